"""Declared schemas of the tables that the workflow reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SOURCE_SAMPLE = struct(id=S, question=S, answer=S, image=S, problem_type=S)
ANSWERED_SAMPLE = struct(id=S, question=S, answer=S, image=S, problem_type=S, model_answer=S, generation_error=B, error_message=S)
JUDGED_SAMPLE = struct(id=S, question=S, answer=S, model_answer=S, image_type=S, problem_type=S, is_correct=B, error_type=S, error_description=S)
GENERATION_INPUT = struct(original_question=S, original_answer=S, original_question_type=S, image_path=S)
GENERATED_QUESTION = struct(question_type=S, image_type=S, question=S, answer=S, image=S)
INCREMENTAL_LOG = T.StructType([*GENERATED_QUESTION.fields, T.StructField("_meta", struct(sample_index=L, timestamp=S, success=B, error=S))])
CANDIDATES = struct(question_id=S, candidate_index=I, text=S)
SCORED_QUESTION = T.StructType([*GENERATED_QUESTION.fields, T.StructField("score", D), T.StructField("consistency_info", struct(consistent_count=I, total_candidates=I, all_candidates=T.ArrayType(S)))])
TRAIN_ROW = struct(problem=S, answer=S, score=D, images=S, problem_type=S, image_type=S)
WEIGHTS = struct(image_type=S, weight=D)
PLAN = struct(question_type=S, image_type=S, plan_summary=S, search_related_query=S, search_new_element_query=S, edit_instruction=S)
REWARD_ROW = struct(overall=D, format=D, accuracy=D)
METRICS = struct(step=L, name=S, value=D)
