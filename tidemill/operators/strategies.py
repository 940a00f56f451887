"""How images of each type may be edited, as a small table that is joined to the plans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Image type, priority, how much may be edited, its scope, and the
# scores from which an image has the quality and can be used as it is.
STRATEGIES = [
    ("geometric", "use_search_heavily", "minimal", "tiny_adjustments", 9.0, 7.5),
    ("medical", "use_search_heavily", "minimal", "annotations_only", 9.5, 7.0),
    ("chart_graph", "use_search_preferred", "moderate", "data_labels", 8.5, 7.0),
    ("text_dense", "use_search_preferred", "targeted", "key_text_only", 8.0, 7.0),
    ("diagram", "use_search_preferred", "moderate", "structure_aware", 8.0, 7.0),
    ("math_formula", "use_search_heavily", "minimal", "specific_symbols", 9.5, 7.5),
    ("map", "use_search_preferred", "moderate", "labels_and_markers", 8.0, 7.0),
    ("natural_scene", "use_search_balanced", "flexible", "broad_changes", 7.0, 6.5),
    ("artistic", "generation_friendly", "very_flexible", "creative", 6.5, 6.0),
    ("everyday_object", "use_search_balanced", "moderate", "object_properties", 7.5, 6.5),
    ("architectural", "use_search_preferred", "moderate", "details_and_context", 8.0, 6.8),
    ("mixed", "use_search_balanced", "moderate", "careful_mixed", 7.5, 6.5),
]
SEARCHED = ("use_search_heavily", "use_search_preferred")
OTHER = "mixed"
COLUMNS = "image_type string, priority string, edit_allowed string, edit_scope string, quality_threshold double, can_use_threshold double"
#: Our own wording; a table of templates by image type may replace it.
TEMPLATE = "Edit within this scope: {edit_scope}. Changes allowed: {edit_allowed}.\nWhat to do: {instruction}"


def table(spark: SparkSession, templates: Mapping[str, str] | None = None) -> DataFrame:
    """The twelve types with their template and whether search comes before generation."""
    given = templates or {}
    rows = [(*r, given.get(r[0], TEMPLATE)) for r in STRATEGIES]
    return spark.createDataFrame(rows, f"{COLUMNS}, template string").withColumn("prefer_search", F.col("priority").isin(*SEARCHED))


def with_strategy(plans: DataFrame, strategies: DataFrame, image_type: str = "image_type", instruction: str = "instruction") -> DataFrame:
    """Adds the type's attributes, those of ``mixed`` for a type that is not known, and edit_instruction, the filled template."""
    known = F.when(F.col(image_type).isin(*(r[0] for r in STRATEGIES)), F.col(image_type)).otherwise(OTHER)
    joined = plans.withColumn("__type", known).join(F.broadcast(strategies.withColumnRenamed("image_type", "__type")), "__type")  # twelve rows
    filled = F.col("template")
    for name in ("edit_scope", "edit_allowed", "instruction"):
        filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(F.col(instruction if name == "instruction" else name), F.lit("")))
    return joined.withColumn("edit_instruction", filled).drop("__type", "template")


def usable_as_is(plans: DataFrame, score: str = "score") -> DataFrame:
    """Adds can_use: whether the image's score reaches its type's threshold."""
    return plans.withColumn("can_use", F.coalesce(F.col(score) >= F.col("can_use_threshold"), F.lit(False)))
