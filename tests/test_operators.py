from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions import text as X
from tidemill.operators import advantage, balance, batch, curation, diagnosis, grading, quota, rewards, similarity
from tidemill.plans.iteration import Settings, iterate, loop
from tidemill.plans.providers import Canned, Checked, Patient
from tidemill.plans.replies import ask


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


def test_weight_bands_are_strict(spark):
    rows = spark.createDataFrame([(str(a), a) for a in (0.699, 0.70, 0.75, 0.85, 0.90)], "category string, accuracy double")
    got = {r.category: r.raw_weight for r in diagnosis.weights(rows).collect()}
    assert got == {"0.699": 2.0, "0.7": 1.5, "0.75": 1.0, "0.85": 0.8, "0.9": 0.5}


def test_quotas_are_cut_and_the_rest_is_flexible(spark):
    w = spark.createDataFrame([("a", 0.55), ("b", 0.37), ("c", 0.08)], "category string, weight double")
    assert {r.category: r.quota for r in quota.allocate(w, 10).collect()} == {"a": 5, "b": 3, quota.FLEXIBLE: 2}
    assert quota.allocate(w.withColumn("weight", F.lit(0.0)), 10).count() == 0


def test_variants_spread_the_remainder(spark):
    gap = spark.createDataFrame([("a", 7), ("b", 2), ("c", 2)], "category string, gap long")
    sources = spark.createDataFrame([("a", k) for k in range(3)] + [("b", k) for k in range(3)], "category string, source_id long")
    rows = quota.variants(gap, sources).groupBy("category", "source_id").count().collect()
    assert {(r.category, r.source_id): r["count"] for r in rows} == {("a", 0): 3, ("a", 1): 2, ("a", 2): 2, ("b", 0): 1, ("b", 1): 1, ("c", None): 2}


def test_admission_never_exceeds_quotas(spark):
    rows = spark.createDataFrame([(i, random.Random(i).choice("aabc")) for i in range(500)], "arrival long, category string")
    quotas = spark.createDataFrame([("a", 40), (quota.FLEXIBLE, 25)], "category string, quota long")
    got = quota.admit(rows, quotas, ["arrival"]).where("admitted").collect()
    assert sum(r.category == "a" for r in got) == 40 and sum(r.category != "a" for r in got) == 25
    assert max(r.arrival for r in got if r.category == "a") == sorted(r.arrival for r in rows.collect() if r.category == "a")[39]


def test_fill_up_adds_but_never_cuts(spark):
    rows = spark.createDataFrame([(i, i / 10) for i in range(11)], "id long, score double")
    passed = curation.in_band(F.col("score"))
    assert curation.fill_up(rows, passed, 8, ["id"]).count() == 8
    assert curation.fill_up(rows, passed, 2, ["id"]).count() == 6
    assert not curation.fill_up(rows, passed, 2, ["id"]).where("filled").count()
    assert curation.fill_up(rows, passed, 99, ["id"]).count() == 11


@pytest.mark.parametrize(("text", "expected"), [("<think>a\nb</think> \\boxed{3}\n", 1.0), ("<think>a</think> so \\boxed{3}", 0.0), ("\\boxed{3}", 0.0)])
def test_solver_format(spark, text, expected):
    assert one(spark, X.solver_format(F.col("t")), t=text) == expected


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, X.boxed(t), t="x \\boxed{ 1000, 1000 } y \\boxed{2}") == "1000, 1000"
    assert one(spark, X.boxed(t), t="none") is None
    assert one(spark, X.repair_json(t), t='{"a": [1,2,],}') == '{"a": [1,2]}'
    assert one(spark, X.choice_letter(t), t="(b) blue") == "B"
    assert one(spark, X.choice_letter(t), t="xyz") is None
    assert one(spark, X.one_image_tag(t), t="<image 1> q") == " q<image>"
    assert one(spark, X.one_image_tag(t), t="q") == "q<image>"
    assert one(spark, X.one_image_tag(t), t="<image 1> <image 2>") == "<image 1> <image 2>"
    assert one(spark, X.squeeze_tags(t), t="a < b > \u00a0/ c") == "a<b>/c"
    assert one(spark, X.tag_or_all(t, "answer"), t=" <answer> 4 </answer>") == "4"
    assert one(spark, X.without_fence(t), t="x ```json\n{}\n``` y") == "{}"
    assert one(spark, X.keyword_class(t, {"chart": ["bar"], "art": ["art"]}, "mixed"), t="Bar chart") == "chart"
    assert one(spark, X.missing(t), t="None") and not one(spark, X.missing(t), t="none")
    assert one(spark, X.has_choices(t), t="A. x\nB. y\nC. z") and not one(spark, X.has_choices(t), t="A. x")


def test_array_functions(spark):
    assert one(spark, A.response_mask(F.col("i"), [1]), i=[0, 0, 2, 4, 3, 5, 1, 0, 0]) == [1] * 7 + [0, 0]
    assert one(spark, A.position_ids(F.col("i")), i=[0, 0, 1, 1, 1]) == [0, 0, 0, 1, 2]
    assert one(spark, A.fit_left(F.col("i"), 4, 9), i=[1, 2]) == [9, 9, 1, 2]
    assert one(spark, A.fit_right(F.col("i"), 1, 9), i=[1, 2]) == [1]


def test_folds_match_loops(spark):
    r, v, m = ([random.Random(k).gauss(0, 1) for k in range(s, s + 20)] for s in (0, 50, 90))
    mask = [float(x > 0) for x in m]
    gae, carried = [], 0.0
    for k in reversed(range(20)):
        carried = r[k] + 0.9 * (v[k + 1] if k < 19 else 0) - v[k] + 0.9 * 0.8 * carried
        gae.insert(0, carried)
    assert np.allclose(one(spark, A.gae_advantages(F.col("r"), F.col("v"), 0.9, 0.8), r=r, v=v), gae)
    out, carried = [], 0.0
    for k in reversed(range(20)):
        out.insert(0, r[k] + 0.9 * carried)
        carried = out[0] * mask[k]
    assert np.allclose(one(spark, A.discounted_returns(F.col("r"), F.col("m"), 0.9), r=r, m=mask), out)


def test_group_advantages(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", 0.0), ("g", 0.0)], "uid string, score double")
    assert sorted(r.advantage for r in advantage.rloo(rows).collect()) == [-0.5, -0.5, 1.0]
    two = spark.createDataFrame([("g", 1.0), ("g", 0.0)], "uid string, score double")
    assert np.allclose(sorted(r.advantage for r in advantage.grpo(two).collect()), [-0.5 / (0.5**0.5 + 1e-6), 0.5 / (0.5**0.5 + 1e-6)])
    with pytest.raises(Exception, match="one member"):
        advantage.grpo(two.limit(1)).collect()


def test_padding_and_chunks(spark):
    rows = spark.range(3).withColumnRenamed("id", "idx")
    assert sorted((r.idx, r.is_pad) for r in batch.pad_to_divisor(rows, 8).collect()) == [(0, False), (1, False), (2, False), *((k, True) for k in range(3, 8))]
    assert batch.unpad(batch.pad_to_divisor(rows, 8)).count() == 3
    ten = spark.range(10).select(batch.near_equal_chunk(F.col("id"), 10, 4).alias("c")).groupBy("c").count().orderBy("c").collect()
    assert [r["count"] for r in ten] == [3, 3, 2, 2]
    with pytest.raises(ValueError, match="equal"):
        batch.equal_chunk(F.col("id"), 10, 4)


def test_union_conflict_fails(spark):
    a = spark.createDataFrame([(1, 2)], ["k", "v"])
    with pytest.raises(Exception, match="v differs"):
        batch.column_union(a, spark.createDataFrame([(1, 3)], ["k", "v"]), "k").collect()


def test_index_is_complete(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 as x")
    got = batch.with_index(rows, ["x"]).collect()
    assert all(r.idx == r.x for r in got) and len(got) == 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=40), st.integers(1, 5))
def test_partitions_cover_all_rows(lengths, k):
    for equal in (False, True):
        if equal:
            lengths = lengths[: len(lengths) // k * k]
        for method in (balance.largest_differencing, balance.greedy):
            lists = method(lengths, k, equal)
            assert len(lists) == k and sorted(i for x in lists for i in x) == list(range(len(lengths)))
            if equal:
                assert len({len(x) for x in lists}) == 1


def test_differencing_beats_order():
    lists = balance.largest_differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in x) for x in lists) == [14, 16]


def test_bleu_and_clusters():
    a = "the cat sat on the mat today".split()
    assert similarity.bleu(a, a) == pytest.approx(1.0)
    assert similarity.bleu(a, ["dog"]) == 0.0


def test_answers_and_votes(spark):
    assert grading.boxed_balanced("x \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}"
    assert grading.same_answer("$\\frac{1}{2}$", "0.5") and grading.same_answer("1,000", "1000.0") and not grading.same_answer("a", "b")
    rows = spark.createDataFrame([("q", 0, "2"), ("q", 1, "0.5"), ("q", 2, "\\frac{1}{2}"), ("q", 3, ""), ("r", 0, "")], "question_id string, candidate_index int, text string")
    got = {r.question_id: (r.answer, r.votes, r.score) for r in grading.majority_of_classes(rows).collect()}
    assert got == {"q": ("0.5", 2, 2 / 3), "r": (None, 0, 0.0)}
    assert {r.question_id: r.total for r in grading.majority(rows, "question_id", "text", ["candidate_index"], "all").collect()} == {"q": 4}


def test_user_rewards(spark, tmp_path):
    (tmp_path / "f.py").write_text("def one(text, weight):\n    return {'overall': weight * len(text)}\n\ndef many(text):\n    return [{'overall': float(len(text))} for _ in text]\n")
    rows = spark.createDataFrame([(1, "ab"), (2, "c")], "id long, text string")
    f = rewards.load_function(f"{tmp_path}/f.py:one", weight=2.0)
    assert {r.id: r.overall for r in rewards.row_rewards(rows, f, ["text", "image"], "id").collect()} == {1: 4.0, 2: 2.0}
    g = rewards.load_function(f"{tmp_path}/f.py:many")
    assert [r.overall for r in rewards.batch_rewards(rows.withColumn("b", F.lit(1)), g, ["text"], "id", "b").collect()] == [2.0, 2.0]
    with pytest.raises(ValueError, match="no function"):
        rewards.load_function(f"{tmp_path}/f.py:missing")


def test_providers(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, None)], "id long, prompt string")
    got = {r.id: r.reply for r in ask(rows, "prompt", Canned()).collect()}
    assert got[1] == got[2] in ("yes", "no") and got[3] is None
    pauses = []

    class Flaky:
        def call(self, prompts):
            if len(pauses) < 2:
                raise OSError
            return prompts

    assert Patient(Flaky(), sleep=pauses.append).call(["a"]) == ["a"] and pauses == [2.0, 4.0]


def test_iteration(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = labels.join(docs, "doc_id").select(F.col("source").alias("category"), (F.col("quality") == 1).alias("is_correct"))
    sources = docs.select(F.col("source").alias("category"), F.col("doc_id").alias("source_id"), F.substring("text", 1, 30).alias("question"))
    got = iterate(judged, sources, Canned(), Settings(generated=60, target=40, candidates=5))
    assert got.count() >= 40 and got.select("question_id").distinct().count() == got.count()


def test_rows_without_a_group_stay(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 6.0)], "uid string, score double")
    assert sorted(r.advantage for r in advantage.rloo(rows).collect()) == [-4.0, -2.0, 2.0, 4.0]
    assert advantage.grpo(rows).count() == 4
    base = spark.createDataFrame([("a", 1.0), (None, 2.0)], "uid string, baseline double")
    assert sorted(r.advantage for r in advantage.remax(rows, base).collect()) == [0.0, 0.0, 2.0, 4.0]


@pytest.mark.parametrize("range_rows", [1, 7, 1000])
def test_ranks_over_ranges(spark, range_rows):
    chance = random.Random(4)
    rows = [(chance.choice(["a", "b", None]), chance.choice([None, "x", "y", "zz"]), chance.randint(0, 5), k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, s string, n int, id long")
    got = {r.id: r.place for r in quota.ranked_within(df, "g", ["s", "n", "id"], "place", range_rows).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or "", r[2], r[3]))
        assert [got[r[3]] for r in own] == list(range(1, len(own) + 1))
    assert quota.ranked_within(df.limit(0), "g", ["id"], "place", range_rows).count() == 0


def test_ranks_over_ranges_with_columns_of_any_name(spark):
    rows = [(k % 3, k * 7 % 50, k, -k, k + 1, 2 * k) for k in range(50)]
    df = spark.createDataFrame(rows, "__g int, b int, __part int, __P int, __before int, __held int")
    got = {r["b"]: r for r in quota.ranked_within(df, "__g", ["b"], "__n", 7).collect()}
    for g in range(3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        assert [tuple(got[r[1]]) for r in own] == [(*r, k + 1) for k, r in enumerate(own)]


def test_weakness_examples_and_error_descriptions_over_ranges(spark, monkeypatch):
    rows = [(f"t{k % 2}" if k % 5 else None, "d" if k % 3 else None, 100 - k, k) for k in range(60)]
    found = spark.createDataFrame(rows, "question_type string, description string, example_id long, seen long")
    judged = found.select("question_type", "description", F.concat(F.lit("text "), F.lpad(F.col("seen").cast("string"), 3, "0")).alias("text"), F.lit(False).alias("is_correct"))
    plans = [lambda: diagnosis.weakness_examples(found), lambda: diagnosis.error_descriptions(judged, ["question_type", "description"], "text")]
    plain = [sorted(map(str, plan().collect())) for plan in plans]
    monkeypatch.setattr(quota, "RANGE_ROWS", 9)
    assert [sorted(map(str, plan().collect())) for plan in plans] == plain


def test_one_valid_token(spark):
    rows = spark.createDataFrame([([1.0, 5.0], [0.0, 1.0])], "v array<double>, m array<double>")
    got = advantage.masked_moments(rows, "v", "m").first()
    assert abs(got.mean - 5.0) < 1e-6 and got["var"] == pytest.approx(0.0, abs=1e-12)
    assert len(advantage.whiten(rows, "v", "m").first().whitened) == 2


def test_comparison_of_huge_answers_ends():
    assert not grading.same_answer("1e99999999", "2e99999999") and grading.same_answer("1e3", "1000")
    assert not grading.same_answer("9" * 5000, "9" * 5000 + "1") and grading.same_answer("9" * 5000, "9" * 5000)


def test_votes_count_equal_texts_once(spark):
    rows = [("q", 5, "1.0"), ("q", 1, "2"), ("q", 2, "1"), ("q", 3, "2.0"), ("q", 4, "1"), ("q", 6, None), ("none", 0, ""), (None, 0, "x")]
    df = spark.createDataFrame(rows, "question_id string, candidate_index long, text string")
    got = {r.question_id: tuple(r)[1:] for r in grading.majority_of_classes(df).collect()}
    assert got == {"q": ("1", 3, 5, 0.6), "none": (None, 0, 0, 0.0), None: ("x", 1, 1, 1.0)}
    assert {r.total for r in grading.majority_of_classes(df, denominator="all").collect()} == {6, 1}


def test_replies_keep_the_callers_columns(spark):
    rows = spark.createDataFrame([("hi", 1, 2), ("hi", 3, 4), (None, 5, 6)], "prompt string, p long, r long")
    got = ask(rows, "prompt", Canned(("ok",)))
    assert got.columns == ["prompt", "p", "r", "reply"] and sorted(map(tuple, got.collect()), key=str) == sorted([("hi", 1, 2, "ok"), ("hi", 3, 4, "ok"), (None, 5, 6, None)], key=str)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_folds_over_blocks(spark, n):
    chance = random.Random(n)
    rewards, mask = [chance.random() for _ in range(n)], [float(chance.random() < 0.8) for _ in range(n)]
    rows = spark.createDataFrame([(rewards, mask)], "r array<double>, m array<double>")
    got = rows.select(A.discounted_returns(F.col("r"), F.col("m"), 0.9).alias("d"), A.position_ids(F.transform("m", lambda x: x.cast("long"))).alias("p")).first()
    carried, want = 0.0, []
    for r, m in zip(rewards[::-1], mask[::-1], strict=True):
        want.append(r + 0.9 * carried)
        carried = want[-1] * m
    assert got.d == pytest.approx(want[::-1])
    assert got.p == [max(int(sum(mask[: k + 1])) - 1, 0) for k in range(n)]


def test_variants_of_large_and_missing_sources(spark, monkeypatch):
    monkeypatch.setattr(quota, "RANGE_ROWS", 10)
    gap = spark.createDataFrame([("a", 7), ("c", 2)], "category string, gap long")
    sources = spark.createDataFrame([("a", k) for k in range(50)] + [("a", None), ("other", 1)], "category string, source_id long")
    got = sorted(map(tuple, quota.variants(gap, sources).collect()), key=str)
    assert got == sorted([*(("a", k, 0, 1) for k in range(7)), ("c", None, 0, 2), ("c", None, 1, 2)], key=str)


def test_restored_state_keeps_counts(spark):
    old = spark.createDataFrame([("a", 5), ("b", 2), (quota.FLEXIBLE, 3)], "category string, quota long")
    new = spark.createDataFrame([("a", 6), ("b", 2), (quota.FLEXIBLE, 4)], "category string, quota long")
    counts = spark.createDataFrame([("a", 4), (quota.FLEXIBLE, 1)], "category string, count long")
    state, changes = quota.restore(quota.snapshot(old, counts), new)
    assert {tuple(r) for r in state.collect()} == {("a", 6, 4), ("b", 2, 0), (quota.FLEXIBLE, 4, 1)}
    assert [tuple(r) for r in changes.collect()] == [("a", 5, 6)]


def test_checked_providers():
    said = iter(["bad", "good", "good"])

    class Wavering:
        def call(self, prompts):
            return [next(said) for _ in prompts]

    assert Checked(Wavering(), lambda r: r == "good", retries=1).call(["x", "y"]) == ["good", "good"]
    assert Checked(Canned(("no",)), lambda r: r == "good", retries=1).call(["x"]) == [None]


def test_loop_goes_on_where_it_stopped(spark, folder, tmp_path):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = labels.join(docs, "doc_id").select(F.col("source").alias("category"), (F.col("quality") == 1).alias("is_correct"))
    sources = docs.select(F.col("source").alias("category"), F.col("doc_id").alias("source_id"), F.substring("text", 1, 30).alias("question"))
    asked = []

    def judge(model, k):
        asked.append((model, k))
        return judged

    run = lambda n: loop("v0", judge, lambda m, made, k: f"v{k}:{made.count()}", sources, Canned(), str(tmp_path), n, Settings(generated=40, target=20, candidates=3))
    first = run(1)
    assert first == "v1:20" and run(2) == "v2:20" and asked == [("v0", 1), ("v1:20", 2)]


def test_classes_by_form_are_the_fold(spark):
    chance = random.Random(8)
    texts = ["2", "2.0", "4/2", "\\frac{4}{2}", "no idea", "No  idea", "no answer", "there is no x", "x", "X.", "3", "no 3", "NO idea", "", None]
    rows = [(f"q{q}" if q else None, k, chance.choice(texts[: 4 + q % 12])) for q in range(60) for k in range(chance.randrange(1, 12))]
    df = spark.createDataFrame(rows, "question_id string, candidate_index int, text string").repartition(4)
    fold = grading.majority_of_classes(df, lambda a, b: grading.same_answer(a, b))
    assert sorted(map(tuple, grading.majority_of_classes(df).collect()), key=str) == sorted(map(tuple, fold.collect()), key=str)
