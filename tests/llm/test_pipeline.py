"""The pipeline's stages on rows that are easy to get wrong, each against what its operator's plain version says."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import decontaminate


def word(chance) -> str:
    return "".join(chance.choice("abcdefghijklmnop") for _ in range(chance.randint(3, 8)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with nulls, repeats, ties, a very long text and columns named as the operators' own; labels and items."""
    chance = random.Random(6)
    vocabulary = {x: [word(chance) for _ in range(80)] for x in ("aa", "bb")}
    text = lambda x, n: " ".join(chance.choice(vocabulary[x]) for _ in range(n))
    item = text("aa", 30)
    rows = [(k, text(("aa", "bb")[k % 2], 60), ("aa", "bb")[k % 2]) for k in range(80)]
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(5)]  # exact copies under other ids
    rows += [rows[7], rows[7], (7, text("bb", 61), "bb"), (None, text("aa", 62), "aa"), (None, rows[9][1], None)]
    rows += [(200, None, "aa"), (201, "", None), (202, " \n\t", "bb"), (203, "few words only", "aa"), (None, None, None)]
    rows += [(300, f"{text('aa', 200)} {item} {text('aa', 900)}", "aa"), (301, f"{text('aa', 20)} {item}", None), (302, text("bb", 40_000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "rejected": F.lit("own"), "spans": F.lit(1), "items": F.array(F.lit("x")), "key": F.col("doc_id"), "row": F.lit(None).cast("int")})
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 80, 3)] + [(None, 0, 0), (999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item


def test_stages_one_by_one(spark, tables):
    folder, rows, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    good = corpus_pipeline.quality(spark, docs, folder)
    want = sorted((i for i, t, _ in rows if t and len(t.split()) >= 20), key=str)
    assert good.columns == docs.columns and ids(good) == want  # the few windows that repeat are below three in ten words
    known = corpus_pipeline.known_language(spark, good, folder)
    assert known.columns == docs.columns and ids(known) == want
    single = corpus_pipeline.near_duplicates(spark, known, folder)
    texts = {t for i, t, _ in rows if t and len(t.split()) >= 20}
    kept = [(r.doc_id, r.text) for r in single.collect()]
    assert single.columns == docs.columns and sorted(t for _, t in kept) == sorted(texts)
    assert not {100, 101, 102, 103, 104} & {i for i, _ in kept} and sum(i is None for i, _ in kept) == 1
    clean = corpus_pipeline.benchmark_passages(spark, single, folder)
    left = {r.doc_id: r.text for r in clean.collect()}
    before = {i: t for i, t in kept}
    assert clean.columns == docs.columns and set(left) == {i for i, _ in kept} - {301}
    assert len(left[300].split()) == len(before[300].split()) - 30 and item not in left[300]
    assert all(left[i] == before[i] for i in left if i not in (7, 300))
    ends = corpus_pipeline.token_ids(spark, clean, folder)
    assert ids(ends) == ids(clean) and ends.where("n_tokens > 0").count() == clean.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(map(tuple, ends.collect()), key=str)


def test_empty_tables(spark, tables, tmp_path):
    folder, _, _ = tables
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_items_found_beside_columns_of_the_same_names(spark, tables):
    folder, _, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 300")
    found = decontaminate.find_items(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), keep=["doc_id", "key"])
    assert {r.doc_id: (r["items"], r.n_hit) for r in found.collect()} == {300: (["1"], 30), 301: (["1"], 30), 302: ([], 0)}
