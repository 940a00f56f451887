from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tidemill.llm import centroids, vector_codes
from tidemill.llm.centroids import EqualAverage
from tidemill.llm.vector_codes import Orchard

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("high", [2, 5, 1000, 1 << 19])
def test_searches_are_brute_force(high):
    chance = np.random.default_rng(high)
    for _ in range(40):
        k, w = chance.integers(1, 40), chance.integers(1, 9)
        entries, rows = chance.integers(-high, high, (k, w)), chance.integers(-high, high, (chance.integers(1, 200), w))
        apart = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        for found in (Orchard(entries).nearest(rows), EqualAverage(entries).nearest(rows)):
            assert (found[0] == apart.argmin(axis=1)).all() and (found[1] == apart.min(axis=1)).all()


def test_bounds_rule_out_what_is_far():
    chance = np.random.default_rng(1)
    middles = np.arange(0, 64_000, 1000)[:, None] + np.zeros((64, 16), np.int64)
    rows = middles[chance.integers(0, 64, 500)] + chance.integers(-50, 50, (500, 16))
    assert EqualAverage(middles).nearest(rows)[2] < 3 * 500


def kept(rows, size=None):
    fine = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return [r for r in fine if size is None or len(r[1]) == size]


def brute_round(values, books):
    names = ((values[:, None] - books[None]) ** 2).sum(axis=2).argmin(axis=1)
    return np.array([values[names == e].sum(axis=0) // max(1, (names == e).sum()) if (names == e).any() else books[e] for e in range(len(books))])


def odd_rows() -> list:
    chance = np.random.default_rng(7)
    rows = [(k, chance.normal(0, 0.1, 64).astype(np.float32).tolist(), int(k % 3) or None) for k in range(400)]
    rows += [rows[5], rows[5], (None, rows[6][1], 9), (1000, None, 1), (1001, [None] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [float("-inf")] + [0.0] * 63, 2)]
    return rows


def brute_codes(rows):
    rows = sorted(kept(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    values = np.floor(np.array([r[1] for r in rows]) * 1024).astype(np.int64).reshape(len(rows), 4, 16)
    books, codes, errors = [], [], 0
    for p in range(4):
        book = values[:256, p]
        for _ in range(4):
            book = brute_round(values[:, p], book)
        apart = ((values[:, None, p] - book[None]) ** 2).sum(axis=2)
        books.append(book)
        codes.append(apart.argmin(axis=1))
        errors = errors + apart.min(axis=1)
    of = {}
    for r, e in zip(rows, errors.tolist(), strict=True):
        of[r[2]] = of.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(map(str, np.concatenate([b.ravel() for b in books]).tolist())).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{c[k]:02x}" for c in codes), int(errors[k]), of[r[2]], digest) for k, r in enumerate(rows)], key=str)


def test_codes_are_brute_force(spark):
    rows = odd_rows()
    found = vector_codes.report(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, found.collect()), key=str) == brute_codes(rows)
    few = rows[:7]
    assert sorted(map(tuple, vector_codes.report(spark.createDataFrame(few, SCHEMA)).collect()), key=str) == brute_codes(few)


def test_codes_of_odd_lengths_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0, 3.0, 4.5], 1), (3, [1.0] * 8, 1), (4, [1.0] * 5, None), (5, [], None), (6, [3e38] * 4, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.report(docs).collect()}
    assert found == {1: ("00000000", 0, 0), 2: ("00000001", 0, 0), 3: (None, None, 0), 4: (None, None, None), 5: (None, None, None), 6: (None, None, None)}
    assert vector_codes.report(docs.limit(0)).count() == 0
    assert [r.code for r in vector_codes.report(docs.where("vec_id = 5")).collect()] == [None]


def test_decoded_vectors_are_the_entries(spark):
    rows, size = vector_codes.prepare(spark.createDataFrame(odd_rows(), SCHEMA))
    books = vector_codes.train(rows, size, entries=64)
    back = {r.vec_id: r for r in vector_codes.decode(vector_codes.encode(rows, books), books).collect()}
    for r in rows.where("vec_id is not null").collect():
        assert int(((np.array(r.v) - np.array(back[r.vec_id].vector) * 1024) ** 2).sum()) == back[r.vec_id].error


def brute_clusters(rows):
    rows = kept(rows, 64)
    values = np.floor(np.array([r[1] for r in rows]) * 64).astype(np.int64)
    order = sorted((hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), v.tolist()) for r, v in zip(rows, values, strict=True) if r[0] is not None)
    middles = np.array([v for _, v in order[:16]])
    for _ in range(3):
        middles = brute_round(values, middles)
    apart = ((values[:, None] - middles[None]) ** 2).sum(axis=2)
    names, least = apart.argmin(axis=1), apart.min(axis=1)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles.tolist()]
    return sorted([(r[0], int(c), int(d), int(least[names == c].sum()), int(least.sum()), digest[c]) for r, c, d in zip(rows, names, least, strict=True)], key=str)


def test_clusters_are_brute_force(spark):
    rows = [*odd_rows(), (2000, [1.0] * 63, 1), (2001, [], 1)]
    found = centroids.report(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters(rows)
    few = rows[:5] + [rows[0]] * 3
    assert sorted(map(tuple, centroids.report(spark.createDataFrame(few, SCHEMA)).collect()), key=str) == brute_clusters(few)


def test_clusters_of_empty_tables_and_clashing_names(spark):
    table = spark.createDataFrame(odd_rows(), SCHEMA)
    assert centroids.report(table.limit(0)).count() == 0 and centroids.report(table.where("vec_id is null")).count() == 0
    clashing = table.selectExpr("vec_id as n", "embedding as v", "label as place", "1 as cluster", "2 as vec_id", "3 as code", "4 as of", "5 as label", "6 as embedding")
    assert sorted(map(tuple, centroids.report(clashing, "v", "n").collect()), key=str) == brute_clusters(odd_rows())
    assert sorted(map(tuple, vector_codes.report(clashing, "v", "n", "place").collect()), key=str) == brute_codes(odd_rows())
