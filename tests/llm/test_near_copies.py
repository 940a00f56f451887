from __future__ import annotations

import random

import numpy as np

from tidemill.llm import bands, simhash


def grams(text) -> set:
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(a, b) -> bool:
    x, y = grams(a), grams(b)
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def brute_heads(texts) -> list[int]:
    best = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if near(texts[a], texts[b]) and best[a] != best[b]:
                old, new = max(best[a], best[b]), min(best[a], best[b])
                best = [new if x == old else x for x in best]
    return sorted(set(best))


def near_texts() -> list:
    chance = random.Random(3)
    base = [[f"w{chance.randrange(5000)}" for _ in range(300)] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for k, b in enumerate(base):
        for n in (3, 5, 6, 12):  # Jaccard of about 0.9, 0.85, 0.8 and 0.65
            copy = list(b)
            for at in chance.sample(range(300), n):
                copy[at] = f"new{k}-{n}-{at}"
            texts.append(" ".join(copy))
    return texts + [None, "", " \t\n", "One", "one", "a b c d e f", "A b\nc d e f", "a b c d e"]


def test_near_copies_are_brute_force(spark, monkeypatch):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, tries in ((bands.BLOCK, bands.TRIES), (2, 1)):
        monkeypatch.setattr(bands, "BLOCK", block)
        monkeypatch.setattr(bands, "TRIES", tries)
        kept = simhash.drop_near_copies(docs)
        assert sorted(r.doc_id for r in kept.collect()) == brute_heads(texts) and kept.columns == docs.columns
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == brute_heads(texts)


def families(seed: int) -> list[str]:
    """Texts of some templates with ever more words changed: chains of near copies, many pairs about the limit."""
    chance, texts = random.Random(seed), []
    for f in range(3):
        base = [f"f{f}w{chance.randrange(500)}" for _ in range(120)]
        for _ in range(60):
            copy = list(base)
            for _ in range(chance.randrange(6)):
                copy[chance.randrange(120)] = f"x{chance.randrange(10**9)}"
            texts.append(" ".join(copy))
            if chance.random() < 0.1:
                base = copy
    return texts


def test_families_about_the_limit_are_brute_force(spark):
    for seed in (1, 2):
        texts = families(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == brute_heads(texts)


def test_promising_pairs_connect_all_that_are_alike():
    texts = families(3)
    sets = [bands.shingles(bands.words_of(t.encode())) for t in texts]
    sketches = np.stack([np.frombuffer(bands.sketch(s), np.uint8) for s in sets])
    keys, sizes, none = np.arange(len(texts)), np.array(list(map(len, sets))), np.zeros(len(texts), np.int64)
    roots, failed, rounds = keys.copy(), [[] for _ in texts], 0
    while pairs := bands.promising(keys, roots, sizes, sketches, none, failed, 2 * 4**rounds, rounds < 2):
        rounds += 1
        for a, b in pairs:
            if near(texts[a], texts[b]):
                old, new = max(roots[a], roots[b]), min(roots[a], roots[b])
                roots[roots == old] = new
            else:
                failed[a].append(b)
    assert sorted(set(roots.tolist())) == brute_heads(texts) and rounds < 9
    assert sum(map(len, failed)) < len(texts) ** 2 / 8


def test_repeated_and_null_ids(spark):
    x, y, z = ("".join(f"{c}{k} " for k in range(50)) for c in "xyz")
    rows = [(1, x), (1, y), (None, z), (None, z + "end"), (None, x), (2, y), (1, y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_copies(docs).collect()]
    assert sorted(k for k in kept if k[0]) == [(1, x), (1, y)]  # neither of two texts of one id is lost
    assert sorted((r.doc_id, r.text) for r in simhash.deduplicate(docs).collect() if r.doc_id) == [(1, x), (1, y)]
    assert len(kept) == 3 and [i for i, t in kept if t.startswith("z0 ")] == [None]


def test_later_rounds_start_from_stars(spark, monkeypatch):
    texts, given = families(1), []

    def seen(links, write):
        given.append({(r.a, r.b) for r in links.collect()})
        return components(links, write)

    components = bands.components
    monkeypatch.setattr(bands, "components", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == brute_heads(texts)
    assert len(given) > 1
    for before, links in zip(given, given[1:], strict=False):
        heads = {}
        for a, b in before:  # the smallest that links reach
            group = heads.get(a, {a}) | heads.get(b, {b})
            heads.update(dict.fromkeys(group, group))
        stars = {(min(group), x) for x, group in heads.items() if x != min(group)}
        assert stars <= links and not (before - stars) & links
