from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, language, quality_rules, url_rules

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(text, items):
    words = WORD.findall((text or "").encode().lower())
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = WORD.findall((t or "").encode().lower())
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[j : j + n]:
                    hit[k : k + n] = [True] * n
                    found.add(str(item))
    n = sum(hit)
    return len(words), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(words)


@pytest.mark.parametrize("block", [decontaminate.ITEM_BYTES, 200])
def test_contamination_is_brute_force(spark, block):
    chance = random.Random(5)
    word = lambda: chance.choice(["the", "of", "sat", "Ünder", "x1", "mat"])
    items = [(k, " ".join(word() for _ in range(chance.choice([1, 5, 13, 14, 30])))) for k in range(12)] + [(90, ""), (91, None), (3, "the of sat mat")]
    docs = [(k, " ".join(word() for _ in range(chance.choice([0, 3, 40, 200])))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "clean - words, ONLY"), (103, f"start {items[4][1].upper()}! end"), (103, f"start {items[4][1]} end")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_items(docs_df, items_df, block_bytes=block)
    got = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found.collect())
    assert got == sorted((d, *brute_contamination(t, items)) for d, t in docs)


def test_contaminated_documents_go_and_spans_are_cut(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    filler = " ".join(f"w{k}" for k in range(600))
    docs = spark.createDataFrame([(1, item), (2, f"{filler} {item}. {filler}"), (3, filler), (4, None)], "doc_id long, text string").withColumn("n_hit", F.lit("own"))
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert set(got) == {2, 3, 4} and got[2].text == f"{filler} . {filler}" and got[3].text == filler and got[4].text is None
    assert got[2].n_hit == "own"
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert decontaminate.report(docs.drop("n_hit"), items.limit(0)).where("contaminated").count() == 0


def rules_of_thumb(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")))


@pytest.mark.parametrize(("sent", "rows"), [(url_rules.MAX_SENT, 1), (3, url_rules.RANGE_ROWS), (3, 6)])
def test_url_rules(spark, sent, rows):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "/en/", "allow")]
    chance = random.Random(1)
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?u=://y", "https://example.org", "x://org/", "s://xexample.org/es/", "s://b.a.example.org/en/12#z", "s://..org/", "http://example.org/es/\nx"]
    urls += [f"http://{chance.choice(['', 'a.', 'b.a.', 'www.'])}{chance.choice(['example.org', 'org', 'com', 'exampleorg', 'net'])}/{chance.choice(['es/', 'en/1', 'fr/x', 'de/', ''])}" for _ in range(150)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = sorted(map(tuple, url_rules.judge(pages, spark.createDataFrame(rules, url_rules.RULES), max_sent=sent, range_rows=rows).collect()))
    assert got == [(k, *rules_of_thumb(u, rules)) for k, u in enumerate(urls)]
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(rules, url_rules.RULES), max_sent=sent, range_rows=rows).count() == 0
    assert url_rules.judge(pages, spark.createDataFrame([], url_rules.RULES)).where("rule is not null").count() == 0


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    hit = {i for p in places.values() if len(p) > 1 for k in p for i in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_statistics_are_brute_force(spark):
    chance = random.Random(2)
    texts = [None, "", " \n\t ", "a", "x\u00a0y \x0b\x0c z", "é ü\r\nß", "#*$%&|<> |"]
    texts += [" ".join(chance.choice(["a", "bb", "c\n", "\n\n", "d#"]) for _ in range(chance.choice([7, 8, 9, 16, 60, 300]))) for _ in range(60)]
    texts.append("long " * 30_000 + " ".join(map(str, range(30_000))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.report(docs, labels).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_statistics(t), k
        assert r.kept == (not r.base_failed)


def test_learned_rules_separate(spark, folder):
    chance = random.Random(4)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(chance.randint(2, 7)))
    good = [" ".join(word() for _ in range(60)) for _ in range(300)]
    bad = [" ".join(word() + "###" for _ in range(60)) for _ in range(150)] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string").withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(k, int(k < 300), None) for k in range(0, 600, 2)] + [(None, 1, 0), (9999, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    assert kept == set(range(300))
    assert quality_rules.keep_good(docs, labels).columns == docs.columns
    learned = quality_rules.learn_list(quality_rules.labelled_sample(docs, labels))
    assert 1 <= len(learned.rules) <= 4 and "case" not in str(learned).lower()


def test_verdicts_are_those_of_the_list_in_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = quality_rules.learn_list(quality_rules.labelled_sample(docs, labels))
    assert learned.rules

    def rejected(text):
        n, chars, symbols, dups, repeats, failed = brute_statistics(text)
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        row = {"mean_word": chars / max(n, 1), "symbols_a_word": symbols / max(n, 1), "marks_a_word": (text or "").count("!") / max(n, 1), "capitals_a_character": len(re.findall("[A-Z]", text or "")) / max(chars, 1)}
        row |= {"twins_a_word": sum(a == b for a, b in zip(w, w[1:])) / max(n, 1), "repeats_a_word": repeats / max(n, 1), "dup_lines": float(dups), "words": float(n)}
        return failed or any(all(c.holds(row) for c in rule) for rule in learned.rules)

    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {k for k, t in texts.items() if not rejected(t)}
    assert {r.doc_id for r in quality_rules.report(docs, labels).where("kept").collect()} == want
    assert {r.doc_id for r in quality_rules.keep_good(docs, labels).select("doc_id").collect()} == want


def test_sample_of_labels(spark):
    docs = spark.createDataFrame([(k % 50, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(500)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(5000)], "doc_id long, quality int, toxic int")
    rows = quality_rules.labelled_sample(docs, labels, limit=60)
    assert len(rows) == 50 == len(quality_rules.labelled_sample(docs.unionByName(docs), labels, limit=60))  # labels without a document take no room
    assert quality_rules.labelled_sample(docs, labels, limit=60) == rows and len(quality_rules.labelled_sample(docs, labels, limit=7)) == 7
    text = docs.where("doc_id is not null")
    plan = quality_rules.keep_good(text, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") <= 2  # lines and windows, once each


def test_plan_of_quality_rules_has_no_python(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality_rules.report(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 34 -- ²", "en"), (None, "the and of", None), (10**6 + 2, "", None)], "doc_id long, text string, lang string")
    rows = language.report(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r.score <= 1 for r in rows)
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in true]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.99 * len(held) > 100
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id is not None and r.doc_id >= 10**6)


def test_language_edges(spark):
    none = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.report(none).collect()} == {("und", 0.0)}
    assert language.report(none.limit(0)).count() == 0
    taught = spark.createDataFrame([(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 20, "en" if k % 2 else "de") for k in range(60)] + [(100, "zzzz qqqq xxxx wwww kkkk jjjj vvvv " * 9, "en")], "doc_id long, text string, lang string").withColumn("rejected", F.lit("mine"))
    kept = language.keep_known(taught)
    assert kept.columns == taught.columns and {r.doc_id for r in kept.collect()} >= set(range(60))


def dictionary_kneser_ney(top, order, base):
    """Plain interpolated Kneser-Ney over dictionaries: probability of a character behind a context, and the discounts' weights."""
    counts = {order: dict(top)}
    for n in range(order - 1, 0, -1):
        counts[n] = defaultdict(int)
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1

    def discount(n):
        ones, twos = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(context, c):
        if len(context) == 0:
            below = base
        else:
            below = p(context[1:], c)
        of = {g: v for g, v in counts[len(context) + 1].items() if g[:-1] == context}
        if not of:
            return below
        d, total = discount(len(context) + 1), sum(of.values())
        return max(of.get(context + c, 0) - d, 0) / total + d * len(of) / total * below

    return p


def small_corpus(spark):
    chance = random.Random(8)
    words = {"xx": ["ana", "banana", "an", "bé", "naan"], "yy": ["oto", "moto", "tom", "om", "ot"], "zz": ["ana", "oto", "\U00020000\u4e2d"]}
    rows = [(k, " ".join(chance.choice(words[x]) for _ in range(30)), x) for k in range(45) for x in [("xx", "yy", "zz")[k % 3]]]
    return spark.createDataFrame([*rows, (None, "an", "xx"), (77, None, "xx"), (78, "12", "yy"), (79, "tom", None)], "doc_id long, text string, lang string")


def test_models_are_plain_kneser_ney(spark):
    docs = small_corpus(spark)
    models = language.learn(docs)
    tops = defaultdict(lambda: defaultdict(int))
    for r in docs.where("text is not null and lang is not null").collect():
        for w in re.findall(r"[^\W\d]+", r.text):
            padded = "\x02\x02\x02" + w + "\x03"
            for k in range(len(w) + 1):
                tops[r.lang][padded[k : k + 4]] += 1
    base = 1 / (len({g[-1] for t in tops.values() for g in t}) + 1)
    plain = {x: dictionary_kneser_ney(t, 4, base) for x, t in tops.items()}
    words = ["ana", "tomana", "é", "q", "\U00020000\u4e2dom", "x" * 300]
    got = models.arrays.word_scores(words)
    for w, row in zip(words, got, strict=True):
        padded = "\x02\x02\x02" + w + "\x03"
        for x, v in zip(models.judge.languages, row, strict=True):
            want = sum(math.log(plain[x](padded[k : k + 3], padded[k + 3])) for k in range(len(w) + 1))
            assert abs(v - want) < 1e-4 * max(1, abs(want)), (w, x)
    # of what follows any context, the probabilities come to one
    chars = {g[-1] for t in tops.values() for g in t}
    for context in ("", "a", "an", "ana"):
        assert abs(sum(plain["xx"](context, c) for c in [*chars, "unseen"]) - 1) < 1e-9


def test_joined_models_predict_the_same(spark):
    docs = small_corpus(spark).withColumn("row", F.lit("own")).withColumn("kept", F.lit(1))
    docs = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(90, "tom " * 20_000 + "q" * 20_000, None, "own", 1), (91, "", "xx", "own", 1), (91, "", "xx", "own", 1)], docs.schema))
    taught = docs.where("lang is not null and doc_id < 60")
    small, large = language.learn(taught), language.learn(taught, max_cells=0)
    assert large.arrays is None and small.entries is None
    assert abs(small.judge.limit - large.judge.limit) < 1e-4 and abs(small.judge.slack - large.judge.slack) < 1e-3
    keep = ["doc_id", "row", "kept"]
    rows = [sorted(map(tuple, language.predict(docs, m, keep=keep).select(*keep, "lang_pred", F.round("score", 3), "rejected").collect()), key=str) for m in (small, large)]
    assert rows[0] == rows[1] and len(rows[0]) == docs.count()
    assert language.predict(docs.limit(0), large, keep=keep).count() == 0


def test_text_of_no_language_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    chance = random.Random(2)
    long = [r for r in docs.where("length(text) > 600").orderBy("doc_id").limit(200).collect()]
    noise = [(10**6 + k, "".join(chance.sample(r.text, len(r.text))), None) for k, r in enumerate(long)]
    kept = {r.doc_id for r in language.keep_known(docs.unionByName(spark.createDataFrame(noise, docs.schema))).select("doc_id").collect()}
    assert sum(k >= 10**6 for k in kept) <= 0.05 * len(noise)  # 95 in 100 are rejected
    assert sum(k < 10**6 for k in kept) >= 0.995 * docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_calibration_of_few_or_wrong_labels(spark, monkeypatch):
    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 20, "en" if k % 2 else "de") for k in range(60)]
    taught = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bare = spark.range(1000, 9000).select(F.col("id").alias("doc_id"), F.lit("no label").alias("text"), F.lit(None).cast("string").alias("lang"))
    monkeypatch.setattr(language, "CALIBRATION", 20)
    models = language.learn(taught.unionByName(bare))
    judge, score = models.judge, models.arrays.cross_entropies
    assert judge.limit < float("inf")
    texts, labels = [t for _, t, _ in rows], [x for _, _, x in rows]
    judge.calibrate(texts, labels, score)
    limit, slack = judge.limit, judge.slack
    judge.calibrate([*texts, "der hund und die katze " * 2000], [*labels, "en"], score)
    assert abs(judge.limit - limit) < 0.1 and judge.slack <= slack + 0.1
