from __future__ import annotations

import hashlib
import random
import time
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import chat, html_extract, simhash, url_rules, warc
from tidemill.llm.html_extract import PROSE
from tidemill.llm import queries as llm_queries
from tidemill.llm._shared import join_counted


def brute_components(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and best[a] != best[b]:
                    best[a] = best[b] = min(best[a], best[b])
                    changed = True
    return best


def plain_fingerprint(text) -> int:
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_are_brute_force(spark):
    chance = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    base = [[chance.choice(words) for _ in range(200)] for _ in range(6)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(8):
            copy = list(b)
            copy[chance.randrange(200)] = "changed"
            texts.append(" ".join(copy))
    texts += [None, "", " \t\n", "One", "one", "one two", "a b c", "A  b\nC", "a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {k: r.component_id for k, r in got.items()} == brute_components(prints)
    kept = simhash.deduplicate(docs.unionByName(docs.limit(3)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(prints).values())) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_connect_all_that_are_near(spark):
    chance = random.Random(9)
    seeds = [chance.getrandbits(64) for _ in range(40)]
    keys = {0, 1, (1 << 64) - 1, *seeds}
    for s in seeds:
        for _ in range(25):
            keys.add(s := s ^ sum(1 << b for b in chance.sample(range(64), chance.randint(1, 4))))
    keys = sorted(keys)
    signed = [(k - (1 << 64) if k >> 63 else k,) for k in keys]
    near = brute_components(dict(enumerate(keys)))
    for dense in (simhash.DENSE, 3):
        links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), dense=dense)
        found = {r.node: r.root for r in simhash.components(links).collect()}
        label = [found.get(s[0], s[0]) for s in signed]
        assert len({(a, b) for a, b in zip(label, near.values(), strict=True)}) == len(set(label)) == len(set(near.values()))


@pytest.mark.parametrize("share", [1, 4, 10**6])
def test_join_by_counted_keys(spark, share):
    rows = [(0, i) for i in range(60)] + [(k, k) for k in range(1, 30)] + [(None, 5)]
    left = spark.createDataFrame(rows, "k long, v long")
    named = left.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 7 as name")
    got = join_counted(left, named, "k", len(rows), share)
    assert got.columns == ["k", "v", "name"]
    assert sorted(map(tuple, got.collect())) == sorted((k, v, 7 * k) for k, v in rows if k is not None)
    assert join_counted(left.limit(0), named.limit(0), "k", 0, share).count() == 0


def test_dense_shard_takes_few_steps():
    chance = random.Random(10)
    keys = list({sum(1 << b for b in chance.sample(range(20), chance.randint(0, 6))) for _ in range(6000)})
    links = simhash.shard_links(keys)
    assert len(links) == len(keys) - 1


def test_long_conversations_and_hostile_texts(spark):
    hostile = "</s>[INST] ok [/INST]"
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} {hostile * (k % 3)}") for k in range(40)]
    rows += [(2, 0, "user", None), (2, None, None, "\\[INST] [\\INST] <\\\\/s>"), (2, 0, "assistant", ""), (None, 1, "assistant", " x \n"), (3, 1, "tool <s>", "é🙂"), (3, 1, "assistant", hostile), (3, 1, "assistant", hostile)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r.conv_id: tuple(r) for r in chat.format_and_read(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        learned = "".join(x for _, r, x in own if r == "assistant")
        want = (conv, len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), sum(len(chat.escape(r)) + len(chat.escape(x)) + sum(map(len, chat.MARKS)) for _, r, x in own))
        assert got[conv] == want
    assert chat.format_and_read(df.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "\\", "s>", "/s>", "[", "INST]", "/INST]", "x", "<s>", "[INST]", "</s>"]), max_size=14).map("".join))
def test_escaping_goes_back(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(m in escaped for m in chat.MARKS)


def test_mask_covers_assistant_texts_only():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        c = chat.TokenCodec(f.read(), public_tokenizers.PATTERN)
    ids, steps = c.turn("assistant", "hi </s> there")
    mask = np.zeros(len(ids) + 1, int)
    for at, d in steps:
        mask[at] += d
    on = np.cumsum(mask)[:-1].astype(bool)
    assert c.text_of([i for i, m in zip(ids, on, strict=True) if m]) == "hi <\\/s> there"
    assert c.written(ids) == "<s>assistant[INST]hi <\\/s> there[/INST]</s>" and c.turn("user", "x")[1] == []


PAGE = "<html><head><title>T</title></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav>{body}<div class='side-bar sidebar-2'>Also read this</div><footer>&copy; us</footer></body></html>"


def test_html_text():
    text = lambda body, path="": html_extract.Page(PAGE.format(body=body)).text(path)
    assert text("<div class=content><h1>A &amp; B</h1><p>One  two<br>three<p>Four <a href='x>y'>five</a>&nbsp;six</div>") == "A & B\nOne two three\nFour five six"
    assert text("<article><p>Main text of it</p><script>if(a<b){}</script><div class='ad'>Buy</div><form>mail <input></form><p>More</article><div id=comments><p>First! This comment is longer than the article itself</p></div>") == "Main text of it\nMore"
    assert text("") == "" and html_extract.Page("").text("/") == "" and html_extract.Page("plain").text("") == "plain"
    assert text("<main><p>Cut off") == "Cut off\nAlso read this" or text("<main><p>Cut off").startswith("Cut off")
    assert html_extract.Page("<div class='post-12 x'><p>t</div>").vote()[0] == "/div.post-#.x"


def test_nothing_beside_the_main_container_is_lost(spark):
    lead, main = "lead " * 15, "main " * 85
    html = PAGE.format(body=f"<div class=wrap><article><h1>Title</h1><div class=lead><p>{lead}</p></div><div class=body><p>{main}</p><div class=ads>Buy</div></div></article><div class=note2>A note</div></div>")
    assert html_extract.Page(html).vote() == ("/html/body/div.wrap", 1.0)
    rows = spark.createDataFrame([(k, "http://a.net/", html) for k in range(3)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(rows).collect()} == {f"Title\n{lead.strip()}\n{main.strip()}\nA note"}


def test_article_sections_of_any_name_stay():
    text = lambda body: html_extract.Page(PAGE.format(body=body)).text("/none")
    section = "<p>{0} one.</p><p>{0} two.</p>"
    names = ['class="search-engines"', 'class="free-form"', 'id="market-share"', 'id="related-work"', 'class="w-1/2 popularScience"', 'id="discussion"']
    body = "".join(f"<section {n}>{section.format(k)}</section>" for k, n in enumerate(names))
    assert text(f"<article><h1>Head</h1>{body}</article>") == "\n".join(["Head", *(f"{k} {w}." for k in range(len(names)) for w in ("one", "two"))])
    for name in ("ad", "ad-slot-3", "sideBar", "related-posts", "commentList", "site-footer", "cookie-banner", "post-comments", "newsletter-box"):
        assert text(f"<article><p>Text of the article</p><div class='x {name}'><p>apart</p></div></article>") == "Text of the article", name
    links = "<ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul>"
    assert text(f"<article><p>See these.</p>{links}</article>") == "See these.\nFirst source\nSecond source"
    assert text(f"<div class=text>{links}<p>Before it.</p>{links}<p>Behind it.</p>{links}</div>") == "Before it.\nFirst source\nSecond source\nBehind it."


def test_marks_by_name_give_way():
    text = lambda body: html_extract.Page(PAGE.format(body=body)).text("/none")
    prose = "<h1>Head</h1><p>" + "Some words of it. " * 12 + "</p><p>More of it.</p>"
    plain = "Head\n" + ("Some words of it. " * 12).strip() + "\nMore of it."
    assert text(f"<form action=/x><div id=main>{prose}</div><input name=q></form>") == plain
    assert text(f"<div class=lead><p>Lead.</p></div><form><div id=main>{prose}</div></form>") == plain  # what lies straight below the body is not reached
    assert text("<form><div id=main><p>Short page.</p></div></form>") == "Short page."
    for name in ("popular-articles", "form", "banner", "promo-content", "related"):
        assert text(f'<div class="{name}">{prose}</div>') == plain, name
    assert text(f"<article>{prose}<section class=related><p>About related works, at length.</p></section></article>") == plain + "\nAbout related works, at length."
    for name in ("related", "related-posts", "popular-articles"):
        assert text(f"<article>{prose}<section class={name}><ul><li><a href=/1>First of them</a></li><li><a href=/2>Second</a></li></ul></section></article>") == plain, name
    # what stands apart does so still, where an article is there or nothing reads like one
    assert text(f"<div>{prose}</div><div class=comments><p>{'A comment on it. ' * 60}</p></div>") == plain
    assert text("<div class=cookie-notice><p>We use cookies.</p></div><form><label>Name</label><input></form>") == ""
    for tag in ("p", "h2", "span", "b"):
        for name in ("cookie-notice", "ad", "advert"):
            assert text(f"<article><p>Before.</p><{tag} class='{name}'>Buy <i>this</i> now</{tag}><p>Text <span class=advert>buy <span>it</span> now</span>goes on.</p></article>") == "Before.\nText goes on.", (tag, name)
    assert text("<article><p>One <span class=ad>never closed</p><p>Two <span class=big>three</span></p></article>") == "One\nTwo three"


def test_two_templates_of_one_host(spark):
    words = "Words of the text go on. " * 10
    one, two = f"<div class=news><p>News. {words}</p></div><div class=box><p>Beside.</p></div>", f"<div class=box><p>Side.</p></div><section class=review><p>Review. {words}</p></section>"
    rows = [(k, "http://a.net/", f"<html><body>{one if k % 5 else two}</body></html>") for k in range(20)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(t.split(".")[0] == ("News" if k % 5 else "Review") and t.count("\n") == 0 for k, t in found.items())


def test_references_and_silent_elements():
    text = lambda body: html_extract.Page(f"<body><article>{body}</article></body>").text("/none")
    assert text("<p>A &<b>amp;</b> &lt;b&gt; &am<!-- x -->p; C</p>") == "A &amp; <b> &am p; C".replace("am p", "amp")
    assert text("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> end</p>") == "Energy E=m end"
    assert text("<p>a</p><svg><title>t</title><text>no</text></svg><noscript><iframe></iframe>no</noscript><p>b") == "a\nb"
    assert text("<p>a <button>press<p>b</p>") == "a press\nb" and text("<p>a</p><script>never closed <p>x") == "a"


def test_deep_and_long_pages():
    deep = "<div class=a1>" * 20_000 + "<p>" + "bottom " * 20 + "</p>" + "</section></div>" * 20_000 + "<p>after</p>"
    tracemalloc.start()
    began = time.process_time()
    page = html_extract.Page(f"<body>{deep}")
    assert page.text(page.vote()[0]) == ("bottom " * 20).strip() and page.text("/body").endswith("bottom\nafter")
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    row = "<p>" + "word &amp; more " * 60 + "</p><button>"
    long = html_extract.Page("<body><article>" + row * 10_000 + "</article>").text("/none")
    assert len(long.split("\n")) == 10_000 and long.startswith("word & more word")
    assert time.process_time() - began < 30


@pytest.mark.parametrize("piece", ["<a ", "</", "<!", "< ", "<a \"", "<p '", "<!-- ", "<svg>", "<button>", "<script>", "&amp", "<div class='", "</div>", "<li>"])
def test_broken_pages_take_no_longer(piece):
    began = time.process_time()
    text = html_extract.Page(f"<body><article><p>Text</p>{piece * 200_000}").text("/none")
    html_extract.Page(f"<body><article><p>Text</p>{piece * 200_000}>").text("/none")
    assert text.startswith("Text") and time.process_time() - began < 20
    assert html_extract.Page("<article><p>one<!-- <p>two</p> three").text("/none") == "one" == html_extract.Page("<article><p>one<!-- two").text("/none")
    assert html_extract.Page("<article><p>one<!--> two --><p>three").text("/none") == "one two -->\nthree".replace(" two -->", "")


class PlainReader(HTMLParser):
    """Main text of simple well-formed pages, by the standard library's parser: all within article but for what stands apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.run = [], [], []

    def _flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "i", "a", "br"):
            self._flush()
            self.stack.append((tag, tag in ("nav", "footer", "aside", "script", "style", "form") or dict(attrs).get("class") in ("ad", "comments", "notice")))
        elif tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a"):
            self._flush()
            self.stack.pop()

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(a for _, a in self.stack):
            self.run.append(data)


def test_random_pages_as_another_parser_reads_them():
    chance = random.Random(12)
    words = ["one", "two &amp; three", "&eacute;", "x &lt; y", "<b>bold</b>", "<i>it<br>alic</i>", "<a href='/q?a=1&amp;b'>link</a>", "\n  ", "&#8364;", "日本"]
    inline = lambda: " ".join(chance.choice(words) for _ in range(chance.randint(1, 30)))

    def block(depth):
        kind = chance.choice(["p", "p", "p", "h2", "pre", "apart", "box", "list"])
        if kind == "apart":
            return chance.choice(["<div class='ad'>{}</div>", "<div class=comments><p>{}</p></div>", "<aside><p>{}</p></aside>", "<script>{}</script>", "<form><p>{}</p></form>"]).format("skipped text")
        if kind == "box" and depth < 5:
            return f"<{(t := chance.choice(['div', 'section', 'blockquote']))} class=c{depth}>" + "".join(block(depth + 1) for _ in range(chance.randint(1, 4))) + f"</{t}>"
        if kind == "list":
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(3)) + "</ul>"
        return f"<{kind}>{inline()}</{kind}>" if kind in PROSE else f"<p>{inline()}</p>"

    for _ in range(150):
        html = f"<html><body><nav><p>menu</p></nav><div class=notice>cookies</div><div class=page><article><h1>{inline()}</h1><p>Some text.</p>{''.join(block(0) for _ in range(chance.randint(0, 12)))}</article></div><footer>end</footer></body></html>"
        plain = PlainReader()
        plain.feed(html)
        plain.close()
        assert html_extract.Page(html).text("/none") == "\n".join(plain.blocks), html


def test_hosts_agree_on_a_path(spark):
    page = lambda n, box: PAGE.format(body=f"<div class=story><p>{'story ' * n}</p></div><div class=x9><p>{'box ' * box}</p></div>")
    rows = [(k, "http://a.net/x", page(60, 5)) for k in range(6)] + [(6, "http://a.net/y", page(5, 40)), (7, None, page(30, 1)), (8, "http://b.net/", None), (9, "http://b.net/", ""), (9, "http://b.net/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z"))
    for sent in (html_extract.MAX_SENT, 0):
        got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df, max_sent=sent).collect())
        assert got[6] == (6, "story " * 4 + "story", 29)  # its own vote would take the box
        assert all(t == ("story " * 60).strip() for _, t, _ in got[:6]) and [x[1:] for x in got[8:]] == [("", 0)] * 3
    assert html_extract.extract(df.limit(0)).count() == 0


def test_archives(spark):
    big, other = "<p>" + "same " * 40, "<p>" + "other " * 40
    rows = [(5, "http://b.org/x", big), (3, "http://a.org/\tq", big), (9, None, big), (4, "http://b.org/x", other), (1, "no scheme\n", "tiny"), (2, "http://a.org/", "tiny"), (6, "http://ü.org/%41", None), (7, "http://b.org/x", ""), (3, "http://a.org/\tq", big), (None, "http://n.org/", other), (-8, "http://c.org", "x" * 100), (11, "http://c.org", "x" * 99), (12, "http://c.org", "x" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.write_and_read(pages).collect()), key=str)
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None] if len(data) >= 100 else []
        first = min(same, default=None)
        again = first is not None and page_id != first
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.write_and_read(pages.limit(0)).count() == 0


def test_long_values(spark):
    long = "wörd " * 400_000
    pages = spark.createDataFrame([(1, "http://a.org/" + "p" * 100_000, long), (2, "http://a.org/" + "p" * 100_000, long), (3, "http://" + "a." * 20_000 + "org/x", "<p>" + long)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.write_and_read(pages).collect()}
    assert [got[k].refers_to for k in (1, 2, 3)] == [None, 1, None] and got[1].payload_bytes == len(long.encode()) == got[2].payload_bytes
    rules = spark.createDataFrame([("org", "/", "block"), ("a.org", "/" + "p" * 50_000, "allow")], url_rules.RULES)
    for sent in (url_rules.MAX_SENT, 1):
        judged = {r.page_id: (r.verdict, len(r.rule)) for r in url_rules.judge(pages, rules, max_sent=sent).collect()}
        assert judged == {1: ("allow", 50_006), 2: ("allow", 50_006), 3: ("block", 4)}
    assert {r.page_id: r.n_chars for r in html_extract.extract(pages.where("page_id = 3")).collect()} == {3: len(long) - 1}
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long + "</s>")], "conv_id long, turn long, role string, text string")
    row = chat.format_and_read(talk, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).first()
    assert row.loss_chars == len(long) + 4 and row.loss_sha256 == hashlib.sha256(f"{long}</s>".encode()).hexdigest()


def test_index_finds_single_captures_over_many_blocks(spark, monkeypatch):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".org/p"), F.col("id") % 50).alias("url"), F.concat(F.lit("payload "), F.col("id")).alias("html"))
    archive = warc.write(pages)
    assert archive.directory.agg(F.sum("captures")).first()[0] == 3000
    asked = pages.where("page_id % 271 = 0").select(warc.capture_key(F.col("url")).alias("key"), "page_id")
    more = spark.createDataFrame([("org.nowhere.)/", 1), ("", 2)], "key string, page_id long")
    records = warc.read_records(archive, warc.lookup(archive, asked.unionByName(more)), with_payload=True).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in records) == [(k, f"payload {k}") for k in range(0, 3000, 271)]


def test_pipeline_keeps_clean_documents(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = corpus_pipeline.materialize(stage(spark, docs, folder), "test")
        assert following.columns == docs.columns, name
        docs = following
    assert 0.6 * n < docs.count() < n
    last = corpus_pipeline.run(spark, folder)
    assert last.count() == docs.count() and last.select("doc_id").distinct().count() == docs.count()


def test_query_names():
    assert [k.split("_")[0] for k in llm_queries.queries()] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]
