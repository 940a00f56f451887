from __future__ import annotations

import hashlib
import random
import re

import duckdb

from tidemill.llm import oracle, secrets

#: The base kinds as plain patterns over code points, with what must be how long.
PLAIN = [
    ("assign", r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE, 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]+", 0, 0, 24),
]


def brute(text: str | None) -> list[tuple[int, int, int]]:
    spans = []
    for k, (_, pattern, flags, group, least) in enumerate(PLAIN):
        # in ASCII only, so that no other letter counts as s or k
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    for k, pattern in ((3, r"gh[oprsu]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), (4, r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if secrets.checksum(m[1][:30].encode()).decode() == m[1][30:]]
    return sorted(spans)


def token(chance: random.Random, prefix: str, good: bool = True) -> str:
    body = bytes(chance.choice(secrets.DIGITS) for _ in range(30))
    end = secrets.checksum(body)
    return (prefix.encode() + body + (end if good else end[::-1])).decode()


def texts() -> list:
    chance = random.Random(5)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc123", "deadbeef0123", "F", "AKIA", "AKIAX0", "ABCDEFGH1234", "é", "𝄞", "-", "f" * 23, "\n", "x", "ſecret", "toKen"]
    made = ["".join(chance.choice([*parts, token(chance, "ghp_"), token(chance, "npm_"), token(chance, "gho_", False)]) for _ in range(chance.randrange(40))) for _ in range(1500)]
    return [None, "", "é" * 70_000 + " token=abcdef " + "0a" * 40_000, *made]


def test_checksum_of_a_known_token():
    assert secrets.checksum(b"zQWBuTSOoRi4A9spHcVY5ncnsDkxkJ") == b"0mLq17"


def test_report_is_brute_force_and_sql(spark):
    all_texts = texts()
    rows = [*enumerate(all_texts), (None, "token: abcdef"), (3, all_texts[3])]
    found = sorted(map(tuple, secrets.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    expected = []
    for i, t in rows:
        spans = brute(t)
        base = [s for s in spans if s[1] < 3]
        expected.append((i, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(secrets.listed(base).encode()).hexdigest(), secrets.listed(spans)))
    assert found == sorted(expected, key=str)
    assert sum("github:" in r[-1] for r in found) > 200 and sum("npm:" in r[-1] for r in found) > 200
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.sql(oracle.oracle_sql()["op12_secret_scan"]).fetchall(), key=str) == found


def test_secrets_and_redaction(spark):
    good = token(random.Random(1), "ghp_")
    rows = [(1, f"é {good}!", "a"), (2, 'PASSWORD = "hunter22" and more', "b"), (3, None, "c"), (4, "token=" + "0123456789ab" * 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted(map(tuple, secrets.secrets(docs).collect())) == [
        (1, "github", 2, 42, good), (2, "assign", 0, 20, 'PASSWORD = "hunter22'), (4, "assign", 0, 30, "token=" + "0123456789ab" * 2), (4, "hex", 6, 30, "0123456789ab" * 2),
    ]
    hidden = secrets.redact(docs)
    assert hidden.columns == docs.columns
    assert sorted(map(tuple, hidden.collect())) == [(1, "é [github]!", "a"), (2, '[assign]" and more', "b"), (3, None, "c"), (4, "[assign]", None)]
    assert secrets.report(docs.limit(0)).count() == secrets.secrets(docs.limit(0)).count() == secrets.redact(docs.limit(0)).count() == 0
