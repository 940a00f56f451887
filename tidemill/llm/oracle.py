"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


OP4 = """
with parts as (
  select page_id,
         case when url is not null and position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
  from pages
),
split as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
),
rules(rule_host, rule_path, rule_verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
),
ranked as (
  select s.page_id, s.host, s.path, r.rule_host || r.rule_path as rule, r.rule_verdict,
         row_number() over (partition by s.page_id order by length(r.rule_host || r.rule_path) desc) as k
  from split s left join rules r
    on (s.host = r.rule_host or suffix(s.host, '.' || r.rule_host)) and starts_with(s.path, r.rule_path)
)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from ranked where k = 1
"""


OP1 = """
with payloads as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
),
firsts as (
  select payload_digest, min(page_id) as first_id from payloads where payload_bytes >= 100 group by payload_digest
)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when f.first_id <> p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id <> p.page_id then f.first_id end as refers_to
from payloads p left join firsts f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""


OP5 = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) as v(conv_id, turn, role, text)
),
sized as (
  select *, length(role) + length(text) + 20
    + len(regexp_extract_all(role, '<\\*s>|\[\\*INST\]|\[\\*/INST\]|<\\*/s>'))
    + len(regexp_extract_all(text, '<\\*s>|\[\\*INST\]|\[\\*/INST\]|<\\*/s>')) as written
  from said
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(written)::bigint as formatted_chars
from sized group by conv_id
"""

OP7 = r"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
),
windows as (
  select distinct item_id, n, list_slice(w, i, i + n - 1) as win
  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)
),
places as (
  select doc_id, i, n, list_slice(w, i, i + n - 1) as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from windows) where len(w) >= n)
),
hits as (select p.doc_id, p.i, p.n, x.item_id from places p join windows x on p.n = x.n and p.win = x.win),
words as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as at from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from docs d left join words on d.doc_id = words.doc_id left join found on d.doc_id = found.doc_id
"""


_PLACES = """
  select r, t, '{kind}' as kind, {k} as k, starts[i] as s, starts[i] + length(m[i]) as e, {size} as size
  from (select r, t, m, x, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda y: length(y)))::bigint + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)::bigint) as starts
        from (select r, t, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as x, string_split_regex(t, '{pattern}') as g from docs)),
       lateral (select unnest(range(1, len(m) + 1)) as i)
"""
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_BODY = """
  select r, kind, k, s, s + {prefix} + 36 as e, substr(t, s + {prefix} + 1, 36) as body, substr(t, s + {prefix} + 37, 1) as after from ({places})
"""


def _op12() -> str:
    """Patterns by their matches and the gaps between; the checksum bit by bit."""
    base = [("assign", 0, _ASSIGN, 2), ("access", 1, "AKIA[A-Z0-9]+", 0), ("hex", 2, "[0-9a-f]{24,}", 0)]
    listed = lambda kind, k, pattern, group: _PLACES.format(kind=kind, k=k, pattern=pattern, group=group, size="length(x[i])")
    tokens = [("github", 3, "gh[oprsu]_", 4), ("npm", 4, "npm_", 4)]
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
base as (
  select r, kind, k, s, e from ({" union all ".join(listed(*x) for x in base)})
  where size >= case kind when 'assign' then 6 when 'access' then 20 else 24 end
),
bodies as ({" union all ".join(_BODY.format(prefix=n, places=listed(kind, k, pattern, 0)) for kind, k, pattern, n in tokens)}),
summed as (
  select r, kind, k, s, e,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, 31), lambda j: ascii(substr(body, j, 1))::bigint)),
             lambda c, y: list_reduce(list_concat([xor(c, y)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) as crc,
         list_reduce(list_concat([0::bigint], list_transform(range(31, 37), lambda j: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', substr(body, j, 1))::bigint - 1)), lambda c, y: 62 * c + y) as told
  from bodies where regexp_full_match(body, '[0-9A-Za-z]{{36}}') and not regexp_full_match(after, '[0-9A-Za-z]')
),
spans as (select * from base union all select r, kind, k, s, e from summed where crc = told),
found as (
  select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans
  from spans group by r
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join found using (r)
"""


_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"
_APART = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))::bigint"
_DOWN = "(({0} - (({0} % {1}) + {1}) % {1}) // {1})"


def _op11() -> str:
    """All distances, four rounds."""
    rounds = ""
    for k in range(4):
        rounds += f"""
near{k} as materialized (
  select a.vec_id, a.p, min(d * 256 + e) % 256 as e from (select a.vec_id, a.p, b.e, {_APART} as d from parts a join book{k} b on a.p = b.p) a group by all
),
mean{k} as (
  select p, e, list({_DOWN.format("total", "n")} order by i) as v
  from (select a.p, b.e, i, sum(a.v[i])::bigint as total, count(*) as n
        from parts a join near{k} b on a.vec_id = b.vec_id and a.p = b.p, lateral (select unnest(range(1, len(a.v) + 1)) as i) group by all)
  group by p, e
),
book{k + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from book{k} b left join mean{k} m on b.p = m.p and b.e = m.e),"""
    return f"""
with fine as (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as w from embeddings where {_FINITE}
),
parts as materialized (
  select vec_id, p, list_slice(w, p * len(w) // 4 + 1, (p + 1) * len(w) // 4) as v from fine, (select unnest(range(4)) as p)
),
first as (select vec_id, row_number() over (order by vec_id) - 1 as e from (select vec_id from fine order by vec_id limit 256)),
book0 as materialized (select p, e, v from parts join first using (vec_id)),{rounds}
last as (
  select vec_id, p, min(d * 256 + e) as x from (select a.vec_id, a.p, b.e, {_APART} as d from parts a join book4 b on a.p = b.p) group by all
),
coded as (select vec_id, string_agg(printf('%02x', x % 256), '' order by p) as code, sum(x // 256)::bigint as error from last group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from book4) as codebooks_sha256
from coded join fine using (vec_id)
"""


def _op13() -> str:
    """All distances, three rounds."""
    rounds = ""
    for k in range(4):
        rounds += f"""
near{k} as materialized (
  select vec_id, v, min(d * 16 + c) as x from (select a.vec_id, a.v, b.c, {_APART} as d from fine a, book{k} b) group by all
),
book{k + 1} as materialized (
  select b.c, coalesce(m.v, b.v) as v
  from book{k} b left join (
    select c, list({_DOWN.format("total", "n")} order by i) as v
    from (select x % 16 as c, i, sum(v[i])::bigint as total, count(*) as n from near{k}, (select unnest(range(1, 65)) as i) group by all)
    group by c
  ) m on b.c = m.c
),"""
    return f"""
with fine as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and {_FINITE}
),
book0 as materialized (
  select row_number() over (order by h) - 1 as c, v from (select sha256('1:' || vec_id) as h, v from fine order by h limit 16)
),{rounds}
named as (select vec_id, (x % 16)::int as cluster, x // 16 as distance from near3)
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
       sha256(array_to_string(v, ',')) as centroid_sha256
from named join book3 on cluster = c
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1, "op4_url_rules": OP4, "op5_chat_format": OP5, "op7_decontaminate": OP7, "op11_vector_codes": _op11(), "op12_secret_scan": _op12(), "op13_centroid_search": _op13()}
