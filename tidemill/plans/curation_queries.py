"""Diagnosis, quotas, text functions and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import curation, diagnosis, quota
from tidemill.plans.registry import Registry, Tables

query = Registry()

KNOWN = [f"src{k}" for k in range(15)]
EVENT_QUOTAS = [("click", 100), ("view", 250), ("purchase", 40), (quota.FLEXIBLE, 300)]

_JUDGED = """judged as (
  select d.doc_id, d.source as category, d.lang as kind, l.quality = 1 as ok, d.text
  from labels l join documents d on l.doc_id = d.doc_id
)"""
_STATS = _JUDGED + """, stats as (
  select category, count(*)::bigint as total, sum(ok::int)::bigint as correct, sum(ok::int)::double / count(*) as accuracy
  from judged group by category
), weighted as (
  select *, case when accuracy < 0.70 then 2.0 when accuracy < 0.75 then 1.5 when accuracy < 0.85 then 1.0 when accuracy < 0.90 then 0.8 else 0.5 end::double as raw_weight
  from stats
), shares as (
  select *, raw_weight / sum(raw_weight) over () as weight from weighted
)"""
_QUOTAS = _STATS + """, quotas as (
  select category, weight, floor(1000 * weight / (select sum(weight) from shares))::bigint as quota from shares
), counts as (
  select source as category, count(*)::bigint as n from documents group by source
)"""


def judged(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select("doc_id", F.col("source").alias("category"), F.col("lang").alias("kind"), (F.col("quality") == 1).alias("is_correct"), "text")


def weighted(t: Tables) -> DataFrame:
    return diagnosis.weights(diagnosis.accuracy(judged(t)))


def source_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("category")).agg(F.count("*").alias("count"))


@query("q01_diagnose_accuracy", f"with {_JUDGED}, named as (select case when category in ({', '.join(map(repr, KNOWN))}) then category else 'mixed' end as category, ok from judged) select category, count(*)::bigint as total, sum(ok::int)::bigint as correct, sum(ok::int)::double / count(*) as accuracy, 1 - sum(ok::int)::double / count(*) as error_rate from named group by category")
def _(t):
    return diagnosis.accuracy(judged(t).withColumn("category", diagnosis.known_or_other(F.col("category"), KNOWN)))


@query("q02_diagnose_weights", f"with {_STATS} select category, total, correct, accuracy, 1 - accuracy as error_rate, raw_weight, weight from shares")
def _(t):
    return weighted(t)


@query("q03_type_breakdown", f"with {_JUDGED} select category, kind, count(*)::bigint as total, sum(ok::int)::bigint as correct, grouping(kind)::int as is_total, sum(ok::int)::double / count(*) as accuracy from judged group by grouping sets ((category), (category, kind))")
def _(t):
    return diagnosis.breakdown(judged(t), "category", "kind")


@query("q04_error_descriptions", f"with {_JUDGED} select category, kind, row_number() over (partition by category, kind order by substr(text, 1, 200))::bigint as place, md5(substr(text, 1, 200)) as digest from judged where not ok")
def _(t):
    rows = diagnosis.error_descriptions(judged(t), ["category", "kind"], "text")
    return rows.select("category", "kind", "place", F.md5("description").alias("digest"))


@query("q05_overall_summary", f"with {_JUDGED} select count(*)::bigint as total, sum(ok::int)::bigint as correct, sum(ok::int)::double / count(*) as accuracy from judged")
def _(t):
    return diagnosis.summary(judged(t))


def weaknesses_found(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("question_type"), F.get_json_object("props", "$.k").alias("description"), F.col("event_id").alias("example_id"), F.col("event_id").alias("seen"))


def weaknesses(t: Tables) -> DataFrame:
    return diagnosis.upsert_weaknesses(weaknesses_found(t))


_WEAK = "weak as (select event_type as question_type, json_extract_string(props, '$.k') as description, count(*)::bigint as \"count\", min(event_id) as first_seen from events group by 1, 2)"


@query("q06_weakness_upsert", "with f as (select event_type as question_type, json_extract_string(props, '$.k') as description, event_id from events), o as (select question_type, description, count(*) as n, min(event_id) as first from f where event_id % 5 = 0 group by 1, 2), n as (select question_type, description, count(*) as n, min(event_id) as first from f where event_id % 5 <> 0 group by 1, 2) select question_type, description, (coalesce(o.n, 0) + coalesce(n.n, 0))::bigint as \"count\", coalesce(o.first, n.first) as first_seen from o full outer join n using (question_type, description)")
def _(t):
    # the fifth part of what is found makes the table that the rest is put into
    found = weaknesses_found(t)
    return diagnosis.upsert_weaknesses(found.where("seen % 5 <> 0"), diagnosis.upsert_weaknesses(found.where("seen % 5 = 0")))


@query("q81_weakness_examples", "select event_type as question_type, json_extract_string(props, '$.k') as description, row_number() over (partition by 1, 2 order by event_id)::bigint as place, event_id as example_id from events".replace("partition by 1, 2", "partition by event_type, json_extract_string(props, '$.k')"))
def _(t):
    return diagnosis.weakness_examples(weaknesses_found(t))


@query("q07_top_weaknesses", f"with {_WEAK}, ranked as (select *, row_number() over (partition by question_type order by \"count\" desc, first_seen) as rank from weak where \"count\" >= 2) select question_type, description, \"count\", rank::int as rank from ranked where rank <= 5")
def _(t):
    return diagnosis.top_by_count(weaknesses(t), ["question_type"], 5, 2).select("question_type", "description", "count", "rank")


_PERCENT = "((correct * 2000 + total) // (total * 2))"


@query("q08_priority_report", f"with {_STATS}, banded as (select *, case when accuracy < 0.70 then 'HIGH' when accuracy < 0.85 then 'MEDIUM' else 'LOW' end as band from stats) select band, row_number() over (partition by band order by accuracy, category)::bigint as place, category, '- ' || category || ': ' || ({_PERCENT} // 10)::varchar || '.' || ({_PERCENT} % 10)::varchar || '% (' || correct::varchar || '/' || total::varchar || ')' as line from banded")
def _(t):
    return diagnosis.priority_lines(diagnosis.accuracy(judged(t)))


@query("q09_quota_allocation", f"with {_QUOTAS} select category, weight, quota from quotas where quota > 0 union all select '{quota.FLEXIBLE}', null, (1000 - sum(quota))::bigint from quotas")
def _(t):
    return quota.allocate(weighted(t), 1000)


@query("q10_quota_progress", f"with {_QUOTAS} select q.category, quota, coalesce(n, 0)::bigint as current, greatest(quota - coalesce(n, 0), 0)::bigint as remaining, coalesce(n, 0) * 100.0::double / quota as percentage from quotas q left join counts c on q.category = c.category where quota > 0")
def _(t):
    return quota.progress(quota.allocate(weighted(t), 1000), source_counts(t))


_LIMITS = ", ".join(f"('{k}', {n})" for k, n in EVENT_QUOTAS)


@query("q11_quota_admission", f"with limits(line, quota) as (values {_LIMITS}), lined as (select e.*, case when l.line is not null then event_type else '{quota.FLEXIBLE}' end as line from events e left join limits l on e.event_type = l.line), ranked as (select event_id, event_type, line, row_number() over (partition by line order by ts, event_id)::bigint as arrival_rank from lined) select event_id, event_type, arrival_rank, arrival_rank <= quota as admitted from ranked r join limits l on r.line = l.line")
def _(t):
    quotas = t.spark.createDataFrame(EVENT_QUOTAS, "event_type string, quota long")
    return quota.admit(t.events.select("event_id", "event_type", "ts"), quotas, ["ts", "event_id"], "event_type").select("event_id", "event_type", "arrival_rank", "admitted")


_GAPS = _QUOTAS + ", gaps as (select q.category, (quota - coalesce(n, 0))::bigint as gap from (select category, quota * 2 as quota from quotas where quota > 0) q left join counts c on q.category = c.category where quota > coalesce(n, 0))"


def gap_rows(t: Tables) -> DataFrame:
    doubled = quota.allocate(weighted(t), 1000).withColumn("quota", F.col("quota") * 2)
    return quota.gaps(doubled, source_counts(t))


@query("q12_quota_gaps", f"with {_GAPS} select category, gap from gaps")
def _(t):
    return gap_rows(t)


@query("q13_variant_plan", f"with {_GAPS}, joined as (select g.category, gap, doc_id as source_id, count(doc_id) over (partition by g.category) as n, row_number() over (partition by g.category order by doc_id) as r from gaps g left join (select source, doc_id from documents) d on g.category = d.source), shared as (select category, source_id, (case when n = 0 then gap else gap // greatest(n, 1) + (case when r <= gap % greatest(n, 1) then 1 else 0 end) end)::bigint as total_variants from joined) select category, source_id, unnest(range(total_variants))::bigint as variant_index, total_variants from shared where total_variants > 0")
def _(t):
    sources = t.documents.select(F.col("source").alias("category"), F.col("doc_id").alias("source_id"))
    return quota.variants(gap_rows(t), sources)


@query("q14_expected_vs_actual", f"with {_QUOTAS} select coalesce(s.category, c.category) as category, coalesce(floor(weight * 1000), 0)::bigint as expected, coalesce(n, 0)::bigint as actual, (coalesce(n, 0) - coalesce(floor(weight * 1000), 0))::bigint as diff from shares s full outer join counts c on s.category = c.category")
def _(t):
    return quota.expected_and_actual(weighted(t), source_counts(t), 1000)


KEYWORDS = {"gear": ["gear", "bolt"], "ring": ["ring", "small"], "widget": ["widget", "red", "blue"], "heat": ["hot"]}
_HITS = {name: " + ".join(f"contains(lower(p_name), '{w}')::int" for w in words) for name, words in KEYWORDS.items()}


@query("q15_keyword_classify", f"with hits as (select p_partkey, {', '.join(f'{h} as h{k}' for k, h in enumerate(_HITS.values()))} from part), top as (select *, greatest({', '.join(f'h{k}' for k in range(len(_HITS)))}) as m from hits) select p_partkey, case when m = 0 then 'mixed' {' '.join(f"when h{k} = m then '{n}'" for k, n in enumerate(_HITS))} end as class from top")
def _(t):
    return t.part.select("p_partkey", X.keyword_class(F.col("p_name"), KEYWORDS, "mixed").alias("class"))


@query("q16_question_kind", "select conv_id, turn, case when contains(text, chr(10) || 'A.') or contains(text, chr(10) || 'B.') then 'multiple choice' else 'numerical' end as kind from conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", X.question_kind(F.col("text")).alias("kind"))


@query("q17_tag_extract", "select page_id, case when regexp_matches(html, '(?s)<title>(.*?)</title>') then regexp_extract(html, '(?s)<title>(.*?)</title>', 1) end as title, case when regexp_matches(html, '(?s)<h1>(.*?)</h1>') then regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) end as heading from pages")
def _(t):
    return t.pages.select("page_id", X.tag_content(F.col("html"), "title").alias("title"), X.tag_content(F.col("html"), "h1").alias("heading"))


_REPLY = "'<think>' || text || '</think>' || case when doc_id % 3 = 0 then ' so: ' else ' ' || chr(10) end || chr(92) || 'boxed{' || n_chars::varchar || '}'"


@query("q18_format_check", f"select doc_id, regexp_matches({_REPLY}, '(?s)\\A<think>.*</think>[ \\t\\r\\n]*\\\\boxed\\{{.*\\}}[ \\t\\r\\n]*\\z')::int::double as form from documents")
def _(t):
    reply = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>"), F.when(F.col("doc_id") % 3 == 0, " so: ").otherwise(" \n"), F.lit("\\boxed{"), F.col("n_chars").cast("string"), F.lit("}"))
    return t.documents.select("doc_id", X.solver_format(reply).alias("form"))


@query("q19_boxed_extract", "select event_id, regexp_extract('so ' || chr(92) || 'boxed{ ' || event_type || ' } or ' || chr(92) || 'boxed{x}', '\\\\boxed\\{\\s*([^}]*?)\\s*\\}', 1) as answer from events")
def _(t):
    reply = F.concat(F.lit("so \\boxed{ "), F.col("event_type"), F.lit(" } or \\boxed{x}"))
    return t.events.select("event_id", X.boxed(reply).alias("answer"))


@query("q20_json_field", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as int), -1) as k, coalesce(try_cast(json_extract_string(props, '$.missing') as int), -1) as missing from events")
def _(t):
    props = F.col("props")
    return t.events.select("event_id", X.json_field(props, "$.k", "int", -1).alias("k"), X.json_field(props, "$.missing", "int", -1).alias("missing"))


@query("q21_json_repair", "select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def _(t):
    chatter = F.concat(F.lit("Sure: "), F.regexp_replace("props", r"\}", ", }"), F.lit(" done"))
    return t.events.select("event_id", X.json_field(X.json_in_chatter(chatter), "$.k", "int", None).alias("k"))


@query("q22_tag_squeeze", "select page_id, md5(regexp_replace(html, '[ \\t\\n\\r]*(<|>|/)[ \\t\\n\\r]*', '\\1', 'g')) as digest from pages")
def _(t):
    return t.pages.select("page_id", F.md5(X.squeeze_tags(F.col("html"))).alias("digest"))


@query("q23_choice_normalise", "select p_partkey, case when regexp_matches(p_name, '^[A-Da-d]\\.?') then upper(substr(p_name, 1, 1)) else nullif(upper(regexp_extract(p_name, '([A-Da-d])', 1)), '') end as letter, regexp_matches(p_name, '[A-D]\\.') as optioned from part")
def _(t):
    return t.part.select("p_partkey", X.choice_letter(F.col("p_name")).alias("letter"), X.has_choices(F.col("p_name")).alias("optioned"))


@query("q24_sample_id", "select doc_id, substr(md5(coalesce(text, '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '')), 1, 16) as sample_id from documents")
def _(t):
    return t.documents.select("doc_id", X.row_id(F.col("text"), F.col("lang"), F.col("source")).alias("sample_id"))


@query("q25_prompt_template", "select conv_id, turn, md5('Role: ' || role || chr(10) || regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') || ' Answer in a box.') as prompt from conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.md5(X.fill_template("Role: {role}\n{content} Answer in a box.", role=F.col("role"), content=F.col("text"))).alias("prompt"))


_RAW = "case turn % 3 when 0 then text when 1 then '<image 1>' || text else '<image 1>' || text || '<image 2>' end"


@query("q26_image_tag_norm", f"with r as (select conv_id, turn, {_RAW} as raw from conversations), p as (select *, regexp_replace(raw, '<image[ \\t\\r\\n]*[0-9]+>', '<image>', 'g') as plain from r), n as (select *, (length(plain) - length(replace(plain, '<image>', ''))) // 7 as n from p) select conv_id, turn, md5(case n when 0 then plain || '<image>' when 1 then replace(plain, '<image>', '') || '<image>' else raw end) as prompt from n")
def _(t):
    raw = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("<image 1>"), F.col("text"))).otherwise(F.concat(F.lit("<image 1>"), F.col("text"), F.lit("<image 2>")))
    return t.conversations.select("conv_id", "turn", F.md5(X.one_image_tag(raw)).alias("prompt"))


def scored(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("score"))


@query("q27_score_band", "select l_orderkey, l_linenumber, l_discount * 10 as score from lineitem where l_discount * 10 between 0.3 and 0.8")
def _(t):
    return scored(t).where(curation.in_band(F.col("score")))


_FILL = "with s as (select l_orderkey, l_linenumber, l_discount * 10 as score, md5('42|' || l_orderkey::varchar || '|' || l_linenumber::varchar) as h from lineitem), n as (select count(*) as passed from s where score between 0.3 and 0.8), r as (select *, row_number() over (order by h, l_orderkey, l_linenumber) as k from s where not score between 0.3 and 0.8) select l_orderkey, l_linenumber, score, false as filled from s where score between 0.3 and 0.8 union all select l_orderkey, l_linenumber, score, true from r where k <= greatest(0, 9000 - (select passed from n))"


@query("q28_auto_fill", _FILL)
def _(t):
    return curation.fill_up(scored(t), curation.in_band(F.col("score")), 9000, ["l_orderkey", "l_linenumber"])


@query("q29_score_stats", "select count(l_discount)::bigint as n, avg(l_discount * 10) as mean, max(l_discount * 10) as max, min(l_discount * 10) as min, count(*) filter (l_discount * 10 >= 0.8)::bigint as high, count(*) filter (l_discount * 10 >= 0.5 and l_discount * 10 < 0.8)::bigint as medium, count(*) filter (l_discount * 10 < 0.5)::bigint as low, (count(*) filter (l_discount * 10 >= 0.8))::double / count(*) as high_share from lineitem")
def _(t):
    return curation.score_summary(scored(t))


@query("q30_score_histogram", "with e as (select min(value) as lo, max(value) as hi from events), p as (select least(11, floor(coalesce((value - lo) / nullif((hi - lo) / 11, 0), 0)) + 1)::bigint as bin, lo, (hi - lo) / 11 as width from events, e where value is not null) select bin, lo + (bin - 1) * width as \"from\", count(*)::bigint as n from p group by 1, 2")
def _(t):
    return curation.histogram(t.events, "value")


@query("q31_score_quantiles", "select avg(value) as mean, quantile_cont(value, 0.5) as median, max(value) as max, min(value) as min from events")
def _(t):
    return curation.quantiles(t.events, "value")


@query("q32_type_distribution", "select p_type, count(*)::bigint as \"count\", round(count(*) * 100.0::double / sum(count(*)) over (), 2) as percent from part group by p_type")
def _(t):
    return curation.distribution(t.part, "p_type")


@query("q33_multi_source_union", "select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_name, s_acctbal, null from supplier")
def _(t):
    one = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    other = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return one.unionByName(other, allowMissingColumns=True)
