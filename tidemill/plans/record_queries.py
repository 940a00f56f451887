"""Estimators with their whitening, filters, records, images, state and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import images
from tidemill.functions import text as X
from tidemill.operators import advantage, balance, batch, curation, diagnosis, losses, metrics, quota, records, strategies
from tidemill.plans.batch_queries import _PAIRS, _TOKENS, pairs, positive, token_ids, vectors
from tidemill.plans.registry import Registry
from tidemill.sources import readers

query = Registry()

_WHITE = "mo as (select sum(x * m) / (sum(m) + 1e-8) as mean, sum(m) as n from est), va as (select mean, (select sum((x - mean) * (x - mean) * m) from est, mo) / (n + 1e-8) * n / (n - 1) as var from mo), adv as (select *, (x - mean) / sqrt(var + 1e-8) * m as advantage from est, va) select vec_id, sum(advantage) as advantage, sum(advantage * i) as placed, sum(ret) as returns from adv group by vec_id"


def _by_place(rows):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", total(F.col("advantages")).alias("advantage"), total(F.transform("advantages", lambda x, i: x * (i + 1))).alias("placed"), total(F.col("returns")).alias("returns"))


_C = 0.99 * 0.95


@query("q82_gae_returns", f"with {_TOKENS}, r as (select x.vec_id, x.i, x.v, b.v as value, x.v + 0.99 * coalesce(n.v, 0) - b.v as d from tokens x join tokens b on x.vec_id = b.vec_id and b.i = 65 - x.i left join tokens n on x.vec_id = n.vec_id and n.i = 64 - x.i), e as (select a.vec_id, a.i, sum(b.d * pow({_C!r}, b.i - a.i)) as x from r a join r b on a.vec_id = b.vec_id and b.i >= a.i group by 1, 2), est as (select e.vec_id, e.i, e.x, (r.v > 0)::int::double as m, e.x + r.value as ret from e join r on e.vec_id = r.vec_id and e.i = r.i), {_WHITE}")
def _(t):
    rows = vectors(t).withColumn("w", F.reverse("v")).withColumn("m", positive("v"))
    return _by_place(advantage.gae(rows, "v", "w", "m", 0.99, 0.95))


@query("q83_reinforce_pp_whitened", f"with {_TOKENS}, k as (select *, (i <= 1 + vec_id % 64)::int::double as m from tokens), est as (select a.vec_id, a.i, a.m, sum(b.v * pow(0.9::double, b.i - a.i)) as x, sum(b.v * pow(0.9::double, b.i - a.i)) as ret from k a join k b on a.vec_id = b.vec_id and (b.i = a.i or (b.i > a.i and b.m > 0)) group by 1, 2, 3), {_WHITE}")
def _(t):
    mask = F.transform("v", lambda _, i: F.when(i <= F.col("vec_id") % 64, 1.0).otherwise(0.0))
    return _by_place(advantage.reinforce_plus_plus(vectors(t).withColumn("m", mask), "v", "m", 0.9))


@query("q84_short_prompts", "select doc_id from documents where text is null or len(string_split(text, ' ')) <= 60")
def _(t):
    """The pieces between blanks stand for ids."""
    return curation.short_enough(t.documents.select("doc_id", F.split("text", " ").alias("ids")), "ids", 60).select("doc_id")


@query("q85_rows_without_errors", "select event_id, event_type from events where not (event_type = 'error' and event_id % 3 <> 0)")
def _(t):
    failed = F.when(F.col("event_id") % 3 != 0, F.col("event_type") == "error")
    return curation.without_errors(t.events.withColumn("generation_error", failed)).select("event_id", "event_type")


_TYPES = [r[0] for r in strategies.STRATEGIES] + ["unheard of", None]
_TYPE_SQL = "[" + ", ".join("null" if x is None else f"'{x}'" for x in _TYPES) + "]"
_STRATEGIES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e}::double, {f}::double)" for a, b, c, d, e, f in strategies.STRATEGIES)


@query("q86_edit_instructions", f"with s(image_type, priority, edit_allowed, edit_scope, quality_threshold, can_use_threshold) as (values {_STRATEGIES}), p as (select p_partkey, p_name, p_size, ({_TYPE_SQL})[(p_partkey % {len(_TYPES)}) + 1] as image_type from part) select p_partkey, p.image_type, priority, edit_allowed, edit_scope, quality_threshold, can_use_threshold, priority in ('use_search_heavily', 'use_search_preferred') as prefer_search, 'Edit within this scope: ' || edit_scope || '. Changes allowed: ' || edit_allowed || '.' || chr(10) || 'What to do: ' || p_name as edit_instruction, p_size / 5.0::double >= can_use_threshold as can_use from p join s on s.image_type = case when p.image_type in (select image_type from s) then p.image_type else 'mixed' end")
def _(t):
    kind = F.get(F.array(*(F.lit(x).cast("string") for x in _TYPES)), (F.col("p_partkey") % len(_TYPES)).cast("int"))
    plans = t.part.select("p_partkey", kind.alias("image_type"), F.col("p_name").alias("instruction"), (F.col("p_size") / 5.0).alias("score"))
    joined = strategies.with_strategy(plans, strategies.table(t.spark))
    return strategies.usable_as_is(joined).drop("instruction", "score")


@query("q87_weight_lookup", "select n_nationkey as category, count(*)::bigint as total, coalesce(case when n_nationkey % 2 = 0 then n_nationkey / 10.0::double end, 1.0)::double as weight from supplier join nation on s_nationkey = n_nationkey group by 1")
def _(t):
    stats = t.supplier.groupBy(F.col("s_nationkey").alias("category")).agg(F.count("*").alias("total"))
    table = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("category"), (F.col("n_nationkey") / 10.0).alias("weight"))
    return diagnosis.with_weights(stats, table)


@query("q88_valid_answers", "select p_partkey from part where p_partkey % 4 = 3 and p_partkey % 5 <> 0")
def _(t):
    k = F.col("p_partkey") % 4
    answer = F.when(k == 0, "").when(k == 1, "None").when(k == 3, F.col("p_name"))
    rows = t.part.select("p_partkey", answer.alias("answer"), F.when(F.col("p_partkey") % 5 != 0, "").alias("image"))
    return curation.valid_answers(rows).select("p_partkey")


@query("q89_tag_or_all", "select page_id, md5(regexp_replace(case when regexp_matches(html, '(?s)<h1>(.*?)</h1>') then regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) else html end, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) as heading, md5(regexp_replace(html, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) as whole from pages")
def _(t):
    return t.pages.select("page_id", F.md5(X.tag_or_all(F.col("html"), "h1")).alias("heading"), F.md5(X.tag_or_all(F.col("html"), "no-such-tag")).alias("whole"))


@query("q90_nested_columns", 'select o_orderkey as "order/key", o_orderstatus as "order/state/now", o_totalprice as price from orders')
def _(t):
    flat = t.orders.select(F.col("o_orderkey").alias("order/key"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("order/state/now"))
    return batch.flatten_columns(batch.unflatten_columns(flat))


@query("q91_restored_state", "with o as (select source, count(*) as n from documents group by 1), q as (select source, count(*) * 2 as quota from documents where lang is not null group by 1) select coalesce(q.source, o.source) as category, quota::bigint as quota, coalesce(n, 0)::bigint as \"count\" from q full outer join o on q.source = o.source")
def _(t):
    """Counts of all documents, under quotas of twice those with a language instead of three times all."""
    count = lambda df: df.groupBy(F.col("source").alias("category")).agg(F.count("*").alias("count"))
    times = lambda df, n: df.select("category", (F.col("count") * n).alias("quota"))
    every, known = count(t.documents), count(t.documents.where("lang is not null"))
    return quota.restore(quota.snapshot(times(every, 3), every), times(known, 2))[0]


@query("q92_group_ids", "select conv_id, turn, sha256('{\"conv_id\":' || conv_id || ',\"turn\":' || turn || '}') as uid from conversations")
def _(t):
    return batch.group_ids(t.conversations.select("conv_id", "turn"), "conv_id", "turn")


@query("q93_base64", "select p_partkey, p_name as name, length(p_name) > 0 as sniffed from part")
def _(t):
    head = F.when(F.col("p_partkey") % 2 == 0, "data:text/plain;base64,").otherwise("")
    made = t.part.select("p_partkey", F.concat(head, F.base64(F.col("p_name").cast("binary"))).alias("b"))
    return made.select("p_partkey", X.from_base64(F.col("b")).cast("string").alias("name"), X.looks_base64(X.without_data_uri(F.col("b"))).alias("sniffed"))


@query("q94_three_decimals", "select event_id, printf('%.3f', event_id / 8.0::double + 0.0001) as shown from events")
def _(t):
    return t.events.select("event_id", X.three_decimals(F.col("event_id") / 8.0 + 0.0001).alias("shown"))


@query("q95_run_pace", "with s as (select count(*)::bigint as n, count(*) filter (event_type <> 'error')::bigint as succeeded, count(*) filter (event_type = 'error')::bigint as failed from events) select *, succeeded * 100.0::double / n as percent, 3600.0::double / succeeded as seconds_each, 3600.0::double / succeeded * failed as seconds_left from s")
def _(t):
    log = t.events.select(F.struct((F.col("event_type") != "error").alias("success")).alias("_meta"))
    return metrics.pace(metrics.run_statistics(log), 3600.0)


@query("q96_first_valid_attempt", "select l_orderkey as sample_id, min(l_linenumber)::int - 1 as attempt, min(l_linenumber)::int as tries from lineitem where l_linenumber <= 3 and l_quantity > 25 group by 1")
def _(t):
    tried = t.lineitem.select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber").cast("int") - 1).alias("attempt"), (F.col("l_quantity") > 25).alias("valid"))
    return records.attempts(tried, "valid").select("sample_id", "attempt", "tries")


@query("q97_length_balance", "with l as (select doc_id % 8 as p, sum(n_chars) as load from documents group by 1) select min(load)::bigint as min, max(load)::bigint as max, avg(load)::double as mean from l")
def _(t):
    return metrics.balance(t.documents.withColumn("p", F.col("doc_id") % 8), "p", "n_chars")


@query("q98_token_entropy", f"with {_PAIRS} select -sum(p * m) / (sum(m) + 1e-8) as entropy from pairs")
def _(t):
    return losses.entropy(pairs(t), "p", "m")


@query("q99_complete_rows", "select p_partkey from part where p_partkey % 6 <> 0 and p_partkey % 7 <> 0")
def _(t):
    name = F.when(F.col("p_partkey") % 6 == 0, None).when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_name"))
    return curation.complete_rows(t.part.select("p_partkey", name.alias("name"), "p_type"), "name", "p_type").select("p_partkey")


@query("q100_needs_score", "with s as (select l_orderkey, l_linenumber, case when l_linenumber <> 1 then l_discount * 10 end as s from lineitem) select l_orderkey, l_linenumber, coalesce(s, 1.0)::double as score, s is null or s = 1.0 as needed from s")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 1, F.col("l_discount") * 10).cast("double").alias("score"))
    return curation.with_score(rows.withColumn("needed", curation.needs_score(F.col("score"))))


@query("q101_gradable", "select conv_id, turn, not (contains(text, '证明') or contains(lower(text), 'box') or contains(lower(role), 'text')) as gradable from conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", X.gradable(F.col("text"), F.col("role")).alias("gradable"))


@query("q102_denials", "select p_partkey, p_partkey % 2 = 0 and p_partkey % 3 = 0 as both from part")
def _(t):
    side = lambda k: F.concat(F.when(F.col("p_partkey") % k == 0, "There is NO ").otherwise("A "), F.lit("gear"))
    return t.part.select("p_partkey", X.both_negative(side(2), side(3)).alias("both"))


@query("q103_code_fence", "select event_id, props as inside from events")
def _(t):
    fenced = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```"), F.col("props"), F.lit("```"))).otherwise(F.col("props"))
    return t.events.select("event_id", X.without_fence(fenced).alias("inside"))


@query("q104_seeded_sample", "select p_partkey from part order by md5('42|' || p_partkey::varchar), p_partkey limit 200")
def _(t):
    return readers.seeded_sample(t.part, "p_partkey", 200).select("p_partkey")


@query("q105_first_filled_fields", "select p_partkey::varchar as id, case p_partkey % 3 when 0 then p_name when 1 then p_type else '' end as question, p_brand as answer, 'none' as image from part")
def _(t):
    k = F.col("p_partkey") % 3
    rows = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.when(k == 0, F.col("p_name")).alias("problem"), F.when(k == 1, F.col("p_type")).otherwise("").alias("query"), "p_brand")
    found = records.coalesced(rows, {"id": ["id"], "question": ["problem", "query"], "answer": ["p_brand"]})
    return found.join(records.coalesced(rows, {"id": ["id"], "image": ["no_such_column"]}, "none"), "id")


@query("q106_train_rows", "select p_name as problem, p_brand as answer, p_size::double as score, null::varchar as images, 'numerical' as problem_type, p_type as image_type from part")
def _(t):
    rows = t.part.select(F.col("p_name").alias("question"), F.col("p_brand").alias("answer"), F.col("p_size").alias("score"), F.lit(None).cast("string").alias("image"), F.lit("numerical").alias("question_type"), F.col("p_type").alias("image_type"))
    return curation.train_rows(rows)


@query("q107_encoded_fields", "select p_partkey, base64(encode(p_name)) as own, base64(encode(p_type)) as nested, base64(encode(p_brand)) as listed from part")
def _(t):
    raw = lambda c: F.col(c).cast("binary")
    rows = t.part.select("p_partkey", raw("p_name").alias("own"), F.struct(raw("p_type").alias("x")).alias("s"), F.array(F.struct(raw("p_brand").alias("y"))).alias("a"))
    return records.encoded(rows).select("p_partkey", "own", F.col("s.x").alias("nested"), F.get("a", F.lit(0))["y"].alias("listed"))


@query("q108_mean_metrics", "select l_returnflag as name, avg(l_quantity)::double as value from lineitem group by 1")
def _(t):
    return metrics.mean_metrics(t.lineitem.select(F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("double").alias("value")))


@query("q109_usable_images", "select p_partkey from part where p_size >= 10 and p_partkey % 40 >= 10")
def _(t):
    return t.part.where(images.usable(F.col("p_size"), F.col("p_partkey") % 40)).select("p_partkey")


@query("q110_files_that_are_there", "select p_partkey, p_name as image from part where p_name in (select p_name from part where p_size > 40)")
def _(t):
    rows = t.part.select("p_partkey", F.col("p_name").alias("image"))
    return curation.with_files(rows, "image", t.part.where("p_size > 40").select(F.col("p_name").alias("path"))).select("p_partkey", "image")


@query("q111_warmup", "select o_orderkey, least(1.0, o_orderkey / 500.0)::double as factor from orders")
def _(t):
    return t.orders.select("o_orderkey", losses.warmup_factor(F.col("o_orderkey"), 500).alias("factor"))


@query("q112_model_family", "select p_partkey, contains(lower(p_brand), 'brand') as is_family from part")
def _(t):
    return t.part.select("p_partkey", X.is_of_family(F.col("p_brand"), "brand").alias("is_family"))


@query("q113_columns_taken_out", "select o_orderkey, o_custkey as customer, o_totalprice as price from orders")
def _(t):
    taken, rest = batch.select_and_rest(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_orderkey")
    return batch.column_union(batch.rename(taken, ["o_custkey"], ["customer"]), batch.rename(rest, ["o_totalprice"], ["price"]), "o_orderkey")


@query("q114_greedy_balance")
def _(t):
    rows = t.documents.select(F.floor(F.col("doc_id") / 512).alias("batch"), "doc_id", "n_chars")
    return balance.balanced(rows, "batch", "doc_id", "n_chars", 8, equal_size=False, method=balance.greedy)


@query("q115_scientific", "select event_id, event_id % 2 = 0 as scientific from events")
def _(t):
    shown = F.when(F.col("event_id") % 2 == 0, F.concat(F.col("event_id").cast("string"), F.lit(".5e-3"))).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return t.events.select("event_id", X.is_scientific(shown).alias("scientific"))


@query("q116_hand_kept_table", "select n_nationkey, case when n_nationkey = 3 then 'changed' else n_name end as n_name from nation where n_nationkey <> 5")
def _(t):
    rows = t.nation.select("n_nationkey", "n_name")
    return records.updated(records.removed(rows, {"n_nationkey": 5}), {"n_nationkey": 3}, {"n_name": "changed"})
