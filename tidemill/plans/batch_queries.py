"""Batch algebra, advantages, losses, metrics, votes and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import arrays as A
from tidemill.functions import images
from tidemill.functions import text as X
from tidemill.operators import advantage, balance, batch, diagnosis, grading, losses, metrics, quota, records, similarity
from tidemill.plans.curation_queries import weaknesses
from tidemill.plans.registry import Registry, Tables

query = Registry()


def joined_text(values) -> F.Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


@query("q34_column_union", "select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders")
def _(t):
    return batch.column_union(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


@query("q35_repeat_interleave", "select r_name, k::int as copy, (r_regionkey * 3 + k)::bigint as aabb, (k * (select count(*) from region) + r_regionkey)::bigint as abab from region, range(3) as c(k)")
def _(t):
    rows = t.region.select("r_name", F.col("r_regionkey").cast("long").alias("idx"))
    one = batch.repeat(rows, 3).select("r_name", "copy", F.col("position").cast("long").alias("aabb"))
    other = batch.repeat(rows, 3, interleave=False).select("r_name", "copy", F.col("position").cast("long").alias("abab"))
    return one.join(other, ["r_name", "copy"])


@query("q36_pad_to_divisor", "with s as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as idx from supplier), n as (select count(*) as n from s) select s_suppkey, idx::bigint as idx, false as is_pad from s union all select s_suppkey, (idx + n * k)::bigint, true from s, n, range(1, 8) as c(k) where idx + n * k < n + (8 - n % 8) % 8")
def _(t):
    return batch.pad_to_divisor(batch.with_index(t.supplier.select("s_suppkey"), ["s_suppkey"]), 8)


@query("q37_chunking", "select n_nationkey, (n_nationkey // 5)::bigint as equal, (n_nationkey // 7)::bigint as rounded, (case when n_nationkey < 7 then 0 else 1 + (n_nationkey - 7) // 6 end)::bigint as near from nation")
def _(t):
    n = t.nation.count()
    index = F.col("n_nationkey").cast("long")
    return t.nation.select("n_nationkey", batch.equal_chunk(index, n, 5).alias("equal"), batch.ceil_chunk(index, n, 4).alias("rounded"), batch.near_equal_chunk(index, n, 4).cast("long").alias("near"))


@query("q38_reorder_inverse", "select n_nationkey::bigint as old_idx, (row_number() over (order by md5(n_name)) - 1)::bigint as new_idx, n_name, n_nationkey::bigint as back from nation")
def _(t):
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("idx"), "n_name")
    order = rows.select(F.col("idx").alias("old_idx"), (F.row_number().over(Window.orderBy(F.md5("n_name"))) - 1).cast("long").alias("new_idx"))  # 25 rows
    moved = batch.reorder(rows, order).select(F.col("idx").alias("new_idx"), "n_name")
    back = batch.inverse(order).select(F.col("old_idx").alias("new_idx"), F.col("new_idx").alias("back"))
    return moved.join(order, "new_idx").join(back, "new_idx").select("old_idx", "new_idx", "n_name", "back")


@query("q39_resume_anti", "select event_id, event_type from events where event_id % 2 <> 0 and event_id % 3 <> 0")
def _(t):
    keys = t.events.select("event_id")
    return batch.without_processed(t.events.select("event_id", "event_type"), keys.where("event_id % 2 = 0"), keys.where("event_id % 3 = 0"), key="event_id")


@query("q40_drop_last_batches", "with i as (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 512 as batch from orders) select batch::bigint as batch, count(*)::bigint as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key from i group by batch having count(*) = 512")
def _(t):
    rows = batch.batches(batch.with_index(t.orders.select("o_orderkey"), ["o_orderkey"]), 512)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("q41_gather_lists", "select conv_id, string_agg(role, ',' order by turn) as roles, md5(string_agg(text, '|' order by turn)) as texts from conversations group by conv_id")
def _(t):
    return batch.collate(t.conversations, "conv_id", "turn", "role", "text").select("conv_id", F.array_join("role", ",").alias("roles"), F.md5(F.array_join("text", "|")).alias("texts"))


def rewards(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", F.col("user_id").alias("uid"), F.col("value").alias("score"))


_GROUPS = "with g as (select user_id, count(*) as n, avg(value) as mean, stddev_samp(value) as sd, sum(value) as total from events group by user_id)"


@query("q42_grpo_advantage", f"{_GROUPS} select event_id, (value - mean) / (sd + 1e-6) as advantage from events e join g on e.user_id = g.user_id where n > 1")
def _(t):
    return advantage.grpo(_larger(rewards(t))).select("event_id", "advantage")


def _larger(rows: DataFrame) -> DataFrame:
    """Groups with more than one member, which the two operators ask for."""
    return rows.join(rows.groupBy("uid").count().where("count > 1").select("uid"), "uid")


@query("q43_rloo_advantage", f"{_GROUPS} select event_id, value - (total - value) / (n - 1) as advantage from events e join g on e.user_id = g.user_id where n > 1")
def _(t):
    return advantage.rloo(_larger(rewards(t))).select("event_id", "advantage")


@query("q44_remax_advantage", "with b as (select user_id, arg_min(value, (ts, event_id)) as baseline from events group by user_id) select event_id, value - baseline as advantage from events e join b on e.user_id = b.user_id")
def _(t):
    rows = rewards(t)
    first = rows.groupBy("uid").agg(F.min_by("score", F.struct("ts", "event_id")).alias("baseline"))
    return advantage.remax(rows, first).select("event_id", "advantage")


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def positive(v) -> F.Column:
    return F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(0.0))


_TOKENS = "tokens as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings)"


@query("q45_masked_whiten", f"with {_TOKENS}, m as (select *, (v > 0)::int::double as w from tokens), a as (select sum(v * w) / (sum(w) + 1e-8) as mean, sum(w) as n from m), b as (select mean, n, (select sum((v - mean) * (v - mean) * w) from m, a) / (n + 1e-8) * n / (n - 1) as var from a) select vec_id, sum((v - mean) / sqrt(var + 1e-8) * w) as total, max((v - mean) / sqrt(var + 1e-8) * w) as top from m, b group by vec_id")
def _(t):
    rows = advantage.whiten(vectors(t).withColumn("m", positive("v")), "v", "m")
    return rows.select("vec_id", A.total(F.col("whitened")).alias("total"), F.array_max("whitened").alias("top"))


_GAE = 0.99 * 0.95


@query("q46_gae", f"with {_TOKENS}, r as (select x.vec_id, x.i, x.v + 0.99 * coalesce(n.v, 0) - b.v as d from tokens x join tokens b on x.vec_id = b.vec_id and b.i = 65 - x.i left join tokens n on x.vec_id = n.vec_id and n.i = 64 - x.i) select vec_id, sum(d * pow({_GAE!r}, i - 1)) as first, sum(d * (1 - pow({_GAE!r}, i)) / (1 - {_GAE!r})) as total from r group by vec_id")
def _(t):
    rows = vectors(t).select("vec_id", A.gae_advantages(F.col("v"), F.reverse("v"), 0.99, 0.95).alias("a"))
    return rows.select("vec_id", F.get("a", F.lit(0)).alias("first"), A.total(F.col("a")).alias("total"))


@query("q47_reinforce_pp", f"with {_TOKENS} select vec_id, sum(case when i <= 1 + vec_id % 64 then v * pow(0.9::double, i - 1) else 0 end) as first, sum(case when i <= 1 + vec_id % 64 then v * (1 - pow(0.9::double, i)) / (1 - 0.9::double) else v end) as total from tokens group by vec_id")
def _(t):
    mask = F.transform("v", lambda _, i: F.when(i <= F.col("vec_id") % 64, 1.0).otherwise(0.0))
    rows = vectors(t).select("vec_id", A.discounted_returns(F.col("v"), mask, 0.9).alias("r"))
    return rows.select("vec_id", F.get("r", F.lit(0)).alias("first"), A.total(F.col("r")).alias("total"))


def token_ids(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", F.transform("v", lambda x: F.floor(F.abs(x) * 20)).alias("ids"))


_IDS = "ids as (select vec_id, list_transform(embedding, lambda x: floor(abs(x::double) * 20)::bigint) as ids from embeddings)"


@query("q48_response_mask", f"with {_IDS} select vec_id, array_to_string(list_transform(range(1, 65), lambda i: case when i <= coalesce(nullif(list_position(ids, 1), 0), 64) then 1 else 0 end), ',') as mask from ids")
def _(t):
    return token_ids(t).select("vec_id", joined_text(A.response_mask(F.col("ids"), [1])).alias("mask"))


@query("q49_position_ids", f"with {_TOKENS}, s as (select vec_id, i, greatest(sum((v > 0)::int) over (partition by vec_id order by i) - 1, 0)::bigint as p from tokens) select vec_id, string_agg(p::varchar, ',' order by i) as positions from s group by vec_id")
def _(t):
    mask = F.transform("v", lambda x: F.when(x > 0, 1).otherwise(0).cast("long"))
    return vectors(t).select("vec_id", joined_text(A.position_ids(mask)).alias("positions"))


_FITTED = "with w as (select doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda x: length(x)) as ids, len(string_split(coalesce(text, ''), ' ')) as n from documents) select doc_id, array_to_string(case when n >= 40 then ids[n - 39:n] else list_transform(range(40 - n), lambda x: 0::bigint) || ids end, ',') as on_left, array_to_string(case when n >= 40 then ids[1:40] else ids || list_transform(range(40 - n), lambda x: 0::bigint) end, ',') as on_right from w"


@query("q50_pad_truncate", _FITTED)
def _(t):
    """The lengths of the pieces between blanks, of every text, as ids that are brought to 40 from either side."""
    rows = t.documents.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda x: F.length(x).cast("long")).alias("ids"))
    return rows.select("doc_id", joined_text(A.fit_left(F.col("ids"), 40, 0)).alias("on_left"), joined_text(A.fit_right(F.col("ids"), 40, 0)).alias("on_right"))


def pairs(t: Tables) -> DataFrame:
    """Each vector as p, the next as r, and its own positive entries as the mask."""
    one = vectors(t).select("vec_id", F.col("v").alias("p"))
    other = vectors(t).select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("r"))
    return one.join(other, "vec_id").withColumn("m", positive("p"))


_PAIRS = _TOKENS + ", pairs as (select a.vec_id, a.i, a.v as p, b.v as r, (a.v > 0)::int::double as m from tokens a join tokens b on b.vec_id = a.vec_id + 1 and b.i = a.i)"


@query("q51_kl_variants", f"with {_PAIRS}, k as (select *, least(10.0, greatest(-10.0, exp(r - p) - (r - p) - 1)) as low from pairs) select vec_id, sum(p - r) as kl, sum(abs(p - r)) as abs, sum(0.5 * (p - r) * (p - r)) as mse, sum(low) as low_var_kl, sum(p - 0.1 * low * m) as penalised from k group by vec_id")
def _(t):
    rows = pairs(t)
    kinds = {k: A.divergence(k, F.col("p"), F.col("r")) for k in ("kl", "abs", "mse", "low_var_kl")}
    less = A.penalised(F.col("p"), kinds["low_var_kl"], F.col("m"), 0.1)
    return rows.select("vec_id", *(A.total(v).alias(k) for k, v in kinds.items()), A.total(less).alias("penalised"))


@query("q52_reward_placement", "select vec_id, (label * (vec_id % 64 + 1))::double as weighted, label::double as total from embeddings")
def _(t):
    placed = A.at_index(F.lit(64), (F.col("vec_id") % 64).cast("int"), F.col("label").cast("double"))
    rows = vectors(t).select("vec_id", placed.alias("a"))
    return rows.select("vec_id", A.total(F.transform("a", lambda x, i: x * (i + 1))).alias("weighted"), A.total(F.col("a")).alias("total"))


@query("q53_ppo_loss", f"with {_PAIRS}, x as (select m, r - p as d, exp(r - p) as ratio, r as a from pairs), c as (select *, -a * ratio as plain, -a * greatest(0.8, least(1.2, ratio)) as cut from x), l as (select *, case when a < 0 then least(greatest(plain, cut), -a * 3.0) else greatest(plain, cut) end as loss from c) select sum(loss * m) / (sum(m) + 1e-8) as loss, sum((cut > plain)::int * m) / (sum(m) + 1e-8) as clip_high, sum((a < 0 and greatest(plain, cut) > -a * 3.0)::int * m) / (sum(m) + 1e-8) as clip_low, sum(-d * m) / (sum(m) + 1e-8) as kl from l")
def _(t):
    return losses.policy_loss(pairs(t).withColumn("a", F.col("r")), "p", "r", "a", "m")


@query("q54_value_loss", f"with {_PAIRS}, x as (select m, (p - v) * (p - v) as plain, (greatest(r - 0.05, least(r + 0.05, p)) - v) * (greatest(r - 0.05, least(r + 0.05, p)) - v) as cut from (select *, p + r as v from pairs)) select 0.5 * sum(greatest(plain, cut) * m) / (sum(m) + 1e-8) as loss, sum((cut > plain)::int * m) / (sum(m) + 1e-8) as clipped from x")
def _(t):
    rows = pairs(t).withColumn("v", F.zip_with("p", "r", lambda p, r: p + r))
    return losses.value_loss(rows, "p", "r", "v", "m", 0.05)


@query("q55_batch_metrics", f"with {_PAIRS}, s as (select vec_id, sum(p) as score, sum(m) as length from pairs group by vec_id), a as (select avg(score) as score_mean, max(score) as score_max, min(score) as score_min, avg(length) as length_mean, max(length) as length_max, min(length) as length_min from s), b as (select avg(r) as advantage_mean, max(r) as advantage_max, min(r) as advantage_min, avg(p) as return_mean, max(p) as return_max, min(p) as return_min, 1 - var_samp(p - r) / (var_samp(p) + 1e-5) as explained_variance from pairs where m > 0) select score_mean, score_max, score_min, advantage_mean, advantage_max, advantage_min, return_mean, return_max, return_min, length_mean, length_max, length_min, explained_variance from a, b")
def _(t):
    return metrics.batch_metrics(pairs(t), "p", "r", "p", "m", values="r")


@query("q56_throughput", "select source, sum(n_chars)::bigint as tokens, sum(n_chars) / (count(*) * 2.0::double) as rate from documents group by source")
def _(t):
    grouped = t.documents.groupBy("source").agg(F.sum("n_chars").alias("tokens"), F.count("*").alias("seconds"))
    return grouped.select("source", "tokens", metrics.throughput(F.col("tokens"), F.col("seconds").cast("double"), 2).alias("rate"))


@query("q57_flops", "select sum(n_chars::double) as tokens, sum(n_chars::double * n_chars) as squares, 6.0::double * 7e9 * sum(n_chars::double) + 12.0::double * sum(n_chars::double * n_chars) * 128 * 28 * 28 as flops from documents")
def _(t):
    return metrics.flops(t.documents, "n_chars", 7e9, 28, 28, 128)


@query("q58_kl_controller", "with s as (select date_trunc('hour', ts) as step, avg(value) / 100 as kl, count(*)::double as n from events group by 1) select epoch(step)::bigint as step, 0.01 * exp(sum(ln(1 + greatest(-0.2, least(0.2, kl / 0.5 - 1)) * n / 10000)) over (order by step)) as coefficient from s")
def _(t):
    hour = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    steps = t.events.groupBy(hour.alias("step")).agg((F.avg("value") / 100).alias("kl"), F.count("*").cast("double").alias("n"))
    return losses.coefficients(steps, 0.01, 0.5, 10000)


_VOTES = "with c as (select user_id, event_type, count(*) as votes, min((ts, event_id)) as f from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by votes desc, f) as k, sum(votes) over (partition by user_id) as total from c)"


@query("q59_majority_vote_exact", f"{_VOTES} select user_id, event_type, votes::bigint as votes, total::bigint as total, votes::double / total as score from r where k = 1")
def _(t):
    return grading.majority(t.events, "user_id", "event_type", ["ts", "event_id"])


@query("q60_self_consistency", "with g as (select event_type as golden from events group by 1 order by count(*) desc, 1 limit 1) select user_id, count(*) filter (event_type = golden)::bigint as consistent, count(*)::bigint as total, (count(*) filter (event_type = golden))::double / count(*) as score from events, g group by user_id")
def _(t):
    golden = t.events.groupBy(F.col("event_type").alias("golden")).count().orderBy(F.desc("count"), "golden").limit(1).select("golden")
    return grading.self_consistency(t.events.join(F.broadcast(golden)), "user_id", "event_type", F.col("golden"))


@query("q61_solver_reward", "select doc_id, 0.9::double * quality + 0.1::double * (case when doc_id % 3 = 0 then 0 else 1 end) as reward from labels")
def _(t):
    reply = F.concat(F.lit("<think>x</think>"), F.when(F.col("doc_id") % 3 == 0, "?").otherwise(""), F.lit("\\boxed{1}"))
    return t.labels.select("doc_id", grading.solver_reward(F.col("quality").cast("double"), X.solver_format(reply)).alias("reward"))


@query("q62_bleu_cluster_share")
def _(t):
    shares = similarity.cluster_share(t.benchmark.withColumn("batch", F.floor(F.col("item_id") / 40)), "batch", "item_id", "text")
    reward = grading.questioner_reward(F.length("text") > 100, F.lit(0.4), F.col("share"))
    return shares.join(t.benchmark, "item_id").select("batch", "item_id", "share", reward.alias("reward"))


@query("q63_kk_balance")
def _(t):
    rows = t.documents.select(F.floor(F.col("doc_id") / 512).alias("batch"), "doc_id", "n_chars")
    return balance.balanced(rows, "batch", "doc_id", "n_chars", 8, equal_size=False)


@query("q64_best_candidate", "with r as (select *, row_number() over (partition by s_nationkey order by case when s_acctbal > 5000 then 0 when s_acctbal > 0 then 1 else 2 end, s_acctbal desc, s_suppkey) as k from supplier) select s_nationkey, s_suppkey, s_name, s_acctbal from r where k = 1")
def _(t):
    tier = F.when(F.col("s_acctbal") > 5000, 0).when(F.col("s_acctbal") > 0, 1).otherwise(2)
    return grading.best_candidate(t.supplier, ["s_nationkey"], tier, "s_acctbal", "s_suppkey").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")


@query("q65_micro_batches", "with o as (select doc_id // 256 as batch, ceil(sum(n_chars) / 50000.0)::bigint as own from documents group by 1) select batch::bigint as batch, own, max(own) over () as micro_batches from o")
def _(t):
    return balance.micro_batches(t.documents.withColumn("batch", F.floor(F.col("doc_id") / 256)), "batch", "n_chars", 50000)


@query("q66_changed_quotas", "with a as (select source, count(*) as q from documents where doc_id % 2 = 0 group by 1), b as (select source, count(*) as q from documents where doc_id % 2 = 1 group by 1) select coalesce(a.source, b.source) as category, a.q::bigint as old_quota, b.q::bigint as new_quota from a full outer join b on a.source = b.source where a.q is distinct from b.q")
def _(t):
    half = lambda k: t.documents.where(F.col("doc_id") % 2 == k).groupBy(F.col("source").alias("category")).agg(F.count("*").alias("quota"))
    return quota.changed_quotas(half(0), half(1))


_WEAK = "weak as (select event_type as question_type, json_extract_string(props, '$.k') as description, count(*)::bigint as c, min(event_id) as first_seen from events group by 1, 2), ranked as (select *, row_number() over (partition by question_type order by c desc, first_seen) as rank from weak)"


@query("q67_weakness_summary", f"with {_WEAK} select question_type, count(*)::bigint as kinds, sum(c)::bigint as occurrences, string_agg(description, ',' order by rank) filter (rank <= 3) as top from ranked group by 1")
def _(t):
    return diagnosis.weakness_summary(weaknesses(t)).withColumn("top", F.array_join("top", ","))


@query("q68_weakness_prompt", f"with {_WEAK} select question_type, string_agg(rank::varchar || '. ' || description || ' (seen ' || c::varchar || ' times)', chr(10) order by rank) as prompt from ranked where rank <= 5 and c >= 2 group by 1")
def _(t):
    return diagnosis.weakness_prompt(weaknesses(t))


@query("q69_named_class", "select event_id, case when event_type = 'view' then 'view' when event_type = 'click' then 'click' else 'mixed' end as class from events")
def _(t):
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.col("event_type"), F.lit(" it is"))).otherwise(F.concat(F.lit("It is "), F.col("event_type")))
    return t.events.select("event_id", X.named_class(reply, ["click", "view"]).alias("class"))


@query("q70_wording_score", "select event_id, case event_id % 4 when 0 then value when 1 then 9.0 when 2 then 5.0 else 3.0 end as score from events")
def _(t):
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "An EXCELLENT one").when(k == 2, "okay").otherwise("hm")
    return t.events.select("event_id", X.wording_score(reply).alias("score"))


@query("q71_sequence_kl", f"with {_PAIRS}, s as (select vec_id, sum((p - r) * m) / (sum(m) + 1e-8) as kl from pairs group by 1) select avg(kl) as kl from s")
def _(t):
    return metrics.sequence_kl(pairs(t).withColumn("kl", A.divergence("kl", F.col("p"), F.col("r"))), "kl", "m")


@query("q72_question_triple", "select p_partkey, 'numerical' as kind, p_name as question, p_size::varchar as answer, case when p_partkey % 2 = 0 then 1.0 else 0.0 end::double as form from part")
def _(t):
    reply = F.concat(F.when(F.col("p_partkey") % 2 == 0, "").otherwise("Here: "), F.lit("<type>numerical</type>\n<question> "), F.col("p_name"), F.lit("</question><answer>"), F.col("p_size").cast("string"), F.lit("</answer>"))
    return t.part.select("p_partkey", X.question_triple(reply).alias("q"), X.questioner_format(reply).alias("form")).select("p_partkey", "q.*", "form")


@query("q73_section_timing", "with s as (select source as name, count(*)::double as seconds from documents group by 1), k as (select source as name, sum(n_chars) as tokens from documents group by 1 having sum(n_chars) % 3 > 0) select s.name, seconds, seconds * 1000 / tokens as ms_per_token from s left join k on s.name = k.name")
def _(t):
    seconds = t.documents.groupBy(F.col("source").alias("name")).agg(F.count("*").cast("double").alias("seconds"))
    # the tokens of some sections are not known
    tokens = t.documents.groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("tokens")).where("tokens % 3 > 0")
    return metrics.timing(seconds, tokens)


@query("q74_fold_batch", "select (o_orderkey_idx // 4)::bigint as fold, string_agg(o_orderstatus, '' order by o_orderkey_idx) as states from (select o_orderstatus, row_number() over (order by o_orderkey) - 1 as o_orderkey_idx from orders) group by 1")
def _(t):
    rows = batch.with_index(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    return batch.fold(rows, 4, "idx", "o_orderstatus").select("fold", F.array_join("o_orderstatus", "").alias("states"))


@query("q75_run_statistics", "select count(*)::bigint as n, count(*) filter (event_type <> 'error')::bigint as succeeded, count(*) filter (event_type = 'error')::bigint as failed, (count(*) filter (event_type <> 'error')) * 100.0::double / count(*) as percent from events")
def _(t):
    return metrics.run_statistics(t.events.select(F.struct((F.col("event_type") != "error").alias("success")).alias("_meta")))


@query("q76_fuzzy_vote", "with c as (select user_id, event_id, length(event_type) as class, case when event_id % 2 = 0 then '$' || length(event_type)::varchar || '.0$' else length(event_type)::varchar end as text from events), k as (select user_id, class, count(*) as votes, min(event_id) as first, arg_min(text, event_id) as answer from c group by 1, 2), r as (select *, row_number() over (partition by user_id order by votes desc, first) as place, sum(votes) over (partition by user_id) as total from k) select user_id::varchar as question_id, answer, votes::bigint as votes, total::bigint as total, votes::double / total as score from r where place = 1")
def _(t):
    # each user's events are the candidates for one question, alternating spellings of the same number
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("$"), F.length("event_type").cast("string"), F.lit(".0$"))).otherwise(F.length("event_type").cast("string"))
    rows = t.events.select(F.col("user_id").cast("string").alias("question_id"), F.col("event_id").alias("candidate_index"), answer.alias("text"))
    return grading.majority_of_classes(rows)


@query("q77_image_gate", "select p_partkey, not (p_size * 30 < 512 and p_partkey % 900 < 512) and p_retailprice * 1000 between 20480 and 5242880 and p_size * 4.0 >= 80 as accepted from part")
def _(t):
    return t.part.select("p_partkey", images.acceptable(F.col("p_size") * 30, F.col("p_partkey") % 900, F.col("p_retailprice") * 1000, F.col("p_size") * 4.0).alias("accepted"))


@query("q78_image_sizes", "with s as (select p_partkey, p_size * 30 as w, (p_partkey % 900 + 1)::int as h from part), f as (select *, case when w * h > 300000 then sqrt(300000.0::double / (w * h)) when w * h < 65536 then sqrt(65536.0::double / (w * h)) else 1.0 end::double as f from s) select p_partkey, trunc(w * f)::int as width, trunc(h * f)::int as height from f")
def _(t):
    sized = images.within_pixels((F.col("p_size") * 30).cast("int"), (F.col("p_partkey") % 900 + 1).cast("int"), 65536, 300000)
    return t.part.select("p_partkey", sized.alias("s")).select("p_partkey", "s.*")


@query("q79_validated_plans", "select p_partkey, case when p_type in ('PROMO', 'LARGE') then p_type else 'mixed' end as image_type, coalesce(nullif(p_name, ''), 'none') as summary, 'numerical' as question_type from part")
def _(t):
    rows = t.part.select("p_partkey", F.col("p_type").alias("image_type"), F.col("p_name").alias("summary"))
    return records.validated(rows, {"image_type": "mixed", "summary": "none", "question_type": "numerical"}, {"image_type": ["PROMO", "LARGE"]})


@query("q80_until_successes", "with g as (select ts, event_id from events where event_type = 'purchase' order by ts, event_id limit 1 offset 99) select event_id, event_type from events e where not exists (select 1 from g) or (e.ts, e.event_id) <= (select (ts, event_id) from g)")
def _(t):
    rows = t.events.select("event_id", "event_type", "ts", (F.col("event_type") == "purchase").alias("ok"))
    return records.until_successes(rows, ["ts", "event_id"], "ok", 100).select("event_id", "event_type")
