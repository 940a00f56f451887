"""What is written and read again, stores and streams, table functions, and orders that are worked out: queries on whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import images
from tidemill.operators import balance, batch, grading, metrics, quota, records, rewards, selection, table_functions
from tidemill.operators.versions import VersionedTable, markdown
from tidemill.plans.batch_queries import vectors
from tidemill.plans.curation_queries import EVENT_QUOTAS
from tidemill.plans.providers import Canned
from tidemill.plans.registry import Registry, Tables
from tidemill.plans.replies import ReplyStore
from tidemill.sources import readers, sinks
from tidemill.storage import shared_folder
from tidemill.streaming import quota_stream

query = Registry()


def folder(t: Tables) -> str:
    return shared_folder(t.spark, "query")


_SPREAD = "with s as (select doc_id // 512 as batch, count(*) as n, sum(n_chars) as total, max(n_chars) as longest from documents group by 1) select batch::bigint as batch, n::bigint as n, total::bigint as total, longest::bigint as longest, true as within from s"


@query("q117_balance_bounds", _SPREAD)
def _(t):
    """The lists of every batch, from shards of 128 rows, have all its rows, and sums no further apart than its longest row."""
    rows = t.documents.select(F.floor(F.col("doc_id") / 512).alias("batch"), "doc_id", "n_chars")
    lists = balance.balanced(rows, "batch", "doc_id", "n_chars", 8, equal_size=False, shard=128).groupBy("batch", "partition").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.max("n_chars").alias("longest"))
    least = F.when(F.count("*") < 8, 0).otherwise(F.min("total"))  # lists without rows have no row here
    return lists.groupBy("batch").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("longest").cast("long").alias("longest"), (F.max("total") - least <= F.max("longest")).alias("within"))


def _order_sql(seed: int) -> str:
    """The permutation of ``selection.permuted`` for n rows numbered x."""
    offsets = [selection._offset(seed, k) for k in range(selection.ROUNDS)]
    added = lambda v, size: f"(({v} + o[k + 1]) * ({v} + o[k + 1]) % {selection.PRIME} % {size})"
    once = lambda x: f"list_reduce(list_concat([{x}], range({selection.ROUNDS})), lambda s, k: case when k % 2 = 0 then (s // b + {added('(s % b)', 'a')}) % a * b + s % b else s // b * b + (s % b + {added('(s // b)', 'b')}) % b end)"
    walked = f"list_reduce(list_concat([{once('x')}], range(64)), lambda y, j: case when y < n then y else {once('y')} end)"
    return f"select doc_id, {walked} as idx from (select *, {offsets}::bigint[] as o from numbered)"


_NUMBERED = "with sized as (select count(*)::bigint as n, floor(sqrt(count(*) - 1))::bigint + 1 as a from documents), numbered as (select doc_id, row_number() over (order by doc_id) - 1 as x, n, a, (n + a - 1) // a as b from documents, sized)"


@query("q118_mini_batches", f"{_NUMBERED}, placed as (select 0 as epoch, * from ({_order_sql(42)}) union all select 1, * from ({_order_sql(43)})) select doc_id, epoch, idx // 32 as batch, idx from placed")
def _(t):
    return records.mini_batches(t.documents.select("doc_id"), "doc_id", 32, epochs=2).select("doc_id", "epoch", "batch", "idx")


@query("q119_candidates_udtf", "select p_partkey, k::int as candidate, p_name || '|' || k as asked from part, (select unnest(range(3)) as k)")
def _(t):
    table_functions.register(t.spark)
    t.part.select("p_partkey", "p_name").createOrReplaceTempView("tidemill_prompts")
    return t.spark.sql("select p_partkey, candidate, asked from candidates(TABLE(tidemill_prompts), 'p_name', 3)")


@query("q120_first_valid_udtf", "with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as tries from events) select user_id, min(event_id) as event_id, min(tries)::bigint as tries from r where event_type <> 'error' group by 1")
def _(t):
    table_functions.register(t.spark)
    t.events.select("user_id", "event_id", (F.col("event_type") != "error").alias("valid")).createOrReplaceTempView("tidemill_tried")
    return t.spark.sql("select user_id, event_id, tries from first_valid(TABLE(tidemill_tried), 'user_id', 'event_id', 'valid')")


@query("q121_json_arrays", "select doc_id, text, lang, source from documents")
def _(t):
    path, rows = folder(t), t.documents.select("doc_id", "text", "lang", "source")
    sinks.write_json_array(rows, path)
    return readers.json_array(t.spark, path, rows.schema)


@query("q122_json_lines", "select event_id, event_type, value from events")
def _(t):
    path, rows = folder(t), t.events.select("event_id", "event_type", "value")
    sinks.write_json(rows, path)
    return readers.json_lines(t.spark, path, rows.schema)


@query("q123_tolerant_json_lines", "select count(*) filter (doc_id % 7 <> 0)::bigint as good, count(*) filter (doc_id % 7 = 0)::bigint as bad, sum(case when doc_id % 7 <> 0 then length(text) end)::bigint as chars from documents")
def _(t):
    path, rows = folder(t), t.documents.select("doc_id", "text")
    line = F.to_json(F.struct("doc_id", "text"))
    # every seventh line breaks off
    rows.select(F.when(F.col("doc_id") % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.json_lines_tolerant(t.spark, path, rows.schema)
    return good.agg(F.count("*").alias("good"), F.sum(F.length("text")).alias("chars")).join(bad.agg(F.count("*").alias("bad")))


@query("q124_files_in_name_order", "select l_orderkey, count(*)::bigint as n from (select l_orderkey from lineitem order by l_orderkey limit 5000) group by 1")
def _(t):
    path = folder(t)
    sinks.write_training_set(t.lineitem.select("l_orderkey").repartitionByRange(6, "l_orderkey").sortWithinPartitions("l_orderkey"), path)
    return readers.parquet_in_name_order(t.spark, path, 5000).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("q125_dataset_splits", "select source, count(*)::bigint as n, sum(n_chars)::bigint as chars from documents where lang = 'en' group by 1")
def _(t):
    path = folder(t)
    t.documents.where("lang is not null").write.partitionBy("lang").parquet(path)
    return readers.dataset(t.spark, f"{path}@lang=en").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))


@query("q126_log_and_final_set", "select event_id, event_type from events where event_type <> 'error'")
def _(t):
    path, rows = folder(t), t.events.select(F.col("event_id").alias("sample_index"), "event_id", "event_type")
    failed = F.col("event_type") == "error"
    sinks.append_log(rows.where(~failed), f"{path}/log", True)
    sinks.append_log(rows.where(failed), f"{path}/log", False, "failed")
    sinks.finalize_log(t.spark.read.json(f"{path}/log"), f"{path}/final")
    return readers.json_lines(t.spark, f"{path}/final", rows.drop("sample_index").schema)


@query("q127_metric_sinks", "select (event_id % 5)::bigint as step, event_type as name, sum(event_id)::double as value from events group by 1, 2")
def _(t):
    path = folder(t)
    rows = t.events.groupBy((F.col("event_id") % 5).cast("long").alias("step"), F.col("event_type").alias("name")).agg(F.sum("event_id").cast("double").alias("value"))
    sinks.to_sinks(rows, lambda m: sinks.append_metrics(m, f"{path}/parquet"), lambda m: sinks.write_json(m, f"{path}/json"))
    written = t.spark.read.schema("step long, name string, value double").parquet(f"{path}/parquet")
    return written.join(t.spark.read.schema(written.schema).json(f"{path}/json"), ["step", "name", "value"])


@query("q128_union_of_files", "select p_partkey as id, p_name as name from part union all select s_suppkey, s_name from supplier")
def _(t):
    path = folder(t)
    part, supplier = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    sinks.write_json(part, f"{path}/part")
    sinks.write_json(supplier, f"{path}/supplier")
    return readers.union_of_readable(t.spark, [f"{path}/part", f"{path}/missing", f"{path}/supplier"], part.schema, multi_line=False)


@query("q129_versioned_table", "select c_custkey, case when c_mktsegment = 'BUILDING' then 'changed' else c_name end as c_name, c_mktsegment from customer where c_mktsegment <> 'MACHINERY'")
def _(t):
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    table = VersionedTable(t.spark, folder(t), rows.schema, ["c_custkey"])
    table.add(rows)
    table.update({"c_mktsegment": "BUILDING"}, {"c_name": "changed"})
    table.remove({"c_mktsegment": "MACHINERY"})
    return table.at()


_REPORT = """
with s as (select p_brand, 'size ' || p_size as text, p_type, count(*) as n from part group by all),
g as (select p_brand, count(*) as kinds, sum(n) as total from s group by 1),
r as (select *, row_number() over (partition by p_brand order by n desc, text, p_type) as k from s),
lines as (
  select p_brand, 0 as part, 0 as place, unnest(range(1, 8)) as j, unnest(['## ' || p_brand, '', '- kinds: ' || kinds, '- total: ' || total, '', '| rank | text | kind | count |', '|---|---|---|---|']) as line from g
  union all select p_brand, 1, k, 0, '| ' || k || ' | ' || text || ' | ' || p_type || ' | ' || n || ' |' from r where k <= 3
  union all select p_brand, 2, 0, 0, '' from g where kinds > 3
  union all select r.p_brand, 3, k, 0, k || '. **' || text || '** (' || p_type || ', ' || n || ')' from r join g on r.p_brand = g.p_brand where kinds > 3
  union all select p_brand, 4, 0, 0, '' from g
)
select row_number() over (order by p_brand, part, place, j)::int as line_no, line from lines
"""


@query("q130_table_report", _REPORT)
def _(t):
    rows = t.part.groupBy("p_brand", F.concat(F.lit("size "), "p_size").alias("text"), "p_type").agg(F.count("*").alias("n"))
    return markdown(rows, "p_brand", "text", "p_type", "n")


@query("q131_reply_store", "select item_id, case when position(right(md5(text), 1) in '02468ace') > 0 then 'yes' else 'no' end as reply from benchmark")
def _(t):
    store = ReplyStore(t.spark, folder(t))
    return store.ask(t.benchmark.select("item_id", "text"), "text", Canned()).select("item_id", "reply")


_LIMITS = ", ".join(f"('{k}', {n})" for k, n in EVENT_QUOTAS)
_ADMITTED = f"with limits(line, quota) as (values {_LIMITS}), lined as (select e.*, case when l.line is not null then event_type else '{quota.FLEXIBLE}' end as line from events e left join limits l on e.event_type = l.line), ranked as (select *, row_number() over (partition by line order by ts, event_id) as place from lined)"


def _admission(t: Tables, path: str) -> str:
    arrival = F.concat(F.date_format("ts", "yyyyMMddHHmmss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    rows = t.events.select("event_id", "event_type", arrival.alias("arrival"))
    sinks.write_json(rows, f"{path}/in")
    admission = quota_stream.admit_stream(t.spark.readStream.schema(rows.schema).json(f"{path}/in"), dict(EVENT_QUOTAS), "event_type")
    started = quota_stream.write_outcomes(admission, f"{path}/ok", f"{path}/no", f"{path}/checkpoint")
    started.awaitTermination()
    return path


@query("q132_stream_admission", f"{_ADMITTED} select event_id, event_type, case when place <= quota then null else 'Quota exceeded for type' end as error from ranked r join limits l on r.line = l.line")
def _(t):
    path = _admission(t, folder(t))
    read = lambda name: t.spark.read.schema("event_id long, event_type string, error string").json(f"{path}/{name}").drop("batch")
    return read("ok").unionByName(read("no"))


@query("q133_stream_state", f"{_ADMITTED} select l.line as category, count(*) filter (place <= quota)::bigint as count from ranked r join limits l on r.line = l.line group by 1 having count > 0")
def _(t):
    return quota_stream.counts_so_far(t.spark, f"{_admission(t, folder(t))}/checkpoint")


@query("q134_sharpness", "with e as (select vec_id, embedding as v from embeddings), p as (select vec_id, y, x, v from e, (select unnest(range(1, 7)) as y), (select unnest(range(1, 7)) as x)) select vec_id, var_pop(v[(y - 1) * 8 + x + 1]::double + v[(y + 1) * 8 + x + 1]::double + v[y * 8 + x]::double + v[y * 8 + x + 2]::double - 4 * v[y * 8 + x + 1]::double) as sharpness from p group by 1")
def _(t):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("v", y * 8 + 1, 8))
    return vectors(t).select("vec_id", images.sharpness(rows).alias("sharpness"))


@query("q135_slices", "with i as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as x, count(*) over () as n from orders) select (n - 1 - x) // 3 as idx, o_orderkey from i where (n - 1 - x) % 3 = 0")
def _(t):
    """Every third row from the end."""
    return batch.sliced(batch.with_index(t.orders.select("o_orderkey"), ["o_orderkey"]), step=-3).select("idx", "o_orderkey")


@query("q136_metric_lists", "select event_type as name, sum(value * k) as weighted, count(*)::bigint as n from (select *, row_number() over (partition by event_type order by event_id % 2, case when event_id % 2 = 0 then event_id end, value) as k from events) group by 1")
def _(t):
    """Values of even events in their order, then those of odd ones appended."""
    even = t.events.where("event_id % 2 = 0")
    kept = batch.members(even.select(F.col("event_type").alias("name"), "event_id", "value"), "name", ["event_id"]).select("name", "place", "value")
    lists = metrics.metric_lists(metrics.appended(kept, t.events.where("event_id % 2 = 1").select(F.col("event_type").alias("name"), "value")))
    return lists.select("name", F.aggregate(F.transform("values", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, x: a + x).alias("weighted"), F.size("values").cast("long").alias("n"))


@query("q137_sorted_then_shuffled", f"with sized as (select count(*)::bigint as n, floor(sqrt(count(*) - 1))::bigint + 1 as a from documents), numbered as (select doc_id, row_number() over (order by text nulls first, doc_id) - 1 as x, n, a, (n + a - 1) // a as b from documents, sized) select doc_id, idx from ({_order_sql(42)}) where idx < 100")
def _(t):
    """A sample of 100 rows is the feature."""
    return records.shuffled_by_text(t.documents.select("doc_id", "text"), "text", 100, ties=["doc_id"]).select("doc_id", "idx")


@query("q138_members", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as place from orders")
def _(t) -> DataFrame:
    return batch.members(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "place")


@query("q139_boxed_content", "select p_partkey, case when p_size > 5 then '\\frac{' || p_size || '}{' || p_name || '}' end as answer from part")
def _(t):
    """A last box with braces in it after another; parts up to size 5 leave theirs open."""
    inner = F.concat(F.lit("\\frac{"), "p_size", F.lit("}{"), "p_name", F.lit("}"))
    text = F.concat(F.lit("So \\boxed{1} or \\boxed{"), inner, F.when(F.col("p_size") > 5, "} it is").otherwise(" it is"))
    return t.part.select("p_partkey", grading.boxed(text).alias("answer"))


@query("q140_checkpoints_to_drop", "select n_nationkey as step, n_name as path from (select *, row_number() over (order by n_nationkey desc) as k from nation) where k > 4")
def _(t):
    return sinks.checkpoints_to_drop(t.nation.select(F.col("n_nationkey").alias("step"), F.col("n_name").alias("path")), 5)


@query("q141_report_file", f"with report as ({_REPORT}) select line, count(*)::bigint as n from report group by 1")
def _(t):
    path = folder(t)
    sinks.write_report(query.queries["q130_table_report"](t.spark, t.folder), path)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("q142_latest_file", "select count(*)::bigint as n, sum(s_suppkey)::bigint as keys from supplier")
def _(t):
    path = folder(t)
    for table in (t.nation.select(F.col("n_nationkey").alias("key")), t.supplier.select(F.col("s_suppkey").alias("key"))):
        table.coalesce(1).write.mode("append").parquet(path)
    found = t.spark.read.parquet(readers.latest_file(t.spark, path))
    return found.agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


_REWARDS = f"{os.path.dirname(os.path.abspath(__file__))}/example_rewards.py"


@query("q143_row_rewards", "select event_id, 0.5::double * value * (event_type <> 'error')::int as overall, (event_type <> 'error')::int::double as format, value as accuracy from events")
def _(t):
    function = rewards.load_function(f"{_REWARDS}:row_reward", scale=0.5)
    return rewards.row_rewards(t.events, function, ["value", "event_type", "scale", "missing"], "event_id")


@query("q144_batch_rewards", "select event_id, 2.0::double * (value - max(value) over (partition by user_id)) as overall, (event_type <> 'error')::int::double as format, value as accuracy from events")
def _(t):
    """A user's events are a batch, which the function sees whole."""
    function = rewards.load_function(f"{_REWARDS}:batch_reward", scale=2.0)
    return rewards.batch_rewards(t.events, function, ["value", "event_type"], "event_id", batch="user_id")
