"""The driver's tables seen as trajectories, disks and stored rows; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta, fold, lineage

BLOCK_CHARS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def actions(spark: SparkSession, sf_dir: str, run: int | None = None) -> DataFrame:
    """One action for each row of ``events``: a run is a user; ``run`` reaches the scan as a filter."""
    events = table(spark, sf_dir, "events")
    events = events if run is None else events.where(F.col("user_id") == run)
    k = F.get_json_object("props", "$.k").cast("int")
    action = (
        F.when(F.col("event_type") == "click", "inc").when(F.col("event_type") == "view", "peek").when(F.col("event_type") == "signup", "list_items")
        .when(F.col("event_type") == "purchase", F.when(k >= 95, "submit").otherwise("sample")).otherwise("unknown")
    )
    return events.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), "event_id", "ts", action.alias("action"), k.alias("k"), F.pmod(k, F.lit(8)).alias("n"))


def trajectories(spark: SparkSession, sf_dir: str, run: int | None = None) -> DataFrame:
    """What the episodes record, in spans that end with each accepted list_items: there a state is taken."""
    return lineage.in_spans(fold.fold(actions(spark, sf_dir, run), ["ts", "event_id"], commit=(F.col("action") == "list_items") & (F.col("status") == "ok")))


def tampered(rows: DataFrame) -> DataFrame:
    """Trajectories as someone changed them: some observations, some actions under their old observations, and the spacing of some, which is no change."""
    at = lambda k, *names: (F.col("k") == k) & (F.col("status") == "ok") & F.col("action").isin(*names)
    return rows.select("span_id", "t", F.when(at(17, "inc"), "peek").otherwise(F.col("action")).alias("action"), "n", "status", F.when(at(13, "inc", "peek"), '{"value":-1}').when(F.col("k") % 7 == 1, F.replace("observation", F.lit(":"), F.lit(" : "))).otherwise(F.col("observation")).alias("observation"))


TRAJECTORIES = """
acts as (
  select 'r' || user_id as run_id, event_id, ts, (props->>'$.k')::int as k,
    case event_type when 'click' then 'inc' when 'view' then 'peek' when 'signup' then 'list_items'
      when 'purchase' then case when (props->>'$.k')::int >= 95 then 'submit' else 'sample' end else 'unknown' end as action,
    case (props->>'$.k')::int % 8 when 0 then 3 else (props->>'$.k')::int % 8 end as n
  from events),
numbered as (
  select *, row_number() over w as t, coalesce(sum((action = 'submit')::int) over (partition by run_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) > 0 as closed
  from acts window w as (partition by run_id order by ts, event_id)),
asked as (select *, not closed and action in ('inc', 'list_items', 'sample') as spends from numbered),
ranked as (select *, sum(spends::int) over (partition by run_id order by t) as asked from asked),
judged as (select *, case when closed then 'EpisodeComplete' when action = 'unknown' then 'UnknownAction' when spends and asked > 20 then 'ActionRefused' end as error from ranked),
valued as (
  select *, case when error is null then 'ok' else 'error' end as status,
    case when closed or action in ('peek', 'submit') then 0 else 1 end as cost, (20 - least(20, asked))::int as steps,
    (sum((error is null and action = 'inc')::int) over (partition by run_id order by t))::bigint as value,
    (sum(case when error is null and action = 'sample' then n else 0 end) over (partition by run_id order by t))::bigint as cursor,
    (error is null and action = 'list_items')::int as commits_here
  from judged),
traj as (
  select *, (sum(commits_here) over (partition by run_id order by t) - commits_here)::bigint as span_no, run_id || '-p' || (sum(commits_here) over (partition by run_id order by t) - commits_here)::bigint as span_id,
    case when error is null then case
      when action in ('inc', 'peek') then '{"value":' || value || '}'
      when action = 'list_items' then '{"items":["item_0","item_1","item_2","item_3","item_4","item_5","item_6","item_7"]}'
      when action = 'submit' then '{"ok":true,"submission":null,"value":' || value || '}'
      else '{"items":[' || coalesce(array_to_string(list_transform(range(cursor - n, least(cursor, 64)), lambda i: '"id_03_' || lpad(i::varchar, 4, '0') || '"'), ','), '') || ']}' end end as observation
  from valued),
states as (
  select run_id || '-s' || n as state_id, run_id, n, case when n > 0 then run_id || '-s' || (n - 1) end as parent_state_id, case when n > 0 then run_id || '-p' || (n - 1) end as from_span_id, t::bigint as t, steps, value::bigint as value, cursor::bigint as cursor, done, 'snapshots/' || run_id || '-s' || n as snapshot_uri
  from (select run_id, span_no + 1 as n, t, steps, value, cursor, closed as done from traj where commits_here = 1 union all select distinct run_id, 0, 0, 20, 0, 0, false from traj)),
spans as (
  select s.run_id || '-p' || s.n as span_id, s.run_id, s.n, s.state_id as from_state_id, s.t + 1 as t_start, min(e.t) as t_lo, max(e.t) as t_end, count(e.t) as n_events,
    case when max(e.commits_here) = 1 then s.run_id || '-s' || (s.n + 1) end as to_state_id
  from states s left join traj e on e.run_id = s.run_id and e.span_no = s.n group by s.run_id, s.n, s.state_id, s.t)
"""


def recorded(rows: DataFrame) -> DataFrame:
    """Whole events of trajectories, as they are stored."""
    return rows.select(
        F.lit(1).alias("protocol"), F.col("t").cast("int").alias("t"), F.lit(0.0).alias("ts"), "action", F.to_json(F.struct("n")).alias("params"), "status", "cost",
        F.create_map(F.lit("steps"), F.col("steps").cast("double")).alias("budget_remaining"), "observation", F.lit(None).cast("string").alias("obs_summary"), "error", F.lit(None).cast("string").alias("message"), "run_id", "span_id", F.concat("run_id", F.lit("-box")).alias("sandbox_id"),
    )


def disk(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """Texts of even (0) or odd (1) ids as disks of blocks: disk ``i`` is based on text 2i and works as 2i + 1."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == odd)
    n = F.floor((F.length("text") + BLOCK_CHARS - 1) / BLOCK_CHARS)
    each = docs.where(n > 0).select(F.floor(F.col("doc_id") / 2).cast("string").alias("disk"), "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("idx"))
    # A digest stands for each block, so that block sizes do not depend on the alphabet.
    return each.select("disk", "idx", F.unhex(F.md5(F.substring("text", (F.col("idx") * BLOCK_CHARS + 1).cast("int"), F.lit(BLOCK_CHARS)))).alias("data"))


def sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("disk").agg((F.max("idx") + 1).alias("n_blocks"))


def upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.changed(disk(spark, sf_dir, 1), disk(spark, sf_dir, 0), 16)


DISKS = """
blocks as (
  select (doc_id // 2)::varchar as disk, doc_id % 2 as odd, i as idx, md5(substring(text, (i * 256 + 1)::int, 256)) as data
  from (select doc_id, text, unnest(range(((length(text) + 255) // 256)::bigint)) as i from documents)),
base as (select disk, idx, data from blocks where odd = 0), working as (select disk, idx, data from blocks where odd = 1),
upper as (select w.* from working w left join base b using (disk, idx) where w.data <> coalesce(b.data, repeat('0', 32))),
sizes as (select disk, max(idx) + 1 as n_blocks from working group by disk)
"""


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as writes of (order, line), in a total order."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", F.when(F.col("l_quantity") > 10, F.col("l_linestatus")).alias("l_linestatus"))


WRITES = "select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, case when l_quantity > 10 then l_linestatus end as l_linestatus from lineitem"
WRITE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
