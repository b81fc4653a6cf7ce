"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import json as js
from ..functions import values
from ..operators import delta, events, fold, layers, lineage, loop, ordered, quality, upsert
from ..sources import images, objects, packed, tables, versions
from ..streaming import episodes, ingest
from . import domain as d

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "q07_episode_fold"


def query(sql: str):
    """Register a query by its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def stored(spark: SparkSession, sf_dir: str, run: int | None = None) -> DataFrame:
    return d.recorded(d.trajectories(spark, sf_dir, run))


URI = "'runs/' || run_id || '/spans/' || span_id || '/events/' || lpad(t::varchar, 8, '0') || '.json'"
SPAN_EVENTS = f"span_ev as (select run_id, span_id, run_id || '-box' as sandbox_id, t::int as t, 0.0::double as ts, action, status, cost, {URI} as event_uri, observation, 1 as protocol from traj)"


@query(f"with {d.TRAJECTORIES}, {SPAN_EVENTS} select * from span_ev where run_id = 'r7' and action = 'inc'")
def q01_query_events(spark, sf_dir):
    return events.query_events(events.span_events(stored(spark, sf_dir, 7)), run_id="r7", span_id="", action="inc")


@query(f"with {d.TRAJECTORIES}, {SPAN_EVENTS} select * from span_ev where span_id = 'r7-p0' and t = 2")
def q02_get_event(spark, sf_dir):
    return events.span_events(stored(spark, sf_dir, 7)).where((F.col("span_id") == "r7-p0") & (F.col("t") == 2))


@query(f"with {d.TRAJECTORIES} select span_id, t::int as t, row_number() over (partition by span_id order by t) as nth, action || ':' || status as step from traj")
def q03_span_events(spark, sf_dir):
    return events.span_steps(stored(spark, sf_dir)).select("span_id", "t", "nth", F.concat("action", F.lit(":"), "status").alias("step"))


@query("with said as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as prompt from conversations where role <> 'system') select conv_id::varchar || '-s' || turn as state_id, (turn + 1)::int as t, 'runs/' || conv_id || '/prompts/' || conv_id || '-s' || turn || '.json' as prompt_uri, text as prompt from conversations where role = 'user' union all select conv_id::varchar || '-s' || turn, (turn + 1)::int, 'runs/' || conv_id || '/prompts/' || conv_id || '-s' || turn || '.json', null from conversations where role <> 'user'")
def q04_state_with_prompt(spark, sf_dir):
    turns = d.table(spark, sf_dir, "conversations")
    run, state = F.col("conv_id").cast("string"), F.concat(F.col("conv_id").cast("string"), F.lit("-s"), F.col("turn").cast("string"))
    states = turns.select(state.alias("state_id"), (F.col("turn") + 1).cast("int").alias("t"), values.prompt_uri(run, state).alias("prompt_uri"))
    prompts = turns.where("role = 'user'").select(values.prompt_uri(run, state).alias("prompt_uri"), F.col("text").alias("prompt"))
    return events.with_prompts(states, prompts)


KEPT, CHANGED = ["l_quantity", "l_returnflag"], ["l_shipdate", "l_linestatus", "l_extendedprice"]
_SEQ = f"row({', '.join(d.WRITE_ORDER)})"
_UPSERT_SQL = f"select l_orderkey, l_linenumber, {', '.join(f'arg_min_null({c}, {_SEQ}) as {c}' for c in KEPT)}, {', '.join(f'arg_max_null({c}, {_SEQ}) as {c}' for c in CHANGED)} from ({d.WRITES}) group by all"


@query(_UPSERT_SQL)
def q05_partial_upsert(spark, sf_dir):
    return upsert.partial_upsert(d.writes(spark, sf_dir), ["l_orderkey", "l_linenumber"], d.WRITE_ORDER, KEPT, CHANGED, dealt=True)


@query(f"with {d.TRAJECTORIES}, {SPAN_EVENTS} select * replace (case when action = 'peek' then null else observation end as observation, case when action = 'peek' then 'error' else status end as status) from span_ev")
def q06_rebuild_analytics(spark, sf_dir):
    rows = ordered.stage(stored(spark, sf_dir), "events")
    # All peeks are written again, as errors: status and observation follow the later write.
    again = rows.where("action = 'peek'").withColumns({"status": F.lit("error"), "observation": F.lit(None).cast("string"), "cost": F.lit(9), "version": F.lit(2)})
    return events.rebuild(rows.withColumn("version", F.lit(1)).unionByName(again), ["version"])


@query(f"with {d.TRAJECTORIES} select run_id, event_id, t, action, status, error, cost, steps, value, observation from traj")
def q07_episode_fold(spark, sf_dir):
    return fold.fold(d.actions(spark, sf_dir), ["ts", "event_id"]).select("run_id", "event_id", "t", "action", "status", "error", "cost", "steps", "value", "observation")


@query(f"with {d.TRAJECTORIES} select run_id, count(*) as events, sum(cost)::bigint as charged, (20 - min(steps))::int as spent, max(value) as value from traj group by run_id")
def q08_budget_spent(spark, sf_dir):
    rows = fold.fold(d.actions(spark, sf_dir), ["ts", "event_id"])
    return rows.groupBy("run_id").agg(F.count("*").alias("events"), F.sum("cost").alias("charged"), (fold.STEPS - F.min("steps")).cast("int").alias("spent"), F.max("value").alias("value"))


@query(f"with {d.TRAJECTORIES} select span_id, run_id, from_state_id, to_state_id, t_start, t_lo, t_end, n_events from spans")
def q09_spans_from_commits(spark, sf_dir):
    return lineage.spans(ordered.stage(d.trajectories(spark, sf_dir), "events"))


@query(f"with {d.TRAJECTORIES} select e.run_id, e.t as event_t, s.state_id, s.t::bigint as state_t from traj e join states s on s.run_id = e.run_id and s.t < e.t where e.action = 'submit' and e.status = 'ok' qualify row_number() over (partition by e.run_id, e.t order by s.t desc) = 1")
def q10_restore_point(spark, sf_dir):
    rows = ordered.stage(d.trajectories(spark, sf_dir), "events")
    return lineage.restore_points(rows, (F.col("action") == "submit") & (F.col("status") == "ok"))


_RECORDED = "case when k = 13 and status = 'ok' and action in ('inc', 'peek') then '{\"value\":-1}' else observation end"
#: What comes out when it is done again, up to the first divergence: where an inc was changed to a peek, the value stays.
_ANEW = "case when k = 17 and status = 'ok' and action = 'inc' then '{\"value\":' || (value - 1) || '}' else observation end"
_BOTH = f"both_ as (select span_id, t, {_ANEW} is distinct from {_RECORDED} as bad from traj)"


@query(f"""with {d.TRAJECTORIES}, {_BOTH}, bad as (select span_id, min(case when bad then t end) as diverged_at from both_ group by span_id),
good as (select span_id, max(t) as last_t, count(*) as n from both_ join bad using (span_id) where diverged_at is null or t < diverged_at group by span_id)
select p.span_id, p.t_start as from_t, coalesce(good.last_t, p.t_start - 1) as last_t, coalesce(good.n, 0) as events_applied, diverged_at from spans p left join bad using (span_id) left join good using (span_id)""")
def q11_replay_verify(spark, sf_dir):
    rows = ordered.stage(d.trajectories(spark, sf_dir), "events")
    states = ordered.stage(lineage.states(rows), "states")
    return lineage.replay(d.tampered(rows), lineage.spans(rows, states), states)


@query(f"with {d.TRAJECTORIES} select span_id, coalesce(t_lo, t_start) as t_lo, coalesce(t_end + 1, t_start) as t_hi, 5 between coalesce(t_lo, t_start) and coalesce(t_end + 1, t_start) as may_stop_at_5 from spans")
def q12_replay_range_check(spark, sf_dir):
    rows = ordered.stage(d.trajectories(spark, sf_dir), "events")
    return lineage.bounds(lineage.spans(rows)).withColumn("may_stop_at_5", F.lit(5).between(F.col("t_lo"), F.col("t_hi")))


@query(f"with {d.TRAJECTORIES} select run_id, state_id as from_state_id, case when n % 2 = 0 then state_id end as parent_state_id, i::int as index, state_id || '-b' || i as sandbox_id, (t + 1)::bigint as t_start from (select *, unnest(range(3)) as i from states)")
def q13_branch_fanout(spark, sf_dir):
    rows = ordered.stage(d.trajectories(spark, sf_dir), "events")
    return lineage.branch(lineage.states(rows), 3, dirty=F.col("n") % 2 == 1)


@query("select conv_id, turn, case when length(text) > 400 then left(text, 400) || '...[' || length(text) || ' chars]' else text end as summary from conversations")
def q14_summary_string(spark, sf_dir):
    return d.table(spark, sf_dir, "conversations").select("conv_id", "turn", js.summary_text(F.col("text")).alias("summary"))


@query("with w as (select doc_id, string_split(text, ' ') as w from documents) select doc_id, array_to_string(case when len(w) > 5 then list_append(w[1:5], '...' || (len(w) - 5) || ' more') else w end, '|') as summary from w")
def q15_summary_list(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", F.array_join(js.summary_list(F.split("text", " ")), "|").alias("summary"))


@query("select event_id, event_type = 'error' as hidden from events")
def q16_hidden_keys(spark, sf_dir):
    key = F.when(F.col("event_type") == "error", "_k").otherwise("k_")
    text = F.concat(F.lit('{ "v": "_x", "a": [1, {"'), key, F.lit('": '), F.col("event_id").cast("string"), F.lit("}], \"q\": \"\\\"_z\"}"))
    return d.table(spark, sf_dir, "events").select("event_id", js.has_hidden_key(text).alias("hidden"))


@query("select event_id, coalesce(nullif((props->>'$.k')::int, 0), 3) as n, contains(props, '1') as has_1, '...' || right(props, 3) as tail from events")
def q17_json_extract(spark, sf_dir):
    n = values.falsy(F.get_json_object("props", "$.k").cast("int"), 3)
    return d.table(spark, sf_dir, "events").select("event_id", n.alias("n"), F.contains("props", F.lit("1")).alias("has_1"), F.concat(F.lit("..."), F.right("props", F.lit(3))).alias("tail"))


@query("select a.event_id, (a.props->>'$.k')::int = (b.props->>'$.k')::int as same from events a join events b on b.event_id = a.event_id + 1")
def q18_json_equal(spark, sf_dir):
    rows = d.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    # The same value written with other spacing, order and form of number.
    other = rows.select((F.col("event_id") - 1).alias("event_id"), F.concat(F.lit('{"b":[1, 2],  "k" : '), k, F.lit(".0}")).alias("other"))
    mine = F.concat(F.lit('{"k":'), k, F.lit(',"b":[1,2]}'))
    return rows.join(other, "event_id").select("event_id", js.json_equal(mine, F.col("other")).alias("same"))


_DIGITS = values.ID_DIGITS
_ID = f"array_to_string(list_transform(range(10), lambda i: substring('{_DIGITS}', (((1704067200000 + event_id * 977) // (32::bigint ** (9 - i))::bigint) % 32 + 1)::int, 1)), '') || 'AAAAAAAAAAAAAAAA'"


@query(f"select event_id, {_ID} as id, 1704067200000 + event_id * 977 as millis, true as valid from events")
def q19_id_decode(spark, sf_dir):
    millis = F.lit(1704067200000) + F.col("event_id") * 977
    text = F.concat(*[F.substring(F.lit(_DIGITS), (F.shiftright(millis, 5 * (9 - i)).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(10)], F.lit("A" * 16))
    rows = d.table(spark, sf_dir, "events").select("event_id", text.alias("id"))
    return rows.select("event_id", "id", values.id_millis(F.col("id")).alias("millis"), values.is_id(F.col("id")).alias("valid"))


@query(f"with {d.DISKS} select disk, idx, data from upper")
def q20_block_diff(spark, sf_dir):
    return d.upper(spark, sf_dir).select("disk", "idx", F.lower(F.hex("data")).alias("data"))


@query(f"with {d.DISKS}, wanted as (select disk, unnest([0, 3, 7, 1000])::bigint as idx from sizes) select disk, idx, coalesce(u.data, b.data, repeat('0', 32)) as data, case when u.data is not null then 'upper' when b.data is not null then 'base' else 'zero' end as layer from wanted left join upper u using (disk, idx) left join base b using (disk, idx)")
def q21_overlay_read(spark, sf_dir):
    wanted = d.sizes(d.disk(spark, sf_dir, 1)).select("disk", F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 3, 7, 1000)])).alias("idx"))
    return delta.read_blocks(wanted, d.upper(spark, sf_dir), d.disk(spark, sf_dir, 0), 16).select("disk", "idx", F.lower(F.hex("data")).alias("data"), "layer")


@query(f"with {d.DISKS} select disk, idx, data from working")
def q22_materialize(spark, sf_dir):
    # Base overlaid by the differences gives the working disk again.
    out = delta.whole(d.sizes(d.disk(spark, sf_dir, 1)), d.upper(spark, sf_dir), d.disk(spark, sf_dir, 0), 16)
    return out.select("disk", "idx", F.lower(F.hex("data")).alias("data"))


@query(f"with {d.DISKS} select disk, idx, 'upper' as layer, (row_number() over (partition by disk order by idx) - 1) * 4096 as \"offset\" from upper")
def q23_block_map(spark, sf_dir):
    return delta.block_map(d.upper(spark, sf_dir))


@query(f"with {d.DISKS}, kids as (select disk, unnest(range(3))::int as child from sizes), own as (select child, disk, child::bigint as idx, md5(disk || child) as data from kids) select * from own union all select child, disk, idx, data from kids join upper using (disk) where not exists (from own where own.child = kids.child and own.disk = kids.disk and own.idx = upper.idx)")
def q24_fork_isolation(spark, sf_dir):
    kids = d.sizes(d.disk(spark, sf_dir, 1)).select("disk", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("child"))
    own = kids.select("child", "disk", F.col("child").cast("long").alias("idx"), F.unhex(F.md5(F.concat("disk", F.col("child").cast("string")))).alias("data"))
    return delta.fork(d.upper(spark, sf_dir), kids, own).select("child", "disk", "idx", F.lower(F.hex("data")).alias("data"))


@query("with r as (select p_partkey::int as region, p_partkey * 70000 as base, (p_size * 2000)::bigint as size, p_partkey * 4096 as off from part), a as (select event_id * 13577 as address from events) select address, region, page::bigint as page from (select address, region, (off + (address // 4096) * 4096 - base) // 4096 as page from a left join r on address >= base and address < base + size qualify row_number() over (partition by address order by region) = 1)")
def q25_region_lookup(spark, sf_dir):
    regions = d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("region"), (F.col("p_partkey") * 70000).alias("base"), (F.col("p_size") * 2000).cast("long").alias("size"), (F.col("p_partkey") * 4096).alias("offset"), F.lit(4096).cast("long").alias("page_size"))
    return delta.locate(d.table(spark, sf_dir, "events").select((F.col("event_id") * 13577).alias("address")), regions)


@query("select 'orders to customer' as reference, count(*) as n from orders where o_custkey not in (select c_custkey from customer) union all select 'documents to labels', count(*) from documents where doc_id not in (select doc_id from labels) union all select 'backend', count(*) from orders where o_orderstatus not in ('episode', 'firecracker')")
def q26_reference_check(spark, sf_dir):
    t = lambda name: d.table(spark, sf_dir, name)
    found = {"orders to customer": quality.orphans(t("orders"), "o_custkey", t("customer"), "c_custkey"), "documents to labels": quality.orphans(t("documents"), "doc_id", t("labels"), "doc_id"), "backend": quality.outside(t("orders"), "o_orderstatus", schemas.BACKENDS)}
    out = [df.agg(F.lit(name).alias("reference"), F.count("*").alias("n")) for name, df in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def q27_key_check(spark, sf_dir):
    return quality.repeated_keys(d.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("with x as (select conv_id, turn as t, lag(turn) over (partition by conv_id order by turn) as before from conversations where role <> 'assistant') select conv_id, before as after, t - before - 1 as missing from x where t - before > 1")
def q28_gaps(spark, sf_dir):
    return quality.gaps(d.table(spark, sf_dir, "conversations").where("role <> 'assistant'"), "conv_id", "turn")


@query("with a as (select o_orderkey as k, o_orderstatus as s from orders where o_orderkey % 7 <> 0), b as (select o_orderkey as k, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as s from orders where o_orderkey % 11 <> 0) select k, case when b.s is null then 'only first' when a.s is null then 'only second' else 'differ' end as wrong from a full join b using (k) where a.s is distinct from b.s")
def q29_cross_layer(spark, sf_dir):
    rows = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    other = rows.where("k % 11 <> 0").withColumn("s", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s")))
    return quality.disagreements(rows.where("k % 7 <> 0"), other, ["k"], ["s"])


_CODES = "case event_type when 'click' then 'StateNotFound' when 'view' then 'ReplayDivergence' when 'signup' then 'VmmFailed' when 'purchase' then 'BranchFailed' end"


@query(f"select event_id, {_CODES} as code, case event_type when 'click' then 404 when 'view' then 409 when 'signup' then 503 when 'purchase' then 400 else 200 end as http from events")
def q30_error_status_map(spark, sf_dir):
    rows = d.table(spark, sf_dir, "events").select("event_id", F.expr(_CODES).alias("code"))
    return rows.withColumn("http", values.http_status(F.col("code")))


@query(f"with {d.TRAJECTORIES} select state_id, run_id, n, parent_state_id, from_span_id, t, steps, value, cursor, done, snapshot_uri from states")
def q31_states(spark, sf_dir):
    return lineage.states(d.trajectories(spark, sf_dir))


@query(f"with {d.TRAJECTORIES} select run_id, value from traj where action = 'submit' and status = 'ok'")
def q32_scores(spark, sf_dir):
    return fold.results(fold.fold(d.actions(spark, sf_dir), ["ts", "event_id"]))


@query(f"with {d.DISKS} select s.disk, s.n_blocks, s.n_blocks * 4096 as size, count(u.idx) as n_dirty, count(u.idx) * 4096 as dirty_bytes from sizes s left join upper u using (disk) group by all")
def q33_disk_headers(spark, sf_dir):
    return delta.headers(d.sizes(d.disk(spark, sf_dir, 1)), d.upper(spark, sf_dir))


@query(f"with {d.DISKS}, w as (select disk, 0::bigint as idx, md5('b' || disk) as data from sizes union all select disk, n_blocks, md5('c' || disk) from sizes) select * from w union all select * from upper where not exists (from w where w.disk = upper.disk and w.idx = upper.idx)")
def q34_point_writes(spark, sf_dir):
    rows = d.sizes(d.disk(spark, sf_dir, 1))
    each = [(F.lit(0).cast("long"), "a", 1), (F.lit(0).cast("long"), "b", 2), (F.col("n_blocks"), "c", 3)]
    writes = rows.select("disk", F.explode(F.array(*[F.struct(i.alias("idx"), F.unhex(F.md5(F.concat(F.lit(x), "disk"))).alias("data"), F.lit(s).alias("seq")) for i, x, s in each])).alias("w")).select("disk", "w.*")
    return delta.write_blocks(d.upper(spark, sf_dir), writes).select("disk", "idx", F.lower(F.hex("data")).alias("data"))


@query("select event_id, case when event_type = 'error' then 'error' when event_type = 'view' then 'error' when k % 3 = 0 then 'ok' else 'error' end as status, case when event_type = 'error' then 'UnknownAction' when event_type = 'view' then 'ActionRefused' when k % 3 > 0 then 'ExecFailed' end as error, case when event_type = 'error' then 'only exec is known' when event_type = 'view' then 'exec needs cmd' when k % 3 > 0 then 'exit ' || (k % 3) end as message, 0 as cost from (select *, (props->>'$.k')::int as k from events)")
def q35_recorded_commands(spark, sf_dir):
    rows = d.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "stop").otherwise("exec").alias("action"), F.when(F.col("event_type") != "view", "ls").alias("cmd"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("exit"))
    return fold.recorded_commands(rows).select("event_id", "status", "error", "message", "cost")


@query(_UPSERT_SQL)
def q36_stream_upsert(spark, sf_dir):
    """The writes of q05 as a stream of files, upserted batch by batch."""
    at = ordered.shared_path(spark, "stream")
    arrived = d.writes(spark, sf_dir).repartition(6)
    arrived.write.parquet(f"{at}/arrived")
    stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 3).parquet(f"{at}/arrived")
    keys = ["l_orderkey", "l_linenumber"]
    ingest.run_upserts(stream, f"{at}/table", f"{at}/checkpoint", keys, d.WRITE_ORDER, KEPT, CHANGED)
    return ingest.current(spark, f"{at}/table", keys, d.WRITE_ORDER, KEPT, CHANGED)


@query("select distinct conv_id::varchar || '-s0' as state_id, conv_id::varchar as run_id, 0::int as t, 'episode' as backend, 'snapshots/' || conv_id || '-s0' as snapshot_uri, conv_id::varchar || '-p0' as span_id, conv_id::varchar || '-box' as sandbox_id, 1::int as t_start from conversations")
def q37_start_runs(spark, sf_dir):
    run = F.col("conv_id").cast("string")
    asked = d.table(spark, sf_dir, "conversations").select(run.alias("run_id"), F.concat(run, F.lit("-box")).alias("sandbox_id"), F.lit("counter").alias("task_id"), F.lit(3).alias("seed"), F.lit(schemas.BACKENDS[0]).alias("backend"), F.lit(0.0).alias("created_at")).distinct()
    _, states, spans = lineage.start_runs(asked, F.create_map(F.lit("steps"), F.lit(float(fold.STEPS))))
    first = spans.select(F.col("from_state_id").alias("state_id"), "span_id", "sandbox_id", "t_start")
    return states.join(first, "state_id").select("state_id", "run_id", "t", "backend", "snapshot_uri", "span_id", "sandbox_id", "t_start")


@query(f"""with {d.TRAJECTORIES}, {_BOTH}, lim as (select span_id, t_start, coalesce(t_lo, t_start) as lo, coalesce(t_end + 1, t_start) as hi from spans),
wanted as (select state_id, run_id, t::bigint as restored_t, case when n % 2 = 0 then run_id || '-p' || n end as span_id, case when n % 4 = 0 then t + 4 end as asked from states),
ranged as (select w.*, t_start, lo, hi, coalesce(asked, hi) as stop, coalesce(asked, hi) between lo and hi as fits from wanted w left join lim using (span_id)),
ev as (select r.state_id, b.t as step, b.bad from ranged r join both_ b using (span_id) where b.t < stop and fits),
bad as (select state_id, min(case when bad then step end) as diverged_at from ev group by state_id),
good as (select state_id, count(*) as applied, max(step) as last_at from ev join bad using (state_id) where diverged_at is null or step < diverged_at group by state_id)
select r.state_id, span_id, run_id, restored_t, case when span_id is not null then stop end as stop_before_t, t_start as from_t,
  case when fits then coalesce(last_at, restored_t) end as last_t, case when fits then coalesce(applied, 0) end as events_applied, diverged_at,
  case when span_id is null then null when not fits then 'StopBeforeTOutOfRange' when diverged_at is not null then 'ReplayDivergence' end as error,
  case when span_id is null then restored_t when fits and diverged_at is null then coalesce(last_at, restored_t) end as t
from ranged r left join bad using (state_id) left join good using (state_id)
union all select 'lost', null, null, null, null, null, null, null, null, 'StateNotFound', null""")
def q38_restore_and_replay(spark, sf_dir):
    rows = ordered.stage(d.trajectories(spark, sf_dir), "events")
    states = ordered.stage(lineage.states(rows), "states")
    # Every other state is only restored; of the rest every other names a stop, which may be out of range. One state is unknown.
    wanted = states.select("state_id", F.when(F.col("n") % 2 == 0, lineage.span_id(F.col("run_id"), F.col("n"))).alias("span_id"), F.when(F.col("n") % 4 == 0, F.col("t") + 4).alias("stop_before_t"))
    lost = spark.range(1).select(F.lit("lost").alias("state_id"), F.lit(None).cast("string").alias("span_id"), F.lit(None).cast("long").alias("stop_before_t"))
    return lineage.restore_and_replay(states, lineage.spans(rows, states), d.tampered(rows), wanted.unionByName(lost))


@query("select conv_id, turn from conversations where turn % 5 = 0 and length(text) > 400")
def q39_cut_observations(spark, sf_dir):
    # Of every fifth turn only the summary was stored as the observation.
    short = js.summary_text(F.col("text"))
    rows = d.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 0, short).otherwise(F.col("text")).alias("observation"), short.alias("obs_summary"))
    return quality.cut_observations(rows).select("conv_id", "turn")


@query(f"with {d.TRAJECTORIES} select 'runs' as name, count(distinct run_id) as n from traj union all select 'states', count(*) from states union all select 'spans', count(*) from spans union all select 'span_index', count(*) from traj")
def q40_row_counts(spark, sf_dir):
    rows = ordered.stage(d.trajectories(spark, sf_dir), "events")
    return quality.row_counts({"runs": rows.select("run_id").distinct(), "states": lineage.states(rows), "spans": lineage.spans(rows), "span_index": events.span_index(d.recorded(rows))})


@query("select o_orderkey, '{\"steps\":' || o_orderkey || ',\"usd\":' || case when o_orderkey % 4 = 0 then (o_orderkey // 4)::varchar else (o_orderkey / 4)::varchar end || '}' as budget from orders")
def q41_budget_snapshot(spark, sf_dir):
    counters = F.create_map(F.lit("usd"), F.col("o_orderkey") / 4, F.lit("steps"), F.col("o_orderkey").cast("double"))
    return d.table(spark, sf_dir, "orders").select("o_orderkey", values.budget_snapshot(counters).alias("budget"))


@query("select doc_id, text || chr(65533) || '.' as output from documents")
def q42_decoded_output(spark, sf_dir):
    """Output with a byte that is no UTF-8."""
    return d.table(spark, sf_dir, "documents").select("doc_id", values.decoded(F.concat(F.col("text").cast("binary"), F.lit(b"\xff."))).alias("output"))


@query(f"with {d.TRAJECTORIES} select event_id, error, case error when 'EpisodeComplete' then 'this episode has already finished' when 'UnknownAction' then 'no action ''' || action || '''; available: inc, list_items, peek, sample, submit' when 'ActionRefused' then 'steps exhausted: ' || steps || ' left, 1 needed' end as message from traj")
def q43_error_messages(spark, sf_dir):
    rows = fold.fold(d.actions(spark, sf_dir), ["ts", "event_id"])
    return rows.select("event_id", "error", fold.messages(F.col("steps"), F.col("error"), F.col("action")).alias("message"))


@query(f"with {d.DISKS} select s.disk, 4096 as page_size, s.n_blocks * 4096 as len, s.n_blocks as n_pages, case when s.disk::bigint % 2 = 0 then count(u.idx) else s.n_blocks end as n_dirty from sizes s left join upper u using (disk) group by s.disk, s.n_blocks")
def q44_memory_headers(spark, sf_dir):
    images = d.sizes(d.disk(spark, sf_dir, 1)).withColumn("packed", F.col("disk").cast("long") % 2 == 0)
    return delta.memory_headers(images, d.upper(spark, sf_dir))


@query(f"with {d.TRAJECTORIES} select run_id, state_id as from_state_id, state_id as parent_state_id, i::int as index, case when n % 3 <> i then state_id || '-b' || i end as sandbox_id, (t + 1)::bigint as t_start, case when n % 3 = i then 'BranchFailed' end as error from (select *, unnest(range(3)) as i from states)")
def q45_partial_branches(spark, sf_dir):
    states = lineage.states(ordered.stage(d.trajectories(spark, sf_dir), "events"))
    return lineage.branch(states, 3, broken=F.col("n") % 3 == F.col("index"))


@query(f"""with recursive {d.TRAJECTORIES}, up(state_id, ancestor_id, distance) as (select state_id, parent_state_id, 1 from states where parent_state_id is not null
union all select up.state_id, s.parent_state_id, up.distance + 1 from up join states s on s.state_id = up.ancestor_id where s.parent_state_id is not null) select * from up""")
def x01_lineage(spark, sf_dir):
    """All ancestors of each state; a run takes at most as many states as it has steps."""
    return lineage.lineage(lineage.states(d.trajectories(spark, sf_dir)))


@query(f"with {d.TRAJECTORIES} select run_id, span_id, t::int as t, action, status, observation, {URI} as event_uri, steps::double as steps from traj")
def q46_event_batches(spark, sf_dir):
    """Whole events, stored and read again."""
    at = ordered.shared_path(spark, "events")
    objects.write_events(stored(spark, sf_dir), at)
    rows = objects.read_batches(spark, at)
    return rows.select("run_id", "span_id", "t", "action", "status", "observation", "event_uri", F.col("budget_remaining")["steps"].alias("steps"))


@query(f"with {d.TRAJECTORIES} select span_id, t::int as t, action, status, error, cost, observation from traj")
def q47_trajectory_file(spark, sf_dir):
    at = ordered.shared_path(spark, "trajectory")
    objects.write_trajectory(stored(spark, sf_dir), at)
    return objects.read_trajectory(spark, at).select("span_id", "t", "action", "status", "error", "cost", "observation")


@query(f"with {d.TRAJECTORIES} select state_id, run_id, t::int as t, case when n % 5 <> 4 then 'counter' end as task_id, case when n % 5 <> 4 then 3 end as seed, case when n % 5 <> 4 then 'episode' end as backend, case when n % 5 = 4 then 'StateNotFound' end as error from states")
def q48_snapshots(spark, sf_dir):
    """Metadata from the states' runs, stored and read again; of every fifth state a run has, it is lost."""
    at, states = ordered.shared_path(spark, "snapshots"), ordered.stage(lineage.states(d.trajectories(spark, sf_dir)), "states")
    runs = states.select("run_id", F.lit("counter").alias("task_id"), F.lit(fold.SEED).alias("seed"), F.lit(schemas.BACKENDS[0]).alias("backend")).distinct()
    objects.write_snapshots(lineage.metadata(states.where("n % 5 <> 4"), runs), at)
    found = objects.with_snapshots(states.select("state_id", "run_id", F.col("t").cast("int").alias("t")), objects.read_snapshot_batches(spark, at))
    return found.select("state_id", "run_id", "t", "snapshot.task_id", "snapshot.seed", "snapshot.backend", "error")


@query("select 'runs/' || conv_id || '/prompts/' || conv_id || '-s' || turn || '.json' as prompt_uri, text as prompt from conversations where text is not null")
def q49_prompts(spark, sf_dir):
    at, run = ordered.shared_path(spark, "prompts"), F.col("conv_id").cast("string")
    objects.write_prompts(d.table(spark, sf_dir, "conversations").select(run.alias("run_id"), F.concat(run, F.lit("-s"), F.col("turn").cast("string")).alias("state_id"), F.col("text").alias("prompt")), at)
    return objects.read_prompt_batches(spark, at)


def _round_trip(spark, sf_dir, kind):
    at = ordered.shared_path(spark, "images")
    images.write_packed(ordered.stage(d.upper(spark, sf_dir), "upper"), ordered.stage(d.sizes(d.disk(spark, sf_dir, 1)), "sizes"), at, 16, kind)
    return images.read_images(spark, at, kind=kind).select("disk", "block_size", "n_blocks", "idx", F.lower(F.hex("data")).alias("data"))


@query(f"with {d.DISKS} select disk, 16 as block_size, n_blocks, idx, data from upper join sizes using (disk)")
def q50_packed_disks(spark, sf_dir):
    return _round_trip(spark, sf_dir, packed.DISK)


@query(f"with {d.DISKS} select disk, 16 as block_size, n_blocks, idx, data from upper join sizes using (disk)")
def q51_packed_memory(spark, sf_dir):
    return _round_trip(spark, sf_dir, packed.MEMORY)


@query("with t as (select doc_id::varchar as disk, upper(hex(text)) as h, length(hex(text)) // 2 as n from documents) select disk, ((n + 4095) // 4096)::bigint as n_blocks, i::bigint as idx, md5(unhex(rpad(substr(h, (i * 8192 + 1)::int, 8192), 8192, '0'))) as data from (select *, unnest(range(((n + 4095) // 4096)::bigint)) as i from t)")
def q52_dense_images(spark, sf_dir):
    """Whole texts as dense images, cut into blocks that are filled up with zeros."""
    files = d.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return packed.unpack(files, dense_size=delta.BLOCK_SIZE).select("disk", "n_blocks", "idx", F.md5("data").alias("data"))


@query("select o_orderkey, o_custkey from orders where o_orderkey % 3 <> 1")
def q53_insert_only(spark, sf_dir):
    """New orders into those that are there."""
    rows = d.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return upsert.insert_only(rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 3 = 2"), "o_orderkey")


@query(f"with {d.DISKS} select disk, idx, data from working where idx % 3 <> 0")
def q54_diff_from_zeros(spark, sf_dir):
    """Every third page is empty and so not part of what changed."""
    pages = d.disk(spark, sf_dir, 1)
    pages = pages.withColumn("data", F.when(F.col("idx") % 3 == 0, delta.zero(16)).otherwise(F.col("data")))
    return delta.changed(pages, None, 16).select("disk", "idx", F.lower(F.hex("data")).alias("data"))


@query("with s as (select doc_id::varchar as disk, doc_id, case when doc_id % 3 > 0 then 'b' || doc_id % 10 end as base_id, case when doc_id % 4 > 0 then '/u' || doc_id % 7 end as base_uri from documents) select disk, case when doc_id % 3 > 0 and doc_id % 10 < 4 then '/u' || doc_id % 10 when doc_id % 4 > 0 and doc_id % 7 < 4 then '/u' || doc_id % 7 end as base, case when base is not null then 'upper' end as upper, case when base is null then 'StateNotFound' end as error from s")
def q55_reopen(spark, sf_dir):
    """Disks on the base that their header names: by id, else by place, else none is known."""
    doc = F.col("doc_id")
    stored_ = d.table(spark, sf_dir, "documents").select(doc.cast("string").alias("disk"), F.when(doc % 3 > 0, F.concat(F.lit("b"), (doc % 10).cast("string"))).alias("base_id"), F.when(doc % 4 > 0, F.concat(F.lit("/u"), (doc % 7).cast("string"))).alias("base_uri"), F.lit(None).cast("string").alias("upper"))
    bases = spark.range(4).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("base_id"), F.concat(F.lit("/u"), F.col("id").cast("string")).alias("uri"))
    return delta.reopen(stored_, bases)


@query("with c as (select conv_id, turn, text, length(text) as n from conversations) select conv_id, turn, case when turn % 2 = 1 then 'observation.list[1]._k' end as path, '{\"list\":[' || to_json(case when n > 400 then left(text, 400) || '...[' || n || ' chars]' else text end)::varchar || ',{\"' || case when turn % 2 = 1 then '_k' else 'k' end || '\":[0,1,2,3,4,\"...3 more\"]}]}' as summary from c")
def q56_json_walk(spark, sf_dir):
    """Nested observations: where a hidden key is, and their summary."""
    rows = d.table(spark, sf_dir, "conversations")
    key = F.when(F.col("turn") % 2 == 1, "_k").otherwise("k")
    seen = F.concat(F.lit('{"list": ['), values.json_string(F.col("text")), F.lit(', {"'), key, F.lit('": [0, 1, 2, 3, 4, 5, 6, 7]}]}'))
    return rows.select("conv_id", "turn", js.hidden_key_path(seen).alias("path"), js.summary_json(seen).alias("summary"))


@query("select event_id, case when k % 3 = 0 then k when k % 3 = 1 then 128 + k % 20 else 1 end as code from (select event_id, (props->>'$.k')::int as k from events)")
def q57_exit_codes(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return d.table(spark, sf_dir, "events").select("event_id", values.exit_code(k % 3 == 0, k, F.when(k % 3 == 1, k % 20)).cast("int").alias("code"))


_SCRIPTS = {0: ["inc", "peek", "inc", "sample"], 1: ["sample", "peek", "bogus", "inc"]}
_SCRIPT_SQL = ", ".join(f"({i}, {j}, '{a}')" for i, script in _SCRIPTS.items() for j, a in enumerate(script, 1))


@query(f"""with {d.TRAJECTORIES}, script(child, seq, action) as (values {_SCRIPT_SQL}),
moves as (select state_id || '-b' || child as sandbox_id, s.*, child, seq, action, action in ('inc', 'sample') as spends, sum((action in ('inc', 'sample'))::int) over w as asked from states s, script window w as (partition by state_id, child order by seq)),
weighed as (select *, case when action = 'bogus' then 'UnknownAction' when spends and asked > steps then 'ActionRefused' end as error from moves)
select sandbox_id, (t + seq)::bigint as t, action, error, (steps - least(steps, asked))::int as steps, (value + sum((error is null and action = 'inc')::int) over w)::bigint as value, (cursor + sum(case when error is null and action = 'sample' then 3 else 0 end) over w)::bigint as cursor
from weighed where not done window w as (partition by state_id, child order by seq)""")
def q58_branches_act(spark, sf_dir):
    """Two children of each open state, each of which acts on its own."""
    states = ordered.stage(lineage.states(d.trajectories(spark, sf_dir)), "states").where("not done")
    kids = lineage.branch(states, len(_SCRIPTS))
    script = F.array(*[F.struct(F.lit(i).alias("of"), F.lit(j).alias("seq"), F.lit(a).alias("action")) for i, script in _SCRIPTS.items() for j, a in enumerate(script, 1)])
    acts = kids.select("sandbox_id", "index", F.explode(script).alias("a")).where("index = a.of").select("sandbox_id", "a.seq", "a.action", F.lit(None).cast("int").alias("n"))
    out = lineage.go_on(kids, states, acts, ["seq"])
    return out.select(F.col("run_id").alias("sandbox_id"), "t", "action", "error", "steps", "value", "cursor")


@query(f"with {d.TRAJECTORIES}, latest as (select run_id, max(t) as t from states group by run_id) select traj.run_id, event_id, traj.t, action, status, error, cost, steps, value, observation from traj join latest using (run_id) where traj.t > latest.t")
def q59_continued_runs(spark, sf_dir):
    """Each run restored from its last state and gone on with: what comes out is what the whole run gave."""
    rows = ordered.stage(d.trajectories(spark, sf_dir), "events")
    latest = lineage.states(rows).groupBy("run_id").agg(*[F.max_by(c, "n").alias(c) for c in lineage.STATE])
    latest = ordered.stage(latest, "latest")
    later = rows.select("run_id", "event_id", "action", "n", F.col("t").alias("was")).join(latest.select("run_id", F.col("t").alias("since")), "run_id").where("was > since")
    return fold.fold(later, ["was"], start=latest).select("run_id", "event_id", "t", "action", "status", "error", "cost", "steps", "value", "observation")


@query("select l_orderkey as id, l_linenumber, case when o_orderkey is not null then o_custkey end as found, case when o_orderkey is null then 'StateNotFound' end as error from lineitem left join orders on o_orderkey = l_orderkey and o_orderstatus <> 'F'")
def q60_point_lookups(spark, sf_dir):
    """Rows by key; those that are not there have an error in place of a row."""
    orders = d.table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    wanted = d.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return events.found(wanted, "id", orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("found")), "StateNotFound")


def _stored_tables(spark, sf_dir):
    """The trajectories as stored, bucketed tables; gives the database's name."""
    rows = ordered.stage(d.trajectories(spark, sf_dir), "events")
    states = ordered.stage(lineage.states(rows), "states")
    whole = events.span_events(d.recorded(rows))
    at = ordered.shared_path(spark, "tables")
    name = at.rsplit("/", 1)[-1].replace("-", "_")
    tables.create_database(spark, name, at)
    for table, df in (("runs", states.select("run_id").distinct()), ("states", states), ("spans", lineage.spans(rows, states)), ("span_index", events.span_index(d.recorded(rows))), ("span_events", whole)):
        tables.save_table(df, name, table)
    return name


@query(f"with {d.TRAJECTORIES} select 'runs' as name, 16 as buckets, 'run_id' as keys, count(distinct run_id) as n from traj union all select 'states', 16, 'run_id', count(*) from states union all select 'spans', 16, 'span_id', count(*) from spans union all select 'span_index', 16, 'span_id', count(*) from traj union all select 'span_events', 16, 'span_id', count(*) from traj")
def q61_catalog(spark, sf_dir):
    """The stored tables that the catalog lists, with their layout and rows."""
    return tables.catalog(spark, _stored_tables(spark, sf_dir))


@query(f"with {d.TRAJECTORIES} select p.span_id, e.t::int as t, p.to_state_id, e.action, e.status, {URI.replace('run_id', 'e.run_id').replace('span_id', 'e.span_id').replace('t::', 'e.t::')} as event_uri from spans p join traj e on e.span_id = p.span_id where p.to_state_id is not null")
def q71_bucketed_join(spark, sf_dir):
    """The events of closed spans, from stored tables that share their bucketing: no row is shuffled."""
    db = _stored_tables(spark, sf_dir)
    closed = spark.table(f"{db}.spans").where("to_state_id is not null").select("span_id", "to_state_id")
    return closed.join(spark.table(f"{db}.span_index").hint("merge"), "span_id").select("span_id", "t", "to_state_id", "action", "status", "event_uri")


_SUBMITTED = "case when action = 'submit' and error is null then '{\"ok\":true,\"value\":' || value || ',\"submission\":null}' else observation end"


@query(f"with {d.TRAJECTORIES} select run_id, t::int as t, action, status, error, cost, {_SUBMITTED} as observation from traj")
def q62_episodes(spark, sf_dir):
    """The events as a stream of actions through the episode loop, state kept by run."""
    at = ordered.shared_path(spark, "episodes")
    acts = d.actions(spark, sf_dir)
    acts.select("run_id", F.struct("ts", "event_id").alias("seq"), "action", F.to_json(F.struct("n")).alias("params")).write.parquet(f"{at}/arrived")
    stream = spark.readStream.schema("run_id string, seq struct<ts: timestamp_ntz, event_id: long>, action string, params string").parquet(f"{at}/arrived")
    flat = stream.select("run_id", F.concat(F.date_format("seq.ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("seq.event_id").cast("string"), 20, "0")).alias("seq"), "action", "params")
    tasks = loop.counter_tasks([f"id_{fold.SEED:02d}_{i:04d}" for i in range(fold.ITEMS)])
    out = episodes.episodes(flat, tasks, {"budget": {"steps": fold.STEPS}, "value": 0, "cursor": 0})
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(episodes.OUT).parquet(f"{at}/out")


@query(f"with {d.TRAJECTORIES} select span_id, run_id, from_state_id, t_start, 0.0::double as created_at, to_state_id, case when to_state_id is not null then t_end end as t_end, case when to_state_id is not null then 'closed' else 'open' end as sandbox_id from spans")
def q63_span_upserts(spark, sf_dir):
    """Spans as they are written: once when they open, and again, with other first columns, when they end."""
    found = ordered.stage(lineage.spans(ordered.stage(d.trajectories(spark, sf_dir), "events")), "spans")
    none = {"to_state_id": F.lit(None).cast("string"), "t_end": F.lit(None).cast("long")}
    opened = found.withColumns({**none, "sandbox_id": F.lit("open"), "created_at": F.lit(0.0), "seq": F.lit(1)})
    ended = found.where("to_state_id is not null").withColumns({"from_state_id": F.lit("late"), "t_start": F.lit(-1).cast("long"), "sandbox_id": F.lit("closed"), "created_at": F.lit(1.0), "seq": F.lit(2)})
    keys, first, last = upsert.SPANS_RULE
    return upsert.partial_upsert(ended.unionByName(opened), keys, ["seq"], first, last)


@query(f"with {d.TRAJECTORIES} select span_id, t::int as t, {URI} as event_uri, action, case when action = 'peek' then 'error' else status end as status from traj")
def q64_span_index(spark, sf_dir):
    """The index of events by span, where all peeks are written again: the last write counts."""
    rows = events.span_index(stored(spark, sf_dir)).withColumn("seq", F.lit(1))
    again = rows.where("action = 'peek'").withColumns({"status": F.lit("error"), "seq": F.lit(2)})
    keys, first, last = upsert.SPAN_INDEX_RULE
    return upsert.partial_upsert(rows.unionByName(again), keys, ["seq"], first, last)


_METERED = """metered as (select run_id, event_id, t, coalesce(k, 0) as k, case action when 'inc' then 'add' when 'peek' then 'look' when 'sample' then 'rest' else action end as action from numbered),
walk as (
  select run_id, 0::bigint as t, null::bigint as event_id, null::varchar as action, null::varchar as status, null::varchar as error, 0 as cost, 20.0::double as steps, 60.5::double as tokens, 0::bigint as value, false as done from metered group by run_id
  union all
  select run_id, t, event_id, action, case when error is null then 'ok' else 'error' end, error, case when error = 'EpisodeComplete' then 0 when error = 'UnknownAction' then 1 when action = 'add' then 2 when action = 'rest' then 1 else 0 end,
    steps - case when error in ('EpisodeComplete', 'UnknownAction') then 0 when action = 'add' and steps >= 1.5 then 1.5 when action = 'rest' and steps >= 0.5 then 0.5 else 0 end,
    tokens - case when error is not null then 0 when action = 'add' then k * 0.25 when action = 'look' then 0.25 else 0 end, value + case when error is null and action = 'add' then k else 0 end, done or (error is null and action = 'submit')
  from (select m.run_id, m.t, m.event_id, m.action, m.k, w.steps, w.tokens, w.value, w.done,
      case when w.done then 'EpisodeComplete' when m.action not in ('add', 'look', 'rest', 'submit') then 'UnknownAction' when m.action = 'add' and (w.steps < 1.5 or w.tokens < m.k * 0.25) or m.action = 'look' and w.tokens < 0.25 or m.action = 'rest' and w.steps < 0.5 then 'ActionRefused' end as error
    from walk w join metered m on m.run_id = w.run_id and m.t = w.t + 1))"""
_METERS = {"inc": "add", "peek": "look", "sample": "rest"}


@query(f"with recursive {d.TRAJECTORIES}, {_METERED} select run_id, event_id, t, action, status, error, cost, steps, tokens, case when error is null then case action when 'rest' then '{{}}' when 'submit' then '{{\"ok\":' || (value > 0) || ',\"value\":' || value || '}}' else '{{\"value\":' || value || '}}' end end as observation from walk where t > 0")
def q65_metered_episodes(spark, sf_dir):
    """A task of two counters at fractional costs, over all events."""
    rows = d.actions(spark, sf_dir)
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in _METERS.items() for x in pair])[F.col("action")], F.col("action"))
    rows = rows.select("run_id", "event_id", "ts", named.alias("action"), F.to_json(F.struct("k")).alias("params"))
    out = loop.play(rows, ["ts", "event_id"], loop.metered_tasks(), {"budget": {"steps": 20, "tokens": 60.5}, "value": 0})
    return out.select("run_id", "event_id", "t", "action", "status", "error", "cost", F.col("budget")["steps"].alias("steps"), F.col("budget")["tokens"].alias("tokens"), "observation")


@query(f"""with {d.TRAJECTORIES}, {_BOTH},
sought as (select state_id, run_id, n, state_id || '-r' as sandbox_id, run_id || '-p' || n as span_id, case when n % 4 = 0 then t + 4 end as stop, t as since from states where n % 2 = 0),
reaching as (select a.*, coalesce(a.stop, p.t_end + 1, p.t_start) as upto, coalesce(a.stop, p.t_end + 1, p.t_start) between coalesce(p.t_lo, p.t_start) and coalesce(p.t_end + 1, p.t_start) as fits from sought a join spans p using (span_id)),
due as (select r.sandbox_id, r.since, b.*, min(case when bad then b.t end) over (partition by r.sandbox_id) as first_bad from reaching r join both_ b using (span_id) where fits and b.t < upto)
select e.run_id, d.sandbox_id || '-p' as span_id, d.sandbox_id, e.t::bigint as t, case when e.k = 17 and e.status = 'ok' and e.action = 'inc' then 'peek' else e.action end as action, e.status, {_ANEW} as observation, e.span_id as replayed_span_id, not bad as same
from due d join traj e using (span_id, t) where first_bad is null or t <= first_bad""")
def q66_replay_records(spark, sf_dir):
    """What sandboxes restored from every other state record while they replay the span that it opened, up to and with the first event that comes out differently."""
    rows = ordered.stage(d.trajectories(spark, sf_dir), "events")
    states = ordered.stage(lineage.states(rows), "states")
    wanted = states.where("n % 2 = 0").select(F.concat("state_id", F.lit("-r")).alias("sandbox_id"), "state_id", lineage.span_id(F.col("run_id"), F.col("n")).alias("span_id"), F.when(F.col("n") % 4 == 0, F.col("t") + 4).alias("stop_before_t"))
    _, recorded = lineage.replay_and_record(states, lineage.spans(rows, states), d.tampered(rows), wanted)
    return recorded.select("run_id", "span_id", "sandbox_id", "t", "action", "status", "observation", "replayed_span_id", "same")


@query(f"with {d.TRAJECTORIES}, wanted as (select case when n % 3 = 2 then 'lost-' || state_id else state_id end as state_id, state_id || '-box' as sandbox_id from states) select s.run_id, w.state_id, w.sandbox_id, case when s.run_id is not null then w.sandbox_id || '-p' end as span_id, s.state_id as from_state_id, s.t + 1 as t_start, s.snapshot_uri, case when s.n % 2 = 0 then 'go on from ' || s.value end as prompt, case when s.run_id is null then 'StateNotFound' end as error from wanted w left join states s using (state_id)")
def q67_restore(spark, sf_dir):
    """A sandbox for each state, with the prompt of every other; every third asks for a state that is not there."""
    states = ordered.stage(lineage.states(d.trajectories(spark, sf_dir)), "states")
    prompts = states.where("n % 2 = 0").select("state_id", F.concat(F.lit("go on from "), F.col("value").cast("string")).alias("prompt"))
    wanted = states.select(F.when(F.col("n") % 3 == 2, F.concat(F.lit("lost-"), F.col("state_id"))).otherwise(F.col("state_id")).alias("state_id"), F.concat("state_id", F.lit("-box")).alias("sandbox_id"))
    return lineage.restore(states, prompts, wanted)


@query(f"with {d.DISKS}, placed as (select disk, idx, idx - row_number() over (partition by disk order by idx) as run from upper) select disk, min(idx) as idx, count(*) as n from placed group by disk, run")
def q68_dirty_runs(spark, sf_dir):
    """Which blocks of each disk differ from its base, as runs of neighbours."""
    return delta.dirty_runs(d.upper(spark, sf_dir))


@query(f"with {d.DISKS} select disk, n_blocks, n_blocks * 16 as len, (select count(*) from upper u where u.disk = sizes.disk) as n_dirty from sizes")
def q69_written_images(spark, sf_dir):
    """What is told of the memory images that were written."""
    upper, sizes = ordered.stage(d.upper(spark, sf_dir), "upper"), ordered.stage(d.sizes(d.disk(spark, sf_dir, 1)), "sizes")
    return images.write_packed(upper, sizes, ordered.shared_path(spark, "images"), 16, images.MEMORY)


@query(f"with {d.DISKS}, every as (select disk, n_blocks, unnest(range(n_blocks)) as idx from sizes) select disk, n_blocks, idx, coalesce(u.data, b.data, repeat('0', 32)) as data from every left join upper u using (disk, idx) left join base b using (disk, idx)")
def q70_dense_files(spark, sf_dir):
    """Each disk written as a dense image over its base, and read back from the file."""
    at = ordered.shared_path(spark, "dense")
    images.write_dense(ordered.stage(d.upper(spark, sf_dir), "upper"), ordered.stage(d.sizes(d.disk(spark, sf_dir, 1)), "sizes"), at, 16, ordered.stage(d.disk(spark, sf_dir, 0), "base"))
    return images.read_images(spark, at, dense_size=16).select("disk", "n_blocks", "idx", F.lower(F.hex("data")).alias("data"))


_LAYERS = """texts as (select doc_id, i as idx, md5(substring(text, (i * 256 + 1)::int, 256)) as data from (select doc_id, text, unnest(range(((length(text) + 255) // 256)::bigint)) as i from documents)),
layers as (select doc_id, 'd' || doc_id as layer, case when doc_id % 6 > 0 then 'd' || (doc_id - 1) end as parent from documents),
held as (select doc_id, idx, data from texts where (idx + doc_id) % 3 = 0),
reach as (select l.doc_id, h.doc_id as source, h.idx, h.data, row_number() over (partition by l.doc_id, h.idx order by h.doc_id desc) as nth from layers l join held h on h.doc_id // 6 = l.doc_id // 6 and h.doc_id <= l.doc_id),
near as (select * from reach where nth = 1)"""


def _layers(spark, sf_dir):
    """Documents as layers in chains of six, each of which holds every third block of its text."""
    docs = d.table(spark, sf_dir, "documents")
    name = lambda i: F.concat(F.lit("d"), i.cast("string"))
    n = F.floor((F.length("text") + d.BLOCK_CHARS - 1) / d.BLOCK_CHARS)
    each = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("idx"))
    held = each.where((F.col("idx") + F.col("doc_id")) % 3 == 0).select(name(F.col("doc_id")).alias("layer"), "idx", F.unhex(F.md5(F.substring("text", (F.col("idx") * d.BLOCK_CHARS + 1).cast("int"), F.lit(d.BLOCK_CHARS)))).alias("data"))
    chain = docs.select(name(F.col("doc_id")).alias("layer"), F.when(F.col("doc_id") % 6 > 0, name(F.col("doc_id") - 1)).alias("parent"))
    return chain, ordered.stage(held, "layer-blocks"), each.select(name(F.col("doc_id")).alias("layer"), "idx")


@query(f"with {_LAYERS} select 'd' || t.doc_id as layer, t.idx, coalesce(n.data, repeat('0', 32)) as data, 'd' || n.source as source from texts t left join near n on n.doc_id = t.doc_id and n.idx = t.idx")
def q72_layered_reads(spark, sf_dir):
    """Every block of every document through its chain of layers."""
    chain, held, wanted = _layers(spark, sf_dir)
    return layers.read_layers(chain, held, wanted, 16).select("layer", "idx", F.lower(F.hex("data")).alias("data"), "source")


@query(f"with {_LAYERS}, own as (select doc_id, count(*) as n from held group by 1), whole as (select doc_id, count(*) as n, sum((source <> doc_id)::int) as s from near group by 1) select layer, coalesce(own.n, 0) * 16 as own_bytes, coalesce(whole.n, 0) * 16 as full_bytes, (coalesce(whole.s, 0) * 16)::bigint as shared_bytes from layers left join own using (doc_id) left join whole using (doc_id)")
def q73_layer_sizes(spark, sf_dir):
    """What each layer stores, and what its image holds by reference."""
    chain, held, _ = _layers(spark, sf_dir)
    return layers.layer_sizes(chain, held, 16)


@query("with asked as (select 'd' || doc_id as parent, doc_id, unnest(range(3)) as i from documents), kids as (select case when i = 2 and doc_id % 5 = 0 then parent else parent || '-c' || i end as layer, case when i = 1 and doc_id % 4 = 0 then 'lost' else parent end as parent from asked) select layer, parent, case when layer = parent then 'LayerExists' when parent = 'lost' then 'StateNotFound' when layer like '%0-c0' then 'BranchFailed' end as error from kids where layer = parent or parent = 'lost' or layer like '%0-c0'")
def q74_fork_failures(spark, sf_dir):
    """Three children of each layer; some take a name that is there, some have no parent, some cannot be made: each has its error, and the others are made."""
    docs = d.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("layer"), "doc_id")
    kids = docs.select(F.col("layer").alias("of"), "doc_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
    named = F.when((F.col("i") == 2) & (F.col("doc_id") % 5 == 0), F.col("of")).otherwise(F.concat("of", F.lit("-c"), F.col("i").cast("string")))
    kids = kids.select(named.alias("layer"), F.when((F.col("i") == 1) & (F.col("doc_id") % 4 == 0), "lost").otherwise(F.col("of")).alias("parent"))
    _, failures = layers.fork_layers(docs.select("layer", F.lit(None).cast("string").alias("parent")), kids, F.col("layer").like("%0-c0"))
    return failures


@query("with regions as (select p_partkey::int as region, case p_partkey % 50 when 0 then 0 else p_partkey * 70000 % 1000003 end as base, case p_partkey % 50 when 0 then 1125899906842624 when 1 then 1 else p_size * 20000 end as size, p_partkey * 4096 as off from part), asked as (select distinct event_id * 13577 % 2000003 * case when event_id % 9 = 0 then 1000003 else 1 end as address from events) select address, region, page::bigint as page from (select address, region, (off + (address // 4096) * 4096 - base) // 4096 as page from asked left join regions on address >= base and address < base + size qualify row_number() over (partition by address order by region) = 1)")
def q75_nested_regions(spark, sf_dir):
    """Addresses among regions of one byte to 2**50, which overlap and nest: the first that holds each."""
    p = F.col("p_partkey")
    base, size = F.when(p % 50 == 0, 0).otherwise(p * 70000 % 1000003), F.when(p % 50 == 0, 1 << 50).when(p % 50 == 1, 1).otherwise(F.col("p_size") * 20000)
    regions = d.table(spark, sf_dir, "part").select(p.cast("int").alias("region"), base.cast("long").alias("base"), size.cast("long").alias("size"), (p * 4096).alias("offset"), F.lit(4096).cast("long").alias("page_size"))
    e = F.col("event_id")
    asked = d.table(spark, sf_dir, "events").select((e * 13577 % 2000003 * F.when(e % 9 == 0, 1000003).otherwise(1)).alias("address")).distinct()
    return delta.locate(asked, regions)


_PRICES = "prices as (select l_orderkey, l_linenumber, l_extendedprice / (l_partkey + 1)::double as price, (l_suppkey % 7 - 3) * l_extendedprice * l_extendedprice / 16 + 0.00005 as sum_ from lineitem)"


@query(f"with {_PRICES} select l_orderkey, l_linenumber, case when price = floor(price) then price::bigint::varchar else regexp_replace(printf('%.4f', price), '([.][0-9]+?)0+$', '\\1') end as rounded, printf('%g', price) as general, printf('%g', sum_) as general_sum from prices")
def q76_exact_decimals(spark, sf_dir):
    """Doubles to four places and to six digits, rounded by their exact values."""
    rows = d.table(spark, sf_dir, "lineitem")
    price, total = F.col("l_extendedprice") / (F.col("l_partkey") + 1).cast("double"), (F.col("l_suppkey") % 7 - 3) * F.col("l_extendedprice") * F.col("l_extendedprice") / 16 + 0.00005
    text = F.when(price == F.rint(price), price.cast("long").cast("string")).otherwise(values.rounded(price))
    return rows.select("l_orderkey", "l_linenumber", text.alias("rounded"), values.general(price).alias("general"), values.general(total).alias("general_sum"))


@query(f"select 1 as version, * from ({_UPSERT_SQL.replace(') group by all', ') where l_partkey % 3 = 0 group by all')}) union all select 3, * from ({_UPSERT_SQL})")
def q77_versioned_upserts(spark, sf_dir):
    """The writes of q05 in three batches: the table as its first version has it, and as the third."""
    writes, keys = ordered.stage(d.writes(spark, sf_dir), "writes"), ["l_orderkey", "l_linenumber"]
    at = ordered.shared_path(spark, "versions")
    for k in range(3):
        versions.upsert_version(writes.where(F.col("l_partkey") % 3 == k), at, keys, d.WRITE_ORDER)
    one, three = (versions.read_version(spark, at, keys, d.WRITE_ORDER, KEPT, CHANGED, v).select(F.lit(v).alias("version"), *keys, *KEPT, *CHANGED) for v in (1, 3))
    return one.unionByName(three)


@query(f"with {d.DISKS}, every as (select disk, unnest(range(n_blocks)) as idx from sizes) select disk, idx, coalesce(u.data, repeat('0', 32)) as data, case when u.data is null then 'zero' else 'upper' end as layer from every left join upper u using (disk, idx)")
def q78_sparse_pages(spark, sf_dir):
    """The pages that changed as whole memory images, without a base: what is not there is zero."""
    pages = delta.whole(d.sizes(d.disk(spark, sf_dir, 1)), d.upper(spark, sf_dir), size=16)
    return pages.select("disk", "idx", F.lower(F.hex("data")).alias("data"), "layer")


@query(f"with {d.TRAJECTORIES}, latest as (select run_id, max(t) as t from states group by run_id) select traj.run_id, event_id, traj.t, action, status, error, cost, steps::double as steps, observation from traj join latest using (run_id) where traj.t > latest.t")
def q79_restored_stream(spark, sf_dir):
    """Each run restored from its last state and gone on with as a stream of three batches: what comes out is what the whole run gave."""
    rows = ordered.stage(d.trajectories(spark, sf_dir), "events")
    latest = ordered.stage(lineage.states(rows).groupBy("run_id").agg(*[F.max_by(c, "n").alias(c) for c in lineage.STATE]), "latest")
    state = F.to_json(F.struct("t", F.struct("steps").alias("budget"), "value", "cursor", "done"))
    later = rows.select("run_id", "event_id", "action", F.to_json(F.struct("n")).alias("params"), F.col("t").alias("was")).join(latest.select("run_id", F.col("t").alias("since")), "run_id").where("was > since")
    later = ordered.stage(later, "later")
    at = ordered.shared_path(spark, "restored")
    tasks = loop.counter_tasks([f"id_{fold.SEED:02d}_{i:04d}" for i in range(fold.ITEMS)])
    begun = latest.select("run_id", state.alias("state"))
    for third in range(3):
        # What arrives is taken before more does, so that a run's events come in order.
        later.where(F.least(F.floor((F.col("was") - F.col("since") - 1) / 4), F.lit(2)) == third).write.mode("append").parquet(f"{at}/arrived")
        stream = spark.readStream.schema(later.schema).parquet(f"{at}/arrived")
        episodes.run_batches(stream, ["was"], f"{at}/out", f"{at}/checkpoint", tasks, {"budget": {"steps": fold.STEPS}, "value": 0, "cursor": 0}, begun)
    out = spark.read.parquet(f"{at}/out/rows")
    return out.select("run_id", "event_id", "t", "action", "status", "error", "cost", F.col("budget")["steps"].alias("steps"), "observation")
