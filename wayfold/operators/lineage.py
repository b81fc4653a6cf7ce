"""States and spans: commits, restore points, replays that are verified, branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import json_equal
from ..functions.values import snapshot_uri
from ..schemas import PROTOCOL
from .errors import WayfoldError
from .fold import SEED, STEPS, fold
from .ordered import by_size, stage

MOST_BRANCHES = 100
#: What a fold goes on from.
STATE = ("t", "steps", "value", "cursor", "done")


def state_id(run_id: Column, n: Column) -> Column:
    return F.concat(run_id, F.lit("-s"), n.cast("string"))


def span_id(run_id: Column, n: Column) -> Column:
    return F.concat(run_id, F.lit("-p"), n.cast("string"))


def start_runs(requests: DataFrame, budget: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows for the tables of runs, states and spans that new runs begin with.

    ``requests`` has (run_id, sandbox_id, task_id, seed, backend, created_at). Each run gets its root state, at
    t = 0 with the task's ``budget`` and without a parent, and a first span, open and from t = 1 on.
    """
    root, none = state_id(F.col("run_id"), F.lit(0)), F.lit(None).cast("string")
    budget = F.lit(None).cast("map<string,double>") if budget is None else budget
    runs = requests.select("run_id", "task_id", "seed", "backend", "created_at")
    roots = requests.select(root.alias("state_id"), "run_id", none.alias("parent_state_id"), none.alias("from_span_id"), F.lit(0).alias("t"), "backend", snapshot_uri(root).alias("snapshot_uri"), none.alias("prompt_uri"), budget.alias("budget"), "created_at")
    first = requests.select(span_id(F.col("run_id"), F.lit(0)).alias("span_id"), "run_id", root.alias("from_state_id"), none.alias("to_state_id"), "sandbox_id", F.lit(1).alias("t_start"), F.lit(None).cast("int").alias("t_end"), "created_at")
    return runs, roots, first


def in_spans(folded: DataFrame, commit: Column | None = None) -> DataFrame:
    """Rows of ``fold`` with their span's number and id; ``commit`` says how many states are taken after an event.

    Without it ``folded`` has counted the commits already. The first state taken after an event ends its span;
    each further one finds an empty span, which stays open for good.
    """
    rows = folded if commit is None else by_size(folded.withColumn("commits_here", F.coalesce(commit.cast("int"), F.lit(0))), ["run_id"], ["t"], lambda some, add: add(some, {"commits": F.col("commits_here")}))
    return rows.withColumn("span_no", F.col("commits") - F.col("commits_here")).withColumn("span_id", span_id(F.col("run_id"), F.col("span_no")))


def states(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The state after each commit, with all that a fold can go on from; number 0 is the run's root, at t = 0.

    Each names its parent, the state before it, and the span that it ends: none for the root and for a commit
    without an event since the last. Every state opens the span of its number.
    """
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("commits_here").cast("long"))).alias("nth")
    commits = rows.where("commits_here > 0").select("*", nth).select("run_id", (F.col("span_no") + F.col("nth")).alias("n"), (F.col("nth") == 1).alias("ends"), "t", "steps", "value", "cursor", "done")
    zero = F.lit(0).cast("long")
    roots = rows.select("run_id").distinct().select("run_id", zero.alias("n"), F.lit(False).alias("ends"), zero.alias("t"), F.lit(steps).alias("steps"), zero.alias("value"), zero.alias("cursor"), F.lit(False).alias("done"))
    me, last = state_id(F.col("run_id"), F.col("n")), F.col("n") - 1
    return roots.unionByName(commits).select(
        me.alias("state_id"), "run_id", "n", F.when(F.col("n") > 0, state_id(F.col("run_id"), last)).alias("parent_state_id"), F.when(F.col("ends"), span_id(F.col("run_id"), last)).alias("from_span_id"),
        "t", "steps", "value", "cursor", "done", snapshot_uri(me).alias("snapshot_uri"),
    )


def spans(rows: DataFrame, states_: DataFrame | None = None) -> DataFrame:
    """A row for each span, empty ones included: every state opens one, one past its t. Open spans have no end state,
    spans without events no ``t_lo`` and ``t_end`` (their first and last event)."""
    states_ = states(rows) if states_ is None else states_
    each = rows.groupBy("run_id", F.col("span_no").alias("n")).agg(F.min("t").alias("t_lo"), F.max("t").alias("t_end"), F.count("*").alias("n_events"), (F.max("commits_here") > 0).alias("closed"))
    both = states_.select("state_id", "run_id", "n", (F.col("t") + 1).alias("t_start")).join(each.withColumnRenamed("run_id", "of_run"), F.col("run_id").eqNullSafe(F.col("of_run")) & (states_["n"] == each["n"]), "left").drop(each["n"])
    return both.select(span_id(F.col("run_id"), F.col("n")).alias("span_id"), "run_id", F.col("state_id").alias("from_state_id"), F.when(F.col("closed"), state_id(F.col("run_id"), F.col("n") + 1)).alias("to_state_id"), "t_start", "t_lo", "t_end", F.coalesce("n_events", F.lit(0).cast("long")).alias("n_events"))


def restore_points(rows: DataFrame, at: Column) -> DataFrame:
    """For the events for which ``at`` holds, the latest state before them: its id and t."""
    wanted = rows.where(at).select("run_id", F.col("t").alias("event_t"), F.col("span_no").alias("n"))
    return wanted.join(states(rows).select("run_id", "n", "state_id", F.col("t").alias("state_t")), ["run_id", "n"]).select("run_id", "event_t", "state_id", "state_t")


def bounds(spans_: DataFrame) -> DataFrame:
    """(span_id, t_lo, t_hi): where a replay of each span may stop; of an empty one at its start alone."""
    return spans_.select("span_id", F.coalesce("t_lo", "t_start").alias("t_lo"), F.coalesce(F.col("t_end") + 1, F.col("t_start")).alias("t_hi"))


def check_stop(span_bounds: DataFrame, span: str, stop_before_t: int) -> None:
    """Raise if there is no such span, or a replay of it cannot stop there."""
    found = span_bounds.where(F.col("span_id") == span).take(1)
    if not found:
        raise WayfoldError("SpanNotFound", f"no span {span}")
    lo, hi = found[0]["t_lo"], found[0]["t_hi"]
    if not lo <= stop_before_t <= hi:
        raise WayfoldError("StopBeforeTOutOfRange", f"stop_before_t={stop_before_t} not in [{lo}, {hi}]", stop_before_t=stop_before_t, t_lo=lo, t_hi=hi)


def same_value(a: Column, b: Column) -> Column:
    """Whether two observations hold one JSON value, however they are written; what is no JSON is compared as text."""
    return F.when(a.eqNullSafe(b), True).otherwise(F.coalesce(json_equal(a, b), F.lit(False)))


def _done_again(asked: DataFrame, recorded: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(report, events) for ``asked`` (key, span_id, stop_before_t, t, steps, value, cursor, done): what was recorded (span_id,
    t, action, n, status, observation) is done again, from the state given, and compared by status and value of observation.

    The report has (key, applied, last_t, diverged_at) of each key with events to replay; the events, staged, are rows of ``fold``
    with ``key``, ``r_t`` (the recorded t), ``r_status``, ``r_observation`` and ``same``, up to and with the diverging one.
    """
    events = recorded.select("span_id", F.col("t").alias("r_t"), "action", "n", F.col("status").alias("r_status"), F.col("observation").alias("r_observation"))
    due = asked.select("key", "span_id", "stop_before_t").join(events, "span_id").where(F.col("stop_before_t").isNull() | (F.col("r_t") < F.col("stop_before_t")))
    start = asked.select(F.col("key").alias("run_id"), "t", "steps", "value", "cursor", "done")
    anew = fold(due.withColumnRenamed("key", "run_id"), ["r_t"], seed=seed, start=start)
    same = F.col("status").eqNullSafe(F.col("r_status")) & same_value(F.col("observation"), F.col("r_observation"))
    anew = stage(anew.withColumnRenamed("run_id", "key").withColumn("same", same), "replayed")
    first_bad = anew.groupBy("key").agg(F.min(F.when(~F.col("same"), F.col("r_t"))).alias("diverged_at"))
    upto = anew.join(first_bad, "key").where(F.col("diverged_at").isNull() | (F.col("r_t") <= F.col("diverged_at")))
    report = upto.groupBy("key").agg(F.sum(F.col("same").cast("long")).alias("applied"), F.max(F.when(F.col("same"), F.col("r_t"))).alias("last_t"), F.first("diverged_at").alias("diverged_at"))
    return report, upto.drop("diverged_at")


def replay(recorded: DataFrame, spans_: DataFrame, states_: DataFrame, stop_before_t: Column | None = None, seed: int = SEED) -> DataFrame:
    """(span_id, from_t, last_t, events_applied, diverged_at) of each span, done again from the state it starts at.

    The recorded actions are folded anew; where status or observation come out differently the replay ends and
    ``diverged_at`` says so. ``from_t`` is the span's start, ``last_t`` the last event applied, else the state's t.
    Events from ``stop_before_t`` on, over the span's columns, are not replayed; a null stop replays all.
    """
    stop = F.lit(None).cast("long") if stop_before_t is None else stop_before_t.cast("long")
    of = states_.select(F.col("state_id").alias("from_state_id"), *STATE)
    asked = stage(spans_.select("span_id", "from_state_id", "t_start", stop.alias("stop_before_t")).join(of, "from_state_id").withColumn("key", F.col("span_id")), "replays")
    done, _ = _done_again(asked, recorded, seed)
    return asked.join(done, "key", "left").select("span_id", F.col("t_start").alias("from_t"), F.coalesce("last_t", "t").alias("last_t"), F.coalesce("applied", F.lit(0)).alias("events_applied"), "diverged_at")


def branch(states_: DataFrame, n: int, dirty: Column | None = None, broken: Column | None = None) -> DataFrame:
    """``n`` children of each state: (run_id, from_state_id, parent_state_id, index, sandbox_id, t_start).

    They share the run and the state; a dirty parent names no parent state. Nothing is copied. With ``broken``
    (over the state and ``index``) a child for which it holds has an ``error`` and no sandbox; the others go on.
    """
    if not 1 <= n <= MOST_BRANCHES:
        raise WayfoldError("BranchFailed", f"n must be 1..{MOST_BRANCHES}, got {n}")
    dirty = F.lit(False) if dirty is None else dirty
    failed = F.lit(False) if broken is None else F.coalesce(broken, F.lit(False))
    each = states_.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("index"))
    error = [] if broken is None else [F.when(failed, "BranchFailed").alias("error")]
    box = F.when(~failed, F.concat("state_id", F.lit("-b"), F.col("index").cast("string")))
    return each.select("run_id", F.col("state_id").alias("from_state_id"), F.when(~dirty, F.col("state_id")).alias("parent_state_id"), "index", box.alias("sandbox_id"), (F.col("t") + 1).alias("t_start"), *error)


def restore(states_: DataFrame, prompts: DataFrame, wanted: DataFrame) -> DataFrame:
    """A new span for each (state_id, sandbox_id) of ``wanted``, with the state's prompt: siblings of what was
    recorded, which stays as it is. An unknown state gives a row with the error StateNotFound and no span."""
    of = states_.select("state_id", "run_id", "t", "snapshot_uri")
    found = wanted.select("state_id", "sandbox_id").join(of, "state_id", "left").join(prompts.select("state_id", "prompt"), "state_id", "left")
    known = F.col("run_id").isNotNull()
    return found.select("run_id", "state_id", "sandbox_id", F.when(known, sibling_span(F.col("sandbox_id"))).alias("span_id"), F.when(known, F.col("state_id")).alias("from_state_id"), (F.col("t") + 1).alias("t_start"), "snapshot_uri", "prompt", F.when(~known, "StateNotFound").alias("error"))


def sibling_span(sandbox_id: Column) -> Column:
    """The span that a restored sandbox writes to: its own, beside the recorded ones."""
    return F.concat(sandbox_id, F.lit("-p"))


def metadata(states_: DataFrame, runs: DataFrame) -> DataFrame:
    """What is stored beside each state's snapshot: the state with its run's task, seed and backend."""
    of_run = runs.select("run_id", "task_id", "seed", "backend")
    return states_.select("state_id", "run_id", "t").join(of_run, "run_id").select("state_id", "run_id", "backend", "task_id", "seed", F.col("t").cast("int").alias("t"), F.lit(PROTOCOL).alias("protocol"))


def _requests(states_: DataFrame, spans_: DataFrame, wanted: DataFrame, key: Column) -> DataFrame:
    """``wanted`` (w_state, w_span, w_stop and more) with its key, state and the bounds of its span; ``error`` tells what keeps it from a replay."""
    known = wanted.join(states_.select("state_id", "run_id", *STATE), F.col("w_state") == F.col("state_id"), "left").drop("state_id")
    known = known.join(bounds(spans_).join(spans_.select("span_id", "t_start"), "span_id"), F.col("w_span") == F.col("span_id"), "left").drop("span_id")
    stop = F.coalesce("w_stop", "t_hi")
    error = (
        F.when(F.col("run_id").isNull(), "StateNotFound").when(F.col("w_span").isNull(), F.lit(None).cast("string")).when(F.col("t_lo").isNull(), "SpanNotFound")
        .when(~F.coalesce(stop.between(F.col("t_lo"), F.col("t_hi")), F.lit(False)), "StopBeforeTOutOfRange")
    )
    return stage(known.withColumns({"key": key, "stop_before_t": stop, "error": error}), "requests")


def _report(known: DataFrame, done: DataFrame, more: list[str]) -> DataFrame:
    """What each of the requests ``known`` gives, from the report of the replays ``done``."""
    error = F.coalesce("error", F.when(F.col("diverged_at").isNotNull(), "ReplayDivergence"))
    replays = F.col("error").isNull() & F.col("w_span").isNotNull()
    last = F.when(replays, F.coalesce("last_t", "t"))
    return known.join(done, "key", "left").select(
        *more, F.col("w_state").alias("state_id"), F.col("w_span").alias("span_id"), "run_id", F.col("t").alias("restored_t"), F.when(F.col("w_span").isNotNull(), F.col("stop_before_t")).alias("stop_before_t"),
        F.when(F.col("w_span").isNotNull(), F.col("t_start")).alias("from_t"), last.alias("last_t"), F.when(replays, F.coalesce("applied", F.lit(0).cast("long"))).alias("events_applied"),
        "diverged_at", error.alias("error"), F.when(error.isNull(), F.coalesce(last, F.col("t"))).alias("t"),
    )


def _due(known: DataFrame) -> DataFrame:
    return known.where("error is null and w_span is not null").withColumnRenamed("w_span", "span_id")


def restore_and_replay(states_: DataFrame, spans_: DataFrame, recorded: DataFrame, wanted: DataFrame, seed: int = SEED) -> DataFrame:
    """What each distinct request of ``wanted`` (state_id, span_id, stop_before_t) gives: the state restored, then the
    span's recorded actions done again from it, whichever state the span itself started at.

    Returns (state_id, span_id, run_id, restored_t, stop_before_t, from_t, last_t, events_applied, diverged_at,
    error, t). A null span only restores. A null ``stop_before_t`` means one past the span's last event; a span
    without events allows its first t alone. A stop out of range, an unknown span and a divergence are named in
    ``error`` and leave ``t`` null, where the run else stands. Unknown states give a row with the error StateNotFound.
    """
    asked = wanted.distinct().select(F.col("state_id").alias("w_state"), F.col("span_id").alias("w_span"), F.col("stop_before_t").cast("long").alias("w_stop"))
    # Nulls are left out of the JSON and so differ from any value.
    known = _requests(states_, spans_, asked, F.to_json(F.struct("w_state", "w_span", "w_stop")))
    done, _ = _done_again(_due(known), recorded, seed)
    return _report(known, done, [])


def replay_and_record(states_: DataFrame, spans_: DataFrame, recorded: DataFrame, wanted: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(report, events) of the requests ``wanted`` (sandbox_id, state_id, span_id, stop_before_t), one for each sandbox.

    The report is that of ``restore_and_replay``, with ``sandbox_id``. The events are what the sandboxes record while they replay:
    each appends to its own span, a sibling of the recorded ones, which stay as they are; a replay's last event may be the one
    that came out differently. They have (run_id, span_id, sandbox_id, t, action, n, status, error, cost, steps, observation,
    replayed_span_id, replayed_t, same); t goes on from the restored state. Two rows for one sandbox are an error, DuplicateSandbox.
    """
    asked = wanted.select("sandbox_id", F.col("state_id").alias("w_state"), F.col("span_id").alias("w_span"), F.col("stop_before_t").cast("long").alias("w_stop"))
    known = _requests(states_, spans_, asked, F.col("sandbox_id"))
    if known.groupBy("sandbox_id").count().where("count > 1").take(1):
        raise WayfoldError("DuplicateSandbox", "a sandbox replays one span at a time")
    done, events = _done_again(_due(known), recorded, seed)
    of = known.select("key", "run_id", "sandbox_id", F.col("w_span").alias("replayed_span_id"))
    events = events.drop("run_id").join(of, "key").select(
        "run_id", sibling_span(F.col("sandbox_id")).alias("span_id"), "sandbox_id", "t", "action", "n", "status", "error", "cost", "steps", "observation", "replayed_span_id", F.col("r_t").alias("replayed_t"), "same"
    )
    return _report(known, done, ["sandbox_id"]), events


def go_on(children: DataFrame, states_: DataFrame, actions: DataFrame, order: list[str], seed: int = SEED) -> DataFrame:
    """What each child of ``branch`` or ``restore`` records when it acts: ``actions`` (sandbox_id, action, n and ``order``)
    folded from the state the child was made of. Children of one state share its past and nothing later.

    Rows of ``fold`` with the sandbox as run_id; actions of no child are left out. A child that failed has no
    sandbox and so no rows.
    """
    of = states_.select(F.col("state_id").alias("from_state_id"), *STATE)
    start = stage(children.where("sandbox_id is not null").select("sandbox_id", "from_state_id").join(of, "from_state_id").select(F.col("sandbox_id").alias("run_id"), *STATE), "children")
    mine = actions.withColumnRenamed("sandbox_id", "run_id").join(start.select("run_id"), "run_id", "left_semi")
    return fold(mine, order, seed=seed, start=start)


def lineage(states_: DataFrame) -> DataFrame:
    """(state_id, ancestor_id, distance): all that are above each state. An extension.

    Each round joins the paths found so far, staged, with each other and so doubles their reach; it ends with the
    round that finds nothing. A state above itself is an error, LineageCycle.
    """
    paths = stage(states_.where("parent_state_id is not null").select("state_id", F.col("parent_state_id").alias("ancestor_id"), F.lit(1).alias("distance")), "lineage")
    reach, found = 1, [paths]
    while True:
        far = reduce(DataFrame.unionByName, found)
        # Paths of the greatest length so far, each put in front of all others.
        tips = far.where(F.col("distance") == reach).select("state_id", F.col("ancestor_id").alias("mid"))
        new = stage(tips.join(far.select(F.col("state_id").alias("mid"), "ancestor_id", F.col("distance").alias("more")), "mid").select("state_id", "ancestor_id", (F.col("more") + reach).alias("distance")), "lineage")
        if not new.take(1):
            return far
        if new.where("state_id = ancestor_id").take(1):
            raise WayfoldError("LineageCycle", "a state is its own ancestor")
        found.append(new)
        reach *= 2
