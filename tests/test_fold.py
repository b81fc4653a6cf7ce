"""The window form of the fold against a sequential loop, and the facts of the counter task."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import fold, lineage, loop, ordered
from wayfold.operators.errors import WayfoldError
from wayfold.operators.loop import counter_tasks, step

SCHEMA = "run_id string, seq int, action string, n int"
SCRIPT = [("inc", None), ("inc", None), ("peek", None), ("list_items", None), ("sample", 3), ("sample", 3), ("inc", None), ("peek", None)]


def folded(spark, actions):
    return fold.fold(spark.createDataFrame(actions, SCHEMA), ["seq"])


def by_loop(actions):
    states, out = {}, []
    tasks = counter_tasks([f"id_03_{i:04d}" for i in range(64)])
    for run, seq, action, n in sorted(actions, key=lambda a: (str(a[0]), a[1])):
        state = states.setdefault(run, {"t": 0, "budget": {"steps": 20}, "value": 0, "cursor": 0})
        status, error, _, cost, seen = step(state, tasks, action, {"n": n} if n is not None else {})
        out.append((run, seq, state["t"], status, error, cost, state["budget"]["steps"], state["value"], None if seen is None else json.dumps(seen, sort_keys=True)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.run_id, r.seq, r.t, r.status, r.error, r.cost, r.steps, r.value, r.observation and json.dumps(json.loads(r.observation), sort_keys=True)) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_window_fold_equals_loop(spark, seed):
    rng = random.Random(seed)
    kinds = ["inc", "peek", "list_items", "sample", "bogus", None] * 4 + ["submit"]
    # One run holds most rows and so spans several parts.
    actions = [(rng.choice(["a", "a", "a", "b", "c", None]), i, rng.choice(kinds), rng.choice([None, 0, 1, 5, 40])) for i in range(300)]
    assert got(folded(spark, actions)) == by_loop(actions)


def test_large_runs_in_parts_equal_loop(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LARGE", 50)
    rng = random.Random(9)
    kinds = ["inc", "peek", "list_items", "sample", "bogus", None] * 6 + ["submit"]
    actions = [(rng.choice(["a", "a", "a", "b", "c", None, None]), i, rng.choice(kinds), rng.choice([None, 0, 1, 5, 40])) for i in range(400)] + [("d", i, "peek", None) for i in range(60)]
    df = folded(spark, actions)
    assert got(df) == by_loop(actions)
    # Prefix, then the rest from the states that the prefix leaves: as if it had gone on.
    cut = {"a": 100, "b": 90, "c": 400, "d": 30}
    head, tail = ([x for x in actions if (x[1] < cut.get(x[0], 200)) == first] for first in (True, False))
    last = folded(spark, head).groupBy("run_id").agg(*[fold.F.max_by(c, "t").alias(c) for c in lineage.STATE])
    again = fold.fold(spark.createDataFrame(tail, SCHEMA), ["seq"], start=last)
    assert sorted(got(folded(spark, head)) + got(again), key=str) == by_loop(actions)


def test_script(spark):
    rows = folded(spark, [("a", i, a, n) for i, (a, n) in enumerate(SCRIPT, 1)]).orderBy("t").collect()
    assert [r.status for r in rows] == ["ok"] * 8
    assert json.loads(rows[4].observation)["items"] == ["id_03_0000", "id_03_0001", "id_03_0002"]
    assert json.loads(rows[5].observation)["items"] == ["id_03_0003", "id_03_0004", "id_03_0005"]
    assert len(json.loads(rows[3].observation)["items"]) == 8 and rows[7].value == 3 and rows[7].steps == 14


def test_budget_runs_out_and_refusals_are_charged(spark):
    rows = folded(spark, [("a", i, "inc", None) for i in range(22)]).orderBy("t").collect()
    assert (rows[19].steps, rows[19].status) == (0, "ok")
    assert (rows[20].error, rows[20].cost, rows[20].steps, rows[20].value) == ("ActionRefused", 1, 0, 20)


def test_empty(spark):
    df = folded(spark, [])
    rows = lineage.in_spans(df, fold._is("submit"))
    assert df.count() == 0 and lineage.states(rows).count() == 0 and lineage.spans(rows).count() == 0


def scripted(spark, commit, script=SCRIPT):
    """(rows, states, spans) of one run of the script."""
    rows = lineage.in_spans(folded(spark, [("a", i, a, n) for i, (a, n) in enumerate(script, 1)]), commit).cache()
    states = lineage.states(rows).cache()
    return rows, states, lineage.spans(rows, states).cache()


def test_replay_prefix_then_suffix(spark):
    rows, states, spans = scripted(spark, fold.F.col("t") == 2)
    kept = {r.n: r for r in states.collect()}
    assert kept[1].parent_state_id == "a-s0" and kept[1].t == 2 and kept[1].from_span_id == "a-p0" and (kept[1].value, kept[1].steps, kept[0].steps) == (2, 18, 20)
    done = lambda stop=None: {r.span_id: (r.from_t, r.last_t, r.events_applied, r.diverged_at) for r in lineage.replay(rows, spans, states, stop).collect()}
    assert done(fold.F.lit(5)) == {"a-p0": (1, 2, 2, None), "a-p1": (3, 4, 2, None)}
    # A stop at a span's first event applies none; the run stands where the state does.
    assert done(fold.F.lit(3))["a-p1"] == (3, 2, 0, None)
    assert done()["a-p1"] == (3, 8, 6, None)


def test_spans_without_events(spark):
    # Two states after event 2, one after the last: an empty span that stays open, and an empty last one.
    rows, states, spans = scripted(spark, fold.F.when(fold.F.col("t") == 2, 2).when(fold.F.col("t") == 8, 1))
    kept = {r.n: (r.t, r.parent_state_id, r.from_span_id) for r in states.collect()}
    assert kept == {0: (0, None, None), 1: (2, "a-s0", "a-p0"), 2: (2, "a-s1", None), 3: (8, "a-s2", "a-p2")}
    found = {r.span_id: (r.from_state_id, r.to_state_id, r.t_start, r.t_end, r.n_events) for r in spans.collect()}
    assert found == {"a-p0": ("a-s0", "a-s1", 1, 2, 2), "a-p1": ("a-s1", None, 3, None, 0), "a-p2": ("a-s2", "a-s3", 3, 8, 6), "a-p3": ("a-s3", None, 9, None, 0)}
    assert {r.span_id: (r.t_lo, r.t_hi) for r in lineage.bounds(spans).collect()} == {"a-p0": (1, 3), "a-p1": (3, 3), "a-p2": (3, 9), "a-p3": (9, 9)}
    replays = {r.span_id: (r.from_t, r.last_t, r.events_applied) for r in lineage.replay(rows, spans, states).collect()}
    assert replays == {"a-p0": (1, 2, 2), "a-p1": (3, 2, 0), "a-p2": (3, 8, 6), "a-p3": (9, 8, 0)}


def test_tampered_events_are_found(spark):
    rows, states, spans = scripted(spark, fold.F.lit(False), [("inc", None)] * 4)
    seen = rows.withColumn("observation", fold.F.when(fold.F.col("t") == 1, '{"value":-1}').otherwise(fold.F.col("observation")))
    assert lineage.replay(seen, spans, states).first().asDict() == {"span_id": "a-p0", "from_t": 1, "last_t": 0, "events_applied": 0, "diverged_at": 1}
    # An action that was changed shows in what it observes when done again.
    did = rows.withColumn("action", fold.F.when(fold.F.col("t") == 3, "peek").otherwise(fold.F.col("action")))
    assert lineage.replay(did, spans, states).first().asDict() == {"span_id": "a-p0", "from_t": 1, "last_t": 2, "events_applied": 2, "diverged_at": 3}
    # One that was left out shows in the next.
    assert lineage.replay(rows.where("t <> 2"), spans, states).first().diverged_at == 3


def test_stop_out_of_range(spark):
    rows, states, spans = scripted(spark, fold.F.lit(False), [("inc", None)])
    with pytest.raises(WayfoldError) as e:
        lineage.check_stop(lineage.bounds(spans), "a-p0", 99)
    assert e.value.as_dict() == {"error": "StopBeforeTOutOfRange", "message": "stop_before_t=99 not in [1, 2]", "stop_before_t": 99, "t_lo": 1, "t_hi": 2}
    with pytest.raises(WayfoldError):
        lineage.check_stop(lineage.bounds(spans), "nowhere", 1)
    lineage.check_stop(lineage.bounds(spans), "a-p0", 2)


def test_restore_and_replay(spark):
    rows, states, spans = scripted(spark, fold.F.col("t").isin(2, 8))
    bad = rows.withColumn("observation", fold.F.when(fold.F.col("t") == 4, '{"value":-1}').otherwise(fold.F.col("observation")))
    asked = [("a-s1", "a-p1", 5), ("a-s1", "a-p1", 5), ("a-s1", None, None), ("a-s0", "a-p0", None), ("a-s1", "a-p1", 99), ("a-s2", "a-p2", None), ("a-s1", "nowhere", None), ("lost", None, None)]
    asked = spark.createDataFrame(asked, "state_id string, span_id string, stop_before_t long")

    def run(recorded, asked=asked):
        found = lineage.restore_and_replay(states, spans, recorded, asked).collect()
        return {(r.state_id, r.span_id, r.stop_before_t): (r.restored_t, r.from_t, r.last_t, r.events_applied, r.error, r.t) for r in found}

    whole = run(rows)
    assert whole == {
        ("a-s1", "a-p1", 5): (2, 3, 4, 2, None, 4), ("a-s1", None, None): (2, None, None, None, None, 2), ("a-s0", "a-p0", 3): (0, 1, 2, 2, None, 2), ("a-s1", "a-p1", 99): (2, 3, None, None, "StopBeforeTOutOfRange", None),
        ("a-s2", "a-p2", 9): (8, 9, 8, 0, None, 8), ("a-s1", "nowhere", None): (2, None, None, None, "SpanNotFound", None), ("lost", None, None): (None, None, None, None, "StateNotFound", None),
    }
    assert run(bad) == whole | {("a-s1", "a-p1", 5): (2, 3, 3, 1, "ReplayDivergence", None)}
    # A span replayed from a state that it did not start at diverges at once: an inc from value 2 gives 3.
    other = spark.createDataFrame([("a-s1", "a-p0", None)], "state_id string, span_id string, stop_before_t long")
    assert run(rows, other) == {("a-s1", "a-p0", 3): (2, 1, 2, 0, "ReplayDivergence", None)}
    assert lineage.restore_and_replay(states, spans, rows, asked.limit(0)).count() == 0


def test_children_act_on_their_own(spark):
    rows, states, _ = scripted(spark, fold.F.col("t") == 5)
    kids = lineage.branch(states.where("n = 1"), 2)
    script = [("a-s1-b0", 1, "inc", None), ("a-s1-b0", 2, "peek", None), ("a-s1-b1", 1, "peek", None), ("a-s1-b1", 2, "sample", 2), ("nobody", 1, "inc", None)]
    out = lineage.go_on(kids, states, spark.createDataFrame(script, "sandbox_id string, seq int, action string, n int"), ["seq"])
    got = {(r.run_id, r.t): (r.observation, r.steps) for r in out.collect()}
    assert got == {
        ("a-s1-b0", 6): ('{"value":3}', 15), ("a-s1-b0", 7): ('{"value":3}', 15), ("a-s1-b1", 6): ('{"value":2}', 16), ("a-s1-b1", 7): ('{"items":["id_03_0003","id_03_0004"]}', 15),
    }
    # The same actions as the parent took give what the parent saw.
    same = [("a-s1-b0", i, a, n) for i, (a, n) in enumerate(SCRIPT[5:], 1)]
    out = lineage.go_on(kids, states, spark.createDataFrame(same, "sandbox_id string, seq int, action string, n int"), ["seq"])
    assert sorted((r.t, r.observation) for r in out.collect()) == sorted((r.t, r.observation) for r in rows.where("t > 5").collect())


def test_lineage(spark):
    states = spark.createDataFrame([(f"s{i}", f"s{i - 1}" if i else None) for i in range(150)] + [("t", "s3"), ("u", None)], "state_id string, parent_state_id string")
    got = {(r.state_id, r.ancestor_id): r.distance for r in lineage.lineage(states).collect()}
    assert got == {(f"s{i}", f"s{j}"): i - j for i in range(150) for j in range(i)} | {("t", f"s{j}"): 4 - j for j in range(4)}
    with pytest.raises(WayfoldError):
        lineage.lineage(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "state_id string, parent_state_id string"))
    assert lineage.lineage(states.limit(0)).count() == 0


def test_start_runs(spark):
    asked = spark.createDataFrame([("r", "box", "counter", 3, "episode", 1.5)], "run_id string, sandbox_id string, task_id string, seed int, backend string, created_at double")
    runs, states, spans = lineage.start_runs(asked)
    assert runs.columns == ["run_id", "task_id", "seed", "backend", "created_at"]
    state, span = states.first(), spans.first()
    assert (state.state_id, state.t, state.parent_state_id, state.budget) == ("r-s0", 0, None, None)
    assert (span.from_state_id, span.to_state_id, span.t_start, span.t_end, span.sandbox_id) == ("r-s0", None, 1, None, "box")


def test_partial_branch(spark):
    states = spark.createDataFrame([("s", "r", 4)], "state_id string, run_id string, t int")
    kids = lineage.branch(states, 3, broken=fold.F.when(fold.F.col("index") == 1, True)).collect()
    assert [(k["index"], k.sandbox_id, k.error) for k in kids] == [(0, "s-b0", None), (1, None, "BranchFailed"), (2, "s-b2", None)]


def test_messages(spark):
    df = folded(spark, [("a", i, "inc", None) for i in range(21)] + [("a", 21, "bogus", None), ("a", 22, None, None), ("a", 23, "submit", None), ("a", 24, "inc", None)])
    said = [r[0] for r in df.orderBy("t").select(fold.messages(fold.F.col("steps"), fold.F.col("error"), fold.F.col("action"))).collect()]
    assert said[19:] == [None, "steps exhausted: 0 left, 1 needed", "no action 'bogus'; available: inc, list_items, peek, sample, submit", "no action None; available: inc, list_items, peek, sample, submit", None, "this episode has already finished"]


@pytest.mark.parametrize("n", [0, 101])
def test_branch_limits(spark, n):
    with pytest.raises(WayfoldError):
        lineage.branch(spark.createDataFrame([("s", "r", 1)], "state_id string, run_id string, t int"), n)


def test_branch_children(spark):
    states = spark.createDataFrame([("s", "r", 4)], "state_id string, run_id string, t int")
    kids = lineage.branch(states, 100, dirty=fold.F.lit(True)).collect()
    assert len({k.sandbox_id for k in kids}) == 100 and {k.parent_state_id for k in kids} == {None} and {k.t_start for k in kids} == {5}


def test_recorded_commands(spark):
    df = fold.recorded_commands(spark.createDataFrame([("exec", "ls", 0), ("exec", "ls", 2), ("exec", "", 0), ("exec", None, 0), ("inc", "ls", 0), ("exec", "ls", None)], "action string, cmd string, exit int"))
    assert [(r.status, r.error, r.message) for r in df.collect()] == [("ok", None, None), ("error", "ExecFailed", "exit 2"), ("error", "ActionRefused", "exec needs cmd"), ("error", "ActionRefused", "exec needs cmd"), ("error", "UnknownAction", "only exec is known"), ("error", "ExecFailed", "exit None")]


def test_clashing_columns(spark):
    df = fold.fold(spark.createDataFrame([("a", 1, "inc", 0, "mine", 5)], SCHEMA + ", status string, closed int"), ["seq"])
    assert [(r.status, r.closed, r.seq) for r in df.collect()] == [("ok", 5, 1)]


def by_steps(actions, initial, starts):
    """What a plain loop gives: (run, seq, t, status, error, message, cost, budget, observation, done)."""
    tasks, states, out = loop.metered_tasks(), {r: {"t": 0, **json.loads(json.dumps(initial)), **json.loads(s)} for r, s in starts}, []
    for run, seq, action, params in sorted(actions, key=lambda a: (str(a[0]), a[1])):
        state = states.setdefault(run, {"t": 0, **json.loads(json.dumps(initial))})
        status, error, message, cost, seen = step(state, tasks, action, loop.params_of(params))
        out.append((run, seq, state["t"], status, error, message, cost, sorted(state["budget"].items()), None if seen is None else json.dumps(seen, sort_keys=True, separators=(",", ":")), bool(state.get("done"))))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts,slice_", [(1, 10_000), (6, 10_000), (7, 3), (40, 1)])
def test_any_costs_over_any_parts(spark, monkeypatch, parts, slice_):
    """Fractional costs over two counters; one run holds most rows and spans parts, whatever is held at a time."""
    monkeypatch.setattr(loop, "SLICE", slice_)
    rng, initial = random.Random(parts), {"budget": {"steps": 20, "tokens": 11.25}, "value": 0}
    kinds = ["add", "look", "rest", "rest", "look", "bogus", None] * 6 + ["submit"]
    actions = [(rng.choice(["hot"] * 6 + ["b", "c", "d", None]), i, rng.choice(kinds), rng.choice([None, "", "[1]", "no json", '{"k":3}', '{"k":0.5}', '{"k":40}'])) for i in range(260)]
    starts = [("c", json.dumps({"t": 7, "value": 5, "budget": {"steps": 1.0001, "gas": 3}})), ("d", json.dumps({"t": 2, "done": True})), ("unknown", json.dumps({"t": 1}))]
    for given in ([], starts):
        df = spark.createDataFrame([(*a, "x", 5) for a in actions], "run_id string, seq int, action string, params string, other string, t int")
        start = spark.createDataFrame(given, "run_id string, state string") if given else None
        out = loop.play(df, ["seq"], loop.metered_tasks(), initial, start=start, parts=parts)
        got_ = sorted(((r.run_id, r.seq, r.t, r.status, r.error, r.message, r.cost, sorted((k, round(v, 4)) for k, v in r.budget.items()), r.observation, r.done) for r in out.collect()), key=str)
        # Played in two calls, the second from the states that the first left, the rest is the same.
        early, states = loop.play_on(df.where("seq < 130"), ["seq"], loop.metered_tasks(), initial, start=start, parts=parts)
        late = loop.play(df.where("seq >= 130"), ["seq"], loop.metered_tasks(), initial, start=ordered.stage(states, "states"), parts=parts)
        assert sorted(map(str, early.unionByName(late).collect())) == sorted(map(str, out.collect()))
        expected = [(*r[:7], [(k, round(float(v), 4)) for k, v in r[7]], *r[8:]) for r in by_steps(actions, initial, given)]
        assert got_ == sorted(expected, key=str) and {r.other for r in out.collect()} == {"x"}
    assert loop.play(df.limit(0), ["seq"], loop.metered_tasks(), initial).count() == 0


def test_a_task_must_not_serve_hidden_keys(spark):
    df = spark.createDataFrame([("a", 1, "leak", None)], "run_id string, seq int, action string, params string")
    with pytest.raises(Exception, match="HiddenKey|hidden key observation.a"):
        loop.play(df, ["seq"], {"leak": (0, lambda params, state: {"a": [{"_truth": 1}]})}, {"budget": {}}).collect()


def test_a_replay_records_in_a_sibling_span(spark):
    """Spacing is no divergence; the event that comes out differently is recorded too; the originals stay."""
    actions = [("a", i, x, n) for i, (x, n) in enumerate(SCRIPT)]
    rows = ordered.stage(lineage.in_spans(folded(spark, actions), F.col("action") == "list_items"), "events")
    states, given = lineage.states(rows), rows.select("span_id", "t", "action", "n", "status", F.replace("observation", F.lit(":"), F.lit(" :  ")).alias("observation"))
    wanted = [("box0", "a-s0", "a-p0", None), ("box1", "a-s1", "a-p1", None), ("box2", "a-s0", "a-p0", 3), ("box3", "a-s1", None, None), ("box4", "no", "a-p0", None), ("box5", "a-s0", "a-p1", None), ("box6", "a-s0", "a-p0", 99)]
    wanted = spark.createDataFrame(wanted, "sandbox_id string, state_id string, span_id string, stop_before_t int")
    report, events = lineage.replay_and_record(states, lineage.spans(rows, states), given, wanted)
    got_ = {r.sandbox_id: (r.events_applied, r.last_t, r.diverged_at, r.error) for r in report.collect()}
    assert got_ == {"box0": (4, 4, None, None), "box1": (4, 8, None, None), "box2": (2, 2, None, None), "box3": (None, None, None, None), "box4": (None, None, None, "StateNotFound"), "box5": (2, 6, 7, "ReplayDivergence"), "box6": (None, None, None, "StopBeforeTOutOfRange")}
    out = sorted((r.sandbox_id, r.span_id, r.t, r.replayed_t, r.action, r.observation, r.same) for r in events.collect())
    assert [o[:5] for o in out if o[0] == "box1"] == [("box1", "box1-p", t, t, a) for t, (a, _) in enumerate(SCRIPT[4:], 5)]
    # From the first state on the counter stands at 0 where it stood at 2: the third event differs, and ends the replay.
    assert [(o[2], o[3], o[5], o[6]) for o in out if o[0] == "box5"][2:] == [(3, 7, '{"value":1}', False)] and {o[0] for o in out} == {"box0", "box1", "box2", "box5"}
    with pytest.raises(WayfoldError, match="one span at a time"):
        lineage.replay_and_record(states, lineage.spans(rows, states), given, wanted.unionByName(wanted))


def test_restore_names_unknown_states(spark):
    states = lineage.states(lineage.in_spans(folded(spark, [("a", 0, "inc", None)]), F.lit(True)))
    prompts, wanted = spark.createDataFrame([("a-s0", "hi")], "state_id string, prompt string"), spark.createDataFrame([("a-s0", "b0"), ("a-s1", "b1"), ("a-s1", "b2"), ("x", "b3")], "state_id string, sandbox_id string")
    got_ = {r.sandbox_id: (r.span_id, r.t_start, r.prompt, r.error) for r in lineage.restore(states, prompts, wanted).collect()}
    assert got_ == {"b0": ("b0-p", 1, "hi", None), "b1": ("b1-p", 2, None, None), "b2": ("b2-p", 2, None, None), "b3": (None, None, None, "StateNotFound")}
