"""The episode loop over a whole table: any task, any costs, runs of any length.

Costs in general have no closed form: whether an action is refused depends on all that came before it. So rows are
sorted by run and order, and each part of the sorted table is gone through once, in slices, with one small state
in hand. A run that goes on in the next part is folded again there, from the state in which the part before left it;
that takes one round for each further part of the longest run. What is kept between rounds is staged.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.json import hidden_path
from .errors import WayfoldError
from .fold import COUNTER, LISTED, SAMPLED
from .ordered import stage

#: (params, state) -> observation; may change ``state`` (a JSON object), raises Refused to decline.
Step = Callable[[dict, dict], object]
#: What an action costs, and what it does.
Tasks = dict[str, tuple[int, Step]]
#: What the loop adds to an action's row, and what it keeps beside it until all parts are done.
ADDED = {"t": "long", "status": "string", "error": "string", "message": "string", "cost": "int", "budget": "map<string,double>", "observation": "string", "done": "boolean"}
KEPT = {"_part": "int", "_seq": "long", "_first": "boolean", "_state": "string", "_end": "string"}
#: Rows whose results are held before they are given out.
SLICE = 10_000


class Refused(Exception):
    """A task declines an action; the text says why."""


def spend(state: dict, counter: str, amount: float) -> None:
    """Take from a counter of the budget; one that the budget does not have costs nothing. What was taken before a refusal stays taken."""
    budget = state["budget"]
    if counter not in budget:
        return
    if budget[counter] < amount:
        raise Refused(f"{counter} exhausted: {budget[counter]:g} left, {amount:g} needed")
    budget[counter] -= amount


def step(state: dict, tasks: Tasks, action: str | None, params: dict) -> tuple[str, str | None, str | None, int, object]:
    """(status, error, message, cost, observation) of one action. An observation with a hidden key is an error of the task and ends the job."""
    state["t"] += 1
    if state.get("done"):
        return "error", "EpisodeComplete", "this episode has already finished", 0, None
    if action not in tasks:
        return "error", "UnknownAction", f"no action {action!r}; available: {', '.join(sorted(tasks))}", 1, None
    cost, act = tasks[action]
    try:
        seen = act(params, state)
    except Refused as why:
        return "error", "ActionRefused", str(why), cost, None
    at = hidden_path(seen)
    if at is not None:
        raise WayfoldError("HiddenKey", f"the task serves a hidden key {at}")
    return "ok", None, None, cost, seen


def params_of(text: str | None) -> dict:
    """An action's parameters; null and what is no JSON object count as none."""
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        found = {}
    return found if isinstance(found, dict) else {}


class _Part:
    """The fold of one part, row by row; holds one run's state and the results of one slice."""

    def __init__(self, tasks: Tasks, initial: str, began: dict[int, str] | None):
        self.tasks, self.initial, self.began = tasks, initial, began
        self.part, self.run, self.state, self.first = None, None, {}, None
        self.out: list[tuple] = []
        self.seq = 0

    def end(self, part: bool = True) -> None:
        """Mark a run's last row here with its state; the part's last one with what the next part needs as well."""
        if self.out:
            state = json.dumps(self.state)
            self.out[-1] = (*self.out[-1][:-2], state, json.dumps({"first": self.first, "last": self.run, "state": self.state}) if part else None)

    def add(self, part: int, seq: int, run: str | None, load: str | None, action: str | None, params: str | None) -> None:
        if part != self.part:
            self.end()
            self.part, self.run, self.first = part, run, run
            self.state = json.loads(self.began[part] if self.began else self.initial)
        elif run != self.run:
            self.end(part=False)
            self.run, self.state = run, json.loads(self.initial)
        if load is not None:
            self.state = {**json.loads(self.initial), **json.loads(load)}
            row = (None,) * len(ADDED)
        else:
            status, error, message, cost, seen = step(self.state, self.tasks, action, params_of(params))
            budget = [(k, round(float(v), 4)) for k, v in self.state["budget"].items()]
            row = (self.state["t"], status, error, message, cost, budget, None if seen is None else json.dumps(seen, sort_keys=True, ensure_ascii=False, separators=(",", ":")), bool(self.state.get("done")))
        self.out.append((*row, part, seq, run == self.first, None, None))


def _fold(tasks: Tasks, initial: str, began: dict[int, str] | None, given: list[str]):
    """The function for ``mapInArrow``: rows of a first pass, or, with the states that parts ``began`` at, of a later one."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,double>": pa.map_(pa.string(), pa.float64())}
    names = [*ADDED, *KEPT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, held = _Part(tasks, initial, began), None
        mine = TaskContext.get().partitionId()

        def flush(rows: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array(list(v), kinds[{**ADDED, **KEPT}[n]]) for n, v in zip(names, zip(*fold.out))]
            fold.out = []
            return pa.RecordBatch.from_arrays([*[rows.column(c) for c in given], *columns], [*given, *names])

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                parts = batch.column("_part").to_pylist() if began else [mine] * batch.num_rows
                seqs = batch.column("_seq").to_pylist() if began else range(fold.seq, fold.seq + batch.num_rows)
                fold.seq += batch.num_rows
                # The last row of a slice may be its part's or its run's last one, which only the next slice tells.
                if held is not None:
                    if parts[0] != fold.part or batch.column("run_id")[0].as_py() != fold.run:
                        fold.end(part=parts[0] != fold.part)
                    yield flush(held)
                for row in zip(parts, seqs, *(batch.column(c).to_pylist() for c in ("run_id", "_load", "action", "params"))):
                    fold.add(*row)
                held = batch
        if held is not None:
            fold.end()
            yield flush(held)

    return run


def play(actions: DataFrame, order: list[str], tasks: Tasks, initial: dict, start: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """The rows of ``play_on`` alone: see there."""
    return play_on(actions, order, tasks, initial, start, parts)[0]


def play_on(actions: DataFrame, order: list[str], tasks: Tasks, initial: dict, start: DataFrame | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, states): ``actions`` (run_id, action, params and ``order``) with what the episode of each run records for them.

    ``tasks`` says what each action costs and does; ``initial`` is the state that runs start from: a small JSON object with
    a ``budget`` (counter to number) and whatever else the task keeps. ``start`` (run_id, state) has at most one row a run:
    the JSON state that it goes on from, with its ``t``. ``params`` is JSON.

    Adds t, status, error, message, cost, budget (what is left, to four places), observation (canonical JSON) and done. After
    a task sets ``done`` all is EpisodeComplete at no cost; an unknown or null action costs 1; a refused one its cost. Rows equal in
    ``order`` come in any order: make it total. Null run_ids are one run. An empty table gives an empty result. Other columns
    go along; those named like an added one are replaced. The states (run_id, state) are how each run stands at the end, those of
    ``start`` without an action included: what a later call goes on from. ``parts`` is how many parts the table is sorted into (Spark's choice if None).
    """
    text = json.dumps({"t": 0, **initial})
    other = [c for c in actions.columns if c not in ("run_id", "action", "params", *ADDED)]
    by = {f"_by{i}": F.col(c) for i, c in enumerate(order)}
    rows = actions.select("run_id", F.lit(None).cast("string").alias("_load"), "action", "params", F.struct(F.lit(0).alias("_"), *other).alias("_row"), *[c.alias(k) for k, c in by.items()])
    if start is not None:
        rows = rows.unionByName(start.select("run_id", F.col("state").alias("_load")), allowMissingColumns=True)
    sort = [F.col("run_id").asc_nulls_first(), F.col("_load").isNull(), *[F.col(k).asc_nulls_last() for k in by]]
    rows = (rows.repartitionByRange(parts, *sort) if parts else rows.repartitionByRange(*sort)).sortWithinPartitions(*sort).drop(*by)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(", ".join(f"{c} {k}" for c, k in {**ADDED, **KEPT}.items())).fields])
    first = stage(rows.mapInArrow(_fold(tasks, text, None, rows.columns), schema), "loop")

    # One small row a part.
    ends = {r["_part"]: json.loads(r["_end"]) for r in first.where("_end is not null").select("_part", "_end").collect()}
    order_ = sorted(ends)
    before = {b: a for a, b in zip(order_, order_[1:]) if ends[a]["last"] == ends[b]["first"]}
    known = {p: json.dumps(e["state"]) for p, e in ends.items() if p not in before or e["first"] != e["last"]}
    done, todo = [first.where(~(F.col("_first") & F.col("_part").isin(list(before)))) if before else first], set(before)
    while todo:
        ready = sorted(p for p in todo if before[p] in known)
        again = first.where(F.col("_first") & F.col("_part").isin(ready)).select(*rows.columns, "_part", "_seq")
        again = again.repartition(len(ready), "_part").sortWithinPartitions("_part", "_seq")
        new = stage(again.mapInArrow(_fold(tasks, text, {p: known[before[p]] for p in ready}, rows.columns), schema), "loop")
        known |= {r["_part"]: json.dumps(json.loads(r["_end"])["state"]) for r in new.where("_end is not null").select("_part", "_end").collect() if r["_part"] not in known}
        done.append(new)
        todo -= set(ready)
    out = done[0]
    for new in done[1:]:
        out = out.unionByName(new)
    # A run that spans parts has a state in each; the last one's counts.
    states = out.where("_state is not null").groupBy("run_id").agg(F.max_by("_state", "_part").alias("state"))
    return out.where("_load is null").select("run_id", "action", "params", *[F.col("_row")[c].alias(c) for c in other], *ADDED), states


def counter_tasks(ids: list[str]) -> Tasks:
    """The counter task at the costs of ``COUNTER``; its state starts as ``{"budget": {"steps": 20}, "value": 0, "cursor": 0}``."""

    def seen(action: str, params: dict, now: dict) -> object:
        if action == "list_items":
            return {"items": [f"item_{i}" for i in range(LISTED)]}
        if action == "sample":
            start = now["cursor"]
            now["cursor"] += int(params.get("n") or SAMPLED)
            return {"items": ids[start : now["cursor"]]}
        now["value"] += action == "inc"
        if action != "submit":
            return {"value": now["value"]}
        now["done"] = True
        return {"ok": True, "value": now["value"], "submission": params.get("answer")}

    def task(action: str) -> Step:
        def act(params: dict, now: dict) -> object:
            if COUNTER[action].spends:
                spend(now, "steps", 1)
            return seen(action, params, now)

        return act

    return {action: (known.cost, task(action)) for action, known in COUNTER.items()}


def metered_tasks() -> Tasks:
    """A task of two counters, ``steps`` and ``tokens``, at fractional costs; its state starts as ``{"budget": {...}, "value": 0}``.

    ``add`` costs one and a half steps and a quarter token for each unit of its parameter k; ``look`` a quarter token; ``rest``
    half a step, and gas, which no budget has; ``submit`` nothing. A refusal of tokens comes after the steps are spent.
    """

    def add(params: dict, now: dict) -> object:
        spend(now, "steps", 1.5)
        spend(now, "tokens", 0.25 * (params.get("k") or 0))
        now["value"] += params.get("k") or 0
        return {"value": now["value"]}

    def look(params: dict, now: dict) -> object:
        spend(now, "tokens", 0.25)
        return {"value": now["value"]}

    def rest(params: dict, now: dict) -> object:
        spend(now, "gas", 7)
        spend(now, "steps", 0.5)
        return {}

    def submit(params: dict, now: dict) -> object:
        now["done"] = True
        return {"ok": now["value"] > 0, "value": now["value"]}

    return {"add": (2, add), "look": (0, look), "rest": (1, rest), "submit": (0, submit)}
