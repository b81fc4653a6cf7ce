"""The episode fold: what each action of a run did, given its budget.

Every action of the counter task spends one step or none, so the sequential loop has a closed form in
running sums; see ``wayfold.streaming.episodes`` for costs that have none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import general
from .ordered import Add, by_size, small, stage


@dataclass(frozen=True)
class Action:
    """What an action costs and whether it spends a step of the budget."""

    cost: int
    spends: bool


#: The counter task.
COUNTER = {"inc": Action(1, True), "peek": Action(0, False), "list_items": Action(1, True), "sample": Action(1, True), "submit": Action(0, False)}
SEED, STEPS, ITEMS, LISTED, SAMPLED = 3, 20, 64, 8, 3
ADDED = ("t", "status", "error", "cost", "steps", "value", "cursor", "observation", "done")


def item_id(seed: Column, i: Column) -> Column:
    return F.concat(F.lit("id_"), F.lpad(seed.cast("string"), 2, "0"), F.lit("_"), F.lpad(i.cast("string"), 4, "0"))


def _is(action: str) -> Column:
    return F.coalesce(F.col("action") == action, F.lit(False))


def _any(actions: list[str]) -> Column:
    return F.coalesce(F.col("action").isin(actions), F.lit(False))


def observation(seed: Column) -> Column:
    """Canonical JSON of what an accepted action returns, from its value, cursor and n."""
    start = F.col("cursor") - F.col("n")
    upto = F.least(F.col("cursor"), F.lit(ITEMS).cast("long"))
    sampled = F.when(start < upto, F.transform(F.sequence(start, F.greatest(upto - 1, start)), lambda i: item_id(seed, i))).otherwise(F.array().cast("array<string>"))
    value = F.to_json(F.struct("value"))
    return (
        F.when(_is("inc") | _is("peek"), value)
        .when(_is("list_items"), F.to_json(F.struct(F.array(*[F.lit(f"item_{i}") for i in range(LISTED)]).alias("items"))))
        .when(_is("sample"), F.to_json(F.struct(sampled.alias("items"))))
        .when(_is("submit"), F.to_json(F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("submission"), "value"), {"ignoreNullFields": "false"}))
    )


def fold(actions: DataFrame, order: list[str], seed: int = SEED, steps: int = STEPS, start: DataFrame | None = None, commit: Column | None = None) -> DataFrame:
    """``actions`` (run_id, action, n and ``order``) with what the episode records for each of them.

    Adds t, status, error, cost, steps (what is left), value, cursor, observation and done (whether a submit was
    accepted by then). After a submit all is EpisodeComplete at no cost; an unknown or null action costs 1; an
    action that the budget refuses is charged though the steps stay. ``n`` of null or 0 counts as 3; negative n
    give no items. Equal rows in ``order`` come in any order: make it total. An empty table gives an empty
    result. Other columns go along; those named like an added one are replaced.

    ``start`` (run_id, t, steps, value, cursor, done) has at most one row a run: the state that it goes on from;
    runs without one begin anew. ``commit``, over action, status, error, cost, steps and t, says how many states are taken after an
    event (or whether one is): it adds ``commits_here`` and ``commits``, those taken so far.

    Runs go through one shuffle and its sort; those too large for a task are cut into parts (see ``ordered``).
    """
    n = F.coalesce(F.nullif(F.col("n"), F.lit(0)), F.lit(SAMPLED)).cast("long")
    other = [c for c in actions.columns if c not in ("run_id", "action", "n", *ADDED)]
    by = {f"_by{i}": F.col(c) for i, c in enumerate(order)}
    given = actions.select("run_id", "action", n.alias("n"), *[c.alias(k) for k, c in by.items()], F.struct(*(other or ["run_id"])).alias("_row"))
    began = {"s_t": F.lit(0), "s_steps": F.lit(steps), "s_value": F.lit(0), "s_cursor": F.lit(0), "s_done": F.lit(False)}
    if start is not None:
        of = stage(start.select(F.col("run_id").alias("s_run"), *[F.col(c[2:]).alias(c) for c in began]), "starts")
        given = given.join(small(of), F.col("run_id").eqNullSafe(F.col("s_run")), "left").drop("s_run").withColumns({c: F.coalesce(c, v) for c, v in began.items()})
        began = {c: F.col(c) for c in began}

    def run(rows: DataFrame, add: Add) -> DataFrame:
        submit = _is("submit").cast("int")
        rows = add(rows, {"t": F.lit(1), "submits": submit})
        rows = rows.withColumn("closed", began["s_done"] | (F.col("submits") - submit > 0))
        rows = rows.withColumn("spends", ~F.col("closed") & _any([a for a, x in COUNTER.items() if x.spends]))
        rows = add(rows, {"asked": F.col("spends").cast("int")})
        error = F.when(F.col("closed"), "EpisodeComplete").when(~_any(list(COUNTER)), "UnknownAction").when(F.col("spends") & (F.col("asked") > began["s_steps"]), "ActionRefused")
        costs = F.when(F.col("closed"), 0).when(_any([a for a, x in COUNTER.items() if not x.cost]), 0).otherwise(1)
        rows = rows.withColumns({"t": (F.col("t") + began["s_t"]).cast("long"), "error": error, "cost": costs.cast("int"), "steps": (began["s_steps"] - F.least(began["s_steps"], F.col("asked"))).cast("int"), "done": F.col("closed") | _is("submit")})
        ok = F.col("error").isNull()
        rows = rows.withColumn("status", F.when(ok, "ok").otherwise("error"))
        sums = {"value": (ok & _is("inc")).cast("int"), "cursor": F.when(ok & _is("sample"), F.col("n")).otherwise(0)}
        if commit is not None:
            rows, sums["commits"] = rows.withColumn("commits_here", F.coalesce(commit.cast("int"), F.lit(0))), F.col("commits_here")
        return add(rows, sums).withColumns({c: (F.col(c) + began[f"s_{c}"]).cast("long") for c in ("value", "cursor")})

    rows = by_size(given, ["run_id"], list(by), run)
    seen = F.when(F.col("error").isNull(), observation(F.lit(seed)))
    return rows.select("run_id", "action", *[F.col("_row")[c].alias(c) for c in other], "n", *[seen.alias(c) if c == "observation" else F.col(c) for c in ADDED], *(["commits_here", "commits"] if commit is not None else []))


def results(folded: DataFrame) -> DataFrame:
    """(run_id, value) of each run that was submitted: the score at its first submit."""
    return folded.where(_is("submit") & (F.col("status") == "ok")).select("run_id", "value")


def messages(steps: Column, error: Column, action: Column) -> Column:
    """What an event's error says, given the steps that are left; null without one."""
    names = ", ".join(sorted(COUNTER))
    called = F.coalesce(F.concat(F.lit("'"), action, F.lit("'")), F.lit("None"))
    return (
        F.when(error == "EpisodeComplete", "this episode has already finished")
        .when(error == "UnknownAction", F.concat(F.lit("no action "), called, F.lit(f"; available: {names}")))
        .when(error == "ActionRefused", F.concat(F.lit("steps exhausted: "), general(steps.cast("double")), F.lit(" left, 1 needed")))
    )


def recorded_commands(commands: DataFrame) -> DataFrame:
    """Events of recorded command results (action, cmd, exit): only exec is known, an empty command is refused, all is free."""
    from ..functions.values import exec_status

    status, error, message = exec_status(F.col("exit"))
    unknown, empty = ~_is("exec"), F.coalesce(F.col("cmd"), F.lit("")) == ""
    return commands.select(
        "*", F.when(unknown | empty, "error").otherwise(status).alias("status"), F.when(unknown, "UnknownAction").when(empty, "ActionRefused").otherwise(error).alias("error"),
        F.when(unknown, "only exec is known").when(empty, "exec needs cmd").otherwise(message).alias("message"), F.lit(0).alias("cost"),
    )
