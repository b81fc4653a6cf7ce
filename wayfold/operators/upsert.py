"""Keyed writes: upserts whose columns are first-wins or last-wins, and inserts that reject repeated keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import WayfoldError
from .ordered import LARGE

#: Fixed values: (keys, first-wins, last-wins) of the stored tables.
SPAN_EVENTS_RULE = (["span_id", "t"], ["run_id", "sandbox_id", "ts", "action", "cost", "protocol"], ["status", "observation", "event_uri"])
SPANS_RULE = (["span_id"], ["run_id", "from_state_id", "t_start", "created_at"], ["to_state_id", "t_end", "sandbox_id"])
SPAN_INDEX_RULE = (["span_id", "t"], [], ["event_uri", "action", "status"])


#: Rows that a task sorts, about; parts by which keys of more than ``LARGE`` rows are found.
TASK_ROWS, PARTS = 250_000, 1 << 16


def by_key(writes: DataFrame, keys: list[str], ends: Callable[[DataFrame], DataFrame], within: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """``ends``, an aggregation by ``keys``, of all ``writes``: rows meet by key, as they are, in tasks of about ``TASK_ROWS`` rows however many there are.

    Aggregates of structs are made from sorted rows: partial ones would sort all rows of a task that reads, and move wider rows than these. A key
    of more than ``LARGE`` rows has partial ones all the same, so that none fills a task. The rows are counted first, from the keys alone.
    ``within`` deals the rows to so many tasks, if not by key.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS))
    counts = writes.groupBy(part.alias("part")).count()
    total, hot = counts.agg(F.sum("count"), F.collect_list(F.when(F.col("count") > LARGE, F.col("part")))).first()
    tasks = max(1, -(-(total or 0) // TASK_ROWS))
    deal = within or (lambda rows, n: rows.repartition(n, *keys))
    if not hot:
        return ends(deal(writes, tasks))
    return ends(deal(writes.where(~part.isin(hot)), tasks)).unionByName(ends(writes.where(part.isin(hot))))


def partial_upsert(writes: DataFrame, keys: list[str], seq: list[str], first: list[str], last: list[str], dealt: bool = False) -> DataFrame:
    """One row a key after all writes in order of ``seq``, which must be total: ``first`` keep what the first
    write gave, ``last`` what the last gave, nulls included. One aggregation, so a hot key costs no more than its tasks' rows: with partial
    sums, or ``dealt`` (see ``by_key``), for stored writes, since they are read twice."""
    at = F.struct(*seq)
    kept = [F.min_by(F.struct(*first), at).alias("f")] if first else []
    ends = lambda rows: rows.groupBy(*keys).agg(*kept, F.max_by(F.struct(*last), at).alias("l")).select(*keys, *[f"f.{c}" for c in first], *[f"l.{c}" for c in last])
    return by_key(writes, keys, ends) if dealt else ends(writes)


def write_ends(writes: DataFrame, keys: list[str], seq: list[str], within: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The writes that may still matter: the first and the last of each key. ``within`` as in ``by_key``."""
    at, columns = F.struct(*seq), writes.columns

    def ends(rows: DataFrame) -> DataFrame:
        both = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), at).alias("a"), F.max_by(F.struct(*columns), at).alias("b"))
        return both.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("w")).select("w.*")

    return by_key(writes, keys, ends, within)


def insert_only(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows``; an error if a key is there already or comes twice."""
    twice = rows.groupBy(key).count().where("count > 1").select(key)
    clash = rows.select(key).join(table.select(key), key, "left_semi").unionByName(twice).take(1)
    if clash:
        raise WayfoldError("DuplicateKey", f"{key} {clash[0][0]!r} is there already")
    return table.unionByName(rows)
