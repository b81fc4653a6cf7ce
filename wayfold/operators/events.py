"""Events: the analytics projection, filtered and point lookups, spans with their events, rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import event_uri, falsy
from .errors import WayfoldError
from .ordered import numbered
from .upsert import SPAN_EVENTS_RULE, partial_upsert


def span_events(events: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """The analytics columns of whole events, with the defaults for missing values; a projection, no second write."""
    return events.select(
        *(more or []),
        falsy(F.col("run_id"), "").alias("run_id"), falsy(F.col("span_id"), "").alias("span_id"), "sandbox_id", F.col("t").cast("int"), F.col("ts").cast("double"), falsy(F.col("action"), "").alias("action"), falsy(F.col("status"), "").alias("status"),
        falsy(F.col("cost").cast("int"), 0).alias("cost"), event_uri(F.coalesce("run_id", F.lit("")), F.coalesce("span_id", F.lit("")), F.col("t")).alias("event_uri"), "observation", falsy(F.col("protocol").cast("int"), 1).alias("protocol"),
    )


def span_index(events: DataFrame) -> DataFrame:
    return span_events(events).select("span_id", "t", "event_uri", "action", "status")


def query_events(table: DataFrame, run_id: str | None = None, span_id: str | None = None, action: str | None = None) -> DataFrame:
    """Rows that equal all the given values, by run, span and t. None and '' filter nothing."""
    for name, value in (("run_id", run_id), ("span_id", span_id), ("action", action)):
        table = table.where(F.col(name) == value) if value else table
    return table.orderBy("run_id", "span_id", "t")


def one(table: DataFrame, code: str, **key: object) -> dict:
    """The row with this key as a dict, else an error of this code. States and runs: StateNotFound; spans and events: SpanNotFound."""
    for name, value in key.items():
        table = table.where(F.col(name) == value)
    if not (found := table.take(1)):
        raise WayfoldError(code, f"no row with {key}", **key)
    return found[0].asDict(recursive=True)


def found(wanted: DataFrame, key: str, table: DataFrame, code: str) -> DataFrame:
    """``wanted`` keys with their rows of ``table`` and ``error``, the code where there is none: lookups in bulk."""
    there = table.withColumn("_there", F.lit(True))
    return wanted.join(there, key, "left").withColumn("error", F.when(F.col("_there").isNull(), code)).drop("_there")


def get_event(table: DataFrame, span_id: str, t: int) -> dict:
    return one(table, "SpanNotFound", span_id=span_id, t=t)


def get_span(spans: DataFrame, index: DataFrame, events: DataFrame, span_id: str) -> tuple[dict, DataFrame]:
    """A span's row and its whole events in order, found through the index."""
    mine = index.where(F.col("span_id") == span_id).select("span_id", "t")
    return one(spans, "SpanNotFound", span_id=span_id), mine.join(events, ["span_id", "t"]).orderBy("t")


def span_steps(events: DataFrame) -> DataFrame:
    """All events in their spans with their place there, ``nth``, by t: rows, since one span may hold most events."""
    return numbered(events, ["span_id"], ["t"])


def with_prompts(states: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every state, with its prompt where there is one."""
    return states.join(prompts, "prompt_uri", "left")


def rebuild(events: DataFrame, seq: list[str]) -> DataFrame:
    """The analytics table anew from all stored events; of events with one (span_id, t) the later in ``seq``
    replace what may change. Running it again gives the same rows."""
    keys, first, last = SPAN_EVENTS_RULE
    return partial_upsert(span_events(events, [F.struct(*seq).alias("written")]), keys, ["written"], first, last)
