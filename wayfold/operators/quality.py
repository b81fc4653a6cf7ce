"""Checks of what the stored tables promise: keys, references, values, gaps, agreement of layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import TEXT_LIMIT, summary_text
from .ordered import numbered


def repeated_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(table: DataFrame, column: str, referred: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference leads nowhere."""
    return table.where(F.col(column).isNotNull()).join(referred.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def outside(table: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    return table.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def gaps(events: DataFrame, key: str = "span_id", t: str = "t") -> DataFrame:
    """(key, after, missing): holes in the run of ``t``; reported, not mended, since gaps are legal.

    Distinct values are numbered; where value less number changes, some are missing.
    """
    rows = numbered(events.select(F.col(key).alias("key"), F.col(t).cast("long").alias("t")).distinct(), ["key"], ["t"])
    islands = rows.groupBy("key", (F.col("t") - F.col("nth")).alias("shift")).agg(F.max("t").alias("last"), F.max("nth").alias("last_nth"), F.min("t").alias("first"), F.min("nth").alias("first_nth"))
    # The island before is the one whose last number is one less than this one's first.
    before = islands.select("key", F.col("last").alias("after"), (F.col("last_nth") + 1).alias("first_nth"))
    return islands.join(before, ["key", "first_nth"]).select(F.col("key").alias(key), "after", (F.col("first") - F.col("after") - 1).alias("missing"))


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that one layer lacks or that differ in one of ``columns``, with what is wrong."""
    left, right = (df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in columns], F.lit(True).alias(side)) for df, side in ((a, "a"), (b, "b")))
    same: Column = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    wrong = F.when(F.col("b").isNull(), "only first").when(F.col("a").isNull(), "only second").when(~same, "differ")
    return left.join(right, keys, "full").select(*keys, wrong.alias("wrong")).where("wrong is not null")


def cut_observations(events: DataFrame) -> DataFrame:
    """Events whose stored observation is not whole: it is a stored summary with its note, or the summary made of it is not the stored one.

    The summary of 414 characters is its own summary again, so it is compared itself; a whole text of that length which ends in its own note can't be told from one."""
    whole = summary_text(F.col("observation")).eqNullSafe(F.col("obs_summary")) & ~(F.col("observation").eqNullSafe(F.col("obs_summary")) & (F.length("obs_summary") > TEXT_LIMIT))
    return events.where(F.col("obs_summary").isNotNull() & ~whole)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
