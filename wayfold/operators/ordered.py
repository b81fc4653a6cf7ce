"""Staging, and running sums over ordered groups of any size.

Groups of up to ``LARGE`` rows are summed by a window each. The rows of larger ones are range partitioned by key
and order, so that a group spans many tasks; sums run within each part, and what earlier parts of the same group
hold is added from a table of at most one group a part.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .errors import WayfoldError

#: Rows of a group that one task may sort and sum; larger groups are cut into parts. The rows that result are the same.
LARGE = 1_000_000
#: What may be broadcast: rows, and bytes of their strings.
MOST_ROWS, MOST_BYTES = 100_000, 64 << 20
#: Keys that hold more than this share of all rows are hot: there are fewer than a thousand of them.
HOT_SHARE = 1e-3


def shared_dir(spark: SparkSession) -> str:
    """The folder that all of this session's staged files are under, in the cluster's shared folder, ``spark.checkpoint.dir``.

    Where that is unset a local session (tests, bench) gets a folder of its own; on a cluster, whose executors
    do not see the driver's disk, it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise WayfoldError("NoSharedFolder", "set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_staged(spark: SparkSession) -> None:
    """Remove what this session has staged. Results that were not written elsewhere can no longer be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _extent(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df``, and the bytes of their strings."""
    texts = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return tuple(x or 0 for x in df.agg(F.count("*"), F.sum(sum(texts, F.lit(0).cast("long")))).first())


def small(df: DataFrame, max_rows: int = MOST_ROWS, max_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``max_rows`` rows, and ``max_bytes`` in their strings, else as
    it is (a shuffle join follows).

    ``df`` should be staged: measuring it is an action of its own.
    """
    rows, size = _extent(df)
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def with_facts(rows: DataFrame, facts: DataFrame, key: str, hot: Column) -> DataFrame:
    """``rows`` joined with ``facts``, which are staged, on ``key``, nulls alike; a hot key's rows stay in the tasks that hold them.

    ``hot`` tells from the facts which keys hold more than ``HOT_SHARE`` of all rows: at most a thousand, so these
    are broadcast, if a key has one row of facts or few; all others meet in a shuffle, where none fills a task. Facts
    of hot keys that are more than may be broadcast meet their rows in a shuffle as well.
    """
    on = F.col(key).eqNullSafe(F.col(f"_f_{key}"))
    out = [*[F.col(c) for c in rows.columns], *[F.col(f"_f_{c}").alias(c) for c in facts.columns if c != key]]
    named = facts.select(*[F.col(c).alias(f"_f_{c}") for c in facts.columns], F.coalesce(hot, F.lit(False)).alias("_hot"))
    held, size = _extent(named.where("_hot"))
    if not held or held > MOST_ROWS or size > MOST_BYTES:
        return rows.join(named, on).select(*out)
    both = rows.join(F.broadcast(named.where("_hot")), on, "left")
    rare = both.where("_hot is null").select(*rows.columns).join(named.where("not _hot"), on)
    return both.where("_hot").select(*out).unionByName(rare.select(*out))


def ordered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_part`` and ``_seq``: sorted by key and order over all parts. The order should be total."""
    by = [F.col(c).asc_nulls_last() for c in (*keys, *order)]
    return stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")), "ordered")


def running(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows of ``ordered`` with the sums up to and with each row of its key, as longs."""
    within = W.partitionBy(*keys, "_part").orderBy("_seq").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*[f"k_{k}" for k in keys]).orderBy("k_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("_part").alias("k_part")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    carried = parts.select(*[f"k_{k}" for k in keys], "k_part", *[F.sum(n).over(earlier).alias(f"c_{n}") for n in sums], F.count("*").over(earlier).alias("behind")).where("behind > 0")
    on = F.col("_part") == F.col("k_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    # In sorted order a part goes on with one key at most: no more rows than parts.
    both = rows.select("*", *[F.sum(c).over(within).alias(f"w_{n}") for n, c in sums.items()]).join(F.broadcast(carried), on, "left")
    return both.select(*rows.columns, *[(F.col(f"w_{n}") + F.coalesce(f"c_{n}", F.lit(0))).cast("long").alias(n) for n in sums])


#: Adds to rows the sums, by name, up to and with each row of its key.
Add = Callable[[DataFrame, dict[str, Column]], DataFrame]


def by_size(rows: DataFrame, keys: list[str], order: list[str], body: Callable[[DataFrame, Add], DataFrame]) -> DataFrame:
    """``body`` over all groups of ``rows``, with the way of summing that a group's size asks for.

    ``body`` gets rows and a function that adds running sums to them, which it may call again and again. The order
    should be total. The sizes are counted first, from the keys alone.
    """
    window = W.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(W.unboundedPreceding, 0)

    def by_window(some: DataFrame, sums: dict[str, Column]) -> DataFrame:
        return some.select("*", *[F.sum(c).over(window).cast("long").alias(n) for n, c in sums.items()])

    def by_parts(some: DataFrame, sums: dict[str, Column]) -> DataFrame:
        return stage(running(some, keys, sums), "sums")

    large = rows.groupBy(*[F.col(k).alias(f"l_{k}") for k in keys]).count().where(F.col("count") > LARGE).drop("count")
    if not large.take(1):
        return body(rows, by_window)
    large, on = small(stage(large, "large")), F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"l_{k}"))
    rest, parts = body(rows.join(large, on, "left_anti"), by_window), body(ordered(rows.join(large, on, "left_semi"), keys, order), by_parts)
    return rest.unionByName(parts.drop("_part", "_seq"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """``rows`` with their place in their group, from 1."""
    return by_size(rows, keys, order, lambda some, add: add(some, {name: F.lit(1)}))
