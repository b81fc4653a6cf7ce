"""A table of keyed writes in versions: an upsert rewrites the buckets that it touches, and readers keep the version they began with.

Rows are in buckets by a hash of their key. A version is a manifest, one row a bucket, that names the folder in which the bucket
lies; data is written before its manifest, a manifest once and whole, and neither is changed after. So a reader
sees one version from end to end, a writer that fails leaves the table as it was, and of two writers at once the later one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.errors import WayfoldError
from ..operators.upsert import TASK_ROWS, partial_upsert, write_ends

#: A table's buckets; fixed when its first version is written.
BUCKETS = 64
MANIFEST = "version int, bucket int, folder string, buckets int, batch long"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are whole, in order: those whose manifest was finished."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/version=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(f.getPath().getParent().getName().removeprefix("version=")) for f in found or [])


def manifest(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The rows of a version's manifest, the latest one's if None: one for each bucket that holds rows. None are there before the first version."""
    known = versions(spark, path)
    if version is not None and version not in known:
        raise WayfoldError("VersionNotFound", f"no version {version} at {path}")
    if not known:
        return []
    rows = spark.read.schema(MANIFEST).option("basePath", f"{path}/manifests").parquet(f"{path}/manifests/version={version or known[-1]}")
    return sorted(rows.collect(), key=lambda r: r["bucket"])


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def read_writes(spark: SparkSession, path: str, held: list, schema=None) -> DataFrame | None:
    """The stored writes of the buckets of ``held``, manifest rows; None without any."""
    paths = [f"{path}/data/{r['folder']}/bucket={r['bucket']}" for r in held]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths) if paths else None


def upsert_version(writes: DataFrame, path: str, keys: list[str], seq: list[str], buckets: int = BUCKETS, batch: int | None = None) -> int:
    """Add ``writes`` and give the version that has them. Only buckets of their keys are read and written anew.

    Of a key's writes the first and the last by ``seq``, which must be total, are kept. ``batch`` numbers the batches of a stream: one
    that the table has already is left out. No writes make no version. A table keeps the buckets it began with.
    """
    spark, held = writes.sparkSession, manifest(writes.sparkSession, path)
    if held and batch is not None and held[0]["batch"] is not None and held[0]["batch"] >= batch:
        return held[0]["version"]
    buckets = held[0]["buckets"] if held else buckets
    new = writes.withColumn("_bucket", _bucket(keys, buckets))
    touched = {r[0] for r in new.select("_bucket").distinct().collect()}  # as many as buckets at most
    if not touched:
        return held[0]["version"] if held else 0
    old = read_writes(spark, path, [r for r in held if r["bucket"] in touched], writes.schema)
    rows = new if old is None else new.unionByName(old.withColumn("_bucket", _bucket(keys, buckets)))
    folder, version = uuid.uuid4().hex, (held[0]["version"] if held else 0) + 1
    # A bucket is dealt to as many tasks as its rows need; its files are written where its rows were sorted.
    most = rows.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    parts = -(-most // TASK_ROWS)
    rows = rows.withColumn("_sub", F.pmod(F.xxhash64(*keys, F.lit("sub")), F.lit(parts)).cast("int"))
    ends = write_ends(rows, ["_bucket", "_sub", *keys], seq, lambda some, n: some.repartition(min(len(touched) * parts, 4 * n), "_bucket", "_sub"))
    ends.drop("_sub").withColumnRenamed("_bucket", "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    lines = [(r["bucket"], r["folder"]) for r in held if r["bucket"] not in touched] + [(b, folder) for b in sorted(touched)]
    out = spark.createDataFrame([(b, f, buckets, batch) for b, f in lines], "bucket int, folder string, buckets int, batch long")
    # Errors if another writer has made this version in the meantime.
    out.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifests/version={version}")
    return version


def read_version(spark: SparkSession, path: str, keys: list[str], seq: list[str], first: list[str], last: list[str], version: int | None = None) -> DataFrame | None:
    """The table as of ``version`` (None: the latest), one row a key; later upserts don't change it. None before anything came."""
    rows = read_writes(spark, path, manifest(spark, path, version))
    return None if rows is None else partial_upsert(rows, keys, seq, first, last, dealt=True)
