"""Events as they arrive: files become a stream, each batch is upserted into the analytics table.

A file source does not see that an object was rewritten in place: corrections need new names or a rebuild.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordered import stored
from ..operators.upsert import partial_upsert, write_ends


def event_stream(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.schema(schemas.EVENT).option("multiLine", True).option("recursiveFileLookup", True).json(root)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All that is stored at ``path``, with ``batch`` and ``base``: the latest base and the batches after it; None if nothing is."""
    # What is there and cannot be read is an error, not an empty table.
    if not any(stored(spark, f"{path}/base={kind}") for kind in ("true", "false")):
        return None
    rows = spark.read.option("basePath", path).parquet(path).withColumns({"base": F.col("base").cast("boolean"), "batch": F.col("batch").cast("long")})
    upto = rows.where("base").agg(F.max("batch")).first()[0]
    return rows if upto is None else rows.where((F.col("base") & (F.col("batch") == upto)) | (~F.col("base") & (F.col("batch") > upto)))


def run_upserts(stream: DataFrame, path: str, checkpoint: str, keys: list[str], seq: list[str], first: list[str], last: list[str]) -> int:
    """Take what has arrived and upsert it: each batch adds the writes that matter in it, and no more.

    First and last writes are found in any order of batches, so the table is all batches together; ``compact`` now
    and then makes one of them. A batch that is run again replaces itself. Returns how many batches there were.
    """
    columns = list(dict.fromkeys([*keys, *seq, *first, *last]))

    def upsert(batch: DataFrame, number: int) -> None:
        write_ends(batch.select(*columns), keys, seq).write.mode("overwrite").parquet(f"{path}/base=false/batch={number}")

    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"])


def compact(spark: SparkSession, path: str, keys: list[str], seq: list[str]) -> None:
    """Make one base of all that is stored; what it was made of is no longer read."""
    rows = _stored(spark, path)
    if rows is not None:
        upto = rows.agg(F.max("batch")).first()[0]
        write_ends(rows.drop("base", "batch"), keys, seq).write.mode("overwrite").parquet(f"{path}/base=true/batch={upto}")


def current(spark: SparkSession, path: str, keys: list[str], seq: list[str], first: list[str], last: list[str]) -> DataFrame | None:
    """The table as it stands; None before anything came."""
    rows = _stored(spark, path)
    return None if rows is None else partial_upsert(rows, keys, seq, first, last, dealt=True)
