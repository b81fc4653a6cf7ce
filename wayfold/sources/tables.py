"""Stored tables that the catalog knows, bucketed by their keys.

Tables of one bucketing join on it without a shuffle, and a lookup by key reads one bucket's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed choice: the keys that each table is bucketed and sorted by.
LAYOUT = {"runs": (["run_id"], ["run_id"]), "states": (["run_id"], ["run_id", "t"]), "spans": (["span_id"], ["span_id"]), "span_index": (["span_id"], ["span_id", "t"]), "span_events": (["span_id"], ["span_id", "t"])}
#: Files of a bucketed table are as many as its buckets: one for some gigabytes.
BUCKETS = 16


def create_database(spark: SparkSession, name: str, path: str) -> None:
    """A database whose tables lie under ``path``; one of that name stays as it is."""
    spark.sql(f"create database if not exists `{name}` location '{path}'")


def save_table(table: DataFrame, database: str, name: str, buckets: int = BUCKETS) -> None:
    """Store ``table`` under one of the names of ``LAYOUT``, in place of an older one. One file a bucket: rows are dealt by the bucketing first."""
    keys, sort = LAYOUT[name]
    table.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*sort).mode("overwrite").format("parquet").saveAsTable(f"`{database}`.`{name}`")


def catalog(spark: SparkSession, database: str) -> DataFrame:
    """(name, buckets, keys, n) of each stored table of ``database``: its layout as the catalog has it, and its rows, counted from the files' footers."""
    out = spark.createDataFrame([], "name string, buckets int, keys string, n long")
    for t in sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary):
        kept = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe extended `{database}`.`{t}`").collect()}
        layout = F.lit(int(kept.get("Num Buckets", 0))).alias("buckets"), F.lit(kept.get("Bucket Columns", "[]").strip("[]").replace("`", "")).alias("keys")
        out = out.unionByName(spark.table(f"`{database}`.`{t}`").agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), *layout, "n"))
    return out
