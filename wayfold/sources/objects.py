"""Stored objects: pretty-printed JSON events, snapshots, prompts, JSON-lines trajectories, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.values import event_uri, prompt_uri


def read_events(spark: SparkSession, root: str, run_id: str | None = None, span_id: str | None = None) -> DataFrame:
    """Events under ``root``, one object a file, with ``event_uri``; run and span narrow the folders that are listed."""
    path = f"{root}/runs/{run_id or '*'}/spans/{span_id or '*'}/events"
    rows = spark.read.schema(schemas.EVENT).option("multiLine", True).json(f"{path}/*.json")
    return rows.withColumn("event_uri", F.regexp_extract(F.col("_metadata.file_path"), "(runs/.*)$", 1))


def _write_lines(rows: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines, added to what is there: sorted over files of a size, not a file or folder for each key."""
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("append").json(path)


def write_events(events: DataFrame, root: str) -> None:
    """Events as JSON lines by run, span and t: batches, where single objects would make a file each."""
    _write_lines(events, f"{root}/batches", ["run_id", "span_id", "t"])


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """The events of all batches, with the uri that each has as an object."""
    rows = spark.read.schema(schemas.EVENT).json(f"{root}/batches")
    return rows.withColumn("event_uri", event_uri(F.col("run_id"), F.col("span_id"), F.col("t")))


def write_snapshots(rows: DataFrame, root: str, name: str = "metadata") -> None:
    """``metadata`` or ``episode`` rows, each with its state_id, as batches."""
    _write_lines(rows, f"{root}/snapshot-batches/{name}", ["state_id"])


def read_snapshot_batches(spark: SparkSession, root: str, name: str = "metadata") -> DataFrame:
    schema = {"metadata": schemas.METADATA, "episode": f"state_id string, {schemas.EPISODE}"}[name]
    return spark.read.schema(schema).json(f"{root}/snapshot-batches/{name}")


def with_snapshots(states: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``states`` with ``snapshot``, what is stored for each, and ``error``: StateNotFound where nothing is."""
    stored = snapshots.select("state_id", F.struct(*[c for c in snapshots.columns if c != "state_id"]).alias("snapshot"))
    return states.join(stored, "state_id", "left").withColumn("error", F.when(F.col("snapshot").isNull(), "StateNotFound"))


def write_prompts(prompts: DataFrame, root: str) -> None:
    """(run_id, state_id, prompt) as batches; a null prompt is not stored."""
    rows = prompts.where("prompt is not null").select(prompt_uri(F.col("run_id"), F.col("state_id")).alias("prompt_uri"), "prompt")
    _write_lines(rows, f"{root}/prompt-batches", ["prompt_uri"])


def read_prompt_batches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("prompt_uri string, prompt string").json(f"{root}/prompt-batches")


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """A trajectory: one event a line."""
    return spark.read.schema(schemas.EVENT).json(path)


def write_trajectory(events: DataFrame, path: str) -> None:
    """Events by run, span and t as JSON lines; replaces what is there."""
    events.repartitionByRange("run_id", "span_id", "t").sortWithinPartitions("run_id", "span_id", "t").write.mode("overwrite").json(path)


def read_snapshots(spark: SparkSession, root: str, name: str = "metadata") -> DataFrame:
    """``metadata`` or ``episode`` of all snapshots, with their state_id from the folder."""
    schema = {"metadata": schemas.METADATA, "episode": schemas.EPISODE}[name]
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/snapshots/*/{name}.json")
    return rows.withColumn("state_id", F.regexp_extract(F.col("_metadata.file_path"), "snapshots/([^/]*)/", 1))


def snapshot_events(episodes: DataFrame) -> DataFrame:
    """The events that snapshots hold, one a row."""
    return episodes.select("state_id", F.explode("rows").alias("e")).select("state_id", "e.*")


def read_prompts(spark: SparkSession, root: str) -> DataFrame:
    """(prompt_uri, prompt): whole prompts as JSON text."""
    rows = spark.read.option("wholetext", True).text(f"{root}/runs/*/prompts/*.json")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), "(runs/.*)$", 1).alias("prompt_uri"), F.col("value").alias("prompt"))


def with_prompt_uri(states: DataFrame) -> DataFrame:
    return states.withColumn("prompt_uri", prompt_uri(F.col("run_id"), F.col("state_id")))


def write_table(table: DataFrame, path: str, sort: list[str]) -> None:
    """Parquet, range partitioned and sorted, so that row-group statistics prune lookups by the leading columns."""
    by = [F.col(c) for c in sort]
    table.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
