"""Tables and the memory of Python workers; staging and size-checked broadcasts are the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.ordered import HOT_SHARE, by_size, numbered, ordered, running, shared_path, small, stage, stored, with_facts

__all__ = ["HOT_SHARE", "by_size", "new_path", "numbered", "ordered", "running", "small", "stage", "stored", "table", "with_facts", "worker_memory"]

new_path = shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_memories: dict[str, dict] = {}


def worker_memory(name: str) -> dict:
    """What an operator remembers in this Python worker, over all its tasks; what other operators remembered is let go."""
    for other in _memories.keys() - {name}:
        _memories.pop(other).clear()
    return _memories.setdefault(name, {})
