"""The episode loop as a stateful operator: any task, any costs, events in order of arrival by run."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.loop import Tasks, params_of, play_on, step
from ..operators.ordered import stage, stored

OUT = "run_id string, t int, action string, status string, error string, cost int, observation string"
STATE = "state string"

def episodes(stream: DataFrame, tasks: Tasks, initial: dict) -> DataFrame:
    """Rows ``OUT`` for a stream of (run_id, seq, action, params): within a batch by ``seq``, between batches as they come.

    ``params`` is JSON or null. A run's state is one JSON object, kept by Spark.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {"t": 0, **json.loads(json.dumps(initial))}
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for action, params in zip(rows["action"], rows["params"]):
            status, error, _, cost, seen = step(now, tasks, action, params_of(params))
            out.append((key[0], now["t"], action, status, error, cost, None if seen is None else json.dumps(seen, separators=(",", ":"))))
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return stream.groupBy("run_id").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")


def run_batches(stream: DataFrame, order: list[str], path: str, checkpoint: str, tasks: Tasks, initial: dict, start: DataFrame | None = None) -> int:
    """Take what has arrived of ``stream`` (run_id, action, params and ``order``) through the loop, batch by batch, and give how many batches there were.

    Each batch is folded as a table (``loop.play_on``), so that no run of it, however hot, is one task's frame. It goes on from the states that
    the batch before left, the first one from ``start`` (run_id, state): snapshots, say. Results lie under ``path``/rows, states, one
    whole table for each batch, under ``path``/states. A batch that is run again replaces itself.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The states of the last batch that was finished before this one.
        done = [n for n in range(number) if stored(spark, f"{path}/states/batch={n}/_SUCCESS")]
        held = spark.read.schema("run_id string, state string").parquet(f"{path}/states/batch={done[-1]}") if done else start
        rows, states = play_on(stage(batch, "episodes"), order, tasks, initial, start=held)
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        states.write.mode("overwrite").parquet(f"{path}/states/batch={number}")

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"])
