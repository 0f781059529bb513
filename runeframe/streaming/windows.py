"""Counts over streams of events: by time windows with late events, and by key with state of one's own."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(events: DataFrame, width: str, delay: str, by: list[str], ts: str = "ts") -> DataFrame:
    """by, start, n: events by window. On a stream, a window takes events up to delay behind the latest seen, and its state is dropped then; later ones don't count."""
    counted = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, F.col("window.start").alias("start"), "n")


def running_runs(events: DataFrame, key: str, sym: str, order: str) -> DataFrame:
    """key, runs, length, last: for each key that a batch touches, runs of one symbol so far, the length of the one that goes on, and its symbol. Within a batch events count in order."""
    key_kind = events.schema[key].dataType.simpleString()

    def update(name: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, length, last = state.get if state.exists else (0, 0, "")
        for symbol in pd.concat(frames).sort_values(order)[sym]:
            runs, length, last = (runs, length + 1, last) if runs and symbol == last else (runs + 1, 1, symbol)
        state.update((runs, length, last))
        yield pd.DataFrame({key: [name[0]], "runs": [runs], "length": [length], "last": [last]})

    return events.select(key, sym, order).groupBy(key).applyInPandasWithState(update, f"{key} {key_kind}, runs long, length long, last string", "runs long, length long, last string", "update", GroupStateTimeout.NoTimeout)


def store_latest(updates: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Starts writing a stream of updates under path, a folder a batch, which a repeated batch replaces; latest() reads what holds in the end."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key of what store_latest() wrote."""
    values = [c for c in stored.columns if c not in (*keys, "batch")]
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")
