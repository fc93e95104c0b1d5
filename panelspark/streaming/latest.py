"""Streaming forms of persistence and of windowed panels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

__all__ = ["previous_values", "windowed_panel"]


def previous_values(events: DataFrame, entity: str, ts: str, value: str, delay: str = "10 minutes") -> DataFrame:
    """For each event (entity long, ts, value double): the entity's latest earlier value, by event time; null for its first.

    State is one (time, value) pair for each entity. Within a micro-batch events are ordered by time; an event older
    than the state's is answered with null, as its predecessor is gone.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([ts, value], kind="stable")
        last_t, last_v = state.get if state.exists else (None, None)
        out = []
        for t, v in zip(rows[ts], rows[value], strict=True):
            micros = int(t.value // 1000)
            late = last_t is not None and micros < last_t
            out.append((key[0], t, v, None if late else last_v))
            if not late:
                last_t, last_v = micros, v
        state.update((last_t, last_v))
        yield pd.DataFrame(out, columns=["entity", "ts", "value", "previous"])

    rows = events.select(F.col(entity).cast("long").alias(entity), ts, F.col(value).cast("double").alias(value)).withWatermark(ts, delay)
    return rows.groupBy(entity).applyInPandasWithState(step, "entity long, ts timestamp, value double, previous double", "t long, v double", "append", GroupStateTimeout.NoTimeout)


def windowed_panel(events: DataFrame, keys: list[str], ts: str, value: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by key and tumbling window; late events up to ``delay`` are counted. Works on batches as well."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    return rows.groupBy(*keys, F.window(ts, size).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")
