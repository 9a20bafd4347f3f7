"""The batch windows as streams: event-time sums per sensor and a running mean of its last readings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(readings: DataFrame, key: str, time: str, value: str, length: str = "6 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """key, start, n, mean, greatest of each sliding window; readings later than the watermark do not count."""
    rows = readings.withWatermark(time, late).groupBy(key, F.window(time, length, slide).alias("w"))
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("greatest")).select(key, F.col("w.start").alias("start"), "n", "mean", "greatest")


def running_mean(readings: DataFrame, key: str, order: str, value: str, n: int = 36) -> DataFrame:
    """key, order, roll for each reading: the mean of the key's last n, null until there are n. The state of a key is its
    last n - 1 values, whatever the stream's length. Readings of one micro-batch are put in order."""
    kind, pos = readings.schema[key].dataType.simpleString(), readings.schema[order].dataType.simpleString()

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        values = pd.Series(last + rows[value].tolist(), dtype="float64")
        state.update((values.tolist()[-(n - 1) :] if n > 1 else [],))
        yield pd.DataFrame({key: name[0], order: rows[order].to_numpy(), "roll": values.rolling(n).mean().to_numpy()[len(last) :]})

    return readings.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} {pos}, roll double", "last array<double>", "append", GroupStateTimeout.NoTimeout)
