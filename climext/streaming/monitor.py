"""Structured Streaming: re-scoring arriving values with saved parameters, and running event state for each cell."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import transform_with_params


def rescore(stream: DataFrame, params: DataFrame, value: str = "scaled", distribution: str = "gamma") -> DataFrame:
    """Index of a stream of scaled values: a stream-static join with a calibration, without state."""
    return transform_with_params(stream, params, value, distribution)


def watch(stream: DataFrame, threshold: float = -1.0, value: str = "value") -> DataFrame:
    """(cell_id, time, index_value, is_event, duration, magnitude) for every arriving step, in time order within a batch.

    The state of a cell is four numbers, whatever its history.  Steps older than the cell's last one are dropped: a
    running state can't be revised.
    """
    below = threshold < 0

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, duration, magnitude = state.get if state.exists else (pd.Timestamp.min.value, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("time")
        out = []
        for t, v in zip(pd.to_datetime(rows["time"]), rows[value].astype(float), strict=True):
            if t.value <= last:
                continue
            last = t.value
            hit = bool(v < threshold if below else v > threshold)
            duration, magnitude = (duration + 1, magnitude + abs(v - threshold)) if hit else (0, 0.0)
            out.append((key[0], t, None if v != v else v, hit, duration, magnitude))
        state.update((last, duration, magnitude))
        yield pd.DataFrame(out, columns=["cell_id", "time", "index_value", "is_event", "duration", "magnitude"])

    return stream.groupBy("cell_id").applyInPandasWithState(
        step,
        "cell_id long, time timestamp, index_value double, is_event boolean, duration long, magnitude double",
        "last long, duration long, magnitude double",
        "append",
        GroupStateTimeout.NoTimeout,
    )
