"""Series continuity as streaming state: the length of the current run decides which rows can be scored."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelworks.functions.calendar import HOUR, epoch_seconds


def _continue_runs(keys: list[str], ts: str, window: int, step_seconds: int, keep_seconds: int):
    def update(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values("_sec", kind="stable").reset_index(drop=True)
        last, length = state.get if state.exists else (None, 0)
        seconds = rows["_sec"].to_numpy()
        # A row that is not later than all before it comes too late to be placed: it leaves by the side, the run goes on.
        furthest = np.concatenate([[seconds[0] - 1 if last is None else last], seconds[:-1]])
        late = seconds <= np.maximum.accumulate(furthest)
        known = seconds[~late]
        places = np.zeros(len(known), dtype=np.int64)
        if len(known):
            before = np.concatenate([[known[0] if last is None else last], known[:-1]])
            # A row that does not follow the one before it begins a run; the first rows may go on with the run so far.
            begins = np.where(known - before != step_seconds, np.arange(len(known)), -1)
            begin = np.maximum.accumulate(begins)
            places = np.arange(len(known)) - np.where(begin < 0, -length, begin)
            last, length = int(known[-1]), int(places[-1]) + 1
            state.update((last, length))
        # After that time without a row the run cannot go on, and nothing has to be remembered.
        state.setTimeoutTimestamp(max((last + keep_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame({name: [value] * len(rows) for name, value in zip(keys, key)})
        out[ts] = rows[ts].to_numpy()
        out["run_position"] = pd.array([pd.NA] * len(rows), dtype="Int64")
        out.loc[~late, "run_position"] = places
        out["evaluable"] = np.zeros(len(rows), dtype=bool)
        out.loc[~late, "evaluable"] = places >= window
        out["late"] = late
        yield out

    return update


def continuity_stream(
    stream: DataFrame, keys: Sequence[str], ts: str, window: int, step_seconds: int = HOUR, watermark: str = "2 days"
) -> DataFrame:
    """Run position and evaluable flag per row, and whether it came ``late``.

    The state per series is the time of its last row and the length of its current run. An event-time timer removes it
    when the watermark has passed the row that would have to follow, so finished series leave nothing behind. A row that is not
    later than the last one of its series has no position and is marked late instead of stopping the stream; rows behind the
    watermark are dropped by Spark, which counts them. One batch of one series is bounded by the hours the batch covers.
    """
    keys = list(keys)
    second = epoch_seconds(F.col(ts))
    ready = stream.select(*keys, ts, second.alias("_sec"), F.timestamp_seconds(second).alias("_time")).withWatermark("_time", watermark)
    fields = [stream.schema[name] for name in [*keys, ts]]
    output = T.StructType(
        [*fields, T.StructField("run_position", T.LongType()), T.StructField("evaluable", T.BooleanType()), T.StructField("late", T.BooleanType())]
    )
    state = T.StructType([T.StructField("last", T.LongType()), T.StructField("length", T.LongType())])
    return ready.groupBy(*keys).applyInPandasWithState(
        _continue_runs(keys, ts, window, step_seconds, step_seconds), output, state, "append", GroupStateTimeout.EventTimeTimeout
    )


def placed(rows: DataFrame) -> DataFrame:
    """The rows with a position."""
    return rows.filter("not late").drop("late")


def late_rows(rows: DataFrame) -> DataFrame:
    """The side output."""
    return rows.filter("late").drop("late", "run_position", "evaluable")
