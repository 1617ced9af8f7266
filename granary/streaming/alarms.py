"""Alarms on live streams of steps: a state a run (its peak, and whether it was warned of), which goes when the run has been idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def memory_alarms(steps: DataFrame, limit: float, value: str = "memory", by: str = "experiment_id", every: int = 1, idle: str | None = None) -> DataFrame:
    """steps: a stream of by, step (long) and value (double). Rows of by (string), step, peak: one for each run, when its value is over the limit for the first time, with the least such step of the batch in which it is seen.
    Only steps that `every` divides are looked at; null values and steps are left out.

    The state of a run is one number and one mark, whatever its length, and a run's rows pass by in pieces. Steps that come after the alarm change nothing, later batches' lower ones too. idle (as `2 hours`): a run of which
    nothing came for so long is forgotten, and warned of anew if it comes back."""
    gone = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def watch(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        peak, warned = state.get if state.exists else (float("-inf"), False)
        first: tuple[int, float] | None = None
        for p in pieces:
            peak = max(peak, p["value"].max())
            over = p[p["value"] > limit]
            if not warned and len(over):
                step = int(over["step"].min())
                top = float(over.loc[over["step"] == step, "value"].max())
                if first is None or (step, -top) < (first[0], -first[1]):
                    first = step, top
        state.update((float(peak), warned or first is not None))
        if gone:
            state.setTimeoutDuration(gone)
        if first:
            yield pd.DataFrame({"by": [key[0]], "step": [first[0]], "peak": [first[1]]})

    kept = steps.select(F.col(by).cast("string").alias("by"), F.col("step").cast("long").alias("step"), F.col(value).cast("double").alias("value")).filter((F.col("step") % every == 0) & F.col("value").isNotNull() & F.col("by").isNotNull())
    timeout = GroupStateTimeout.ProcessingTimeTimeout if gone else GroupStateTimeout.NoTimeout
    found = kept.groupBy("by").applyInPandasWithState(watch, "by string, step long, peak double", "peak double, warned boolean", "append", timeout)
    return found.withColumnRenamed("by", by)
