"""Streams: success rates of a growing feedback log, and parameters of arriving frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from coastline.sources.logs import FEEDBACK

FRAME = "series_id string, time double, n_segments bigint, domain_scale double"
PARAMETERS = "series_id string, time double, n_segments bigint, initial_delta double, delta_factor double, num_steps int"
STATE = "count int, n1 double, n2 double, delta double, factor double, steps int, last double, waiting array<struct<time: double, n_segments: bigint, domain_scale: double>>"


def feedback_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_status(stream: DataFrame) -> DataFrame:
    """Totals and success rates per implementation and class so far (update or complete mode)."""
    return stream.groupBy("implementation", "interface_type").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successes"), F.avg(F.col("success").cast("double")).alias("success_rate"))


def status_by_window(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same per window of the records' time; windows older than the watermark are closed."""
    timed = stream.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "implementation").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successes"))


#: Seconds added to a frame's time for its event time: a stream's watermark starts at 0, and frames at 0 would be late.
OFFSET = 86_400.0


def _step(state: tuple, n_segments: float, scale: float) -> tuple:
    """The batch recurrence, one frame at a time: (count, n1, n2, delta, factor, steps)."""
    count, n1, n2, delta, factor, steps = state
    if count == 0:
        delta, factor, steps = scale / 200, 1.4, 15
    elif count == 1:
        delta *= 0.95
    else:
        change = (n1 - n2) / n2 if n2 else None
        if change is not None and change > 0.5:
            delta, factor, steps = delta * 0.8, min(factor + 0.1, 2.0), min(steps + 2, 20)
        elif change is None or change >= 0.1:
            delta, steps = delta * 0.9, steps + 1
    return count + 1, float(n_segments), n1, delta, factor, steps


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Frames wait until the watermark has passed them, and then go on in the order of their times."""
    had = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0, float("-inf"), [])
    now, last, waiting = tuple(had[:6]), had[6], [tuple(w) for w in had[7] or []]
    for frame in frames:
        waiting += [(float(t), int(n), float(z)) for t, n, z in zip(frame["time"], frame["n_segments"], frame["domain_scale"], strict=True) if t > last]
    waiting.sort()
    passed, rows = state.getCurrentWatermarkMs() / 1000 - OFFSET, []
    while waiting and waiting[0][0] <= passed:
        last, n, scale = waiting.pop(0)
        now = _step(now, n, scale)
        rows.append((key[0], last, n, *now[3:]))
    state.update((*now, last, waiting))
    if waiting:
        state.setTimeoutTimestamp(int((max(waiting[0][0], passed) + OFFSET) * 1000) + 1)
    yield pd.DataFrame(rows, columns=["series_id", "time", "n_segments", "initial_delta", "delta_factor", "num_steps"])


def temporal_parameters(frames: DataFrame, late: str = "10 seconds") -> DataFrame:
    """A stream of frames -> their parameters, as in batch.

    ``time`` is the event time in seconds: frames may arrive in any order within
    ``late``; a frame comes out once the watermark has passed it, and one that
    comes after a later frame has come out is left out.
    """
    timed = frames.withColumn("at", F.timestamp_micros(((F.col("time") + OFFSET) * 1_000_000).cast("bigint"))).withWatermark("at", late)
    return timed.groupBy("series_id").applyInPandasWithState(_advance, PARAMETERS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
