"""Means of a stream of observations, and lags of a panel whose months arrive.

An extension: months are independent until they are differenced, so a panel can
grow month by month.  A watermark bounds the state of the means, which are emitted once
they can no longer change; lags need the last three values of each unit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def daily_means(stream: DataFrame, ts: str, value: str, key: str, late: str = "2 days") -> DataFrame:
    """(key, day, value, n) of complete days of a streaming or static table."""
    window = F.window(F.col(ts), "1 day")
    return stream.withWatermark(ts, late).groupBy(key, window.alias("w")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("day"), value, "n")


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Writes what a streaming table emits to a parquet folder, once each, as
    long as there is input."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.format("parquet").option("path", folder).trigger(availableNow=True).start()


#: Columns of `lagged_stream`, and what it keeps of a unit: its latest period and the
#: values there and in the two before.
LAGGED = "{unit}, t int, y double, dy double, dyl double, l2 double, l3 double, late boolean"
_HELD = "last int, y0 double, y1 double, y2 double"


def _advance(held: tuple, t: int, y: float | None) -> tuple[tuple, list[float | None]]:
    """The state after period t, and the values of the three periods before it."""
    last, *values = held
    gap = t - last if last is not None else 4
    earlier = ([None] * (gap - 1) + values)[:3]
    return (t, y, *earlier[:2]), earlier


def lagged_stream(stream: DataFrame, unit: str = "pixel_id", t: str = "t", value: str = "y") -> DataFrame:
    """(unit, t, y, dy, dyl, l2, l3, late): differences and lags of a panel whose periods
    arrive one after another, as the batch operator `panel_lags` gives them.

    A unit keeps its last three values, so the state does not grow with time.  The
    periods of a unit within one micro-batch are taken in order; a period that was left
    out counts as missing.  One that comes when a later one is already out, or again, is
    late: it is emitted with nulls and `late`, and changes nothing, as what rests on it
    has been emitted.  Rows without a unit or period are left out."""
    kind = stream.schema[unit].dataType.simpleString()

    def step(key, frames, state):
        rows = pd.concat(list(frames))
        rows = sorted(zip(rows["t"].tolist(), [None if pd.isna(v) else float(v) for v in rows["y"]], strict=True), key=lambda r: r[0])
        held = tuple(None if pd.isna(v) else v for v in state.get) if state.exists else (None, None, None, None)
        out = []
        for period, y in rows:
            if held[0] is not None and period <= held[0]:
                out.append((key[0], period, y, None, None, None, None, True))
                continue
            held, (y1, y2, y3) = _advance(held, period, y)
            minus = lambda a, b: None if a is None or b is None else a - b
            out.append((key[0], period, y, minus(y, y1), minus(y1, y2), y2, y3, False))
        if held[0] is not None:
            state.update(held)
        yield pd.DataFrame(out, columns=[unit, "t", "y", "dy", "dyl", "l2", "l3", "late"])

    rows = stream.select(unit, F.col(t).cast("int").alias("t"), F.col(value).cast("double").alias("y")).na.drop(subset=[unit, "t"])
    return rows.groupBy(unit).applyInPandasWithState(step, LAGGED.format(unit=f"`{unit}` {kind}"), _HELD, "append", GroupStateTimeout.NoTimeout)
