"""Panels: long tables with a unit, a time and values.

Missing values are null; NaN and infinities become null at ingest (`clean`).
Windows run within a unit, so a panel is dealt once by unit and stays there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import finite


def clean(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(finite(F.col(c)), F.col(c)) for c in columns})


def sentinel_null(df: DataFrame, column: str, sentinel: float = -9999.0) -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(sentinel)))


def spine(units: DataFrame, times: DataFrame) -> DataFrame:
    """Every unit at every time: the balanced panel's rows, a product by
    definition.  The time axis, hundreds of rows, is sent to the units."""
    return units.crossJoin(F.broadcast(times))


def on_spine(full: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    return full.join(values, keys, "left")


def period_index(df: DataFrame, ts: str = "ts", name: str = "t") -> DataFrame:
    """`df` with the rank of its time among the distinct times, from 0.  The
    ranking runs over the distinct times only, never over the rows."""
    times = df.select(ts).distinct()
    ranked = times.withColumn(name, (F.row_number().over(Window.orderBy(ts)) - 1).cast("int"))
    return df.join(F.broadcast(ranked), ts)


def first_periods(df: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """The rows of the first `n` distinct times."""
    kept = df.select(ts).distinct().orderBy(ts).limit(n)
    return df.join(F.broadcast(kept), ts, "left_semi")


def fill_gaps(panel: DataFrame, unit: str = "pixel_id", ts: str = "ts", value: str = "y", name: str = "filled") -> DataFrame:
    """Linear interpolation in actual time within a unit; the first and last
    values extend to the ends, and a unit without any value stays null."""
    before = Window.partitionBy(unit).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(unit).orderBy(ts).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.unix_micros(F.to_timestamp(ts)).cast("double"))
    held = panel.withColumn("__at", at).withColumns({
        "__y0": F.last(value, True).over(before), "__t0": F.last("__at", True).over(before),
        "__y1": F.first(value, True).over(after), "__t1": F.first("__at", True).over(after),
    })
    now = F.unix_micros(F.to_timestamp(ts)).cast("double")
    share = F.try_divide(now - F.col("__t0"), F.col("__t1") - F.col("__t0"))
    first, last = (F.col(c).cast("double") for c in ("__y0", "__y1"))
    line = first + share * (last - first)
    filled = F.coalesce(F.col(value), line, F.col("__y0"), F.col("__y1"))
    return held.withColumn(name, filled).drop("__at", "__y0", "__t0", "__y1", "__t1")


def gap_counts(panel: DataFrame, before: str, after: str) -> DataFrame:
    return panel.agg(F.count_if(F.col(before).isNull()).alias("before"), F.count_if(F.col(after).isNull()).alias("after"))


def shift(value: str | Column, k: int, unit: list[str], t: str = "t") -> Column:
    """The value exactly k periods earlier in the unit, null if that period is
    absent.  A range frame, unlike lag(), does not bridge gaps."""
    frame = Window.partitionBy(*unit).orderBy(t).rangeBetween(-k, -k)
    return F.max(value).over(frame)


def panel_lags(panel: DataFrame, unit: str = "pixel_id", t: str = "t", value: str = "y") -> DataFrame:
    """dy = y(t) - y(t-1), dyl = y(t-1) - y(t-2), l2 = y(t-2), l3 = y(t-3), on a
    balanced spine, where row and period coincide."""
    w = Window.partitionBy(unit).orderBy(t)
    lag = [F.col(value), *[F.lag(value, k).over(w) for k in (1, 2, 3)]]
    return panel.withColumns({"dy": lag[0] - lag[1], "dyl": lag[1] - lag[2], "l2": lag[2], "l3": lag[3]})


def keyed_lags(panel: DataFrame, unit: list[str], t: str = "t", value: str = "y", orders: tuple[int, ...] = (1, 2, 3), keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(unit, t, keep, value, lag1, ...): the value exactly k periods earlier, null if
    that period is absent, of a panel with one row a unit and integer period.

    Every row goes to its own period and those that look back at it, in one aggregate
    by unit and period.  So a unit with any share of the rows is spread over all tasks,
    which a window by unit would not do; where units are short, `shift` moves less."""
    moved = panel.select(*unit, t, *keep, value, F.explode(F.array(*[F.lit(k) for k in (0, *orders)])).alias("__k"))
    moved = moved.withColumn(t, F.col(t) + F.col("__k"))
    own = lambda c, k=0: F.max(F.when(F.col("__k") == k, F.col(c)))
    found = moved.groupBy(*unit, t).agg(F.min("__k").alias("__k"), *[own(c).alias(c) for c in (*keep, value)], *[own(value, k).alias(f"lag{k}") for k in orders])
    return found.filter("__k = 0").drop("__k")


def change_points(df: DataFrame, unit: str, order: list[str]) -> DataFrame:
    """The first row of each unit in the given order."""
    w = Window.partitionBy(unit).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_observation(panel: DataFrame, unit: str = "pixel_id", ts: str = "ts", value: str = "y") -> DataFrame:
    """(unit, month, y0): the earliest value of each unit, 0 without any, for all twelve months."""
    first = panel.groupBy(unit).agg(F.coalesce(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(ts))), F.lit(0.0)).alias("y0"))
    return first.select(unit, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), "y0")


def season_baseline(panel: DataFrame, unit: str = "pixel_id", ts: str = "ts", value: str = "y", base_year: int | None = None) -> DataFrame:
    """(unit, month, y0): the unit's mean in that calendar month of the base
    year (by default the first), else its mean of the base year, else 0.  If no
    row is of the base year, all rows count as if they were."""
    year = F.year(ts)
    if base_year is None:
        base_year = panel.agg(F.min(year)).first()[0]
    present = panel.agg(F.max(F.when(year == base_year, 1))).first()[0]
    base = panel.filter(year == base_year) if present else panel
    months = base.groupBy(unit, F.month(ts).alias("month")).agg(F.avg(value).alias("own"))
    whole = base.groupBy(unit).agg(F.avg(value).alias("mean"))
    every = panel.select(unit).distinct().select(unit, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    found = every.join(months, [unit, "month"], "left").join(whole, unit, "left")
    return found.select(unit, "month", F.coalesce("own", "mean", F.lit(0.0)).alias("y0"))


def with_baseline(panel: DataFrame, baseline: DataFrame, unit: str = "pixel_id", ts: str = "ts") -> DataFrame:
    """`panel` with y0 of its calendar month."""
    return panel.withColumn("month", F.month(ts)).join(baseline, [unit, "month"], "left")


def finite_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all of the columns are finite."""
    test = F.lit(True)
    for c in columns:
        test = test & finite(F.col(c))
    return df.filter(test)


def after_base_year(df: DataFrame, base_year: int, ts: str = "ts") -> DataFrame:
    return df.filter(F.year(ts) > base_year)


def monthly_mean(df: DataFrame, ts: str, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("month", ts).cast("timestamp_ntz").alias("month")).agg(F.avg(value).alias(value))


def bin_mean(df: DataFrame, resolution: float, value: str, lat: str = "latitude", lon: str = "longitude", *keys: str) -> DataFrame:
    """Means over square bins of `resolution` degrees."""
    cell = lambda c: F.floor(F.col(c) / resolution).cast("long")
    return df.groupBy(*keys, cell(lat).alias("bin_lat"), cell(lon).alias("bin_lon")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))


def demean(df: DataFrame, *columns: str) -> DataFrame:
    """Columns less their means: one small aggregate, sent to the rows."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.col(c) - F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def finite_share(panel: DataFrame, value: str, ts: str = "ts") -> DataFrame:
    return panel.groupBy(ts).agg(F.avg(finite(F.col(value)).cast("double")).alias("share"))
