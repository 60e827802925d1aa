"""The computing part of raw downloads: monthly fields from finer ones, kept month by month."""

from __future__ import annotations

import calendar
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.panel import clean, sentinel_null
from ..operators.spatial import overlap_mean
from .netcdf import write_raster

#: Scale of the stored leaf area, degrees of its cells, and the last year that it covers.
LEAF_SCALE, LEAF_NATIVE, LEAF_LAST_YEAR = 0.001, 0.05, 2013


def month_starts(first: int, last: int) -> list[date]:
    return [date(y, m, 1) for y in range(first, last + 1) for m in range(1, 13)]


def days_of(month: date) -> list[date]:
    return [month.replace(day=k + 1) for k in range(calendar.monthrange(month.year, month.month)[1])]


def mean_of_means(raw: DataFrame, value: str, native: float, resolution: float, period: str = "month") -> DataFrame:
    """(time, latitude, longitude, value): the mean over the times of a period in each
    native cell, then of those means over a target cell by overlap.  So a cell that was
    seen on few days counts as much as one that was seen on many."""
    at = F.date_trunc(period, "time").cast("timestamp_ntz").alias("time")
    cells = raw.groupBy(at, "latitude", "longitude").agg(F.avg(value).alias(value))
    return overlap_mean(cells, value, native, resolution, ["time"])


def leaf_area_months(raw: DataFrame, first: int, last: int, resolution: float = 0.25, sentinel: float = -9999.0, native: float = LEAF_NATIVE) -> DataFrame:
    """(time, latitude, longitude, lai): scaled leaf area of each month in cells of
    `resolution` degrees, at their centres, from cells of `native` degrees: means over
    the month's days, then over the cells by overlap.  Missing values do not count."""
    if last > LEAF_LAST_YEAR:
        raise ValueError(f"the leaf area record ends in {LEAF_LAST_YEAR}")
    rows = clean(sentinel_null(raw, "lai", sentinel), "lai").filter(F.year("time").between(first, last))
    return mean_of_means(rows, "lai", native, resolution).withColumn("lai", (F.col("lai") * LEAF_SCALE).cast("float"))


def wind_months(hourly: DataFrame) -> DataFrame:
    """(time, latitude, longitude, u, v, omega): means of each calendar month, at
    its start.  A field of monthly means is its own mean, so it may come too."""
    month = F.date_trunc("month", "time").cast("timestamp_ntz").alias("time")
    return hourly.groupBy(month, "latitude", "longitude").agg(*[F.avg(c).alias(c) for c in ("u", "v", "omega")])


def missing_months(spark: SparkSession, folder: str, wanted: list[date]) -> list[date]:
    """The months that a folder partitioned by month does not hold yet."""
    try:
        held = {r["month"] for r in spark.read.parquet(folder).select(F.col("month").cast("string")).distinct().collect()}
    except AnalysisException:
        held = set()
    return [m for m in wanted if m.isoformat() not in held]


def keep_months(field: DataFrame, folder: str, wanted: list[date]) -> list[date]:
    """Adds the wanted months that are not there yet; those that are stay as
    they are, so a run that broke off goes on where it was."""
    spark = field.sparkSession
    new = missing_months(spark, folder, wanted)
    if not new:
        return new
    rows = field.withColumn("month", F.to_date("time").cast("string")).filter(F.col("month").isin([m.isoformat() for m in new]))
    rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(folder)
    return new


def fetch(field: DataFrame, folder: str, out: str, first: int, last: int, variables: list[str], attributes: dict[str, str]) -> list[date]:
    """Keeps the months of the years `first` to `last` that `folder` lacks, then
    writes all of them to the NetCDF file `out`.  Months without any raw row are
    returned; they are no error, as a record may begin or end within a year."""
    wanted = month_starts(first, last)
    keep_months(field, folder, wanted)
    spark = field.sparkSession
    lacking = missing_months(spark, folder, wanted)
    held = spark.read.parquet(folder).filter(F.col("month").cast("string").isin([m.isoformat() for m in wanted]))
    write_raster(held.select("time", "latitude", "longitude", *variables), out, variables, {"": attributes})
    return lacking
