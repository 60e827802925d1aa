"""A panel of cells by days that grows as observations arrive.

A file stream takes the observation files that are new since the last run and writes
their sums by day and cell, a folder for each micro-batch.  Then the days whose sums
are newer than the panel's, and the three days after them, whose differences and
instruments rest on them, are made anew from all sums and replace their partitions.

Layout below `output`:
  _stream/            checkpoint of the file stream: which files were taken
  sums/batch=B/day=D  sums of batch B; a batch that is run again replaces its own
  panel/day=D         pixel_id, n, cents, y, dy, dyl, l2, l3 and upto, the newest batch
                      that the partition knows of
A run that broke off anywhere is put right by the next: the stream repeats its last
batch under the same number, and a day stays stale until its partition says otherwise.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxpanel.operators.panel import shift
from jobs.config import Written, command_line

log = logging.getLogger("jobs.daily_panel")

#: Days before a day that its row rests on.
REACH = 3

SUMS = "batch long, day date, pixel_id long, n long, cents long"
PANEL = "pixel_id long, t int, n long, cents long, y double, dy double, dyl double, l2 double, l3 double, upto long, day date"


@dataclass
class Config:
    """input: a folder, or a pattern of paths, of Parquet observations (ts, value, props
    with the cell under k), to which files are added and whose files do not change;
    output: the job's folder; files_per_batch: files of a micro-batch."""

    input: str
    output: str
    files_per_batch: int = 1000


def observed(events: DataFrame) -> DataFrame:
    """(day, pixel_id, cents): rows without a cell, a time or a value do not count."""
    cell = F.get_json_object("props", "$.k").try_cast("long")
    rows = events.select(F.to_date("ts").alias("day"), cell.alias("pixel_id"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return rows.na.drop()


def _sums(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SUMS).parquet(f"{folder}/sums")


def read_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel as it stands."""
    return spark.read.schema(PANEL).parquet(f"{folder}/panel")


def take_new_files(spark: SparkSession, config: Config) -> int:
    """Runs the stream over what is new; returns the rows that it read."""
    schema = spark.read.parquet(config.input).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(config.input)

    def write(batch: DataFrame, number: int) -> None:
        sums = observed(batch).groupBy("day", "pixel_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
        # Days are few a batch: all rows of one go to one file.
        sums.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{config.output}/sums/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{config.output}/_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def stale_days(spark: SparkSession, folder: str) -> DataFrame:
    """(day, upto) of the days with sums that the panel's partition does not know of,
    its own or those of the days that it rests on."""
    try:
        own = _sums(spark, folder).select("day", "batch").distinct()
    except AnalysisException:  # no file has come yet
        return spark.createDataFrame([], "day date, upto long")
    held = own.select("day").distinct()
    reached = own.select(F.explode(F.sequence(F.col("day"), F.date_add("day", REACH))).alias("day"), "batch")
    newest = reached.groupBy("day").agg(F.max("batch").alias("upto")).join(held, "day", "left_semi")
    try:
        known = read_panel(spark, folder).groupBy("day").agg(F.min("upto").alias("known"))
    except AnalysisException:
        return newest
    return newest.join(known, "day", "left").filter("known is null or known < upto").select("day", "upto")


def refresh(spark: SparkSession, folder: str) -> Written:
    """Makes the stale days of the panel anew, and replaces no other partition."""
    stale = {r["day"]: r["upto"] for r in stale_days(spark, folder).collect()}  # a row a day of the calendar
    panel = spark.createDataFrame([], PANEL)
    if stale:
        needed = {d - timedelta(days=k) for d in stale for k in range(REACH + 1)}
        days = spark.createDataFrame(list(stale.items()), "day date, upto long")
        rows = _sums(spark, folder).filter(F.col("day").isin(sorted(needed))).groupBy("day", "pixel_id").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
        rows = rows.select("pixel_id", "day", F.datediff("day", F.lit("1970-01-01")).alias("t"), "n", "cents", (F.col("cents") / (F.col("n") * 100.0)).alias("y"))
        lag = [F.col("y"), *[shift("y", k, ["pixel_id"]) for k in (1, 2, 3)]]
        rows = rows.withColumns({"dy": lag[0] - lag[1], "dyl": lag[1] - lag[2], "l2": lag[2], "l3": lag[3]})
        panel = rows.join(F.broadcast(days), "day").select(*[c.split(" ")[0] for c in PANEL.split(", ")])
    panel.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/panel")
    written = read_panel(spark, folder).filter(F.col("day").isin(sorted(stale))).count() if stale else 0
    return Written(0, written, [str(d) for d in sorted(stale)])


def run(spark: SparkSession, config: Config) -> Written:
    """Takes what is new in `input` and brings the panel up to date."""
    rows = take_new_files(spark, config)
    done = refresh(spark, config.output)
    done.rows_read = rows
    log.info("read %d new rows from %s; wrote %d rows of %d days to %s/panel", rows, config.input, done.rows_written, len(done.touched), config.output)
    return done


if __name__ == "__main__":
    sys.exit(command_line("daily_panel", Config, run))
