"""A dynamic panel of conversations: how the length of a turn follows from the one before.

Units are conversations, periods are turns, the value is the words of a turn's text.
The job writes the differenced sample and, for each role, the two-stage estimate of
dy = alpha dyl with l2 as instrument and errors clustered by conversation, and the
residual of every row.

Layout below `output`, each replaced as a whole by a run:
  sample/role=R   conv_id, turn, y, dy, dyl, l2, l3 and residual
  estimates/      role, alpha, se, n, clusters, instrument_f
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxpanel.operators.estimation import fit_2sls
from fluxpanel.operators.panel import finite_rows, keyed_lags
from fluxpanel.tables import discard, materialise
from jobs.config import Written, command_line

log = logging.getLogger("jobs.dialogue_panel")

SAMPLE = "conv_id long, turn long, y double, dy double, dyl double, l2 double, l3 double, residual double, role string"
ESTIMATES = "role string, alpha double, se double, n long, clusters long, instrument_f double"

#: Rows of a role, at least, that an estimate is made from.
LEAST = 10


@dataclass
class Config:
    """input: Parquet of (conv_id, turn, role, text); output: the job's folder."""

    input: str
    output: str


def measured(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, y): words of each turn.  A null text is missing, rows of one
    turn add up and have the smallest role; rows without a conversation or turn are left out."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("double")
    rows = turns.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn")
    return rows.agg(F.coalesce(F.min("role"), F.lit("none")).alias("role"), F.sum(words).alias("y"))


def sample(turns: DataFrame) -> DataFrame:
    """The rows that have a difference, its lag and the instrument."""
    rows = keyed_lags(measured(turns), ["conv_id"], "turn", "y", (1, 2, 3), ["role"])
    rows = rows.select("conv_id", "turn", "role", "y", (F.col("y") - F.col("lag1")).alias("dy"), (F.col("lag1") - F.col("lag2")).alias("dyl"), F.col("lag2").alias("l2"), F.col("lag3").alias("l3"))
    return finite_rows(rows, "dy", "dyl", "l2")


def run(spark: SparkSession, config: Config) -> Written:
    """Writes the sample, with residuals, and the estimates."""
    turns = spark.read.parquet(config.input).select("conv_id", "turn", "role", "text")
    n_read, rows = turns.count(), materialise(sample(turns))
    counts = {r["role"]: r["n"] for r in rows.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a role
    found, residual = [], F.lit(None).cast("double")
    for role in sorted(counts):
        if counts[role] < LEAST:
            continue
        own = rows.filter(F.col("role") == role)
        fit = fit_2sls(own.withColumnsRenamed({"conv_id": "pixel_id", "turn": "t"}), "dy", ["dyl"], ["l2"], 1, ())
        means = own.agg(F.avg("dy").alias("dy"), F.avg("dyl").alias("dyl")).first()
        found.append((role, fit.alpha, float(fit.se[0]), fit.n, fit.clusters, float(fit.sw_f[0])))
        residual = F.when(F.col("role") == role, (F.col("dy") - means["dy"]) - fit.alpha * (F.col("dyl") - means["dyl"])).otherwise(residual)
    out = rows.withColumn("residual", residual).select(*[c.split(" ")[0] for c in SAMPLE.split(", ")])
    # By a hash of the row, so that no role or conversation makes one task's share.
    parts = max(1, sum(counts.values()) // 1_000_000)
    out.repartition(parts, "conv_id", "turn").write.mode("overwrite").partitionBy("role").parquet(f"{config.output}/sample")
    spark.createDataFrame(found, ESTIMATES).coalesce(1).write.mode("overwrite").parquet(f"{config.output}/estimates")
    discard(rows)
    done = Written(n_read, sum(counts.values()), sorted(counts))
    log.info("read %d turns from %s; wrote %d rows of %d roles to %s/sample and %d estimates to %s/estimates", n_read, config.input, done.rows_written, len(counts), config.output, len(found), config.output)
    return done


def read_sample(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SAMPLE).parquet(f"{folder}/sample")


def read_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ESTIMATES).parquet(f"{folder}/estimates")


if __name__ == "__main__":
    sys.exit(command_line("dialogue_panel", Config, run))
