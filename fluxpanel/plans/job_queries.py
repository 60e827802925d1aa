"""The runnable jobs as queries: each runs its job twice over the whole table, into a
new folder of the shared one, and returns what stands there after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import daily_panel, dialogue_panel

from ..tables import shared_folder
from .registry import query


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/jobs/{name}-{uuid.uuid4().hex}"


_DAYS = """cell_days AS (SELECT (props->>'$.k')::BIGINT pixel_id, ts::DATE AS day, (ts::DATE - DATE '1970-01-01')::INTEGER t, count(*) n, sum(round(value * 100)::BIGINT)::BIGINT cents
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND (props->>'$.k') IS NOT NULL GROUP BY ALL),
cells AS (SELECT *, cents / (n * 100.0::DOUBLE) y FROM cell_days),
looked AS (SELECT *, max(y) OVER (o RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) l1, max(y) OVER (o RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) l2,
  max(y) OVER (o RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) l3 FROM cells WINDOW o AS (PARTITION BY pixel_id ORDER BY t))"""


@query("SELECT pixel_id, t, n, cents, y, y - l1 dy, l1 - l2 dyl, l2, l3, day::VARCHAR AS day FROM looked", _DAYS)
def job1_daily_panel(spark: SparkSession, d: str) -> DataFrame:
    folder = _new_folder(spark, "daily_panel")
    # A pattern, as the plain path of a file stream must be a folder and the table is one file.
    config = daily_panel.Config(f"{d}/events.parque[t]", folder)
    for _ in range(2):
        daily_panel.run(spark, config)
    return daily_panel.read_panel(spark, folder).drop("upto").withColumn("day", F.col("day").cast("string"))


_TURNS = r"""turns AS (SELECT conv_id, turn, coalesce(min(role), 'none') AS role, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::DOUBLE y
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
back AS (SELECT *, max(y) OVER (o RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) g1, max(y) OVER (o RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) g2,
  max(y) OVER (o RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) g3 FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
differenced AS (SELECT conv_id, turn, role, y, y - g1 dy, g1 - g2 dyl, g2 l2, g3 l3 FROM back WHERE y - g1 IS NOT NULL AND g1 - g2 IS NOT NULL),
middled AS (SELECT *, dy - avg(dy) OVER r my, dyl - avg(dyl) OVER r mx, l2 - avg(l2) OVER r mz, count(*) OVER r n FROM differenced WINDOW r AS (PARTITION BY role)),
slopes AS (SELECT role, sum(mz * my) / sum(mz * mx) alpha FROM middled GROUP BY 1)"""


@query("SELECT conv_id, turn, role, y, dy, dyl, l2, l3, CASE WHEN n >= 10 THEN round(my - alpha * mx, 6) + 0 END residual FROM middled JOIN slopes USING (role)", _TURNS)
def job2_dialogue_panel(spark: SparkSession, d: str) -> DataFrame:
    folder = _new_folder(spark, "dialogue_panel")
    config = dialogue_panel.Config(f"{d}/conversations.parquet", folder)
    for _ in range(2):
        dialogue_panel.run(spark, config)
    return dialogue_panel.read_sample(spark, folder).withColumn("residual", F.round("residual", 6) + 0)
