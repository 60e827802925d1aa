"""Readers and writers.

Gridded fields are long tables (time, latitude, longitude, level?, variables).
NetCDF files have a data source of their own (`netcdf.py`).  Checkpoints are parquet folders, never pickles."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..operators.panel import clean, sentinel_null
from ..operators.spatial import column_alias

#: Names that a variable or coordinate goes by, first match wins.
ALIASES = {
    "time": ["time", "valid_time", "date", "month"],
    "latitude": ["latitude", "lat", "y"],
    "longitude": ["longitude", "lon", "x"],
    "level": ["pressure_level", "level", "plev", "isobaricInhPa"],
    "lai": ["lai", "LAI", "Lai", "leaf_area_index"],
    "u": ["u", "u_component_of_wind", "eastward_wind", "U"],
    "v": ["v", "v_component_of_wind", "northward_wind", "V"],
    "omega": ["w", "omega", "vertical_velocity", "lagrangian_tendency_of_air_pressure"],
}

GRID = ("pixel_id", "latitude", "longitude")


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def grid(df: DataFrame) -> DataFrame:
    """pixel_id, latitude, longitude in the order of pixel_id; ids are kept."""
    require(df, GRID)
    return df.select(F.col("pixel_id").cast("long"), F.col("latitude").cast("double"), F.col("longitude").cast("double")).orderBy("pixel_id")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return grid(spark.read.csv(path, header=True, inferSchema=False))


def read_raster(spark: SparkSession, paths: list[str] | str, variables: list[str], sentinel: float | None = None, time_units: str | None = None) -> DataFrame:
    """A gridded field by role names, from one or more parquet tables; missing
    values become null."""
    paths = [paths] if isinstance(paths, str) else paths
    try:
        parts = [spark.read.parquet(p) for p in paths]
    except AnalysisException as error:
        raise FileNotFoundError(str(error)) from error
    raster = parts[0]
    for more in parts[1:]:
        raster = raster.unionByName(more, allowMissingColumns=True)
    return as_raster(raster, variables, sentinel, time_units)


def as_raster(raster: DataFrame, variables: list[str], sentinel: float | None = None, time_units: str | None = None) -> DataFrame:
    """A gridded field under its role names, floats, missing values null.  A
    pressure level is kept as `level`.  A numeric time counts `time_units`
    ("hours since 1900-01-01"); without them it is an error, as any epoch would
    be a guess."""
    level = next((c for c in ALIASES["level"] if c in raster.columns), None)
    roles = ["time", "latitude", "longitude", *(["level"] if level else []), *variables]
    out = column_alias(raster, {r: ALIASES[r] for r in roles})
    kind = dict(out.dtypes)["time"]
    if kind in ("double", "float", "int", "bigint", "smallint") or kind.startswith("decimal"):
        if time_units is None:
            raise ValueError("the time is a number; say what it counts, such as time_units='hours since 1970-01-01'")
        seconds, epoch = cf_time(time_units)
        micros = F.round(F.col("time") * seconds * 1_000_000).cast("long") + int(epoch.astype("datetime64[us]").astype(int))
        out = out.withColumn("time", F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)")))
    else:
        out = out.withColumn("time", F.col("time").cast("timestamp_ntz"))
    for v in variables:
        out = sentinel_null(out, v, sentinel) if sentinel is not None else out
    places = {c: F.col(c).cast("double") for c in ("latitude", "longitude", *(["level"] if level else []))}
    return clean(out.withColumns(places | {v: F.col(v).cast("float") for v in variables}), *variables)


#: Seconds of the units of a CF time, and the calendars that are the usual one.
CF_SECONDS = {"day": 86400, "hour": 3600, "hr": 3600, "h": 3600, "minute": 60, "min": 60, "second": 1, "sec": 1, "s": 1, "millisecond": 1e-3, "microsecond": 1e-6}
CF_CALENDARS = ("standard", "gregorian", "proleptic_gregorian")


def cf_time(units: str, calendar: str = "standard") -> tuple[float, np.datetime64]:
    """(seconds of a unit, epoch) of units such as "days since 1850-01-01 00:00".
    An epoch with a zone is taken to UTC.  Months, years and other calendars,
    whose units have no fixed length here, are an error."""
    found = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(.+?)\s*", units)
    unit = found[1].lower() if found else ""
    if unit not in CF_SECONDS or calendar.lower() not in CF_CALENDARS:
        raise ValueError(f"time in {units!r} of the calendar {calendar!r} cannot be read")
    parts = re.fullmatch(r"(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2})(?::(\d{1,2}))?(?::(\d{1,2}(?:\.\d+)?))?)?\s*(Z|UTC|[+-]\d{1,2}(?::?\d{2})?)?", found[2])
    if not parts:
        raise ValueError(f"the epoch of {units!r} cannot be read")
    y, m, d, hour, minute, second, zone = parts.groups()
    epoch = np.datetime64(f"{int(y):04}-{int(m):02}-{int(d):02}", "us") + np.timedelta64(round((int(hour or 0) * 3600 + int(minute or 0) * 60 + float(second or 0)) * 1e6), "us")
    if zone and zone not in ("Z", "UTC"):
        digits = re.sub(r"\D", "", zone)
        ahead = int(digits[:2] if len(digits) != 3 else digits[:1]) * 60 + int(digits[-2:] if len(digits) > 2 else 0)
        epoch -= np.timedelta64((-1 if zone[0] == "-" else 1) * ahead, "m")
    return CF_SECONDS[unit], epoch


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(polygon, ring, lat1, lon1, lat2, lon2): the sides of the rings of a GeoJSON
    file: a FeatureCollection, a bare MultiPolygon or a bare Polygon."""
    one = "array<array<array<double>>>"
    parsed = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("j"))
    kind = F.variant_get("j", "$.type", "string")
    names = {r["kind"] for r in parsed.select(kind.alias("kind")).collect()}
    if not names <= {"FeatureCollection", "MultiPolygon", "Polygon"}:
        raise ValueError(f"not a polygon file: {names}")
    features = F.when(kind == "FeatureCollection", F.transform(F.variant_get("j", "$.features", "array<variant>"), lambda f: F.variant_get(f, "$.geometry", "variant"))).otherwise(F.array("j"))
    shapes = parsed.select(F.posexplode(features).alias("f", "g"))
    is_one = F.variant_get("g", "$.type", "string") == "Polygon"
    many = F.when(is_one, F.array(F.variant_get("g", "$.coordinates", one))).otherwise(F.variant_get("g", "$.coordinates", f"array<{one}>"))
    rings = shapes.select("f", F.posexplode(many).alias("p", "poly")).select("f", "p", F.posexplode("poly").alias("ring", "points"))
    sides = rings.select(F.concat_ws("-", "f", "p").alias("polygon"), "ring", F.explode(F.arrays_zip(F.expr("slice(points, 1, size(points) - 1)").alias("a"), F.expr("slice(points, 2, size(points) - 1)").alias("b"))).alias("s"))
    at = lambda side, k: F.col(f"s.{side}")[k]
    return sides.select("polygon", "ring", at("a", 1).alias("lat1"), at("a", 0).alias("lon1"), at("b", 1).alias("lat2"), at("b", 0).alias("lon2"))


def lattice(spark: SparkSession, lat: tuple[float, float], lon: tuple[float, float], resolution: float, offset: float = 0.0) -> DataFrame:
    """A row-major lattice over a box, ends included; `offset` (in cells) moves
    the centres inwards, and there is then one row and column fewer."""
    count = lambda a, b: int((b - a) / resolution + 0.5 - offset * 2) + 1
    n_lat, n_lon = count(*lat), count(*lon)
    cell = lambda start, k: F.lit(start) + (F.lit(offset) + k) * resolution
    ids = spark.range(n_lat * n_lon)
    return ids.select(F.col("id").alias("pixel_id"), cell(lat[0], F.expr(f"id div {n_lon}")).alias("latitude"), cell(lon[0], F.col("id") % n_lon).alias("longitude"))


#: Buckets of the links of a checkpoint; what they are dealt by, as shells are joined on it.
BUCKETS, DEALT_BY = 64, ("i", "j")


def write_checkpoint(folder: str, buckets: int = BUCKETS, **tables: DataFrame) -> None:
    """panel, circulation, adjacency, grid: one parquet folder each.  Circulation is dealt
    by its links into buckets, in the order of months within each, so that what joins
    on links later moves only the other side; `circulation_layout` says how."""
    for name, df in tables.items():
        if name != "circulation":
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            continue
        # The catalogue is where bucketed files are written by; files stay when the name goes.
        table, spark = f"circulation_{uuid.uuid4().hex}", df.sparkSession
        spread = df.repartition(buckets, *DEALT_BY)
        writer = spread.write.format("parquet").mode("overwrite").bucketBy(buckets, *DEALT_BY).sortBy("ts", *DEALT_BY)
        writer.option("path", f"{folder}/{name}").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")
        spark.createDataFrame([(buckets, spread.schema.json())], "buckets int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}_layout")


def _bucketed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Links as a table that knows its buckets, under a name of this call; one
    without a layout, as older checkpoints have it, is read as it is."""
    try:
        layout = spark.read.parquet(f"{folder}/{name}_layout").first()
    except AnalysisException:
        return spark.read.parquet(f"{folder}/{name}")
    schema = StructType.fromJson(json.loads(layout["schema"]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    table, path = f"circulation_{uuid.uuid4().hex}", f"{folder}/{name}".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({', '.join(DEALT_BY)}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def read_checkpoint(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    try:
        return {n: _bucketed(spark, folder, n) if n == "circulation" else spark.read.parquet(f"{folder}/{n}") for n in names}
    except AnalysisException as error:
        raise FileNotFoundError(f"no checkpoint in {folder}; build it with --build-inputs") from error


def output_folder(root: str, mode: str) -> Path:
    """Demo and full runs write to different folders, so neither replaces the other's."""
    out = Path(root) if mode == "full" else Path(root) / "demo"
    out.mkdir(parents=True, exist_ok=True)
    return out
