"""Spatial joins and fills on grids.

Nearest cells and neighbours are equi-joins on integer cells: a point is sent
to the few cells that can hold its match, never compared with all points.  On a
regular lattice the match is arithmetic and needs no join at all."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import chord, chord_degrees, finite
from ..tables import materialise, small_side

#: Half the diagonal of a cell, and the reach of edge and corner neighbours.
VORONOI, QUEEN = 0.7072, math.sqrt(2) + 1e-6


@dataclass(frozen=True)
class Lattice:
    """A regular grid: first latitude and longitude, their steps, and how many
    of each.  Cells are numbered row by row from the lowest coordinates."""

    lat: float
    lon: float
    dlat: float
    dlon: float
    rows: int
    cols: int

    @classmethod
    def of(cls, raster: DataFrame, step: float = 1.0) -> Lattice:
        """The lattice of a raster, in any order of its axes; `step` is that of
        an axis of one value.  The axes, some thousand values, are collected; if
        they are not evenly spaced, it is an error."""
        axes = raster.agg(*[F.array_sort(F.collect_set(F.col(c).cast("double"))) for c in ("latitude", "longitude")]).first()
        out = []
        for values in map(np.array, axes):
            if not len(values):
                raise ValueError("a raster without cells has no lattice")
            d = (values[-1] - values[0]) / (len(values) - 1) if len(values) > 1 else step
            if np.abs(values - values[0] - d * np.arange(len(values))).max() > 1e-3 * d:
                raise ValueError("the axes of the raster are not evenly spaced")
            out.append((float(values[0]), float(d), len(values)))
        (lat, dlat, rows), (lon, dlon, cols) = out
        return cls(lat, lon, dlat, dlon, rows, cols)

    @classmethod
    def spanning(cls, grid: DataFrame, step: float) -> Lattice | None:
        """The lattice with this step that holds all cells of a grid, which may
        have holes and bays; None if some cell is off it."""
        lo = grid.agg(F.min("latitude"), F.min("longitude"), F.max("latitude"), F.max("longitude")).first()
        if lo[0] is None:
            return cls(0.0, 0.0, step, step, 1, 1)
        off = lambda c, a: F.max(F.abs((F.col(c) - a) / step - F.round((F.col(c) - a) / step)))
        worst = grid.agg(off("latitude", lo[0]), off("longitude", lo[1])).first()
        if max(worst) > 1e-3:
            return None
        return cls(lo[0], lo[1], step, step, round((lo[2] - lo[0]) / step) + 1, round((lo[3] - lo[1]) / step) + 1)

    def row(self, lat: str | Column = "latitude") -> Column:
        return F.round(((F.col(lat) if isinstance(lat, str) else lat) - self.lat) / self.dlat).cast("long")

    def col(self, lon: str | Column = "longitude") -> Column:
        return F.round(((F.col(lon) if isinstance(lon, str) else lon) - self.lon) / self.dlon).cast("long")

    def number(self) -> Column:
        """The number of the cell at the columns latitude and longitude."""
        return self.row() * self.cols + self.col()

    def cells(self, spark) -> DataFrame:
        """cell, latitude and longitude of every cell."""
        at = spark.range(self.rows * self.cols)
        return at.select(F.col("id").alias("cell"), (self.lat + F.expr(f"id div {self.cols}") * self.dlat).alias("latitude"), (self.lon + F.col("id") % self.cols * self.dlon).alias("longitude"))


def _nearby(df: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    """Each row once for each of the nine buckets around it."""
    offset = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    return df.withColumn("__o", offset).withColumns({
        "__bi": F.floor(F.col(lat) / size) + F.col("__o.a"), "__bj": F.floor(F.col(lon) / size) + F.col("__o.b"),
    }).drop("__o")


def _reached(df: DataFrame, lat: str, lon: str, reach: float, size: float) -> DataFrame:
    """Each row once for each bucket that a circle of radius `reach` may touch:
    four at most, as buckets are no smaller than the circle."""
    ends = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    return df.withColumn("__bi", F.explode(ends(lat))).withColumn("__bj", F.explode(ends(lon)))


def _bucketed(df: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    return df.withColumns({"__bi": F.floor(F.col(lat) / size), "__bj": F.floor(F.col(lon) / size)})


def queen_adjacency(grid: DataFrame, resolution: float) -> DataFrame:
    """Edges (i, j), both ways, between cells that share an edge or a corner."""
    reach = QUEEN * resolution
    left = _nearby(grid.select(F.col("pixel_id").alias("i"), F.col("latitude").alias("a"), F.col("longitude").alias("b")), "a", "b", reach)
    right = _bucketed(grid.select(F.col("pixel_id").alias("j"), F.col("latitude").alias("c"), F.col("longitude").alias("d")), "c", "d", reach)
    near = F.sqrt((F.col("a") - F.col("c")) ** 2 + (F.col("b") - F.col("d")) ** 2) <= reach
    return left.join(right, ["__bi", "__bj"]).filter(near & (F.col("i") != F.col("j"))).select("i", "j")


def nearest_cell(points: DataFrame, grid: DataFrame, resolution: float, keys: list[str], lat: str = "lat", lon: str = "lon", radius: float = VORONOI) -> DataFrame:
    """`keys` of the points with `cell` and `distance` (in degrees) of the nearest
    grid cell within radius * resolution, for grids of any shape.  Ties within
    1e-12 go to the lowest id.  A counted small grid is sent to the points."""
    reach = radius * resolution
    size = 2 * reach * (1 + 1e-9)
    near = _reached(points.select(*keys, lat, lon), lat, lon, reach, size)
    cells = _bucketed(grid.select(F.col("pixel_id").alias("cell"), F.col("latitude").alias("__c"), F.col("longitude").alias("__d")), "__c", "__d", size)
    d = F.sqrt((F.col(lat) - F.col("__c")) ** 2 + (F.col(lon) - F.col("__d")) ** 2)
    met = near.join(small_side(cells, grid.count()), ["__bi", "__bj"]).withColumn("distance", d).filter(F.col("distance") <= reach)
    best = F.min(F.struct(F.round("distance", 12).alias("distance"), "cell"))
    return met.groupBy(*keys, lat, lon).agg(best.alias("__m")).select(*keys, lat, lon, "__m.cell", "__m.distance")


def nearest_on_sphere(targets: DataFrame, lattice: Lattice, limit: float | None = 1.0) -> DataFrame:
    """`targets` (latitude, longitude, any other columns) with `source`, the number
    of the lattice cell that is nearest on the sphere, and its distance in
    `degrees`; the source is null if that is over `limit`.

    Of a row of the lattice the nearest cell is the one nearest in longitude,
    the circle closed at 360 degrees, or an end of the row; and the nearest row
    is the nearest in latitude or one beside it, unless the target lies tens of
    degrees of longitude outside the lattice near a pole.  So fifteen candidates
    are weighed within an expression, without a join.  Ties within 1e-12 go to
    the lowest number."""
    inside = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1)))
    row, col = lattice.row(), F.round(F.pmod(F.col("longitude") - lattice.lon, F.lit(360.0)) / lattice.dlon).cast("long")
    rows = [inside(row + k, lattice.rows) for k in (-1, 0, 1)]
    cols = [*[inside(col + k, lattice.cols) for k in (-1, 0, 1)], F.lit(0), F.lit(lattice.cols - 1)]
    pairs = F.array(*[F.struct(r.cast("long").alias("r"), c.cast("long").alias("c")) for r in rows for c in cols])
    away = lambda o: F.round(chord(F.col("latitude"), F.col("longitude"), lattice.lat + o["r"] * lattice.dlat, lattice.lon + o["c"] * lattice.dlon), 12)
    best = F.array_min(F.transform(pairs, lambda o: F.struct(away(o).alias("c"), (o["r"] * lattice.cols + o["c"]).alias("s"))))
    degrees = chord_degrees(F.col("__m.c"))
    found = targets.withColumn("__m", best)
    source = F.col("__m.s") if limit is None else F.when(degrees <= limit, F.col("__m.s"))
    return found.select(*targets.columns, source.alias("source"), degrees.alias("degrees"))


def nearest_level(raster: DataFrame, keys: list[str], level: str = "level", target: float = 800.0) -> DataFrame:
    """The rows at the level nearest to `target` hPa (levels over 2000 are in
    Pa); the first such level in the order of the axis wins a tie."""
    axis = raster.select(level).distinct()
    unit = F.when(F.max(level).over(Window.partitionBy()) > 2000, 100.0).otherwise(1.0)
    chosen = axis.withColumn("__d", F.abs(F.col(level) / unit - target)).agg(F.min_by(level, F.struct("__d", level)).alias(level))
    return raster.join(F.broadcast(chosen), level, "left_semi").select(*keys, level, *[c for c in raster.columns if c not in (*keys, level)])


def inside_band(df: DataFrame, box: tuple[float, float, float, float], low: float = 100.0, high: float = 950.0) -> DataFrame:
    """Points in the box (latitudes, longitudes) and the pressure band, ends included."""
    return df.filter(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]) & F.col("pressure").between(low, high))


def in_polygons(points: DataFrame, edges: DataFrame, keys: list[str], lat: str = "latitude", lon: str = "longitude", band: float = 0.25) -> DataFrame:
    """`keys` of the points with `inside`.

    `edges` (polygon, ring, lat1, lon1, lat2, lon2) are the sides of rings; ring
    0 is the outline, the others are holes.  A ring contains a point if a ray
    from it crosses the ring an odd number of times; polygons are united.  A
    point meets only the sides that reach its band of latitudes, by an
    equi-join, and what comes out are the crossings, which are counted."""
    y, x = F.col(lat), F.col(lon)
    ends = [F.floor(f(F.col("lat1"), F.col("lat2")) / band).cast("long") for f in (F.least, F.greatest)]
    sides = edges.filter("lat1 <> lat2").withColumn("__band", F.explode(F.sequence(*ends)))
    spans = (F.col("lat1") > y) != (F.col("lat2") > y)
    cut = F.col("lon1") + (y - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    own = points.select(*keys, *[c for c in (lat, lon) if c not in keys])
    met = own.withColumn("__band", F.floor(y / band).cast("long")).join(sides, "__band").filter(spans & (x < cut))
    odd = met.groupBy(*keys, "polygon", "ring").agg((F.count(F.lit(1)) % 2 == 1).alias("odd")).filter("odd")
    held = odd.groupBy(*keys, "polygon").agg((F.min("ring") == 0).alias("outline"), (F.max("ring") == 0).alias("whole"))
    within = held.filter("outline and whole").select(*keys).distinct().withColumn("inside", F.lit(True))
    return own.select(*keys).join(within, keys, "left").select(*keys, F.coalesce("inside", F.lit(False)).alias("inside"))


def bilinear(points: DataFrame, raster: DataFrame, resolution: float, origin: tuple[float, float], keys: list[str], value: str = "value") -> DataFrame:
    """`keys` and the value between the four raster cells around (lat, lon); null
    outside the raster or next to a missing cell.  One equi-join on lattice
    indices and one aggregate."""
    fi, fj = (F.col("lat") - origin[0]) / resolution, (F.col("lon") - origin[1]) / resolution
    at = points.withColumns({"__i": F.floor(fi), "__j": F.floor(fj), "__a": fi - F.floor(fi), "__b": fj - F.floor(fj)})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    weight = F.when(F.col("__o.a") == 1, F.col("__a")).otherwise(1 - F.col("__a")) * F.when(F.col("__o.b") == 1, F.col("__b")).otherwise(1 - F.col("__b"))
    corners = at.withColumn("__o", corner).withColumns({"__w": weight, "ci": (F.col("__i") + F.col("__o.a")).cast("long"), "cj": (F.col("__j") + F.col("__o.b")).cast("long")}).filter("__w > 0")
    index = lambda c, o: F.round((F.col(c) - o) / resolution).cast("long")
    cells = raster.select(index("latitude", origin[0]).alias("ci"), index("longitude", origin[1]).alias("cj"), F.col(value).alias("__v"))
    met = corners.join(cells, ["ci", "cj"], "left").groupBy(*keys)
    return met.agg(F.when(F.count("__v") == F.count(F.lit(1)), F.sum(F.col("__w") * F.col("__v"))).alias(value))


def row_col_fill(raster: DataFrame, value: str | list[str] = "value", lat: str = "latitude", lon: str = "longitude", keys: list[str] | None = None) -> DataFrame:
    """Missing cells get the mean of their row (latitude), then of their column
    of the rows so filled, then 0.  Several values share the two shuffles."""
    keys, values = keys or [], [value] if isinstance(value, str) else value
    row, col = Window.partitionBy(*keys, lat), Window.partitionBy(*keys, lon)
    once = raster.withColumns({v: F.coalesce(F.col(v), F.avg(v).over(row)) for v in values})
    return once.withColumns({v: F.coalesce(F.col(v), F.avg(v).over(col), F.lit(0.0)) for v in values})


def overlap_mean(field: DataFrame, value: str, native: float, resolution: float, keys: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(keys, lat, lon, value) at the centres of cells of `resolution` degrees whose edges
    are its multiples: means of the native cells (centres, `native` degrees wide),
    weighted by the share of each that lies in the target cell.  Missing native cells have
    no weight; a target cell with none of weight is absent.  Neither width need divide
    the other.

    A native cell meets a bounded number of target cells, (native / resolution + 2)^2 at
    most, so this is one explode and one partial aggregate, whatever the grids are."""

    def met(c: str) -> Column:
        # In units of target cells, rounded so that edges that coincide stay together.
        lo, hi = (F.round((F.col(c) + side * native / 2) / resolution, 9) for side in (-1, 1))
        last = F.greatest(F.ceil(hi) - 1, F.floor(lo)).cast("long")
        cover = lambda k: F.least(hi, k + F.lit(1.0)) - F.greatest(lo, k.cast("double"))
        return F.transform(F.sequence(F.floor(lo).cast("long"), last), lambda k: F.struct(k.alias("k"), cover(k).alias("w")))

    rows = field.filter(F.col(value).isNotNull()).select(*keys, value, F.explode(met(lat)).alias("__a"), met(lon).alias("__b"))
    rows = rows.select(*keys, value, "__a", F.explode("__b").alias("__b")).withColumn("__w", F.col("__a.w") * F.col("__b.w")).filter("__w > 0")
    total = rows.groupBy(*keys, F.col("__a.k").alias("__i"), F.col("__b.k").alias("__j")).agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias(value))
    centre = lambda k: (F.col(k) + 0.5) * resolution
    return total.select(*keys, centre("__i").alias(lat), centre("__j").alias(lon), value)


def land_mask(raster: DataFrame, value: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Whether a cell ever has a finite value."""
    return raster.groupBy(lat, lon).agg(F.coalesce(F.bool_or(finite(F.col(value))), F.lit(False)).alias("land"))


#: Stamps of an axis that goes to the events whole; stamps of a stretch of a longer one, at least.
SHORT_AXIS, STRETCH = 4096, 256


def _micros(c: str | Column) -> Column:
    return F.unix_micros(F.to_timestamp(c))


def _not_later(stamps: Column, than: Column) -> Column:
    """How many of a sorted array are not later, by halving."""
    n = F.size(stamps)
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda s: s <= n)
    fits = lambda p, s: (p + s <= n) & (F.try_element_at(stamps, F.least(p + s, n)) <= than)
    return F.aggregate(steps, F.lit(0), lambda p, s: p + F.when(fits(p, s), s).otherwise(F.lit(0)))


def _stretches(axis: DataFrame, n: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """An axis in stretches of about the root of its length: (stretch, stamps, next), and
    the stretch of a time.  Each but the first begins with a stamp, and the times at which
    they begin, few as they are, stand in the expression."""
    parts = max(1, n // max(STRETCH, int(n**0.5)))
    shares = ", ".join(f"{k / parts!r}" for k in range(1, parts)) or "0.0"
    cuts = axis.select(_micros("__stamp").alias("m")).agg(F.expr(f"percentile_approx(m, array({shares}), {max(10_000, 20 * parts)})")).first()[0]
    literal = F.from_json(F.lit(json.dumps(sorted(set(cuts)))), "array<bigint>")
    of = lambda c: _not_later(literal, _micros(c))
    held = axis.groupBy(of(F.col("__stamp")).alias("__stretch")).agg(F.array_sort(F.collect_set("__stamp")).alias("__axis"))
    held = materialise(held)
    # A row a stretch, without its stamps: the window sees few and short ones.
    onward = held.select("__stretch", F.lead(F.col("__axis")[0]).over(Window.orderBy("__stretch")).alias("__next"))
    return held.join(onward, "__stretch"), of


def bracket(events: DataFrame, axis: DataFrame, ts: str = "ts", keys: list[str] | None = None, stamp: str = "ts", short: int = SHORT_AXIS) -> DataFrame:
    """Events with the stamps (t0, t1) of the axis (column `stamp`) around them and the weight w1
    of the later one; before the first and after the last stamp both are that
    stamp and w1 is 0.  Null times and an empty axis give nulls.

    An axis of at most `short` stamps goes to the events as one sorted array, in which
    each halves its way to the last stamp that is not later.  A longer one is cut into
    stretches, which events are joined with by time: an event then meets the stamps of
    one stretch, so what stands beside it grows with the root of the axis, and a stretch
    that many events fall into can be split like any join."""
    keys = keys or [c for c in events.columns if c != ts]
    times = materialise(axis.select(F.col(stamp).alias("__stamp")).filter("__stamp is not null").distinct())
    n, first = times.agg(F.count(F.lit(1)), F.min("__stamp").cast("string")).first()
    kind = axis.schema[stamp].dataType
    if n <= short:
        stamps = times.agg(F.array_sort(F.collect_list("__stamp")).alias("__axis"))
        held = events.crossJoin(F.broadcast(stamps)).withColumn("__next", F.lit(None).cast(kind))
    else:
        stretches, of = _stretches(times, n)
        held = events.withColumn("__stretch", of(F.col(ts))).join(stretches, "__stretch", "left")
    size, at = F.size("__axis"), F.col("__at")
    held = held.withColumn("__at", F.when(F.col("__axis").isNotNull(), _not_later(F.col("__axis"), F.col(ts))).otherwise(0))
    own = lambda k: F.when(F.col(ts).isNotNull(), F.coalesce(F.try_element_at("__axis", k), F.lit(first).cast(kind)))
    out = held.withColumns({
        "t0": own(F.greatest(at, F.lit(1))),
        "t1": F.when(at <= 0, own(F.lit(1))).when(at < size, own(at + 1)).otherwise(F.coalesce("__next", own(F.greatest(at, F.lit(1))))),
    })
    seconds = lambda c: _micros(c).cast("double")
    w1 = F.coalesce(F.try_divide(seconds(F.col(ts)) - seconds(F.col("t0")), seconds(F.col("t1")) - seconds(F.col("t0"))), F.lit(0.0))
    return out.select(*keys, ts, "t0", "t1", w1.alias("w1"))


def grid_difference(left: DataFrame, right: DataFrame, digits: int = 4) -> DataFrame:
    """Cells only left, only right and in both, coordinates rounded."""
    at = lambda df, n: df.select(F.round("latitude", digits).alias("a"), F.round("longitude", digits).alias("b")).distinct().withColumn(n, F.lit(1))
    both = at(left, "l").join(at(right, "r"), ["a", "b"], "full_outer")
    count = lambda c: F.count_if(c)
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.agg(count(l & ~r).alias("only_left"), count(~l & r).alias("only_right"), count(l & r).alias("both"))


def common_times(left: DataFrame, right: DataFrame, ts: str = "ts") -> DataFrame:
    """Times of both; an empty intersection is an error."""
    times = left.select(ts).intersect(right.select(ts))
    if times.isEmpty():
        raise ValueError("the two time axes have no time in common")
    return times


def within_times(df: DataFrame, times: DataFrame, ts: str = "ts") -> DataFrame:
    return df.join(F.broadcast(times), ts, "left_semi")


def column_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One column per role: the first of its aliases that `df` has."""
    out: list[Column] = []
    for role, names in aliases.items():
        found = next((n for n in names if n in df.columns), None)
        if found is None:
            raise KeyError(f"no column for {role}; looked for {', '.join(names)}")
        out.append(F.col(found).alias(role))
    return df.select(*out)
