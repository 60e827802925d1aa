"""Backward trajectories through a monthly wind field.

A step depends on the one before, which no built-in operator expresses, so
parcels step together in numpy.  Parcels are independent: those of a month are
dealt into blocks of bounded size, and a block meets only the two or three
snapshots of the wind that its walk can reach, in one cogrouped join.  The wind
is a table of packed snapshots, and no more of it is ever in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS, HOUR, P_HIGH, P_LOW, P_START, POLAR_LIMIT
from ..tables import materialise, small_side
from .spatial import VORONOI, Lattice, nearest_cell

#: Parcels of a block: so many that its wind is worth the way, within these ends;
#: blocks that note every point stay at the lesser end.
PARCELS = (4096, 65536)

#: Tasks of a walk, at most; the blocks of a task come one after another.
TASKS = 4096

_FIELDS = ("u", "v", "omega")


class Field:
    """u, v and omega on stamps x latitudes x longitudes; NaN where missing."""

    def __init__(self, times: np.ndarray, lats: np.ndarray, lons: np.ndarray, field: np.ndarray):
        self.times, self.lats, self.lons, self.field = times, lats, lons, field

    def _corners(self, lat: np.ndarray, lon: np.ndarray):
        """Places of the four cells around each point, and their weights."""
        out = []
        for axis, value in ((self.lats, lat), (self.lons, lon)):
            last = len(axis) - 1
            step = (axis[-1] - axis[0]) / last if last else 1.0
            part = (value - axis[0]) / step
            low = np.clip(np.floor(part).astype(np.int64), 0, max(last - 1, 0))
            out.append((low, np.minimum(low + 1, last), part - low if last else np.zeros(len(value))))
        (i, i1, a), (j, j1, b) = out
        n = len(self.lons)
        return [(i * n + j, (1 - a) * (1 - b)), (i * n + j1, (1 - a) * b), (i1 * n + j, a * (1 - b)), (i1 * n + j1, a * b)]

    def _mixed(self, k: int, corners) -> np.ndarray:
        """A snapshot's values; a missing corner without weight does no harm."""
        held = self.field[k].reshape(-1, self.field.shape[-1])
        out = sum(held[at] * w[:, None] for at, w in corners)
        lost = np.flatnonzero(np.isnan(out).any(1))
        if len(lost):
            out[lost] = sum(np.where(w[lost, None] != 0, held[at[lost]] * w[lost, None], 0) for at, w in corners)
        return out

    def at(self, moment: np.datetime64, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Bilinear in space, NaN outside; linear between the stamps around the
        moment, constant beyond the ends."""
        corners = self._corners(lat, lon)
        k = int(np.searchsorted(self.times, moment, side="right"))
        if k == 0 or k == len(self.times):
            out = self._mixed(0 if k == 0 else k - 1, corners)
        else:
            late = (moment - self.times[k - 1]) / (self.times[k] - self.times[k - 1])
            out = self._mixed(k - 1, corners)
            if late:
                out = (1 - late) * out + late * self._mixed(k, corners)
        out[(lat < self.lats[0]) | (lat > self.lats[-1]) | (lon < self.lons[0]) | (lon > self.lons[-1])] = np.nan
        return out


def walk(wind: Field, moment: np.datetime64, lat: np.ndarray, lon: np.ndarray, hours: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Hour by hour (h, origin index, lat, lon) of the points reached, h = 0 the
    origins.  A parcel ends where it leaves the field or the pressure band,
    before the point is noted, and where the wind is missing, after."""
    lat, lon = lat.astype(float), lon.astype(float)
    pressure, alive = np.full(len(lat), P_START), np.arange(len(lat))
    for h in range(hours):
        inside = (lat >= wind.lats[0]) & (lat <= wind.lats[-1]) & (lon >= wind.lons[0]) & (lon <= wind.lons[-1])
        inside &= (pressure >= P_LOW) & (pressure <= P_HIGH)
        alive, lat, lon, pressure = alive[inside], lat[inside], lon[inside], pressure[inside]
        if not len(alive):
            break
        yield h, alive, lat, lon
        uvw = wind.at(moment - np.timedelta64(h, "h"), lat, lon)
        ok = np.isfinite(uvw).all(1)
        alive, lat, lon, pressure, uvw = alive[ok], lat[ok], lon[ok], pressure[ok], uvw[ok]
        metres = EARTH_RADIUS * np.maximum(np.cos(np.radians(lat)), np.cos(np.radians(POLAR_LIMIT)))
        lat, lon = lat - np.degrees(uvw[:, 1] * HOUR / EARTH_RADIUS), lon - np.degrees(uvw[:, 0] * HOUR / metres)
        lon = (lon + 180) % 360 - 180
        pressure = pressure - uvw[:, 2] * HOUR / 100


def _packed(lattice: Lattice):
    """One row a stamp: the three fields as floats in the order of the lattice."""

    def pack(table: pa.Table) -> pa.Table:
        cell = table.column("cell").to_numpy()
        if len(np.unique(cell)) < len(cell):
            raise ValueError(f"the wind at {table.column('time')[0]} has more than one value in a cell; select a level first")
        out = np.full((lattice.rows * lattice.cols, len(_FIELDS)), np.nan, np.float32)
        for k, name in enumerate(_FIELDS):
            out[cell, k] = table.column(name).to_numpy()
        return pa.table([table.column("time")[:1], pa.array([out.tobytes()], pa.large_binary())], names=["time", "field"]).cast(pa.schema([("time", pa.timestamp("us")), ("field", pa.binary())]))

    return pack


class Wind:
    """A raster (time, latitude, longitude, u, v, omega) as a written table of
    snapshots.  Only the axes are on the driver.  Two values in a cell at one
    time are an error, found when the snapshots are packed."""

    def __init__(self, raster: DataFrame):
        self.lattice = Lattice.of(raster)
        self.times = np.array(sorted(r[0] for r in raster.select("time").distinct().collect()), "datetime64[us]")
        rows = raster.select("time", self.lattice.number().alias("cell"), *[F.col(c).cast("float").alias(c) for c in _FIELDS])
        self.snapshots = materialise(rows.groupBy("time").applyInArrow(_packed(self.lattice), "time timestamp_ntz, field binary"))

    @property
    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.lattice
        return n.lat + n.dlat * np.arange(n.rows), n.lon + n.dlon * np.arange(n.cols)

    def field(self, times: np.ndarray, blobs: list[bytes]) -> Field:
        shape = (self.lattice.rows, self.lattice.cols, len(_FIELDS))
        order = np.argsort(times)
        return Field(times[order], *self.axes, np.stack([np.frombuffer(blobs[k], np.float32).astype(float).reshape(shape) for k in order]))

    def reached(self, moment: np.datetime64, hours: int) -> np.ndarray:
        """The stamps whose snapshots a walk of so many hours may need."""
        first = np.searchsorted(self.times, moment - np.timedelta64(max(hours - 1, 0), "h"), side="right") - 1
        last = np.searchsorted(self.times, moment, side="left")
        return self.times[max(first, 0) : last + 1]


def _blocks(grid: DataFrame, months: DataFrame, wind: Wind, hours: int, most: int):
    """Starts and the wind that they need, both dealt by (ts, block)."""
    spark, cells = grid.sparkSession, grid.count()
    snapshot = wind.lattice.rows * wind.lattice.cols * 4 * len(_FIELDS)
    blocks = max(1, -(-cells // min(max(PARCELS[0], 3 * snapshot // (8 * max(hours, 1))), most)))
    stamps = [r[0] for r in months.select("ts").distinct().collect()]
    reach = [(ts, t.astype(object)) for ts in stamps for t in wind.reached(np.datetime64(ts, "us"), hours)]
    tasks = max(1, min(len(stamps) * blocks, TASKS))
    days = spark.createDataFrame([(ts,) for ts in stamps], "ts timestamp_ntz")
    starts = grid.select("pixel_id", "latitude", "longitude", F.pmod(F.xxhash64("pixel_id"), F.lit(blocks)).alias("block")).crossJoin(F.broadcast(days))
    needed = spark.createDataFrame(reach, "ts timestamp_ntz, time timestamp_ntz").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    fields = wind.snapshots.join(small_side(needed, len(reach) * blocks), "time")
    dealt = lambda df: df.repartition(tasks, "ts", "block").groupBy("ts", "block")
    return dealt(starts).cogroup(dealt(fields.select("ts", "block", "time", "field")))


def _opened(wind: Wind, starts: pa.Table, fields: pa.Table):
    """The month, the ids and places of its parcels in the order of ids, and their wind."""
    starts = starts.sort_by("pixel_id")
    moment = np.datetime64(starts.column("ts")[0].as_py(), "us")
    times = fields.column("time").cast(pa.timestamp("us")).to_numpy()
    return moment, *[starts.column(c).to_numpy() for c in ("pixel_id", "latitude", "longitude")], wind.field(times, fields.column("field").to_pylist())


class _Shipped:
    """What a task needs to know of the wind: its lattice."""

    axes, field = Wind.axes, Wind.field

    def __init__(self, lattice: Lattice):
        self.lattice = lattice


def back_trajectories(grid: DataFrame, months: DataFrame, wind: Wind, hours: int) -> DataFrame:
    """(ts, origin, h, lat, lon) from every cell of `grid` at every stamp of `months` (ts)."""
    own = _Shipped(wind.lattice)

    def points(starts: pa.Table, fields: pa.Table) -> pa.Table:
        schema = pa.schema([("ts", pa.timestamp("us")), ("origin", pa.int64()), ("h", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64())])
        if not starts.num_rows or not fields.num_rows:
            return schema.empty_table()
        moment, ids, lat, lon, field = _opened(own, starts, fields)
        steps = [(np.full(len(a), h, np.int32), ids[a], y, x) for h, a, y, x in walk(field, moment, lat, lon, hours)]
        h, origin, y, x = (np.concatenate(c) for c in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return pa.table([pa.array(np.full(len(h), moment)), pa.array(origin), pa.array(h), pa.array(y), pa.array(x)], schema=schema)

    return _blocks(grid, months, wind, hours, PARCELS[0]).applyInArrow(points, "ts timestamp_ntz, origin long, h int, lat double, lon double")


def circulation(points: DataFrame, grid: DataFrame, resolution: float) -> DataFrame:
    """(ts, i, j): the cells j that trajectories from i visit, for a grid of any shape."""
    met = nearest_cell(points, grid, resolution, ["ts", "origin"])
    return met.select("ts", F.col("origin").alias("i"), F.col("cell").alias("j")).filter("i <> j").distinct()


class Domain:
    """The cells of a lattice that belong to a grid, a bit each."""

    def __init__(self, lattice: Lattice, bits: bytes):
        self.lattice = lattice
        self.held = np.unpackbits(np.frombuffer(bits, np.uint8), count=lattice.rows * lattice.cols).astype(bool).reshape(lattice.rows, lattice.cols)

    def nearest(self, lat: np.ndarray, lon: np.ndarray, reach: float) -> np.ndarray:
        """The number of the nearest cell that belongs to the grid, within
        `reach` degrees, or -1.  Ties within 1e-12 go to the lowest number."""
        n = self.lattice
        i, j = (np.floor((v - a) / d + 1e-9).astype(np.int64) for v, a, d in ((lat, n.lat, n.dlat), (lon, n.lon, n.dlon)))
        best, out = np.full(len(lat), np.inf), np.full(len(lat), -1, np.int64)
        for a in (0, 1):
            r, y = i + a, lat - (n.lat + (i + a) * n.dlat)
            for b in (0, 1):
                c, x = j + b, lon - (n.lon + (j + b) * n.dlon)
                away = np.sqrt(y * y + x * x)
                near = np.flatnonzero((away <= reach) & (away < best - 1e-12) & (r >= 0) & (r < n.rows) & (c >= 0) & (c < n.cols))
                near = near[self.held[r[near], c[near]]]
                best[near], out[near] = away[near], r[near] * n.cols + c[near]
        return out


def snapped_circulation(grid: DataFrame, months: DataFrame, wind: Wind, hours: int, resolution: float) -> DataFrame:
    """(ts, i, j): the cells j that trajectories from i visit.

    Where the grid is part of a lattice with this resolution, a point's cell is
    found in the walk, and only distinct pairs leave a block: no point is ever
    shuffled.  Ties go to the cell that comes first on the lattice.  For other
    grids the points are matched by a join."""
    lattice = Lattice.spanning(grid, resolution)
    if lattice is None:
        return circulation(back_trajectories(grid, months, wind, hours), grid, resolution)
    own, reach, size = _Shipped(wind.lattice), VORONOI * resolution, lattice.rows * lattice.cols
    cells = materialise(grid.select("pixel_id", lattice.number().alias("cell")))

    def bits(table: pa.Table) -> pa.Table:
        held = np.zeros(size, bool)
        held[table.column("cell").to_numpy()] = True
        return pa.table([pa.array([np.packbits(held).tobytes()], pa.binary())], names=["bits"])

    # A bit a cell is a hundredth of one snapshot, so it travels in a closure.
    held = cells.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(bits, "bits binary").collect()
    mask = held[0]["bits"] if held else np.packbits(np.zeros(size, bool)).tobytes()

    def pairs(starts: pa.Table, fields: pa.Table) -> pa.Table:
        schema = pa.schema([("ts", pa.timestamp("us")), ("i", pa.int64()), ("cell", pa.int64())])
        if not starts.num_rows or not fields.num_rows:
            return schema.empty_table()
        moment, ids, lat, lon, field = _opened(own, starts, fields)
        domain, met, last = Domain(lattice, mask), [], np.full(len(ids), -1, np.int64)
        for _, a, y, x in walk(field, moment, lat, lon, hours):
            cell = domain.nearest(y, x, reach)
            fresh = (cell >= 0) & (cell != last[a])
            met.append(a[fresh] * size + cell[fresh])
            last[a] = cell
        codes = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        return pa.table([pa.array(np.full(len(codes), moment)), pa.array(ids[codes // size]), pa.array(codes % size)], schema=schema)

    met = _blocks(grid, months, wind, hours, PARCELS[1]).applyInArrow(pairs, "ts timestamp_ntz, i long, cell long")
    named = cells.select("cell", F.col("pixel_id").alias("j"))
    return met.join(small_side(named, named.count()), "cell").select("ts", "i", "j").filter("i <> j")
