"""The input build: rasters to a panel, trajectories to monthly graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, panel, spatial, trajectory
from ..operators.spatial import Lattice
from ..sources.readers import lattice as lattice_cells
from ..tables import discard, materialise, small_side

#: The continental box (latitudes, longitudes) on which cells are numbered.
BOX = ((-56.0, 13.0), (-82.0, -34.0))


def domain(spark, sides: DataFrame, resolution: float, box=BOX) -> DataFrame:
    """pixel_id, latitude, longitude of the cells of the continental lattice
    within polygons; an id is the cell's number on the whole lattice, so ids of
    different domains can be compared."""
    cells = lattice_cells(spark, *box, resolution)
    inside = spatial.in_polygons(cells, sides, ["pixel_id", "latitude", "longitude"], band=resolution)
    return inside.filter("inside").select("pixel_id", "latitude", "longitude")


def at_level(wind: DataFrame) -> DataFrame:
    """The wind at the pressure level nearest to where parcels start."""
    if "level" not in wind.columns:
        return wind
    keys = ["time", "latitude", "longitude"]
    return spatial.nearest_level(wind, keys).drop("level")


def build_panel(grid: DataFrame, lai: DataFrame, wind: DataFrame, interpolate: bool = True) -> DataFrame:
    """(pixel_id, ts, lai, u, v, omega) of every cell at every shared time: each
    field from its nearest cell, null beyond one degree; leaf area with its gaps
    filled; as float.  A wind with several levels is taken at the nearest one.

    Only the cells of a field that are nearest to some cell of the grid are
    joined.  Two values in a cell at one time are an error."""
    wind = at_level(wind)
    times = materialise(spatial.common_times(lai, wind, "time"))
    n_times, n_cells = times.count(), grid.count()
    out = panel.spine(grid.select("pixel_id"), times.withColumnRenamed("time", "ts"))
    for field, variables in ((lai, ["lai"]), (wind, ["u", "v", "omega"])):
        field = panel.clean(spatial.within_times(field, times, "time"), *variables)
        own = Lattice.of(field)
        met = spatial.nearest_on_sphere(grid.select("pixel_id", "latitude", "longitude"), own).select("pixel_id", "source")
        values = field.select(own.number().alias("source"), F.col("time").alias("ts"), *[F.col(v).cast("float").alias(v) for v in variables])
        values = values.join(small_side(met.select("source").distinct(), n_cells), "source", "left_semi")
        out = out.join(small_side(met, n_cells), "pixel_id", "left").join(values, ["source", "ts"], "left").drop("source")
    out = materialise(out)
    if out.count() != n_cells * n_times:
        raise ValueError("a field has more than one value in a cell at one time")
    if interpolate:
        held, out = out, panel.fill_gaps(out, value="lai").withColumn("lai", F.col("filled").cast("float")).drop("filled")
        out = materialise(out)
        discard(held)
    return out.select("pixel_id", "ts", "lai", "u", "v", "omega")


def wind_field(wind: DataFrame, lai: DataFrame | None = None) -> DataFrame:
    """The field that moves parcels: as it is, or, with `lai`, as a panel of land
    cells would hold it: masked to land and refilled by row and column means.
    A wind cell is land if the leaf area cell nearest to it ever has a value."""
    wind = at_level(wind)
    if lai is None:
        return wind
    own, other = Lattice.of(wind), Lattice.of(lai)
    land = spatial.land_mask(lai, "lai").filter("land").select(other.number().alias("source"))
    near = spatial.nearest_on_sphere(own.cells(wind.sparkSession), other, limit=None).select("cell", "source")
    on_land = near.join(land, "source", "left_semi").select("cell", F.lit(True).alias("land"))
    values = ("u", "v", "omega")
    marked = wind.withColumn("cell", own.number()).join(small_side(on_land, own.rows * own.cols), "cell", "left")
    masked = marked.withColumns({v: F.when(F.col("land"), F.col(v)) for v in values}).drop("land", "cell")
    return spatial.row_col_fill(masked, list(values), keys=["time"])


def build(grid: DataFrame, lai: DataFrame, wind: DataFrame, resolution: float, hours: int = 120, panel_fill: bool = False, months: int | None = None, interpolate: bool = True) -> dict[str, DataFrame]:
    """panel, circulation (ts, i, j), adjacency and statistics.  The wind between
    the panel's months moves parcels; all months' trajectories are one job."""
    rows = build_panel(grid, lai, wind, interpolate)
    if months:
        rows = materialise(panel.first_periods(rows, months))
    stamps = rows.select("ts").distinct()
    field = spatial.within_times(wind_field(wind, lai if panel_fill else None), stamps.withColumnRenamed("ts", "time"), "time")
    moved = trajectory.Wind(field)
    met = materialise(trajectory.snapped_circulation(grid, stamps, moved, hours, resolution))
    discard(moved.snapshots)
    # One shuffle of links serves the share and the graph.
    pairs = materialise(graph.paired(met, ["ts"]))
    discard(met)
    share = graph.both_ways_share(pairs, ["ts"]).agg(F.avg("share").alias("mean"), F.max("share").alias("worst"))
    return {"panel": rows, "circulation": graph.one_way(pairs, ["ts"]), "adjacency": materialise(spatial.queen_adjacency(grid, resolution)), "bidirectional": share}


def contract(out: dict[str, DataFrame], cells: int, months: int, depth: int = 1) -> dict[str, bool]:
    """What a build must satisfy, by name."""
    rows, links, near = out["panel"], out["circulation"], out["adjacency"]
    back = links.select("ts", F.col("j").alias("i"), F.col("i").alias("j"))
    return {
        "columns": rows.columns == ["pixel_id", "ts", "lai", "u", "v", "omega"],
        "rows": rows.count() == cells * months,
        "no missing leaf area": rows.filter("lai is null").isEmpty(),
        "no loops": links.filter("i = j").isEmpty() and near.filter("i = j").isEmpty(),
        "no repeats": links.count() == links.distinct().count(),
        "one direction": links.join(back, ["ts", "i", "j"], "left_semi").isEmpty(),
        "linked": not graph.upwind(links, graph.shells(near, depth)).isEmpty(),
    }
