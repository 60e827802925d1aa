"""Command line: demo and full estimation, input build, smoke test, comparison."""

from __future__ import annotations

import argparse
import functools
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .operators.channels import SPECS
from .operators.panel import fill_gaps, period_index
from .operators.spatial import grid_difference, queen_adjacency
from .plans import build, estimate, figures, report
from .session import session
from .sources import months, readers, synthetic
from .sources.netcdf import read_netcdf, variables_of
from .tables import materialise, small_side


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fluxpanel", description=__doc__)
    mode = p.add_mutually_exclusive_group()
    for name, what in (("demo", "estimate a synthetic panel (the default)"), ("full", "estimate a checkpoint"), ("build-inputs", "build a checkpoint from gridded fields"), ("smoke", "build synthetic fields and check the result"), ("fetch-raw", "make monthly fields from downloaded ones")):
        mode.add_argument(f"--{name}", action="store_true", help=what)
    mode.add_argument("--verify", nargs=2, metavar=("REBUILT", "COMMITTED"), help="compare two tables of coefficients")
    p.add_argument("--spec", default="all", choices=[*[s.name for s in SPECS], "all", "both"], help='"both" is an older name of "all"')
    p.add_argument("--checkpoint", "--out", default="checkpoint")
    p.add_argument("--K", type=int, default=20)
    p.add_argument("--seed", type=int, default=synthetic.SEED)
    p.add_argument("--outputs-dir", default="outputs")
    p.add_argument("--no-figures", action="store_true")
    build_ = p.add_argument_group("building")
    build_.add_argument("--grid", help="cells as CSV; with a polygon, what its cells are compared with")
    build_.add_argument("--lai", help="parquet or NetCDF")
    build_.add_argument("--wind", help="parquet or NetCDF; one or several pressure levels")
    build_.add_argument("--time-units", help='what a numeric time in parquet counts, such as "hours since 1900-01-01"')
    build_.add_argument("--resolution", type=float, default=0.25)
    build_.add_argument("--hours-back", type=int, default=120)
    build_.add_argument("--wind-field", default="era5-native", choices=["era5-native", "panel-fill"])
    build_.add_argument("--domain-from-polygon", help="GeoJSON")
    build_.add_argument("--no-interpolate-lai", action="store_true")
    build_.add_argument("--months", type=int)
    fetch = p.add_argument_group("fetching", "downloads need accounts and a network, so the files as published come by --lai-raw and --wind-raw")
    fetch.add_argument("--what", choices=["lai", "wind", "both"], default="both")
    fetch.add_argument("--lai-raw", help="daily leaf area: parquet, a NetCDF file or a folder of them")
    fetch.add_argument("--wind-raw", help="hourly wind or monthly means, likewise")
    fetch.add_argument("--lai-out", default="lai_monthly.nc")
    fetch.add_argument("--wind-out", default="wind_monthly.nc")
    fetch.add_argument("--wind-source", choices=["hourly", "monthly-means"], default="hourly")
    fetch.add_argument("--start-year", type=int, default=1985)
    fetch.add_argument("--end-year", type=int, default=2013)
    fetch.add_argument("--cache", default="months", help="folder of the months that are done; a later run goes on from there")
    return p


def _chosen(name: str):
    return SPECS if name in ("all", "both") else tuple(s for s in SPECS if s.name == name)


def write_reports(spark, results, folder: str, mode: str, with_figures: bool = True) -> str:
    out = readers.output_folder(folder, mode)
    table = report.summary(spark, results)
    text = report.as_text(table) + "\n" + report.fit_lines(results)
    (out / "summary.txt").write_text(text)
    (out / "table.tex").write_text(report.as_latex(table, results, mode))
    if with_figures:
        (out / "decay.svg").write_text(figures.decay_figure(results))
        (out / "multiplier.svg").write_text(figures.multiplier_figure(results))
    wide = report.wide_coefficients(report.long_coefficients(spark, results))
    wide.toPandas().to_csv(out / "coefficients.csv", index=False)
    return text


def run_demo(spark, args) -> str:
    depth = min(args.K, 5)
    demo = synthetic.demo_panel(depth=depth, seed=args.seed)
    t = demo.tables(spark)
    near = queen_adjacency(t["grid"], demo.resolution)
    results = estimate.run(t["grid"], t["panel"], t["circulation"], near, depth, _chosen(args.spec), t["baseline"])
    return write_reports(spark, results, args.outputs_dir, "demo", not args.no_figures) + f"planted: {demo.truth}\n"


def run_full(spark, args) -> str:
    held = readers.read_checkpoint(spark, args.checkpoint, "grid", "panel", "circulation", "adjacency")
    panel = fill_gaps(period_index(held["panel"]).withColumn("y", F.col("lai").cast("double"))).select("pixel_id", "ts", "t", F.col("filled").alias("y"))
    stamps = panel.select("ts", "t").distinct()
    edges = held["circulation"].join(small_side(stamps, stamps.count()), "ts").select("t", "i", "j")
    results = estimate.run(held["grid"], panel, edges, held["adjacency"], args.K, _chosen(args.spec))
    return write_reports(spark, results, args.outputs_dir, "full", not args.no_figures)


def _field(spark, path: str, variables: list[str], time_units: str | None = None):
    """A gridded field from parquet, a NetCDF file or a folder of such files, of which only
    the variables of these roles are read."""
    if not path:
        raise FileNotFoundError("no path is given for " + ", ".join(variables))
    files = [path] if path.endswith(".nc") else sorted(str(f) for f in Path(path).glob("*.nc")) if Path(path).is_dir() else []
    if not files:
        return readers.read_raster(spark, path, variables, time_units=time_units)
    parts = [readers.as_raster(read_netcdf(spark, f, variables_of(f, variables)), variables, time_units=time_units) for f in files]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def run_build(spark, args) -> str:
    lai, wind = _field(spark, args.lai, ["lai"], args.time_units), _field(spark, args.wind, ["u", "v", "omega"], args.time_units)
    said = ""
    if args.domain_from_polygon:
        grid = materialise(build.domain(spark, readers.read_polygons(spark, args.domain_from_polygon), args.resolution))
        if args.grid:
            d = grid_difference(grid, readers.read_grid(spark, args.grid)).first()
            said = f"domain from polygon: {d['both'] + d['only_left']} cells; {d['both']} also in {args.grid}, {d['only_left']} only here, {d['only_right']} only there\n"
    else:
        grid = readers.read_grid(spark, args.grid)
    out = build.build(grid, lai, wind, args.resolution, args.hours_back, args.wind_field == "panel-fill", args.months, not args.no_interpolate_lai)
    readers.write_checkpoint(args.checkpoint, grid=grid, **{k: out[k] for k in ("panel", "circulation", "adjacency")})
    share = out["bidirectional"].first()
    return f"{said}written to {args.checkpoint}; bidirectional share mean {share['mean']}, worst {share['worst']}\n"


def run_fetch(spark, args) -> str:
    jobs = []
    if args.what in ("lai", "both"):
        raw = _field(spark, args.lai_raw, ["lai"], args.time_units)
        jobs.append(("lai", args.lai_out, months.leaf_area_months(raw, args.start_year, args.end_year, args.resolution), ["lai"], "monthly mean of daily values"))
    if args.what in ("wind", "both"):
        raw = build.at_level(_field(spark, args.wind_raw, ["u", "v", "omega"], args.time_units))
        jobs.append(("wind", args.wind_out, months.wind_months(raw), ["u", "v", "omega"], f"800 hPa, {args.wind_source}"))
    said = ""
    for name, out, field, variables, how in jobs:
        lacking = months.fetch(field, f"{args.cache}/{name}", out, args.start_year, args.end_year, variables, {"aggregation": how})
        said += f"written to {out}" + (f", without {len(lacking)} months that have no raw values\n" if lacking else "\n")
    return said


def run_smoke(spark, args) -> str:
    t = synthetic.smoke_rasters(spark)
    found = build.contract(build.build(t["grid"], t["lai"], t["wind"], 0.25, 48), 289, 6)
    if not all(found.values()):
        raise AssertionError(f"broken: {[k for k, ok in found.items() if not ok]}")
    return "smoke test passed: " + ", ".join(found) + "\n"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session("fluxpanel")
    if args.verify:
        left, right = (spark.read.csv(p, header=True, inferSchema=True) for p in args.verify)
        report.deviations(left, right, ["k"]).orderBy(F.desc("deviation")).show(200, truncate=False)
        return 0
    run = run_full if args.full else run_build if args.build_inputs else run_smoke if args.smoke else run_fetch if args.fetch_raw else run_demo
    try:
        print(run(spark, args))
    except (FileNotFoundError, ValueError) as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
