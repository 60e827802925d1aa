"""Estimators, graphs and trajectories beside dense numpy, and published figures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxpanel import cli
from fluxpanel.functions.tails import chi2_tail, normal_tail
from fluxpanel.operators import channels as ch
from fluxpanel.operators import estimation, graph, panel, spatial, trajectory
from fluxpanel.plans import build, estimate, report
from fluxpanel.sources import readers, synthetic


@pytest.fixture(scope="module")
def demo(spark):
    d = synthetic.demo_panel()
    t = d.tables(spark)
    near = spatial.queen_adjacency(t["grid"], d.resolution)
    return estimate.run(t["grid"], t["panel"], t["circulation"], near, d.depth, ch.SPECS[:2], t["baseline"])


#: alpha, its error, the sum of beta, least conditional F, cond(Z), m(1), m(2), mean multiplier.
FIGURES = {
    ("paper-literal", "binary"): (0.2485, 0.0366, 0.1626, 164, 1.942, -8.66, 0.26, 1.3894),
    ("paper-literal", "composition"): (0.2487, 0.0373, 0.1568, 220.1, 2.364, -8.68, 0.24, 1.2990),
    ("season-matched", "binary"): (0.2466, 0.0368, 0.1647, 128.7, 1.979, -8.64, 0.23, 1.3895),
    ("season-matched", "composition"): (0.2480, 0.0374, 0.1627, 239.9, 2.463, -8.65, 0.23, 1.3048),
}


def test_recovers_published_figures(demo):
    for r in demo:
        alpha, se, total, f, cond, m1, m2, omega = FIGURES[r.spec, r.instrument]
        assert r.fit.n == 2200 and r.fit.clusters == 100
        assert r.fit.alpha == pytest.approx(alpha, abs=6e-5)
        assert r.fit.se[0] == pytest.approx(se, abs=6e-5)
        assert sum(r.beta) == pytest.approx(total, abs=6e-5)
        assert min(r.fit.sw_f) == pytest.approx(f, rel=2e-3)
        assert r.fit.cond_z == pytest.approx(cond, abs=6e-4)
        assert r.fit.ar[1][0] == pytest.approx(m1, abs=6e-3)
        assert r.fit.ar[2][0] == pytest.approx(m2, abs=6e-3)
        assert r.omega["mean"] == pytest.approx(omega, abs=6e-5)


def test_overidentified(demo):
    found = {r.spec: r.overidentified for r in demo if r.overidentified}
    for spec, j, p, alpha in (("paper-literal", 1.3325, 0.2484, 0.2472), ("season-matched", 1.1985, 0.2736, 0.2430)):
        assert found[spec]["J"] == pytest.approx(j, abs=6e-5)
        assert found[spec]["p"] == pytest.approx(p, abs=6e-5)
        assert found[spec]["alpha"] == pytest.approx(alpha, abs=6e-5)
        assert found[spec]["n"] == 2100 and found[spec]["n_dropped"] == 100


def test_reports(spark, demo, tmp_path):
    table = report.summary(spark, demo)
    text = report.as_text(table) + report.fit_lines(demo)
    assert "0.2485" in text and "published" in text
    tex = report.as_latex(table, demo)
    assert all(part in tex for part in (r"\toprule", r"\caption", r"\label", r"\end{table}"))
    assert "before the sample" in report.fit_lines(demo)
    wide = report.wide_coefficients(report.long_coefficients(spark, demo))
    assert wide.count() == 5 and "season-matched__binary__se" in wide.columns
    same = report.deviations(wide, wide, ["k"]).toPandas()
    assert (same["deviation"] == 0).all()
    with pytest.raises(ValueError):
        report.deviations(wide.select("k"), wide.select("k"), ["k"])


def random_sample(seed, n=900, units=30, depth=2, extra=True):
    rng = np.random.default_rng(seed)
    t = np.tile(np.arange(n // units), units)
    z, e = rng.normal(size=(n, 2 + depth)), rng.normal(size=n)
    x = z[:, [0, *range(2, 2 + depth)]] * 0.8 + 0.5 * e[:, None] + rng.normal(size=(n, 1 + depth))
    y = x @ np.linspace(0.5, 1, 1 + depth) + e + 3
    df = pd.DataFrame({"pixel_id": np.repeat(np.arange(units), n // units), "t": t, "dy": y, "dyl": x[:, 0], "l2": z[:, 0], "l3": z[:, 1]})
    df["dx"], df["dz"] = x[:, 1:].tolist(), z[:, 2:].tolist()
    return df, y, x, z


def dense(y, x, z, units):
    """The textbook way, on demeaned matrices."""
    y, x, z = y - y.mean(), x - x.mean(0), z - z.mean(0)
    xh = z @ np.linalg.lstsq(z, x, rcond=None)[0]
    b = np.linalg.solve(xh.T @ xh, xh.T @ y)
    e, bread = y - x @ b, np.linalg.inv(xh.T @ xh)
    s = np.array([(xh[units == g] * e[units == g, None]).sum(0) for g in np.unique(units)])
    g, n, p = len(s), len(y), x.shape[1]
    v = g / (g - 1) * (n - 1) / (n - p) * bread @ s.T @ s @ bread
    return b, np.sqrt(np.diag(v)), np.linalg.cond(z)


@pytest.mark.parametrize("over", [False, True])
def test_2sls_matches_dense(spark, over):
    df, y, x, z = random_sample(3)
    rows = spark.createDataFrame(df).repartition(5)
    names = ["l2", "l3", "dz"] if over else ["l2", "dz"]
    zz = z if over else z[:, [0, 2, 3]]
    fit = estimation.fit_2sls(rows, "dy", ["dyl", "dx"], names, 2)
    b, se, cond = dense(y, x, zz, df["pixel_id"].to_numpy())
    np.testing.assert_allclose(fit.coef, b, rtol=1e-9)
    np.testing.assert_allclose(fit.se, se, rtol=1e-8)
    assert fit.cond_z == pytest.approx(cond, rel=1e-9)


def test_gmm(spark):
    df, y, x, z = random_sample(4)
    rows = spark.createDataFrame(df)
    out = estimation.fit_overidentified(rows, 2)
    yc, xc, zc, ids = y - y.mean(), x - x.mean(0), z - z.mean(0), df["pixel_id"].to_numpy()
    e = yc - xc @ dense(y, x, z, ids)[0]
    s = np.array([(zc[ids == g] * e[ids == g, None]).sum(0) for g in np.unique(ids)])
    w = np.linalg.inv(s.T @ s)
    a = xc.T @ zc @ w @ zc.T
    b = np.linalg.solve(a @ xc, a @ yc)
    g = zc.T @ (yc - xc @ b)
    np.testing.assert_allclose(out["coef"], b, rtol=1e-8)
    assert out["J"] == pytest.approx(g @ w @ g, rel=1e-7) and out["df"] == 1
    assert math.isnan(estimation.fit_gmm(rows, "dy", ["dyl", "dx"], ["l2", "dz"], 2)["p"])
    assert estimation.fit_overidentified(rows.limit(50), 2) is None


def test_tails():
    assert normal_tail(1.959963984540054) == pytest.approx(0.025, rel=1e-12)
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-10)
    assert chi2_tail(1.0, 1) == pytest.approx(math.erfc(math.sqrt(0.5)), rel=1e-12)
    assert chi2_tail(0, 3) == 1 and math.isnan(chi2_tail(1, 0))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_multiplier_matches_inverse(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "LOCAL_ENTRIES", limit)
    rng = np.random.default_rng(1)
    a = np.where(rng.random((12, 12)) < 0.3, rng.random((12, 12)) * 0.15, 0)
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, a double")
    cells = spark.range(12).withColumnRenamed("id", "pixel_id")
    got = graph.multiplier_margins(edges, cells).orderBy("pixel_id").toPandas()
    omega2 = np.linalg.matrix_power(np.linalg.inv(np.eye(12) - a), 2)
    np.testing.assert_allclose(got["row_margin"], omega2.sum(1), rtol=1e-10)
    np.testing.assert_allclose(got["col_margin"], omega2.sum(0), rtol=1e-10)
    loud = edges.withColumn("a", F.lit(0.9))
    assert graph.multiplier_margins(loud, cells, terms=20) is None


@pytest.mark.parametrize("limit", [0, 10**6])
def test_multiplier_of_so_many_terms(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "LOCAL_ENTRIES", limit)
    a = np.where(np.random.default_rng(2).random((6, 6)) < 0.6, 0.5, 0)
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, a double")
    got = graph.multiplier_margins(edges, spark.range(6).withColumnRenamed("id", "pixel_id"), terms=5, whole=False).orderBy("pixel_id").toPandas()
    total = sum((m + 1) * np.linalg.matrix_power(a, m) for m in range(6))
    np.testing.assert_allclose(got["row_margin"], total.sum(1), rtol=1e-12)
    np.testing.assert_allclose(got["col_margin"], total.sum(0), rtol=1e-12)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_multiplier_is_summed_until_it_settles(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "LOCAL_ENTRIES", limit)
    cells = spark.range(3).withColumnRenamed("id", "pixel_id")
    ring = lambda a: spark.createDataFrame([(i, (i + 1) % 3, a) for i in range(3)], "i long, j long, a double")
    got = graph.multiplier_margins(ring(0.3), cells, terms=4).toPandas()
    np.testing.assert_allclose(got[["row_margin", "col_margin"]], 1 / 0.7**2, rtol=1e-12)
    for a in (1.0, 1.01, math.nan):
        assert graph.multiplier_margins(ring(a), cells, terms=4) is None


def test_multiplier_of_more_than_500_terms(spark):
    edges = spark.createDataFrame([(0, 1, 0.99), (1, 0, 0.99)], "i long, j long, a double")
    got = graph.multiplier_margins(edges, spark.range(2).withColumnRenamed("id", "pixel_id")).toPandas()
    np.testing.assert_allclose(got[["row_margin", "col_margin"]], 1e4, rtol=1e-10)


def test_shells_on_irregular_lattice(spark):
    from fluxpanel.plans.fixtures import irregular

    found = graph.shells(spatial.queen_adjacency(irregular(spark), 1.0), 5).groupBy("k").count().orderBy("k").collect()
    assert [r["count"] for r in found] == [588, 904, 992, 976, 1052]
    lone = spark.createDataFrame([(1, 2), (2, 1)], "i long, j long")
    assert graph.shells(lone, 4).count() == 2
    assert graph.shells(lone.limit(0), 4).count() == 0


@pytest.mark.parametrize("symmetric", [True, False])
def test_searches_and_joins_find_the_same_shells(spark, monkeypatch, symmetric):
    rng = np.random.default_rng(6)
    links = {(int(a), int(b)) for a, b in rng.integers(0, 60, (90, 2)) if a != b}
    links |= {(b, a) for a, b in links} if symmetric else set()
    df = spark.createDataFrame([(a * 10**12, b * 10**12) for a, b in links], "i long, j long")
    found = []
    for limit in (0, 10**6):
        monkeypatch.setattr(graph, "LOCAL_LINKS", limit)
        found.append({(r["i"], r["j"], r["k"]) for r in graph.shells(df, 6).collect()})
    assert found[0] == found[1] and len({k for _, _, k in found[0]}) > 3


def test_smoke_build(spark):
    t = synthetic.smoke_rasters(spark)
    found = build.contract(build.build(t["grid"], t["lai"], t["wind"], 0.25, 24), 289, 6)
    assert all(found.values()), found


def test_panel_fill_wind(spark):
    t = synthetic.smoke_rasters(spark, months=2, size=5)
    masked = t["lai"].withColumn("lai", F.when(F.col("latitude") > -5.8, F.col("lai")))
    filled = build.wind_field(t["wind"], masked)
    assert filled.count() == t["wind"].count() and filled.filter("u is null").isEmpty()


def local_wind(raster):
    """All snapshots of a raster as one field, as a task would open them."""
    wind = trajectory.Wind(raster)
    rows = wind.snapshots.collect()
    return wind, wind.field(np.array([r["time"] for r in rows], "datetime64[us]"), [bytes(r["field"]) for r in rows])


def reached(wind, start, lat, lon, hours):
    return [(h, a, y, x) for h, at, ys, xs in trajectory.walk(wind, start, np.array(lat), np.array(lon), hours) for a, y, x in zip(at, ys, xs, strict=True)]


def test_trajectory_edges(spark):
    t = synthetic.smoke_rasters(spark, months=2, size=5)
    _, wind = local_wind(t["wind"])
    start = wind.times[1]
    out = reached(wind, start, [-5.5, 10.0], [-61.5, 0.0], 10)
    assert {p[1] for p in out} == {0} and min(p[0] for p in out) == 0
    assert not reached(wind, start, [90.0], [0.0], 5)
    wind.field[:] = np.nan
    assert len(reached(wind, start, [-5.5], [-61.5], 10)) == 1


def test_blocks_meet_only_the_wind_they_need(spark, monkeypatch):
    """Points of small blocks equal those of one walk through the whole wind, which changes in space and time."""
    t = synthetic.smoke_rasters(spark, months=6, size=9)
    raster = t["wind"].withColumns({"u": F.col("u") * (1 + F.col("latitude") / 20), "v": F.col("longitude") / 40, "omega": F.lit(0.3)})
    wind, whole = local_wind(raster)
    grid = t["grid"].filter("pixel_id % 3 = 0")
    months = raster.select(F.col("time").alias("ts")).distinct()
    first = min(wind.times)
    assert len(wind.reached(wind.times[3], 120)) == 2 and wind.reached(first, 120).tolist() == [first.astype(object)]
    assert wind.reached(wind.times[3], 1).tolist() == [wind.times[3].astype(object)]
    monkeypatch.setattr(trajectory, "PARCELS", (7, 11))
    got = {(r["ts"], r["origin"], r["h"]): (r["lat"], r["lon"]) for r in trajectory.back_trajectories(grid, months, wind, 60).collect()}
    cells = grid.orderBy("pixel_id").toPandas()
    expected = {}
    for ts in wind.times:
        for h, a, y, x in reached(whole, ts, cells["latitude"], cells["longitude"], 60):
            expected[ts.astype(object), int(cells["pixel_id"][a]), h] = (y, x)
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in expected.items())
    points = spark.createDataFrame([(k[0], k[1], *v) for k, v in got.items()], "ts timestamp_ntz, origin long, lat double, lon double")
    edges = {tuple(r) for r in trajectory.circulation(points, t["grid"], 0.25).collect()}
    assert {tuple(r) for r in trajectory.snapped_circulation(t["grid"], months, wind, 60, 0.25).filter("i % 3 = 0").collect()} == edges and edges
    holed = t["grid"].filter("pixel_id % 5 <> 0")
    edges = {tuple(r) for r in trajectory.circulation(points, holed, 0.25).collect()}
    assert {tuple(r) for r in trajectory.snapped_circulation(holed, months, wind, 60, 0.25).filter("i % 3 = 0").collect()} == {e for e in edges if e[1] % 5}
    off = t["grid"].withColumn("latitude", F.col("latitude") + F.when(F.col("pixel_id") == 4, 0.1).otherwise(0.0))
    assert trajectory.snapped_circulation(off, months, wind, 5, 0.25).count() > 0


def test_two_values_in_a_cell_are_an_error(spark):
    t = synthetic.smoke_rasters(spark, months=2, size=3)
    with pytest.raises(Exception, match="more than one value"):
        trajectory.Wind(t["wind"].unionByName(t["wind"]))
    with pytest.raises(ValueError, match="more than one value"):
        build.build_panel(t["grid"], t["lai"], t["wind"].unionByName(t["wind"]))


def levelled(raster, levels, own):
    """The raster at one of several levels, others far from it."""
    rows = raster.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    return rows.withColumns({c: F.when(F.col("level") == own, F.col(c)).otherwise(99.0) for c in ("u", "v", "omega")})


@pytest.mark.parametrize(("levels", "own"), [((70000, 80000), 80000), ((500, 775, 1000), 775)])
def test_build_takes_one_level(spark, levels, own):
    t = synthetic.smoke_rasters(spark, months=3, size=9)
    plain = build.build(t["grid"], t["lai"], t["wind"], 0.25, 24)
    out = build.build(t["grid"], t["lai"], levelled(t["wind"], levels, own), 0.25, 24)
    found = build.contract(out, 81, 3)
    assert all(found.values()), found
    for name in ("panel", "circulation"):
        assert out[name].count() == plain[name].count() and out[name].exceptAll(plain[name]).isEmpty()


@pytest.mark.parametrize(("units", "seconds", "epoch"), [("hours since 1900-01-01 00:00:0.0", 3600, "1900-01-01"), ("days since 1850-1-1", 86400, "1850-01-01"), ("seconds since 1970-01-01T00:00:00Z", 1, "1970-01-01")])
def test_build_from_files(spark, tmp_path, units, seconds, epoch):
    """Fields from NetCDF with the latitudes descending and CF times."""
    t = synthetic.smoke_rasters(spark, months=3, size=9)
    plain = build.build(t["grid"], t["lai"], t["wind"], 0.25, 24)
    for name, variables, called in (("lai", ["lai"], {"lai": "leaf_area_index"}), ("wind", ["u", "v", "omega"], {"u": "eastward_wind", "v": "V", "omega": "lagrangian_tendency_of_air_pressure"})):
        rows = t[name].toPandas().sort_values(["time", "latitude", "longitude"], ascending=[True, False, True])
        stamps = (np.sort(rows["time"].unique()).astype("datetime64[s]") - np.datetime64(epoch, "s")).astype(float) / seconds
        axes = {"valid_time": stamps, "lat": np.sort(rows["latitude"].unique())[::-1], "lon": np.sort(rows["longitude"].unique())}
        from fluxpanel.sources import netcdf

        netcdf.write_netcdf(str(tmp_path / f"{name}.nc"), axes, {called.get(v, v): rows[v].to_numpy(float).reshape(3, 9, 9) for v in variables}, {"valid_time": {"units": units}})
    fields = [cli._field(spark, str(tmp_path / f"{n}.nc"), v) for n, v in (("lai", ["lai"]), ("wind", ["u", "v", "omega"]))]
    out = build.build(t["grid"], *fields, 0.25, 24)
    assert out["panel"].exceptAll(plain["panel"]).isEmpty() and out["circulation"].exceptAll(plain["circulation"]).isEmpty()
    assert out["panel"].count() == 81 * 3 and out["circulation"].count() == plain["circulation"].count() > 0


def test_times_of_files():
    day = np.datetime64("2000-01-01", "us")
    assert readers.cf_time("days since 2000-01-01") == (86400, day)
    assert readers.cf_time("hr since 2000-01-01 06:30") == (3600, day + np.timedelta64(390, "m"))
    assert readers.cf_time("minutes since 2000-1-1 01:00:00 +01:00") == (60, day)
    assert readers.cf_time("seconds since 1999-12-31 20:00 -4") == (1, day)
    for bad in (("months since 2000-01-01",), ("days since noon",), ("days",), ("days since 2000-01-01", "noleap")):
        with pytest.raises(ValueError, match="cannot be read"):
            readers.cf_time(*bad)


def test_all_land_stays_as_it_is(spark):
    """Across the equator and the zero meridian, with leaf area half a cell beside the wind."""
    cells = readers.lattice(spark, (-0.5, 0.5), (-0.5, 0.5), 0.25)
    stamp = F.expr("timestamp_ntz'2001-01-01'").alias("time")
    wind = cells.select(stamp, "latitude", "longitude", (F.col("pixel_id") * 1.0).alias("u"), F.lit(1.0).alias("v"), F.lit(0.0).alias("omega"))
    lai = readers.lattice(spark, (-0.5, 0.5), (-0.5, 0.5), 0.25, offset=0.5).select(stamp, "latitude", "longitude", F.lit(2.0).alias("lai"))
    out = build.wind_field(wind, lai)
    assert out.count() == 25 and out.select(wind.columns).exceptAll(wind).isEmpty()
    sea = build.wind_field(wind, lai.withColumn("lai", F.when(F.col("longitude") < 0, F.col("lai"))))
    assert 0 < sea.select(wind.columns).exceptAll(wind).count() <= 10


def test_nearest_across_the_date_line(spark):
    globe = spatial.Lattice(-89.5, 0.5, 1.0, 1.0, 180, 360)
    rng = np.random.default_rng(4)
    lat, lon = rng.uniform(-89.9, 89.9, 300), rng.uniform(-180, 360, 300)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon, strict=True))], "pixel_id long, latitude double, longitude double")
    got = {r["pixel_id"]: (r["source"], r["degrees"]) for r in spatial.nearest_on_sphere(df, globe).collect()}
    xyz = lambda a, b: np.stack([np.cos(np.radians(a)) * np.cos(np.radians(b)), np.cos(np.radians(a)) * np.sin(np.radians(b)), np.sin(np.radians(a))], -1)
    cells = xyz(*np.meshgrid(globe.lat + np.arange(180), globe.lon + np.arange(360), indexing="ij")).reshape(-1, 3)
    for k in range(300):
        away = np.linalg.norm(cells - xyz(lat[k], lon[k]), axis=1)
        assert away[got[k][0]] == pytest.approx(away.min(), abs=1e-11)
        assert got[k][1] == pytest.approx(np.degrees(2 * np.arcsin(away.min() / 2)), abs=1e-6)


def test_domain_on_the_continental_lattice(spark):
    square = [(0.1, 0.1), (0.1, 1.1), (1.1, 1.1), (1.1, 0.1)]
    sides = spark.createDataFrame([("p", 0, -60 + a, -3 + b, -60 + c, -3 + d) for (a, b), (c, d) in zip(square, square[1:] + square[:1], strict=True)], "polygon string, ring int, lon1 double, lat1 double, lon2 double, lat2 double")
    got = {r["pixel_id"]: (r["latitude"], r["longitude"]) for r in build.domain(spark, sides, 0.25).collect()}
    assert len(got) == 16
    assert all(k == round((a + 56) / 0.25) * 193 + round((b + 82) / 0.25) for k, (a, b) in got.items())


def test_notes_on_the_base_year():
    paper, season, kept = ch.SPECS
    assert ch.base_year_note(paper, 2000, 10, 3) == ""
    assert ch.base_year_note(season, 2000, 10, 3) == "baseline year 2000 left out: 3 of 10 rows (30.00%)"
    assert "retained: 3 of 10" in ch.base_year_note(kept, 2000, 10, 3)
    assert "before the sample" in ch.base_year_note(season, 2000, 10, 3, presample=True)


def test_gaps_and_baselines(spark):
    rows = [(1, 1, 1.0), (1, 2, None), (1, 4, 4.0), (2, 1, None), (2, 2, None), (2, 4, None), (3, 1, None), (3, 2, 7.0), (3, 4, None)]
    df = spark.createDataFrame([(u, f"2001-01-0{d}", y) for u, d, y in rows], "pixel_id long, day string, y double").selectExpr("pixel_id", "cast(day as timestamp_ntz) ts", "y")
    got = {(r["pixel_id"], r["ts"].day): r["filled"] for r in panel.fill_gaps(df).collect()}
    assert got[1, 2] == pytest.approx(2.0) and got[2, 1] is None and got[3, 1] == 7.0 and got[3, 4] == 7.0
    first = {r["pixel_id"]: r["y0"] for r in panel.first_observation(df).filter("month = 5").collect()}
    assert first == {1: 1.0, 2: 0.0, 3: 7.0}
    season = {(r["pixel_id"], r["month"]): r["y0"] for r in panel.season_baseline(df).collect()}
    assert season[1, 1] == 2.5 and season[1, 6] == 2.5 and season[2, 1] == 0.0
    assert panel.season_baseline(df, base_year=1900).count() == 36
    empty = df.limit(0)
    assert panel.fill_gaps(empty).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "grid.csv").write_text("latitude,longitude,pixel_id\n1,2,9\n3,4,5\n")
    assert [r["pixel_id"] for r in readers.read_grid(spark, str(tmp_path / "grid.csv")).collect()] == [5, 9]
    with pytest.raises(ValueError):
        readers.grid(spark.range(1))
    with pytest.raises(KeyError):
        spatial.column_alias(spark.range(1), {"lai": ["lai"]})
    with pytest.raises(FileNotFoundError):
        readers.read_raster(spark, str(tmp_path / "none"), ["lai"])
    square = [[[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]
    import json

    for name, shape in (("p", {"type": "Polygon", "coordinates": square}), ("m", {"type": "MultiPolygon", "coordinates": [square]}), ("f", {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(shape))
        sides = readers.read_polygons(spark, str(tmp_path / f"{name}.json"))
        assert sides.count() == 8
        points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 5.0)], "pixel_id long, latitude double, longitude double")
        assert {r["pixel_id"]: r["inside"] for r in spatial.in_polygons(points, sides, ["pixel_id"]).collect()} == {1: True, 2: False, 3: False}
    (tmp_path / "x.json").write_text('{"type": "Point"}')
    with pytest.raises(ValueError):
        readers.read_polygons(spark, str(tmp_path / "x.json"))
    raster = spark.createDataFrame([("2001-01-01", 1.0, 2.0, -9999.0), ("2001-01-01", 1.0, 3.0, 5.0)], "valid_time string, lat double, lon double, LAI double")
    raster.write.parquet(str(tmp_path / "r"))
    got = readers.read_raster(spark, str(tmp_path / "r"), ["lai"], sentinel=-9999.0)
    assert got.columns == ["time", "latitude", "longitude", "lai"] and got.filter("lai is null").count() == 1


def test_checkpoint_round_trip(spark, tmp_path):
    t = synthetic.demo_panel(4, 4, 4, 2).tables(spark)
    readers.write_checkpoint(str(tmp_path / "c"), grid=t["grid"], panel=t["panel"])
    back = readers.read_checkpoint(spark, str(tmp_path / "c"), "grid", "panel")
    assert back["panel"].count() == 64
    with pytest.raises(FileNotFoundError):
        readers.read_checkpoint(spark, str(tmp_path / "none"), "grid")
    assert readers.output_folder(str(tmp_path), "demo") != readers.output_folder(str(tmp_path), "full")


def test_empty_time_axes(spark):
    a = spark.sql("select timestamp_ntz'2001-01-01' ts")
    b = spark.sql("select timestamp_ntz'2002-01-01' ts")
    with pytest.raises(ValueError):
        spatial.common_times(a, b)


def test_streaming_daily_means(spark, tmp_path):
    from fluxpanel.streaming.monthly import append_to, daily_means

    rows = spark.sql("select timestamp'2001-01-01' + make_interval(0, 0, 0, 0, cast(id as int), 0, 0) ts, id % 3 as k, cast(id as double) v from range(240)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    append_to(daily_means(stream, "ts", "v", "k"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    full = {(r["k"], r["day"]): r["v"] for r in daily_means(rows, "ts", "v", "k").collect()}
    assert 0 < got.count() < len(full)
    assert all(full[r["k"], r["day"]] == r["v"] for r in got.collect())


def test_long_axis_equals_short(spark):
    """The as-of join over stretches of an axis, crowded in one place, beside the one over a whole array."""
    from fluxpanel.operators.spatial import bracket

    stamp = F.expr("timestamp_ntz'2001-01-01' + make_dt_interval(0, 0, 0, cast(s as decimal(18, 6)))")
    at = F.when(F.col("id") % 3 == 0, F.col("id") * 0.001).otherwise(F.col("id") * 37.5)
    axis = spark.range(5000).select(at.alias("s")).select(stamp.alias("ts")).union(spark.createDataFrame([(None,)], "ts timestamp_ntz"))
    events = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, F.lit(7.5015)).otherwise(F.col("id") * 70.0 - 500).alias("s")).select("id", stamp.alias("at"))
    events = events.union(spark.createDataFrame([(9999, None)], "id long, at timestamp_ntz")).union(axis.limit(300).select(F.lit(7).cast("long"), "ts"))
    short, long = (sorted(map(str, bracket(events, axis, "at", ["id"], short=n).collect())) for n in (10_000, 100))
    assert short == long and len(short) == events.count()
    plan = bracket(events, axis, "at", ["id"], short=100)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    none = bracket(events, axis.limit(0), "at", ["id"]).collect()
    assert len(none) == len(short) and all(r["t0"] is None and r["t1"] is None and r["w1"] == 0 for r in none)


def test_pairs_in_one_shuffle(spark):
    from fluxpanel.operators import graph

    rng = np.random.default_rng(0)
    rows = [(int(t), int(i), int(j)) for t, i, j in rng.integers(0, [3, 12, 12], (400, 3))]
    df = spark.createDataFrame(rows, "ts int, i int, j int")
    links = {(t, i, j) for t, i, j in rows if i != j}
    kept = {(t, i, j) for t, i, j in links if i < j or (t, j, i) not in links}
    got = graph.unidirectional(df, ["ts"])
    assert sorted(map(tuple, got.select("ts", "i", "j").collect())) == sorted(kept)
    share = {r["ts"]: r["share"] for r in graph.bidirectional_share(df, ["ts"]).collect()}
    assert share == {t: sum((t, j, i) in links for s, i, j in links if s == t) / sum(s == t for s, _, _ in links) for t in range(3)}
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_links_of_a_checkpoint_do_not_move(spark, tmp_path):
    """Shells meet the buckets of the links: no exchange above the scan of the links."""
    from fluxpanel.operators import graph
    from fluxpanel.sources import readers

    rng = np.random.default_rng(1)
    rows = sorted({(f"2001-{int(t) + 1:02}-01", int(i), int(j)) for t, i, j in rng.integers(0, [6, 40, 40], (3000, 3)) if i != j})
    links = spark.createDataFrame(rows, "ts string, i long, j long").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "i", "j")
    folder = str(tmp_path / "it's a checkpoint")
    for _ in range(2):
        readers.write_checkpoint(folder, 8, circulation=links)
    held = readers.read_checkpoint(spark, folder, "circulation")["circulation"]
    assert held.schema == links.schema and held.exceptAll(links).isEmpty() and links.exceptAll(held).isEmpty()
    shell = spark.range(1600).select((F.col("id") % 40).alias("i"), (F.col("id") / 40).cast("long").alias("j"), F.lit(1).alias("k")).filter("i <> j").repartition(3)
    stamps = links.select("ts").distinct().withColumn("t", F.dense_rank().over(Window.orderBy("ts")))
    edges = held.join(F.broadcast(stamps), "ts").select("t", "i", "j")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.upwind(edges, shell)
        n = found.count()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n == len(rows)
    join = plan[plan.index("SortMergeJoin") :] if "SortMergeJoin" in plan else plan[plan.index("ShuffledHashJoin") :]
    left = join[: join.index("Range (")]
    assert "Bucketed: true" in left and left.count("Exchange hashpartitioning(i") == 1, plan
    # A folder without a layout is read as it is.
    links.write.parquet(f"{tmp_path}/old/circulation")
    assert readers.read_checkpoint(spark, f"{tmp_path}/old", "circulation")["circulation"].count() == len(rows)


@pytest.mark.parametrize("size", [1, 3, 7])
def test_scores_over_the_edges_of_blocks(spark, size):
    """Units of any length, with periods left out and rows that do not count, in blocks of few rows."""
    from fluxpanel.operators import estimation

    rng = np.random.default_rng(5)
    rows = []
    for unit in range(12):
        for t in range(int(rng.integers(1, 30))):
            if rng.random() < 0.85:
                v = rng.normal(size=7).tolist()
                rows.append((unit, t, v[0], v[1], v[2], v[3] if rng.random() < 0.7 else None, v[4:5], v[5:6]))
    df = spark.createDataFrame(rows, "pixel_id long, t int, dy double, dyl double, l2 double, l3 double, dx array<double>, dz array<double>")
    whole = estimation.fit_specification(df.withColumns({c: F.col("dx") for c in ("xc", "xm", "zc", "zm")}).withColumns({"xm": F.array(F.col("dyl") * F.col("l2")), "zm": F.array(F.col("l2") * F.col("l2"))}), 1, 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        parts = estimation.fit_specification(df.repartition(5).withColumns({c: F.col("dx") for c in ("xc", "xm", "zc", "zm")}).withColumns({"xm": F.array(F.col("dyl") * F.col("l2")), "zm": F.array(F.col("l2") * F.col("l2"))}), 1, 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, b in zip(whole[:2], parts[:2], strict=True):
        assert np.allclose(a.coef, b.coef) and np.allclose(a.se, b.se) and (a.n, a.clusters) == (b.n, b.clusters)
        assert all(np.allclose(a.ar[o], b.ar[o]) for o in (1, 2))
    assert whole[2]["J"] == pytest.approx(parts[2]["J"]) and whole[2]["n"] == parts[2]["n"] < whole[0].n


def test_lags_of_a_stream_equal_the_batch(spark, tmp_path):
    """Months that arrive in three runs, some of them late or twice."""
    from fluxpanel.operators.panel import panel_lags
    from fluxpanel.streaming.monthly import append_to, lagged_stream

    rng = np.random.default_rng(2)
    rows = [(u, t, None if rng.random() < 0.2 else float(rng.normal())) for u in range(5) for t in range(9)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for months in ((0, 3), (3, 4), (4, 9)):
        new = [r for r in rows if months[0] <= r[1] < months[1]]
        late = [(1, 2, 99.0), (1, 3, 98.0)] if months[0] == 4 else []
        rng.shuffle(new)
        spark.createDataFrame([*[(int(u), int(t), y) for u, t, y in new], *late, (None, 1, 2.0)], "pixel_id long, t int, y double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("pixel_id long, t int, y double").parquet(source)
        append_to(lagged_stream(stream), out, str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(out)
    columns = ("pixel_id", "t", "y", "dy", "dyl", "l2", "l3")
    expected = panel_lags(spark.createDataFrame(rows, "pixel_id long, t int, y double")).select(*columns)
    assert sorted(map(str, found.filter("not late").select(*columns).collect())) == sorted(map(str, expected.collect()))
    assert sorted((r["t"], r["y"], r["dy"]) for r in found.filter("late").collect()) == [(2, 99.0, None), (3, 98.0, None)]


def test_lags_of_a_stream_with_gaps():
    from fluxpanel.streaming.monthly import _advance

    held, seen = (None, None, None, None), []
    for t in (1, 2, 4, 8, 9):
        held, earlier = _advance(held, t, float(t))
        seen.append(earlier)
    assert seen == [[None] * 3, [1.0, None, None], [None, 2.0, 1.0], [None] * 3, [8.0, None, None]]
