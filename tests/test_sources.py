"""NetCDF, monthly fields and figures."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxpanel.plans import figures
from fluxpanel.plans.estimate import Result
from fluxpanel.sources import months, netcdf, readers


def test_netcdf_round_trip(spark, tmp_path):
    path = str(tmp_path / "field.nc")
    axes = {"time": np.array([0.0, 744.0]), "latitude": np.array([-1.0, 0.0, 1.0]), "longitude": np.array([5.0, 6.0])}
    values = np.arange(12.0).reshape(2, 3, 2)
    values[1, 0, 0] = np.nan
    netcdf.write_netcdf(path, axes, {"lai": values, "u": values * 2}, {"lai": {"units": "1"}, "": {"title": "a field"}})
    header = netcdf.read_header(path)
    assert header.attributes == {"title": "a field"} and header.variables["lai"].attributes["units"] == "1"
    df = netcdf.read_netcdf(spark, path, cells=6)
    assert df.columns == ["time", "latitude", "longitude", "lai", "u"]
    got = {(r["time"], r["latitude"], r["longitude"]): r["lai"] for r in df.collect()}
    assert len(got) == 12 and got[744.0, -1.0, 5.0] is None and got[744.0, 1.0, 6.0] == 11.0
    with pytest.raises(ValueError, match="what it counts"):
        readers.as_raster(df, ["lai"])
    raster = readers.as_raster(df, ["lai"], time_units="hours since 1970-01-01")
    assert {r["time"].isoformat() for r in raster.select("time").distinct().collect()} == {"1970-01-01T00:00:00", "1970-02-01T00:00:00"}
    assert dict(raster.dtypes)["time"] == "timestamp_ntz" and raster.filter("lai is null").count() == 1


def test_netcdf_records(spark, tmp_path):
    """A file with a record dimension, its variables interleaved and packed."""
    import struct

    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    scale = struct.pack(">ii", 12, 1) + name("scale_factor") + struct.pack(">iid", 6, 1, 0.5)
    none = struct.pack(">ii", 0, 0)
    head = b"CDF\x01" + struct.pack(">i", 3) + struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 2)
    head += none + struct.pack(">ii", 11, 2)
    one = name("time") + struct.pack(">ii", 1, 0) + none + struct.pack(">ii", 6, 8)
    two = name("v") + struct.pack(">iii", 2, 0, 1) + scale + struct.pack(">ii", 4, 8)
    at = len(head) + len(one) + len(two) + 8
    data = b"".join(struct.pack(">dii", 10.0 * k, k, k + 100) for k in range(3))
    path = tmp_path / "r.nc"
    path.write_bytes(head + one + struct.pack(">i", at) + two + struct.pack(">i", at + 8) + data)
    got = {(r["time"], r["x"]): r["v"] for r in netcdf.read_netcdf(spark, str(path)).collect()}
    assert got == {(10.0 * k, x): (k + 100 * x) * 0.5 for k in range(3) for x in (0.0, 1.0)}


def test_netcdf_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        netcdf.read_netcdf(spark, str(tmp_path / "none.nc"))
    (tmp_path / "x.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(20))
    with pytest.raises(ValueError):
        netcdf.read_netcdf(spark, str(tmp_path / "x.nc"))


def test_netcdf_header_of_any_length(spark, tmp_path):
    path = str(tmp_path / "long.nc")
    axes = {"time": np.array([0.0]), "latitude": np.array([1.0]), "longitude": np.array([2.0])}
    netcdf.write_netcdf(path, axes, {"lai": np.ones((1, 1, 1))}, {"": {"history": "h" * 3_000_000}, "time": {"units": "days since 2001-01-01"}})
    row = netcdf.read_netcdf(spark, path).first()
    assert row["time"].isoformat() == "2001-01-01T00:00:00" and row["lai"] == 1.0
    (tmp_path / "cut.nc").write_bytes((tmp_path / "long.nc").read_bytes()[:50])
    with pytest.raises(ValueError):
        netcdf.read_header(str(tmp_path / "cut.nc"))


def test_raster_round_trip(spark, tmp_path):
    """A table with gaps, written slice by slice, reads back the same."""
    rows = spark.sql("select timestamp_ntz'2001-01-01' + make_interval(0, cast(t as int)) time, y * 0.25 latitude, x * 0.25D longitude, cast(t * 100 + y * 10 + x as float) u, cast(if(x = 2, null, t) as float) v from (select explode(sequence(0, 3)) t), (select explode(sequence(-2, 2)) y), (select explode(sequence(0, 3)) x) where not (t = 1 and y = 0)")
    rows = rows.withColumn("latitude", F.col("latitude").cast("double")).repartition(3)
    path = str(tmp_path / "out.nc")
    netcdf.write_raster(rows, path, ["u", "v"], {"": {"aggregation": "none"}, "u": {"units": "m s-1"}})
    assert netcdf.read_header(path).attributes == {"aggregation": "none"}
    back = readers.as_raster(netcdf.read_netcdf(spark, path), ["u", "v"])
    assert back.count() == 4 * 5 * 4
    assert back.filter("u is not null").exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()


def test_fetch(spark, tmp_path, capsys):
    from fluxpanel import cli

    daily = spark.sql("select timestamp_ntz'2001-01-01' + make_interval(0, 0, 0, cast(id as int)) time, 0.05 * (id % 5) + 0.025 latitude, 0.025D longitude, 1000D + id lai from range(40)")
    daily.withColumn("latitude", F.col("latitude").cast("double")).write.parquet(str(tmp_path / "daily"))
    hourly = spark.sql("select timestamp_ntz'2001-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) time, 0D latitude, 0D longitude, explode(array(70000D, 80000D)) level, cast(id as double) u, 0D v, 0D w from range(1000)")
    hourly.write.parquet(str(tmp_path / "hourly"))
    args = ["--fetch-raw", "--what", "both", "--lai-raw", str(tmp_path / "daily"), "--wind-raw", str(tmp_path / "hourly"), "--lai-out", str(tmp_path / "l.nc"), "--wind-out", str(tmp_path / "w.nc"), "--cache", str(tmp_path / "cache"), "--start-year", "2001", "--end-year", "2001"]
    for _ in range(2):
        assert cli.main(args) == 0
        assert "without 10 months" in capsys.readouterr().out
    wind = {r["time"].month: r["u"] for r in readers.as_raster(netcdf.read_netcdf(spark, str(tmp_path / "w.nc")), ["u"]).collect()}
    assert wind == {1: np.float32(np.mean(range(744))), 2: np.float32(np.mean(range(744, 1000)))}
    lai = readers.as_raster(netcdf.read_netcdf(spark, str(tmp_path / "l.nc")), ["lai"])
    assert lai.count() == 2 and lai.filter("month(time) = 1").first()["lai"] == pytest.approx(1.015, abs=1e-6)
    assert cli.main([*args[:-1], "2014"]) == 2


def test_specifications_by_name():
    from fluxpanel import cli

    assert [len(cli._chosen(n)) for n in ("all", "both", "season-matched")] == [3, 3, 1]


def test_months(spark, tmp_path):
    assert len(months.month_starts(2000, 2001)) == 24 and len(months.days_of(date(2000, 2, 1))) == 29
    raw = spark.sql("select timestamp_ntz'2001-01-05' + make_interval(0, 0, 0, cast(id as int)) time, 0.05 * (id % 5) + 0.025 latitude, 0.025 longitude, case when id = 3 then -9999 else 1000 + id end lai from range(40)")
    got = months.leaf_area_months(raw.withColumn("lai", F.col("lai").cast("double")), 2001, 2001)
    first = got.filter("month(time) = 1").first()
    cells = [[1000 + k for k in range(27) if k != 3 and k % 5 == c] for c in range(5)]
    assert first["lai"] == pytest.approx(np.mean([np.mean(c) for c in cells]) * 0.001) and first["latitude"] == 0.125
    with pytest.raises(ValueError):
        months.leaf_area_months(raw, 2001, 2014)
    folder, wanted = str(tmp_path / "cache"), [date(2001, 1, 1), date(2001, 2, 1)]
    assert months.keep_months(got, folder, wanted[:1]) == wanted[:1]
    assert months.keep_months(got, folder, wanted) == wanted[1:]
    assert months.missing_months(spark, folder, wanted) == []
    wind = raw.select("time", "latitude", "longitude", F.lit(1.0).alias("u"), F.lit(2.0).alias("v"), F.lit(0.0).alias("omega"))
    assert months.wind_months(wind).filter("u = 1 and v = 2").count() == 10


def test_leaf_area_is_a_mean_of_means(spark):
    """Cells seen on one day and on three count alike."""
    rows = [("2001-01-01", 0.025, 1000.0), *[(f"2001-01-0{k}", 0.075, 2000.0) for k in (2, 3, 4)], ("2001-01-09", 0.125, -9999.0)]
    raw = spark.createDataFrame(rows, "time string, latitude double, lai double").select(F.col("time").cast("timestamp_ntz").alias("time"), "latitude", F.lit(0.025).alias("longitude"), "lai")
    got = months.leaf_area_months(raw, 2001, 2001).collect()
    assert [(r["latitude"], r["longitude"], r["lai"]) for r in got] == [(0.125, 0.125, 1.5)]


@pytest.mark.parametrize(("native", "resolution", "origin"), [(0.05, 0.25, 0.025), (0.1, 0.25, 0.05), (0.07, 0.25, -1.0), (0.4, 0.25, 0.2), (1.0, 1.0, 0.5), (1.0, 0.3, -0.35)])
def test_overlap_mean_against_dense(spark, native, resolution, origin):
    from fluxpanel.operators.spatial import overlap_mean

    rng = np.random.default_rng(1)
    n = 13
    at, values = origin + native * np.arange(n), rng.normal(size=(n, n))
    values[rng.random((n, n)) < 0.2] = np.nan
    rows = [(1, float(at[i]), float(at[j]), None if np.isnan(values[i, j]) else float(values[i, j])) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "time int, latitude double, longitude double, value double").repartition(3)
    got = {(r["latitude"], r["longitude"]): r["value"] for r in overlap_mean(df, "value", native, resolution, ["time"]).collect()}
    lo, hi = np.floor((at[0] - native / 2) / resolution) - 1, np.ceil((at[-1] + native / 2) / resolution) + 1
    cells = np.arange(lo, hi)
    share = np.clip(np.minimum.outer((cells + 1) * resolution, at + native / 2) - np.maximum.outer(cells * resolution, at - native / 2), 0, None)
    share[share < 1e-8] = 0
    weight, there = share @ ~np.isnan(values) @ share.T, share @ np.nan_to_num(values) @ share.T
    expected = {((cells[i] + 0.5) * resolution, (cells[j] + 0.5) * resolution): there[i, j] / weight[i, j] for i, j in zip(*np.nonzero(weight > 1e-12), strict=True)}
    assert {(round(a, 6), round(b, 6)) for a, b in got} == {(round(a, 6), round(b, 6)) for a, b in expected}
    wanted = {(round(a, 6), round(b, 6)): v for (a, b), v in expected.items()}
    assert {(round(a, 6), round(b, 6)): v for (a, b), v in got.items()} == pytest.approx(wanted, rel=1e-6, abs=1e-7)


def test_figures():
    results = [Result("season-matched", "binary", None, [0.08, -0.01], [0.01, 0.01], {"mean": 1.4, "min": 1.1, "max": 1.6}), Result("paper-literal", "composition", None, [0.07, 0.02], [0.01, 0.01])]
    assert figures.decay_figure(results).count("<polyline") == 3
    assert figures.multiplier_figure(results).count("<circle") == 1


def _twins(tmp_path, new, more=0, **how):
    """One field in a classic file and in one of the HDF5-based format."""
    from . import hdf5_files

    rng = np.random.default_rng(3)
    hours, lat, lon = np.arange(10) * 6.0, np.linspace(-1, 1, 5), np.linspace(4, 7, 7)
    packed = {n: rng.integers(-30000, 30000, (10, 5, 7)).astype("<i2") for n in ("u", "v")}
    packed["u"][2, 1, 3] = -32767
    units = "hours since 2001-01-01"
    scaled = {n: np.where(p == -32767, np.nan, p * 0.25 + 100.0) for n, p in packed.items()}
    netcdf.write_netcdf(str(tmp_path / "classic.nc"), {"time": hours, "latitude": lat, "longitude": lon}, scaled, {"time": {"units": units}})
    axes = {"time": (hours.astype("<i4"), {"units": units}), "latitude": (lat, {}), "longitude": (lon.astype(">f8"), {})}
    own = {"scale_factor": np.float64(0.25), "add_offset": np.float64(100.0), "_FillValue": np.int16(-32767)}
    hdf5_files.write(tmp_path / "new.nc", axes, {n: (p, own) for n, p in packed.items()}, new, {"title": "a field"}, more, **how)
    return str(tmp_path / "classic.nc"), str(tmp_path / "new.nc")


@pytest.mark.parametrize("new", [False, True])
@pytest.mark.parametrize("how", [{}, {"chunk": (3, 2, 4), "filters": ("shuffle", "deflate")}, {"chunk": (4, 5, 7), "filters": ("deflate", "fletcher32")}])
def test_netcdf4_equals_its_classic_twin(spark, tmp_path, new, how):
    classic, hdf = _twins(tmp_path, new, 20, **how)
    a, b = netcdf.read_netcdf(spark, classic, cells=70), netcdf.read_netcdf(spark, hdf, cells=70)
    assert a.schema == b.schema and a.columns == ["time", "latitude", "longitude", "u", "v"]
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and b.filter("u is null").count() == 1
    header = netcdf.read_header(hdf)
    assert header.attributes == {"title": "a field"} and header.variables["u"].attributes["note19"] == "n" * 40
    assert b.rdd.getNumPartitions() == (5 if not how else 4 if how["chunk"][0] == 3 else 3)


def test_netcdf4_chunks_that_are_not_there(tmp_path):
    from . import hdf5_files
    from fluxpanel.sources import hdf5

    values = np.arange(24.0).reshape(6, 4)
    for new in (False, True):
        hdf5_files.write(tmp_path / "x.nc", {"time": (np.arange(6.0), {}), "x": (np.arange(4.0), {})}, {"v": (values, {})}, new, chunk=(2, 3), fill=-5.0, leave_out={(1, 0)})
        expected = values.copy()
        expected[2:4, :3] = -5
        f = hdf5.File(str(tmp_path / "x.nc"))
        assert (f.read("v") == expected).all() and (f.read("v", 3, 5) == expected[3:5]).all()


def test_netcdf4_errors(tmp_path):
    from . import hdf5_files

    hdf5_files.write(tmp_path / "x.nc", {"t": (np.arange(3.0), {})}, {"v": (np.arange(3.0), {})}, True)
    raw = (tmp_path / "x.nc").read_bytes()
    (tmp_path / "cut.nc").write_bytes(raw[:150])
    with pytest.raises(ValueError, match="early"):
        netcdf.read_header(str(tmp_path / "cut.nc"))


@pytest.mark.parametrize("kind", ["classic", "hdf5"])
def test_netcdf_pruning(spark, tmp_path, kind):
    """A filter on time and a choice of variables leave bytes unread."""
    from datetime import datetime

    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    classic, hdf = _twins(tmp_path, True, chunk=(2, 5, 7), filters=("shuffle",))
    path = classic if kind == "classic" else hdf
    at = lambda k: datetime(2001, 1, 1 + 6 * k // 24, 6 * k % 24)

    def read(names, *filters):
        reader = netcdf._PruningReader(path, names, 70)
        counted = lambda: reader.header.read_bytes + (reader.header.file.read_bytes if reader.header.file else 0)
        before = counted()
        assert list(reader.pushFilters(list(filters))) == list(filters)
        pieces = reader.partitions()
        return [(p.lo, p.hi) for p in pieces], sum(b.num_rows for p in pieces for b in reader.read(p)), counted() - before

    every, rows, both = read(["time", "latitude", "longitude", "u", "v"])
    assert every == [(k, k + 2) for k in range(0, 10, 2)] and rows == 350
    one = read(["u"])[2]
    few = read(["u"], GreaterThanOrEqual(("time",), at(3)), LessThan(("time",), at(5)))
    assert few[0] == [(2, 4), (4, 6)] and few[1] == 140 and few[2] < one < both
    assert read(["u"], EqualTo(("time",), at(9)))[0] == [(8, 10)] and read(["u"], In(("time",), (at(0), at(3))))[0] == [(0, 2), (2, 4)]
    assert read(["u"], EqualTo(("time",), datetime(1999, 1, 1)))[0] == [(0, 0)] and read(["u"], EqualTo(("latitude",), 1.0))[0] == every
    # The same through Spark, with and without its setting for Python sources.
    for on in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
        try:
            df = netcdf.read_netcdf(spark, path, ["v"], 70).filter("time >= timestamp_ntz'2001-01-01 18:00:00' and time < timestamp_ntz'2001-01-02 06:00:00'")
            assert df.columns == ["time", "latitude", "longitude", "v"] and df.count() == 70
            assert df.rdd.getNumPartitions() == (2 if on == "true" else 5)
        finally:
            spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert netcdf.variables_of(path, ["v"]) == ["v"] and netcdf.variables_of(path, ["v", "omega"]) is None
    with pytest.raises(Exception, match="no variables"):
        netcdf.read_netcdf(spark, path, ["w"])


def test_raster_writer_commits_or_leaves_nothing(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2001-01-01' + make_interval(0, 0, 0, cast(t as int)) time, cast(y as double) latitude, cast(x as double) longitude, cast(t * 100 + y * 10 + x as float) u from (select explode(sequence(0, 5)) t), (select explode(sequence(0, 3)) y), (select explode(sequence(0, 2)) x) where t <> 3")
    path = tmp_path / "out.nc"
    broken = rows.withColumn("u", F.when(F.col("u") == 211, F.raise_error(F.lit("lost")).cast("float")).otherwise(F.col("u")))
    with pytest.raises(Exception, match="lost"):
        netcdf.write_raster(broken, str(path), ["u"])
    assert list(tmp_path.iterdir()) == []
    netcdf.write_raster(rows, str(path), ["u"])
    first = path.read_bytes()
    # A run that fails leaves the file as it was; one that succeeds writes the same bytes, however it is dealt out.
    with pytest.raises(Exception, match="lost"):
        netcdf.write_raster(broken, str(path), ["u"])
    assert path.read_bytes() == first
    netcdf.write_raster(rows.repartition(7), str(path), ["u"])
    assert path.read_bytes() == first and [p.name for p in tmp_path.iterdir()] == ["out.nc"]
    # An attempt of its own that is run twice, of which one is committed.
    writer = netcdf._Writer(str(tmp_path / "twice.nc"), {"run": "r", "times": [0, 3_600_000_000], "latitude": [0.0], "longitude": [0.0, 1.0], "variables": ["u"], "attributes": {}, "fill": -1.0})
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"time": pa.array([0, 0], pa.timestamp("us")), "latitude": [0.0, 0.0], "longitude": [1.0, 0.0], "u": pa.array([4.0, 5.0], pa.float32())})
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch])), writer.write(iter([])), None])
    assert netcdf.read_variable(str(tmp_path / "twice.nc"), netcdf.read_header(str(tmp_path / "twice.nc")), "u").ravel().tolist()[:2] == [5.0, 4.0]
    assert not list(tmp_path.glob("*attempts*"))


def test_netcdf_single_record_of_odd_size(tmp_path):
    """Records of one variable of two-byte numbers follow each other without padding."""
    import struct

    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    none = struct.pack(">ii", 0, 0)
    head = b"CDF\x01" + struct.pack(">i", 4) + struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 3)
    head += none + struct.pack(">ii", 11, 1) + name("v") + struct.pack(">iii", 2, 0, 1) + none + struct.pack(">ii", 3, 8)
    path = tmp_path / "r.nc"
    path.write_bytes(head + struct.pack(">i", len(head) + 4) + np.arange(12).astype(">i2").tobytes())
    assert netcdf.read_variable(str(path), netcdf.read_header(str(path)), "v").tolist() == np.arange(12.0).reshape(4, 3).tolist()
