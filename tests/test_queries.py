"""Every registered query of the library beside its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from fluxpanel.plans import estimation_queries, graph_queries, job_queries, panel_queries, spatial_queries  # noqa: F401
from fluxpanel.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].isna().any() and pd.api.types.is_numeric_dtype(df[c].dropna().infer_objects()):
            df[c] = df[c].astype("float64")  # missing numbers come as NaN, None or NA
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLES[name]).df()
    assert set(got.columns) == set(expected.columns)
    assert len(got) == len(expected)
    pd.testing.assert_frame_equal(comparable(got), comparable(expected), check_dtype=False, rtol=1e-9, atol=2e-6)


def test_margins_where_all_pairs_are_linked(spark, tmp_path):
    """All nations sell to all in all months: the series needs more than 500 terms to settle."""
    con = duckdb.connect()
    for t, q in {
        "nation": "SELECT k AS n_nationkey FROM range(25) r(k)",
        "customer": "SELECT k AS c_custkey, k AS c_nationkey FROM range(25) r(k)",
        "supplier": "SELECT k AS s_suppkey, k AS s_nationkey FROM range(25) r(k)",
        "orders": "SELECT 25 * m + k AS o_orderkey, k AS o_custkey, TIMESTAMP '1995-01-15' + to_months(m::INTEGER) AS o_orderdate, 10.0::DOUBLE AS o_totalprice FROM range(2) a(m), range(25) b(k)",
        "lineitem": "SELECT o_orderkey AS l_orderkey, k AS l_suppkey, 'R' AS l_returnflag, 50.0::DOUBLE AS l_quantity FROM orders, range(25) r(k)",
        "events": f"SELECT * FROM '{FOLDER}/events.parquet'",
    }.items():
        con.sql(f"COPY ({q}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, expected = QUERIES["omega_margins"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["omega_margins"]).df()
    assert len(got) == 25 and expected["row_margin"].max() > 100
    pd.testing.assert_frame_equal(comparable(got), comparable(expected), check_dtype=False, rtol=1e-12)


@pytest.mark.parametrize("nations, settles", [(25, True), (30, False), (40, False)])
def test_margins_are_those_of_the_inverse(spark, tmp_path, nations, settles):
    """All nations sell to all: the whole multiplier, or none from a spectral radius of 1 on."""
    con = duckdb.connect()
    for t, q in {
        "nation": f"SELECT k AS n_nationkey FROM range({nations}) r(k)",
        "customer": f"SELECT k AS c_custkey, k AS c_nationkey FROM range({nations}) r(k)",
        "supplier": f"SELECT k AS s_suppkey, k AS s_nationkey FROM range({nations}) r(k)",
        "orders": f"SELECT k AS o_orderkey, k AS o_custkey, TIMESTAMP '1995-01-15' AS o_orderdate, 10.0::DOUBLE AS o_totalprice FROM range({nations}) r(k)",
        "lineitem": f"SELECT o_orderkey AS l_orderkey, k AS l_suppkey, 'R' AS l_returnflag, 50.0::DOUBLE AS l_quantity FROM orders, range({nations}) r(k)",
        "events": f"SELECT * FROM '{FOLDER}/events.parquet'",
    }.items():
        con.sql(f"COPY ({q}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, expected = QUERIES["omega_margins"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["omega_margins"]).df()
    row, col = np.divmod(np.arange(nations), 5)
    apart = np.maximum(abs(row[:, None] - row), abs(col[:, None] - col))
    a = np.select([apart == k for k in graph_queries.BETA], list(graph_queries.BETA.values()), 0.0)
    assert (abs(np.linalg.eigvals(a)).max() < 1) == settles
    whole = np.linalg.matrix_power(np.linalg.inv(np.eye(nations) - a), 2).sum(1) if settles else np.full(nations, np.nan)
    for df in (got, expected):
        df = df.sort_values("pixel_id")
        np.testing.assert_array_equal(df["pixel_id"], np.arange(nations))
        for c in ("row_margin", "col_margin"):
            np.testing.assert_allclose(df[c].astype(float), whole, rtol=1e-10)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["term", "k", "estimate", "se"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_trajectories_have_the_wind_of_all_months(spark, monkeypatch):
    from fluxpanel.operators import trajectory
    from fluxpanel.plans import fixtures, spatial_queries

    given, trace = [], trajectory.back_trajectories
    monkeypatch.setattr(trajectory, "back_trajectories", lambda cells, starts, wind, hours: given.append(len(wind.times)) or trace(cells, starts, wind, hours))
    spatial_queries.back_trajectory(spark, "/root/testdata/sf0.001")
    assert given[0] == fixtures.months(spark, "/root/testdata/sf0.001").count() > 4
