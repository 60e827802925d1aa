"""The runnable jobs: reruns, growing input, broken runs, command lines."""

import json
import logging
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fluxpanel.operators.panel import keyed_lags, shift
from jobs import config, daily_panel, dialogue_panel

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(k, day, cell, value, hour=3):
    props = None if cell is None else json.dumps({"k": cell})
    ts = None if day is None else datetime(2024, 1, 1, hour) + timedelta(days=day)
    return (k, ts, 1, "view", value, props)


def add(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))


def brute(rows):
    sums = {}
    for _, ts, _, _, value, props in rows:
        if ts is None or value is None or props is None:
            continue
        own = sums.setdefault((json.loads(props)["k"], (ts.date() - date(1970, 1, 1)).days), [0, 0])
        own[0] += 1
        own[1] += round(value * 100)
    y = {k: c / (n * 100.0) for k, (n, c) in sums.items()}
    out = []
    for (cell, t), (n, c) in sums.items():
        back = [y.get((cell, t - k)) for k in range(4)]
        minus = lambda a, b: None if a is None or b is None else a - b
        out.append((cell, t, n, c, back[0], minus(back[0], back[1]), minus(back[1], back[2]), back[2], back[3]))
    return sorted(out)


def held(spark, folder):
    cols = ("pixel_id", "t", "n", "cents", "y", "dy", "dyl", "l2", "l3")
    return sorted(tuple(r) for r in daily_panel.read_panel(spark, str(folder)).select(*cols).collect())


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("part-*.parquet")}


FIRST = [event(k, k % 9, k % 4, (k * 37 % 101) / 4) for k in range(80)] + [event(900, None, 1, 2.0), event(901, 2, None, 2.0), event(902, 2, 1, None)]
LATE = [event(1000 + k, 2, 3, 50.5 + k) for k in range(3)] + [event(2000 + k, 12, k, 7.25) for k in range(4)]


def test_daily_panel_over_growing_input(spark, tmp_path, caplog):
    source, out = tmp_path / "events", tmp_path / "out"
    settings = daily_panel.Config(str(source), str(out), 1)
    add(spark, source, FIRST)
    with caplog.at_level(logging.INFO):
        done = daily_panel.run(spark, settings)
    assert (done.rows_read, len(done.touched)) == (len(FIRST), 9) and held(spark, out) == brute(FIRST)
    assert f"read {len(FIRST)} new rows" in caplog.text
    before = files(out / "panel")
    # Nothing new: nothing is read or written.
    done = daily_panel.run(spark, settings)
    assert (done.rows_read, done.rows_written, done.touched) == (0, 0, []) and files(out / "panel") == before
    # Late rows of day 2 and a new day 12: days 2 to 5 and 12 are made anew, no other file changes.
    add(spark, source, LATE)
    done = daily_panel.run(spark, settings)
    assert done.rows_read == len(LATE) and [d[-2:] for d in done.touched] == ["03", "04", "05", "06", "13"]
    assert held(spark, out) == brute(FIRST + LATE)
    kept = {f for f in before if not any(f"day={d}" in f for d in done.touched)}
    assert kept <= files(out / "panel") and len(kept) == 5
    # One run over all of it comes to the same.
    other = tmp_path / "other"
    daily_panel.run(spark, daily_panel.Config(str(source), str(other)))
    assert held(spark, other) == held(spark, out)


def test_daily_panel_goes_on_after_a_broken_run(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "events", tmp_path / "out"
    settings = daily_panel.Config(str(source), str(out))
    add(spark, source, FIRST)
    daily_panel.run(spark, settings)
    add(spark, source, LATE)
    # The stream took the files, and the panel was not brought up to date.
    with monkeypatch.context() as m:
        m.setattr(daily_panel, "refresh", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            daily_panel.run(spark, settings)
    assert held(spark, out) == brute(FIRST)
    done = daily_panel.run(spark, settings)
    assert done.rows_read == 0 and held(spark, out) == brute(FIRST + LATE)
    # A batch that is run again replaces its own sums.
    import shutil

    for name in ("commits/1", "commits/.1.crc"):
        (out / "_stream" / name).unlink(missing_ok=True)
    again = daily_panel.run(spark, settings)
    assert again.rows_read == len(LATE) and held(spark, out) == brute(FIRST + LATE)
    # A day whose partition is gone comes back.
    shutil.rmtree(out / "panel" / "day=2024-01-05")
    assert daily_panel.run(spark, settings).touched == ["2024-01-05"] and held(spark, out) == brute(FIRST + LATE)


def test_daily_panel_of_nothing(spark, tmp_path):
    source, out = tmp_path / "events", tmp_path / "out"
    add(spark, source, [])
    for _ in range(2):
        done = daily_panel.run(spark, daily_panel.Config(str(source), str(out)))
        assert done.touched == [] and held(spark, out) == []


TURNS = "conv_id long, turn long, role string, text string"


def test_dialogue_panel(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", " ".join("w" * int(rng.integers(1, 40)))) for c in range(60) for t in range(int(rng.integers(2, 9)))]
    rows += [(99, t, "system", "a b") for t in range(5)] + [(None, 1, "user", "x"), (5, None, "user", "x"), (3, 40, "user", None), (3, 41, None, "a  b\tc")]
    source, out = str(tmp_path / "turns"), str(tmp_path / "out")
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(source)
    settings = dialogue_panel.Config(source, out)
    done = dialogue_panel.run(spark, settings)
    first = sorted(map(tuple, dialogue_panel.read_sample(spark, out).collect()), key=str)
    estimates = {r["role"]: r for r in dialogue_panel.read_estimates(spark, out).collect()}
    assert done.rows_read == len(rows) and done.rows_written == len(first) and set(estimates) == {"user", "assistant"}

    y = {(c, t): None if x is None else len(x.split()) for c, t, _, x in rows if c is not None and t is not None}
    for role, fit in estimates.items():
        own = [(c, t) for c, t, r, _ in rows if r == role and (c, t) in y and all(y.get((c, t - k)) is not None for k in range(3))]
        a = np.array([[y[c, t] - y[c, t - 1], y[c, t - 1] - y[c, t - 2], y[c, t - 2]] for c, t in own], float)
        a = a - a.mean(0)
        alpha = a[:, 2] @ a[:, 0] / (a[:, 2] @ a[:, 1])
        e = a[:, 0] - alpha * a[:, 1]
        scores = {}
        for (c, _), s in zip(own, a[:, 2] * e, strict=True):
            scores[c] = scores.get(c, 0.0) + s
        g, n = len(scores), len(own)
        se = np.sqrt(sum(s * s for s in scores.values()) * g / (g - 1) * (n - 1) / (n - 1)) / abs(a[:, 2] @ a[:, 1])
        assert (fit["n"], fit["clusters"]) == (n, g)
        assert fit["alpha"] == pytest.approx(alpha, rel=1e-9) and fit["se"] == pytest.approx(se, rel=1e-9)
        residuals = sorted(r["residual"] for r in dialogue_panel.read_sample(spark, out).filter(F.col("role") == role).collect())
        assert residuals == pytest.approx(sorted(e.tolist()), abs=1e-9)
    # A run again leaves the same.
    dialogue_panel.run(spark, settings)
    assert sorted(map(tuple, dialogue_panel.read_sample(spark, out).collect()), key=str) == first


def test_dialogue_panel_of_nothing(spark, tmp_path):
    source, out = str(tmp_path / "turns"), str(tmp_path / "out")
    spark.createDataFrame([], TURNS).write.parquet(source)
    assert dialogue_panel.run(spark, dialogue_panel.Config(source, out)).rows_written == 0
    assert dialogue_panel.read_sample(spark, out).count() == dialogue_panel.read_estimates(spark, out).count() == 0


def test_keyed_lags_equal_shifts(spark):
    rows = [(u, t, float(u * 10 + t) if (u + t) % 5 else None, f"r{t}") for u in range(4) for t in range(12) if (u * t) % 7 != 3]
    df = spark.createDataFrame(rows, "u long, t int, y double, r string")
    got = keyed_lags(df, ["u"], "t", "y", (1, 2, 3), ["r"])
    expected = df.select("u", "t", "r", "y", *[shift("y", k, ["u"]).alias(f"lag{k}") for k in (1, 2, 3)])
    assert sorted(map(str, got.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("job", [daily_panel, dialogue_panel])
def test_settings(job):
    name = job.__name__.split(".")[1]
    given = json.loads((Path(job.__file__).with_name(f"{name}.json")).read_text())
    assert config.parsed(job.Config, given)
    with pytest.raises(ValueError, match="unknown"):
        config.parsed(job.Config, given | {"other": 1})
    with pytest.raises(ValueError, match="output"):
        config.parsed(job.Config, {"input": "x"})


def test_command_line(spark, tmp_path):
    """The whole program, in a process and session of its own."""
    import os
    import subprocess
    import sys

    source, out = tmp_path / "events", tmp_path / "out"
    add(spark, source, FIRST)
    (tmp_path / "settings.json").write_text(json.dumps({"input": str(source), "output": "replaced"}))
    repo = Path(daily_panel.__file__).parent.parent
    told = [sys.executable, "-m", "jobs.daily_panel", "--config", str(tmp_path / "settings.json"), "--output", str(out)]
    env = os.environ | {"PYTHONPATH": str(repo), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir={tmp_path} pyspark-shell"}
    done = subprocess.run(told, cwd=repo, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read 83 new rows" in done.stderr, done.stderr[-2000:]
    assert held(spark, out) == brute(FIRST)
