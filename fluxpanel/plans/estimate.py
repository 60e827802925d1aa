"""The estimation run: shells, channels, samples, six estimates, multipliers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators import estimation, graph
from ..operators.panel import after_base_year
from ..tables import discard, materialise


@dataclass
class Result:
    spec: str
    instrument: str
    fit: estimation.Fit
    beta: list[float]
    beta_se: list[float]
    omega: dict[str, float] = field(default_factory=dict)
    overidentified: dict | None = None
    note: str = ""


def upwind_edges(circulation: DataFrame, adjacency: DataFrame, depth: int) -> DataFrame:
    """(t, i, j, k), written once: every later step reads it."""
    return materialise(graph.upwind(circulation, graph.shells(adjacency, depth)))


def run(grid: DataFrame, panel: DataFrame, circulation: DataFrame, adjacency: DataFrame, depth: int, specs=ch.SPECS, supplied: DataFrame | None = None, multipliers: bool = True) -> list[Result]:
    """Estimates of every specification with the binary and the composition
    instrument.  `panel` is (pixel_id, ts, t, y) on the spine; `supplied` is a
    baseline from before the sample, of which paper-literal takes January."""
    w = upwind_edges(circulation, adjacency, depth)
    months, cells = panel.select("t").distinct().count(), grid.count()
    base_year = panel.agg(F.min(F.year("ts"))).first()[0]
    averaged, entries = {}, {}
    if multipliers:
        averaged = {"binary": materialise(graph.time_average(w, months, "t")), "composition": materialise(graph.time_average(w, months, "t", standardise=True))}
        entries = {k: v.count() for k, v in averaged.items()}
    out = []
    for spec in specs:
        if supplied is None:
            baseline = spec.baseline(panel)
        elif spec.season:
            baseline = supplied
        else:
            baseline = supplied.filter("month = 1").select("pixel_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), "y0")
        presample = supplied is not None
        finite = materialise(ch.finite_sample(ch.panel_channels(w, panel, baseline, depth)))
        counts = ch.base_year_counts(finite, base_year).first()
        note = ch.base_year_note(spec, base_year, counts["n"], counts["n_base"], presample)
        rows = after_base_year(finite, base_year) if ch.leaves_base_year(spec, presample) else finite
        binary, split, over = estimation.fit_specification(rows, depth)
        for name, fit, lo in (("binary", binary, 1), ("composition", split, depth + 1)):
            beta, se = fit.coef[lo : lo + depth].tolist(), fit.se[lo : lo + depth].tolist()
            result = Result(spec.name, name, fit, beta, se, overidentified=over if name == "binary" else None, note=note)
            if multipliers:
                a = graph.weighted_adjacency(averaged[name], dict(enumerate(beta, 1)))
                margins = graph.multiplier_margins(a, grid, entries=entries[name])
                if margins is not None:
                    m = margins.agg(F.avg("row_margin"), F.min("row_margin"), F.max("row_margin")).first()
                    result.omega = {"mean": m[0], "min": m[1], "max": m[2]}
            out.append(result)
        discard(finite)
    discard(w, *averaged.values())
    return out
