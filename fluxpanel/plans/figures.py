"""Two figures as SVG: coefficient profiles, and the spread of multipliers."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

from .estimate import Result
from .report import PUBLISHED_BETA

#: Distinguishable with any colour vision.
COLOURS = ("#0072B2", "#D55E00", "#009E73", "#CC79A7", "#E69F00", "#56B4E9", "#333333")
WIDTH, HEIGHT, MARGIN = 720, 420, 60


def _frame(body: list[str], title: str, x: str, y: str) -> str:
    base = [
        f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="12">',
        f'<rect width="{WIDTH}" height="{HEIGHT}" fill="white"/>',
        f'<text x="{WIDTH / 2}" y="24" text-anchor="middle" font-size="15">{escape(title)}</text>',
        f'<text x="{WIDTH / 2}" y="{HEIGHT - 12}" text-anchor="middle">{escape(x)}</text>',
        f'<text transform="translate(16 {HEIGHT / 2}) rotate(-90)" text-anchor="middle">{escape(y)}</text>',
    ]
    return "\n".join([*base, *body, "</svg>"]) + "\n"


def _scale(lo: float, hi: float, a: float, b: float):
    span = hi - lo or 1.0
    return lambda v: a + (v - lo) / span * (b - a)


def decay_figure(results: Sequence[Result]) -> str:
    """Coefficients by lag, one line an estimate, and the published profile."""
    lines = [(f"{r.spec} / {r.instrument}", r.beta) for r in results]
    depth = max((len(b) for _, b in lines), default=len(PUBLISHED_BETA))
    lines.append(("published", list(PUBLISHED_BETA[:depth])))
    values = [v for _, b in lines for v in b] + [0.0]
    x, y = _scale(1, max(depth, 2), MARGIN, WIDTH - 190), _scale(min(values), max(values), HEIGHT - MARGIN, MARGIN)
    body = [f'<line x1="{MARGIN}" x2="{WIDTH - 190}" y1="{y(0):.1f}" y2="{y(0):.1f}" stroke="#999"/>']
    body += [f'<text x="{x(k):.1f}" y="{HEIGHT - MARGIN + 18}" text-anchor="middle">{k}</text>' for k in range(1, depth + 1)]
    body += [f'<text x="{MARGIN - 6}" y="{y(v) + 4:.1f}" text-anchor="end">{v:.3f}</text>' for v in (min(values), max(values))]
    for k, (name, beta) in enumerate(lines):
        colour = COLOURS[k % len(COLOURS)]
        path = " ".join(f"{x(i):.1f},{y(v):.1f}" for i, v in enumerate(beta, 1))
        body += [f'<polyline points="{path}" fill="none" stroke="{colour}" stroke-width="2"/>', f'<text x="{WIDTH - 180}" y="{MARGIN + 18 * k}" fill="{colour}">{escape(name)}</text>']
    return _frame(body, "Coefficients by lag", "lag", "coefficient")


def multiplier_figure(results: Sequence[Result]) -> str:
    """Mean, least and greatest row sum of the squared multiplier."""
    rows = [(f"{r.spec} / {r.instrument}", r.omega) for r in results if r.omega]
    values = [v for _, o in rows for v in o.values()] + [1.0, 2.0]
    x, y = _scale(min(values), max(values), 220, WIDTH - MARGIN), _scale(0, max(len(rows) - 1, 1), MARGIN + 20, HEIGHT - MARGIN - 20)
    body = [f'<text x="{x(v):.1f}" y="{HEIGHT - MARGIN + 18}" text-anchor="middle">{v:.2f}</text>' for v in (min(values), max(values))]
    for k, (name, o) in enumerate(rows):
        colour = COLOURS[k % len(COLOURS)]
        body += [
            f'<text x="210" y="{y(k) + 4:.1f}" text-anchor="end">{escape(name)}</text>',
            f'<line x1="{x(o["min"]):.1f}" x2="{x(o["max"]):.1f}" y1="{y(k):.1f}" y2="{y(k):.1f}" stroke="{colour}" stroke-width="3"/>',
            f'<circle cx="{x(o["mean"]):.1f}" cy="{y(k):.1f}" r="6" fill="{colour}"/>',
        ]
    return _frame(body, "Row sums of the squared multiplier", "row sum", "")
