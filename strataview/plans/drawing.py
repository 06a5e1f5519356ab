"""Drawn plots as SVG: bars of a histogram, and the ranges of sampled values over time.

They draw what was reduced before: the bins of a histogram and the sampled values of one node.
"""

from __future__ import annotations

import datetime
import html
import math

from strataview.functions.text import ellipsize, sigfig
from strataview.plans.plots import DEFAULT_WIDTH, tick

MARGIN, AXIS, ROW = 70, 40, 20
UTC = datetime.timezone.utc
#: Unix seconds end with the year 2100.
LAST_SECOND = 4_102_444_800


def _text(x: float, y: float, text: str, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="10" text-anchor="{anchor}">{html.escape(text)}</text>'


def _page(width: int, height: int, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">{"".join(parts)}</svg>'


def number_steps(most: float, log: bool = False, at_most: int = 6) -> list[float]:
    """Round values of an axis from zero (one, if logarithmic) to ``most``."""
    if log:
        return [10.0**k for k in range(0, math.ceil(math.log10(max(most, 1))) + 1)]
    rough = max(most, 1) / at_most
    unit = 10 ** math.floor(math.log10(rough))
    step = next(unit * k for k in (1, 2, 5, 10) if unit * k >= rough)
    return [step * k for k in range(math.ceil(most / step) + 1)]


def histogram_svg(bars: list[tuple[float, int]], width: int = DEFAULT_WIDTH, height: int = 300, log: bool = False) -> str:
    """Bars (middle, count) with both axes; ``log`` scales the counts."""
    bars = sorted(bars)
    if not bars:
        return _page(width, height, [_text(width / 2, height / 2, "no values")])
    steps = number_steps(max(n for _, n in bars), log)
    scale = (lambda n: math.log10(n) if n >= 1 else 0.0) if log else float
    top = scale(steps[-1]) or 1.0
    floor, room = height - AXIS, width - MARGIN - 10
    y = lambda n: floor - (floor - 10) * scale(n) / top
    gaps = [b - a for (a, _), (b, _) in zip(bars, bars[1:], strict=False)]
    unit = min(gaps, default=1) or 1
    low, high = bars[0][0] - unit / 2, bars[-1][0] + unit / 2
    x = lambda v: MARGIN + room * (v - low) / (high - low)
    parts = [f'<line class="step" x1="{MARGIN}" x2="{width - 10}" y1="{y(s):.1f}" y2="{y(s):.1f}" stroke="#ddd"/>' + _text(MARGIN - 6, y(s) + 3, sigfig(round(s)), "end") for s in steps]
    for v, n in bars:
        parts.append(f'<rect class="bar" x="{x(v - 0.45 * unit):.1f}" y="{y(n):.1f}" width="{max(room * 0.9 * unit / (high - low), 1):.1f}" height="{floor - y(n):.1f}" fill="#4477aa"><title>{v:g}: {sigfig(n)}</title></rect>')
    every = max(1, math.ceil(len(bars) * 50 / room))
    parts += [_text(x(v), floor + 15, f"{v:g}") for v, _ in bars[::every]]
    return _page(width, height, [*parts, f'<line x1="{MARGIN}" x2="{width - 10}" y1="{floor}" y2="{floor}" stroke="black"/>'])


def seconds_of(value) -> float | None:
    """Unix seconds of a date, time or number of seconds; None for anything else."""
    if isinstance(value, datetime.datetime):
        return (value if value.tzinfo else value.replace(tzinfo=UTC)).timestamp()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day, tzinfo=UTC).timestamp()
    if isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value < LAST_SECOND:
        return float(value)
    return None


def timeline_svg(rows: list[tuple], width: int = DEFAULT_WIDTH) -> str:
    """Rows (value, count, first, last) as ranges over one time axis, with the ticks of ``plots.tick``; rows without a time are left out."""
    timed = [(str(v), n, a, b) for v, n, first, last in rows if (a := seconds_of(first)) is not None and (b := seconds_of(last)) is not None]
    height = AXIS + 10 + ROW * max(len(timed), 1)
    if not timed:
        return _page(width, height, [_text(width / 2, 20, "no times")])
    low, high = math.floor(min(r[2] for r in timed)), math.ceil(max(r[3] for r in timed))
    left, floor = 170, height - AXIS
    room = width - left - 30
    x = lambda t: left + room * (t - low) / max(high - low, 1)
    interval, label = tick(low, high, room)
    at = math.ceil(low / interval) * interval
    parts = []
    while at <= high:
        name = datetime.datetime.fromtimestamp(at, UTC).strftime(label)
        parts.append(f'<line class="tick" x1="{x(at):.1f}" x2="{x(at):.1f}" y1="5" y2="{floor}" stroke="#ddd"/>' + _text(x(at), floor + 15, name))
        at += interval
    for k, (value, n, first, last) in enumerate(timed):
        y = 15 + ROW * k
        parts.append(_text(left - 8, y + 3, ellipsize(value), "end"))
        parts.append(f'<line class="range" x1="{x(first):.1f}" x2="{max(x(last), x(first) + 2):.1f}" y1="{y}" y2="{y}" stroke="#4477aa" stroke-width="6"><title>{html.escape(value)}: {sigfig(n)}</title></line>')
    return _page(width, height, parts)


def save_svg(svg: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        file.write(svg)
