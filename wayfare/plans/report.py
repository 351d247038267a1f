"""An HTML report of a run: the iteration table, curves of convergence, histograms of the last iteration."""

from __future__ import annotations

import html
from string import Template

from wayfare.sources import files

CURVES = {
    "Surplus": ["surplus_mean"],
    "Departure time shift": ["alt_dep_time_shift_mean", "alt_dep_time_rmse"],
    "Road travel time": ["road_trip_travel_time_mean", "road_trip_exp_travel_time_mean"],
    "Expected travel time difference": ["road_trip_exp_travel_time_diff_rmse", "road_trip_exp_travel_time_abs_diff_mean"],
    "Congestion": ["road_trip_route_congestion_mean", "road_trip_global_congestion_mean"],
    "Length difference": ["road_trip_length_diff_mean"],
    "Network conditions": ["sim_road_network_cond_rmse", "exp_road_network_cond_rmse"],
}
_PAGE = Template(
    "<!doctype html><html><head><meta charset='utf-8'><title>Simulation report</title><style>body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}"
    "td,th{border:1px solid #ccc;padding:2px 8px;text-align:right}th:first-child,td:first-child{text-align:left}svg{background:#f8f8f8;margin:0 1em 1em 0}</style></head>"
    "<body><h1>Simulation report</h1>$charts<h2>Iterations</h2>$table</body></html>"
)
_COLOURS = ("#1b6ca8", "#c8553d")


def _curve(title: str, names: list[str], rows: list[dict], width: int = 420, height: int = 200) -> str:
    lines = [[(r["iteration_counter"], r[n]) for r in rows if r.get(n) is not None] for n in names]
    points = [p for line in lines for p in line]
    if not points:
        return ""
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points, strict=True))
    place = lambda x, y: f"{40 + (x - x0) / (x1 - x0 or 1) * (width - 60):.1f},{height - 30 - (y - y0) / (y1 - y0 or 1) * (height - 60):.1f}"
    drawn = "".join(f"<polyline fill='none' stroke='{c}' stroke-width='2' points='{' '.join(place(*p) for p in line)}'/>" for c, line in zip(_COLOURS, lines, strict=False) if line)
    names_ = "".join(f"<text x='{45 + 190 * i}' y='{height - 5}' font-size='10' fill='{_COLOURS[i]}'>{html.escape(n)}</text>" for i, n in enumerate(names))
    return f"<svg width='{width}' height='{height}'><text x='10' y='16' font-size='13'>{html.escape(title)} ({y0:.4g} to {y1:.4g})</text>{drawn}{names_}</svg>"


def _bars(title: str, bins: list[tuple[float, float, int]], width: int = 420, height: int = 200) -> str:
    most = max((n for _, _, n in bins), default=0) or 1
    step = (width - 20) / max(len(bins), 1)
    drawn = "".join(f"<rect x='{10 + i * step:.1f}' y='{height - 20 - n / most * (height - 50):.1f}' width='{step:.1f}' height='{n / most * (height - 50):.1f}' fill='{_COLOURS[0]}'/>" for i, (_, _, n) in enumerate(bins))
    return f"<svg width='{width}' height='{height}'><text x='10' y='16' font-size='13'>{html.escape(title)}</text>{drawn}</svg>"


def write_report(rows: list[dict], histograms: dict[str, list[tuple[float, float, int]]], folder: str) -> str:
    """``rows`` are the iteration results, one for each iteration."""
    rows = sorted(rows, key=lambda r: r["iteration_counter"])
    charts = "".join(_curve(t, n, rows) for t, n in CURVES.items()) + "".join(_bars(t, b) for t, b in histograms.items())
    names = [k for k in (rows[0] if rows else {}) if k != "iteration_counter"]
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else html.escape(str(v))
    head = "<tr><th></th>" + "".join(f"<th>{r['iteration_counter']}</th>" for r in rows) + "</tr>"
    body = "".join(f"<tr><td>{html.escape(n)}</td>" + "".join(f"<td>{show(r[n])}</td>" for r in rows) + "</tr>" for n in names)
    path = f"{folder.rstrip('/') or '.'}/report.html"
    files.write_bytes(path, _PAGE.substitute(charts=charts, table=f"<table>{head}{body}</table>").encode())
    return path
