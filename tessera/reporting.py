"""Charts as plain specifications (in Plotly's JSON form), images of them, and reports."""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame


def column_chart(frame: DataFrame, label: str, value: str, title: str = "", limit: int = 1000) -> dict:
    """Columns of an already aggregated table. Raises if it has more rows than the limit; none is left out."""
    rows = frame.select(label, value).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a column chart of {label} has more than {limit} columns")
    return {
        "data": [{"type": "bar", "x": [r[0] for r in rows], "y": [r[1] for r in rows]}],
        "layout": {"title": {"text": title}, "xaxis": {"title": {"text": label}}, "yaxis": {"title": {"text": value}}},
    }


def heat_map(values: Sequence[Sequence[float]], columns: Sequence[str], rows: Sequence[str], title: str = "") -> dict:
    """A grid of values."""
    return {
        "data": [{"type": "heatmap", "z": [list(r) for r in values], "x": list(columns), "y": list(rows), "showscale": True}],
        "layout": {"title": {"text": title}},
    }


def curve_chart(
    curve: DataFrame, points: Sequence[tuple[float, float]], lines: Sequence[tuple[str, float]], title: str = "", limit: int = 10_000
) -> dict:
    """A curve (x, density), points on it, and dashed vertical lines. Raises if the curve has more points than the limit."""
    rows = curve.select("x", "density").orderBy("x").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a curve of more than {limit} points")
    top = max((r[1] for r in rows), default=1.0)
    data = [{"type": "scatter", "mode": "lines", "name": "curve", "x": [r[0] for r in rows], "y": [r[1] for r in rows]}]
    data.append({"type": "scatter", "mode": "markers", "name": "points", "x": [p[0] for p in points], "y": [p[1] for p in points]})
    data += [{"type": "scatter", "mode": "lines", "name": n, "x": [x, x], "y": [0, top], "line": {"dash": "dash"}} for n, x in lines]
    return {"data": data, "layout": {"title": {"text": title}}}


def chart_json(chart: dict) -> str:
    return json.dumps(chart, ensure_ascii=False)


def decode_data_uri(uri: str) -> bytes:
    """The bytes of a base64 data URI, with or without its prefix."""
    return base64.b64decode(re.sub("^data:[^,]*,", "", uri))


#: Colors of axes and texts, and of series.
AXIS, INK = (120, 120, 120), (40, 40, 40)
SERIES = ((31, 119, 180), (214, 39, 40), (44, 160, 44), (148, 103, 189))

#: Letters of 3 by 5 dots, row by row. Others are shown as a full block.
GLYPHS = {
    "A": "010 101 111 101 101", "B": "110 101 110 101 110", "C": "011 100 100 100 011", "D": "110 101 101 101 110", "E": "111 100 110 100 111",
    "F": "111 100 110 100 100", "G": "011 100 101 101 011", "H": "101 101 111 101 101", "I": "111 010 010 010 111", "J": "001 001 001 101 010",
    "K": "101 101 110 101 101", "L": "100 100 100 100 111", "M": "101 111 111 101 101", "N": "110 101 101 101 101", "O": "010 101 101 101 010",
    "P": "110 101 110 100 100", "Q": "010 101 101 110 011", "R": "110 101 110 101 101", "S": "011 100 010 001 110", "T": "111 010 010 010 010",
    "U": "101 101 101 101 111", "V": "101 101 101 101 010", "W": "101 101 111 111 101", "X": "101 101 010 101 101", "Y": "101 101 010 010 010",
    "Z": "111 001 010 100 111", "0": "111 101 101 101 111", "1": "010 110 010 010 111", "2": "110 001 010 100 111", "3": "110 001 010 001 110",
    "4": "101 101 111 001 001", "5": "111 100 110 001 110", "6": "011 100 111 101 111", "7": "111 001 010 010 010", "8": "111 101 111 101 111",
    "9": "111 101 111 001 110", ".": "000 000 000 000 010", ",": "000 000 000 010 100", "-": "000 000 111 000 000", "+": "000 010 111 010 000",
    "%": "101 001 010 100 101", ":": "000 010 000 010 000", "/": "001 001 010 100 100", "(": "001 010 010 010 001", ")": "100 010 010 010 100",
    "_": "000 000 000 000 111", "=": "000 111 000 111 000", "²": "110 010 100 110 000", " ": "000 000 000 000 000",
}


def _png(width: int, height: int, pixels: bytearray) -> bytes:
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + pixels[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def chart_png(chart: dict, width: int = 600, height: int = 600) -> bytes:
    """A plain picture of a chart: columns, grids, lines and points, with its title, axes and their labels in capitals. A
    label that is longer than its place is cut."""
    pixels = bytearray(b"\xff" * (width * height * 3))
    edge = width // 12

    def dot(x: int, y: int, color: tuple[int, int, int]) -> None:
        if 0 <= x < width and 0 <= y < height:
            pixels[(y * width + x) * 3 : (y * width + x) * 3 + 3] = bytes(color)

    def box(x0: float, y0: float, x1: float, y1: float, color: tuple[int, int, int]) -> None:
        for y in range(max(0, int(y0)), min(height, int(y1))):
            a, b = max(0, int(x0)), min(width, int(x1))
            if b > a:
                pixels[(y * width + a) * 3 : (y * width + b) * 3] = bytes(color) * (b - a)

    def write(x: float, y: float, words: object, room: float = width, scale: int = 2) -> None:
        """Words from a place on, or around its middle with a minus sign before the room."""
        shown = f"{words:.4g}" if isinstance(words, float) else str(words)
        shown = shown.upper()[: max(0, int(abs(room) // (4 * scale)))]
        left = x - len(shown) * 2 * scale if room < 0 else x
        for n, c in enumerate(shown):
            for r, line in enumerate(GLYPHS.get(c, "111 111 111 111 111").split()):
                for k in range(3):
                    if line[k] == "1":
                        box(left + (n * 4 + k) * scale, y + r * scale, left + (n * 4 + k + 1) * scale, y + (r + 1) * scale, INK)

    def axes(names: Sequence[object], low: float, high: float) -> None:
        box(edge - 1, edge, edge + 1, height - edge, AXIS)
        box(edge, height - edge - 1, width - edge, height - edge + 1, AXIS)
        write(2, edge - 5, float(high), edge)
        write(2, height - edge - 5, float(low), edge)
        place = (width - 2 * edge) / max(1, len(names))
        for n, name in enumerate(names):
            write(edge + (n + 0.5) * place, height - edge + 6, name, -place)

    layout = chart.get("layout", {})
    write(width / 2, edge // 3, layout.get("title", {}).get("text", ""), -width, 3)
    for axis, y in (("xaxis", height - edge // 3), ("yaxis", edge * 2 // 3)):
        write(width / 2 if axis == "xaxis" else edge, y, layout.get(axis, {}).get("title", {}).get("text", ""), -width if axis == "xaxis" else width)

    scatter = [t for t in chart["data"] if t["type"] == "scatter" and t["x"]]
    if scatter:
        xs, ys = [x for t in scatter for x in t["x"]], [y for t in scatter for y in t["y"]]
        x0, x1, y1 = min(xs), max(xs), max(*ys, 1e-12)
        at = lambda x, y: (edge + (x - x0) / ((x1 - x0) or 1) * (width - 2 * edge), height - edge - y / y1 * (height - 2 * edge))
        axes([float(x0), float((x0 + x1) / 2), float(x1)], 0.0, y1)
        for n, t in enumerate(scatter):
            color = SERIES[n % len(SERIES)]
            places = [at(x, y) for x, y in zip(t["x"], t["y"], strict=True)]
            for x, y in places if t["mode"] == "markers" else ():
                box(x - 4, y - 4, x + 4, y + 4, color)
            for (ax, ay), (bx, by) in zip(places, places[1:], strict=False) if t["mode"] == "lines" else ():
                steps = int(max(abs(bx - ax), abs(by - ay), 1))
                for k in range(steps + 1):
                    if "line" not in t or k // 6 % 2 == 0:
                        dot(int(ax + (bx - ax) * k / steps), int(ay + (by - ay) * k / steps), color)
    for t in chart["data"]:
        if t["type"] == "bar" and t["y"]:
            low, high = (f(0.0, *(float(v or 0) for v in t["y"])) for f in (min, max))
            at = lambda v: edge + (high - v) / ((high - low) or 1) * (height - 2 * edge)
            step = (width - 2 * edge) / len(t["y"])
            for k, v in enumerate(t["y"]):
                v = float(v or 0)  # noqa: PLW2901
                box(edge + k * step + step / 8, at(max(v, 0.0)), edge + (k + 1) * step - step / 8, at(min(v, 0.0)), SERIES[0])
            axes(t["x"], low, high)
            box(edge, at(0.0) - 1, width - edge, at(0.0) + 1, AXIS)
        if t["type"] == "heatmap" and t["z"]:
            top = max(max(r) for r in t["z"]) or 1
            high, wide = (height - 2 * edge) / len(t["z"]), (width - 2 * edge) / len(t["z"][0])
            for i, r in enumerate(t["z"]):
                for j, v in enumerate(r):
                    shade = int(255 * (1 - v / top))
                    box(edge + j * wide, edge + i * high, edge + (j + 1) * wide, edge + (i + 1) * high, (shade, shade, 255))
                    write(edge + (j + 0.5) * wide, edge + (i + 0.5) * high, v, -wide)
                write(2, edge + (i + 0.5) * high, t["y"][i], edge)
            for j, name in enumerate(t["x"]):
                write(edge + (j + 0.5) * wide, height - edge + 6, name, -wide)
    return _png(width, height, pixels)


def cross_validation_report(summary: dict, title: str = "Cross-validation") -> str:
    """Markdown of a one-row summary of folds (``summarize_folds``)."""
    show = lambda x: "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = [f"# {title}", "", "| Measure | Value |", "| --- | --- |"]
    lines += [f"| {k.replace('_', ' ')} | {show(v)} |" for k, v in summary.items() if k != "fold_metrics"]
    folds = [f.asDict() if hasattr(f, "asDict") else dict(f) for f in summary.get("fold_metrics") or []]
    if folds:
        lines += ["", "| " + " | ".join(k.replace("_", " ") for k in folds[0]) + " |", "| " + " | ".join("---" for _ in folds[0]) + " |"]
        lines += ["| " + " | ".join(show(v) for v in f.values()) + " |" for f in folds]
    return "\n".join([*lines, ""])
