"""Vector paths: reading, normalising, flattening and dashing of path text, a path a row."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numbers that each command takes.
ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
FLATNESS, DEEPEST = 0.25, 16
_NUMBER = re.compile(r"[ ,\t\r\n]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
_FLAG = re.compile(r"[ ,\t\r\n]*([01])")
_COMMAND = re.compile(r"[ ,\t\r\n]*([MmLlHhVvCcSsQqTtAaZz])")


def parse(d: str) -> list[tuple]:
    """Commands as written; a repeated move is a line. Reading stops at what is no path."""
    out, at, n = [], 0, len(d)
    while at < n and (m := _COMMAND.match(d, at)):
        at, op, first = m.end(), m[1], True
        k = ARITY[op.upper()]
        while True:
            values, p = [], at
            for j in range(k):
                m = (_FLAG if op in "Aa" and j in (3, 4) else _NUMBER).match(d, p)
                if m is None:
                    break
                values.append(float(m[1]))
                p = m.end()
            if len(values) < k or (not first and not k):
                break
            out.append((op if first or op not in "Mm" else "L" if op == "M" else "l", *values))
            at, first = p, False
            if not k:
                break
    return out


def normalise(commands: list[tuple]) -> list[tuple]:
    """Only absolute M, L, C, Q, A and Z."""
    out: list[tuple] = []
    x = y = sx = sy = 0.0
    last = None
    for op, *v in commands:
        up, rel = op.upper(), op.islower()
        if up == "Z":
            out.append(("Z",))
            x, y, last = sx, sy, None
            continue
        if up == "H":
            v = [v[0] + (x if rel else 0), y]
        elif up == "V":
            v = [x, v[0] + (y if rel else 0)]
        elif up == "A":
            v = [*v[:5], v[5] + (x if rel else 0), v[6] + (y if rel else 0)]
        elif rel:
            v = [c + (y if k % 2 else x) for k, c in enumerate(v)]
        if up in ("S", "T"):
            kind = "C" if up == "S" else "Q"
            px, py = (2 * x - last[1], 2 * y - last[2]) if last and last[0] == kind else (x, y)
            v, up = [px, py, *v], kind
        last = ("C", v[2], v[3]) if up == "C" else ("Q", v[0], v[1]) if up == "Q" else None
        up = "L" if up in "HV" else up
        out.append((up, *v))
        x, y = v[-2], v[-1]
        if up == "M":
            sx, sy = x, y
    return out


def _curve(points: list[tuple[float, float]], flat: float, depth: int = 0) -> Iterator[tuple[float, float]]:
    """End points of the chords of a curve, halved until its control points lie near the chord."""
    (x0, y0), (x1, y1) = points[0], points[-1]
    dx, dy = x1 - x0, y1 - y0
    size = math.hypot(dx, dy)
    off = max((abs((px - x0) * dy - (py - y0) * dx) / size if size else math.hypot(px - x0, py - y0)) for px, py in points[1:-1])
    if off <= flat or depth >= DEEPEST:
        yield points[-1]
        return
    left, right, row = [points[0]], [points[-1]], points
    while len(row) > 1:
        row = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(row, row[1:], strict=False)]
        left.append(row[0])
        right.append(row[-1])
    yield from _curve(left, flat, depth + 1)
    yield from _curve(right[::-1], flat, depth + 1)


def _arc(x0: float, y0: float, rx: float, ry: float, turn: float, large: float, sweep: float, x1: float, y1: float, flat: float) -> Iterator[tuple[float, float]]:
    """An elliptic arc by its end points, in equal steps of angle."""
    rx, ry = abs(rx), abs(ry)
    if not rx or not ry or (x0, y0) == (x1, y1):
        yield x1, y1
        return
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    hx, hy = (x0 - x1) / 2, (y0 - y1) / 2
    px, py = c * hx + s * hy, -s * hx + c * hy
    grow = math.sqrt(max(1.0, (px / rx) ** 2 + (py / ry) ** 2))
    rx, ry = rx * grow, ry * grow
    left = max(0.0, (rx * ry) ** 2 - (rx * py) ** 2 - (ry * px) ** 2) / ((rx * py) ** 2 + (ry * px) ** 2)
    k = math.sqrt(left) * (1 if bool(large) != bool(sweep) else -1)
    qx, qy = k * rx * py / ry, -k * ry * px / rx
    mx, my = c * qx - s * qy + (x0 + x1) / 2, s * qx + c * qy + (y0 + y1) / 2
    a = math.atan2((py - qy) / ry, (px - qx) / rx)
    b = math.atan2((-py - qy) / ry, (-px - qx) / rx)
    span = (b - a) % (2 * math.pi) if sweep else -((a - b) % (2 * math.pi))
    steps = max(1, math.ceil(abs(span) / (2 * math.acos(max(-1.0, 1 - min(1.0, flat / max(rx, ry)))) or 0.1)))
    for j in range(1, steps):
        t = a + span * j / steps
        ux, uy = rx * math.cos(t), ry * math.sin(t)
        yield c * ux - s * uy + mx, s * ux + c * uy + my
    yield x1, y1


def flatten(commands: list[tuple], flat: float = FLATNESS) -> list[list[tuple[float, float]]]:
    """Polylines of a normalised path; a closed one ends where it began."""
    out: list[list[tuple[float, float]]] = []
    for op, *v in commands:
        if op == "M":
            out.append([(v[0], v[1])])
        elif out:
            x, y = out[-1][-1]
            if op == "L":
                out[-1].append((v[0], v[1]))
            elif op in "QC":
                out[-1] += _curve([(x, y), *zip(v[::2], v[1::2], strict=True)], flat)
            elif op == "A":
                out[-1] += _arc(x, y, *v, flat)
            else:
                out[-1].append(out[-1][0])
                out.append([out[-1][0]])
    return [line for line in out if len(line) > 1]


def dash(lines: list[list[tuple[float, float]]], pattern: list[float], offset: float = 0.0) -> list[list[tuple[float, float]]]:
    """The drawn stretches of polylines under a pattern of drawn and blank lengths; an odd pattern is doubled."""
    pattern = pattern * 2 if len(pattern) % 2 else pattern
    total = sum(pattern)
    if total <= 0 or min(pattern) < 0:
        return lines
    out = []
    for line in lines:
        at, k = offset % total, 0
        while at >= pattern[k]:
            at, k = at - pattern[k], (k + 1) % len(pattern)
        left, now = pattern[k] - at, [line[0]] if k % 2 == 0 else []
        for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
            size, done = math.hypot(x1 - x0, y1 - y0), 0.0
            while size - done > left:
                done += left
                p = (x0 + (x1 - x0) * done / size, y0 + (y1 - y0) * done / size)
                if k % 2 == 0:
                    out.append([*now, p])
                    now = []
                else:
                    now = [p]
                k = (k + 1) % len(pattern)
                left = pattern[k]
            left -= size - done
            if k % 2 == 0:
                now.append((x1, y1))
        if len(now) > 1:
            out.append(now)
    return out


def length(lines: list[list[tuple[float, float]]]) -> float:
    return sum(math.hypot(b[0] - a[0], b[1] - a[1]) for line in lines for a, b in zip(line, line[1:], strict=False))


def measured(df: DataFrame, path_col: str, pattern: list[float] | None = None) -> DataFrame:
    """Adds ``commands`` (normalised), ``segments`` and ``path_length`` of each path text; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("__path")
        for batch in batches:
            rows = []
            for d in batch.column(at).to_pylist():
                norm = normalise(parse(d or ""))
                lines = flatten(norm)
                lines = dash(lines, pattern) if pattern else lines
                rows.append((len(norm), sum(len(x) - 1 for x in lines), round(length(lines), 3)) if d is not None else (None, None, None))
            cols = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.float64()))]], names=[*[n for n in names if n != "__path"], "commands", "segments", "path_length"])

    source = df.withColumn("__path", F.col(path_col))
    names = source.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__path")
    return source.mapInArrow(run, f"{schema}, commands int, segments int, path_length double")


def svg_text(uses: DataFrame, width: float, height: float) -> DataFrame:
    """(doc, svg) from rows (doc, ix, gid, x, y, d): each outline is defined once and used where it stands."""
    defs = uses.select("doc", "gid", "d").distinct().groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.format_string('<path id="g%s" d="%s"/>', F.col("gid"), F.col("d")))), "").alias("defs"))
    drawn = uses.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ix", F.format_string('<use href="#g%s" x="%s" y="%s"/>', F.col("gid"), F.col("x"), F.col("y")).alias("u")))).alias("us"))
    both = defs.join(drawn, "doc")
    body = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}"><defs>'), "defs", F.lit('</defs><g transform="scale(1,-1)">'), F.array_join(F.transform("us", lambda u: u["u"]), ""), F.lit("</g></svg>"))
    return both.select("doc", body.alias("svg"))
