"""Font files as relational tables: faces, table directories, names, character maps, metrics, layout rules, outlines.

Files are found by Spark's ``binaryFile`` source. A face is decoded in an Arrow batch where its bytes are; what comes out
are plain rows, so every query on fonts is a join or an aggregate.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

DEJAVU = "/usr/share/fonts/truetype/dejavu"


def font_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the font files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[tT][tT][fF],[oO][tT][fF],[tT][tT][cC]}").load(folder)
    return files.select("path", "content")


class Reader:
    """Big-endian reads that fail past the end."""

    def __init__(self, data: bytes):
        self.data = data

    def u16(self, at: int) -> int:
        return struct.unpack_from(">H", self.data, at)[0]

    def i16(self, at: int) -> int:
        return struct.unpack_from(">h", self.data, at)[0]

    def u32(self, at: int) -> int:
        return struct.unpack_from(">I", self.data, at)[0]

    def tag(self, at: int) -> str:
        return self.data[at : at + 4].decode("latin-1")

    def array(self, kind: str, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.data, kind, n, at)


def face_offsets(data: bytes) -> list[int]:
    r = Reader(data)
    if data[:4] == b"ttcf":
        return [r.u32(12 + 4 * k) for k in range(r.u32(8))]
    return [0] if data[:4] in (b"\0\1\0\0", b"OTTO", b"true") else []


def checksum(data: bytes) -> int:
    """Sum of the big-endian words, the end padded with zeros."""
    return int(np.frombuffer(data + b"\0" * (-len(data) % 4), ">u4").sum(dtype=np.uint64)) & 0xFFFFFFFF


def directory(data: bytes, start: int) -> list[tuple[str, int, int, int]]:
    r = Reader(data)
    return [(r.tag(a), r.u32(a + 4), r.u32(a + 8), r.u32(a + 12)) for a in range(start + 12, start + 12 + 16 * r.u16(start + 4), 16)]


class Face:
    """The decoded tables of one face."""

    def __init__(self, data: bytes, start: int):
        self.r = Reader(data)
        self.tables = {t: (o, n) for t, _, o, n in directory(data, start)}

    def at(self, tag: str) -> int | None:
        return self.tables[tag][0] if tag in self.tables else None

    @property
    def glyphs(self) -> int:
        return self.r.u16(self.at("maxp") + 4) if "maxp" in self.tables else 0

    @property
    def units(self) -> int:
        return self.r.u16(self.at("head") + 18) if "head" in self.tables else 0

    @property
    def style(self) -> tuple[int, bool, str]:
        """(weight class, bold, slant): slant is roman, italic or oblique."""
        mac = self.r.u16(self.at("head") + 44) if "head" in self.tables else 0
        a = self.at("OS/2")
        weight, chosen = (self.r.u16(a + 4), self.r.u16(a + 62)) if a is not None else (700 if mac & 1 else 400, 0)
        angle = self.r.u32(self.at("post") + 4) if "post" in self.tables else 0
        name = (self.best_name(2) or "").lower()
        slanted = bool(mac & 2 or chosen & 1 or chosen & 512 or angle)
        return weight, bool(mac & 1 or chosen & 32), ("oblique" if chosen & 512 or "oblique" in name else "italic") if slanted else "roman"

    def names(self) -> list[tuple[int, int, int, int, str]]:
        """(platform, encoding, language, name, text)."""
        a = self.at("name")
        if a is None:
            return []
        out, store = [], a + self.r.u16(a + 4)
        for k in range(self.r.u16(a + 2)):
            p, e, lang, n, size, off = struct.unpack_from(">6H", self.r.data, a + 6 + 12 * k)
            raw = self.r.data[store + off : store + off + size]
            out.append((p, e, lang, n, raw.decode("utf-16-be" if p in (0, 3) else "mac-roman", "replace")))
        return out

    def best_name(self, name: int) -> str | None:
        """By preference: Windows English, Windows any, Unicode, Macintosh, then whatever there is."""
        rank = lambda x: 0 if x[0] == 3 and x[2] == 0x409 else 1 if x[0] == 3 else 2 if x[0] == 0 else 3 if x[0] == 1 else 4
        found = [x for x in self.names() if x[3] == name]
        return min(found, key=rank)[4] if found else None

    def encodings(self) -> list[tuple[int, int, int, int]]:
        """(platform, encoding, format, offset) of the character maps."""
        a = self.at("cmap")
        if a is None:
            return []
        out = []
        for k in range(self.r.u16(a + 2)):
            p, e, off = struct.unpack_from(">HHI", self.r.data, a + 4 + 8 * k)
            out.append((p, e, self.r.u16(a + off), a + off))
        return out

    def map_at(self, fmt: int, a: int) -> dict[int, int]:
        r, out = self.r, {}
        if fmt == 0:
            out = {c: g for c, g in enumerate(r.data[a + 6 : a + 262])}
        elif fmt == 4:
            n = r.u16(a + 6) // 2
            ends, starts = r.array(">u2", a + 14, n).tolist(), r.array(">u2", a + 16 + 2 * n, n).tolist()
            deltas, offsets = r.array(">u2", a + 16 + 4 * n, n).tolist(), r.array(">u2", a + 16 + 6 * n, n).tolist()
            for k in range(n):
                for c in range(starts[k], min(ends[k], 0xFFFE) + 1):
                    if offsets[k] == 0:
                        out[c] = (c + deltas[k]) & 0xFFFF
                    else:
                        p = a + 16 + 6 * n + 2 * k + offsets[k] + 2 * (c - starts[k])
                        g = r.u16(p) if p + 2 <= len(r.data) else 0
                        out[c] = (g + deltas[k]) & 0xFFFF if g else 0
        elif fmt in (6, 10):
            first, n, p, kind = (r.u16(a + 6), r.u16(a + 8), a + 10, ">u2") if fmt == 6 else (r.u32(a + 12), r.u32(a + 16), a + 20, ">u2")
            out = {first + k: int(g) for k, g in enumerate(r.array(kind, p, n))}
        elif fmt in (12, 13):
            for k in range(r.u32(a + 12)):
                s, e, g = struct.unpack_from(">3I", r.data, a + 16 + 12 * k)
                for c in range(s, min(e, 0x10FFFF) + 1):
                    out[c] = g + (c - s if fmt == 12 else 0)
        return {c: g for c, g in out.items() if 0 < g < self.glyphs}

    def characters(self) -> dict[int, int]:
        """Code points to glyphs: full Windows map, then its short one, then Unicode's; the first glyph found stays."""
        score = {12: 6, 13: 5, 10: 4, 4: 3, 6: 2, 0: 1}
        maps = self.encodings()
        chosen = [m for m in maps if m[:2] == (3, 10)] + [m for m in maps if m[:2] == (3, 1)] + sorted((m for m in maps if m[0] == 0 and m[2] in score), key=lambda m: (-score[m[2]], -m[1]))[:1]
        out: dict[int, int] = {}
        for _, _, fmt, a in chosen:
            for c, g in self.map_at(fmt, a).items():
                out.setdefault(c, g)
        return out

    def advances(self) -> list[int]:
        n = self.r.u16(self.at("hhea") + 34) if "hhea" in self.tables else 0
        if not n or "hmtx" not in self.tables:
            return [0] * self.glyphs
        long = self.r.array(">u2", self.at("hmtx"), 2 * n)[::2].tolist()
        return (long + [long[-1]] * max(0, self.glyphs - n))[: self.glyphs]

    # common layout tables
    def coverage(self, a: int) -> list[int]:
        if self.r.u16(a) == 1:
            return self.r.array(">u2", a + 4, self.r.u16(a + 2)).tolist()
        out = []
        for k in range(self.r.u16(a + 2)):
            s, e, _ = struct.unpack_from(">3H", self.r.data, a + 4 + 6 * k)
            out += range(s, e + 1)
        return out

    def classes(self, a: int) -> dict[int, int]:
        r, out = self.r, {}
        if r.u16(a) == 1:
            first = r.u16(a + 2)
            out = {first + k: int(c) for k, c in enumerate(r.array(">u2", a + 6, r.u16(a + 4))) if c}
        else:
            for k in range(r.u16(a + 2)):
                s, e, c = struct.unpack_from(">3H", r.data, a + 4 + 6 * k)
                if c:
                    out.update(dict.fromkeys(range(s, e + 1), c))
        return out

    def glyph_classes(self) -> dict[int, int]:
        a = self.at("GDEF")
        off = self.r.u16(a + 4) if a is not None else 0
        return self.classes(a + off) if off else {}

    def mark_classes(self) -> dict[int, int]:
        a = self.at("GDEF")
        off = self.r.u16(a + 10) if a is not None else 0
        return self.classes(a + off) if off else {}

    def features(self, tag: str) -> list[tuple[str, str, int, str, list[int]]]:
        """(script, language, required, feature, lookups) rows of GSUB or GPOS."""
        a = self.at(tag)
        if a is None:
            return []
        r, out = self.r, []
        scripts, feats = a + r.u16(a + 4), a + r.u16(a + 6)

        def feature(k: int) -> tuple[str, list[int]]:
            p = feats + 2 + 6 * k
            q = feats + r.u16(p + 4)
            return r.tag(p), r.array(">u2", q + 4, r.u16(q + 2)).tolist()

        for k in range(r.u16(scripts)):
            script, s = r.tag(scripts + 2 + 6 * k), scripts + r.u16(scripts + 6 + 6 * k)
            systems = [("dflt", r.u16(s))] if r.u16(s) else []
            systems += [(r.tag(s + 4 + 6 * j), r.u16(s + 8 + 6 * j)) for j in range(r.u16(s + 2))]
            for language, off in systems:
                q = s + off
                required = r.u16(q + 2)
                if required != 0xFFFF:
                    out.append((script, language, 1, *feature(required)))
                out += [(script, language, 0, *feature(int(f))) for f in r.array(">u2", q + 6, r.u16(q + 4))]
        return out

    def lookups(self, tag: str) -> list[tuple[int, int, int, int, list[int]]]:
        """(index, type, flag, mark set, subtable offsets), extensions resolved."""
        a = self.at(tag)
        if a is None:
            return []
        r, out, extension = self.r, [], 7 if tag == "GSUB" else 9
        top = a + r.u16(a + 8)
        for k in range(r.u16(top)):
            p = top + r.u16(top + 2 + 2 * k)
            kind, flag, n = r.u16(p), r.u16(p + 2), r.u16(p + 4)
            subs = [p + r.u16(p + 6 + 2 * j) for j in range(n)]
            if kind == extension and subs:
                kind = r.u16(subs[0] + 2)
                subs = [s + r.u32(s + 4) for s in subs]
            out.append((k, kind, flag, r.u16(p + 6 + 2 * n) if flag & 16 else -1, subs))
        return out

    def outline(self, glyph: int, depth: int = 0) -> list[tuple]:
        """Path commands of a glyph from glyf: ("M", x, y), ("L", …), ("Q", cx, cy, x, y), ("Z",)."""
        if depth > 8 or "glyf" not in self.tables or glyph >= self.glyphs:
            return []
        r, wide = self.r, self.r.i16(self.at("head") + 50)
        loca = self.at("loca")
        a, b = (r.u32(loca + 4 * glyph), r.u32(loca + 4 * glyph + 4)) if wide else (2 * r.u16(loca + 2 * glyph), 2 * r.u16(loca + 2 * glyph + 2))
        if a == b:
            return []
        p = self.at("glyf") + a
        n = r.i16(p)
        return self._simple(p + 10, n) if n >= 0 else self._composite(p + 10, depth)

    def _composite(self, p: int, depth: int) -> list[tuple]:
        r, out = self.r, []
        while True:
            flags, glyph = r.u16(p), r.u16(p + 2)
            p += 4
            if flags & 1:
                dx, dy = r.i16(p), r.i16(p + 2)
                p += 4
            else:
                dx, dy = struct.unpack_from(">bb", r.data, p)
                p += 2
            if not flags & 2:
                dx = dy = 0
            xx, xy, yx, yy = 1.0, 0.0, 0.0, 1.0
            if flags & 8:
                xx = yy = r.i16(p) / 16384
                p += 2
            elif flags & 0x40:
                xx, yy = r.i16(p) / 16384, r.i16(p + 2) / 16384
                p += 4
            elif flags & 0x80:
                xx, xy, yx, yy = (r.i16(p + 2 * k) / 16384 for k in range(4))
                p += 8
            for op, *xs in self.outline(glyph, depth + 1):
                moved = [v for x, y in zip(xs[::2], xs[1::2], strict=True) for v in (xx * x + yx * y + dx, xy * x + yy * y + dy)]
                out.append((op, *moved))
            if not flags & 0x20:
                return out

    def _simple(self, p: int, n: int) -> list[tuple]:
        r = self.r
        if not n:
            return []
        ends = r.array(">u2", p, n).tolist()
        p += 2 * n
        p += 2 + r.u16(p)
        count, flags = ends[-1] + 1, []
        while len(flags) < count:
            f = r.data[p]
            p += 1
            flags.append(f)
            if f & 8:
                flags += [f] * r.data[p]
                p += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, out = 0, []
            for f in flags[:count]:
                if f & short:
                    v += r.data[p] if f & same else -r.data[p]
                    p += 1
                elif not f & same:
                    v += r.i16(p)
                    p += 2
                out.append(v)
            axes.append(out)
        commands, start = [], 0
        for e in ends:
            pts = [(axes[0][i], axes[1][i], flags[i] & 1) for i in range(start, e + 1)]
            start = e + 1
            commands += _contour(pts)
        return commands


def _contour(pts: list[tuple[int, int, int]]) -> list[tuple]:
    """A closed contour of on- and off-curve points; between two off-curve ones stands an implied point."""
    if not pts:
        return []
    mid = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, 1)
    full = []
    for k, q in enumerate(pts):
        if full and not q[2] and not full[-1][2]:
            full.append(mid(full[-1], q))
        full.append(q)
    if not full[0][2] and not full[-1][2]:
        full.append(mid(full[-1], full[0]))
    first = next(k for k, q in enumerate(full) if q[2]) if any(q[2] for q in full) else 0
    full = full[first:] + full[:first]
    out: list[tuple] = [("M", float(full[0][0]), float(full[0][1]))]
    k, ring = 1, [*full, full[0]]
    while k < len(ring):
        if ring[k][2]:
            if k < len(ring) - 1:
                out.append(("L", float(ring[k][0]), float(ring[k][1])))
            k += 1
        else:
            out.append(("Q", *map(float, (*ring[k][:2], *ring[k + 1][:2]))))
            k += 2
    return [*out, ("Z",)]


def per_face(files: DataFrame, schema: str, rows: Callable[[Face], Iterator[tuple]]) -> DataFrame:
    """(path, face_ix, …) rows that ``rows`` makes of each face; a face that can't be decoded gives none."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, start in enumerate(face_offsets(data or b"")):
                    try:
                        found = list(rows(Face(data, start)))
                    except (struct.error, IndexError, ValueError, KeyError, TypeError):
                        continue
                    for i in range(0, len(found), 50_000):
                        part = found[i : i + 50_000]
                        cols = list(zip(*part, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([k] * len(part), pa.int32()), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["path", "face_ix", *names])

    spark = files.sparkSession
    parsed = spark.createDataFrame([], schema).schema
    kinds = [to_arrow_type(f.dataType) for f in parsed]
    return files.select("path", "content").mapInArrow(run, "path string, face_ix int, " + schema)


def faces(files: DataFrame) -> DataFrame:
    def rows(f: Face) -> Iterator[tuple]:
        yield f.best_name(1), f.best_name(2), f.best_name(4), f.best_name(6), f.glyphs, f.units, sorted(f.tables), *f.style

    return per_face(files, "family string, subfamily string, full_name string, postscript string, glyph_count int, units_per_em int, tables array<string>, weight int, bold boolean, slant string", rows)


def font_tables(files: DataFrame) -> DataFrame:
    def rows(f: Face) -> Iterator[tuple]:
        for tag, (offset, length) in f.tables.items():
            yield tag, offset, length, checksum(f.r.data[offset : offset + length])

    return per_face(files, "tag string, offset long, length long, checksum long", rows)


def names(files: DataFrame) -> DataFrame:
    return per_face(files, "platform int, encoding int, language int, name_id int, text string", lambda f: iter(f.names()))


def cmap(files: DataFrame) -> DataFrame:
    return per_face(files, "cp int, gid int", lambda f: iter(sorted(f.characters().items())))


def cmap_subtables(files: DataFrame) -> DataFrame:
    return per_face(files, "platform int, encoding int, format int, offset long", lambda f: iter(f.encodings()))


def hmtx(files: DataFrame) -> DataFrame:
    return per_face(files, "gid int, advance int", lambda f: iter(enumerate(f.advances())))


def gdef(files: DataFrame) -> DataFrame:
    def rows(f: Face) -> Iterator[tuple]:
        marks = f.mark_classes()
        for g, c in sorted(f.glyph_classes().items()):
            yield g, c, marks.get(g, 0)

    return per_face(files, "gid int, class int, mark_class int", rows)


def features(files: DataFrame) -> DataFrame:
    def rows(f: Face) -> Iterator[tuple]:
        for tag in ("GSUB", "GPOS"):
            for script, language, required, feature, lookups in f.features(tag):
                yield tag, script, language, required, feature, lookups

    return per_face(files, "table_tag string, script string, language string, required int, feature string, lookups array<int>", rows)


def lookups(files: DataFrame) -> DataFrame:
    def rows(f: Face) -> Iterator[tuple]:
        for tag in ("GSUB", "GPOS"):
            for k, kind, flag, marks, subs in f.lookups(tag):
                yield tag, k, kind, flag, marks, len(subs)

    return per_face(files, "table_tag string, lookup int, type int, flag int, mark_set int, subtables int", rows)


def outlines(files: DataFrame, cps: list[int]) -> DataFrame:
    """(cp, gid, seq, op, args) of the glyphs of some code points."""

    def rows(f: Face) -> Iterator[tuple]:
        table = f.characters()
        for c in cps:
            for k, (op, *xs) in enumerate(f.outline(table.get(c, 0))):
                yield c, table.get(c, 0), k, op, [float(x) for x in xs]

    return per_face(files, "cp int, gid int, seq int, op string, args array<double>", rows)


def path_data(commands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d): path text of each glyph's commands."""
    number = lambda x: F.regexp_replace(F.format_string("%.2f", x), "\\.?0+$", "")
    piece = F.concat(F.col("op"), F.array_join(F.transform("args", number), " "))
    return commands.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", piece.alias("p")))), lambda s: s["p"]), "").alias("d"))


def _substitutions(f: Face) -> Iterator[tuple]:
    """(lookup, type, subtable, ord, input, output) of the substitution rules without context, in stored order."""
    r = f.r
    for k, kind, _, _, subs in f.lookups("GSUB"):
        for j, a in enumerate(subs):
            if kind not in (1, 2, 3, 4):
                continue
            cov = f.coverage(a + r.u16(a + 2))
            if kind == 1:
                out = [(g + r.i16(a + 4)) & 0xFFFF for g in cov] if r.u16(a) == 1 else r.array(">u2", a + 6, r.u16(a + 4)).tolist()
                for n, (g, x) in enumerate(zip(cov, out, strict=False)):
                    yield k, kind, j, n, [g], [x]
                continue
            n = 0
            for i, g in enumerate(cov):
                p = a + r.u16(a + 6 + 2 * i)
                if kind in (2, 3):
                    yield k, kind, j, n, [g], r.array(">u2", p + 2, r.u16(p)).tolist()
                    n += 1
                    continue
                for q in (p + r.u16(p + 2 + 2 * m) for m in range(r.u16(p))):
                    yield k, kind, j, n, [g, *r.array(">u2", q + 4, r.u16(q + 2) - 1).tolist()], [r.u16(q)]
                    n += 1


def substitution_rules(files: DataFrame) -> DataFrame:
    return per_face(files, "lookup int, type int, subtable int, ord int, input array<int>, output array<int>", _substitutions)


def _pairs(f: Face) -> Iterator[tuple]:
    """(lookup, subtable, first, second, first's advance) of the explicit pairs."""
    r = f.r
    for k, kind, _, _, subs in f.lookups("GPOS"):
        for j, a in enumerate(subs):
            if kind != 2 or r.u16(a) != 1:
                continue
            f1, f2 = r.u16(a + 4), r.u16(a + 6)
            s1, s2 = 2 * bin(f1 & 0xFF).count("1"), 2 * bin(f2 & 0xFF).count("1")
            place = 2 * bin(f1 & 3).count("1")
            for i, g in enumerate(f.coverage(a + r.u16(a + 2))):
                p = a + r.u16(a + 10 + 2 * i)
                for q in range(p + 2, p + 2 + r.u16(p) * (2 + s1 + s2), 2 + s1 + s2):
                    yield k, j, g, r.u16(q), r.i16(q + 2 + place) if f1 & 4 else 0


def pair_rules(files: DataFrame) -> DataFrame:
    return per_face(files, "lookup int, subtable int, first int, second int, advance int", _pairs)


def substitute_singles(glyphs: DataFrame, rules: DataFrame, lookup: int, gid: str = "gid") -> DataFrame:
    """A single-substitution lookup over a glyph column: the first sub-table that has the glyph wins, others stay."""
    first = rules.where((F.col("lookup") == lookup) & (F.col("type") == 1)).groupBy(F.col("input")[0].alias("__in")).agg(F.min_by(F.col("output")[0], F.col("subtable")).alias("__out"))
    kept = [c for c in glyphs.columns if c != gid]
    return glyphs.join(first, F.col(gid) == F.col("__in"), "left").select(*kept, F.coalesce("__out", gid).alias(gid))


def _sequence(r: Reader, p: int, less: int = 0) -> tuple[list[int], int]:
    n = r.u16(p) - less
    return r.array(">u2", p + 2, n).tolist(), p + 2 + 2 * n


def _contexts(f: Face) -> Iterator[tuple]:
    """(table, lookup, type, subtable, format, ord, first, back, input, ahead, places, lookups) of rules with context.

    ``first`` has the glyphs that may begin a match. ``back``, ``input`` (after the first) and ``ahead`` are glyphs in
    format 1, classes in format 2, and the sizes of glyph sets in format 3.
    """
    r = f.r
    for tag, kinds in (("GSUB", (5, 6)), ("GPOS", (7, 8))):
        for k, kind, _, _, subs in f.lookups(tag):
            for j, a in enumerate(subs if kind in kinds else ()):
                fmt, chained = r.u16(a), kind == kinds[1]
                head = (tag, k, kind, j, fmt)
                if fmt == 3:
                    if chained:
                        back, p = _sequence(r, a + 2)
                        inside, p = _sequence(r, p)
                        ahead, p = _sequence(r, p)
                        n, p = r.u16(p), p + 2
                    else:
                        back, ahead, n = [], [], r.u16(a + 4)
                        inside = r.array(">u2", a + 6, r.u16(a + 2)).tolist()
                        p = a + 6 + 2 * len(inside)
                    sizes = [[len(f.coverage(a + o)) for o in x] for x in (back, inside[1:], ahead)]
                    acts = r.array(">u2", p, 2 * n).tolist()
                    yield *head, 0, f.coverage(a + inside[0]) if inside else [], *sizes, acts[::2], acts[1::2]
                    continue
                cov = f.coverage(a + r.u16(a + 2))
                at = a + 4 + (2 * (3 if chained else 1) if fmt == 2 else 0)
                classes = f.classes(a + r.u16(a + (6 if chained else 4))) if fmt == 2 else {}
                order = 0
                for i in range(r.u16(at)):
                    off = r.u16(at + 2 + 2 * i)
                    first = [g for g in cov if classes.get(g, 0) == i] if fmt == 2 else cov[i : i + 1]
                    for m in range(r.u16(a + off) if off and first else 0):
                        p = a + off + r.u16(a + off + 2 + 2 * m)
                        if chained:
                            back, p = _sequence(r, p)
                            inside, p = _sequence(r, p, 1)
                            ahead, p = _sequence(r, p)
                            n, p = r.u16(p), p + 2
                        else:
                            n, back, ahead = r.u16(p + 2), [], []
                            inside = r.array(">u2", p + 4, r.u16(p) - 1).tolist()
                            p += 4 + 2 * len(inside)
                        acts = r.array(">u2", p, 2 * n).tolist()
                        yield *head, order, first, back, inside, ahead, acts[::2], acts[1::2]
                        order += 1


def context_rules(files: DataFrame) -> DataFrame:
    kind = "table_tag string, lookup int, type int, subtable int, format int, ord int, first array<int>, back array<int>, input array<int>, ahead array<int>, places array<int>, lookups array<int>"
    return per_face(files, kind, _contexts)


def _reverse_rules(f: Face) -> Iterator[tuple]:
    """(lookup, subtable, ord, input, output, back, ahead): single substitutions from the end; sizes of the sets around."""
    r = f.r
    for k, kind, _, _, subs in f.lookups("GSUB"):
        for j, a in enumerate(subs if kind == 8 else ()):
            back, p = _sequence(r, a + 4)
            ahead, p = _sequence(r, p)
            new, _ = _sequence(r, p)
            around = [[len(f.coverage(a + o)) for o in x] for x in (back, ahead)]
            for n, (g, x) in enumerate(zip(f.coverage(a + r.u16(a + 2)), new, strict=False)):
                yield k, j, n, g, x, *around


def reverse_rules(files: DataFrame) -> DataFrame:
    return per_face(files, "lookup int, subtable int, ord int, input int, output int, back array<int>, ahead array<int>", _reverse_rules)


def _class_pairs(f: Face) -> Iterator[tuple]:
    """(lookup, subtable, class1, class2, firsts, advance): cells of class pairs that move something, and how many first
    glyphs each holds for."""
    r = f.r
    for k, kind, _, _, subs in f.lookups("GPOS"):
        for j, a in enumerate(subs):
            if kind != 2 or r.u16(a) != 2:
                continue
            f1, f2 = r.u16(a + 4), r.u16(a + 6)
            s1, s2 = bin(f1 & 0xFF).count("1"), bin(f2 & 0xFF).count("1")
            n1, n2, c1 = r.u16(a + 12), r.u16(a + 14), f.classes(a + r.u16(a + 8))
            values = r.array(">i2", a + 16, n1 * n2 * (s1 + s2)).reshape(n1, n2, s1 + s2)
            held: dict[int, int] = {}
            for g in f.coverage(a + r.u16(a + 2)):
                held[c1.get(g, 0)] = held.get(c1.get(g, 0), 0) + 1
            place = bin(f1 & 3).count("1")
            for x, y in np.argwhere(values.any(axis=2)).tolist():
                if x in held:
                    yield k, j, x, y, held[x], int(values[x, y, place]) if f1 & 4 else 0


def class_pairs(files: DataFrame) -> DataFrame:
    return per_face(files, "lookup int, subtable int, class1 int, class2 int, firsts int, advance int", _class_pairs)


def _anchors(f: Face) -> Iterator[tuple]:
    """(lookup, type, subtable, part, gid, class, component, x, y) of attachment points: entries, exits, marks and bases."""
    r = f.r
    point = lambda p: (r.i16(p + 2), r.i16(p + 4))
    for k, kind, _, _, subs in f.lookups("GPOS"):
        for j, a in enumerate(subs):
            if kind == 3:
                for i, g in enumerate(f.coverage(a + r.u16(a + 2))):
                    for part, off in (("entry", r.u16(a + 6 + 4 * i)), ("exit", r.u16(a + 8 + 4 * i))):
                        if off:
                            yield k, kind, j, part, g, 0, 0, *point(a + off)
            if kind not in (4, 5, 6):
                continue
            n, marks, bases = r.u16(a + 6), a + r.u16(a + 8), a + r.u16(a + 10)
            for i, g in enumerate(f.coverage(a + r.u16(a + 2))):
                yield k, kind, j, "mark", g, r.u16(marks + 2 + 4 * i), 0, *point(marks + r.u16(marks + 4 + 4 * i))
            for i, g in enumerate(f.coverage(a + r.u16(a + 4))):
                top = bases + r.u16(bases + 2 + 2 * i) if kind == 5 else bases
                for part in range(r.u16(top) if kind == 5 else 1):
                    for c in range(n):
                        off = r.u16(top + 2 + 2 * ((part if kind == 5 else i) * n + c))
                        if off:
                            yield k, kind, j, "base", g, c, part, *point(top + off)


def anchors(files: DataFrame) -> DataFrame:
    return per_face(files, "lookup int, type int, subtable int, part string, gid int, class int, component int, x int, y int", _anchors)
