"""Queries on a font with known rules: each kind of lookup over glyph sequences whose results follow from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from runeflow.operators import shaping
from runeflow.plans.registry import query
from runeflow.sources import fonts
from runeflow.sources import fontwriter as w

# Glyphs: 1 to 26 are the letters a to z, 27 the space, 30 and 31 marks; others come from the rules.
_MARKS = {30: 3, 31: 3}
_CLASSES = {**dict.fromkeys(range(1, 28), 1), **_MARKS, 40: 2, 41: 2}

_GSUB = (
    (1, 0, [w.single_shift([1, 2], 5)]),
    (1, 0, [w.single({3: 50, 5: 51})]),
    (2, 0, [w.lists({4: [4, 60], 5: [61, 62, 63]})]),
    (3, 0, [w.lists({6: [70, 71]})]),
    (4, 8, [w.ligatures({6: [(41, [6, 9]), (40, [9])]})]),
    (5, 0, [w.context_glyphs({1: [([2], [(1, 0)])]})]),
    (5, 0, [w.context_classes([1, 2], [{1: 1, 2: 1, 3: 2}], {1: [([2], [(0, 0)])]})]),
    (5, 0, [w.context_sets([[1], [2, 3]], [(1, 1)])]),
    (6, 0, [w.context_sets([[1]], [(0, 0)], [[4]], [[5]])]),
    (6, 0, [w.context_glyphs({1: [([], [(0, 0)], [4], [5, 6])]})]),
    (6, 0, [w.context_classes([1], [{4: 1}, {1: 1}, {5: 1}], {1: [([], [(0, 0)], [1], [1])]})]),
    (8, 0, [w.reverse({1: 80, 2: 81}, [], [[3, 80, 81]])]),
    (7, 0, [w.extension(1, w.single({3: 50}))]),
    (1, 0, [w.single({1: 90}), w.single({1: 91, 2: 92})]),
    (6, 8, [w.context_sets([[6], [9]], [(0, 4)], [[4]], [])]),
)
_GPOS = (
    (1, 0, [w.adjusted_alike([1], [10], 4)]),
    (1, 0, [w.adjusted({1: [5, -5], 2: [7, 0]}, 3)]),
    (2, 0, [w.pairs({1: {2: -20}})]),
    (2, 0, [w.pair_classes([1], {1: 1}, {2: 1, 3: 2}, [[0, 0, 0], [0, -30, -40]])]),
    (3, 0, [w.cursive({1: (None, (100, 20)), 2: ((0, 5), None)})]),
    (4, 0, [w.attached({30: (0, (10, 20)), 31: (1, (0, 0))}, {1: [(50, 60), (7, 8)]})]),
    (5, 0, [w.attached({30: (0, (10, 20))}, {40: [[(10, 10)], [(30, 30)]]}, ligature=True)]),
    (6, 0, [w.attached({31: (0, (1, 1))}, {30: [(5, 9)]})]),
    (8, 0, [w.context_sets([[1]], [(0, 0)], [[4]], [])]),
    (7, 0, [w.context_glyphs({1: [([2], [(0, 0)])]})]),
    (2, 8, [w.pairs({1: {2: -20}})]),
    (9, 0, [w.extension(1, w.adjusted_alike([1], [10], 4))]),
)
# (table, lookup, glyphs, glyphs after it, x, y, advance), from the rules by hand.
_CASES = (
    ("GSUB", 0, "1,2,3", "6,7,3"), ("GSUB", 1, "3,4,5", "50,4,51"), ("GSUB", 2, "4,5,6", "4,60,61,62,63,6"), ("GSUB", 3, "6,7,6", "70,7,70"), ("GSUB", 4, "6,30,9", "40,30"), ("GSUB", 4, "6,6,9", "41"), ("GSUB", 4, "6,9,9", "40,9"),
    ("GSUB", 4, "6,6,6,9", "6,41"), ("GSUB", 5, "1,2,2,1", "1,7,2,1"), ("GSUB", 6, "1,3,2,1", "6,3,2,1"), ("GSUB", 7, "1,3,1,4", "1,50,1,4"), ("GSUB", 8, "4,1,5", "4,6,5"), ("GSUB", 8, "4,1,6,1,5", "4,1,6,1,5"), ("GSUB", 9, "4,1,5,6", "4,6,5,6"),
    ("GSUB", 9, "4,1,5,5", "4,1,5,5"), ("GSUB", 10, "4,1,5,1,5", "4,6,5,1,5"), ("GSUB", 11, "1,2,3,1", "80,81,3,1"), ("GSUB", 12, "3,4", "50,4"), ("GSUB", 13, "1,2", "90,92"), ("GSUB", 14, "4,6,30,9", "4,40,30"), ("GSUB", 14, "6,9", "6,9"),
    ("GPOS", 0, "1,2", "1,2", "0,0", "0,0", "10,0"), ("GPOS", 1, "1,2,3", "1,2,3", "5,7,0", "-5,0,0", "0,0,0"), ("GPOS", 2, "1,2,1", "1,2,1", "0,0,0", "0,0,0", "-20,0,0"), ("GPOS", 3, "1,3,1,2", "1,3,1,2", "0,0,0,0", "0,0,0,0", "-40,0,-30,0"),
    ("GPOS", 4, "1,2", "1,2", "0,0", "0,15", "100,0"), ("GPOS", 5, "1,30", "1,30", "0,40", "0,40", "0,0"), ("GPOS", 5, "1,31", "1,31", "0,7", "0,8", "0,0"), ("GPOS", 5, "2,30", "2,30", "0,0", "0,0", "0,0"), ("GPOS", 6, "40,30", "40,30", "0,20", "0,10", "0,0"),
    ("GPOS", 7, "1,30,31", "1,30,31", "0,0,4", "0,0,8", "0,0,0"), ("GPOS", 8, "4,1,1", "4,1,1", "0,0,0", "0,0,0", "0,10,0"), ("GPOS", 9, "1,2,1", "1,2,1", "0,0,0", "0,0,0", "10,0,0"), ("GPOS", 10, "1,30,2", "1,30,2", "0,0,0", "0,0,0", "-20,0,0"),
    ("GPOS", 2, "1,30,2", "1,30,2", "0,0,0", "0,0,0", "0,0,0"), ("GPOS", 11, "1", "1", "0", "0", "10"),
)


def _whole(case: tuple) -> tuple:
    table, lookup, glyphs, out, *rest = case
    zero = ",".join("0" for _ in out.split(","))
    return (table, lookup, glyphs, out, *(rest or [zero, zero, zero]))


def _font() -> bytes:
    letters = {97 + k: 1 + k for k in range(26)} | {32: 27, 0x300: 30, 0x301: 31}
    features = {"liga": [4], "ccmp": [2], "rlig": [8]}
    return w.font(
        {
            **w.plain(100, [600] * 27 + [250] + [0] * 4 + [700]),
            "cmap": w.characters(letters), "GDEF": w.glyph_definitions(_CLASSES), "GSUB": w.layout(_GSUB, features), "GPOS": w.layout(_GPOS, {"kern": [2], "mark": [5], "mkmk": [7]}),
        }
    )


def _files(spark):
    return spark.createDataFrame([("golden", bytearray(_font()))], "path string, content binary")


def _values(rows, columns: str) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS BIGINT)"
    return "SELECT * FROM (VALUES " + ",".join("(" + ",".join(map(text, r)) + ")" for r in rows) + f") t({columns})"


@query(_values([_whole(c) for c in _CASES], "table_tag, lookup, glyphs, gids, xs, ys, advances"))
def golden_lookups(spark, sf_dir):
    """Every kind of lookup, applied alone."""
    rows = [("golden", c[0], c[1], c[2]) for c in _CASES]
    work = spark.createDataFrame(rows, "path string, table_tag string, lookup int, text string").withColumn("glyphs", F.split("text", ",").cast("array<int>"))
    out = shaping.applied(work, _files(spark), "glyphs", positions=True)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("table_tag", F.col("lookup").cast("bigint").alias("lookup"), F.col("text").alias("glyphs"), text("out").alias("gids"), text("xs").alias("xs"), text("ys").alias("ys"), text("advances").alias("advances"))


# Text, glyphs, their first source character, advances and offsets: ccmp, then rlig, then liga; kern, mark, mkmk. Glyphs
# beyond the listed advances have the last one.
_TEXTS = (
    ("ab", "1,2", "0,1", "580,600", "0,0"), ("fi", "40", "0", "700", "0"), ("ffi", "41", "0", "700", "0"), ("fif", "40,6", "0,2", "700,600", "0,0"), ("d", "4,60", "0,0", "600,700", "0,0"), ("a\u0300", "1,30", "0,1", "600,0", "0,-560"), ("a b", "1,27,2", "0,1,2", "600,250,600", "0,0,0"),
    ("?", "0", "0", "600", "0"), ("", "", "", "", ""), ("ab a\u0300", "1,2,27,1,30", "0,1,2,3,4", "580,600,250,600,0", "0,0,0,0,-560"),
)


@query(_values(_TEXTS, "text, gids, sources, advances, xs"))
def golden_texts(spark, sf_dir):
    """Texts shaped with all features of a script."""
    rows = spark.createDataFrame([(t[0],) for t in _TEXTS], "text string")
    out = shaping.shape_runs(rows, _files(spark), "golden", "text")
    part = lambda f: F.array_join(F.transform("glyphs", lambda g: g[f].cast("string")), ",")
    return out.select("text", part("gid").alias("gids"), part("offset").alias("sources"), part("advance").alias("advances"), part("x").alias("xs"))


@query(_values([("GSUB", "latn", "dflt", 0, "ccmp", "2"), ("GSUB", "latn", "dflt", 0, "liga", "4"), ("GSUB", "latn", "dflt", 0, "rlig", "8"), ("GPOS", "latn", "dflt", 0, "kern", "2"), ("GPOS", "latn", "dflt", 0, "mark", "5"), ("GPOS", "latn", "dflt", 0, "mkmk", "7")], "table_tag, script, language, required, feature, lookups"))
def golden_features(spark, sf_dir):
    k = fonts.features(_files(spark))
    return k.select("table_tag", "script", "language", F.col("required").cast("bigint").alias("required"), "feature", F.array_join(F.col("lookups").cast("array<string>"), ",").alias("lookups"))


@query(_values([(t, k, {7: 1, 9: 1}.get(kind, kind) if (t, kind) in (("GSUB", 7), ("GPOS", 9)) else kind, flag, len(s)) for t, ls in (("GSUB", _GSUB), ("GPOS", _GPOS)) for k, (kind, flag, s) in enumerate(ls)], "table_tag, lookup, type, flag, subtables"))
def golden_census(spark, sf_dir):
    """Lookups as written; extensions show the type that they stand for."""
    wide = lambda c: F.col(c).cast("bigint").alias(c)
    return fonts.lookups(_files(spark)).select("table_tag", wide("lookup"), wide("type"), wide("flag"), wide("subtables"))


@query(_values([(0, 1, "1", "6"), (0, 1, "2", "7"), (1, 1, "3", "50"), (1, 1, "5", "51"), (2, 2, "4", "4,60"), (2, 2, "5", "61,62,63"), (3, 3, "6", "70,71"), (4, 4, "6,6,9", "41"), (4, 4, "6,9", "40"), (12, 1, "3", "50"), (13, 1, "1", "90"), (13, 1, "1", "91"), (13, 1, "2", "92")], "lookup, type, input, output"))
def golden_substitutions(spark, sf_dir):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return fonts.substitution_rules(_files(spark)).select(F.col("lookup").cast("bigint").alias("lookup"), F.col("type").cast("bigint").alias("type"), text("input"), text("output"))


@query(_values([("GSUB", 5, 5, 1, "1", "", "2", "", "1", "0"), ("GSUB", 6, 5, 2, "1,2", "", "2", "", "0", "0"), ("GSUB", 7, 5, 3, "1", "", "2", "", "1", "1"), ("GSUB", 8, 6, 3, "1", "1", "", "1", "0", "0"), ("GSUB", 9, 6, 1, "1", "4", "", "5,6", "0", "0"), ("GSUB", 10, 6, 2, "1", "1", "", "1", "0", "0"), ("GSUB", 14, 6, 3, "6", "1", "1", "", "0", "4"), ("GPOS", 8, 8, 3, "1", "1", "", "", "0", "0"), ("GPOS", 9, 7, 1, "1", "", "2", "", "0", "0")], "table_tag, lookup, type, format, first, back, input, ahead, places, lookups"))
def golden_contexts(spark, sf_dir):
    """Rules with context as rows; format 3 shows the sizes of its sets."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    wide = lambda c: F.col(c).cast("bigint").alias(c)
    return fonts.context_rules(_files(spark)).select("table_tag", wide("lookup"), wide("type"), wide("format"), *map(text, ("first", "back", "input", "ahead", "places", "lookups")))


@query(_values([("explicit", 2, 1, 2, -20), ("explicit", 10, 1, 2, -20), ("class", 3, 1, 1, -30), ("class", 3, 1, 2, -40)], "kind, lookup, a, b, advance"))
def golden_pairs(spark, sf_dir):
    wide = lambda c, n: F.col(c).cast("bigint").alias(n)
    files = _files(spark)
    one = fonts.pair_rules(files).select(F.lit("explicit").alias("kind"), wide("lookup", "lookup"), wide("first", "a"), wide("second", "b"), wide("advance", "advance"))
    return one.union(fonts.class_pairs(files).select(F.lit("class"), wide("lookup", "lookup"), wide("class1", "a"), wide("class2", "b"), wide("advance", "advance")))


@query(_values([(4, 3, "exit", 1, 0, 0, 100, 20), (4, 3, "entry", 2, 0, 0, 0, 5), (5, 4, "mark", 30, 0, 0, 10, 20), (5, 4, "mark", 31, 1, 0, 0, 0), (5, 4, "base", 1, 0, 0, 50, 60), (5, 4, "base", 1, 1, 0, 7, 8), (6, 5, "mark", 30, 0, 0, 10, 20), (6, 5, "base", 40, 0, 0, 10, 10), (6, 5, "base", 40, 0, 1, 30, 30), (7, 6, "mark", 31, 0, 0, 1, 1), (7, 6, "base", 30, 0, 0, 5, 9)], "lookup, type, part, gid, class, component, x, y"))
def golden_anchors(spark, sf_dir):
    wide = lambda c: F.col(c).cast("bigint").alias(c)
    return fonts.anchors(_files(spark)).select(wide("lookup"), wide("type"), "part", *map(wide, ("gid", "class", "component", "x", "y")))


@query(_values([(g, c) for g, c in sorted(_CLASSES.items())], "gid, class"))
def golden_glyph_classes(spark, sf_dir):
    return fonts.gdef(_files(spark)).select(F.col("gid").cast("bigint").alias("gid"), F.col("class").cast("bigint").alias("class"))


@query("SELECT cp, CASE WHEN cp = 32 THEN 27 WHEN cp >= 768 THEN cp - 738 ELSE cp - 96 END AS gid, CASE WHEN cp = 32 THEN 250 WHEN cp >= 768 THEN 0 ELSE 600 END AS advance FROM (SELECT CAST(unnest([32, 768, 769]) AS BIGINT) AS cp UNION ALL SELECT * FROM range(97, 123))")
def golden_characters(spark, sf_dir):
    """Characters with their glyphs and advances."""
    files = _files(spark)
    k = fonts.cmap(files).join(fonts.hmtx(files), ["path", "face_ix", "gid"])
    return k.select(F.col("cp").cast("bigint").alias("cp"), F.col("gid").cast("bigint").alias("gid"), F.col("advance").cast("bigint").alias("advance"))
