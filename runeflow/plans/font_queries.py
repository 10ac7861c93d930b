"""Queries on the fonts of this machine; without any they are empty."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from runeflow.functions import paths
from runeflow.functions import unicode as u
from runeflow.operators import reports, sets, shaping, text
from runeflow.plans import font_twins as twins
from runeflow.plans.registry import query
from runeflow.sources import fonts
from runeflow.sources.tables import table

#: Without the fonts there is nothing that the twins could read.
_HERE = os.path.isdir(fonts.DEJAVU)
_SANS = f"file:{fonts.DEJAVU}/DejaVuSans.ttf"


def _wide(df):
    """Whole numbers as 64-bit ones and lists as text, as the twins have them."""
    out = {"int": lambda c: F.col(c).cast("bigint"), "array<int>": lambda c: F.array_join(F.col(c).cast("array<string>"), ",")}
    return df.select(*[out[t](c).alias(c) if t in out else F.col(c) for c, t in df.dtypes])


def _files(spark):
    if not os.path.isdir(fonts.DEJAVU):
        return spark.createDataFrame([], "path string, content binary")
    return fonts.font_files(spark, fonts.DEJAVU)


@query()
def font_faces(spark, sf_dir):
    return fonts.faces(_files(spark))


@query(twins.FONT_TABLES if _HERE else None)
def font_tables(spark, sf_dir):
    return _wide(fonts.font_tables(_files(spark)))


@query(twins.FONT_NAMES if _HERE else None)
def font_names(spark, sf_dir):
    return _wide(fonts.names(_files(spark)))


@query(twins.FONT_CMAP if _HERE else None)
def font_cmap(spark, sf_dir):
    return _wide(fonts.cmap(_files(spark)))


@query(twins.FONT_CMAP_SUBTABLES if _HERE else None)
def font_cmap_subtables(spark, sf_dir):
    return _wide(fonts.cmap_subtables(_files(spark)))


@query(twins.FONT_METRICS if _HERE else None)
def font_metrics(spark, sf_dir):
    return _wide(fonts.hmtx(_files(spark)))


@query(twins.FONT_GLYPH_CLASSES if _HERE else None)
def font_glyph_classes(spark, sf_dir):
    return _wide(fonts.gdef(_files(spark)))


@query(twins.FONT_FEATURES if _HERE else None)
def font_features(spark, sf_dir):
    return _wide(fonts.features(_files(spark)))


@query(twins.FONT_LOOKUP_CENSUS if _HERE else None)
def font_lookup_census(spark, sf_dir):
    """Lookups and sub-tables by table and type, in all faces, and the face with most."""
    k = fonts.lookups(_files(spark))
    per = k.groupBy("path", "table_tag", "type").agg(F.count("*").alias("lookups"), F.sum("subtables").alias("subtables"))
    return _wide(per.groupBy("table_tag", "type").agg(F.sum("lookups").alias("lookups"), F.sum("subtables").alias("subtables"), F.max("subtables").alias("most"), F.min_by("path", F.struct(-F.col("subtables"), "path")).alias("face")))


@query()
def font_filter(spark, sf_dir):
    """Faces with kerning or positioning, at least 3000 glyphs and 2048 units, of bold style."""
    f = fonts.faces(_files(spark))
    return f.where((F.col("units_per_em") == 2048) & (F.col("glyph_count") >= 3000) & F.array_contains("tables", "GPOS") & F.lower("subfamily").contains("bold")).select("path", "face_ix", "family", "subfamily", "glyph_count")


def _scripts(spark):
    return u.property_table(spark, "script", "general_category").where("general_category NOT IN ('Unassigned', 'Surrogate', 'Private_Use') AND script NOT IN ('Common', 'Inherited', 'Unknown')").select("cp", "script")


@query()
def font_script_coverage(spark, sf_dir):
    """Scripts that faces cover by more than half."""
    have, need = fonts.cmap(_files(spark)).select("path", "cp"), _scripts(spark)
    c = sets.coverage(have, need, "path", "script")
    return c.withColumn("percent", F.round(100 * F.col("covered") / F.col("total"), 3)).where("percent > 50")


@query()
def font_script_top3(spark, sf_dir):
    """For each script the three families that cover it best, by ratio, then characters, then glyphs."""
    files = _files(spark)
    c = sets.coverage(fonts.cmap(files).select("path", "cp"), _scripts(spark), "path", "script")
    c = c.join(fonts.faces(files).select("path", "family", "glyph_count"), "path")
    return sets.top_per_key(c, "script", "family", [F.desc(F.col("covered") / F.col("total")), F.desc("covered"), F.desc("glyph_count"), F.col("path")])


@query(twins.FONT_CMAP_HISTOGRAM if _HERE else None)
def font_cmap_histogram(spark, sf_dir):
    """Faces by the number of characters they map."""
    n = fonts.cmap(_files(spark)).groupBy("path").agg(F.count("*").alias("n"))
    return _wide(reports.histogram(n, F.col("n"), [100, 500, 1000, 2000, 3000, 4000, 5000, 6000]))


@query()
def shape_documents(spark, sf_dir):
    """Glyphs and width of every document, all its lines shaped in one face, and the width of each line in order."""
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", text.paragraphs(F.col("text")).alias("lines"))
    lines = F.when(F.size("lines") == 0, F.array(F.lit(""))).otherwise(F.col("lines"))
    docs = docs.select("row", "doc_id", F.posexplode_outer(lines).alias("ix", "line"))
    docs = docs.withColumn("line", F.regexp_replace("line", "[\\n\\r\\x1c-\\x1e\\x85\\u2029]+$", ""))
    out = shaping.measure_runs(docs, _files(spark), _SANS, "line").select("row", "doc_id", "ix", F.col("n_glyphs").alias("n"), F.col("width").alias("w"))
    out = out.groupBy("row", "doc_id").agg(F.sum("n").alias("n_glyphs"), F.sum("w").alias("width"), F.array_sort(F.collect_list(F.struct("ix", "w"))).alias("by_line"))
    return out.select("doc_id", "n_glyphs", "width", F.transform("by_line", lambda x: x["w"]).alias("line_widths"))


@query()
def ligature_probe(spark, sf_dir):
    """Sequences that become one glyph with ligatures and stay as many as their letters without."""
    words = spark.createDataFrame([(w,) for w in ("ff", "fi", "fl", "ffi", "ffl", "ft", "fj", "st", "ab")], "word string")
    files = _files(spark)
    off = shaping.shape_runs(words, files, _SANS, "word", off=("liga", "clig", "calt"), gpos=False).select("word", F.size("glyphs").alias("plain"))
    on = shaping.shape_runs(words, files, _SANS, "word", gpos=False).select("word", F.size("glyphs").alias("shaped"))
    return on.join(off, "word").withColumn("ligature", (F.col("shaped") == 1) & (F.col("plain") == F.char_length("word")))


@query()
def kerning_probe(spark, sf_dir):
    """Pairs whose shaped width differs from their plain advances."""
    words = spark.createDataFrame([(w,) for w in ("AV", "To", "Te", "LT", "VA", "nn", "Yo", "P.")], "word string")
    files = _files(spark)
    width = lambda c: F.aggregate(F.transform("glyphs", lambda g: g["advance"]), F.lit(0), lambda a, b: a + b).alias(c)
    on = shaping.shape_runs(words, files, _SANS, "word").select("word", width("shaped"))
    off = shaping.shape_runs(words, files, _SANS, "word", gpos=False).select("word", width("plain"))
    return on.join(off, "word").withColumn("delta", F.col("shaped") - F.col("plain"))


@query()
def glyph_outlines(spark, sf_dir):
    """Path text of some letters in every face, with flattened lengths."""
    d = fonts.path_data(fonts.outlines(_files(spark), [ord(c) for c in "AgOié"]), ["path", "face_ix", "cp", "gid"])
    return paths.measured(d, "d")


@query()
def svg_names(spark, sf_dir):
    """Region names drawn as SVG: shaped, placed, each outline defined once."""
    files = _files(spark)
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc"), "r_name")
    shaped = shaping.shape_runs(regions, files, _SANS, "r_name").select("doc", "r_name", F.posexplode("glyphs").alias("ix", "g"))
    placed = reports.pen_positions(shaped.select("doc", "ix", F.col("g.gid").alias("gid"), F.col("g.advance").alias("adv"), F.col("g.x").alias("off"), F.col("g.y").alias("y"), F.col("g.offset").alias("at"), "r_name"), ["doc"], "ix", "adv", "off")
    letters = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz"]
    outlines = fonts.path_data(fonts.outlines(files.where(F.col("path") == _SANS), letters), ["gid"])
    return paths.svg_text(placed.join(F.broadcast(outlines), "gid"), 20000, 3000)  # one face's letters


@query()
def gsub_rules(spark, sf_dir):
    """Substitution rules without context, by face and type, with the longest input and the largest fan-out of a glyph."""
    rules = fonts.substitution_rules(_files(spark))
    fan = rules.groupBy("path", "lookup", "subtable", "type", F.col("input")[0].alias("first")).agg(F.count("*").alias("fan"), F.max(F.size("input")).alias("longest"), F.max(F.size("output")).alias("widest"))
    return fan.groupBy("path", "type").agg(F.sum("fan").alias("rules"), F.max("fan").alias("fan_out"), F.max("longest").alias("longest_input"), F.max("widest").alias("widest_output"))


@query()
def gpos_pairs(spark, sf_dir):
    """Explicit kerning pairs of each face: how many, their extremes and the distinct first glyphs."""
    return fonts.pair_rules(_files(spark)).groupBy("path").agg(F.count("*").alias("pairs"), F.min("advance").alias("least"), F.max("advance").alias("most"), F.countDistinct("first").alias("firsts"))


@query()
def gsub_single_join(spark, sf_dir):
    """A face's first single-substitution lookup applied to all its mapped glyphs, as a join."""
    files = _files(spark).where(F.col("path") == _SANS)
    rules = fonts.substitution_rules(files)
    lookup = rules.where("type = 1").agg(F.min("lookup").alias("k")).first()["k"]
    glyphs = fonts.cmap(files).select("cp", "gid")
    return fonts.substitute_singles(glyphs, rules, lookup if lookup is not None else -1)


@query()
def workload_tiers(spark, sf_dir):
    """Typical, high and extreme ligature inputs of the faces, by nearest rank."""
    rules = fonts.substitution_rules(_files(spark)).where("type = 4").select("path", "lookup", "subtable", "ord", F.size("input").alias("components"))
    return reports.tiers(rules, ["path"], [F.col("components"), F.col("lookup"), F.col("subtable"), F.col("ord")])


@query()
def context_rules(spark, sf_dir):
    """Rules with context of each face by table and type: how many, the longest parts, and the most in a sub-table."""
    k = fonts.context_rules(_files(spark))
    per = k.groupBy("path", "table_tag", "type", "lookup", "subtable").agg(F.count("*").alias("n"), F.max(F.size("back")).alias("back"), F.max(F.size("input") + 1).alias("input"), F.max(F.size("ahead")).alias("ahead"), F.max(F.size("lookups")).alias("actions"))
    return per.groupBy("path", "table_tag", "type").agg(F.sum("n").alias("rules"), F.max("n").alias("most_in_subtable"), *[F.max(c).alias(f"longest_{c}") for c in ("back", "input", "ahead")], F.max("actions").alias("most_actions"))


@query()
def class_pair_cells(spark, sf_dir):
    """Cells of class pairs that move something, and the explicit pairs that they stand for on the first side."""
    return fonts.class_pairs(_files(spark)).groupBy("path").agg(F.count("*").alias("cells"), F.sum("firsts").alias("first_glyphs"), F.min("advance").alias("least"), F.max("advance").alias("most"))


@query()
def attachment_points(spark, sf_dir):
    """Attachment points of each face by lookup type and part."""
    return fonts.anchors(_files(spark)).groupBy("path", "type", "part").agg(F.count("*").alias("points"), F.countDistinct("gid").alias("glyphs"), F.max("class").alias("highest_class"))


def _measures(files):
    """(path, metric, value): what makes a face hard to shape, one row a metric."""
    subs = fonts.substitution_rules(files)
    fan = subs.groupBy("path", "type", "lookup", "subtable", F.col("input")[0].alias("first")).agg(F.count("*").alias("fan"), F.max(F.size("input")).alias("parts"), F.max(F.size("output")).alias("wide"))
    pairs2 = subs.where((F.col("type") == 4) & (F.size("input") >= 2)).groupBy("path", "lookup", "subtable", F.col("input")[0].alias("a"), F.col("input")[1].alias("b")).agg(F.count("*").alias("fan"))
    ctx = fonts.context_rules(files)
    in_sub = ctx.groupBy("path", "table_tag", "lookup", "subtable").agg(F.count("*").alias("n"))
    by_first = ctx.select("path", "table_tag", "lookup", "subtable", F.explode("first").alias("g")).groupBy("path", "table_tag", "lookup", "subtable", "g").agg(F.count("*").alias("n"))
    cells, explicit = fonts.class_pairs(files), fonts.pair_rules(files)
    census, points = fonts.lookups(files), fonts.anchors(files)
    name = lambda df, metric, value: df.groupBy("path").agg(value.cast("long").alias("value")).select("path", F.lit(metric).alias("metric"), "value")
    rows = [
        name(subs.where("type = 1").groupBy("path", "lookup", "subtable").agg(F.count("*").alias("n")), "single_mappings_in_subtable", F.max("n")),
        name(fan.where("type = 2"), "multiple_output", F.max("wide")),
        name(fan.where("type = 3"), "alternates", F.max("wide")),
        name(fan.where("type = 4"), "ligature_fan_out", F.max("fan")),
        name(fan.where("type = 4"), "ligature_components", F.max("parts")),
        name(pairs2, "ligature_prefix2_fan_out", F.max("fan")),
        name(in_sub, "context_rules_in_subtable", F.max("n")),
        name(by_first, "context_first_fan_out", F.max("n")),
        name(ctx, "context_back", F.max(F.size("back"))),
        name(ctx, "context_input", F.max(F.size("input") + 1)),
        name(ctx, "context_ahead", F.max(F.size("ahead"))),
        name(ctx, "context_set", F.max(F.array_max(F.when(F.col("format") == 3, F.concat("back", "input", "ahead"))))),
        name(explicit, "explicit_pairs", F.count("*")),
        name(cells, "class_cells", F.count("*")),
        name(points.where("part = 'mark'"), "attached_marks", F.countDistinct("gid")),
        name(points.where("part = 'base'"), "attachment_bases", F.countDistinct("gid")),
        name(census, "lookups", F.count("*")),
        name(census, "subtables_in_lookup", F.max("subtables")),
        name(census.where(F.col("flag").bitwiseAND(0xFF1E) != 0), "filtered_lookups", F.count("*")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("value IS NOT NULL")


@query()
def font_face_records(spark, sf_dir):
    """One row a face: its names, size, and every measure of its rules; what it lacks is 0."""
    files = _files(spark)
    wide = _measures(files).groupBy("path").pivot("metric", sorted(METRICS)).agg(F.first("value"))
    out = fonts.faces(files).select("path", "face_ix", "family", "subfamily", "glyph_count", "weight", "slant").join(wide, "path", "left")
    return out.na.fill(0, list(METRICS))


METRICS = (
    "single_mappings_in_subtable", "multiple_output", "alternates", "ligature_fan_out", "ligature_components", "ligature_prefix2_fan_out", "context_rules_in_subtable", "context_first_fan_out", "context_back", "context_input",
    "context_ahead", "context_set", "explicit_pairs", "class_cells", "attached_marks", "attachment_bases", "lookups", "subtables_in_lookup", "filtered_lookups",
)


@query()
def font_extremes(spark, sf_dir):
    """The largest value of each measure over all faces, and the face that has it."""
    return reports.extremes(_measures(_files(spark)), "path")


@query()
def font_metric_histograms(spark, sf_dir):
    """Faces by the size of each measure."""
    return reports.histogram(_measures(_files(spark)), F.col("value"), [0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096], "metric")


@query(twins.FONT_FILTER_SUMMARY if _HERE else None)
def font_filter_summary(spark, sf_dir):
    """Lookups by what their flags skip."""
    k, bit = fonts.lookups(_files(spark)), lambda b: F.col("flag").bitwiseAND(b) != 0
    named = k.select("path", "table_tag", "type", bit(1).alias("right_to_left"), bit(2).alias("bases"), bit(4).alias("ligatures"), bit(8).alias("marks"), bit(16).alias("mark_set"), (F.col("flag") >= 256).alias("mark_class"))
    return _wide(named).groupBy("table_tag", "type", "right_to_left", "bases", "ligatures", "marks", "mark_set", "mark_class").agg(F.count("*").alias("lookups"), F.countDistinct("path").alias("faces"))


@query()
def workload_families(spark, sf_dir):
    """Glyph sequences that hit the rules of each family, typical, high and extreme ones by the size of the rule."""
    files = _files(spark)
    subs = fonts.substitution_rules(files)
    one = lambda df, family, size, glyphs, length: df.select(F.lit(family).alias("family"), "path", F.lit("GSUB").alias("table_tag"), "lookup", "subtable", "ord", size.cast("int").alias("size"), glyphs.alias("glyphs"), length.cast("int").alias("expected_length"))
    first = lambda k: subs.where(F.col("type") == k)
    lig = first(4)
    fan = lig.groupBy("path", "lookup", "subtable", F.col("input")[0].alias("f")).agg(F.count("*").alias("fan"))
    lig = lig.withColumn("f", F.col("input")[0]).join(fan, ["path", "lookup", "subtable", "f"])
    pairs = fonts.pair_rules(files).withColumn("ord", F.col("second"))
    ctx = fonts.context_rules(files).where("format = 1 AND table_tag = 'GSUB'")
    sequence = F.concat(F.reverse("back"), F.slice("first", 1, 1), F.col("input"), F.col("ahead"))
    parts = [
        one(first(1), "single", F.abs(F.col("output")[0] - F.col("input")[0]), F.col("input"), F.lit(1)),
        one(first(2), "multiple", F.size("output"), F.col("input"), F.size("output")),
        one(first(3), "alternate", F.size("output"), F.col("input"), F.lit(1)),
        one(lig, "ligature_components", F.size("input"), F.col("input"), F.lit(1)),
        one(lig, "ligature_fan_out", F.col("fan"), F.col("input"), F.lit(1)),
        one(ctx, "context_back", F.size("back"), sequence, F.lit(None)),
        one(ctx, "context_input", F.size("input") + 1, sequence, F.lit(None)),
        one(ctx, "context_ahead", F.size("ahead"), sequence, F.lit(None)),
        one(pairs, "explicit_pair", F.abs("advance"), F.array("first", "second"), F.lit(2)).withColumn("table_tag", F.lit("GPOS")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return reports.tiers(rows, ["family"], [F.col("size"), F.col("path"), F.col("lookup"), F.col("subtable"), F.col("ord")])


@query()
def workload_runs(spark, sf_dir):
    """Each workload's lookup applied to its sequence, repeated: lengths before and after."""
    files = _files(spark)
    work = workload_families(spark, sf_dir)
    return shaping.applied(work, files, "glyphs", repeat=16).select("family", "tier", "path", "table_tag", "lookup", "expected_length", F.size("glyphs").alias("n_input"), F.size("out").alias("n_output"))


@query()
def emoji_fonts(spark, sf_dir):
    """Faces that have characters of emoji presentation, and how many of them."""
    need = u.code_points(spark).where(u.holds("emoji_presentation", F.col("cp"))).select("cp", F.lit("emoji").alias("set"))
    return sets.coverage(fonts.cmap(_files(spark)).select("path", "cp"), need, "path", "set").select("path", "covered", "total")


@query()
def ligature_fonts(spark, sf_dir):
    """In all faces, the ligature rules for pairs and triples of Latin letters, as a join of rules with characters."""
    files = _files(spark)
    letters = fonts.cmap(files).where("cp BETWEEN 97 AND 122").select("path", "face_ix", "gid", F.chr("cp").alias("letter"))
    rules = fonts.substitution_rules(files).where("type = 4").select("path", "face_ix", "lookup", "subtable", "ord", F.size("input").alias("n"), F.posexplode("input").alias("at", "gid"))
    spelled = rules.join(letters, ["path", "face_ix", "gid"]).groupBy("path", "face_ix", "lookup", "subtable", "ord", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "").alias("word"))
    return spelled.where(F.char_length("word") == F.col("n")).groupBy("path", "word").agg(F.count("*").alias("rules"))


@query()
def kerning_fonts(spark, sf_dir):
    """In all faces, the explicit pairs of Latin letters that move, as a join of rules with characters."""
    files = _files(spark)
    letters = fonts.cmap(files).where("cp BETWEEN 65 AND 90 OR cp BETWEEN 97 AND 122").select("path", "face_ix", "gid", F.chr("cp").alias("letter"))
    rules = fonts.pair_rules(files).where("advance <> 0")
    a, b = letters.select("path", "face_ix", F.col("gid").alias("first"), F.col("letter").alias("a")), letters.select("path", "face_ix", F.col("gid").alias("second"), F.col("letter").alias("b"))
    return rules.join(a, ["path", "face_ix", "first"]).join(b, ["path", "face_ix", "second"]).select("path", "lookup", "subtable", F.concat("a", "b").alias("pair"), "advance")


@query(twins.CMAP_LOOKUPS if _HERE else None)
def cmap_lookups(spark, sf_dir):
    """For each face, code points of planes 0 and 1 that it maps and that it lacks: what a look-up benchmark draws from."""
    have = fonts.cmap(_files(spark)).groupBy("path", F.floor(F.col("cp") / 65536).alias("plane")).agg(F.count("*").alias("hits"), F.countDistinct("gid").alias("glyphs"), F.max("cp").alias("highest"))
    return _wide(have.withColumn("misses", F.lit(65536) - F.col("hits")))
