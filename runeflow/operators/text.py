"""Texts as streams of scalars, paragraphs, clusters, scripts and runs, one row a text or a scalar."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runeflow.functions import unicode as u


def scalars(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ix, ch, cp, begin, end): a row a scalar with its byte range.

    Offsets are running sums over a text's scalars.
    """
    parts = F.split(F.col(text_col), "")
    sized = F.transform(parts, lambda c: F.struct(c.alias("ch"), F.octet_length(c).alias("n")))
    rows = df.where(F.length(text_col) > 0).select(F.col(id_col), F.posexplode(sized).alias("ix", "s"))
    w = Window.partitionBy(id_col).orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("s.n").over(w)
    return rows.select(id_col, "ix", F.col("s.ch").alias("ch"), F.ascii("s.ch").alias("cp"), (end - F.col("s.n")).cast("int").alias("begin"), end.cast("int").alias("end"))


def scalar_counts(text: Column) -> tuple[Column, Column]:
    """Scalars and bytes of a text."""
    return F.char_length(text), F.octet_length(text)


def character_counts(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, ch, cp, n): how often each character occurs in the texts of a group; combined map-side before it is dealt."""
    ch = F.explode(F.split(F.col(text_col), ""))
    return df.where(F.length(text_col) > 0).select(*keys, ch.alias("ch")).groupBy(*keys, "ch").agg(F.count("*").alias("n")).withColumn("cp", F.ascii("ch"))


def validity(data: Column) -> Column:
    """Ready or InvalidInput for bytes that should be UTF-8."""
    return F.when(F.is_valid_utf8(data), F.lit("Ready")).otherwise(F.lit("InvalidInput"))


def paragraphs(text: Column) -> Column:
    """The text's paragraphs; a separator stays with the paragraph that it ends, CR LF as one."""
    return F.filter(F.regexp_extract_all(text, F.lit("[^\\n\\r\\x1c-\\x1e\\x85\\u2029]*(?:\\r\\n|[\\n\\r\\x1c-\\x1e\\x85\\u2029])|[^\\n\\r\\x1c-\\x1e\\x85\\u2029]+"), F.lit(0)), lambda p: p != "")


def is_nfc(text: Column) -> Column:
    return u.nfc(text) == text


CONTEXTUAL = ("Common", "Inherited")


def fold_scripts(sets: Column) -> Column:
    """Candidates of a cluster: its scalars' script sets intersected in order, an empty intersection keeping what was."""
    return F.aggregate(F.slice(sets, 2, F.size(sets)), F.element_at(sets, 1), lambda held, x: F.when(F.size(F.array_intersect(held, x)) > 0, F.array_intersect(held, x)).otherwise(held))


def resolve_scripts(clusters: DataFrame, id_col: str = "id", order: str = "ix") -> DataFrame:
    """Adds ``resolved``: a contextual cluster between two strong ones of the same script takes it if it may; only
    immediate neighbours count, and what stays open falls back to its own."""
    w = Window.partitionBy(id_col).orderBy(order)
    strong = F.when(~F.col("script").isin(*CONTEXTUAL), F.col("script"))
    before, after = F.lag(strong).over(w), F.lead(strong).over(w)
    may = (F.size("candidates") <= 1) | F.array_contains("candidates", before)
    return clusters.withColumn("resolved", F.when(strong.isNull() & (before == after) & may, before).otherwise(F.col("script")))


def islands(df: DataFrame, partition: list[str], order: str, *values: str) -> DataFrame:
    """Adds ``run``: a number for each maximal stretch of neighbours that agree on ``values``."""
    w = Window.partitionBy(*partition).orderBy(order)
    same = F.lit(True)
    for v in values:
        same = same & F.lag(v).over(w).eqNullSafe(F.col(v))
    first = F.row_number().over(w) == 1
    return df.withColumn("run", F.sum(F.when(first | ~same, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def script_runs(clusters: DataFrame, id_col: str = "id", order: str = "ix", level: str | None = None) -> DataFrame:
    """(id, run, script, first, count): contextual stretches join the run on their left, or at the start the one on
    their right; equal neighbours become a run. With ``level`` context ends where the level changes, so a stretch between
    two runs of another level keeps its own script."""
    if level:
        clusters = islands(clusters, [id_col], order, level).withColumnRenamed("run", "__island")
    parts = [id_col, *(["__island"] if level else [])]
    w = Window.partitionBy(*parts).orderBy(order)
    strong = F.when(~F.col("resolved").isin(*CONTEXTUAL), F.col("resolved"))
    left = F.last(strong, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(strong, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    filled = clusters.withColumn("effective", F.coalesce(left, right, F.col("resolved")))
    runs = islands(filled, [id_col], order, "effective", *(["__island"] if level else []))
    return runs.groupBy(id_col, "run").agg(F.first("effective").alias("script"), *([F.first(level).alias(level)] if level else []), F.min(order).alias("first"), F.count("*").alias("count"))


def paragraph_faults(clusters: DataFrame, id_col: str = "id", order: str = "ix", first: str = "first", count: str = "count", level: str | None = None) -> DataFrame:
    """(id, order, fault): clusters of a paragraph that are empty, don't follow the one before without a gap, or whose level
    is out of range; none in a sound paragraph."""
    w = Window.partitionBy(id_col).orderBy(order)
    due = F.coalesce(F.lag(F.col(first) + F.col(count)).over(w), F.lit(0))
    fault = F.when(F.col(count) <= 0, "empty cluster").when(F.col(first) > due, "gap").when(F.col(first) < due, "overlap")
    if level:
        fault = F.coalesce(fault, F.when((F.col(level) < 0) | (F.col(level) > 126), "level out of range"))
    return clusters.withColumn("fault", fault).where(F.col("fault").isNotNull()).select(id_col, order, "fault")


#: A character map is broadcast up to so many rows.
CMAP_ROWS = 2_000_000


def font_runs(clusters: DataFrame, cmap: DataFrame, id_col: str = "id", order: str = "ix", cps: str = "cps") -> DataFrame:
    """(id, run, face, complete, first, count): each cluster takes the face of least priority that has all its scalars.

    ``cmap``: face, priority, cp. Default-ignorable scalars need no glyph. The search begins anew at each cluster; without
    any face the first one is taken as incomplete; neighbours of the same face and state become a run.
    """
    cmap = F.broadcast(cmap) if cmap.count() <= CMAP_ROWS else cmap  # keyed by character, the side of the texts is skewed
    wanted = F.filter(F.array_distinct(cps), lambda c: ~u.holds("default_ignorable", c))
    needed = clusters.select(id_col, order, wanted.alias("cps")).where(F.size("cps") > 0)
    hits = needed.select(id_col, order, F.size("cps").alias("need"), F.explode("cps").alias("cp")).join(cmap, "cp").groupBy(id_col, order, "face", "priority").agg(F.count("*").alias("have"), F.first("need").alias("need")).where("have = need")
    best = hits.groupBy(id_col, order).agg(F.min_by("face", "priority").alias("best"))
    least = cmap.agg(F.min_by("face", "priority").alias("least")).withColumn("__one", F.lit(1))
    chosen = clusters.select(id_col, order, (F.size(wanted) == 0).alias("free")).join(best, [id_col, order], "left").withColumn("__one", F.lit(1))
    chosen = chosen.join(F.broadcast(least), "__one", "left")  # one row
    chosen = chosen.select(id_col, order, F.coalesce("best", "least").alias("face"), (F.col("free") | F.col("best").isNotNull()).alias("complete"))
    runs = islands(chosen, [id_col], order, "face", "complete")
    return runs.groupBy(id_col, "run").agg(F.first("face").alias("face"), F.first("complete").alias("complete"), F.min(order).alias("first"), F.count("*").alias("count"))


def _decomposed(ch: str) -> str:
    return unicodedata.normalize("NFD", ch)


def nfc_pieces(text: str) -> list[tuple[int, int, int]]:
    """(code point, first source byte, end) of the composed text's scalars; a composed one takes in all its sources."""
    out: list[list[int]] = []
    at = 0
    for ch in text:
        size = len(ch.encode("utf-8", "surrogatepass"))
        for x in _decomposed(ch):
            out.append([ord(x), at, at + size])
            k = len(out) - 1
            while k and 0 < unicodedata.combining(x) < unicodedata.combining(chr(out[k - 1][0])):  # canonical order
                out[k - 1], out[k] = out[k], out[k - 1]
                k -= 1
        at += size
    done: list[list[int]] = []
    starter = -1
    for piece in out:
        c = unicodedata.combining(chr(piece[0]))
        last = unicodedata.combining(chr(done[-1][0])) if done else 0
        free = starter >= 0 and (len(done) - 1 == starter or (0 < last < c))
        both = unicodedata.normalize("NFC", chr(done[starter][0]) + chr(piece[0])) if free else ""
        if len(both) == 1:
            done[starter] = [ord(both), min(done[starter][1], piece[1]), max(done[starter][2], piece[2])]
            continue
        done.append(piece)
        if c == 0:
            starter = len(done) - 1
    return [tuple(p) for p in done]


def nfc_offsets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ix, cp, begin, end): the scalars of the composed text with the bytes of the source that each stands for.

    Texts that are composed already never leave the JVM: each scalar stands for itself.
    """
    same = F.coalesce(is_nfc(F.col(text_col)), F.lit(True))
    kept = scalars(df.where(same), id_col, text_col).select(id_col, "ix", "cp", "begin", "end")
    source = df.where(~same).select(id_col, F.col(text_col).alias("__text"))
    schema = T.StructType([source.schema[id_col], *[T.StructField(n, T.IntegerType()) for n in ("ix", "cp", "begin", "end")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in enumerate(batch.column(1).to_pylist()):
                found = nfc_pieces(t)
                cols = [pa.array(c, pa.int32()) for c in zip(*found, strict=True)] or [pa.array([], pa.int32())] * 3
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(found), pa.int32())), pa.array(range(len(found)), pa.int32()), *cols], names=schema.names)

    return kept.unionByName(source.mapInArrow(run, schema))


def source_union(ranges: DataFrame, keys: list[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """(keys, begin, end): the least range that takes in all of a group's source ranges; empty ones count as nothing."""
    return ranges.where(F.col(end) > F.col(begin)).groupBy(*keys).agg(F.min(begin).alias(begin), F.max(end).alias(end))
