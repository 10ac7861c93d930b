"""Sets of code points, scripts or glyphs as tables: membership, containment, overlap, equality, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def members(ranges: DataFrame, set_col: str = "set_id", first: str = "first", last: str = "last") -> DataFrame:
    """(set_id, cp) of range rows, once each."""
    return ranges.select(set_col, F.explode(F.sequence(F.col(first), F.col(last))).alias("cp")).distinct()


def ranges_of(sets: DataFrame, set_col: str = "set_id", value: str = "cp") -> DataFrame:
    """(set_id, first, last): maximal runs of a set's members."""
    w = Window.partitionBy(set_col).orderBy(value)
    rows = sets.select(set_col, value).distinct().withColumn("run", F.col(value) - F.row_number().over(w))
    return rows.groupBy(set_col, "run").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("run")


def contains_all(have: DataFrame, need: DataFrame, left: str, right: str, value: str = "cp") -> DataFrame:
    """(left, right): every set of ``have`` that holds all of a set of ``need`` (relational division; empty sets aside)."""
    sizes = need.select(right, value).distinct().groupBy(right).agg(F.count("*").alias("size"))
    met = have.select(left, value).distinct().join(need.select(right, value).distinct(), value).groupBy(left, right).agg(F.count("*").alias("met"))
    return met.join(sizes, right).where("met = size").select(left, right)


def coverage(have: DataFrame, need: DataFrame, left: str, right: str, value: str = "cp") -> DataFrame:
    """(left, right, covered, total): how much of each needed set a set has; pairs without any are left out."""
    sizes = need.select(right, value).distinct().groupBy(right).agg(F.count("*").alias("total"))
    met = have.select(left, value).distinct().join(need.select(right, value).distinct(), value).groupBy(left, right).agg(F.count("*").alias("covered"))
    return met.join(sizes, right).select(left, right, "covered", "total")


def intersects(have: DataFrame, need: DataFrame, left: str, right: str, value: str = "cp") -> DataFrame:
    """(left, right) pairs with a common member."""
    return have.select(left, value).distinct().join(need.select(right, value).distinct(), value).select(left, right).distinct()


def bitmap_counts(sets: DataFrame, set_col: str, value: str = "cp") -> DataFrame:
    """(set_id, n): sizes by bitmaps, which combine map-side in a fixed space a bucket."""
    part = sets.groupBy(set_col, F.bitmap_bucket_number(F.col(value).cast("bigint")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(value).cast("bigint"))).alias("bits"))
    return part.groupBy(set_col).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets have the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def top_per_key(scores: DataFrame, key: str, group: str, order: list, k: int = 3) -> DataFrame:
    """(…, place): the best row of each (key, group), then the k best groups of each key."""
    best = scores.withColumn("rank", F.row_number().over(Window.partitionBy(key, group).orderBy(*order))).where("rank = 1")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order, F.col(group)))).where(F.col("place") <= k).drop("rank")
