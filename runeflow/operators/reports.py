"""Reports over measured corpora: histograms, extremes, tiers, presence and pivot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(x: Column, edges: list[float]) -> Column:
    """The number of the first edge that is not below ``x``; one more than the last for what is above all."""
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(x <= edges[k], F.lit(k)).otherwise(out)
    return out


def histogram(df: DataFrame, value: Column, edges: list[float], *keys: str) -> DataFrame:
    return df.groupBy(*keys, bucket(value, edges).alias("bucket")).agg(F.count("*").alias("n"))


def unpivot(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(ids, metrics, "metric", "value")


def extremes(long: DataFrame, who: str) -> DataFrame:
    """(metric, value, who): the largest value of each metric, ties to the least name."""
    return long.groupBy("metric").agg(F.max("value").alias("value"), F.min_by(who, F.struct(-F.col("value"), F.col(who))).alias(who))


def tiers(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows at the nearest-rank places of each group: (n-1)/2 typical, (n-1)*9/10 high, n-1 extreme; one row a place."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    typical, high, extreme = F.floor((F.col("n") - 1) / 2), F.floor((F.col("n") - 1) * 9 / 10), F.col("n") - 1
    tier = F.when(F.col("at") == extreme, "extreme").when(F.col("at") == high, "high").when(F.col("at") == typical, "typical")
    return ranked.withColumn("tier", tier).where(F.col("tier").isNotNull()).drop("at", "n")


def presence(df: DataFrame, key: str) -> DataFrame:
    """(key, n, present) of counted keys."""
    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("present", F.col("n") > 0)


def pen_positions(df: DataFrame, keys: list[str], order: str, advance: str, offset: str, rtl: bool = False) -> DataFrame:
    """Adds ``x``: left to right the pen before the glyph plus its offset; right to left the pen after it, going back."""
    w = Window.partitionBy(*keys).orderBy(order)
    if rtl:
        return df.withColumn("x", -F.sum(advance).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col(offset))
    return df.withColumn("x", F.coalesce(F.sum(advance).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(offset))
