"""The property store: Unicode's properties as a folder of parquet tables, built from the library, with its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeflow.functions import unicode as u

VALUES = ("general_category", "combining_class", "bidi_class", "grapheme_cluster_break", "indic_conjunct_break", "indic_syllabic_category", "indic_positional_category", "joining_type", "joining_group", "hangul_syllable_type", "script", "block")


def brackets(spark: SparkSession) -> DataFrame:
    """(cp, paired, kind) of the paired brackets."""
    cp = F.col("cp")
    return u.code_points(spark, 0, 0xFFFF).select("cp", u.paired_bracket(cp).alias("paired"), u.value("bracket_type", cp).alias("kind")).where("kind IN ('Open', 'Close')")


def script_extensions(spark: SparkSession, last: int = 0x33FF) -> DataFrame:
    """(cp, scripts): code points up to ``last`` whose set of scripts isn't just their own script."""
    cp = F.col("cp")
    many = u.code_points(spark, 0, last).withColumn("script", u.value("script", cp)).where("script <> 'Unknown'")
    numbers = u.code_points(spark).select(u.number("script", cp).alias("k"), u.value("script", cp).alias("name")).distinct()
    held = F.call_function("java_method", F.lit("com.ibm.icu.lang.UScript"), F.lit("hasScript"), cp, F.col("k")).cast("boolean")
    rows = many.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(209)))).where(held).join(F.broadcast(numbers), "k")  # scripts are a fixed list
    sets = rows.groupBy("cp", "script").agg(F.sort_array(F.collect_set("name")).alias("scripts"))
    return sets.where((F.size("scripts") > 1) | (F.element_at("scripts", 1) != F.col("script"))).select("cp", "script", "scripts")


def write(spark: SparkSession, folder: str) -> None:
    """All tables of the store below ``folder``."""
    u.property_table(spark, *VALUES, *u.BINARY).write.parquet(f"{folder}/points")
    points = spark.read.parquet(f"{folder}/points")
    found = None
    for name in (*VALUES, *u.BINARY):
        part = u.ranges(points.select("cp", F.col(name).cast("string").alias(name)), name).withColumn("property", F.lit(name))
        part = part.where("value = 'true'") if name in u.BINARY else part
        found = part if found is None else found.unionByName(part)
    found.write.parquet(f"{folder}/ranges")
    u.decompositions(spark).write.parquet(f"{folder}/decompositions")
    u.compositions(spark).write.parquet(f"{folder}/compositions")
    brackets(spark).write.parquet(f"{folder}/brackets")
    script_extensions(spark).write.parquet(f"{folder}/script_extensions")


def coverage(spark: SparkSession, folder: str, name: str, value: str) -> DataFrame:
    """(first, last) of the code points with a property's value."""
    return spark.read.parquet(f"{folder}/ranges").where((F.col("property") == name) & (F.col("value") == value)).select("first", "last")


def violations(spark: SparkSession, folder: str) -> DataFrame:
    """(rule, n): breaches of what the store promises; all counts of a sound one are 0."""
    r = spark.read.parquet(f"{folder}/ranges")
    total = r.where(F.col("property").isin(*VALUES)).groupBy("property").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n")).where(f"n <> {u.LAST + 1}")
    b = spark.read.parquet(f"{folder}/brackets")
    lone = b.join(b.select(F.col("cp").alias("paired"), F.col("paired").alias("back"), F.col("kind").alias("other")), "paired", "left").where("back IS NULL OR back <> cp OR other = kind")
    d, c = spark.read.parquet(f"{folder}/decompositions"), spark.read.parquet(f"{folder}/compositions")
    deep = d.select(F.explode("full").alias("cp")).distinct().join(d.select("cp"), "cp", "left_semi")
    twice = c.groupBy("first", "second").count().where("count > 1")
    count = lambda rule, rows: rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    out = count("ranges cover every code point once", total)
    for rule, rows in (("ranges run forward", r.where("first > last")), ("brackets pair both ways", lone), ("decompositions are full", deep), ("compositions are unique", twice)):
        out = out.union(count(rule, rows))
    return out
