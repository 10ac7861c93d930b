"""Reading of tables and of the line-based files of the Unicode database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ucd_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(fields): lines without comments and blanks, split at semicolons and trimmed."""
    body = F.trim(F.regexp_replace(F.col(column), "#.*$", ""))
    return lines.where(body != "").select(F.transform(F.split(body, ";"), lambda x: F.trim(x)).alias("fields"))


def ucd_missing(lines: DataFrame, column: str = "value") -> DataFrame:
    """(first, last, value) of the default lines, later ones overriding earlier ones by ``rank``."""
    found = F.regexp_extract(F.col(column), r"^#\s*@missing:\s*([0-9A-Fa-f]+)\.\.([0-9A-Fa-f]+);\s*(\S.*?)\s*$", 0)
    part = lambda k: F.regexp_extract(F.col(column), r"^#\s*@missing:\s*([0-9A-Fa-f]+)\.\.([0-9A-Fa-f]+);\s*(\S.*?)\s*$", k)
    return lines.where(found != "").select(_code(part(1)).alias("first"), _code(part(2)).alias("last"), part(3).alias("value"), F.monotonically_increasing_id().alias("rank"))


def _code(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("int")


def ucd_ranges(lines: DataFrame, column: str = "value") -> DataFrame:
    """(first, last, values) of lines that begin with a code point or a range of them."""
    ends = F.split(F.col("fields")[0], r"\.\.")
    return ucd_lines(lines, column).select(_code(ends[0]).alias("first"), _code(F.element_at(ends, -1)).alias("last"), F.slice("fields", 2, 20).alias("values"))


def ucd_overlaps(found: DataFrame) -> DataFrame:
    """Ranges that meet one which begins before them: none in a sound file."""
    from pyspark.sql import Window

    reach = F.max("last").over(Window.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))  # a file's ranges are few
    return found.withColumn("reach", reach).where(F.col("reach") >= F.col("first")).drop("reach")


# The fields of the main data file, in order.
UNICODE_DATA = ("name", "category", "combining_class", "bidi_class", "decomposition", "decimal", "digit", "numeric", "mirrored", "old_name", "comment", "upper", "lower", "title")


def unicode_data(lines: DataFrame, column: str = "value") -> DataFrame:
    """(first, last, name, …): the main data file. A pair of lines that name a range's first and last code point become one
    row; ``decomposition`` falls into ``decomposition_kind`` (null: canonical) and ``mapping``; case mappings are numbers."""
    body = F.regexp_replace(F.col(column), "[\\r\\n]+$", "")
    f = F.split(body, ";")
    rows = lines.where(body.rlike("^[0-9A-Fa-f]{4,6};")).select(_code(f[0]).alias("cp"), *[F.trim(f[k + 1]).alias(n) for k, n in enumerate(UNICODE_DATA)])
    ends = rows.where(F.col("name").rlike(", (First|Last)>$")).select(F.regexp_extract("name", "^<(.*), (First|Last)>$", 1).alias("of"), "cp")
    ends = ends.groupBy("of").agg(F.min("cp").alias("__first"), F.max("cp").alias("last"), F.count("*").alias("n"))
    first = rows.where(~F.col("name").rlike(", Last>$")).withColumn("of", F.regexp_extract("name", "^<(.*), First>$", 1))
    first = first.join(F.broadcast(ends), "of", "left")  # a file names a few ranges
    kind = F.regexp_extract("decomposition", "^<([^>]*)>", 1)
    mapping = F.transform(F.filter(F.split(F.regexp_replace("decomposition", "^<[^>]*>", ""), " "), lambda x: x != ""), _code)
    null = lambda c: F.when(F.col(c) != "", F.col(c))
    return first.select(
        F.col("cp").alias("first"), F.coalesce("last", "cp").alias("last"), F.when(F.col("of") != "", F.col("of")).otherwise(F.col("name")).alias("name"), "category", F.col("combining_class").try_cast("int").alias("combining_class"), "bidi_class",
        F.when(kind != "", kind).alias("decomposition_kind"), F.when(F.size(mapping) > 0, mapping).alias("mapping"), null("numeric").alias("numeric"), (F.col("mirrored") == "Y").alias("mirrored"), *[_code(null(c)).alias(c) for c in ("upper", "lower", "title")],
    )


def unicode_data_faults(found: DataFrame) -> DataFrame:
    """(first, fault): rows of ``unicode_data`` that break what the file promises; none in a sound one."""
    fault = F.when(F.col("last") < F.col("first"), "range runs backwards").when(~F.col("category").rlike("^[A-Z][a-z]$"), "category").when(F.col("combining_class").isNull() | (F.col("combining_class") > 254), "combining class")
    fault = fault.when(F.col("decomposition_kind").isNull() & (F.size("mapping") > 2), "canonical decomposition longer than two").when(F.array_max("mapping") > 0x10FFFF, "mapping out of range")
    return found.withColumn("fault", fault).where("fault IS NOT NULL").select("first", "fault")


def value_aliases(lines: DataFrame, column: str = "value") -> DataFrame:
    """(property, number, short, long, others): names of property values; combining classes have a number before them."""
    f = F.col("fields")
    numbered = f[1].rlike("^[0-9]+$")
    short, long = F.when(numbered, f[2]).otherwise(f[1]), F.when(numbered, F.try_element_at(f, F.lit(4))).otherwise(F.try_element_at(f, F.lit(3)))
    rest = F.when(numbered, F.slice(f, 5, 20)).otherwise(F.slice(f, 4, 20))
    return ucd_lines(lines, column).select(f[0].alias("property"), F.when(numbered, f[1].try_cast("int")).alias("number"), short.alias("short"), long.alias("long"), rest.alias("others"))


def decoded(found: DataFrame, aliases: DataFrame, property_name: str) -> DataFrame:
    """``ucd_ranges`` rows with ``value``: the long name of the first value, whichever of its names the file uses; null where
    the property has no such value."""
    known = aliases.where(F.col("property") == property_name)
    names = known.select(F.explode(F.array_distinct(F.concat(F.array("short", "long"), "others"))).alias("name"), F.col("long").alias("value"))
    return found.withColumn("name", F.col("values")[0]).join(F.broadcast(names), "name", "left").select("first", "last", "values", "value")


def with_defaults(found: DataFrame, missing: DataFrame, value: str = "value") -> DataFrame:
    """(cp, value) of every code point that ``found`` (first, last, value) or a default line names: what the file says, else
    the last default that takes the code point in."""
    points = lambda df, *more: df.select(F.explode(F.sequence("first", "last")).alias("cp"), F.col("value").alias("v"), *more)
    own = points(found.withColumn("value", F.col(value)), F.lit(True).alias("own"), F.lit(0).cast("bigint").alias("rank"))
    default = points(missing, F.lit(False).alias("own"), F.col("rank").cast("bigint").alias("rank"))
    return own.unionByName(default).groupBy("cp").agg(F.max_by("v", F.struct("own", "rank")).alias("value"))


def uncovered(found: DataFrame, last: int = 0x10FFFF) -> DataFrame:
    """(first, last): what no range of ``found`` takes in, up to ``last``; a file's ranges are few."""
    from pyspark.sql import Window

    ends = found.select("first", "last").unionByName(found.sparkSession.createDataFrame([(last + 1, last + 1)], "first int, last int"))
    reach = F.max("last").over(Window.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    gaps = ends.withColumn("after", F.coalesce(reach, F.lit(-1)) + 1).where(F.col("after") < F.col("first"))
    return gaps.select(F.col("after").alias("first"), (F.col("first") - 1).alias("last"))
