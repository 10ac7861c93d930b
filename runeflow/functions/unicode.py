"""Unicode properties as JVM expressions over code points, and the tables made from them.

Spark ships the ICU library, whose static methods SQL can call, so a property look-up is an expression without any UDF.
Values are those of that library's Unicode version.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CHAR = "com.ibm.icu.lang.UCharacter"
LAST = 0x10FFFF

# The library's numbers of enumerated and binary properties.
ENUMERATED = {
    "bidi_class": 0x1000, "block": 0x1001, "combining_class": 0x1002, "decomposition_type": 0x1003, "east_asian_width": 0x1004, "general_category": 0x1005,
    "joining_group": 0x1006, "joining_type": 0x1007, "line_break": 0x1008, "numeric_type": 0x1009, "script": 0x100A, "hangul_syllable_type": 0x100B,
    "grapheme_cluster_break": 0x1012, "sentence_break": 0x1013, "word_break": 0x1014, "bracket_type": 0x1015, "indic_positional_category": 0x1016,
    "indic_syllabic_category": 0x1017, "vertical_orientation": 0x1018, "indic_conjunct_break": 0x101A,
}
BINARY = {"default_ignorable": 5, "full_composition_exclusion": 9, "extended_pictographic": 64, "emoji": 57, "emoji_presentation": 58}


def _call(owner: str, method: str, *args) -> Column:
    return F.call_function("java_method", F.lit(owner), F.lit(method), *args)


def number(name: str, cp: Column) -> Column:
    """The library's number of an enumerated property's value."""
    return _call(_CHAR, "getIntPropertyValue", cp.cast("int"), F.lit(ENUMERATED[name])).cast("int")


def value(name: str, cp: Column, short: bool = False) -> Column:
    """The name of an enumerated property's value, long or short; the combining class is its number."""
    if name == "combining_class":
        return number(name, cp)
    return _call(_CHAR, "getPropertyValueName", F.lit(ENUMERATED[name]), number(name, cp), F.lit(0 if short else 1))


def holds(name: str, cp: Column) -> Column:
    """A binary property."""
    return _call(_CHAR, "hasBinaryProperty", cp.cast("int"), F.lit(BINARY[name])).cast("boolean")


def paired_bracket(cp: Column) -> Column:
    return _call(_CHAR, "getBidiPairedBracket", cp.cast("int")).cast("int")


def has_script(cp: Column, script: int) -> Column:
    """Whether the script of that number is among the code point's script extensions."""
    return _call("com.ibm.icu.lang.UScript", "hasScript", cp.cast("int"), F.lit(script)).cast("boolean")


def nfc(text: Column) -> Column:
    return _call("com.ibm.icu.text.Normalizer", "compose", text, F.lit(False))


def nfd(text: Column) -> Column:
    return _call("com.ibm.icu.text.Normalizer", "decompose", text, F.lit(False))


def code_points(spark: SparkSession, first: int = 0, last: int = LAST) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("cp"))


def property_table(spark: SparkSession, *names: str, first: int = 0, last: int = LAST) -> DataFrame:
    """cp and the named properties of a range of code points (all by default)."""
    cp = F.col("cp")
    return code_points(spark, first, last).select("cp", *[(holds(n, cp) if n in BINARY else value(n, cp)).alias(n) for n in names])


def ranges(table: DataFrame, column: str) -> DataFrame:
    """(first, last, value): maximal runs of neighbouring code points of one value (gaps and islands, by plane)."""
    plane = F.floor(F.col("cp") / 0x10000)
    w = Window.partitionBy(plane).orderBy("cp")
    new = F.when((F.lag(column).over(w).eqNullSafe(F.col(column))) & (F.lag("cp").over(w) == F.col("cp") - 1), 0).otherwise(1)
    runs = table.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(plane.alias("plane"), "run").agg(F.min("cp").alias("first"), F.max("cp").alias("last"), F.first(column).alias("value")).select("first", "last", "value")


def decompositions(spark: SparkSession, first: int = 0, last: int = LAST) -> DataFrame:
    """(cp, full): the full canonical decomposition of each code point that has one, as code points."""
    text = F.call_function("java_method", F.lit(_CHAR), F.lit("toString"), F.col("cp"))
    table = code_points(spark, first, last).where("cp < 55296 OR cp > 57343").withColumn("ch", text).withColumn("d", nfd(F.col("ch"))).where(F.col("d") != F.col("ch"))
    return table.select("cp", F.transform(F.split("d", ""), F.ascii).alias("full"))


def compositions(spark: SparkSession) -> DataFrame:
    """(first, second, composite): pairs that compose, without the excluded ones; Hangul goes by arithmetic."""
    single = F.call_function("java_method", F.lit(_CHAR), F.lit("toString"), F.col("cp"))
    table = decompositions(spark).where("cp < 44032 OR cp > 55203").where(~holds("full_composition_exclusion", F.col("cp")))
    table = table.withColumn("ch", single).withColumn("last", F.element_at("full", -1))
    head = F.array_join(F.transform(F.slice("full", 1, F.size("full") - 1), lambda c: F.call_function("java_method", F.lit(_CHAR), F.lit("toString"), c)), "")
    return table.where(F.size("full") > 1).select(F.ascii(nfc(head)).alias("first"), F.col("last").alias("second"), F.col("cp").alias("composite"))


# Letters for the grapheme pattern: by cluster break, conjunct break and pictographic.
_BREAKS = {"CR": "R", "LF": "N", "Control": "K", "ZWJ": "Z", "Regional_Indicator": "I", "Prepend": "P", "SpacingMark": "S", "L": "L", "V": "V", "T": "T", "LV": "D", "LVT": "W"}
CLUSTER = r"RN|[RNK]|P*(?:L*(?:V+|DV*|W)T*|L+|T+|II|X(?:[EFM]*ZX)*|Q(?:[EMZ]*M[EMZ]*Q)*|[IOXQ])[EFMZS]*|P+[EFMZS]*|[EFMZS]+"


@lru_cache(maxsize=2)
def _letter_rows(session_id: str) -> tuple[str, str]:
    spark = SparkSession.getActiveSession()
    table = property_table(spark, "grapheme_cluster_break", "indic_conjunct_break", "extended_pictographic").where("cp < 55296 OR cp > 57343")
    rows = table.where("cp < 128 OR grapheme_cluster_break <> 'Other' OR indic_conjunct_break = 'Consonant' OR extended_pictographic").collect()  # fixed by Unicode
    source, target = [], []
    for r in rows:
        gcb, incb = r["grapheme_cluster_break"], r["indic_conjunct_break"]
        if gcb == "Extend":
            letter = {"Linker": "M", "Extend": "E"}.get(incb, "F")
        else:
            letter = _BREAKS.get(gcb) or ("Q" if incb == "Consonant" else "X" if r["extended_pictographic"] else "O")
        source.append(chr(r["cp"]))
        target.append(letter)
    return "".join(source), "".join(target)


def cluster_letters(spark: SparkSession, text: Column) -> Column:
    """One letter for each scalar of the text: its class in the rules of grapheme clusters."""
    source, target = _letter_rows(str(id(spark.sparkContext)))
    return F.regexp_replace(F.translate(text, source, target), "[^\\x00-\\x7F]", "O")


def cluster_lengths(spark: SparkSession, text: Column) -> Column:
    """Scalars of each extended grapheme cluster, in order."""
    return F.transform(F.regexp_extract_all(cluster_letters(spark, text), F.lit(CLUSTER), F.lit(0)), F.char_length)


#: Where a letter may join another one: all but those of plain characters, controls and lone pictographs and consonants.
_JOINS = "[^ONKXQR]|RN"


def cluster_count(spark: SparkSession, text: Column) -> Column:
    """Extended grapheme clusters; where no character can join another they are the scalars."""
    letters = cluster_letters(spark, text)
    return F.when(~letters.rlike(_JOINS), F.char_length(letters)).otherwise(F.size(F.regexp_extract_all(letters, F.lit(CLUSTER), F.lit(0))))


def first_cluster(spark: SparkSession, text: Column) -> Column:
    """The text's first cluster, however long."""
    return F.substring(text, F.lit(1), F.char_length(F.regexp_extract(cluster_letters(spark, text), CLUSTER, 0)))
