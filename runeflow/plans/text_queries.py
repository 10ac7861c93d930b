"""Queries on texts: scalars, properties, normal forms, clusters, paragraphs, runs, byte and number functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from runeflow.functions import scalar as s
from runeflow.functions import unicode as u
from runeflow.operators import bidi, recognition, text
from runeflow.plans.registry import query, quoted
from runeflow.sources import tables as ucd
from runeflow.sources.tables import table, ucd_ranges
from runeflow.streaming import texts as streams

#: SQL twins know the categories of the code points up to here; the tables' texts have none above.
_KNOWN = 0x250


def _category_values() -> str:
    runs: list[list] = []
    for c in range(_KNOWN):
        g = unicodedata.category(chr(c))
        if runs and runs[-1][2] == g:
            runs[-1][1] = c
        else:
            runs.append([c, c, g])
    return ",".join(f"({a},{b},'{g}')" for a, b, g in runs)


_CHARS = "SELECT lang, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0"


@query(f"""WITH c AS ({_CHARS}), k AS (SELECT lang, ch, count(*) AS n FROM c GROUP BY lang, ch), g(a, b, category) AS (VALUES {_category_values()})
SELECT lang, category, CAST(sum(n) AS BIGINT) AS n_scalars, CAST(sum(n * strlen(ch)) AS BIGINT) AS n_bytes, count(*) AS n_distinct FROM k JOIN g ON unicode(ch) BETWEEN a AND b GROUP BY lang, category""")
def category_profile(spark, sf_dir):
    """Scalars, bytes and distinct scalars of each language and general category."""
    k = text.character_counts(table(spark, sf_dir, "documents"), ["lang"], "text")
    k = k.withColumn("category", u.value("general_category", F.col("cp"), short=True))
    return k.groupBy("lang", "category").agg(F.sum("n").alias("n_scalars"), F.sum(F.col("n") * F.octet_length("ch")).alias("n_bytes"), F.count("*").alias("n_distinct"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_scalars, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def scalar_counts(spark, sf_dir):
    n, size = text.scalar_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("bigint").alias("n_scalars"), size.cast("bigint").alias("n_bytes"))


@query(f"WITH c AS ({_CHARS}) SELECT lang, CAST(strlen(ch) AS BIGINT) AS width, count(*) AS n FROM c GROUP BY 1, 2")
def utf8_byte_lengths(spark, sf_dir):
    k = text.character_counts(table(spark, sf_dir, "documents"), ["lang"], "text")
    return k.groupBy("lang", F.octet_length("ch").cast("bigint").alias("width")).agg(F.sum("n").alias("n"))


@query("""WITH c AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ''), 1) - 1 AS ix, unnest(string_split(p_name, '')) AS ch FROM part WHERE length(p_name) > 0)
SELECT p_partkey, CAST(ix AS BIGINT) AS ix, CAST(unicode(ch) AS BIGINT) AS cp, CAST(sum(strlen(ch)) OVER (PARTITION BY p_partkey ORDER BY ix) - strlen(ch) AS BIGINT) AS byte_begin, CAST(sum(strlen(ch)) OVER (PARTITION BY p_partkey ORDER BY ix) AS BIGINT) AS byte_end FROM c""")
def scalar_offsets(spark, sf_dir):
    rows = text.scalars(table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return rows.select("p_partkey", F.col("ix").cast("bigint").alias("ix"), F.col("cp").cast("bigint").alias("cp"), F.col("begin").cast("bigint").alias("byte_begin"), F.col("end").cast("bigint").alias("byte_end"))


@query(f"WITH c AS ({_CHARS}) SELECT CAST(unicode(ch) AS BIGINT) AS cp, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, cp LIMIT 20")
def codepoint_topk(spark, sf_dir):
    """The 20 most frequent scalars."""
    k = text.character_counts(table(spark, sf_dir, "documents"), [], "text")
    return k.select(F.col("cp").cast("bigint").alias("cp"), "n").orderBy(F.desc("n"), "cp").limit(20)


@query(f"""WITH c AS ({_CHARS}), b(a, z, block) AS (VALUES (0, 127, 'Basic_Latin'), (128, 255, 'Latin_1_Supplement'), (256, 383, 'Latin_Extended_A'), (384, 591, 'Latin_Extended_B'))
SELECT block, count(*) AS n FROM c JOIN b ON unicode(ch) BETWEEN a AND z GROUP BY block""")
def block_histogram(spark, sf_dir):
    k = text.character_counts(table(spark, sf_dir, "documents"), [], "text")
    return k.groupBy(u.value("block", F.col("cp")).alias("block")).agg(F.sum("n").alias("n"))


_COUNT = "CAST(length(text) - length(regexp_replace(text, '[{}]', '', 'g')) AS BIGINT)"


@query(f"SELECT doc_id, {_COUNT.format('0-9')} AS digits, {_COUNT.format('A-Z')} AS upper, {_COUNT.format('a-z')} AS lower, {_COUNT.format(' ' + chr(92) + 't' + chr(92) + 'n')} AS spaces, {_COUNT.format('!-/:-@' + chr(92) + '[-`{-~').replace('{-~', '{-~')} AS marks FROM documents")
def ascii_class_counts(spark, sf_dir):
    t = F.col("text")
    count = lambda cls: s.count_in(t, cls).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", count("0-9").alias("digits"), count("A-Z").alias("upper"), count("a-z").alias("lower"), count(" \\t\\n").alias("spaces"), count("!-/:-@\\[-`{-~").alias("marks"))


@query("""WITH q AS (SELECT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages), p AS (SELECT page_id, unnest(string_split(q, '&')) AS pair FROM q WHERE q <> '')
SELECT page_id, split_part(pair, '=', 1) AS name, CASE WHEN strpos(pair, '=') > 0 THEN substr(pair, strpos(pair, '=') + 1) END AS param FROM p""")
def url_parameters(spark, sf_dir):
    q = F.regexp_extract("url", "[?]([^#]*)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", q.alias("q")).where("q <> ''").select("page_id", F.explode(F.split("q", "&")).alias("pair"))
    return rows.select("page_id", s.read_until(F.col("pair"), "=").alias("name"), F.when(F.instr("pair", "=") > 0, F.expr("substring(pair, instr(pair, '=') + 1)")).alias("param"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?')) AS BIGINT) AS n_numbers,
TRY_CAST(NULLIF(regexp_extract(text, '([0-9]+)', 1), '') AS BIGINT) AS first_integer FROM documents""")
def number_scan(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s.number_list(t)).cast("bigint").alias("n_numbers"), F.regexp_extract(t, "([0-9]+)", 1).try_cast("bigint").alias("first_integer"))


_BYTES = "list_transform(range(1, strlen({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS {1}))"


@query(f"SELECT p_partkey, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {_BYTES.format('p_name', 'BIGINT')}), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS BIGINT) AS hash32, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {_BYTES.format('lower(p_name)', 'BIGINT')}), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS BIGINT) AS hash32_ci FROM part")
def fnv1a_32(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", s.fnv1a_32(F.col("p_name")).alias("hash32"), s.fnv1a_32(F.col("p_name"), True).alias("hash32_ci"))


@query(f"""WITH h AS (SELECT n_nationkey, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), {_BYTES.format('n_name', 'HUGEINT')}), lambda h, b: (xor(h, b) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)) AS x FROM nation)
SELECT n_nationkey, lower(lpad(format('{{:x}}', CAST(x AS UBIGINT)), 16, '0')) AS hash64 FROM h""")
def fnv1a_64(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", s.fnv1a_64(F.col("n_name")).alias("hash64"))


@query("""SELECT o_orderkey, (o_orderkey >> 2) & 15 AS field, (o_orderkey & ~CAST(240 AS BIGINT)) | ((o_orderkey % 16) << 4) AS replaced, ((o_orderkey << 7) & 4294967295) | ((o_orderkey & 4294967295) >> 25) AS rotated,
((o_orderkey & 255) << 24) | (((o_orderkey >> 8) & 255) << 16) | (((o_orderkey >> 16) & 255) << 8) | ((o_orderkey >> 24) & 255) AS swapped, CAST(bit_count(o_orderkey) AS BIGINT) AS ones, upper(hex(o_orderkey)) AS hex_text FROM orders""")
def bit_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", s.bit_field(k, 2, 4).alias("field"), s.set_bit_field(k, 4, 4, k % 16).alias("replaced"), s.rotate_left32(k, 7).alias("rotated"), s.swap32(k).alias("swapped"), F.bit_count(k).cast("bigint").alias("ones"), F.hex(k).alias("hex_text")
    )


_APART = (("é", "é"), ("è", "è"), ("ü", "ü"), ("ñ", "ñ"), ("ö", "ö"))


def _apart_sql(column: str) -> str:
    for whole, parts in _APART:
        column = f"replace({column}, {quoted(whole)}, {quoted(parts)})"
    return column


def _apart(column):
    for whole, parts in _APART:
        column = F.replace(column, F.lit(whole), F.lit(parts))
    return column


@query(f"SELECT doc_id, md5(nfc_normalize({_apart_sql('text')})) AS nfc_md5, CAST(length({_apart_sql('text')}) AS BIGINT) AS apart_length, nfc_normalize({_apart_sql('text')}) = {_apart_sql('text')} AS was_nfc FROM documents")
def nfc_text(spark, sf_dir):
    """Texts taken apart and composed again."""
    t = _apart(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(u.nfc(t), "utf-8")).alias("nfc_md5"), F.char_length(t).cast("bigint").alias("apart_length"), text.is_nfc(t).alias("was_nfc"))


_TAILS = ("", "👨‍👩‍👧", "🇫🇷🇩🇪", "é", "क्षि")
_TAIL_SQL = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN {quoted(t)}" for k, t in enumerate(_TAILS)) + " END"


@query(f"SELECT doc_id, CAST(length_grapheme({_apart_sql('text')} || {_TAIL_SQL}) AS BIGINT) AS n_clusters, left_grapheme({_TAIL_SQL} || {_apart_sql('text')}, 1) AS first_cluster FROM documents")
def grapheme_count(spark, sf_dir):
    """Extended grapheme clusters of the texts, with sequences that need each rule added."""
    tail = F.lit(_TAILS[0])
    for k, t in enumerate(_TAILS):
        tail = F.when(F.col("doc_id") % 5 == k, F.lit(t)).otherwise(tail)
    apart = _apart(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", u.cluster_count(spark, F.concat(apart, tail)).cast("bigint").alias("n_clusters"), u.first_cluster(spark, F.concat(tail, apart)).alias("first_cluster"))


_LATIN = "(65,90),(97,122),(170,170),(186,186),(192,214),(216,246),(248,591)"


@query(f"""WITH c AS ({_CHARS}), k AS (SELECT lang, unicode(ch) AS cp, count(*) AS n FROM c GROUP BY 1, 2), l(a, b) AS (VALUES {_LATIN})
SELECT lang, CASE WHEN a IS NULL THEN 'Common' ELSE 'Latin' END AS script, CAST(sum(n) AS BIGINT) AS n FROM k LEFT JOIN l ON cp BETWEEN a AND b GROUP BY 1, 2""")
def script_mix(spark, sf_dir):
    k = text.character_counts(table(spark, sf_dir, "documents"), ["lang"], "text")
    return k.groupBy("lang", u.value("script", F.col("cp")).alias("script")).agg(F.sum("n").alias("n"))


@query(f"""WITH c AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ''), 1) - 1 AS ix, unicode(unnest(string_split(p_name, ''))) AS cp FROM part WHERE length(p_name) > 0), l(a, b) AS (VALUES {_LATIN}),
k AS (SELECT p_partkey, count(a) AS strong, count(*) AS n FROM c LEFT JOIN l ON cp BETWEEN a AND b GROUP BY 1)
SELECT p_partkey, CASE WHEN strong > 0 THEN 'Latin' ELSE 'Common' END AS script, CAST(0 AS BIGINT) AS first_scalar, n AS n_scalars FROM k""")
def script_runs(spark, sf_dir):
    """Runs of one script in part names; common characters join the strong ones beside them."""
    rows = text.scalars(table(spark, sf_dir, "part"), "p_partkey", "p_name").withColumn("script", u.value("script", F.col("cp")))
    rows = text.resolve_scripts(rows.withColumn("candidates", F.array("script")), "p_partkey")
    runs = text.script_runs(rows, "p_partkey")
    return runs.select("p_partkey", "script", F.col("first").cast("bigint").alias("first_scalar"), F.col("count").alias("n_scalars"))


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS n_paragraphs FROM documents")
def paragraph_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("bigint").alias("n_paragraphs"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_scalars, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS n_paragraphs, 'Ready' AS status FROM documents")
def stream_profile(spark, sf_dir):
    """What the document stream computes a row, over the table."""
    p = streams.profile(table(spark, sf_dir, "documents"))
    return p.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_scalars", "n_bytes", "n_paragraphs")], "status")


@query("""SELECT conv_id, turn, trim(text) AS trimmed, ltrim(text, 'ABCabc') AS left_trimmed, starts_with(text, 'The') AS starts, contains(text, 'and') AS holds, CAST(strpos(text, 'the') AS BIGINT) AS place,
regexp_extract(text, '^[A-Za-z_][A-Za-z0-9_]*') AS name, split_part(text, ' ', 1) AS first_word, regexp_matches(text, '^[ -~]*$') AS ascii_only FROM conversations""")
def string_functions(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.trim(t).alias("trimmed"), F.ltrim(t, F.lit("ABCabc")).alias("left_trimmed"), t.startswith("The").alias("starts"), t.contains("and").alias("holds"),
        F.locate("the", t).cast("bigint").alias("place"), s.identifier(t).alias("name"), s.read_until(t, " ").alias("first_word"), s.all_in(t, " -~").alias("ascii_only"),
    )


@query("SELECT name, min(n_nationkey) AS first_key, count(*) AS n FROM (SELECT lower(n_name) AS name, n_nationkey FROM nation UNION ALL SELECT lower(r_name), r_regionkey FROM region) GROUP BY name")
def interned_names(spark, sf_dir):
    """Names interned without regard to case."""
    both = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), "n_nationkey").union(table(spark, sf_dir, "region").select(F.lower("r_name"), "r_regionkey"))
    return both.groupBy("name").agg(F.min("n_nationkey").alias("first_key"), F.count("*").alias("n"))


# Lines of the database's form, to be read as its files are.
_UCD = ("# Scripts", "", "0041..005A    ; Latin # L&  [26] A..Z", "00AA          ; Latin # Lo", "0370..0373    ; Greek # L&", "  ", "1F600..1F64F  ; Common # So")


@query("SELECT * FROM (VALUES (CAST(65 AS BIGINT), CAST(90 AS BIGINT), 'Latin'), (170, 170, 'Latin'), (880, 883, 'Greek'), (128512, 128591, 'Common')) t(first_cp, last_cp, script)")
def ucd_file_ranges(spark, sf_dir):
    found = ucd_ranges(spark.createDataFrame([(x,) for x in _UCD], "value string"))
    return found.select(F.col("first").cast("bigint").alias("first_cp"), F.col("last").cast("bigint").alias("last_cp"), F.col("values")[0].alias("script"))



# Lines of the forms of the main data file, of the alias file and of a file with defaults.
_MAIN = (
    "0041;LATIN CAPITAL LETTER A;Lu;0;L;;;;;N;;;;0061;", "00BD;VULGAR FRACTION ONE HALF;No;0;ON;<fraction> 0031 2044 0032;;;1/2;N;FRACTION ONE HALF;;;;", "00C5;LATIN CAPITAL LETTER A WITH RING ABOVE;Lu;0;L;0041 030A;;;;N;;;;00E5;",
    "0300;COMBINING GRAVE ACCENT;Mn;230;NSM;;;;;N;;;;;", "0028;LEFT PARENTHESIS;Ps;0;ON;;;;;Y;OPENING PARENTHESIS;;;;", "3400;<CJK Ideograph Extension A, First>;Lo;0;L;;;;;N;;;;;", "4DBF;<CJK Ideograph Extension A, Last>;Lo;0;L;;;;;N;;;;;",
    "01C5;LATIN CAPITAL LETTER D WITH SMALL LETTER Z WITH CARON;Lt;0;L;<compat> 0044 017E;;;;N;;;01C4;01C6;01C5",
)
_ALIASES = ("# names", "gc ; Lu ; Uppercase_Letter", "gc ; Nd ; Decimal_Number ; digit", "ccc; 230; A ; Above", "sc ; Qaai ; Inherited ; Zinh # x", "sc ; Latn ; Latin")
_DEFAULTS = ("# @missing: 0000..00FF; Neutral", "# @missing: 0020..002F; Wide", "0025..0027 ; Narrow # x", "0041 ; Ambiguous")


def _lines_sql(lines) -> str:
    return "(VALUES " + ",".join(f"({k}, {quoted(x)})" for k, x in enumerate(lines)) + ") l(k, line)"


_HEX = "CAST('0x' || {} AS BIGINT)"


@query(f"""WITH f AS (SELECT string_split(line, ';') AS f FROM {_lines_sql(_MAIN)}), r AS (SELECT {_HEX.format('f[1]')} AS cp, f FROM f), e AS (SELECT regexp_extract(f[2], '^<(.*), (First|Last)>$', 1) AS of, max(cp) AS last_cp FROM r WHERE f[2] LIKE '%First>' OR f[2] LIKE '%Last>' GROUP BY 1)
SELECT cp AS first_cp, coalesce(last_cp, cp) AS last_cp, CASE WHEN of IS NULL THEN f[2] ELSE of END AS name, f[3] AS category, CAST(f[4] AS BIGINT) AS combining_class, f[5] AS bidi_class, NULLIF(regexp_extract(f[6], '^<([^>]*)>', 1), '') AS kind,
NULLIF(trim(regexp_replace(f[6], '^<[^>]*>', '')), '') AS mapping, NULLIF(f[9], '') AS numeric_value, f[10] = 'Y' AS mirrored, CASE WHEN f[14] <> '' THEN {_HEX.format('f[14]')} END AS lower_cp FROM r LEFT JOIN e ON regexp_extract(f[2], '^<(.*), First>$', 1) = of WHERE f[2] NOT LIKE '%Last>'""")
def ucd_unicode_data(spark, sf_dir):
    """The main data file's lines as rows."""
    d = ucd.unicode_data(spark.createDataFrame([(x,) for x in _MAIN], "value string"))
    mapping = F.array_join(F.transform("mapping", lambda c: F.lpad(F.hex(c.cast("bigint")), 4, "0")), " ")
    wide = lambda c, n: F.col(c).cast("bigint").alias(n)
    return d.select(wide("first", "first_cp"), wide("last", "last_cp"), "name", "category", wide("combining_class", "combining_class"), "bidi_class", F.col("decomposition_kind").alias("kind"), mapping.alias("mapping"), F.col("numeric").alias("numeric_value"), "mirrored", wide("lower", "lower_cp"))


@query(f"""WITH f AS (SELECT list_transform(string_split(regexp_replace(line, '#.*$', ''), ';'), lambda x: trim(x)) AS f FROM {_lines_sql(_ALIASES)} WHERE trim(regexp_replace(line, '#.*$', '')) <> '')
SELECT f[1] AS property, CASE WHEN f[1] = 'ccc' THEN CAST(f[2] AS BIGINT) END AS number, CASE WHEN f[1] = 'ccc' THEN f[3] ELSE f[2] END AS short, CASE WHEN f[1] = 'ccc' THEN f[4] ELSE f[3] END AS long, array_to_string(CASE WHEN f[1] = 'ccc' THEN f[5:] ELSE f[4:] END, ' ') AS others FROM f""")
def ucd_value_aliases(spark, sf_dir):
    a = ucd.value_aliases(spark.createDataFrame([(x,) for x in _ALIASES], "value string"))
    return a.select("property", F.col("number").cast("bigint").alias("number"), "short", "long", F.array_join("others", " ").alias("others"))


@query("SELECT CAST(cp AS BIGINT) AS cp, CASE WHEN cp BETWEEN 37 AND 39 THEN 'Narrow' WHEN cp = 65 THEN 'Ambiguous' WHEN cp BETWEEN 32 AND 47 THEN 'Wide' ELSE 'Neutral' END AS value FROM range(0, 256) t(cp)")
def ucd_defaults(spark, sf_dir):
    """Values with a file's defaults applied, the later default first."""
    lines = spark.createDataFrame([(x,) for x in _DEFAULTS], "value string").coalesce(1)
    found = ucd_ranges(lines).withColumn("value", F.col("values")[0])
    return ucd.with_defaults(found, ucd.ucd_missing(lines)).select(F.col("cp").cast("bigint").alias("cp"), "value")


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(64 AS BIGINT)), (91, 169), (171, 879), (884, 128511), (128592, 1114111)) t(first_cp, last_cp)")
def ucd_unknown(spark, sf_dir):
    """What no range of a file takes in."""
    found = ucd_ranges(spark.createDataFrame([(x,) for x in _UCD], "value string"))
    return ucd.uncovered(found).select(F.col("first").cast("bigint").alias("first_cp"), F.col("last").cast("bigint").alias("last_cp"))


@query()
def ucd_five_properties(spark, sf_dir):
    """Five properties of every code point."""
    return u.property_table(spark, "general_category", "combining_class", "bidi_class", "script", "block")


@query()
def ucd_script_ranges(spark, sf_dir):
    """Maximal ranges of one script over all code points."""
    return u.ranges(u.property_table(spark, "script"), "script")


@query()
def ucd_properties(spark, sf_dir):
    """Every property of every code point."""
    return u.property_table(spark, *u.ENUMERATED, *u.BINARY)


@query()
def ucd_decompositions(spark, sf_dir):
    return u.decompositions(spark)


@query()
def ucd_compositions(spark, sf_dir):
    return u.compositions(spark)


# Texts, direction, paragraph level and levels by the rules.
_BIDI = (
    ("abc", "auto", 0, "0,0,0"),
    ("אבג", "auto", 1, "1,1,1"),
    ("abc אבג", "auto", 0, "0,0,0,0,1,1,1"),
    ("אב 12", "auto", 1, "1,1,1,2,2"),
    ("a(אב)c", "auto", 0, "0,0,1,1,0,0"),
    ("abc", "rtl", 1, "2,2,2"),
    ("ا1ب", "auto", 1, "1,2,1"),
    ("a‏b", "auto", 0, "0,1,0"),
    ("a⁧אb⁩c", "auto", 0, "0,0,1,2,0,0"),
    ("א-ב", "ltr", 0, "1,1,1"),
    ("a⦍b א⦐ ג", "auto", 0, "0,0,0,0,1,0,0,1"),
    ("a⦏b א⦎ ג", "auto", 0, "0,0,0,0,1,0,0,1"),
    ("a⦍b א⦎ ג", "auto", 0, "0,0,0,0,1,1,1,1"),
)


@query("SELECT * FROM (VALUES " + ",".join(f"(CAST({k} AS BIGINT), CAST({b} AS BIGINT), '{lv}')" for k, (_, _, b, lv) in enumerate(_BIDI)) + ") t(id, base, levels)")
def bidi_levels(spark, sf_dir):
    out = None
    for d in ("auto", "ltr", "rtl"):
        rows = [(k, t) for k, (t, way, *_) in enumerate(_BIDI) if way == d]
        part = bidi.with_levels(spark.createDataFrame(rows, "id long, text string"), "text", d)
        out = part if out is None else out.union(part)
    return out.select("id", F.col("base").cast("bigint").alias("base"), F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END AS body, text FROM documents WHERE text <> '')
SELECT doc_id, CAST(len(string_split(body, chr(10))) AS BIGINT) AS n_paragraphs, CAST(0 AS BIGINT) AS highest, CAST(length(text) AS BIGINT) AS n_level_zero FROM p""")
def bidi_documents(spark, sf_dir):
    """Levels of whole documents, paragraph by paragraph; Latin texts are level 0 throughout."""
    out = bidi.paragraph_levels(table(spark, sf_dir, "documents"), "doc_id", "text")
    zero = F.size(F.filter("levels", lambda x: x == 0))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max(F.coalesce(F.array_max("levels"), F.lit(0))).cast("bigint").alias("highest"), F.sum(zero).cast("bigint").alias("n_level_zero"))


_HEBREW = "אבג 12"


@query("""SELECT p_partkey, k AS paragraph, k AS base, CASE k WHEN 0 THEN '0,2,1,3' ELSE '3,2,1,0' END AS visual, CAST(CASE k WHEN 0 THEN length(p_name) + 2 ELSE 0 END AS BIGINT) AS n0, CAST(CASE k WHEN 0 THEN 4 ELSE 5 END AS BIGINT) AS n1, CAST(CASE k WHEN 0 THEN 2 ELSE length(p_name) + 2 END AS BIGINT) AS n2
FROM part, (VALUES (CAST(0 AS BIGINT)), (1)) t(k)""")
def bidi_mixed(spark, sf_dir):
    """Two paragraphs of each part, one that begins with its name and one with Hebrew: levels, and runs in visual order."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(f" {_HEBREW}\n{_HEBREW} "), "p_name").alias("t"))
    out = bidi.paragraph_levels(rows, "p_partkey", "t")
    n = lambda k: F.size(F.filter("levels", lambda x: x == k)).cast("bigint").alias(f"n{k}")
    return out.select("p_partkey", F.col("paragraph").cast("bigint").alias("paragraph"), F.col("base").cast("bigint").alias("base"), F.array_join(F.col("order").cast("array<string>"), ",").alias("visual"), n(0), n(1), n(2))


@query("""WITH g AS (SELECT n_nationkey, unnest(range(0, length(n_name))) AS ix, length(n_name) AS n FROM nation)
SELECT n_nationkey, CAST(ix AS BIGINT) AS ix, CAST(CASE WHEN ix < 3 THEN 10 * ix ELSE 30 + 10 * (n - 3) - 10 * (ix - 3) - 10 END AS BIGINT) AS x FROM g""")
def bidi_positions(spark, sf_dir):
    """Glyphs of a line with a run to the right and one to the left, placed."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.split("n_name", "")).alias("ix", "ch")).where("ch <> ''")
    late = (F.col("ix") >= 3).cast("int")
    glyphs = rows.select("n_nationkey", "ix", late.alias("run"), late.alias("level"), F.lit(10).alias("advance"), F.lit(0).alias("offset"))
    out = bidi.placed_runs(glyphs, ["n_nationkey"], "run", "level", "ix", "advance", "offset")
    return out.select("n_nationkey", F.col("ix").cast("bigint").alias("ix"), F.col("x").cast("bigint").alias("x"))


# Clusters of two paragraphs (paragraph, place, script, level) and their runs (script, level, first, count).
_LEVELLED = ((1, 0, "Latin", 0), (1, 1, "Hebrew", 1), (1, 2, "Common", 0), (2, 0, "Latin", 0), (2, 1, "Common", 0), (2, 2, "Hebrew", 1), (2, 3, "Common", 1), (2, 4, "Common", 2), (2, 5, "Latin", 0))
_LEVEL_RUNS = ((1, "Latin", 0, 0, 1), (1, "Hebrew", 1, 1, 1), (1, "Common", 0, 2, 1), (2, "Latin", 0, 0, 2), (2, "Hebrew", 1, 2, 2), (2, "Common", 2, 4, 1), (2, "Latin", 0, 5, 1))


@query("SELECT * FROM (VALUES " + ",".join(f"(CAST({p} AS BIGINT), '{n}', CAST({lv} AS BIGINT), CAST({f} AS BIGINT), CAST({c} AS BIGINT))" for p, n, lv, f, c in _LEVEL_RUNS) + ") t(id, script, level, first_cluster, n_clusters)")
def script_level_runs(spark, sf_dir):
    """Runs of one script and level; context doesn't leap over a run of another level."""
    rows = spark.createDataFrame(list(_LEVELLED), "id long, ix int, resolved string, level int")
    out = text.script_runs(rows, level="level")
    return out.select("id", "script", F.col("level").cast("bigint").alias("level"), F.col("first").cast("bigint").alias("first_cluster"), F.col("count").alias("n_clusters"))


@query(f"""WITH c AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) - 1 AS ix, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, ix, unicode(ch) AS cp, strlen({_apart_sql('ch')}) AS n FROM c),
o AS (SELECT doc_id, ix, cp, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY ix) AS BIGINT) AS e FROM w)
SELECT doc_id, count(*) AS n_scalars, CAST(max(e) AS BIGINT) AS n_source_bytes, CAST(sum((cp * 31 + e) % 1000003) AS BIGINT) AS ends, CAST(sum((ix + 1) * (e - n) % 1000003) AS BIGINT) AS begins FROM o GROUP BY doc_id""")
def nfc_offsets(spark, sf_dir):
    """Texts taken apart and composed again: the bytes of the source that each composed scalar stands for, summed up."""
    rows = table(spark, sf_dir, "documents").select("doc_id", _apart(F.col("text")).alias("t"))
    out = text.nfc_offsets(rows, "doc_id", "t").selectExpr("doc_id", "cast(ix as bigint) AS ix", "cast(cp as bigint) AS cp", "cast(`begin` as bigint) AS b", "cast(`end` as bigint) AS e")
    return out.groupBy("doc_id").agg(F.count("*").alias("n_scalars"), F.max("e").alias("n_source_bytes"), F.sum(F.expr("(cp * 31 + e) % 1000003")).alias("ends"), F.sum(F.expr("(ix + 1) * b % 1000003")).alias("begins"))


@query("""SELECT o_orderkey, hex(CAST((CAST(o_orderkey AS HUGEINT) * 1152921504606846976) % 18446744073709551616 + (o_orderkey >> 4) AS UBIGINT)) AS rotated64,
CAST(floor((CASE WHEN (o_orderkey * 1048576) % 4294967296 >= 2147483648 THEN (o_orderkey * 1048576) % 4294967296 - 4294967296 ELSE (o_orderkey * 1048576) % 4294967296 END) / 8.0) AS BIGINT) AS shifted,
CAST((ascii(substr(o_orderpriority, 2, 1)) // 8 + ascii(substr(o_orderpriority, 3, 1)) * 32) % 4096 AS BIGINT) AS bits, CASE WHEN o_orderstatus = 'O' THEN true WHEN o_orderstatus = 'F' THEN false END AS flag FROM orders""")
def wide_bit_functions(spark, sf_dir):
    k = F.col("o_orderkey")
    flag = s.boolean(F.when(F.col("o_orderstatus") == "O", " On ").when(F.col("o_orderstatus") == "F", "no").otherwise("?"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(s.rotate_left64(k, 60)).alias("rotated64"), s.arithmetic_shift32(k * 1048576, 3).alias("shifted"), s.bits_from_bytes(F.encode("o_orderpriority", "utf-8"), 11, 12).alias("bits"), flag.alias("flag"))


@query("""SELECT n_nationkey, split_part(n_name, 'I', 1) AS enclosed, n_name || '",a"' AS before_comma FROM nation""")
def enclosed_tokens(spark, sf_dir):
    """Tokens between marks, and up to a delimiter that isn't quoted."""
    inside = F.concat(F.lit("("), F.replace("n_name", F.lit("I"), F.lit(")")), F.lit(")tail"))
    quoted_comma = F.concat("n_name", F.lit('",a",rest'))
    return table(spark, sf_dir, "nation").select("n_nationkey", s.read_enclosed(inside, "(", ")").alias("enclosed"), s.read_until_unquoted(quoted_comma, ",").alias("before_comma"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Events by type in tumbling windows of an hour: what the stream keeps, over the table."""
    out = streams.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "2 hours")
    return out.select("event_type", F.col("window.start").alias("hour"), "n")


_DEVANAGARI = ("क", "क्ष", "र्क", "कि", "अं", "क्‍ष", "हिन्दी", "नमस्ते", "abc", "१२", "़", "कx")

def _twin_kinds(t: str) -> str:
    """Kind letters of the sample texts by a plain table."""
    table_ = {**dict.fromkeys("कषहदमतनस", "c"), "र": "r", "अ": "v", "़": "n", "्": "h", "‍": "j", "ि": "m", "े": "a", "ी": "p", "ं": "x", "१": "d", "२": "d"}
    return "".join(table_.get(c, "o") for c in t)


@query("SELECT id, kinds, array_to_string(regexp_extract_all(kinds, '(?:[rc]n?(?:h[jJ]?|J?h))*[rc]n?(?:[jJ])?(?:h[jJ]?|[mabp]*n?h?)[xze]*|(?:rh)?vn?[mabp]*n?h?[xze]*|[nhmabpxze]+'), '/') AS units FROM (VALUES " + ",".join(f"(CAST({k} AS BIGINT), {quoted(_twin_kinds(t))})" for k, t in enumerate(_DEVANAGARI)) + ") t(id, kinds)")
def devanagari_units(spark, sf_dir):
    """Kinds and recognised units of sample texts."""
    rows = spark.createDataFrame(list(enumerate(_DEVANAGARI)), "id long, text string").withColumn("kinds", recognition.DEVANAGARI.kinds(F.col("text")))
    return rows.select("id", "kinds", F.array_join(recognition.DEVANAGARI_UNITS.recognise(F.col("kinds")), "/").alias("units"))


_THAI = ("นํา", "น้ำ", "ทำ", "กำ้", "คำ่", "abc", "ำ")


@query("SELECT id, regexp_replace(text, '([่-๋]*)ำ', 'ํ\\1า', 'g') AS shaped FROM (VALUES " + ",".join(f"(CAST({k} AS BIGINT), {quoted(t)})" for k, t in enumerate(_THAI)) + ") t(id, text)")
def thai_sara_am(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(_THAI)), "id long, text string").select("id", recognition.thai_scalars(F.col("text")).alias("shaped"))
