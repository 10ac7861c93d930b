"""Queries on sets and reports: coverage, ranking, fallback, runs, histograms, extremes, tiers, positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runeflow.functions import paths
from runeflow.operators import bidi, reports, sets, text
from runeflow.plans.registry import query, quoted
from runeflow.sources.tables import table


def _alphabet(spark, sf_dir, key):
    return text.character_counts(table(spark, sf_dir, "documents"), [key], "text").select(key, "ch")


_ALPHABETS = "WITH a AS (SELECT DISTINCT source, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0), r AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0), t AS (SELECT lang, count(*) AS total FROM r GROUP BY lang), m AS (SELECT source, lang, count(*) AS covered FROM a JOIN r USING (ch) GROUP BY source, lang)"


@query(_ALPHABETS + " SELECT source, lang FROM m JOIN t USING (lang) WHERE covered = total")
def coverage_contains_all(spark, sf_dir):
    """Sources whose characters include all those of a language."""
    return sets.contains_all(_alphabet(spark, sf_dir, "source"), _alphabet(spark, sf_dir, "lang"), "source", "lang", "ch")


@query(_ALPHABETS + " SELECT source, lang, covered, total, round(100.0 * covered / total, 6) AS percent FROM m JOIN t USING (lang) WHERE 100.0 * covered / total > 90")
def coverage_ratio(spark, sf_dir):
    """How much of each language's alphabet each source has, where it is more than 90 per cent."""
    c = sets.coverage(_alphabet(spark, sf_dir, "source"), _alphabet(spark, sf_dir, "lang"), "source", "lang", "ch")
    share = F.lit(100.0) * F.col("covered") / F.col("total")
    return c.where(share > 90).select("source", "lang", "covered", "total", F.round(share, 6).alias("percent"))


@query("WITH a AS (SELECT DISTINCT source, unnest(string_split(text, '')) AS ch FROM documents), r AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM documents) SELECT DISTINCT source, lang FROM a JOIN r USING (ch) WHERE unicode(ch) > 127")
def coverage_intersects(spark, sf_dir):
    """Sources and languages with a common character beyond ASCII."""
    return sets.intersects(_alphabet(spark, sf_dir, "source").where(F.ascii("ch") > 127), _alphabet(spark, sf_dir, "lang"), "source", "lang", "ch")


@query("SELECT source, count(DISTINCT ch) AS n FROM (SELECT source, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0) GROUP BY source")
def coverage_stats(spark, sf_dir):
    """Sizes of the sources' alphabets, by bitmaps."""
    return sets.bitmap_counts(_alphabet(spark, sf_dir, "source").withColumn("cp", F.ascii("ch")), "source")


@query("WITH c AS (SELECT DISTINCT source, unicode(unnest(string_split(text, ''))) AS cp FROM documents WHERE length(text) > 0), g AS (SELECT source, cp, cp - row_number() OVER (PARTITION BY source ORDER BY cp) AS k FROM c) SELECT source, CAST(min(cp) AS BIGINT) AS first_cp, CAST(max(cp) AS BIGINT) AS last_cp FROM g GROUP BY source, k")
def coverage_ranges(spark, sf_dir):
    a = _alphabet(spark, sf_dir, "source").withColumn("cp", F.ascii("ch"))
    return sets.ranges_of(a, "source").select("source", F.col("first").cast("bigint").alias("first_cp"), F.col("last").cast("bigint").alias("last_cp"))


@query(_ALPHABETS + """, f AS (SELECT lang, source, covered, total, regexp_replace(source, '[0-9]$', '') AS family FROM m JOIN t USING (lang)),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, family ORDER BY covered DESC, source) AS k FROM f), p AS (SELECT lang, family, source, covered, total, row_number() OVER (PARTITION BY lang ORDER BY covered DESC, source, family) AS place FROM b WHERE k = 1)
SELECT lang, family, source, covered, total, place FROM p WHERE place <= 3""")
def script_top3(spark, sf_dir):
    """For each language the three families of sources that cover it best, by the best source of each."""
    c = sets.coverage(_alphabet(spark, sf_dir, "source"), _alphabet(spark, sf_dir, "lang"), "source", "lang", "ch").withColumn("family", F.regexp_replace("source", "[0-9]$", ""))
    top = sets.top_per_key(c, "lang", "family", [F.desc("covered"), F.col("source")])
    return top.select("lang", "family", "source", "covered", "total", F.col("place").cast("bigint").alias("place"))


@query("""WITH w AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS ix, unnest(string_split(lower(p_name), ' ')) AS word FROM part), l AS (SELECT DISTINCT p_partkey, ix, unnest(string_split(word, '')) AS ch FROM w WHERE word <> ''),
f AS (SELECT DISTINCT n_nationkey AS face, unnest(string_split(lower(n_name), '')) AS ch FROM nation), need AS (SELECT p_partkey, ix, count(*) AS need FROM l GROUP BY 1, 2), hit AS (SELECT p_partkey, ix, face, count(*) AS have FROM l JOIN f USING (ch) GROUP BY 1, 2, 3),
best AS (SELECT p_partkey, ix, min(face) AS face FROM hit JOIN need USING (p_partkey, ix) WHERE have = need GROUP BY 1, 2), c AS (SELECT p_partkey, ix, coalesce(best.face, 0) AS face, best.face IS NOT NULL AS complete FROM need LEFT JOIN best USING (p_partkey, ix)),
r AS (SELECT *, CASE WHEN lag(face) OVER o IS NOT DISTINCT FROM face AND lag(complete) OVER o IS NOT DISTINCT FROM complete THEN 0 ELSE 1 END AS n FROM c WINDOW o AS (PARTITION BY p_partkey ORDER BY ix)), k AS (SELECT *, sum(n) OVER (PARTITION BY p_partkey ORDER BY ix) AS run FROM r)
SELECT p_partkey, CAST(run AS BIGINT) AS run, CAST(min(face) AS BIGINT) AS face, bool_and(complete) AS complete, count(*) AS n_words FROM k GROUP BY p_partkey, run""")
def font_fallback(spark, sf_dir):
    """Words of part names and the first nation whose name has all their letters; the first nation stands in for none."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(F.lower("p_name"), " ")).alias("ix", "word")).where("word <> ''")
    words = words.withColumn("cps", F.array_distinct(F.transform(F.split("word", ""), F.ascii)))
    faces = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("face"), F.col("n_nationkey").alias("priority"), F.explode(F.array_distinct(F.transform(F.split(F.lower("n_name"), ""), F.ascii))).alias("cp"))
    runs = text.font_runs(words, faces, "p_partkey")
    return runs.select("p_partkey", F.col("run").cast("bigint").alias("run"), F.col("face").cast("bigint").alias("face"), "complete", F.col("count").alias("n_words"))


@query("""WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER o IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, min(event_id) AS first_event, count(*) AS n_events FROM r GROUP BY user_id, run""")
def run_itemize_islands(spark, sf_dir):
    """Stretches of one event type of each user."""
    e = text.islands(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")
    return e.groupBy("user_id", F.col("run").cast("bigint").alias("run")).agg(F.first("event_type").alias("event_type"), F.min("event_id").alias("first_event"), F.count("*").alias("n_events"))


_EDGES = [0, 1, 2, 4, 8, 16, 32, 64]


@query("SELECT l_returnflag, CAST(CASE " + " ".join(f"WHEN l_quantity <= {e} THEN {k}" for k, e in enumerate(_EDGES)) + f" ELSE {len(_EDGES)} END AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2")
def histogram_buckets(spark, sf_dir):
    h = reports.histogram(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), _EDGES, "l_returnflag")
    return h.select("l_returnflag", F.col("bucket").cast("bigint").alias("bucket"), "n")


@query("""WITH m AS (SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(count(*) AS DOUBLE) AS lines, max(l_tax) AS tax FROM lineitem GROUP BY 1), u AS (SELECT l_suppkey, 'quantity' AS metric, quantity AS value FROM m UNION ALL SELECT l_suppkey, 'lines', lines FROM m UNION ALL SELECT l_suppkey, 'tax', tax FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, l_suppkey) AS r FROM u) SELECT metric, value, l_suppkey FROM k WHERE r = 1""")
def extremes_argmax(spark, sf_dir):
    """The supplier with the largest value of each metric."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("double").alias("quantity"), F.count("*").cast("double").alias("lines"), F.max("l_tax").alias("tax"))
    return reports.extremes(reports.unpivot(m, ["l_suppkey"], ["quantity", "lines", "tax"]), "l_suppkey")


@query("""WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id, value, CASE WHEN k = n - 1 THEN 'extreme' WHEN k = (n - 1) * 9 // 10 THEN 'high' ELSE 'typical' END AS tier FROM r WHERE k IN (n - 1, (n - 1) * 9 // 10, (n - 1) // 2)""")
def tiers_nearest_rank(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return reports.tiers(e, ["event_type"], [F.col("value"), F.col("event_id")])


@query("SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS automobile FROM customer GROUP BY 1")
def pivot_matrix(spark, sf_dir):
    p = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY", "AUTOMOBILE"]).count().na.fill(0)
    return p.select("c_nationkey", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery"), F.col("AUTOMOBILE").alias("automobile"))


@query("SELECT o_orderpriority, count(*) AS n, count(*) > 0 AS present FROM orders GROUP BY 1")
def presence_checklist(spark, sf_dir):
    return reports.presence(table(spark, sf_dir, "orders"), "o_orderpriority")


_KERN = (("a", "n", -3), ("e", "r", 2), ("i", "n", -1), ("o", "n", 4), ("t", "h", -2), ("l", "l", 1))
_KERN_SQL = ",".join(f"({quoted(a)},{quoted(b)},{v})" for a, b, v in _KERN)


@query(f"""WITH c AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ''), 1) AS ix, unnest(string_split(lower(p_name), '')) AS ch FROM part), p AS (SELECT p_partkey, ch, lead(ch) OVER (PARTITION BY p_partkey ORDER BY ix) AS nx FROM c), k(a, b, v) AS (VALUES {_KERN_SQL})
SELECT p_partkey, count(*) AS n_pairs, CAST(sum(v) AS BIGINT) AS adjustment FROM p JOIN k ON ch = a AND nx = b GROUP BY p_partkey""")
def kern_adjacent_pairs(spark, sf_dir):
    """Adjustments of neighbouring letters by a table of pairs; pairs are made inside the row."""
    letters = F.split(F.lower("p_name"), "")
    pairs = F.transform(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), lambda c, i: F.concat(c, F.get(letters, i + 1)))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(pairs).alias("pair"))
    kern = spark.createDataFrame([(a + b, v) for a, b, v in _KERN], "pair string, v long")  # a fixed table
    return rows.join(F.broadcast(kern), "pair").groupBy("p_partkey").agg(F.count("*").alias("n_pairs"), F.sum("v").alias("adjustment"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_event FROM events")
def mark_base_asof(spark, sf_dir):
    """For each event the user's last one before it that is no view, as a mark finds its base."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") != "view", F.col("event_id")), True).over(w).alias("base_event"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x_ltr,
(-sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING))::BIGINT AS x_rtl FROM lineitem""")
def pen_positions(spark, sf_dir):
    """Pens of an order's lines, left to right and right to left."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), F.col("l_quantity").cast("bigint").alias("adv"), F.lit(0).alias("off"))
    left = reports.pen_positions(rows, ["l_orderkey"], "at", "adv", "off").withColumnRenamed("x", "x_ltr")
    return reports.pen_positions(left, ["l_orderkey"], "at", "adv", "off", rtl=True).select("l_orderkey", "l_linenumber", F.col("x_ltr").cast("bigint").alias("x_ltr"), F.col("x").cast("bigint").alias("x_rtl"))


_ROWS = (("latn", "dflt", 0, "liga", "3,1"), ("latn", "dflt", 1, "ccmp", "0"), ("latn", "DEU ", 0, "liga", "4"), ("DFLT", "dflt", 0, "liga", "7"), ("arab", "dflt", 0, "calt", "9"))
_WANTED = ("latn", "DEU ", "liga"), ("latn", "FRA ", "liga"), ("grek", "dflt", "liga"), ("latn", "dflt", "calt")


@query("SELECT * FROM (VALUES ('latn','DEU ','liga','4'),('latn','FRA ','liga','0,1,3'),('grek','dflt','liga','7'),('latn','dflt','calt','0')) t(script, language, feature, lookups)")
def lookup_plan_select(spark, sf_dir):
    """Lookups of wanted features, with fallback to the default script and the script's default language."""
    have = spark.createDataFrame([(*r[:4], [int(x) for x in r[4].split(",")]) for r in _ROWS], "s string, l string, required int, f string, ks array<int>")
    want = spark.createDataFrame(_WANTED, "script string, language string, feature string")
    systems = have.select("s", "l").distinct()
    named = want.join(F.broadcast(systems.select("s").distinct()), F.col("script") == F.col("s"), "left").withColumn("use", F.coalesce("s", F.lit("DFLT"))).drop("s")
    named = named.join(F.broadcast(systems), (F.col("use") == F.col("s")) & (F.col("language") == F.col("l")), "left").withColumn("way", F.coalesce("l", F.lit("dflt"))).drop("s", "l")
    rows = named.join(F.broadcast(have), (F.col("use") == F.col("s")) & (F.col("way") == F.col("l")) & ((F.col("required") == 1) | (F.col("f") == F.col("feature"))))
    plan = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ks"))))
    return rows.groupBy("script", "language", "feature").agg(F.array_join(plan.cast("array<string>"), ",").alias("lookups"))


@query("""WITH e AS (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER o AS b, lead(event_type, 2) OVER o AS c, lag(event_type) OVER o AS z FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) AS n_matches FROM e WHERE a = 'click' AND b IN ('view', 'click') AND c = 'purchase' AND z IS DISTINCT FROM 'purchase' GROUP BY user_id""")
def context_match(spark, sf_dir):
    """Matches of a chained context: a click, then a view or click, ahead of a purchase and not after one."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = "event_type"
    e = table(spark, sf_dir, "events").select("user_id", F.col(t).alias("a"), F.lead(t).over(w).alias("b"), F.lead(t, 2).over(w).alias("c"), F.lag(t).over(w).alias("z"))
    return e.where("a = 'click' AND b IN ('view', 'click') AND c = 'purchase' AND NOT (z <=> 'purchase')").groupBy("user_id").agg(F.count("*").alias("n_matches"))


@query("""WITH p AS (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT a AS first_word, count(*) AS rules, count(DISTINCT b) AS fan_out FROM p GROUP BY a""")
def rule_prefix_fanout(spark, sf_dir):
    """Rules that share their first item, and distinct second items: what a prefix tree of them would share."""
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(words[0].alias("first_word"), F.coalesce(F.get(words, 1), F.lit("")).alias("b")).groupBy("first_word").agg(F.count("*").alias("rules"), F.countDistinct("b").alias("fan_out"))


_LEVELS = (("0,1,2,1,0", "0,3,2,1,4"), ("0,1,0", "0,1,2"), ("1,1", "1,0"), ("0,2,1,2", "0,3,2,1"), ("1,2,1", "2,1,0"))


@query("SELECT * FROM (VALUES " + ",".join(f"('{a}','{b}')" for a, b in _LEVELS) + ") t(levels, visual)")
def bidi_visual_order(spark, sf_dir):
    """Visual orders of sample runs by reversing stretches."""
    rows = [(a, ",".join(map(str, bidi.visual_order([int(x) for x in a.split(",")])))) for a, _ in _LEVELS]
    return spark.createDataFrame(rows, "levels string, visual string")


_PATHS = (("M0 0 L3 4", 2, 1, 5.0), ("M0,0h10v10h-10z", 5, 4, 40.0), ("m1 1 l0 2 l2 0", 3, 2, 4.0), ("M0 0 2 0 2 2", 3, 2, 4.0), ("", 0, 0, 0.0))


@query("SELECT * FROM (VALUES " + ",".join(f"({quoted(d)}, CAST({c} AS BIGINT), CAST({n} AS BIGINT), CAST({x} AS DOUBLE))" for d, c, n, x in _PATHS) + ") t(d, commands, segments, path_length)")
def path_lengths(spark, sf_dir):
    out = paths.measured(spark.createDataFrame([(p[0],) for p in _PATHS], "d string"), "d")
    return out.select("d", F.col("commands").cast("bigint").alias("commands"), F.col("segments").cast("bigint").alias("segments"), "path_length")
