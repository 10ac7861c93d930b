"""SQL twins of the font queries: DuckDB reads the same files as hexadecimal text and takes their tables apart by itself."""

from __future__ import annotations

from runeflow.sources.fonts import DEJAVU


def _number(text: str) -> str:
    return f"CAST('0x' || {text} AS BIGINT)"


def _u16(column: str, at: str) -> str:
    """Two bytes at a byte offset of a column of hexadecimal text."""
    return _number(f"substr({column}, CAST(2 * ({at}) + 1 AS BIGINT), 4)")


def _u32(column: str, at: str) -> str:
    return _number(f"substr({column}, CAST(2 * ({at}) + 1 AS BIGINT), 8)")


def _text(column: str, at: str, n: int) -> str:
    return " || ".join(f"chr(CAST({_number(f'substr({column}, CAST(2 * ({at}) + {2 * k + 1} AS BIGINT), 2)')} AS INT))" for k in range(n))


#: tab: path, tag, off, len and the table's bytes as hexadecimal text.
TABLES = f"""b AS (SELECT 'file:' || filename AS path, hex(content) AS h FROM read_blob('{DEJAVU}/*.ttf')), d AS (SELECT path, h, unnest(range(0, {_u16('h', '4')})) AS k FROM b),
dir AS (SELECT path, {_text('h', '12 + 16 * k', 4)} AS tag, {_u32('h', '12 + 16 * k + 8')} AS off, {_u32('h', '12 + 16 * k + 12')} AS len, h FROM d), tab AS (SELECT path, tag, off, len, substr(h, 2 * off + 1, 2 * len) AS x FROM dir)"""

FONT_TABLES = f"""WITH {TABLES} SELECT path, CAST(0 AS BIGINT) AS face_ix, tag, off AS "offset", len AS length, CAST(list_sum(list_transform(regexp_extract_all(rpad(x, CAST(8 * ((len + 3) // 4) AS INT), '0'), '........'), lambda w: {_number('w')})) % 4294967296 AS BIGINT) AS checksum FROM tab"""

FONT_CMAP_SUBTABLES = f"""WITH {TABLES}, c AS (SELECT path, off, x, unnest(range(0, {_u16('x', '2')})) AS k FROM tab WHERE tag = 'cmap'), s AS (SELECT path, off, x, {_u16('x', '4 + 8 * k')} AS platform, {_u16('x', '4 + 8 * k + 2')} AS encoding, {_u32('x', '4 + 8 * k + 4')} AS place FROM c)
SELECT path, CAST(0 AS BIGINT) AS face_ix, platform, encoding, {_u16('x', 'place')} AS format, off + place AS "offset" FROM s"""

FONT_METRICS = f"""WITH {TABLES}, n AS (SELECT path, {_u16('x', '34')} AS n FROM tab WHERE tag = 'hhea'), g AS (SELECT path, {_u16('x', '4')} AS glyphs FROM tab WHERE tag = 'maxp'),
m AS (SELECT tab.path, n, glyphs, list_transform(regexp_extract_all(substr(x, 1, CAST(8 * n AS BIGINT)), '........'), lambda w: {_number('substr(w, 1, 4)')}) AS adv FROM tab JOIN n USING (path) JOIN g USING (path) WHERE tag = 'hmtx'),
e AS (SELECT path, adv, n, unnest(range(0, glyphs)) AS gid FROM m)
SELECT path, CAST(0 AS BIGINT) AS face_ix, gid, adv[least(gid, n - 1) + 1] AS advance FROM e"""

# Characters by formats 12 and 4; the full Windows map goes first, then the short one, then Unicode's.
_CMAP = f"""{TABLES}, c AS (SELECT path, x, unnest(range(0, {_u16('x', '2')})) AS k FROM tab WHERE tag = 'cmap'), s AS (SELECT path, {_u16('x', '4 + 8 * k')} AS platform, {_u16('x', '4 + 8 * k + 2')} AS encoding, substr(x, CAST(2 * {_u32('x', '4 + 8 * k + 4')} + 1 AS BIGINT)) AS y FROM c),
s2 AS (SELECT path, platform, encoding, y, {_u16('y', '0')} AS format FROM s), r AS (SELECT path, y, format, CASE WHEN platform = 3 AND encoding = 10 THEN 0 WHEN platform = 3 AND encoding = 1 THEN 1 ELSE 2 END AS rank FROM s2 WHERE (platform = 3 AND encoding IN (1, 10)) OR platform = 0),
g12 AS (SELECT path, rank, unnest(regexp_extract_all(substr(y, 33, CAST(24 * {_u32('y', '12')} AS BIGINT)), '........................')) AS g FROM r WHERE format = 12),
p12 AS (SELECT path, rank, {_u32('g', '0')} AS a, {_u32('g', '4')} AS z, {_u32('g', '8')} AS first FROM g12), m12 AS (SELECT path, rank, unnest(range(a, z + 1)) AS cp, a, first FROM p12),
h4 AS (SELECT path, rank, y, {_u16('y', '6')} // 2 AS n FROM r WHERE format = 4), i4 AS (SELECT path, rank, y, n, unnest(range(0, n)) AS i FROM h4),
e4 AS (SELECT path, rank, y, n, i, {_u16('y', '14 + 2 * i')} AS z, {_u16('y', '16 + 2 * n + 2 * i')} AS a, {_u16('y', '16 + 4 * n + 2 * i')} AS delta, {_u16('y', '16 + 6 * n + 2 * i')} AS ro FROM i4),
v4 AS (SELECT path, rank, substr(y, CAST(2 * (16 + 6 * n + 2 * i + ro) + 1 AS BIGINT), CAST(CASE WHEN ro = 0 THEN 0 ELSE 4 * (z - a + 1) END AS BIGINT)) AS w, a, z, delta, ro FROM e4 WHERE z >= a),
m4 AS (SELECT path, rank, unnest(range(a, z + 1)) AS cp, a, delta, ro, w FROM v4), q4 AS (SELECT path, rank, cp, CASE WHEN ro = 0 THEN (cp + delta) % 65536 ELSE {_u16('w', 'cp - a')} END AS raw, ro, delta FROM m4 WHERE cp < 65535),
every AS (SELECT path, rank, cp, first + cp - a AS gid FROM m12 UNION ALL SELECT path, rank, cp, CASE WHEN ro = 0 OR raw = 0 THEN raw ELSE (raw + delta) % 65536 END FROM q4)"""
_CMAP = _CMAP.replace(_u16("w", "cp - a"), _number("substr(w, CAST(4 * (cp - a) + 1 AS BIGINT), 4)"))

FONT_CMAP = f"WITH {_CMAP} SELECT path, CAST(0 AS BIGINT) AS face_ix, cp, CAST(arg_min(gid, rank) AS BIGINT) AS gid FROM every WHERE gid <> 0 GROUP BY path, cp"

FONT_CMAP_HISTOGRAM = f"""WITH {_CMAP}, n AS (SELECT path, count(DISTINCT cp) AS n FROM every WHERE gid <> 0 GROUP BY path)
SELECT CAST(CASE WHEN n <= 100 THEN 0 WHEN n <= 500 THEN 1 WHEN n <= 1000 THEN 2 WHEN n <= 2000 THEN 3 WHEN n <= 3000 THEN 4 WHEN n <= 4000 THEN 5 WHEN n <= 5000 THEN 6 WHEN n <= 6000 THEN 7 ELSE 8 END AS BIGINT) AS bucket, count(*) AS n FROM n GROUP BY 1"""

# Lookups by type and flag, extensions by what they stand for.
_LOOKUPS = f"""{TABLES}, top AS (SELECT path, tag, x, {_u16('x', '8')} AS t FROM tab WHERE tag IN ('GSUB', 'GPOS')), i AS (SELECT path, tag, x, t, unnest(range(0, {_u16('x', 't')})) AS k FROM top), p AS (SELECT path, tag, x, k, t + {_u16('x', 't + 2 + 2 * k')} AS p FROM i),
q AS (SELECT path, tag, k, x, p, {_u16('x', 'p')} AS type, {_u16('x', 'p + 2')} AS flag, {_u16('x', 'p + 4')} AS n FROM p), look AS (SELECT path, tag, k, CASE WHEN n > 0 AND type = CASE tag WHEN 'GSUB' THEN 7 ELSE 9 END THEN {_u16('x', 'p + ' + _u16('x', 'p + 6') + ' + 2')} ELSE type END AS type, flag, n FROM q)"""

FONT_LOOKUP_CENSUS = f"""WITH {_LOOKUPS}, per AS (SELECT path, tag, type, count(*) AS lookups, CAST(sum(n) AS BIGINT) AS subtables FROM look GROUP BY 1, 2, 3)
SELECT tag AS table_tag, type, CAST(sum(lookups) AS BIGINT) AS lookups, CAST(sum(subtables) AS BIGINT) AS subtables, max(subtables) AS most, arg_min(path, (-subtables, path)) AS face FROM per GROUP BY 1, 2"""

FONT_FILTER_SUMMARY = f"""WITH {_LOOKUPS} SELECT tag AS table_tag, type, flag & 1 <> 0 AS right_to_left, flag & 2 <> 0 AS bases, flag & 4 <> 0 AS ligatures, flag & 8 <> 0 AS marks, flag & 16 <> 0 AS mark_set, flag >= 256 AS mark_class, count(*) AS lookups, count(DISTINCT path) AS faces FROM look GROUP BY ALL"""

FONT_NAMES = f"""WITH {TABLES}, c AS (SELECT path, x, {_u16('x', '4')} AS store, unnest(range(0, {_u16('x', '2')})) AS k FROM tab WHERE tag = 'name'),
r AS (SELECT path, {_u16('x', '6 + 12 * k')} AS platform, {_u16('x', '8 + 12 * k')} AS encoding, {_u16('x', '10 + 12 * k')} AS language, {_u16('x', '12 + 12 * k')} AS name_id, substr(x, CAST(2 * (store + {_u16('x', '16 + 12 * k')}) + 1 AS BIGINT), CAST(2 * {_u16('x', '14 + 12 * k')} AS BIGINT)) AS raw FROM c)
SELECT path, CAST(0 AS BIGINT) AS face_ix, platform, encoding, language, name_id, array_to_string(list_transform(regexp_extract_all(raw, CASE WHEN platform IN (0, 3) THEN '....' ELSE '..' END), lambda w: chr(CAST({_number('w')} AS INT))), '') AS text FROM r"""

# Scripts, languages and features of both layout tables.
_SYSTEMS = f"""{TABLES}, top AS (SELECT path, tag, x, {_u16('x', '4')} AS s, {_u16('x', '6')} AS f FROM tab WHERE tag IN ('GSUB', 'GPOS')), sc AS (SELECT path, tag, x, s, f, unnest(range(0, {_u16('x', 's')})) AS k FROM top),
script AS (SELECT path, tag, x, f, {_text('x', 's + 2 + 6 * k', 4)} AS script, s + {_u16('x', 's + 6 + 6 * k')} AS p FROM sc), lang AS (SELECT path, tag, x, f, script, 'dflt' AS language, p + {_u16('x', 'p')} AS q FROM script WHERE {_u16('x', 'p')} > 0
UNION ALL SELECT path, tag, x, f, script, {_text('x', 'p + 4 + 6 * j', 4)} AS language, p + {_u16('x', 'p + 8 + 6 * j')} AS q FROM (SELECT *, unnest(range(0, {_u16('x', 'p + 2')})) AS j FROM script)),
uses AS (SELECT path, tag, x, f, script, language, 1 AS required, {_u16('x', 'q + 2')} AS ix FROM lang WHERE {_u16('x', 'q + 2')} <> 65535 UNION ALL SELECT path, tag, x, f, script, language, 0 AS required, {_u16('x', 'q + 6 + 2 * i')} AS ix FROM (SELECT *, unnest(range(0, {_u16('x', 'q + 4')})) AS i FROM lang))"""

FONT_FEATURES = f"""WITH {_SYSTEMS}, named AS (SELECT path, tag, script, language, required, x, {_text('x', 'f + 2 + 6 * ix', 4)} AS feature, f + {_u16('x', 'f + 6 + 6 * ix')} AS p FROM uses)
SELECT path, CAST(0 AS BIGINT) AS face_ix, tag AS table_tag, script, language, CAST(required AS BIGINT) AS required, feature, array_to_string(list_transform(range(0, {_u16('x', 'p + 2')}), lambda i: {_u16('x', 'p + 4 + 2 * i')}), ',') AS lookups FROM named"""

# Glyph classes of both formats, and the mark classes beside them.


def _class_table(name: str, at: str) -> str:
    return f"""{name}0 AS (SELECT path, substr(x, CAST(2 * {_u16('x', at)} + 1 AS BIGINT)) AS y FROM tab WHERE tag = 'GDEF' AND {_u16('x', at)} > 0),
{name}1 AS (SELECT path, {_u16('y', '2')} + k AS gid, {_u16('y', '6 + 2 * k')} AS class FROM (SELECT path, y, unnest(range(0, {_u16('y', '4')})) AS k FROM {name}0 WHERE {_u16('y', '0')} = 1)),
{name}2 AS (SELECT path, unnest(range(a, z + 1)) AS gid, class FROM (SELECT path, {_u16('y', '4 + 6 * k')} AS a, {_u16('y', '6 + 6 * k')} AS z, {_u16('y', '8 + 6 * k')} AS class FROM (SELECT path, y, unnest(range(0, {_u16('y', '2')})) AS k FROM {name}0 WHERE {_u16('y', '0')} = 2))),
{name} AS (SELECT * FROM {name}1 WHERE class > 0 UNION ALL SELECT * FROM {name}2 WHERE class > 0)"""


FONT_GLYPH_CLASSES = f"WITH {TABLES}, {_class_table('glyph', '4')}, {_class_table('mark', '10')} SELECT path, CAST(0 AS BIGINT) AS face_ix, gid, glyph.class AS class, coalesce(mark.class, 0) AS mark_class FROM glyph LEFT JOIN mark USING (path, gid)"

CMAP_LOOKUPS = f"""WITH {_CMAP}, m AS (SELECT path, cp, arg_min(gid, rank) AS gid FROM every WHERE gid <> 0 GROUP BY path, cp) SELECT path, CAST(cp // 65536 AS BIGINT) AS plane, count(*) AS hits, count(DISTINCT gid) AS glyphs, max(cp) AS highest, 65536 - count(*) AS misses FROM m GROUP BY 1, 2"""
