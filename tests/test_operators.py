import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from runeflow.functions import paths
from runeflow.functions import scalar as s
from runeflow.functions import unicode as u
from runeflow.operators import bidi, recognition, sets, text
from runeflow.sources import fonts, tables


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_clusters_against_another_library(spark):
    rnd = random.Random(3)
    probes = "a\r\n\tे‍क्ष़🙂👨👩🇫🇷éᄀ각가ᅡᆨः؀"
    texts = ["".join(rnd.choice(probes) for _ in range(rnd.randrange(12))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r["y"] for r in df.select(u.cluster_lengths(spark, F.col("x")).alias("y")).collect()]
    assert got == [[len(c) for c in regex.findall(r"\X", t)] for t in texts]


def test_normal_forms(spark):
    for t in ("é", "ﾞが", "각", "á̖b", "", "Å"):
        assert one(spark, t, u.nfc(F.col("x"))) == unicodedata.normalize("NFC", t)
        assert one(spark, t, u.nfd(F.col("x"))) == unicodedata.normalize("NFD", t)


def test_hashes_and_bits(spark):
    assert one(spark, "foobar", s.fnv1a_32(F.col("x"))) == 0xBF9CF968
    assert one(spark, "foobar", s.fnv1a_64(F.col("x"))) == "85944171f73967e8"
    assert one(spark, 1, s.fmix32(F.col("x")), "long") == 0x514E28B7
    assert [one(spark, n, s.next_power_of_two(F.col("x")), "long") for n in (0, 1, 2, 3, 17, 1024)] == [1, 1, 2, 4, 32, 1024]
    assert one(spark, 0x12345678, s.swap32(F.col("x")), "long") == 0x78563412
    assert one(spark, 0x80000001, s.rotate_right32(F.col("x"), 1), "long") == 0xC0000000
    assert one(spark, '"a b"', s.trim_quotes(F.col("x"))) == "a b"
    assert one(spark, "1.5e2, -3 .25", s.number_list(F.col("x"))) == [150.0, -3.0, 0.25]
    assert one(spark, "0x1F", s.parse_hex(F.col("x"))) == 31
    assert one(spark, "k:v;w:z", s.parameters(F.col("x"))) == {"k": "v", "w": "z"}
    assert one(spark, "12abc", s.integer_prefix(F.col("x"))) == 12
    assert one(spark, "abc", s.integer_prefix(F.col("x"))) is None


def test_bidi_rules():
    assert bidi.levels_of("car (CAR) 12".replace("CAR", "אבג"))[1] == [0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 2, 2]
    assert bidi.levels_of("אב 12 cd") == (1, [1, 1, 1, 2, 2, 1, 2, 2])
    assert bidi.levels_of("a‮bc‬d")[1][2:4] == [1, 1]
    assert bidi.levels_of("(א", "ltr")[1] == [0, 1]
    deep = "‫" * 200 + "a"
    assert max(bidi.levels_of(deep)[1]) <= bidi.DEEPEST + 1
    assert bidi.visual_order([0, 1, 2, 1, 0]) == [0, 3, 2, 1, 4]
    assert bidi.visual_order([]) == []
    rnd = random.Random(1)
    for _ in range(500):
        t = "".join(rnd.choice("aא1+,( )[]ا٣‫‭‬⁦⁧⁨⁩́") for _ in range(rnd.randrange(20)))
        base, levels = bidi.levels_of(t)
        assert len(levels) == len(t) and all(0 <= x <= 127 for x in levels)


def test_scripts_resolve_by_immediate_neighbours_only(spark):
    rows = [("a", 0, "Latin"), ("a", 1, "Common"), ("a", 2, "Latin"), ("b", 0, "Latin"), ("b", 1, "Common"), ("b", 2, "Common"), ("b", 3, "Latin"), ("c", 0, "Common"), ("c", 1, "Greek"), ("c", 2, "Common")]
    df = spark.createDataFrame(rows, "id string, ix int, script string").withColumn("candidates", F.array("script"))
    got = {(r.id, r.ix): r.resolved for r in text.resolve_scripts(df).collect()}
    assert got["a", 1] == "Latin" and got["b", 1] == "Common" and got["b", 2] == "Common"
    runs = {(r.id, r.first): (r.script, r["count"]) for r in text.script_runs(text.resolve_scripts(df)).collect()}
    assert runs == {("a", 0): ("Latin", 3), ("b", 0): ("Latin", 4), ("c", 0): ("Greek", 3)}


def test_candidates_survive_an_empty_intersection(spark):
    got = one(spark, [["A", "B"], ["B", "C"], ["D"]], text.fold_scripts(F.col("x")), "array<array<string>>")
    assert got == ["B"]


def test_fallback_restarts_at_each_cluster(spark):
    clusters = spark.createDataFrame([(1, 0, [97]), (1, 1, [98]), (1, 2, [97]), (1, 3, [99])], "id int, ix int, cps array<int>")
    cmap = spark.createDataFrame([("f0", 0, 97), ("f1", 1, 97), ("f1", 1, 98)], "face string, priority int, cp int")
    got = [(r.face, r.complete, r["count"]) for r in text.font_runs(clusters, cmap).orderBy("run").collect()]
    assert got == [("f0", True, 1), ("f1", True, 1), ("f0", True, 1), ("f0", False, 1)]


def test_set_algebra(spark):
    a = sets.members(spark.createDataFrame([("x", 1, 4), ("x", 3, 6), ("y", 9, 9)], "set_id string, first int, last int"))
    assert sorted(map(tuple, sets.ranges_of(a).collect())) == [("x", 1, 6), ("y", 9, 9)]
    assert {r.set_id: r.n for r in sets.bitmap_counts(a, "set_id").collect()} == {"x": 6, "y": 1}
    need = spark.createDataFrame([("p", 2), ("p", 5), ("q", 9), ("q", 1)], "need string, cp int")
    assert [tuple(r) for r in sets.contains_all(a, need, "set_id", "need").collect()] == [("x", "p")]
    assert sets.equal(a, a) and not sets.equal(a, a.where("cp > 1"))


def test_ucd_lines(spark):
    lines = spark.createDataFrame([("# @missing: 0000..10FFFF; Left_To_Right",), ("0590..05FF ; R # x",), ("05FE ; AL",), ("",)], "value string")
    assert [tuple(r)[:3] for r in tables.ucd_missing(lines).collect()] == [(0, 0x10FFFF, "Left_To_Right")]
    found = tables.ucd_ranges(lines)
    assert sorted((r["first"], r["last"], r["values"][0]) for r in found.collect()) == [(0x590, 0x5FF, "R"), (0x5FE, 0x5FE, "AL")]
    assert tables.ucd_overlaps(found).count() == 1


def test_grammar_builders(spark):
    g = recognition.Grammar().unit("Pair", recognition.seq(recognition.role("left", "a+"), recognition.opt("x"), recognition.role("right", "b")))
    assert one(spark, "zaaxbab", g.recognise(F.col("x"))) == ["aaxb", "ab"]
    assert one(spark, "aaxb", g.role_text(F.col("x"), "Pair", "left")) == "aa"
    assert one(spark, "ab", g.unit_of(F.col("x"))) == "Pair"
    with pytest.raises(ValueError):
        recognition.many("a*")
    c = recognition.Classifier(((recognition.has("general_category", "Decimal_Number"), "d"), (recognition.both(recognition.span(65, 90), recognition.negated(recognition.cp(66))), "u")))
    assert one(spark, "A1B٣", c.kinds(F.col("x"))) == "udod"


def test_paths():
    p = paths.normalise(paths.parse("m1 1 2 0 t2 2 a1 1 0 01.5.5z"))
    assert [c[0] for c in p] == ["M", "L", "Q", "A", "Z"]
    circle = paths.flatten(paths.normalise(paths.parse("M1 0A1 1 0 0 1 -1 0A1 1 0 0 1 1 0")), 0.0005)
    assert abs(paths.length(circle) - 6.2832) < 0.01
    assert [len(x) for x in paths.dash([[(0.0, 0.0), (10.0, 0.0)]], [2, 1])] == [2, 2, 2, 2]
    assert paths.parse("garbage") == []


def test_damaged_fonts_give_no_rows(spark):
    files = spark.createDataFrame([("a", bytearray(b"\0\1\0\0" + b"\xff" * 40)), ("b", bytearray(b"x")), ("c", None)], "path string, content binary")
    assert fonts.cmap(files).count() == 0
    assert fonts.checksum(b"\0\0\0\1\0\0\0\2\xff") == (3 + 0xFF000000) & 0xFFFFFFFF


def test_stream_is_the_batch(spark, tmp_path):
    from runeflow.streaming import texts

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = texts.document_stream(spark, str(tmp_path / "in"), docs.schema, 1)
    texts.run_once(texts.profile(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sets.equal(spark.read.parquet(str(tmp_path / "out")), texts.profile(docs))


def test_entry_runs_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "runeflow", tmp_path / "runeflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_store_is_sound(spark, tmp_path):
    from runeflow.sources import store

    folder = str(tmp_path / "store")
    store.write(spark, folder)
    assert {r.rule: r.n for r in store.violations(spark, folder).collect() if r.n} == {}
    greek = store.coverage(spark, folder, "script", "Greek").collect()
    assert any(r["first"] <= 0x3B1 <= r["last"] for r in greek)
    ext = {r.cp: r.scripts for r in spark.read.parquet(f"{folder}/script_extensions").collect()}
    assert "Devanagari" in ext[0x964] and len(ext[0x964]) > 5


def test_script_programs():
    from runeflow.operators import script_program as sp

    thai = "".join(chr(i.value) for i in sp.thai_program().scalars("น้ำ"))
    assert thai == "นํ้า"
    assert sp.move_selection(list("abcd"), [2], 0, True) == list("cabd")
    assert sp.move_selection(list("abcd"), [0, 1], 2, False) == list("cabd")
    assert sp.move_selection(list("abcd"), [], 2, False) == list("abcd")
    with pytest.raises(ValueError):
        sp.move_selection(list("abcd"), [1], 1, True)
    assert sp.merge_spans([(5, 7), (0, 2), (2, 4)]) == [(0, 4), (5, 7)]
    assert sp.half_candidates("chchc") == [(0, 2), (2, 4)] and sp.half_candidates("chJc") == []
    assert sp.base_of("chc") == 2 and sp.reph("rhc") == (0, 2) and sp.reph("rhJc") is None


@pytest.mark.skipif(not __import__("os").path.isdir(fonts.DEJAVU), reason="no fonts here")
def test_shaping_real_fonts(spark):
    from runeflow.operators import script_program as sp
    from runeflow.operators.shaping import Shaper

    with open(f"{fonts.DEJAVU}/DejaVuSans.ttf", "rb") as f:
        shaper = Shaper(fonts.Face(f.read(), 0))
    assert len(shaper.shape("ffi")) == 1 and len(shaper.shape("ffi", off=("liga",))) == 3
    plain = sum(g.advance for g in shaper.shape("AV", gpos=False))
    assert sum(g.advance for g in shaper.shape("AV")) < plain
    mark = shaper.shape("x́")[-1]
    assert (mark.x, mark.y) != (0, 0) or mark.parent < 0
    assert [g.offset for g in sp.thai_program().run(shaper, "ab")] == [0, 1]
    assert len(sp.devanagari_program("rhcm").run(shaper, "abcd")) == 4
    files = spark.createDataFrame([("f", bytearray(shaper.r.data))], "path string, content binary")
    rules = fonts.substitution_rules(files).where("type = 4").collect()
    ffi = [shaper.map[ord(c)] for c in "ffi"]
    assert any(r.input == ffi for r in rules)


def test_every_bracket_has_its_own_partner(spark):
    """The table against the library's, over all paired brackets."""
    rows = u.code_points(spark, 0, 0xFFFF).select("cp", u.paired_bracket(F.col("cp")).alias("p"), u.value("bracket_type", F.col("cp")).alias("k")).where("k = 'Open'").collect()
    assert {ord(a): ord(b) for a, b in zip(bidi._OPEN, bidi._CLOSE, strict=True)} == {r.cp: r.p for r in rows}
    assert len(rows) == 64


def test_bidi_classes_are_the_librarys(spark):
    rows = spark.createDataFrame([(c,) for c in range(0, 0x3000)], "cp int").select("cp", u.number("bidi_class", F.col("cp")).alias("k"), u.value("bidi_class", F.col("cp"), True).alias("v")).collect()
    assert all(bidi.CLASSES[r.k] == r.v for r in rows)


def test_composed_scalars_and_their_sources(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("aeq̣́̄ébạ각각Åͅ") for _ in range(rnd.randrange(1, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in text.nfc_offsets(df, "id", "t").orderBy("id", "ix").collect():
        got.setdefault(r.id, []).append((r.cp, r.begin, r.end))
    for k, t in enumerate(texts):
        assert "".join(chr(c) for c, *_ in got[k]) == unicodedata.normalize("NFC", t), t
        raw = t.encode()
        for _, a, b in got[k]:  # ranges fall on scalars, and together they take in the whole source
            assert 0 <= a < b <= len(raw)
            raw[a:b].decode()
        assert {x for _, a, b in got[k] for x in range(a, b)} == set(range(len(raw)))
    assert text.nfc_pieces("éx") == [(0xE9, 0, 3), (0x78, 3, 4)]
    assert text.nfc_pieces("ạ́") == [(0x1EA1, 0, 5), (0x301, 1, 3)]
    union = text.source_union(spark.createDataFrame([(1, 2, 4), (1, 7, 7), (1, 0, 1)], "k int, begin int, end int"), ["k"])
    assert [tuple(r) for r in union.collect()] == [(1, 0, 4)]


def test_ignorable_scalars_need_no_glyph(spark):
    clusters = spark.createDataFrame([(1, 0, [97, 0x200D]), (1, 1, [0x200B]), (1, 2, [0x200D, 98])], "id int, ix int, cps array<int>")
    cmap = spark.createDataFrame([("f0", 0, 97), ("f1", 1, 98)], "face string, priority int, cp int")
    got = [(r.face, r.complete, r["count"]) for r in text.font_runs(clusters, cmap).orderBy("run").collect()]
    assert got == [("f0", True, 2), ("f1", True, 1)]


def test_paragraph_faults(spark):
    rows = [(1, 0, 0, 2, 0), (1, 1, 2, 1, 1), (2, 0, 0, 1, 0), (2, 1, 2, 1, 0), (2, 2, 2, 1, 0), (3, 0, 0, 0, 0), (4, 0, 0, 1, 127)]
    df = spark.createDataFrame(rows, "id int, ix int, first int, count int, level int")
    assert sorted(map(tuple, text.paragraph_faults(df, level="level").collect())) == [(2, 1, "gap"), (2, 2, "overlap"), (3, 0, "empty cluster"), (4, 0, "level out of range")]


def test_wide_rotations_and_bits(spark):
    assert one(spark, 0x0123456789ABCDEF, F.hex(s.rotate_left64(F.col("x"), 8)), "long") == "23456789ABCDEF01"
    assert one(spark, 1, F.hex(s.rotate_right64(F.col("x"), 1)), "long") == "8000000000000000"
    assert one(spark, 0xFFFFFFF0, s.arithmetic_shift32(F.col("x"), 2), "long") == -4
    assert one(spark, bytearray(b"\x12\x34\x56"), s.bits_from_bytes(F.col("x"), 4, 12), "binary") == 0x341
    assert one(spark, "[a]b]", s.read_enclosed(F.col("x"), "[", "]")) == "a"
    assert one(spark, "a]", s.read_enclosed(F.col("x"), "[", "]")) is None
    assert one(spark, 'a"b,\\"c",d', s.read_until_unquoted(F.col("x"), ",")) == 'a"b,\\"c"'
    assert [one(spark, x, s.boolean(F.col("x"))) for x in ("YES", " 0 ", "maybe")] == [True, False, None]


def test_first_cluster_of_any_length(spark):
    long = "e" + "́" * 100
    assert one(spark, long + "x", u.first_cluster(spark, F.col("x"))) == long
    assert [one(spark, t, u.cluster_count(spark, F.col("x"))) for t in ("a\r\nb", "ab\r", "", "é🙂x", "é")] == [3, 3, 0, 3, 1]


def test_unicode_data_against_python(spark):
    """Lines written from Python's own tables come back as they were; what breaks the rules is told."""
    lines = []
    for c in [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00)]:
        ch = chr(c)
        if not unicodedata.name(ch, ""):
            continue
        lines.append((f"{c:04X};{unicodedata.name(ch)};{unicodedata.category(ch)};{unicodedata.combining(ch)};{unicodedata.bidirectional(ch)};{unicodedata.decomposition(ch)};;;;{'Y' if unicodedata.mirrored(ch) else 'N'};;;;;",))
    rows = {r["first"]: r for r in tables.unicode_data(spark.createDataFrame(lines, "value string")).collect()}
    assert len(rows) == len(lines)
    for c, r in rows.items():
        parts = unicodedata.decomposition(chr(c)).split()
        kind = parts.pop(0).strip("<>") if parts and parts[0].startswith("<") else None
        assert (r.name, r.category, r.combining_class, r.bidi_class) == (unicodedata.name(chr(c)), unicodedata.category(chr(c)), unicodedata.combining(chr(c)), unicodedata.bidirectional(chr(c)))
        assert (r.decomposition_kind, r.mapping) == (kind, [int(x, 16) for x in parts] or None)
    bad = spark.createDataFrame([("0041;A;lu;0;L;;;;;N;;;;;",), ("0042;B;Lu;999;L;;;;;N;;;;;",), ("0043;C;Lu;0;L;0041 0042 0043;;;;N;;;;;",), ("0044;D;Lu;0;L;;;;;N;;;;;",)], "value string")
    assert sorted(map(tuple, tables.unicode_data_faults(tables.unicode_data(bad)).collect())) == [(0x41, "category"), (0x42, "combining class"), (0x43, "canonical decomposition longer than two")]


def test_values_by_any_of_their_names(spark):
    aliases = tables.value_aliases(spark.createDataFrame([("sc ; Zinh ; Inherited ; Qaai",), ("sc ; Latn ; Latin",)], "value string"))
    found = tables.ucd_ranges(spark.createDataFrame([("0041..005A ; Latn",), ("0300 ; Qaai",), ("0301 ; Odd",)], "value string"))
    assert {r["first"]: r.value for r in tables.decoded(found, aliases, "sc").collect()} == {0x41: "Latin", 0x300: "Inherited", 0x301: None}
