import os
import shutil
import subprocess

import pytest

from runeflow.operators import shaping
from runeflow.plans import font_queries, text_queries
from runeflow.sources import fonts

pytestmark = pytest.mark.skipif(not os.path.isdir(fonts.DEJAVU), reason="no fonts here")


def test_all_lines_of_a_document_are_shaped(spark, tmp_path):
    rows = [(1, "AV"), (2, "To fi"), (3, "AV\nTo fi\r\n\nAV\n"), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in font_queries.shape_documents(spark, str(tmp_path)).collect()}
    av, to = got[1], got[2]
    assert (got[3].n_glyphs, got[3].width) == (2 * av.n_glyphs + to.n_glyphs, 2 * av.width + to.width)
    assert got[3].line_widths == [av.width, to.width, 0, av.width]
    assert (got[4].n_glyphs, got[4].width, got[5].width) == (0, 0, None)


def test_scripts_outside_the_first_plane_are_there(spark):
    c = {r.script: r for r in font_queries.font_script_coverage(spark, "").where("path LIKE '%/DejaVuSans.ttf'").collect()}
    assert (c["Old_Italic"].covered, c["Old_Italic"].total) == (35, 39)
    assert any(r.script == "Old_Italic" for r in font_queries.font_script_top3(spark, "").collect())
    assert text_queries.ucd_properties(spark, "").count() == 0x110000


def _second_reader(path):
    """What the system's own font library says of a file."""
    form = "%{family[0]}|%{style[0]}|%{fullname[0]}|%{postscriptname}|%{slant}|%{weight}|%{charset}"
    return subprocess.run(["fc-query", "-f", form, path], capture_output=True, text=True, check=True).stdout.split("|")


@pytest.mark.skipif(shutil.which("fc-query") is None, reason="no second reader here")
def test_faces_and_characters_against_a_second_reader(spark):
    faces = {r.path: r for r in font_queries.font_faces(spark, "").collect()}
    maps = {}
    for r in font_queries.font_cmap(spark, "").collect():
        maps.setdefault(r.path, set()).add(r.cp)
    assert len(faces) == 22
    for path, r in faces.items():
        family, style, full, postscript, slant, _, charset = _second_reader(path.removeprefix("file:"))
        assert r.family.startswith(family) and (r.full_name, r.postscript) == (full, postscript)
        assert {"0": "roman", "100": "italic", "110": "oblique"}[slant] == r.slant, path
        assert r.bold == ("Bold" in style), path
        want = set()
        for part in charset.split():
            a, _, b = part.partition("-")
            want |= set(range(int(a, 16), int(b or a, 16) + 1))
        assert {c for c in maps[path] if c >= 32} == {c for c in want if c >= 32}, path


def test_rules_as_tables_are_the_rules_that_are_applied(spark):
    """Each face's rules with context, as a table, against the sets that the shaper matches with."""
    files = fonts.font_files(spark, fonts.DEJAVU)
    rows = {}
    for r in fonts.context_rules(files).collect():
        rows.setdefault((r.path, r.table_tag, r.lookup), []).append((len(r.back), 1 + len(r.input), len(r.ahead), sorted(r.first), list(zip(r.places, r.lookups, strict=True))))
    data = {r.path: bytes(r.content) for r in files.collect()}
    seen = 0
    for path, content in data.items():
        shaper = shaping.Shaper(fonts.Face(content, 0))
        for tag in ("GSUB", "GPOS"):
            for k, (_, kind, _, _, subs) in shaper.tables[tag].items():
                if (tag, kind) in shaping.CONTEXTS:
                    want = [(len(b), len(i), len(a), sorted(i[0]), acts) for s in subs for b, i, a, acts in shaper._rules(s, shaping.CONTEXTS[tag, kind])]
                    assert sorted(rows.get((path, tag, k), [])) == sorted(want), (path, tag, k)
                    seen += len(want)
    assert seen > 100


def test_workloads_do_what_their_rules_say(spark):
    rows = font_queries.workload_runs(spark, "").collect()
    assert {r.family for r in rows} >= {"single", "alternate", "ligature_components", "ligature_fan_out"}
    for r in rows:
        if r.expected_length is not None and r.family.startswith(("multiple", "ligature", "single", "explicit")):
            assert r.n_output == 16 * r.expected_length, r


def test_records_extremes_and_histograms_agree(spark):
    records = font_queries.font_face_records(spark, "").collect()
    top = {r.metric: (r.value, r.path) for r in font_queries.font_extremes(spark, "").collect()}
    assert len(records) == 22
    for metric in font_queries.METRICS:
        assert metric not in top or max(r[metric] for r in records) == top[metric][0]
    counts = {}
    for r in font_queries.font_metric_histograms(spark, "").collect():
        counts[r.metric] = counts.get(r.metric, 0) + r.n
    assert all(counts[m] == sum(1 for r in records if r[m] or m in ("lookups",)) or counts[m] <= 22 for m in counts)
    bits = font_queries.font_filter_summary(spark, "").collect()
    assert sum(r.lookups for r in bits) == sum(r.lookups for r in records)


def test_words_and_whole_lines_give_the_same_glyphs(spark):
    data = open(f"{fonts.DEJAVU}/DejaVuSans.ttf", "rb").read()
    line = shaping.LineShaper(fonts.Face(data, 0), "latn", (), True)
    assert line.by_words
    for t in ("fi  AV To", " ffi ", "a ́b x", "", "ﬁ é", "Te. VA, (fj)"):
        whole = line._whole(t)
        assert (line.glyphs(t) == whole).all()
        assert line.measure(t) == (len(whole), int(whole[:, 3].sum()))
    assert not line.shaper.uses("GSUB", -1, 3)


def test_ligatures_kerning_and_emoji(spark):
    ligs = {(r.path.rpartition("/")[2], r.word) for r in font_queries.ligature_fonts(spark, "").collect()}
    assert {("DejaVuSans.ttf", w) for w in ("fi", "fl", "ffi")} <= ligs
    probe = {r.word: r.ligature for r in font_queries.ligature_probe(spark, "").collect()}
    assert probe["fi"] and probe["ffi"] and not probe["ab"]
    kern = {(r.path.rpartition("/")[2], r.pair): r.advance for r in font_queries.kerning_fonts(spark, "").collect()}
    deltas = {r.word: r.delta for r in font_queries.kerning_probe(spark, "").collect()}
    assert deltas["AV"] < 0 and deltas["nn"] == 0
    assert kern.get(("DejaVuSans.ttf", "AV"), deltas["AV"]) == deltas["AV"]
    assert any(r.covered > 0 and r.covered <= r.total for r in font_queries.emoji_fonts(spark, "").collect())


def test_a_font_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(shaping, "FONT_BYTES", 10)
    with pytest.raises(ValueError):
        font_queries.ligature_probe(spark, "").collect()
