import importlib.util
import pathlib

import pytest

spec = importlib.util.find_spec("corpus_pipeline")
pytestmark = pytest.mark.skipif(spec is None, reason="no pipeline here")


def test_each_stage_against_brute_force(spark, tmp_path):
    import base64

    import corpus_pipeline as p
    import public_tokenizers as tok
    import tiktoken

    from tests.llm.test_decontaminate import brute as leaks
    from tests.llm.test_jaccard import brute as groups
    from tests.llm.test_pii import brute as spans

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in p.STAGES:
        stage(spark, docs, d).write.parquet(str(pathlib.Path(tmp_path) / name))
        before, docs = docs, spark.read.parquet(str(pathlib.Path(tmp_path) / name))
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}
        kept[name] = len(new)
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in new for i in good) >= 0.98 * len(good)
            assert sum(i in new for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())
        elif name == "near_duplicates":
            assert set(new) == {i for i, (_, c) in groups([(i, r.text) for i, r in old.items()]).items() if i == c}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            assert set(old) - set(new) == {i for i, _ in leaks([(i, r.text) for i, r in old.items()], items)}
        elif name == "personal_data":
            assert set(new) == set(old)
            for i, r in old.items():
                assert (new[i].text == r.text) == (not spans(r.text))
                assert new[i].n_chars == len(new[i].text) and not spans(new[i].text)
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tok.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
            library = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert set(new) == set(old)
            for i, r in old.items():
                assert list(new[i].token_ids) == library.encode_ordinary(r.text) and new[i].decoded_ok
    print(kept)


KIND = "doc_id long, text string, lang string, source string, n_chars long"
A, B = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))


def test_repeated_rows_and_nulls_pass_through(spark):
    import corpus_pipeline as p

    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", None, None, None), (3, None, None, None, None), (None, "x y", None, None, None)]
    df = spark.createDataFrame(rows, KIND)
    assert sorted((str(r.doc_id) for r in p.drop_near_duplicates(spark, df, "").collect())) == ["1", "3", "None"]
    assert p.redact(spark, df, "").count() == 5
    assert p.encode(spark, df, "").count() == 5


def test_each_text_of_an_id_counts_by_itself(spark):
    import corpus_pipeline as p

    df = spark.createDataFrame([(1, A), (1, B), (1, A), (5, A + " x"), (6, B + " y"), (6, "c d"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id, (r.text or "")[:2]) for r in p.drop_near_duplicates(spark, df, "").collect())
    assert got == [(1, "a0"), (1, "b0"), (6, "c "), (7, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, A), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_on_nulls_empty_tables_and_clashing_names(spark, folder):
    import corpus_pipeline as p

    rows = [(1, "fine words here", 0.5), (2, None, None), (None, "", None), (None, "x " + A, None), (4, "y " + A + " z", None), (None, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for name in ("predicted", "found", "sig", "kept", "spans", "cls", "component", "token_ids", "decoded", "n", "row", "words", "item_id", "bucket"):
        df = df.selectExpr("*", f"'mine' AS `{name}`")
    for name, stage in p.STAGES:
        out = stage(spark, df, folder)
        if name != "byte_bpe":
            assert out.columns == df.columns
            assert {r.found for r in out.collect()} <= {"mine"}
        assert stage(spark, df.limit(0), folder).count() == 0
    assert sorted((r.text or "") for r in p.drop_leaks(spark, df, folder).collect()) == ["", "", "fine words here", "x y"]
