import zlib

import numpy as np

from runeflow.llm import quality, queries


def test_linear_time_score_is_the_sum_over_pairs():
    rnd = np.random.default_rng(1)
    m = quality.FactorisationMachine(0.3, rnd.normal(size=quality.FEATURES), rnd.normal(size=(quality.FEATURES, 4)))
    ids, x = np.array([3, 9, 3, 40]), np.array([0.5, 2.0, 1.0, -1.0])
    want = m.bias + sum(m.linear[i] * a for i, a in zip(ids, x, strict=True))
    want += sum(m.factors[ids[i]] @ m.factors[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert abs(m.margin(ids, x) - want) < 1e-9


def test_held_out_accuracy_and_whole_table(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op5_quality(spark, d).collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    right = np.mean([rows[r.doc_id].predicted == r.quality for r in labels])
    good = np.mean([rows[r.doc_id].predicted for r in labels if r.quality == 1])
    print("held-out accuracy", right, "clean kept", good)
    assert right > 0.95 and good > 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (2, "x", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    out = quality.score_quality(docs, model)
    assert [r.score for r in out.collect()] == [0.5] * 3
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    odd = spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 1)], "doc_id long, quality int")
    assert quality.train(docs, odd).bias != 0
    assert quality.score_quality(docs.limit(0), model).count() == 0
