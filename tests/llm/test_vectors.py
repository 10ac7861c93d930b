import numpy as np
import pytest

from runeflow.llm import queries, vectors


def brute(rows, cosine=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    links = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    seen, out = [None] * n, []
    for i in range(n):
        if seen[i] is None:
            todo, group = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            least = min(rows[k][0] for k in group)
            for k in group:
                seen[k] = least
    for i, (v, _) in enumerate(rows):
        out.append((v, len(links[i]), seen[i], v == seen[i]))
    return sorted(out)


def run(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.vector_groups(df).collect())


@pytest.mark.parametrize("tiles", [(32, 6), (3, 50), (1, 1)])
def test_random_vectors(spark, monkeypatch, tiles):
    monkeypatch.setattr(vectors, "MOST_TILE", tiles[0])
    monkeypatch.setattr(vectors, "LEAST_TILES", tiles[1])
    monkeypatch.setattr(vectors, "INTERVAL", 16)
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(40, 6))
    rows = [(int(i) * 2 + 1, (base[rnd.integers(40)] + rnd.normal(0, 0.18, 6)).astype(np.float32).tolist()) for i in range(220)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1004, [float("nan")] * 6), (1005, rows[3][1]), (1006, rows[3][1]), (1007, [1.0, 2.0]), (1008, [2.0, 4.0])]
    assert run(spark, rows) == brute(rows)


def test_parts_are_split_without_loss():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(900, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(np.floor(x / 0.32).T[::-1])]
    got = {(int(i), int(j)) for a, b in vectors.join_parts(x, x, x, x, 0.95, 0.3163, True) for i, j in zip(a, b, strict=True)}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))


def test_query_on_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op7_vector_join(spark, d).collect()) == brute(rows)


def test_edges(spark):
    assert run(spark, [], "double") == []
    assert run(spark, [(1, None)], "double") == [(1, 0, 1, True)]
    df = spark.createDataFrame([(1, [1e200, 1e200], 5), (2, [1e-200, 1e-200], 6), (1, [1e200, 1e200], 7)], "vec_id long, embedding array<double>, kept int")
    assert sorted(map(tuple, vectors.vector_groups(df).collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
