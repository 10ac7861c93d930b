import random
import re

import numpy as np
import pytest

from runeflow.llm import jaccard, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def varied(seed, n, length=60, vocab=400):
    rnd = random.Random(seed)
    base = [" ".join(f"w{rnd.randrange(vocab)}" for _ in range(rnd.randrange(1, length))) for _ in range(n // 4)]
    passage = " ".join(f"p{i}" for i in range(25))
    rows = []
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = f"W{rnd.randrange(vocab)}"
        t = " ".join(w)
        if rnd.random() < 0.3:
            t += "\n" + passage
        rows.append((i * 3 + 1, t))
    return [*rows, (2, None), (5, ""), (8, " \t"), (11, "a b"), (14, "A  b"), (17, "x y z w v"), (20, "é É ſ")]


def groups(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, **more).collect()}


def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_jaccard_join(spark, d).collect()}
    assert got == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])


@pytest.mark.parametrize("block", [jaccard.BLOCK, 6])
def test_random_texts_and_large_blocks(spark, block):
    rows = varied(3, 300)
    assert groups(spark, rows, block=block) == brute(rows)


def test_tree_finds_all_components():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 40)).astype(np.uint64)) for _ in range(40)]
        sets += [np.unique(np.concatenate([s[rnd.random(len(s)) < 0.93], rnd.integers(0, 60, 1).astype(np.uint64)])) for s in sets]
        want = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard.similar(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])))}

        def comps(pairs):
            root = list(range(len(sets)))

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in pairs:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            return [find(x) for x in range(len(sets))]

        assert comps(jaccard.tree_links(sets)) == comps(want)


def test_reach_bounds_every_partner_size():
    for n in range(1, 400):
        worst = max(jaccard.head(m) + n - -(-(n + m) * 4 // 9) for m in range(-(-n * 4 // 5), n * 5 // 4 + 1))
        assert jaccard.reach(n) >= min(n, worst), n


def test_edges(spark):
    df = spark.createDataFrame([(4, "a b c d e f", 1), (4, "a b c d e f", 1), (9, "A b c d e f", 2), (None, "a b c d e f", 3)], "doc_id long, text string, component_id int")
    got = jaccard.jaccard_groups(df)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == sorted([(4, 2, 4), (4, 2, 4), (9, 2, 4), (None, 2, None)], key=str)
    assert sorted(r.doc_id or 0 for r in got.where("kept").collect()) == [0, 4]
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


def test_an_id_on_several_texts_keeps_the_links_of_each(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (5, a + " x"), (6, b + " y"), (7, "c d"), (7, "e f"), (0, None), (0, None)]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "component_id").collect())) == [(0, 0), (0, 0), (1, 1), (1, 1), (5, 1), (6, 1), (7, 7), (7, 7)]
    assert sorted(r.doc_id for r in got.where("kept").collect()) == [0, 0, 1, 1, 7, 7]


def test_members_of_many_sets_come_back_from_the_chunk_itself(spark, monkeypatch):
    """With small chunks and a low bound for hot members all ways of an answer are taken."""
    rows = varied(9, 300, vocab=60)
    for name, value in (("HOT", 2), ("CHUNK", 900), ("BUCKET", 200)):
        monkeypatch.setattr(jaccard, name, value)
    assert groups(spark, rows) == brute(rows)


def test_a_subtree_is_left_where_what_remains_cannot_reach_the_overlap(monkeypatch):
    """Sets without a partner are told apart before their leaves: far fewer postings are read than all paths hold."""
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 4000, 400).astype(np.uint64)) for _ in range(80)]
    read = []
    monkeypatch.setattr(jaccard, "POSTINGS", 50)
    count = np.bincount
    monkeypatch.setattr(jaccard.np, "bincount", lambda x, **k: read.append(len(x)) or count(x, **k))
    assert jaccard.tree_links(sets) == []
    every = np.unique(np.concatenate(sets), return_counts=True)[1]
    assert sum(read) < 0.5 * (every[every > 1] ** 2).sum()


def test_very_long_text(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:140_000])), (3, " ".join(long[:90_000]))]
    got = groups(spark, rows)
    assert got[1][1] == got[2][1] == 1 and got[3] == (89_996, 3)
