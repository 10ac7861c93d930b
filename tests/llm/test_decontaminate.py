import random
import re

import numpy as np

from runeflow.llm import decontaminate as d
from runeflow.llm import queries


def words_of(text):
    return re.findall(r"\w+", text.lower())


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = [[rnd.choice("abcd") for _ in range(rnd.randrange(1, 30))] for _ in range(2)]
        assert d.common_subsequence(a, b) == plain_lcs(a, b)


def brute(docs, items):
    out = set()
    for i, t in docs:
        w = words_of(t or "")
        have = set(w)
        for k, q in items:
            x = words_of(q)
            if len(have & set(x)) >= 0.5 * len(set(x)):
                n = len(x)
                best = max(plain_lcs(x, w[s : s + 2 * n]) for s in range(0, max(1, len(w) - n), max(1, n // 2)))
                if best >= 0.8 * n:
                    out.add((i, k))
    return out


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontaminate(spark, sf).collect()}
    read = lambda n, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(*c).collect()]
    want = brute(read("documents", ("doc_id", "text")), read("benchmark", ("item_id", "text")))
    assert want and got == want


def test_reworded_passages_are_found_and_clean_ones_left(spark):
    sf = "/root/testdata/sf0.01"
    rnd = random.Random(7)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    clean = [r.text for r in docs.where("doc_id % 7 = 3").limit(60).collect()]
    rows, want = [], set()
    for k, (item, text) in enumerate(items):
        w = text.split()
        w = [x if rnd.random() > 0.15 else rnd.choice(["moreover", "indeed", ""]) for x in w]
        host = clean[k % len(clean)].split()
        at = rnd.randrange(len(host) + 1)
        rows.append((100_000 + k, " ".join([*host[:at], *w, *host[at:]])))
        want.add((100_000 + k, item))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    space = d.fit(docs.union(planted))
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(planted, spark.read.parquet(f"{sf}/benchmark.parquet"), space=space).collect()}
    print(len(got & want), len(want))
    assert len(got & want) >= 0.95 * len(want)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "one two three four five six", 3), (3, "one two three four five six", 3), (None, "x", 4)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, "one two three four five six"), (8, None), (9, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.find_leaks(docs, items).collect()] == [(3, 7), (3, 7)]
    assert d.find_leaks(docs.limit(0), items).count() == 0
    assert d.find_leaks(docs, items.limit(0)).count() == 0
    assert np.isfinite(d.fit(docs).rows).all()


def test_no_passage_is_lost_for_its_place_in_the_space(spark):
    """Verbatim passages of few words, and longer ones, in hosts of any language; the space may tell nothing."""
    sf = "/root/testdata/sf0.01"
    rnd = random.Random(5)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    hosts = [words_of(r.text) for r in docs.where("length(text) > 200").limit(300).collect()]
    texts = [words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows, items, want = [], [], set()
    for k in range(240):
        w = texts[k % len(texts)]
        w = w[: (5, 8, 12, len(w))[k // 60]]
        host = hosts[k % len(hosts)][:1500]
        at = rnd.randrange(len(host) + 1)
        items.append((k, " ".join(w)))
        rows.append((k, " ".join([*host[:at], *w, *host[at:]])))
        want.add((k, k))
    planted, sought = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    nothing = d.Space(np.ones(1 << d.WORD_BITS, np.float32), np.zeros((1 << d.WORD_BITS, d.RANK), np.float32))
    for space in (d.fit(docs), nothing):
        got = {(r.doc_id, r.item_id) for r in d.find_leaks(planted, sought, space=space).collect()}
        assert want <= got, sorted(want - got)


def test_recall_of_rewordings_against_the_rule(spark):
    """Of rewordings that satisfy the rule of subsequence and answer, whatever their rare words, nine of ten are found."""
    sf = "/root/testdata/sf0.01"
    rnd = random.Random(11)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    hosts = [words_of(r.text) for r in docs.where("length(text) between 1500 and 20000").limit(150).collect()]
    fill = [w for h in hosts for w in h]
    items = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows, want = [], {}
    for rate in (0.15, 0.25, 0.35, 0.42):
        for k in range(120):
            item, x = items[k % len(items)]
            y = [w if rnd.random() > rate else rnd.choice(fill) for w in x]
            answer, share = set(x[-max(3, len(x) // 4) :]), plain_lcs(x, y) / len(x)
            if share >= 0.8 or (share >= 0.55 and len(answer & set(y)) >= 0.5 * len(answer)):
                host = hosts[len(rows) % len(hosts)]
                at = rnd.randrange(len(host) + 1)
                want.setdefault(rate, set()).add((len(rows), item))
                rows.append((len(rows), " ".join([*host[:at], *y, *host[at:]])))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(planted, spark.read.parquet(f"{sf}/benchmark.parquet"), space=d.fit(docs)).collect()}
    print({rate: (len(got & w), len(w)) for rate, w in want.items()})
    assert all(len(got & w) >= 0.9 * len(w) for w in want.values())


def test_clashing_names_and_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long + " one two three four five six", "x", 1.0)], "doc_id long, text string, words string, cosine double")
    items = spark.createDataFrame([(7, "one two three four five six", "y")], "item_id long, text string, doc_id string")
    got = d.find_leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.subsequence) for r in got] == [(1, 7, 1.0)]
