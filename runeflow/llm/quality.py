"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata of the text.

Every pair of features interacts through low-rank vectors, and the sum over all pairs is taken in linear time as half of
the squared sum less the sum of squares. Labels come from a bounded sample of the labelled rows outside the held-out fold;
language, source and id are no inputs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

WORD_BITS = 14
BINS = 12
RANK = 8
THRESHOLD = 0.7
#: The most labelled rows that the fit takes (those of least hashed id); more rows change the model little.
MOST_ROWS = 8_000

STATS = ("length", "words", "upper", "digit", "mark", "pipe", "other", "space", "word_length", "distinct_words", "repeats", "lines", "distinct_lines", "line_length", "word_end_marks")
_WORDS = 1 << WORD_BITS
_DENSE = _WORDS + len(STATS) * BINS
FEATURES = _DENSE + len(STATS)
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their values: words share one unit of weight, each statistic sets a bin and itself."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum())
    words = text.split()
    distinct = set(words)
    count = max(1, len(words))
    lines = text.split("\n")
    marks = int(raw[_MARKS].sum())
    repeats = sum(map(str.__eq__, words, words[1:]))
    values = np.array(
        [
            min(1.0, np.log1p(len(text)) / 14),
            min(1.0, np.log1p(len(words)) / 12),
            upper / max(1, upper + lower),
            raw[48:58].sum() / n,
            min(1.0, 2 * marks / n),
            min(1.0, 10 * raw[124] / n),
            raw[128:].sum() / n,
            raw[32] / n,
            min(1.0, len(text) / count / 20),
            len(distinct) / count,
            repeats / count,
            min(1.0, np.log1p(len(lines)) / 8),
            len(set(lines)) / len(lines),
            min(1.0, np.log1p(len(text) / len(lines)) / 9),
            min(1.0, marks / count / 3),
        ],
        np.float32,
    )
    bins = _WORDS + np.arange(len(STATS)) * BINS + np.minimum((values * BINS).astype(np.int64), BINS - 1)
    ids = np.fromiter((zlib.crc32(w.lower().encode("utf-8", "replace")) & (_WORDS - 1) for w in distinct), np.int64, len(distinct))
    weight = np.full(len(ids), 1 / np.sqrt(max(1, len(ids))), np.float32)
    return np.concatenate([ids, bins, np.arange(_DENSE, FEATURES)]), np.concatenate([weight, np.full(len(STATS), 0.5, np.float32), values])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[ids] * x[:, None]
        total = v.sum(0)
        return float(self.bias + self.linear[ids] @ x + 0.5 * ((total * total).sum() - (v * v).sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = RANK, epochs: int = 8, rate: float = 0.02, batch: int = 64, decay: float = 1e-5) -> FactorisationMachine:
    """Logistic loss, Adagrad steps over shuffled batches; without rows, or with one label only, a constant."""
    y = np.array([r[2] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        odds = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        return FactorisationMachine(odds, np.zeros(FEATURES, np.float32), np.zeros((FEATURES, rank), np.float32))
    rnd = np.random.default_rng(5)
    w, v = np.zeros(FEATURES, np.float32), rnd.normal(0, 0.05, (FEATURES, rank)).astype(np.float32)
    bias, sw, sv, sb = float(np.log(y.mean() / (1 - y.mean()))), np.full(FEATURES, 1e-4, np.float32), np.full((FEATURES, rank), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rnd.permutation(len(rows))
        for at in range(0, len(rows), batch):
            part = [rows[i] for i in order[at : at + batch]]
            cut = np.cumsum([0, *(len(r[0]) for r in part)])[:-1]
            ids, x = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            own = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
            vx = v[ids] * x[:, None]
            total = np.add.reduceat(vx, cut, axis=0)
            z = bias + np.add.reduceat(w[ids] * x, cut) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), cut))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[order[at : at + batch]]) / len(part)
            gx = (g[own] * x)[:, None]
            touched, back = np.unique(ids, return_inverse=True)
            gw = np.bincount(back, gx[:, 0], len(touched)).astype(np.float32) + decay * w[touched]
            per = gx * (total[own] - vx)
            gv = np.stack([np.bincount(back, per[:, f], len(touched)) for f in range(rank)], 1).astype(np.float32) + decay * v[touched]
            sw[touched] += gw * gw
            sv[touched] += gv * gv
            w[touched] -= rate * gw / np.sqrt(sw[touched])
            v[touched] -= rate * gv / np.sqrt(sv[touched])
            gb = float(g.sum())
            sb += gb * gb
            bias -= rate * gb / np.sqrt(sb)
    return FactorisationMachine(float(bias), w, v)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; the fold 2 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> FactorisationMachine:
    """A model from at most ``most_rows`` labelled documents outside the held-out fold.

    Several labels of a document count as their rounded mean; null labels and ids are left out. Of a document that stands in
    the table more than once one row counts, that of least text, so the rows are bounded whatever the table holds.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 2)).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # of a fixed size, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def make():
        def run(texts):
            found = [features(t) for t in texts]
            return [f[0].astype("<i4").tobytes() for f in found], [f[1].astype("<f4").tobytes() for f in found]

        return run

    got = append_columns(rows, "text", [("ids", T.BinaryType()), ("x", T.BinaryType())], make, carry=["doc_id", "__y"])
    got = sorted(got.collect(), key=lambda r: (r["doc_id"], bytes(r["ids"])))
    return fit([(np.frombuffer(r["ids"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4"), r["__y"]) for r in got])


def score_quality(df: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``threshold`` on).

    A null or empty text is scored as the empty text, a very long one whole; a score equal to the threshold is accepted.
    Repeated rows stay; an empty table gives an empty one; input columns
    of these names are replaced. The model has a fixed number of weights and goes with the tasks.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def run(texts):
            scores = [own.score(t) for t in texts]
            return scores, [int(s >= threshold) for s in scores]

        return run

    return append_columns(df, text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make, carry)
