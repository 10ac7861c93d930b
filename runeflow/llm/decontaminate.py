"""Benchmark passages in documents, verbatim or reworded, by latent semantic retrieval.

All documents' passages make a TF-IDF matrix over hashed words. A randomised range finder in one pass gives its leading
right singular vectors: each task adds up, over its passages ``a``, the products ``a (a' W)`` with a random ``W`` and the
passage frequencies of the words; the inverse frequencies scale both sides afterwards, and a Nystroem step on the driver
turns the sum into the vectors. Windows of every document are compared with the items in that space by cosine; each
candidate is checked by the weighted share of the item's words, the longest common subsequence with the words about the
window, and the words of the item's answer, its last part. Items that a document holds enough words of and that no near
window shows are checked at all windows, so a passage is never lost for its place in the space.

Texts become arrays of word numbers in the JVM; Python sees numbers only, and whole batches at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are numbered by 31 bits of a hash; the space has a dimension for each bucket of them.
WORD_BITS = 14
RANK, SKETCH = 32, 40
PASSAGE = 32
#: Words of a step, and windows as (steps long, steps apart); an item is sought with the window nearest its length.
STEP = 4
WINDOWS = ((1, 1), (2, 1), (3, 1), (4, 1), (8, 2), (14, 3))
COSINE = 0.5
#: An item is found if so much of it is a common subsequence, or less if its answer and its rare words are there too.
WHOLE, PART, ANSWER, SHARE = 0.8, 0.55, 0.5, 0.4
#: Items searched for in one pass over the documents, and words handled at a time.
ITEMS = 2_000
AT_A_TIME = 400_000
#: Cells of a table of parts and words.
CELLS = 8_000_000

_V = 1 << WORD_BITS


def word_numbers(text: Column) -> Column:
    """Numbers of the lower-cased words, runs of letters, digits and underscores, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def _batches(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, numbers, lengths) of parts of a list column that hold at most ``AT_A_TIME`` numbers, or one row."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + AT_A_TIME, side="right")) - 1)
        b = min(b, n)
        yield a, b, values[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])
        a = b


@dataclass
class Space:
    """``idf`` of each bucket, and the rows that a word adds to its window's vector, less the mean."""

    idf: np.ndarray
    rows: np.ndarray

    def vector(self, ids: np.ndarray) -> np.ndarray:
        return self.rows[ids & (_V - 1)].sum(0)


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, … within each row."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _step_sums(rows: np.ndarray, ids: np.ndarray, within: np.ndarray, lengths: np.ndarray, step: int) -> np.ndarray:
    """Sums of ``rows`` over each ``step`` words of each text, its last step being shorter; the last of ``rows`` is zero."""
    counts = -(-lengths // step)
    padded = np.full(int(counts.sum()) * step, len(rows) - 1, np.int64)
    padded[np.repeat((np.cumsum(counts) - counts) * step, lengths) + within] = ids
    out = rows[padded[0::step]]
    for k in range(1, step):
        out += rows[padded[k::step]]
    return out


def fit(docs: DataFrame, text_col: str = "text") -> Space:
    """The space of all passages of all texts; without any, one in which nothing is a candidate."""
    test = np.random.default_rng(17).normal(size=(_V, SKETCH)).astype(np.float32)
    padded = np.concatenate([test, np.zeros((1, SKETCH), np.float32)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, passages, words = np.zeros((SKETCH, _V)), np.zeros(_V), 0, np.zeros(_V)
        for batch in batches:
            for _, _, numbers, lengths in _batches(batch.column(0)):
                if not len(numbers):
                    continue
                ids = numbers & (_V - 1)
                within = _within(lengths)
                starts = np.flatnonzero(within % PASSAGE == 0)
                own = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(ids)))
                z = np.ascontiguousarray(_step_sums(padded, ids, within, lengths, PASSAGE).T)
                order = np.argsort(ids.astype(np.int16), kind="stable")
                ordered = ids[order].astype(np.int64)
                first = np.flatnonzero(np.diff(ordered, prepend=-1))
                at, bucket = own[order], ordered[first]
                for k in range(SKETCH):  # a dimension at a time stays in the processor's cache
                    total[k, bucket] += np.add.reduceat(z[k].take(at), first)
                pairs = ordered * len(starts) + at  # in order, as the sort keeps positions
                seen += np.bincount(ordered[np.diff(pairs, prepend=-1) != 0], minlength=_V)
                words += np.bincount(ids, minlength=_V)
                passages += len(starts)
        if passages:
            k = (TaskContext.get().partitionId() if TaskContext.get() else 0) % 256
            blob = np.concatenate([[passages], seen, words, total.T.ravel()]).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "sums": pa.array([blob], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(1)
        for b in group.column("sums"):
            total = total + np.frombuffer(b.as_buffer(), np.float32)
        return pa.table({"k": group.column("k").slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    # one row a task, then 256, then 8: no task gathers more than a part of the sums
    parts = docs.select(word_numbers(F.col(f"`{text_col}`")).alias("words")).mapInArrow(sums, "k int, sums binary").groupBy("k").applyInArrow(add, "k int, sums binary")
    parts = parts.withColumn("k", F.pmod("k", F.lit(8)).cast("int")).groupBy("k").applyInArrow(add, "k int, sums binary").collect()
    if not parts:
        return Space(np.ones(_V, np.float32), np.zeros((_V, RANK), np.float32))
    total = sum(np.frombuffer(bytes(r["sums"]), np.float32).astype(np.float64) for r in sorted(parts, key=lambda r: r["k"]))
    passages, seen, words, y = total[0], total[1 : _V + 1], total[_V + 1 : 2 * _V + 1], total[2 * _V + 1 :].reshape(_V, SKETCH)
    idf = np.log((passages + 1) / (seen + 0.5)).clip(0.05)
    core = test.astype(np.float64).T @ y
    values, turn = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-9
    left, _, _ = np.linalg.svd((idf[:, None] * y) @ (turn[:, good] / np.sqrt(values[good])), full_matrices=False)
    rows = idf[:, None] * left[:, :RANK]
    if rows.shape[1] < RANK:
        rows = np.pad(rows, ((0, 0), (0, RANK - rows.shape[1])))
    mean = (words / words.sum()) @ rows
    return Space(idf.astype(np.float32), (rows - mean).astype(np.float32))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a word of ``b`` at a time over the bits of ``a``."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Item:
    item_id: int | None
    words: list[int]
    weights: dict[int, float]
    total: float
    answer: set[int]
    kind: int
    vector: np.ndarray


def items_of(rows: list[tuple[int | None, list[int]]], space: Space) -> list[Item]:
    out = []
    for item_id, words in rows:
        if not words:
            continue
        ids = np.array(words)
        weights = {w: float(space.idf[w & (_V - 1)]) for w in words}
        kind = int(np.argmin([abs(len(words) - n * STEP) for n, _ in WINDOWS]))
        v = space.vector(ids)
        out.append(Item(item_id, words, weights, sum(weights.values()), set(words[-max(3, len(words) // 4) :]), kind, v / max(1e-12, float(np.linalg.norm(v)))))
    return out


class Searcher:
    """Items found in texts, given as word numbers."""

    def __init__(self, space: Space, items: list[Item], cosine: float = COSINE):
        self.space, self.items, self.cosine = space, items, cosine
        self.padded = np.concatenate([space.rows, np.zeros((1, RANK), np.float32)])
        self.vectors = np.stack([it.vector for it in items]).astype(np.float32) if items else None
        self.kinds = np.array([it.kind for it in items], np.int64)
        self.vocab = np.array(sorted({w for it in items for w in it.weights}), np.int64)
        place = {w: k for k, w in enumerate(self.vocab.tolist())}
        pairs = sorted((place[w], i, x / it.total) for i, it in enumerate(items) for w, x in it.weights.items())
        self.of_word = np.searchsorted([p[0] for p in pairs], np.arange(len(self.vocab) + 1))
        self.pair_item, self.pair_share = np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs])
        self.own = [np.array([place[w] for w in it.weights], np.int64) for it in items]
        self.weights = [np.array(list(it.weights.values())) for it in items]
        self.dense = np.zeros(len(self.vocab) + 1)
        # what lies about a window of any item fits a stretch of words, and so a pair of neighbouring ones wherever it begins
        about = max((WINDOWS[it.kind][0] * STEP + len(it.words) for it in items), default=1)
        self.stretch = -(-about // (STEP * 6)) * STEP * 6

    def shares(self, places: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        """For each part of a text and item the weighted share of the item's words that the part has."""
        out = np.zeros((n, len(self.items)))
        order = np.argsort(part, kind="stable")
        places, part = places[order], part[order]
        step = max(1, CELLS // len(self.vocab))
        for a in range(0, n, step):  # so many parts that a table of which words they have stays small
            low, high = np.searchsorted(part, (a, a + step))
            has = np.zeros((min(step, n - a), len(self.vocab)), bool)
            has[part[low:high] - a, places[low:high]] = True
            own, word = np.divmod(np.flatnonzero(has.ravel()), len(self.vocab))
            count = self.of_word[word + 1] - self.of_word[word]
            k = np.repeat(self.of_word[word] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            key = np.repeat(own, count) * len(self.items) + self.pair_item[k]
            out[a : a + step] = np.bincount(key, self.pair_share[k], len(has) * len(self.items)).reshape(len(has), -1)
        return out

    def search(self, numbers: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, float, float, float, int, int]]:
        """(row, item, cosine, subsequence share, answer share, first word, words) of the rows' matches."""
        if not len(numbers) or not self.items:
            return []
        numbers = numbers.astype(np.int64)
        places = np.minimum(np.searchsorted(self.vocab, numbers), len(self.vocab) - 1)
        places[self.vocab[places] != numbers] = len(self.vocab)
        # pairs of neighbouring stretches: the k-th of a row holds the stretches k and k + 1
        stretches = -(-lengths // self.stretch)
        first = np.cumsum(stretches) - stretches
        hit = np.flatnonzero(places < len(self.vocab))
        rows = np.repeat(np.arange(len(lengths)), lengths)[hit]
        block = _within(lengths)[hit] // self.stretch
        late = block > 0
        part = np.concatenate([first[rows] + block, (first[rows] + block)[late] - 1])
        likely = self.shares(np.concatenate([places[hit], places[hit][late]]), part, int(stretches.sum())) >= SHARE - 1e-9
        part, item = np.nonzero(likely)  # nothing else can hold an item
        if not len(part):
            return []
        row = np.searchsorted(first + stretches, part, side="right")
        order = np.lexsort((part, item, row))
        part, item, row = part[order], item[order], row[order]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        found = []
        cuts = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            k, i = int(row[a]), int(item[a])
            words, where = numbers[offsets[k] : offsets[k + 1]], places[offsets[k] : offsets[k + 1]]
            low, high, weight, near = (np.concatenate(x) for x in zip(*self._windows(i, words, where, part[a:b] - first[k]), strict=True))
            close, best = np.flatnonzero(near >= self.cosine), None
            if len(close):
                best = self._check(i, words, (low, high, weight), close, near)
            if best is None:
                best = self._check(i, words, (low, high, weight), np.arange(len(low)), near)
            if best:
                found.append((k, i, *best))
        return found

    def _windows(self, item: int, words: np.ndarray, where: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, end, weight, cosine) of what lies about each window in runs of the row's ``pairs`` of stretches.

        With repetitions counted what lies about a window weighs no less than without.
        """
        it, (length, apart) = self.items[item], WINDOWS[self.items[item].kind]
        half, size = len(it.words) // 2, -(-len(words) // STEP)
        for run in np.split(pairs, np.flatnonzero(np.diff(pairs) > 1) + 1):
            a, b = int(run[0]) * self.stretch, min(len(words), (int(run[-1]) + 2) * self.stretch)
            start = np.arange(a // STEP // apart * apart, min(max(1, size + apart - length), b // STEP + 1), apart)
            steps = _step_sums(self.padded, words[a:b] & (_V - 1), np.arange(b - a), np.array([b - a]), STEP)
            sums = np.concatenate([np.zeros((1, RANK)), np.cumsum(steps, axis=0, dtype=np.float64)])
            base = a // STEP
            w = (sums[np.minimum(np.minimum(start + length, size) - base, len(steps))] - sums[start - base]).astype(np.float32)
            near = (w @ it.vector.astype(np.float32)) / np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-12)
            self.dense[self.own[item]] = self.weights[item]
            weights = self.dense[where[a:b]]
            self.dense[self.own[item]] = 0
            at = np.flatnonzero(weights)
            total = np.concatenate([[0.0], np.cumsum(weights[at])])
            low, high = np.maximum(0, start * STEP - half), np.minimum(len(words), (start + length) * STEP + half)
            yield low, high, total[np.searchsorted(at, high - a)] - total[np.searchsorted(at, np.maximum(0, low - a))], near

    def _check(self, item: int, words: np.ndarray, regions: tuple[np.ndarray, np.ndarray, np.ndarray], some: np.ndarray, cosines: np.ndarray) -> tuple | None:
        low, high, weight = regions
        it, best = self.items[item], (0.0, 0.0, 0.0, 0, 0)
        for k in some[weight[some] >= SHARE * it.total - 1e-6].tolist():
            part = words[low[k] : high[k]].tolist()
            near = set(part)
            if sum(x for w, x in it.weights.items() if w in near) < SHARE * it.total - 1e-9:
                continue
            share = common_subsequence(it.words, part) / len(it.words)
            if share > best[1]:
                best = (float(cosines[k]), share, len(it.answer & near) / len(it.answer), int(low[k]), len(part))
        return best if best[1] >= WHOLE or (best[1] >= PART and best[2] >= ANSWER) else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", space: Space | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, subsequence, answer, first_word, n_words) of every item found in a document.

    An item is found where four fifths of its words are a common subsequence with the words about a window, or more than
    half and half of its answer's words, and where the rare words there weigh two fifths of the item's. Windows of high
    cosine are checked first, all others of a document that has such weight after them, so the space decides what is
    looked at first and no item is lost by it. Of places that show an item equally well the first is reported.

    Null and empty texts and items have no matches. Repeated rows of documents each give theirs, repeated items too; empty
    tables give an empty result. A very long text is searched at all its windows. Ids may be null; other columns, whatever their names, are left out. The items are a
    stated query set: they are taken in blocks of ``ITEMS``, each of which meets all documents in a pass.
    """
    space = space or fit(docs, text_col)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_numbers(F.col(f"`{text_col}`")).alias("words"))
    queries = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    blocks = max(1, -(-queries.count() // ITEMS))
    spark, out = docs.sparkSession, None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", word_numbers(F.col("text")).alias("words")).collect()
        items = items_of(sorted(((r["item_id"], list(r["words"])) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])), space)
        shared = spark.sparkContext.broadcast((space, items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value)
            for batch in batches:
                ids = batch.column(0)
                for a, _, numbers, lengths in _batches(batch.column(1)):
                    cols = list(zip(*searcher.search(numbers, lengths), strict=True)) or [[]] * 7
                    yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array([a + r for r in cols[0]], pa.int64())), "item_id": pa.array([searcher.items[k].item_id for k in cols[1]], pa.int64()), "cosine": pa.array(cols[2], pa.float64()), "subsequence": pa.array(cols[3], pa.float64()), "answer": pa.array(cols[4], pa.float64()), "first_word": pa.array(cols[5], pa.int64()), "n_words": pa.array(cols[6], pa.int64())})

        part = source.mapInArrow(run, "doc_id long, item_id long, cosine double, subsequence double, answer double, first_word long, n_words long")
        out = part if out is None else out.union(part)
    return out
