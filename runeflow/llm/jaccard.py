"""Exact Jaccard join of word n-gram sets by a prefix tree, and the groups its links make.

A set's members have one global order, so two sets with enough in common share one of their first few members. The join

1. hashes each text's n-grams (64 bits) and keeps one row of each distinct set, its class;
2. drops sets that cannot have a partner. Of a set of n, all but ``n - a`` members must be shared (``a``: the least
   overlap), so among the first ``n - a + 1 + extra`` by hash more than ``extra`` must occur in another set. A shared one
   stands, in the partner, below a rank that follows from the sizes alone, so only members up to that rank are counted;
3. orders the members of what is left by frequency, rarest first. Sets whose first members are rare and unshared have no
   partner; the others are gathered in blocks that share first members and are of like size;
4. joins each block by a tree over its sets, most frequent member first, so that sets that are alike share long paths. The
   tree is walked once for all probing sets: what each has in common with a path is counted once for all sets below it,
   and a probing set leaves a subtree where what remains of both sides cannot reach the overlap. At a leaf the count is
   the exact overlap. Sets that are connected already aren't compared again.

Members travel packed, by ranges of their hash, and each task tells of a member once, however many of its sets hold it, so
no range grows with one frequent member. Blocks beyond ``BLOCK`` sets are first drawn together by leaders, then the sets
that stay apart from the largest group meet the whole block in parts, so no task reads a large group. That last step is
quadratic in the sets of one block that no leader explains, and in nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, cut, let_go, slices, written
from .graph import BROADCAST_BYTES, components, measured

N = 5
#: Similarity as a ratio of whole numbers.
UP, DOWN = 4, 5
#: Members beyond the bare prefix that step 2 looks at.
EXTRA_SHARE, EXTRA = 0.25, 8
#: Members that a range of hashes should hold, that a task packs at a time, and characters that it hashes at a time.
BUCKET, CHUNK, SLICE = 250_000, 1_000_000, 2_000_000
#: Rows of a chunk, so that 16 bits tell them apart; the last number stands for none.
CHUNK_ROWS = 60_000
_NOBODY = np.uint16(65_535)
#: A member that so many sets of a chunk hold stands last in the order, wherever it is.
HOT = 64
#: Sets that one task joins; for blocks beyond that, rounds of leaders and leaders of a block in each.
BLOCK, LEADER_ROUNDS, LEADERS = 128, 4, 8
#: Postings that are counted at a time.
POSTINGS = 200_000

_SPREAD, _LOW = np.uint64(0x9E3779B97F4B), np.uint64(2**48 - 1)
_MIX = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) | 1 for k in range(1, 65)], np.uint64)


def finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _table() -> np.ndarray:
    """A random number for each byte at each of 256 places."""
    return finish(np.arange(1, 65_537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_TABLE = _table()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each word of ``data``: the sum of its bytes' numbers, and its length, mixed."""
    x = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(~_SPACE[x])
    if not len(at):
        return at, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    within = np.arange(len(at)) - np.repeat(first, lengths)
    values = _TABLE[((within & 255) << 8) | x[at]]
    if lengths.max() > 256:
        values = values * (2 * (within >> 8) + 1).astype(np.uint64)
    return at[first], finish(np.add.reduceat(values, first) + lengths.astype(np.uint64))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; words are bytes, A-Z lower-cased, between ASCII spaces."""

    def __init__(self, n: int = N):
        self.n = n

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        place, words = word_hashes(b"\n".join(parts).lower())
        ends = np.searchsorted(place, np.cumsum([len(p) + 1 for p in parts]))
        grams = self._grams(words, self.n)
        return [self._set(words, grams, int(a), int(b)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def _grams(words: np.ndarray, n: int) -> np.ndarray:
        m = max(0, len(words) - n + 1)
        h = np.full(m, np.uint64(n))  # a short text's own length keeps it apart from longer n-grams
        for k in range(n):
            h += words[k : k + m] * _MIX[k]
        return finish(h)

    def _set(self, words: np.ndarray, grams: np.ndarray, a: int, b: int) -> np.ndarray:
        if b - a < self.n:
            return self._grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)
        s = np.sort(grams[a : b - self.n + 1])
        return s[np.concatenate([[True], s[1:] != s[:-1]])]


def least_overlap(n: int) -> int:
    """The least overlap that a set of n has with any similar set."""
    return -(-n * UP // DOWN)


def prefix(n: int) -> int:
    return n - least_overlap(n) + 1


def head(n: int) -> int:
    return min(n, prefix(n) + int(EXTRA_SHARE * prefix(n)) + EXTRA)


def reach(n: int) -> int:
    """The largest rank that a member within a partner's head can have in a set of n.

    A partner of m has at most n * DOWN / UP members; the member's rank is at most its rank there plus the members of
    this set that the partner lacks, which are at most n less the overlap.
    """
    top = n * DOWN // UP
    # overlap >= (n + m) * UP / (UP + DOWN), head(m) grows with m: bound each term by its worst m
    best = 0
    for m in {top, n, -(-n * UP // DOWN)} if n > 64 else range(-(-n * UP // DOWN), top + 1):
        overlap = -(-(n + m) * UP // (UP + DOWN))
        best = max(best, head(m) + n - overlap)
    return min(n, best + 2)


def similar(n: int, m: int, overlap: int) -> bool:
    return DOWN * overlap >= UP * (n + m - overlap)


def _six(h: np.ndarray) -> np.ndarray:
    """The top six bytes of sorted hashes, as rows."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _back(blob: bytes) -> np.ndarray:
    rows = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, 2:] = rows
    return out.view(">u8").ravel().astype(np.uint64)


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """A written table: row (a number of its own), doc_id, n (set size), sig (of the whole set), start (top bytes of the
    first members by hash)."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, row = Shingler(n), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        try:
            for batch in batches:
                ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
                for a, b in slices(texts, SLICE):
                    sets = shingler.sets(texts[a:b])
                    yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(row + a, row + b)), "doc_id": ids.slice(a, b - a), "n": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array(list(map(_digest, sets)), pa.binary()), "start": pa.array([_six(s[: reach(len(s))]).tobytes() for s in sets], pa.binary())})
                row += len(texts)
        finally:
            shingler = None
            let_go()

    return written(source.mapInArrow(run, "row long, doc_id long, n long, sig binary, start binary"), "signatures")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """A written table: cls, n, tokens (packed whole sets) of the classes in ``wanted`` (cls, doc_id, sig); one row each.

    A text belongs to the class whose signature it has, so a doc_id may stand on several texts.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    source = texts.join(measured(wanted), "doc_id").select("cls", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        try:
            for batch in batches:
                ids, sigs, texts = batch.column(0), batch.column(1).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
                for a, b in slices(texts, SLICE):
                    sets = shingler.sets(texts[a:b])
                    own = [k for k, s in enumerate(sets) if _digest(s) == sigs[a + k]]
                    yield pa.RecordBatch.from_pydict({"cls": ids.take(pa.array([a + k for k in own], pa.int64())), "n": pa.array([len(sets[k]) for k in own], pa.int64()), "tokens": pa.array([sets[k].tobytes() for k in own], pa.binary())})
        finally:
            shingler = None
            let_go()

    out = written(source.mapInArrow(run, "cls long, n long, tokens binary"), "sets")
    # a row that stands in the table twice gave its set twice
    return out if out.count() == wanted.count() else written(out.dropDuplicates(["cls"]), "sets")


class Ranges:
    """Members by ranges of their hash: a range and 32 bits within it name a member. Two of a range's members share a name
    with a chance of ``BUCKET`` in 2**32; that may bring sets together, it never keeps them apart."""

    def __init__(self, members: int):
        self.bits = min(18, max(2, math.ceil(math.log2(max(1, members) / BUCKET + 1))))
        self.count = 1 << self.bits
        self.edges = np.arange(1, self.count, dtype=np.uint64) << np.uint64(48 - self.bits)

    def name(self, members: np.ndarray) -> np.ndarray:
        """32 bits of 48-bit members, which stay in order within their range."""
        return ((members << np.uint64(16 + self.bits)) >> np.uint64(32)).astype(np.uint32)


_ASKED = "bucket int, names binary, own binary, who binary, size binary, hot binary"


def _chunks(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(classes, sizes, members) of at most ``CHUNK`` members, or of one set, and ``CHUNK_ROWS`` rows."""
    cls: list[int] = []
    sizes: list[int] = []
    held: list[np.ndarray] = []
    total = 0
    for batch in batches:
        for c, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            m = read(blob.as_buffer())
            if held and (total + len(m) > CHUNK or len(held) >= CHUNK_ROWS):
                yield np.array(cls, np.int64), np.array(sizes, np.int64), held
                cls, sizes, held, total = [], [], [], 0
            cls.append(c)
            sizes.append(n)
            held.append(m)
            total += len(m)
    if held:
        yield np.array(cls, np.int64), np.array(sizes, np.int64), held


def _ask(rows: DataFrame, ranges: Ranges, read, asks, hot: int) -> DataFrame:
    """What tasks tell each range of the members of ``rows`` (cls, n, packed members).

    ``own`` and ``who`` say which sets want to know of a member: the first ``asks(n)`` of each. A member that ``hot`` or
    more sets of a chunk hold is told once, in ``hot``, and its askers get their answer, as ranges beyond the last one,
    from the chunk itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare = ranges.count + (TaskContext.get().partitionId() if TaskContext.get() else 0) % ranges.count
        try:
            for cls, sizes, held in _chunks(batches, read):
                # the first members by hash fill the low ranges only; an odd factor spreads them over all
                tokens = (np.concatenate(held) * _SPREAD) & _LOW
                if not len(tokens):
                    continue
                lengths = np.array([len(h) for h in held])
                own = np.repeat(np.arange(len(held)), lengths)
                within = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                own[within >= np.repeat([asks(int(n)) for n in sizes], lengths)] = _NOBODY
                order = np.argsort(tokens, kind="stable")
                tokens, own = tokens[order], own[order].astype(np.uint16)
                first = np.flatnonzero(np.diff(tokens, prepend=tokens[0] ^ np.uint64(1)))
                many = np.diff(first, append=len(tokens)) >= hot
                common = np.repeat(many, np.diff(first, append=len(tokens)))
                names, known, rest = ranges.name(tokens), tokens[first[many]], ~common
                at, at_hot = np.searchsorted(tokens[rest], ranges.edges), np.searchsorted(known, ranges.edges)
                parts = zip(np.split(names[rest], at), np.split(own[rest], at), np.split(ranges.name(known), at_hot), strict=True)
                out = []
                for k, (x, o, h) in enumerate(parts):
                    if len(x) or len(h):
                        who = np.unique(o)
                        who = who[who != _NOBODY]
                        new = np.searchsorted(who, o).astype(np.uint16)
                        new[o == _NOBODY] = _NOBODY
                        out.append((k, x.tobytes(), new.tobytes(), cls[who].tobytes(), sizes[who].astype(np.uint32).tobytes(), h.tobytes()))
                mine = common & (own != _NOBODY)
                if mine.any():
                    # of these only the first may count, up to the bare prefix
                    o, t = own[mine], tokens[mine]
                    order = np.argsort(o, kind="stable")
                    o, t = o[order], t[order]
                    who, begin, times = np.unique(o, return_index=True, return_counts=True)
                    top = np.array([prefix(int(n)) for n in sizes[who]])
                    some = np.arange(len(o)) - np.repeat(begin, times) < np.repeat(top, times)
                    out.append((spare, t[some].tobytes(), times.astype(np.uint32).tobytes(), cls[who].tobytes(), sizes[who].astype(np.uint32).tobytes(), np.minimum(times, top).astype(np.uint32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k == 0 else pa.binary()) for k in range(6)], names=["bucket", "names", "own", "who", "size", "hot"])
        finally:
            let_go()

    return rows.mapInArrow(run, _ASKED)


def _told(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of a range: (classes, sizes, place of the asker, name, how often) of the members asked for that others
    hold too; how often is 255 for a hot member, else at most 254, and grows with the number of sets."""
    names = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("names")]
    known, back, times = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    hot = np.isin(known, np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("hot")]))
    rarity = np.where(times < 128, times, 128 + 8 * np.log2(np.maximum(times, 128) / 128))
    rarity = np.where(hot, 255, np.minimum(254, rarity)).astype(np.uint8)
    shared = hot | (times > 1)
    at = 0
    for k, x in enumerate(names):
        own = np.frombuffer(group.column("own")[k].as_buffer(), np.uint16)
        mine = back[at : at + len(x)]
        at += len(x)
        ask = shared[mine] & (own != _NOBODY)
        who = np.frombuffer(group.column("who")[k].as_buffer(), np.int64)
        yield who, np.frombuffer(group.column("size")[k].as_buffer(), np.uint32), own[ask], x[ask], rarity[mine[ask]]


def possible(starts: DataFrame, members: int) -> DataFrame:
    """cls of the sets in ``starts`` (cls, n, start) that step 2 cannot rule out."""
    ranges = Ranges(members)

    def answer(group: pa.Table) -> pa.Table:
        cls, shared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if group.column("bucket")[0].as_py() >= ranges.count:
            for who, times in zip(group.column("who"), group.column("own"), strict=True):
                cls.append(np.frombuffer(who.as_buffer(), np.int64))
                shared.append(np.frombuffer(times.as_buffer(), np.uint32).astype(np.int64))
        else:
            for who, _, own, _, _ in _told(group):
                times = np.bincount(own, minlength=len(who))
                cls.append(who[times > 0])
                shared.append(times[times > 0].astype(np.int64))
        return pa.table({"cls": pa.array(np.concatenate(cls)), "shared": pa.array(np.concatenate(shared))})

    asked = _ask(starts, ranges, _back, head, 2)
    found = asked.groupBy("bucket").applyInArrow(answer, "cls long, shared long").groupBy("cls").agg(F.sum("shared").alias("shared"))
    least = F.least(F.col("n"), _prefix_col() + F.floor(_prefix_col() * EXTRA_SHARE).cast("long") + EXTRA) - _prefix_col()
    return written(found.join(starts.select("cls", "n"), "cls").where(F.col("shared") > least).select("cls"), "possible")


def _prefix_col():
    n = F.col("n")
    return n - F.floor((n * UP + DOWN - 1) / DOWN).cast("long") + 1


def first_members(sets: DataFrame, members: int) -> DataFrame:
    """A written table: cls, n and, of each set's prefix, rarest members first, those that other sets hold too (token)."""
    ranges = Ranges(members)

    def read(blob) -> np.ndarray:
        return np.frombuffer(blob, np.uint64) >> np.uint64(16)

    def answer(group: pa.Table) -> pa.Table:
        """The members that others hold too, by the set's slot; sets one after the other, ``times`` members each."""
        bucket = group.column("bucket")[0].as_py()
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        if bucket >= ranges.count:
            for k in range(group.num_rows):
                get = lambda c, t, k=k: np.frombuffer(group.column(c)[k].as_buffer(), t)
                sent = get("hot", np.uint32)
                cols[0].append(np.repeat(get("who", np.int64), sent))
                cols[1].append(np.repeat(get("size", np.uint32), sent).astype(np.int64))
                # those that were not sent follow the prefix in the order; only their number counts
                cols[2].append(np.repeat(get("own", np.uint32) - sent, sent).astype(np.int64) * (np.diff(np.repeat(np.arange(len(sent)), sent), prepend=-1) != 0))
                m = get("names", np.uint64)
                cols[3].append(((m >> np.uint64(48 - ranges.bits)) << np.uint64(32)) | ranges.name(m))
                cols[4].append(np.full(len(m), 255, np.uint8))
        else:
            for who, size, own, name, rarity in _told(group):
                order = np.argsort(own, kind="stable")
                cols[0].append(who[own[order]])
                cols[1].append(size[own[order]].astype(np.int64))
                cols[2].append(np.zeros(len(order), np.int64))
                cols[3].append((np.uint64(bucket) << np.uint64(32)) | name[order])
                cols[4].append(rarity[order])
        cls, n, unsent, token, rarity = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
        slot = finish(cls.astype(np.uint64)) >> np.uint64(64 - ranges.bits) if len(cls) else cls
        order = np.lexsort((cls, slot))
        cls, n, unsent, token, rarity, slot = (x[order] for x in (cls, n, unsent, token, rarity, slot))
        rows = []
        cuts = np.flatnonzero(np.diff(slot)) + 1 if len(slot) else np.zeros(0, np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(slot)], strict=True):
            if b > a:
                first = np.flatnonzero(np.diff(cls[a:b], prepend=cls[a] - 1))
                rows.append((int(slot[a]), cls[a:b][first].tobytes(), n[a:b][first].astype(np.uint32).tobytes(), np.diff(first, append=b - a).astype(np.uint32).tobytes(), np.add.reduceat(unsent[a:b], first).astype(np.uint32).tobytes(), token[a:b].astype(np.uint64).tobytes(), rarity[a:b].astype(np.uint8).tobytes()))
        return pa.table([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(7)], names=["slot", "who", "size", "times", "unsent", "token", "rarity"])

    def select(group: pa.Table) -> pa.Table:
        get = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in group.column(c)])
        who, size, times, unsent = get("who", np.int64), get("size", np.uint32).astype(np.int64), get("times", np.uint32), get("unsent", np.uint32)
        cls, token, rarity = np.repeat(who, times), get("token", np.uint64), get("rarity", np.uint8)
        own, back = np.unique(who, return_inverse=True)
        n, shared = np.zeros(len(own), np.int64), np.bincount(back, times + unsent, len(own)).astype(np.int64)
        n[back] = size
        order = np.lexsort((token, rarity, cls))
        cls, token = cls[order], token[order]
        at = np.searchsorted(own, cls)
        within = np.arange(len(cls)) - np.searchsorted(cls, own)[at]
        take = n - (-(-n * UP // DOWN)) + 1 - (n - shared)  # members of this set alone come first
        keep = within < take[at]
        return pa.table({"cls": pa.array(cls[keep]), "n": pa.array(n[at[keep]]), "token": pa.array(token[keep].astype(np.int64))})

    asked = _ask(sets, ranges, read, lambda n: n, HOT)
    answers = asked.groupBy("bucket").applyInArrow(answer, "slot int, who binary, size binary, times binary, unsent binary, token binary, rarity binary")
    return written(answers.groupBy("slot").applyInArrow(select, "cls long, n long, token long"), "firsts")


def blocks_of(firsts: DataFrame) -> DataFrame:
    """(cls, block): sets that share a first member and whose sizes lie in the same or in neighbouring bands."""
    # similar sets are at most one band apart, whatever the logarithms round to
    band = F.floor(F.log(DOWN / UP + 0.01, F.col("n"))).cast("int")
    seats = firsts.select("cls", "token", F.explode(F.array(band, band + 1)).alias("band"))
    least = seats.groupBy("token", "band").agg(F.min("cls").alias("least"), F.count("*").alias("k")).where("k > 1")
    stars = seats.join(least, ["token", "band"]).select(F.col("least").alias("a"), F.col("cls").alias("b"))
    return components(stars).select(F.col("id").alias("cls"), F.col("component").alias("block"))


def tree_links(sets: list[np.ndarray], group: list[int] | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all similar sets among ``sets`` (sorted arrays): pairs of positions, enough for the components.

    ``group`` tells what is connected already. With ``side``, only pairs with a True on either side are looked at.
    """
    k = len(sets)
    if k < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    vocab, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(vocab), np.int64)
    rank[np.lexsort((vocab, -times))] = np.arange(len(vocab))
    held = times[back] > 1  # what one set has alone is never shared
    token, own = rank[back[held]], np.repeat(np.arange(k), sizes)[held]
    order = np.lexsort((token, own))
    token, own = token[order], own[order]
    ends = np.searchsorted(own, np.arange(k + 1))
    paths = [token[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    place = sorted(range(k), key=lambda i: paths[i].astype(">u4").tobytes())
    paths, sizes = [paths[i] for i in place], sizes[place]
    comp = np.array([group[i] for i in place]) if group is not None else np.arange(k)
    flags = side[place] if side is not None else np.ones(k, bool)
    lengths = np.array([len(p) for p in paths], np.int64)
    begins = np.cumsum(lengths) - lengths
    token, own, words = np.concatenate(paths), np.repeat(np.arange(k), lengths), int((times > 1).sum())
    keys = own * words + token  # a set's members from a rank on are found by one search
    order = np.argsort(token, kind="stable")
    holders, of = own[order], np.searchsorted(token[order], np.arange(words + 1))
    alike = [0]
    for x, y in zip(paths, paths[1:], strict=False):
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        alike.append(int(differ[0]) if len(differ) else m)
    alike = np.array(alike)
    out: list[tuple[int, int]] = []
    todo = [(0, k, 0, np.arange(k), np.zeros(k, np.int64))]
    while todo:
        low, high, depth, probes, overlap = todo.pop()
        leaf = high == low + 1
        end = int(lengths[low]) if leaf else int(alike[low + 1 : high].min())
        label = paths[low][depth:end]
        counts = of[label + 1] - of[label]
        pieces = np.flatnonzero(np.diff(np.cumsum(counts) // POSTINGS, prepend=0)) if len(label) else np.zeros(0, np.int64)
        least, most, left = sizes[low:high].min(), sizes[low:high].max(), lengths[low:high].max()
        keep = (probes < (low if leaf else high)) & (sizes[probes] * DOWN >= least * UP) & (sizes[probes] * UP <= most * DOWN)
        if not flags[low:high].any():
            keep &= flags[probes]
        if (comp[low:high] == comp[low]).all():
            keep &= comp[probes] != comp[low]
        probes, overlap = probes[keep], overlap[keep]
        for part in np.split(np.arange(len(label)), pieces):
            if not len(probes):
                break
            if not len(part):
                continue
            x, c = label[part], counts[part]
            seen = holders[np.repeat(of[x] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
            overlap = overlap + np.bincount(seen, minlength=k)[probes]
            passed = np.searchsorted(keys, probes * words + x[-1], side="right") - begins[probes]
            # what remains on both sides, against the overlap with the smallest set below
            rest = np.minimum(left - (depth + int(part[-1]) + 1), lengths[probes] - passed)
            keep = (overlap + rest) * (UP + DOWN) >= (least + sizes[probes]) * UP
            probes, overlap = probes[keep], overlap[keep]
        if not len(probes):
            continue
        if leaf:
            for p, o in zip(probes.tolist(), overlap.tolist(), strict=True):
                if comp[p] != comp[low] and similar(int(sizes[p]), int(sizes[low]), o):
                    out.append((place[p], place[low]))
                    comp[comp == comp[p]] = comp[low]
        else:
            edges = [low, *(low + 1 + np.flatnonzero(alike[low + 1 : high] == end)).tolist(), high]
            todo += [(a, b, end, probes, overlap) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def _links(cls: list[int], found: list[tuple[int, int]]) -> pa.Table:
    found = [(cls[i], cls[j]) for i, j in found if cls[i] != cls[j]]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def block_links(sets: DataFrame, blocks: DataFrame, most: int = BLOCK) -> DataFrame:
    """(a, b) links between ``sets`` (cls, n, tokens) of the same block in the written ``blocks`` (cls, block)."""
    large = written(blocks.groupBy("block").agg(F.count("*").alias("k")).where(F.col("k") > most).select("block"), "large")
    small = sets.join(measured(written(blocks.join(measured(large), "block", "left_anti"), "small")), "cls")

    def join(group: pa.Table) -> pa.Table:
        return _links(group.column("cls").to_pylist(), tree_links(_arrays(group.column("tokens"))))

    links = written(small.groupBy("block").applyInArrow(join, "a long, b long"), "links")
    if not large.limit(1).count():
        return links
    more = written(sets.join(measured(written(blocks.join(measured(large), "block"), "seats")), "cls"), "large")
    return links.union(_large_links(more, max(2, most * 3 // 4)))


def _against(shared):
    """Each set of a batch against the leaders of its block: (set, leader) of those that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads = {k: [(c, np.frombuffer(x, np.uint64)) for c, x in v] for k, v in shared.value.items()}
        for batch in batches:
            out: list[tuple[int, int]] = []
            for c, block, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), strict=True):
                for other, y in leads.get(block, ()):
                    if len(x) * DOWN >= len(y) * UP and len(y) * DOWN >= len(x) * UP and similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))):
                        out.append((c, other))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
        let_go()

    return run


def _large_links(blocks: DataFrame, most: int) -> DataFrame:
    """Links in blocks beyond a task: leaders first, each against its whole block, then pairs of parts of what is apart."""
    found: list[DataFrame] = []
    state = written(blocks.select("cls", "block", F.lit(False).alias("led")), "state")
    for k in range(LEADER_ROUNDS):
        # some sets of each block that are in no leader's group lead next
        draw = F.xxhash64("cls", F.lit(k))
        leaders = state.where(~F.col("led")).groupBy("block", F.pmod(draw, F.lit(LEADERS)).alias("seat")).agg(F.min_by("cls", F.struct(draw, "cls")).alias("leader")).drop("seat")
        leaders = written(leaders.join(blocks.select(F.col("cls").alias("leader"), F.col("tokens").alias("lead")), "leader"), "leaders")
        held = leaders.agg(F.sum(F.octet_length("lead") + 64)).first()[0]
        if not held:
            break
        # leaders go to the tasks in batches of a bounded size; a row of the block carries its own set only
        batches = -(-2 * int(held) // BROADCAST_BYTES)
        links = None
        for b in range(batches):
            part = leaders.where(F.pmod(F.xxhash64("leader"), F.lit(batches)) == b).collect()
            by_block: dict[int, list[tuple[int, bytes]]] = {}
            for r in part:
                by_block.setdefault(r["block"], []).append((r["leader"], bytes(r["lead"])))
            shared = blocks.sparkSession.sparkContext.broadcast(by_block)
            met = blocks.select("cls", "block", "tokens").mapInArrow(_against(shared), "a long, b long")
            links = met if links is None else links.union(met)
        links = written(links, "led")
        found.append(links.where("a <> b"))
        hit = links.select(F.col("a").alias("cls"), F.lit(True).alias("hit")).distinct()
        state = cut(state.join(hit, "cls", "left").select("cls", "block", (F.col("led") | F.coalesce("hit", F.lit(False))).alias("led")))
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    state = state.select("cls", "block").join(components(edges).withColumnRenamed("id", "cls"), "cls", "left")
    state = written(state.select("cls", "block", F.coalesce("component", "cls").alias("comp")), "state")
    by_comp = state.groupBy("block", "comp").count()
    largest = by_comp.groupBy("block").agg(F.max_by("comp", F.struct("count", -F.col("comp"))).alias("main"), F.sum("count").alias("k"), (F.sum("count") - F.max("count")).alias("n_apart"))
    state = state.join(largest, "block").withColumn("apart", F.col("comp") != F.col("main"))
    part = lambda n: F.pmod(F.xxhash64("cls"), F.greatest(F.lit(1), F.ceil(n * 2 / most))).cast("int")
    state = written(state.select("cls", "block", "comp", "apart", "n_apart", part(F.col("k")).alias("part"), F.ceil(F.col("k") * 2 / most).cast("int").alias("parts"), part(F.col("n_apart")).alias("seat")), "state")
    # sets apart from the largest group, in seats, meet the whole block, part by part
    whole = blocks.join(state.where("n_apart > 0").drop("block"), "cls")
    left = whole.where("apart").select("cls", "block", "comp", "tokens", F.lit(True).alias("probe"), F.col("seat").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    seats = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("n_apart") * 2 / most)).cast("int") - 1)
    right = whole.select("cls", "block", "comp", "tokens", F.lit(False).alias("probe"), F.explode(seats).alias("i"), F.col("part").alias("j"))

    def join(group: pa.Table) -> pa.Table:
        probe = np.array(group.column("probe").to_pylist(), bool)
        return _links(group.column("cls").to_pylist(), tree_links(_arrays(group.column("tokens")), group.column("comp").to_pylist(), probe))

    return edges.union(left.union(right).groupBy("block", "i", "j").applyInArrow(join, "a long, b long"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, sig and kept of each row. component_id is the least id reachable over links of
    similarity 0.8 or more; ``kept`` tells the one row of each group of texts that stands for it, and every row that is in
    no group; ``sig`` is the digest of the row's set (null: empty).

    A text of fewer than ``n`` words has its whole sequence as its one n-gram; a null text, or one without words, has an
    empty set and links with nothing. Equal sets are linked. Repeated rows each give a row; an id on several texts is
    linked by each of them. A null id is never linked and is its own (null) component; an empty table gives an empty one.
    A very long text is one set, whatever its length. Other columns, whatever their names, are left out.
    """
    sig = signatures(docs, id_col, text_col, n)
    usable = sig.where("sig IS NOT NULL AND doc_id IS NOT NULL")
    first = F.struct("doc_id", "row")
    classes = written(usable.groupBy("sig").agg(F.min(first).alias("x")).select("sig", F.col("x.row").alias("cls"), F.col("x.doc_id").alias("doc_id")), "classes")
    copies = written(usable.select("row").join(classes.select(F.col("cls").alias("row")), "row", "left_anti"), "copies")
    reps = usable.join(measured(copies), "row", "left_anti").select(F.col("row").alias("cls"), "n", "start")
    maybe = possible(reps, int(reps.agg(F.sum(F.octet_length("start"))).first()[0] or 0) // 6)
    wanted = written(classes.join(measured(maybe), "cls").select("cls", "doc_id", "sig"), "wanted")
    sets = full_sets(docs, wanted, id_col, text_col, n)
    firsts = first_members(sets, int(sets.agg(F.sum("n")).first()[0] or 0))
    blocks = written(blocks_of(firsts), "blocks")
    links = written(block_links(sets, blocks, block), "links")
    comps = components(links).select(F.col("id").alias("cls"), "component")
    groups = written(classes.join(comps, "cls").groupBy("component").agg(F.min(F.struct("doc_id", "cls")).alias("x")).select("component", F.col("x.cls").alias("main"), F.col("x.doc_id").alias("least")), "groups")
    named = classes.join(comps.join(groups, "component"), "cls", "left").select("sig", "cls", F.coalesce("main", "cls").alias("main"), F.coalesce("least", "doc_id").alias("component_id"))
    named = _same_id(usable, written(named, "named"))
    out = sig.select("row", "doc_id", F.col("n").alias("n_shingles"), "sig").join(named.withColumnRenamed("sig", "of"), F.col("doc_id").isNotNull() & (F.col("sig") == F.col("of")), "left")
    kept = F.coalesce(F.col("row") == F.col("main"), F.lit(True))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "sig", kept.alias("kept"))


def _same_id(usable: DataFrame, named: DataFrame) -> DataFrame:
    """``named`` with the component_id that takes in the groups which one id brings together, by standing on several texts."""
    many = written(usable.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "many")
    if not many.limit(1).count():
        return named
    seats = usable.join(measured(many), "doc_id").select("doc_id", "sig").join(named.select("sig", "component_id"), "sig")
    comps = components(seats.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    wider = comps.withColumnRenamed("id", "component_id")
    return named.join(wider, "component_id", "left").select("sig", "cls", "main", F.coalesce("component", "component_id").alias("component_id"))


def append_signature(docs: DataFrame, name: str, text_col: str = "text", n: int = N) -> DataFrame:
    """``docs`` with the column ``name``: the digest of the text's set, as ``sig`` in ``jaccard_groups``."""

    def make():
        shingler = Shingler(n)
        return lambda texts: [list(map(_digest, shingler.sets(texts)))]

    return append_columns(docs, text_col, [(name, T.BinaryType())], make)
