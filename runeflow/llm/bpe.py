"""Byte-level BPE by rank file: encoding in padded numpy matrices, and decoding.

Every distinct pre-token becomes a row. Rows of like length share a padded matrix; in each round every row merges its
leftmost pair of minimum rank, found by a hashed lookup of (left id, right id), and rows without a mergeable pair leave
the matrix. Rounds merge all rows at once, so a matrix needs as many rounds as its longest row has merges. A row too long
to share a matrix merges, in a round, its leftmost pair and those of the same rank after it that the rules would take next.
"""

from __future__ import annotations

import base64
import copy
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import Memo, cut_texts, spaced
from .common import append_columns

_NONE = np.int32(2**31 - 1)
#: Pieces that a task remembers, and characters that it encodes at a time.
MEMO, SLICE = 250_000, 1_000_000
#: Rows of a matrix hold at most so many bytes together.
_CELLS = 4_000_000
#: Pre-tokens above this many bytes are matrices of one row, which merge equal pairs together.
_LONG = 512
# Fixed value: the pattern for which the cuts of chunks.py and the shortcut below are proven; with any other one each text
# is split whole.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A piece of one word of Latin letters and perhaps some ASCII marks: the known pattern splits it right there.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ʯ]+)([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)?")


class PairTable:
    """Open addressing over the merges: (left, right) to rank, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        todo, at = np.arange(len(key)), self._home(key)
        self.probes = 1
        while len(todo):
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            win = first[free[first]]
            self.keys[at[win]] = key[todo[win]]
            self.ranks[at[win]] = rank[todo[win]]
            rest = np.ones(len(todo), bool)
            rest[win] = False
            todo, at = todo[rest], (at[rest] + np.uint64(1)) & self.mask
            self.probes += 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, ``_NONE`` where there is no merge. Negative ids are padding."""
        key = (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        at = self._home(key)
        out = np.full(key.shape, _NONE, np.int32)
        todo = None
        for _ in range(self.probes):
            seen = self.keys[at]
            hit = seen == key
            if todo is None:
                out[hit] = self.ranks[at[hit]]
                todo = np.flatnonzero(~hit & (seen != np.uint64(2**64 - 1)))
                key, at = key.ravel()[todo], at.ravel()[todo]
            else:
                out.ravel()[todo[hit]] = self.ranks[at[hit]]
                live = ~hit & (seen != np.uint64(2**64 - 1))
                todo, key, at = todo[live], key[live], at[live]
            if not len(todo):
                break
            at = (at + np.uint64(1)) & self.mask
        return out


class ByteBpe:
    """The vocabulary of a rank file (one ``base64 rank`` line each); a merge's rank is the rank of its joined bytes."""

    def __init__(self, path: str, pattern: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.pattern, self.cuts = regex.compile(pattern), pattern == KNOWN_PATTERN
        self.vocab = {i: b for b, i in ranks.items()}
        self.text = {i: str(i) for i in self.vocab}
        self.packed = {i: i.to_bytes(4, "little") for i in self.vocab}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.table = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.memo = Memo(self._encode_pieces)

    def encode_tokens(self, tokens: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each pre-token by itself."""
        out: list = [None] * len(tokens)
        left = []
        for i, t in enumerate(tokens):
            known = self.ranks.get(t)
            if known is not None:
                out[i] = (known,)
            elif len(t) > _LONG:
                out[i] = self._long(t)
            elif t:
                left.append(i)
            else:
                out[i] = ()
        left.sort(key=lambda i: len(tokens[i]))
        start = 0
        while start < len(left):
            width, end = len(tokens[left[start]]), start
            most = max(width + 2, width * 5 // 4)  # a bucket's lengths lie within a quarter of each other
            while end < len(left) and len(tokens[left[end]]) <= most and (end - start + 1) * most <= max(_CELLS, most):
                end += 1
            rows = left[start:end]
            for i, ids in zip(rows, self._matrix([tokens[i] for i in rows]), strict=True):
                out[i] = ids
            start = end
        return out

    def _matrix(self, tokens: list[bytes]) -> list[tuple[int, ...]]:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        width = int(lengths.max())
        ids = np.full((len(tokens), width), -1, np.int32)
        ids[np.arange(width)[None, :] < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        pair = np.full((len(tokens), width), _NONE, np.int32)
        if width > 1:
            pair[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        out: list = [None] * len(tokens)
        row = np.arange(len(tokens))
        while len(row):
            at = pair.argmin(axis=1)  # the first of equal minima: leftmost
            n = np.arange(len(row))
            best = pair[n, at]
            done = best == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[row[k]] = tuple(ids[k, : lengths[k]].tolist())
                live = ~done
                widest = int(lengths[live].max()) if live.any() else 0
                row, lengths, at, best = row[live], lengths[live], at[live], best[live]
                ids, pair = ids[live, :widest], pair[live, :widest]
                if not len(row):
                    break
                n = np.arange(len(row))
            # what stands right of the merged pair moves one to the left
            cols = np.arange(ids.shape[1])
            moved = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), ids.shape[1] - 1)
            ids, pair = np.take_along_axis(ids, moved, 1), np.take_along_axis(pair, moved, 1)
            lengths = lengths - 1
            ids[n, at] = best
            ids[n, np.minimum(lengths, ids.shape[1] - 1)] = -1
            pair[n, np.minimum(lengths, ids.shape[1] - 1)] = _NONE
            pair[n, np.maximum(lengths - 1, 0)] = _NONE
            has_right = at + 1 < lengths
            k = n[has_right]
            pair[k, at[k]] = self._ranks(ids[k, at[k]], ids[k, at[k] + 1])
            k = n[at > 0]
            pair[k, at[k] - 1] = self._ranks(ids[k, at[k] - 1], ids[k, at[k]])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.table.look_up(left, right)
        found[(left < 0) | (right < 0)] = _NONE
        return found

    def _long(self, token: bytes) -> tuple[int, ...]:
        """One row by itself. In a round it merges the pairs of its least rank from left to right, up to the first merge
        that brings up a pair of lesser rank, which has to go first."""
        ids = self.byte_ids[np.frombuffer(token, np.uint8)]
        pair = np.append(self._ranks(ids[:-1], ids[1:]), _NONE)
        while (best := pair.min()) != _NONE:
            at = np.flatnonzero(pair == best)
            k = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, k, 0))
            at = at[(k - begin) % 2 == 0]  # of pairs that overlap the left one
            merged = np.full(len(at), best, np.int32)
            before = np.where(np.diff(at, prepend=-9) == 2, merged, ids[at - 1])
            before[at == 0] = -1
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], np.int32(-1))
            early = np.flatnonzero((self._ranks(before, merged) < best) | (self._ranks(merged, after) < best))
            if len(early):
                at = at[: early[0] + 1]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids[at] = best
            ids, pair = ids[stay], pair[stay]
            new = at - np.arange(len(at))
            new = np.concatenate([new, new - 1])
            new = new[(new >= 0) & (new + 1 < len(ids))]
            pair[new] = self._ranks(ids[new], ids[new + 1])
            pair[-1] = _NONE
        return tuple(ids.tolist())

    def _encode_pieces(self, keys: list[str]) -> list[bytes]:
        """Ids of each piece, four bytes each: half the room of numbers."""
        plain, findall, split = _PLAIN.fullmatch, self.pattern.findall, []
        for k in map(spaced, keys):
            if m := plain(k):
                split.append((m[1], m[2]) if m[2] else (k,))
            else:
                split.append(findall(k))
        distinct, pack = list(set(chain.from_iterable(split))), self.packed.__getitem__
        found = self.encode_tokens([t.encode("utf-8", "surrogatepass") for t in distinct])
        ids = {t: b"".join(map(pack, x)) for t, x in zip(distinct, found, strict=True)}
        return [ids[s[0]] if len(s) == 1 else b"".join(map(ids.__getitem__, s)) for s in split]

    def _cut(self, texts: list[str]) -> tuple[list, dict]:
        return cut_texts(texts, self.memo) if self.cuts else ([None] * len(texts), {})

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        lists, known = self._cut(texts)
        return [self._whole(t) if x is None else np.frombuffer(b"".join(map(known.__getitem__, x)), "<i4").tolist() for t, x in zip(texts, lists, strict=True)]

    def encode_arrays(self, texts: list[str]) -> pa.Array:
        """Ids of whole texts as one Arrow list array, without a Python object for each."""
        lists, known = self._cut(texts)
        data = [np.array(self._whole(t), "<i4").tobytes() if x is None else b"".join(map(known.__getitem__, x)) for t, x in zip(texts, lists, strict=True)]
        ends = np.cumsum([0, *(len(d) // 4 for d in data)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<i4")))

    def _whole(self, text: str) -> list[int]:
        parts = self.pattern.findall(text)
        distinct = list(set(parts))
        ids = dict(zip(distinct, self.encode_tokens([t.encode("utf-8", "surrogatepass") for t in distinct]), strict=True))
        return list(chain.from_iterable(map(ids.__getitem__, parts)))

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of the ids, one after the other."""
        return b"".join(map(self.vocab.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    """The vocabulary at ``path``, read once in each Python worker, with a memo of its own that goes with its user."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    coder = copy.copy(_LOADED[path, pattern])
    coder.memo = Memo(coder._encode_pieces, MEMO)
    return coder


def bpe_encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``token_ids`` (array of int) of each whole text.

    A null or empty text has no ids. Repeated rows stay, each with its ids; an empty table gives an empty one. A column
    of the input named ``token_ids`` is replaced.
    """

    def make():
        coder = load(path, pattern)
        return lambda texts: [coder.encode_arrays(texts)]

    return append_columns(df, text_col, [("token_ids", T.ArrayType(T.IntegerType()))], make, carry, SLICE)


def bpe_decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of the ids in ``ids_col``; null ids decode to no bytes."""
    from pyspark.sql import functions as F

    kept = [c for c in (df.columns if carry is None else carry) if c.lower() != "decoded"]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias("__ids"))
    schema = T.StructType([source.schema[c] for c in source.columns[:-1]] + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        coder = load(path, pattern)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            # a text at a time, so that no batch of numbers turns into Python objects at once
            out = [coder.decode_bytes(values[a:b].tolist()) if ok else b"" for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def bpe_round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``token_ids`` of each whole text and ``decoded`` (binary), their bytes: both in one pass, by one worker.

    A null or empty text has no ids and no bytes. Repeated rows stay; an empty table gives an empty one. Input columns of
    these names are replaced.
    """

    def make():
        coder = load(path, pattern)

        def run(texts):
            ids = coder.encode_arrays(texts)
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            # a text at a time, so that no slice of numbers turns into Python objects at once
            return ids, pa.array([coder.decode_bytes(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

        return run

    return append_columns(df, text_col, [("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())], make, carry, SLICE)


def bpe_digests(df: DataFrame, path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: each text is encoded and its ids decoded in one pass.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the decoded bytes; a null or empty
    text has 0 tokens and the digests of nothing. Input columns of these names are replaced.
    """

    def make():
        coder = load(path, pattern)
        name = coder.text.__getitem__

        def run(texts):
            counts, ids_sha, text_sha = [], [], []
            for ids in coder.encode_batch(texts):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
            return counts, ids_sha, text_sha

        return run

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return append_columns(df, text_col, fields, make, carry, SLICE)
