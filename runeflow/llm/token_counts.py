"""Token counts of whole texts; huge ones in overlapping chunks that are resynchronised.

A huge text is encoded in overlapping chunks with offsets. Two neighbours are spliced at a position where both have a
token's start and white space stands before it: the tokenizer drops white space and never merges, normalises or splits
across it, so what stands left of the place comes whole from the left chunk and the rest from the right one. With the known
pre-tokenizer the change from a letter to a mark is such a place too. Where an overlap has no such place it is doubled; at last the left chunk is, so a text without any such place is encoded in chunks
that together are twice as long as it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import Memo, words
from .common import append_columns

#: Texts of more characters than this are encoded in chunks.
HUGE = 65_536
CHUNK = 32_768
OVERLAP = 256
#: Words new to the memo are encoded together, so many to a text.
_TOGETHER = 4_000


# Fixed value: the pieces that the known pre-tokenizer makes; no piece crosses from an ASCII letter or digit to an ASCII mark
# or digit, whatever stands around them.
KNOWN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Places where white space, or with the known pieces also such a change, stands before: what follows is a token's start.
_AFTER_SPACE = re.compile(r"(?<=[ \t\n\r\f\v])(?![ \t\n\r\f\v])")
_AFTER_PIECE = re.compile(r"(?<=[ \t\n\r\f\v])(?![ \t\n\r\f\v])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~0-9])")


def spliced_count(text: str, starts_of: Callable[[str], np.ndarray], chunk: int = CHUNK, overlap: int = OVERLAP, stable: re.Pattern = _AFTER_SPACE) -> int:
    """Tokens of ``text`` from chunks; ``starts_of`` gives the offsets of the tokens of a part, in order."""
    n, kept, total = len(text), 0, 0
    end = min(chunk, n)
    left = starts_of(text[:end])
    while end < n:
        wide = overlap
        while True:
            begin = end - wide
            if begin <= kept:  # no stable place in all of the left chunk: it becomes twice as long, so all work stays linear
                end = min(end + max(chunk, end - kept), n)
                left = starts_of(text[kept:end]) + kept
                break
            places = [m.start() for m in stable.finditer(text, begin + 1, end)]
            if places:  # else the overlap holds none, whatever the tokens
                right_end = min(begin + max(chunk, 2 * wide), n)
                right = starts_of(text[begin:right_end]) + begin
                both = np.intersect1d(left[(left > max(begin, kept)) & (left < end)], right)
                both = np.intersect1d(both, np.array(places), assume_unique=True).tolist()
                if both:
                    p = both[len(both) // 2]
                    total += int(np.searchsorted(left, p) - np.searchsorted(left, kept))
                    kept, left, end = p, right, right_end
                    break
            wide *= 2
    return total + int(len(left) - np.searchsorted(left, kept))


class WordCounter:
    """Counts with a tokenizer file of the tokenizers library that drops white space."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(self.tokenizer.to_str())
        # an overlap is longer than any special token, so one of its chunks holds a token there whole
        longest = max((len(t["content"]) for t in made["added_tokens"]), default=0)
        self.huge, self.chunk, self.overlap = huge, chunk, max(overlap, longest + 1)
        pieces = [p.get("pattern", {}).get("Regex") for p in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.stable = _AFTER_PIECE if KNOWN_PIECES in pieces else _AFTER_SPACE
        self.memo = Memo(self._count_words)

    def starts(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode(text, add_special_tokens=False).offsets
        return np.fromiter((a for a, _ in found), np.int64, len(found))

    def _count_words(self, keys: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(keys), _TOGETHER):
            part = keys[i : i + _TOGETHER]
            begins = np.cumsum([0, *(len(k) + 1 for k in part)])
            starts = np.sort(self.starts(" ".join(part)))
            out += np.diff(np.searchsorted(starts, begins)).tolist()
        return out

    def count(self, texts: list[str]) -> list[int]:
        lists = [None if len(t) > self.huge else words(t) for t in texts]
        known, _ = self.memo.learn([x for x in lists if x is not None])
        out = []
        for t, x in zip(texts, lists, strict=True):
            if x is not None:
                out.append(sum(map(known.__getitem__, x)))
            elif len(t) > self.huge:
                out.append(spliced_count(t, self.starts, self.chunk, self.overlap, self.stable))
            else:
                out.append(len(self.tokenizer.encode(t, add_special_tokens=False).ids))
        return out


def token_counts(df: DataFrame, path: str, limit: int = 2048, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``) of each whole text.

    A null or empty text counts 0; a very long one is counted whole, in chunks. Repeated rows stay; an empty table gives an empty one. Input columns of these names
    are replaced.
    """

    def make():
        counter = WordCounter(path)

        def run(texts):
            counts = counter.count(texts)
            return [len(t.encode("utf-8", "replace")) for t in texts], counts, [c > limit for c in counts]

        return run

    return append_columns(df, text_col, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], make, carry)
