"""Memoised encoding: a text is cut at places where no tokenizer rule reaches across, and each distinct piece is encoded once.

A cut stands before a single space that has characters other than white space on both sides. The byte-level patterns
attach such a space to what follows and never look further back, and the word-level one drops it, so the pieces'
tokens, one after the other, are those of the whole text. A text in which any space has white space beside it, or which
holds a special token's opening, is left to the caller's whole-text path.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Before the first piece of a text, which had no space before it.
FIRST = "\0"
#: White space to Python that is none to the tokenizers.
_ODD = re.compile("[\x1c-\x1f]")


def words(text: str) -> list[str] | None:
    """The pieces between any white space, for tokenizers that drop it; None where cuts aren't proven."""
    if "<|" in text or _ODD.search(text):
        return None
    return text.split()


def unproven(piece: str) -> bool:
    """Whether a cut beside this piece isn't proven: it is empty, has white space at an end, or opens a special token."""
    body = piece[1:] if piece[:1] == FIRST else piece
    return not body or body[0].isspace() or body[-1].isspace() or "<|" in body


def spaced(piece: str) -> str:
    """The text that a piece stands for."""
    return piece[1:] if piece[:1] == FIRST else f" {piece}"


class Memo:
    """Values of pieces by key in two generations, of which the older goes when the younger is full: at most ``most`` entries."""

    def __init__(self, encode_many: Callable[[list[str]], list], most: int = 1_000_000):
        self.encode_many, self.half, self.known, self.old = encode_many, most // 2, {}, {}

    def learn(self, lists: list[list], refused: Callable[[str], bool] | None = None) -> tuple[dict, set]:
        """Makes the pieces of ``lists`` known; returns the table and the new pieces that were refused."""
        new = set().union(*lists).difference(self.known) if lists else set()
        bad = {k for k in new if refused(k)} if refused else set()
        new -= bad
        if len(self.known) + len(new) > self.half:
            self.old, self.known = self.known, {}
            new = set().union(*lists) - bad
        known, old = self.known, self.old
        if old and new:
            again = [k for k in new if k in old]
            for k in again:
                known[k] = old[k]
            new.difference_update(again)
        if new:
            keys = list(new)
            known.update(zip(keys, self.encode_many(keys), strict=True))
        return known, bad


def cut_texts(texts: list[str], memo: Memo) -> tuple[list[list[str] | None], dict]:
    """Each text's pieces, None for texts to be encoded whole, and the table in which all pieces are known."""
    lists: list[list[str] | None] = []
    for t in texts:
        if not t or FIRST in t:
            lists.append(None)
        else:
            x = t.split(" ")
            x[0] = FIRST + x[0]
            lists.append(x)
    known, bad = memo.learn([x for x in lists if x is not None], unproven)
    if bad:
        lists = [None if x is not None and not bad.isdisjoint(x) else x for x in lists]
    return lists, known
