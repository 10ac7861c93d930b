"""Personal data in whole texts, plain and disguised, with spans in source characters.

Plain identifiers are found by fixed patterns. For disguised ones, transducers rewrite the text while they keep, for each
character they write, the source characters it came from: look-alike characters become the ASCII ones, spelled digits
become digits, "at" and "dot" in their disguises become marks. The same patterns run over the normalised text, and what
they find there is mapped back; a span counts as added only where it covers something that was rewritten.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each at sign: the longest run before it that is free, then the domain. A run that fails once fails from
    every later start, as the sign must follow it."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(low, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers by kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", a, b) for a, b in ips(text)]
        found += [("card", a, b) for a, b in cards(text)]
        if "+" in text:
            found += [("phone", a, b) for a, b in phones(text)]
    return found


# Characters that pass for ASCII ones, in pairs of look-alike and meaning.
_ALIKE = dict(zip("аеорсухіјѕԁһӏвкмнтАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "aeopcyxijsdhlbkmhtABEKMHOPCTYXIJSABEZHIKMNOPTYXovp", strict=True))
_ALIKE |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_ALIKE |= {chr(start + d): str(d) for start in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_ALIKE |= {"․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
_ALIKE |= dict.fromkeys("­​‌‍⁠﻿", "")
_ODD = re.compile("[" + "".join(map(re.escape, _ALIKE)) + "]")

# Spelled digits of English, German, French and Spanish, and words that double or triple the next one.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SPELLED |= {"null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
_SPELLED |= {"zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
_SPELLED |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
_TIMES = {"double": 2, "triple": 3, "doppel": 2, "dreifach": 3, "doble": 2}
_PLUS = "plus|más"
_WORDS = frozenset([*_SPELLED, *_TIMES])
_DIGIT_WORD = "|".join(sorted([*_SPELLED, *_TIMES], key=len, reverse=True))
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_DIGIT_RUN = re.compile(rf"(?<![{_LETTER}])(?:(?:{_PLUS})[ ,.-]+)?(?:{_DIGIT_WORD})(?:[ ,-]*(?:{_DIGIT_WORD}|[0-9](?![0-9A-Za-z]*[A-Za-z])))*(?![{_LETTER}])", re.I)
#: No narrower than a run of three: its first word is followed by another one or by a digit.
_SOME_DIGITS = re.compile(rf"(?<![{_LETTER}])(?:{_DIGIT_WORD})(?=[ ,-]*(?:{_DIGIT_WORD}|[0-9]))", re.I)
_DIGIT_PART = re.compile(rf"{_DIGIT_WORD}|[0-9]|{_PLUS}", re.I)

# Disguises of the at sign and the dot.
_AT_WORDS, _DOT_WORDS = ("at", "arroba", "arobase", "klammeraffe"), ("dot", "punto", "punkt", "point")
_AT_WORD, _DOT_WORD = "|".join(_AT_WORDS), "|".join(_DOT_WORDS)
_AT_IN = rf"[\[({{<][ ]*(?:{_AT_WORD}|@)[ ]*[\])}}>]"
_DOT_IN = rf"[\[({{<][ ]*(?:{_DOT_WORD}|\.)[ ]*[\])}}>]"
_WORD_DOT = rf"(?:[ ]*{_DOT_IN}[ ]*|[ ]+(?:{_DOT_WORD})[ ]+)"
_DOT = rf"(?:{_WORD_DOT}|\.)"
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_LABEL = r"[A-Za-z0-9-]+"
_TOP = r"(?:com|net|org|edu|gov|info|biz|io|dev|app|co|uk|de|fr|es|it|nl|eu|ch|at|be|pt|pl|us|ca|mx|br|ar|in|jp|cn|ru|au)"
#: A marked at with any dots; a bare one only before a domain whose dots are spelled and whose end is known; a plain sign
#: before a domain with a spelled dot.
_AT_ANY = re.compile(rf"(?P<marked>[ ]*{_AT_IN}[ ]*)|(?P<bare>[ ]+(?:{_AT_WORD})[ ]+)|(?P<plain>@)", re.I | re.A)
_AFTER = {
    "marked": re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.I | re.A),
    "bare": re.compile(rf"{_LABEL}(?:{_WORD_DOT}{_LABEL})*?{_WORD_DOT}{_TOP}(?![A-Za-z0-9-])", re.I | re.A),
    "plain": re.compile(rf"{_LABEL}(?:\.{_LABEL})*{_WORD_DOT}{_LABEL}(?:(?:[ ]*{_DOT_IN}[ ]*|\.){_LABEL}|[ ]+(?:{_DOT_WORD})[ ]+{_TOP}(?![A-Za-z0-9-]))*", re.I | re.A),
}
_MARKS = re.compile(_WORD_DOT, re.I | re.A)
#: Every disguised mail has one of these in it, whatever the spaces.
_DISGUISED = re.compile(rf"{_AT_IN}|{_DOT_IN}", re.I | re.A)
_SPACED = re.compile(rf"[ ](?:{_DOT_WORD})[ ]", re.I | re.A)
#: Where no identifier reaches across, plain or disguised: a character that is in no pattern, or the space between two
#: plain words, as patterns take spaces only beside digits, marks and the words above.
_SAID = "|".join(sorted({*_WORDS, *_AT_WORDS, *_DOT_WORDS, *_PLUS.split("|")}, key=len, reverse=True))
_PLAIN_WORD = rf"(?!(?:{_SAID})[ \n])[A-Za-z]+"
_CUT = re.compile(rf"[\n;!?\"'/\\|=*#&:~^`$]|(?<![^ \n]){_PLAIN_WORD}[ ](?={_PLAIN_WORD}[ \n])", re.I | re.A)
#: Characters that are looked through for a cut at a time.
_LOOK = 400


class Tape:
    """A text and, for each of its characters, the source characters it stands for and whether it was rewritten."""

    def __init__(self, text: str, start: int = 0):
        self.text = text
        self.start = list(range(start, start + len(text)))
        self.end = [i + 1 for i in self.start]
        self.changed = [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replaces the ranges of ``edits`` (in order, not overlapping); what is written stands for the whole range."""
        if not edits:
            return self
        out, at, text = Tape(""), 0, []
        for a, b, new in edits:
            self._copy(out, text, at, a)
            if new and b > a:
                text.append(new)
                out.start += [self.start[a]] * len(new)
                out.end += [self.end[b - 1]] * len(new)
                out.changed += [True] * len(new)
            at = b
        self._copy(out, text, at, len(self.text))
        out.text = "".join(text)
        return out

    def _copy(self, out: Tape, text: list[str], a: int, b: int) -> None:
        text.append(self.text[a:b])
        out.start += self.start[a:b]
        out.end += self.end[a:b]
        out.changed += self.changed[a:b]


def alike(tape: Tape) -> Tape:
    return tape.rewrite([(m.start(), m.end(), _ALIKE[m[0]]) for m in _ODD.finditer(tape.text)])


def spelled(tape: Tape) -> Tape:
    edits = []
    for m in _DIGIT_RUN.finditer(tape.text):
        out, times, words = [], 1, 0
        for part in _DIGIT_PART.findall(m[0].lower()):
            if part in ("plus", "más"):
                out.append("+")
            elif part in _TIMES:
                times = _TIMES[part]
                words += 1
            else:
                out.append(_SPELLED.get(part, part) * times)
                words += part in _SPELLED
                times = 1
        if words >= 3:
            edits.append((m.start(), m.end(), "".join(out)))
    return tape.rewrite(edits)


def _name_before(text: str, at: int, low: int, dots: dict[int, int], plain_dots: bool) -> list[tuple[int, int]] | None:
    """The spelled dots (by their ends in ``dots``) in the name that ends at ``at``; None if there is no name."""
    found, k = [], at
    while True:
        start = k
        while k > low and text[k - 1] in _NAME:
            k -= 1
        if k == start:  # nothing before this dot: it isn't the name's
            return found[:-1] if found and found[-1][0] == k else (found if k < at else None)
        if plain_dots and k - 1 > low and text[k - 1] == ".":
            k -= 1
        elif dots.get(k, -1) > low:
            found.append((dots[k], k))
            k = dots[k]
        else:
            return found


def marks(tape: Tape) -> Tape:
    """Spelled at signs and dots of mail addresses become signs: around each at, the name before and the domain after."""
    text, edits, low = tape.text, [], 0
    dots = {m.end(): m.start() for m in _MARKS.finditer(text)}
    for m in _AT_ANY.finditer(text):
        if m.start() < low:
            continue
        domain = _AFTER[m.lastgroup].match(text, m.end())
        name = _name_before(text, m.start(), low, dots, m.lastgroup != "bare") if domain else None
        if name is not None:
            inside = [*name, *(x.span() for x in _MARKS.finditer(text, *domain.span()))]
            edits += sorted([*((a, b, ".") for a, b in inside), (m.start(), m.end(), "@")])
            low = domain.end()
    return tape.rewrite([e for e in edits if text[e[0] : e[1]] != e[2]])


def _reached(text: str, a: int, b: int) -> tuple[int, int]:
    """The range between the nearest cuts around ``a`` to ``b``, however far away they are."""
    look, start = _LOOK, 0
    while True:
        low = max(0, a - look)
        # a word that begins before ``low`` doesn't show there, so the cuts found are real ones
        ends = [m.end() for m in _CUT.finditer(text, low, min(len(text), a + 80)) if m.end() <= a]
        if ends or not low:
            start = ends[-1] if ends else 0
            break
        look *= 4
    cut = _CUT.search(text, b)
    return start, cut.end() if cut else len(text)


def _windows(text: str) -> list[tuple[int, int]]:
    """Where transducers have anything to do: around each trigger as far as an identifier can reach, joined if they touch."""
    low = text.lower()
    hits = [m.span() for m in _DISGUISED.finditer(text)] if any(c in text for c in "[({<") else []
    if any(w in low for w in _DOT_WORDS):
        hits += [m.span() for m in _SPACED.finditer(text)]
    if not text.isascii():
        hits += [m.span() for m in _ODD.finditer(text)]
    if any(w in low for w in _WORDS):
        hits += [m.span() for m in _SOME_DIGITS.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and b <= out[-1][1]:
            continue
        a, b = _reached(text, a, b)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def added_spans(text: str, windows: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Disguised identifiers, in source characters."""
    out = set()
    for a, b in _windows(text) if windows is None else windows:
        tape = marks(spelled(alike(Tape(text[a:b], a))))
        if any(tape.changed):
            for kind, s, e in base_spans(tape.text):
                if any(tape.changed[s:e]):
                    out.add((kind, tape.start[s], tape.end[e - 1]))
    return sorted(out)


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added ones; both by kind as listed, then start, then end."""
    base = base_spans(text)
    extra = [x for x in added_spans(text) if x not in set(base)]
    return base, sorted([*base, *extra], key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if extra else base


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or each group of overlapping ones, replaced by its first kind in brackets."""
    out, at, last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < last:
            at = last = max(last, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = last = b
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (plain ones), ``base_sha256`` and ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind as listed and then start, comma-joined; the digest
    is over the plain ones. A null or empty text has none; a very long text, or a very long identifier, is read whole.
    Of matches of a kind that overlap the leftmost counts. Repeated rows stay; an empty table gives an empty one; input
    columns of these names are replaced.
    """

    def make():
        def run(texts):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans = [], []
            for t in texts:
                base, every = all_spans(t)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            return [*counts.values(), digests, spans]

        return run

    fields = [(f"n_{k}", T.LongType()) for k in KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType())]
    return append_columns(df, text_col, fields, make, carry)


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of ``text_col``, plain or disguised, replaced by its kind in brackets; null stays null, and
    all other columns, whatever their names, stay as they are."""
    from pyspark.sql import functions as F

    def make():
        return lambda texts: [[redacted(t, all_spans(t)[1]) for t in texts]]

    name = "__redacted"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    out = append_columns(df, text_col, [(name, T.StringType())], make)
    return out.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.col(name)).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
