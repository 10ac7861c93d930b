"""Script programs: ordered steps that rewrite a run's scalars, select and move its items, and apply feature stages.

A program is data on the driver. Its scalar steps act on items (value, source place, count, generated) and are plain list
folds; feature stages go through the shaper. Runs are independent rows, so a program runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from runeflow.operators.shaping import Glyph, Shaper


@dataclass
class Item:
    value: int
    offset: int
    count: int = 1
    generated: bool = False


def items_of(text: str) -> list[Item]:
    return [Item(ord(c), i) for i, c in enumerate(text)]


def replace(items: list[Item], value: int, new: tuple[int, ...]) -> list[Item]:
    """Each item of the value gives way to the new ones, which keep its source and aren't looked at again."""
    return [y for x in items for y in ([Item(v, x.offset, x.count, True) for v in new] if x.value == value else [x])]


def move_left(items: list[Item], value: int, first: int, last: int, generated: bool = True) -> list[Item]:
    """Items of the value move left over the unbroken run of values in a range before them."""
    out: list[Item] = []
    for x in items:
        at = len(out)
        if x.value == value and (x.generated or not generated):
            while at and first <= out[at - 1].value <= last:
                at -= 1
        out.insert(at, x)
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def overlapping(glyphs: list, spans: list[tuple[int, int]]) -> list[int]:
    """Places of the glyphs or items whose source meets one of the spans."""
    return [k for k, g in enumerate(glyphs) if any(a < g.offset + g.count and g.offset < b for a, b in spans)]


def move_selection(glyphs: list, moving: list[int], anchor: int | None, before: bool) -> list:
    """The moving ones, in order, right before or after the anchor; nothing to move or no anchor changes nothing."""
    if not moving or anchor is None:
        return glyphs
    if anchor in moving:
        raise ValueError("the anchor is among what moves")
    rest = [g for k, g in enumerate(glyphs) if k not in set(moving)]
    at = anchor - sum(k < anchor for k in moving) + (0 if before else 1)
    return [*rest[:at], *[glyphs[k] for k in moving], *rest[at:]]


def half_candidates(kinds: str) -> list[tuple[int, int]]:
    """Consonant and halant before another consonant, unless a non-joiner keeps the halant visible."""
    return [(m.start(1), m.end(1)) for m in re.finditer(r"(?=([rc]n?h)(?:j?[rc]))", kinds)]


def base_of(kinds: str) -> int | None:
    """The last consonant that no halant ends, walking back from the end over post-base forms without one."""
    places = [m.start() for m in re.finditer("[rcv]", kinds)]
    for k in reversed(places):
        if not re.match("[rcv]n?h", kinds[k:]):
            return k
    return places[-1] if places else None


def reph(kinds: str) -> tuple[int, int] | None:
    """A leading ra and halant before another consonant or vowel."""
    m = re.match(r"rh(?=[rcv])", kinds)
    return m.span() if m else None


@dataclass
class Program:
    """Steps in order; ``run`` applies them to a text."""

    script: str
    steps: list[tuple] = field(default_factory=list)

    def scalar_replace(self, value: int, *new: int) -> Program:
        self.steps.append(("replace", value, new))
        return self

    def scalar_move_left(self, value: int, first: int, last: int) -> Program:
        self.steps.append(("move_left", value, first, last))
        return self

    def gsub(self, *features: str, select: Callable[[list[Glyph]], list[int]] | None = None) -> Program:
        self.steps.append(("gsub", features, select))
        return self

    def move(self, select: Callable[[list[Glyph]], list[int]], anchor: Callable[[list[Glyph]], int | None], before: bool = True) -> Program:
        self.steps.append(("move", select, anchor, before))
        return self

    def gpos(self, *features: str) -> Program:
        if any(s[0] == "gpos" for s in self.steps):
            raise ValueError("a program has one positioning stage at most")
        self.steps.append(("gpos", features))
        return self

    def scalars(self, text: str) -> list[Item]:
        items = items_of(text)
        for step in self.steps:
            if step[0] == "replace":
                items = replace(items, step[1], step[2])
            elif step[0] == "move_left":
                items = move_left(items, *step[1:])
        return items

    def run(self, shaper: Shaper, text: str) -> list[Glyph]:
        buf = [Glyph(shaper.map.get(i.value, 0), i.offset, i.count) for i in self.scalars(text)]
        for kind, *args in self.steps:
            if kind == "gsub":
                for k in shaper.plan("GSUB", self.script, args[0]):
                    if args[1] is None:
                        shaper.apply("GSUB", k, buf)
                    else:
                        self._selected(shaper, k, buf, args[1])
            elif kind == "move":
                buf = move_selection(buf, args[0](buf), args[1](buf), args[2])
        for g in buf:
            g.advance = shaper.advances[g.gid] if g.gid < len(shaper.advances) else 0
        for kind, *args in self.steps:
            if kind == "gpos":
                for k in shaper.plan("GPOS", self.script, args[0]):
                    shaper.apply("GPOS", k, buf)
        shaper._resolve(buf)
        return buf

    @staticmethod
    def _selected(shaper: Shaper, k: int, buf: list[Glyph], select: Callable[[list[Glyph]], list[int]]) -> None:
        """The lookup at selected places only; the selection is made anew before each lookup and follows its edits."""
        lookup = shaper.tables["GSUB"].get(k)
        if lookup is None:
            return
        skip, places = shaper._skips(lookup), sorted(select(buf))
        shift = 0
        for p in places:
            at, size = p + shift, len(buf)
            if 0 <= at < size and not skip(buf[at].gid):
                shaper._at("GSUB", k, buf, at, skip, 0)
                shift += len(buf) - size


def thai_program() -> Program:
    """Sara am is split and its nikhahit goes before the tone marks; then the usual stages."""
    return Program("thai").scalar_replace(0x0E33, 0x0E4D, 0x0E32).scalar_move_left(0x0E4D, 0x0E48, 0x0E4B).gsub("ccmp", "locl").gsub("rlig").gpos("kern", "mark", "mkmk")


def devanagari_program(kinds: str) -> Program:
    """Stages and moves for one syllable whose kind letters are ``kinds``: half forms, then the pre-base matra before the
    first glyph, then the reph after the base."""
    halves, lead, base = half_candidates(kinds), reph(kinds), base_of(kinds)
    matras = [(m.start(), m.end()) for m in re.finditer("m", kinds)]
    at = lambda spans: lambda buf: overlapping(buf, merge_spans(spans))
    p = Program("deva").gsub("locl").gsub("nukt").gsub("akhn").gsub("rphf", select=at([lead] if lead else [])).gsub("rkrf").gsub("pref").gsub("blwf").gsub("half", select=at(halves)).gsub("pstf").gsub("vatu").gsub("cjct")
    first = (lead[1], lead[1] + 1) if lead else (0, 1)
    if matras and base is not None:
        p.move(at(matras), lambda buf: next(iter(overlapping(buf, [first])), None), True)
    if lead and base is not None and base >= lead[1]:
        p.move(at([lead]), lambda buf: next(iter(overlapping(buf, [(base, base + 1)])), None), False)
    return p.gsub("pres", "abvs", "blws", "psts", "haln", "calt").gpos("kern", "dist", "abvm", "blwm")
