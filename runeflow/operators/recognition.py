"""Classification of scalars to kinds and recognition of units over them, compiled to ``CASE`` and one regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from runeflow.functions import unicode as u


@dataclass(frozen=True)
class Classifier:
    """Ordered rules of (predicate over the code point column, kind letter); the first that holds wins."""

    rules: tuple
    default: str = "o"

    def kind(self, cp: Column) -> Column:
        out = None
        for predicate, letter in self.rules:
            out = F.when(predicate(cp), letter) if out is None else out.when(predicate(cp), letter)
        return out.otherwise(self.default) if out is not None else F.lit(self.default)

    def kinds(self, text: Column) -> Column:
        """A letter for each scalar."""
        return F.array_join(F.transform(F.split(text, ""), lambda c: self.kind(F.ascii(c))), "")


def cp(*values: int):
    return lambda c: c.isin(*values)


def span(first: int, last: int):
    return lambda c: c.between(first, last)


def has(name: str, *values: str):
    """A property predicate, by the names of its values."""
    return lambda c: u.value(name, c).isin(*values)


def both(*ps):
    def out(c):
        e = ps[0](c)
        for p in ps[1:]:
            e = e & p(c)
        return e

    return out


def either(*ps):
    def out(c):
        e = ps[0](c)
        for p in ps[1:]:
            e = e | p(c)
        return e

    return out


def negated(p):
    return lambda c: ~p(c)


# The pattern language: each builder returns a regular expression over kind letters.
def seq(*parts: str) -> str:
    return "".join(parts)


def choice(*parts: str) -> str:
    return "(?:" + "|".join(parts) + ")"


def opt(part: str) -> str:
    return f"(?:{part})?"


def many(part: str) -> str:
    if re.fullmatch(part, ""):
        raise ValueError("a repeated part must not match nothing")
    return f"(?:{part})*"


def some(part: str) -> str:
    if re.fullmatch(part, ""):
        raise ValueError("a repeated part must not match nothing")
    return f"(?:{part})+"


def role(name: str, part: str) -> str:
    return f"(?<{name}>{part})"


@dataclass
class Grammar:
    """Units in declared order; at each place the first that matches is taken, greedily, and unmatched items are skipped."""

    units: dict[str, str] = field(default_factory=dict)

    def unit(self, name: str, pattern: str) -> Grammar:
        if re.fullmatch(re.sub(r"\(\?<", "(?P<", pattern), ""):
            raise ValueError(f"unit {name} matches nothing")
        self.units[name] = pattern
        return self

    def recognise(self, kinds: Column) -> Column:
        """An array of the matched stretches of kind letters, in order."""
        whole = "|".join(f"(?:{re.sub(r'[(][?]<[A-Za-z]+>', '(?:', p)})" for p in self.units.values())
        return F.regexp_extract_all(kinds, F.lit(whole), F.lit(0))

    def unit_of(self, stretch: Column) -> Column:
        out = None
        for name, p in self.units.items():
            test = stretch.rlike("^(?:" + re.sub(r"[(][?]<[A-Za-z]+>", "(?:", p) + ")$")
            out = F.when(test, name) if out is None else out.when(test, name)
        return out.otherwise(F.lit(None).cast("string"))

    def role_text(self, stretch: Column, unit: str, name: str) -> Column:
        """What a role holds in a stretch matched by a unit."""
        pattern, names = self.units[unit], re.findall(r"[(][?]<([A-Za-z]+)>", self.units[unit])
        numbered = re.sub(r"[(][?]<[A-Za-z]+>", "(", pattern)
        return F.regexp_extract(stretch, f"^{numbered}$", names.index(name) + 1)


# Kinds of Devanagari scalars: r ra, c consonant, n nukta, h halant, j joiner, J non-joiner, v vowel, m pre-base matra,
# a above, b below, p post, x bindu, z visarga, e vedic sign, d digit or danda, o other.
DEVANAGARI = Classifier(
    (
        (cp(0x0930), "r"),
        (cp(0x093C), "n"),
        (cp(0x094D), "h"),
        (cp(0x200D), "j"),
        (cp(0x200C), "J"),
        (either(span(0x0915, 0x0939), span(0x0958, 0x095F), span(0x0978, 0x097F)), "c"),
        (either(span(0x0904, 0x0914), span(0x0960, 0x0961), span(0x0972, 0x0977)), "v"),
        (cp(0x093F, 0x094E), "m"),
        (either(span(0x0945, 0x0948), cp(0x093A, 0x0955)), "a"),
        (either(span(0x0941, 0x0944), span(0x0956, 0x0957), span(0x0962, 0x0963)), "b"),
        (either(cp(0x093B, 0x093E, 0x0940, 0x094F), span(0x0949, 0x094C)), "p"),
        (span(0x0900, 0x0902), "x"),
        (cp(0x0903), "z"),
        (either(span(0x0951, 0x0954), span(0x1CD0, 0x1CFF)), "e"),
        (span(0x0964, 0x096F), "d"),
    )
)
_CONSONANT = "[rc]n?"
_MATRAS = "[mabp]*n?h?"
_TAIL = "[xze]*"
DEVANAGARI_UNITS = (
    Grammar()
    .unit("ConsonantSyllable", seq(many(seq(_CONSONANT, "(?:h[jJ]?|J?h)")), role("base", _CONSONANT), opt("[jJ]"), role("matras", choice("h[jJ]?", _MATRAS)), role("tail", _TAIL)))
    .unit("VowelSyllable", seq(opt("rh"), role("base", "vn?"), role("matras", _MATRAS), role("tail", _TAIL)))
    .unit("StandAloneCluster", seq(role("marks", "[nhmabpxze]+")))
)

# Kinds of Thai scalars: c consonant, l leading vowel, a above, b below, t tone, m sara am, f following vowel, d digit.
THAI = Classifier(
    (
        (span(0x0E01, 0x0E2E), "c"),
        (span(0x0E40, 0x0E44), "l"),
        (cp(0x0E33), "m"),
        (either(cp(0x0E31, 0x0E47, 0x0E4C, 0x0E4D, 0x0E4E), span(0x0E34, 0x0E37)), "a"),
        (span(0x0E38, 0x0E3A), "b"),
        (span(0x0E48, 0x0E4B), "t"),
        (cp(0x0E2F, 0x0E30, 0x0E32, 0x0E45, 0x0E46), "f"),
        (span(0x0E50, 0x0E59), "d"),
    )
)


def thai_scalars(text: Column) -> Column:
    """Sara am becomes nikhahit and sara aa, and the nikhahit moves left over the tone marks before it."""
    return F.regexp_replace(text, "([่-๋]*)ำ", "ํ$1า")
