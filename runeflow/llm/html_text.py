"""Main text of web pages by wrappers that are inferred from the pages of a host.

A page is a stream of tokens: block elements' opening and closing tags, and a slot for each run of text. Runs of equal
neighbours are folded to repeated groups. A host's streams are aligned one after the other: what both have stays, what
one lacks becomes an optional group, and a group that repeats in one stream takes in its single instances in the other;
no alternatives are ever written, so the wrapper is a union-free expression. Each page is then matched against its
host's wrapper, which gives every block the slot it stands in. What a slot shows on nearly every page is fixed and left
out, inside an article too; what varies is text, unless its place is that of something else (a footer, say).

Streams are counted where they arise, so a host sends each distinct folded stream once a batch, however many its pages;
wrappers of parts of a host are aligned with each other in the same way as streams. What slots show is counted exactly,
by hashes of the texts, so neither the number of pages nor their batches matter.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written
from .graph import measured, weighed

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "math")}
_NUMBER = re.compile(r"[0-9]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")

# Elements inside a line of text, without content, and those whose start ends an open one like it.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Elements and names of what isn't the article.
ASIDE = frozenset("head nav footer aside form button select option dialog menu fieldset object audio video canvas".split())
CONTENT = frozenset(("article", "main"))
NAMES = re.compile(r"(?:^|[-_.])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri\w*|signup|sidebar|side|menu|nav\w*|breadcrumbs?|header|masthead|topbar|footer|foot|copyright|legal|comments?|disqus|repl(?:y|ies)|respond|shar(?:e|ing)|social|related|recommend\w*|widget|toolbar|login|search|pag(?:er|ination)|skip|navigation|contentinfo|complementary|alert)(?:$|[-_.])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SLOT = "#"
#: Longest run of tokens that is looked at as a repeated group.
LONGEST_GROUP = 24
#: Shapes of a host that a task aligns.
TOGETHER = 32


@dataclass
class Block:
    path: tuple[str, ...]
    text: list[str] = field(default_factory=list)
    linked: int = 0


def _key(tag: str, attributes: str) -> str:
    """The element's name with what its class, id and role say, numbers left out; ``!`` marks hidden ones."""
    if not attributes or attributes.isspace():
        return tag
    names, hidden = [], ""
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind in ("class", "id", "role"):
            names += _NUMBER.sub("", value.lower()).split()
        elif kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true") or (kind == "style" and HIDDEN.search(value)):
            hidden = "!"
    return hidden + ".".join([tag, *sorted(set(names))])


def parse(page: str) -> tuple[list[str], list[Block]]:
    """The page's stream of tokens, and a block for each slot in it, in order."""
    stream: list[str] = []
    blocks: list[Block] = []
    stack: list[str] = []
    open_block: Block | None = None
    at, links = 0, 0

    def text(piece: str) -> None:
        nonlocal open_block
        if open_block is None:
            if not piece or piece.isspace():
                return
            open_block = Block(tuple(stack))
            blocks.append(open_block)
            stream.append(SLOT)
        open_block.text.append(html.unescape(piece) if "&" in piece else piece)
        if links:
            open_block.linked += len(piece)

    def close(k: int) -> None:
        nonlocal open_block
        open_block = None
        while len(stack) > k:
            stream.append("/" + stack.pop())

    def pop(names: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            tag = stack[k].lstrip("!").split(".")[0]
            if tag in names:
                close(k)
                return
            if tag in ("table", "ul", "ol", "dl", "div", "article", "section", "main", "body"):
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""
        if ending:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and tag not in VOID:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].lstrip("!").split(".")[0] == tag:
                        close(k)
                        break
                else:
                    open_block = None
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end()
            continue
        if tag == "br":
            text(" ") if open_block is not None else None
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        open_block = None
        if tag in ENDS_P:
            pop({"p"})
        if tag in CLOSES:
            pop(CLOSES[tag])
        if tag in VOID:
            continue
        links = 0
        if tag not in ("html", "body"):
            stack.append(_key(tag, attributes))
            stream.append(stack[-1])
    close(0)
    return stream, blocks


def _together(owned: list[list[list]], length: int) -> list[list]:
    """What the slots of repeated units of ``length`` elements hold, put together by slot."""
    units = [[x for e in owned[k : k + length] for x in e] for k in range(0, len(owned), length)]
    return [[x for part in parts for x in part] for parts in zip(*units, strict=True)]


def fold(stream: list, owned: list | None = None) -> list:
    """Equal neighbours, single tokens or runs, become repeated groups: tuples that begin with ``+``.

    ``owned`` lists for each element, by its slots, the blocks that they hold; it is folded likewise, in place.
    """
    for length in range(1, LONGEST_GROUP + 1):
        i, out, kept = 0, [], []
        while i < len(stream):
            unit = stream[i : i + length]
            j = i + length
            while len(unit) == length and stream[j : j + length] == unit:
                j += length
            if j > i + length:
                body = unit[0] if length == 1 and isinstance(unit[0], tuple) and unit[0][0] == "+" else ("+", *unit)
                out.append(body)
                if owned is not None:
                    kept.append(_together(owned[i:j], length))
                i = j
            else:
                out.append(stream[i])
                if owned is not None:
                    kept.append(owned[i])
                i += 1
        stream = out
        if owned is not None:
            owned[:] = kept
    return stream


def _bodies(stream: list | tuple) -> list[tuple]:
    out = []
    for x in stream:
        if isinstance(x, tuple):
            out += _bodies(x[1:])
            if x[0] == "+":
                out.append(x)
    return out


def refold(stream: list, groups: list[tuple], owned: list | None = None) -> list:
    """Single instances of the repeated ``groups`` become those groups; ``owned`` as in ``fold``."""
    for g in groups:
        body, i, out, kept = list(g[1:]), 0, [], []
        while i < len(stream):
            once = stream[i : i + len(body)] == body
            again = bool(out) and out[-1] == g and (once or stream[i] == g)
            n = len(body) if once else 1
            if owned is not None:
                held = [x for e in owned[i : i + n] for x in e]
                if again:
                    kept[-1] = _together([kept[-1], held], 1)
                else:
                    kept.append(held)
            if not again:
                out.append(g if once else stream[i])
            i += n
        stream = out
        if owned is not None:
            owned[:] = kept
    return stream


def _bare(x):
    """A token without its optional mark."""
    return x[1:] if isinstance(x, tuple) and x[0] == "?" else (x,)


def align(a: list, b: list) -> list:
    """The union-free expression that takes in both: common tokens stay, the rest is optional."""
    if a == b:
        return a
    groups = sorted({g: None for g in [*_bodies(a), *_bodies(b)]}, key=lambda g: (len(g), str(g)))
    a, b = refold(list(a), groups), refold(list(b), groups)
    if a == b:
        return a
    left, right = [_bare(x) for x in a], [_bare(x) for x in b]
    out: list = []
    i = j = 0
    for x, y in [*sorted(_common(left, right)), (len(a), len(b))]:
        out += [("?", *t) for t in (*left[i:x], *right[j:y])]
        if x < len(a):
            optional = any(isinstance(t, tuple) and t[0] == "?" for t in (a[x], b[y]))
            out.append(("?", *left[x]) if optional else a[x])
        i, j = x + 1, y + 1
    return out


def _slots(x) -> int:
    """Slots in a token or group."""
    return sum(map(_slots, x)) if isinstance(x, tuple) else int(x == SLOT)


class Wrapper:
    """A host's wrapper, to match pages against."""

    def __init__(self, tokens: list):
        self.groups = _bodies(tokens)
        self.bare = [_bare(x) for x in tokens]
        self.first = [0]
        for x in self.bare:
            self.first.append(self.first[-1] + _slots(x))

    def places(self, stream: list[str]) -> list[int]:
        """For each block of a page's stream its slot in the wrapper, -1 where the wrapper has none."""
        owned, blocks = [], 0
        for x in stream:
            owned.append([[blocks]] if x == SLOT else [])
            blocks += x == SLOT
        page = fold(list(stream), owned)
        groups = sorted({g: None for g in [*self.groups, *_bodies(page)]}, key=lambda g: (len(g), str(g)))
        left, right = [(x,) for x in refold(page, groups, owned)], self.bare
        out = [-1] * blocks
        for i, j in _common(left, right):
            for k, held in enumerate(owned[i]):
                for block in held:
                    out[block] = self.first[j] + k
        return out


def _common(left: list, right: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence."""
    low, n, m = 0, len(left), len(right)
    while low < n and low < m and left[low] == right[low]:
        low += 1
    while n > low and m > low and left[n - 1] == right[m - 1]:
        n, m = n - 1, m - 1
    out = [(k, k) for k in range(low)] + [(n + k, m + k) for k in range(len(left) - n)]
    a, b = left[low:n], right[low:m]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((low + i, low + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _boilerplate(path: tuple[str, ...]) -> bool:
    inside = False
    for key in path:
        if key.startswith("!"):
            return True
        tag, _, names = key.partition(".")
        inside = inside or tag in CONTENT
        if tag in ASIDE or (tag == "header" and not inside) or (names and any(NAMES.search(x) for x in names.split("."))):
            return True
    return False


def _content(path: tuple[str, ...]) -> bool:
    return any(key.partition(".")[0] in CONTENT for key in path)


def _has_content(stream: list[str]) -> bool:
    """Whether a page has an article or main element, with text or without, that isn't part of something else."""
    path: list[str] = []
    for x in stream:
        if x.startswith("/"):
            path.pop()
        elif x != SLOT:
            path.append(x)
            if x.partition(".")[0] in CONTENT and not _boilerplate(tuple(path)):
                return True
    return False


def chosen(stream: list[str], blocks: list[Block]) -> tuple[str, list[int]]:
    """Where the page's text may be, and the blocks there: inside its article or main elements if it has any, else all.

    What is marked as something else is never among them. Each page decides for itself, whatever others of its host have.
    """
    open_blocks = [k for k, b in enumerate(blocks) if not _boilerplate(b.path)]
    inside = [k for k in open_blocks if _content(blocks[k].path)]
    return ("c", inside) if inside or _has_content(stream) else ("o", open_blocks)


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


class Reader:
    """Pages read by their hosts' wrappers. Wrappers and places are remembered, up to a bound."""

    def __init__(self):
        self.wrappers: dict[str, Wrapper] = {}
        self.memo: dict[tuple, list[int]] = {}
        self.held = self.tokens = 0

    def wrapper(self, text: str) -> Wrapper:
        if text not in self.wrappers:
            if self.held + len(text) > 4_000_000:
                self.wrappers.clear()
                self.held = 0
            self.wrappers[text] = Wrapper(_load(text))
            self.held += len(text)
        return self.wrappers[text]

    def read(self, page: str, wrapper: str) -> list[tuple[str, str, Block]]:
        """(slot, text, block) of the page's chosen blocks, white space made single, in page order."""
        stream, blocks = parse(page)
        where, some = chosen(stream, blocks)
        if not some:
            return []
        key = (wrapper, *stream)
        if key not in self.memo:
            if self.tokens + len(key) > 1_000_000:
                self.memo.clear()
                self.tokens = 0
            self.memo[key] = self.wrapper(wrapper).places(stream)
            self.tokens += len(key)
        places, out = self.memo[key], []
        for k in some:
            text = " ".join("".join(blocks[k].text).split())
            if text:
                # a block that the wrapper has no slot for goes by its path
                slot = f"{where}{places[k]}" if places[k] >= 0 else f"{where}:{text_key(_dump(list(blocks[k].path))):x}"
                out.append((slot, text, blocks[k]))
        return out


def _dump(stream: list) -> str:
    return json.dumps(stream, separators=(",", ":"), ensure_ascii=False)


def _load(text: str) -> list:
    def tuples(x):
        return tuple(map(tuples, x)) if isinstance(x, list) else x

    return [tuples(x) for x in json.loads(text)]


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


#: A text is fixed if so many tenths of the pages with its slot show it there; fewer pages than MOST_FEW prove nothing.
FIXED, MOST_FEW = 9, 5


def wrappers(pages: DataFrame) -> DataFrame:
    """A written table: host, wrapper (JSON) for the hosts of ``pages`` (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                shapes: dict[tuple[str, str], int] = {}
                for host, t in zip(hosts[a:b], texts[a:b], strict=True):
                    key = (host, _dump(fold(parse(t)[0])))
                    shapes[key] = shapes.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in shapes], pa.string()), pa.array([s for _, s in shapes], pa.string()), pa.array(shapes.values(), pa.int64())], names=["host", "shape", "n"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, shape string, n long")
    seen = seen.groupBy("host", "shape").agg(F.sum("n").alias("n"))

    def align_all(group: pa.Table) -> pa.Table:
        order = sorted(zip(group.column("n").to_pylist(), group.column("shape").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
        wrapper = _load(order[0][1])
        for _, shape in order[1:]:
            wrapper = fold(align(wrapper, _load(shape)))
        return pa.table({"host": group.column("host").slice(0, 1), "shape": pa.array([_dump(wrapper)]), "n": pa.array([sum(n for n, _ in order)], pa.int64())})

    rows = written(seen, "shapes")
    while True:
        # a task aligns a few of a host's shapes, and what it makes of them is aligned with others' in the next round
        counts = rows.groupBy("host").agg(F.count("*").alias("k"))
        if not counts.where("k > 1").limit(1).count():
            return written(rows.select("host", F.col("shape").alias("wrapper")), "wrappers")
        part = F.pmod(F.xxhash64("shape"), F.ceil(F.col("k") / TOGETHER))
        parts = rows.join(measured(written(counts, "counts")), "host").select("host", "shape", "n", part.alias("part"))
        made = parts.groupBy("host", "part").applyInArrow(lambda t: align_all(t), "host string, shape string, n long")
        rows = written(made.groupBy("host", "shape").agg(F.sum("n").alias("n")), "shapes")


def left_out(pages: DataFrame) -> DataFrame:
    """(host, leave): slots and fixed texts (``slot=hash``) that are not text, for ``pages`` (host, html, wrapper)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            hosts, texts, shapes = (batch.column(k).to_pylist() for k in range(3))
            for a, b in slices(texts):
                counts: dict[tuple[str, str, int | None], list[int]] = {}
                for host, page, shape in zip(hosts[a:b], texts[a:b], shapes[a:b], strict=True):
                    once = set()
                    for slot, text, block in reader.read(page or "", shape or "[]"):
                        for key in ((host, slot, None), (host, slot, text_key(text))):
                            c = counts.setdefault(key, [0, 0, 0, 0])
                            c[0] += key not in once
                            c[1] += 1
                            once.add(key)
                            if key[2] is None:
                                c[2] += sum(map(len, block.text))
                                c[3] += block.linked
                cols = [*zip(*counts, strict=True)] or [[]] * 3
                cols += [*zip(*counts.values(), strict=True)] or [[]] * 4
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "slot", "text", "pages", "blocks", "chars", "linked"])

    sums = ("pages", "blocks", "chars", "linked")
    seen = pages.select("host", "html", "wrapper").mapInArrow(run, "host string, slot string, text long, pages long, blocks long, chars long, linked long")
    seen = written(seen.groupBy("host", "slot", "text").agg(*[F.sum(c).alias(c) for c in sums]), "slots")
    whole = seen.where("text IS NULL").select("host", "slot", "pages", "chars", "linked")
    often = seen.where(F.col("text").isNotNull() & (F.col("pages") >= MOST_FEW)).select("host", "slot", "text", F.col("pages").alias("shown"))
    fixed = whole.where(F.col("pages") >= MOST_FEW).join(often, ["host", "slot"]).where(F.col("shown") * 10 >= F.col("pages") * FIXED)
    out = fixed.select("host", F.concat_ws("=", "slot", F.col("text").cast("string")).alias("what"))
    links = F.col("slot").startswith("o") & (2 * F.col("linked") > F.col("chars"))
    out = out.unionByName(whole.where(links).select("host", F.col("slot").alias("what")))
    return written(out.groupBy("host").agg(F.array_sort(F.collect_set("what")).alias("leave")), "leave")


def extract(blocks: list[tuple[str, str, Block]], leave: frozenset[str]) -> str:
    """The texts of a page's blocks, less what is to be left out; a page that shows nothing else keeps its text."""
    kept = [t for s, t, _ in blocks if s not in leave and f"{s}={text_key(t)}" not in leave]
    return " ".join(kept or [t for s, t, _ in blocks if s not in leave] or [t for _, t, _ in blocks])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty page has the empty text; a very long one is read whole. A null or odd url counts as the host without
    name. Of equally frequent texts of a slot none is fixed. Repeated rows stay; an empty table gives an empty one; other
    columns, whatever their names, are left out.
    """
    find = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), find, 1)).alias("host"), F.col(f"`{html_col}`").alias("html"))
    known = wrappers(source)
    leave = left_out(source.join(weighed(known, F.octet_length("wrapper")), "host", "left"))
    known = written(known.join(leave, "host", "left"), "known")
    size = F.octet_length("wrapper") + F.coalesce(F.octet_length(F.concat_ws("", "leave")), F.lit(0))
    joined = source.join(weighed(known, size), "host", "left").select("page_id", "url", "html", "wrapper", "leave")
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sets = Reader(), {}
        for batch in batches:
            texts, shapes, leaves = (batch.column(k).to_pylist() for k in range(2, 5))
            for a, b in slices(texts):
                out = []
                for page, shape, leave in zip(texts[a:b], shapes[a:b], leaves[a:b], strict=True):
                    key = tuple(leave or ())
                    if key not in sets:
                        if len(sets) > 1_000:
                            sets.clear()
                        sets[key] = frozenset(key)
                    out.append(extract(reader.read(page or "", shape or "[]"), sets[key]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, schema)
