"""Embedding levels of paragraphs by the Unicode bidirectional algorithm, and the visual order of runs.

The rules keep a stack and look both ways over isolating run sequences, which no built-in expression can say, so they run
in Arrow batches, a paragraph a row. Rules P1 to P3, X1 to X10, W1 to W7, N0 to N2, I1 and I2 are applied; levels of trailing
white space are not reset, and no mirroring is done. A text whose characters are all of left-to-right, neutral or
European classes in a left-to-right paragraph has level 0 throughout and is answered without the rules.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runeflow.functions import unicode as u
from runeflow.operators import text

DEEPEST = 125
PAIRS = 63
_REMOVED = frozenset(("RLE", "LRE", "RLO", "LRO", "PDF", "BN"))
_ISOLATES = frozenset(("LRI", "RLI", "FSI"))
_NEUTRAL = frozenset(("B", "S", "WS", "ON", "LRI", "RLI", "FSI", "PDI"))
_SIMPLE = frozenset(("L", "EN", "ES", "ET", "CS", "NSM", "BN", "WS", "S", "ON"))
# Opening and closing brackets, in order, and the two pairs that are equal to others by canonical equivalence.
_OPEN = "([{༺༼᚛⁅⁽₍⌈⌊\u2329❨❪❬❮❰❲❴⟅⟦⟨⟪⟬⟮⦃⦅⦇⦉⦋⦍⦏⦑⦓⦕⦗⧘⧚⧼⸢⸤⸦⸨⹕⹗⹙⹛〈《「『【〔〖〘〚﹙﹛﹝（［｛｟｢"
_CLOSE = ")]}༻༽᚜⁆⁾₎⌉⌋\u232A❩❫❭❯❱❳❵⟆⟧⟩⟫⟭⟯⦄⦆⦈⦊⦌⦐⦎⦒⦔⦖⦘⧙⧛⧽⸣⸥⸧⸩⹖⹘⹚⹜〉》」』】〕〗〙〛﹚﹜﹞）］｝｠｣"
_SAME = {0x2329: 0x3008, 0x232A: 0x3009}
_PARTNER = {ord(a): _SAME.get(ord(b), ord(b)) for a, b in zip(_OPEN, _CLOSE, strict=True)}
_CLOSING = {ord(b): _SAME.get(ord(b), ord(b)) for b in _CLOSE}
# The classes by the library's numbers.
CLASSES = "L R EN ES ET AN CS B S WS ON LRE LRO AL RLE RLO PDF NSM BN FSI LRI RLI PDI".split()


def paragraph_level(types: list[str], start: int = 0, stop: int | None = None, default: int = 0) -> int:
    """P2, P3: by the first strong character outside isolates."""
    depth = 0
    for t in types[start:stop]:
        if t in _ISOLATES:
            depth += 1
        elif t == "PDI":
            depth = max(0, depth - 1)
        elif not depth and t in ("L", "R", "AL"):
            return int(t != "L")
    return default


def _matches(types: list[str]) -> dict[int, int]:
    """Isolate initiators to their PDIs."""
    stack, out = [], {}
    for i, t in enumerate(types):
        if t in _ISOLATES:
            stack.append(i)
        elif t == "PDI" and stack:
            out[stack.pop()] = i
    return out


def _explicit(types: list[str], base: int, match: dict[int, int]) -> tuple[list[int], list[str]]:
    """X1 to X8: levels and types after overrides."""
    levels, out = [base] * len(types), list(types)
    stack: list[tuple[int, str | None, bool]] = [(base, None, False)]
    over_isolates = over_embeddings = valid = 0
    closing = set(match.values())
    for i, t in enumerate(types):
        level, override, _ = stack[-1]
        odd, even = (level + 1) | 1, (level + 2) & ~1
        if t in ("RLE", "LRE", "RLO", "LRO"):
            new = odd if t[0] == "R" else even
            levels[i] = level
            if new <= DEEPEST and not over_isolates and not over_embeddings:
                stack.append((new, {"RLO": "R", "LRO": "L"}.get(t), False))
            elif not over_isolates:
                over_embeddings += 1
        elif t in _ISOLATES:
            levels[i] = level
            if override:
                out[i] = override
            right = t == "RLI" or (t == "FSI" and paragraph_level(types, i + 1, match.get(i)))
            new = odd if right else even
            if new <= DEEPEST and not over_isolates and not over_embeddings:
                valid += 1
                stack.append((new, None, True))
            else:
                over_isolates += 1
        elif t == "PDI":
            if over_isolates:
                over_isolates -= 1
            elif valid and (i in closing or valid):
                over_embeddings = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                valid -= 1
            levels[i] = stack[-1][0]
            if stack[-1][1]:
                out[i] = stack[-1][1]
        elif t == "PDF":
            levels[i] = level
            if not over_isolates:
                if over_embeddings:
                    over_embeddings -= 1
                elif not stack[-1][2] and len(stack) > 1:
                    stack.pop()
        elif t == "B":
            levels[i] = base
        else:
            levels[i] = level
            if t != "BN" and override:
                out[i] = override
    return levels, out


def _sequences(types: list[str], levels: list[int], base: int, match: dict[int, int]) -> list[tuple[list[int], str, str]]:
    """X10: isolating run sequences of what is not removed, with the types at their ends."""
    live = [i for i, t in enumerate(types) if t not in _REMOVED]
    runs: list[list[int]] = []
    for i in live:
        if runs and levels[runs[-1][-1]] == levels[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    by_first = {r[0]: k for k, r in enumerate(runs)}
    back = {p: i for i, p in match.items()}
    out, where = [], {x: k for k, x in enumerate(live)}
    for r in runs:
        if types[r[0]] == "PDI" and r[0] in back:
            continue
        seq = list(r)
        while types[seq[-1]] in _ISOLATES and seq[-1] in match and match[seq[-1]] in by_first:
            seq += runs[by_first[match[seq[-1]]]]
        level = levels[seq[0]]
        a, b = where[seq[0]], where[seq[-1]]
        before = levels[live[a - 1]] if a else base
        after = base if b + 1 == len(live) or (types[seq[-1]] in _ISOLATES and seq[-1] not in match) else levels[live[b + 1]]
        out.append((seq, "R" if max(level, before) % 2 else "L", "R" if max(level, after) % 2 else "L"))
    return out


def _weak(seq: list[int], t: list[str], sos: str) -> None:
    last = sos
    for i in seq:  # W1
        if t[i] == "NSM":
            t[i] = "ON" if last in (*_ISOLATES, "PDI") else last
        last = t[i]
    strong = sos
    for i in seq:  # W2
        if t[i] in ("L", "R", "AL"):
            strong = t[i]
        elif t[i] == "EN" and strong == "AL":
            t[i] = "AN"
    for i in seq:  # W3
        if t[i] == "AL":
            t[i] = "R"
    for k in range(1, len(seq) - 1):  # W4
        a, x, b = t[seq[k - 1]], t[seq[k]], t[seq[k + 1]]
        if a == b and ((x == "ES" and a == "EN") or (x == "CS" and a in ("EN", "AN"))):
            t[seq[k]] = a
    k = 0
    while k < len(seq):  # W5
        if t[seq[k]] == "ET":
            e = k
            while e < len(seq) and t[seq[e]] == "ET":
                e += 1
            if (k and t[seq[k - 1]] == "EN") or (e < len(seq) and t[seq[e]] == "EN"):
                for x in seq[k:e]:
                    t[x] = "EN"
            k = e
        else:
            k += 1
    for i in seq:  # W6
        if t[i] in ("ET", "ES", "CS"):
            t[i] = "ON"
    strong = sos
    for i in seq:  # W7
        if t[i] in ("L", "R"):
            strong = t[i]
        elif t[i] == "EN" and strong == "L":
            t[i] = "L"


def bracket_pairs(seq: list[int], t: list[str], chars: str) -> list[tuple[int, int]]:
    """BD16 over a sequence: places in it of each pair, by the opening one."""
    stack: list[tuple[int, int]] = []
    out = []
    for k, i in enumerate(seq):
        c = ord(chars[i])
        if t[i] != "ON":
            continue
        if c in _PARTNER:
            if len(stack) == PAIRS:
                return []
            stack.append((_PARTNER[c], k))
        elif c in _CLOSING:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == _CLOSING[c]:
                    out.append((stack[n][1], k))
                    del stack[n:]
                    break
    return sorted(out)


def _neutral(seq: list[int], t: list[str], original: list[str], text: str, level: int, sos: str, eos: str) -> None:
    own = "R" if level % 2 else "L"
    side = lambda x: "R" if x in ("R", "EN", "AN") else "L" if x == "L" else None
    for a, b in bracket_pairs(seq, t, text):  # N0
        inside = {side(t[i]) for i in seq[a + 1 : b]} - {None}
        if not inside:
            continue
        new = own
        if own not in inside:
            before = next((side(t[i]) for i in reversed(seq[:a]) if side(t[i])), sos)
            new = before if before != own else own
        for k in (a, b):
            t[seq[k]] = new
            for i in seq[k + 1 :]:
                if original[i] != "NSM":
                    break
                t[i] = new
    k = 0
    while k < len(seq):  # N1, N2
        if t[seq[k]] in _NEUTRAL:
            e = k
            while e < len(seq) and t[seq[e]] in _NEUTRAL:
                e += 1
            before = side(t[seq[k - 1]]) if k else sos
            after = side(t[seq[e]]) if e < len(seq) else eos
            for i in seq[k:e]:
                t[i] = before if before == after else own
            k = e
        else:
            k += 1


def levels_of(text: str, direction: str = "auto", types: list[str] | None = None) -> tuple[int, list[int]]:
    """Paragraph level and the level of each scalar of one paragraph, by the classes given, else those that Python knows."""
    types = [unicodedata.bidirectional(c) or "L" for c in text] if types is None else types
    if direction != "rtl" and _SIMPLE.issuperset(types):
        return 0, [0] * len(text)
    base = {"ltr": 0, "rtl": 1}.get(direction)
    base = paragraph_level(types) if base is None else base
    match = _matches(types)
    levels, t = _explicit(types, base, match)
    for seq, sos, eos in _sequences(types, levels, base, match):
        level, original = levels[seq[0]], [*t]
        _weak(seq, t, sos)
        _neutral(seq, t, original, text, level, sos, eos)
        for i in seq:  # I1, I2
            if level % 2 == 0:
                levels[i] = level + (1 if t[i] == "R" else 2 if t[i] in ("AN", "EN") else 0)
            else:
                levels[i] = level + (1 if t[i] in ("L", "EN", "AN") else 0)
    return base, levels


def visual_order(levels: list[int]) -> list[int]:
    """L2: from the highest level to the least odd one, stretches at that level or above are reversed."""
    order = list(range(len(levels)))
    odd = [x for x in levels if x % 2]
    for level in range(max(levels, default=0), min(odd, default=1) - 1, -1):
        k = 0
        while k < len(order):
            if levels[order[k]] >= level:
                e = k
                while e < len(order) and levels[order[e]] >= level:
                    e += 1
                order[k:e] = reversed(order[k:e])
                k = e
            else:
                k += 1
    return order


def runs_of(levels: list[int]) -> list[tuple[int, int, int]]:
    """(first, count, level) of the stretches of one level."""
    out: list[tuple[int, int, int]] = []
    for i, x in enumerate(levels):
        if out and out[-1][2] == x:
            out[-1] = (out[-1][0], out[-1][1] + 1, x)
        else:
            out.append((i, 1, x))
    return out


#: Characters that can raise a level: those of right-to-left scripts' blocks, Arabic numbers, and explicit formatting.
_RAISING = r"[\u0590-\u08FF\u200F\u202A-\u202E\u2066-\u2069\uFB1D-\uFDFF\uFE70-\uFEFF\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}]"


def with_levels(df: DataFrame, text_col: str, direction: str = "auto") -> DataFrame:
    """Adds ``base``, ``levels`` (array) and ``order`` (runs in visual order) for one paragraph a row; null has none.

    Texts without any character that can raise a level never leave the JVM, unless the paragraph runs right to left; the
    others take their classes from the same library as all other properties.
    """
    kept = [c for c in df.columns if c.lower() not in ("base", "levels", "order")]
    source = df.select(*kept, F.col(text_col).alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in kept], T.StructField("base", T.IntegerType()), T.StructField("levels", T.ArrayType(T.IntegerType())), T.StructField("order", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, classes = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
            found = [levels_of(t, direction, [CLASSES[k] for k in c]) if t is not None else (None, None) for t, c in zip(texts, classes, strict=True)]
            order = [visual_order([x for *_, x in runs_of(levels)]) if levels is not None else None for _, levels in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.int32())), pa.array(order, pa.list_(pa.int32()))], names=schema.names)

    letters = F.filter(F.split("__text", ""), lambda c: c != "")
    classed = lambda rows: rows.withColumn("__classes", F.transform(letters, lambda c: u.number("bidi_class", F.ascii(c))))
    if direction == "rtl":
        return classed(source).mapInArrow(run, schema)
    plain = ~F.coalesce(F.col("__text").rlike(_RAISING), F.lit(True))
    n = F.char_length("__text")
    level = source.where(plain).select(*kept, F.lit(0).alias("base"), F.array_repeat(F.lit(0), n).alias("levels"), F.array_repeat(F.lit(0), F.least(n, F.lit(1))).alias("order"))
    return level.union(classed(source.where(~plain)).mapInArrow(run, schema))


def paragraph_levels(df: DataFrame, id_col: str, text_col: str, direction: str = "auto") -> DataFrame:
    """(id, paragraph, base, levels, order): P1, a row a paragraph, its separator with it; texts without any have no row."""
    rows = df.select(id_col, F.posexplode(text.paragraphs(F.col(text_col))).alias("paragraph", "__line"))
    return with_levels(rows, "__line", direction).drop("__line")


def measured_runs(glyphs: DataFrame, keys: list[str], run: str, level: str, advance: str) -> DataFrame:
    """(keys, run, level, n_glyphs, width): the width of each run of shaped glyphs, whichever way it goes."""
    return glyphs.groupBy(*keys, run).agg(F.first(level).alias(level), F.count("*").alias("n_glyphs"), F.sum(advance).alias("width"))


def placed_runs(glyphs: DataFrame, keys: list[str], run: str, level: str, order: str, advance: str, offset: str) -> DataFrame:
    """Adds ``x`` to the glyphs of a line's runs: runs stand side by side in visual order, and inside a run of odd level the
    pen goes from its right end to the left."""
    line = measured_runs(glyphs, keys, run, level, advance).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(run, level, "width"))).alias("runs"))
    # the order of the runs is decided from their levels alone; a line has few

    def visual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [visual_order([r[level] for r in runs]) for runs in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "order"])

    schema = T.StructType([*line.schema.fields, T.StructField("order", T.ArrayType(T.IntegerType()))])
    line = line.mapInArrow(visual, schema)
    placed = line.select(*keys, "runs", F.posexplode("order").alias("place", "which")).select(*keys, "place", F.element_at("runs", F.col("which") + 1).alias("r"))
    w = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.select(*keys, F.col(f"r.{run}").alias(run), F.coalesce(F.sum("r.width").over(w), F.lit(0)).alias("__start"), F.col("r.width").alias("__width"))
    before = F.coalesce(F.sum(advance).over(Window.partitionBy(*keys, run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = glyphs.withColumn("__before", before).join(starts, [*keys, run])
    pen = F.when(F.col(level) % 2 == 1, F.col("__start") + F.col("__width") - F.col("__before") - F.col(advance)).otherwise(F.col("__start") + F.col("__before"))
    return rows.withColumn("x", pen + F.col(offset)).drop("__before", "__start", "__width")
