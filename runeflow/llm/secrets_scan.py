"""Secrets in whole texts: fixed patterns, and a character convolutional network over every other candidate.

A candidate is any run of 12 or more key characters that no fixed pattern covers, with digits or without. The
network sees it with the characters around it, in windows that together cover all of it, and takes the highest score. It
is trained in numpy on labelled findings that a seeded generator writes: keys of many shapes in the settings, code and
prose they turn up in, and what merely looks like one. Scores are calibrated on held-out findings (Platt), and the
threshold is the highest at which the recall there is still ``RECALL``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

KINDS = ("assign", "access", "hex", "generic")

# Fixed patterns.
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 12
_KEYISH = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
_HEX_BYTES = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_HEX_RUN = b"1" * 24

LEFT, BODY, RIGHT = 24, 48, 8
WIDTH = LEFT + BODY + RIGHT
FILTERS, KERNEL = 16, 5
RECALL = 0.98
TRAIN_ROWS = 8_000

# Character classes: each ASCII letter of either case, digit, marks, others, and padding.
_MARKS = " =:\"'_-/+.,()"
_DIGITS, _OTHER, _PAD = 52, 53 + len(_MARKS), 54 + len(_MARKS)
_CLASSES = _PAD + 1


def _codes() -> np.ndarray:
    table = np.full(128, _OTHER, np.int64)
    for i, c in enumerate(string.ascii_letters):
        table[ord(c)] = i
    for c in string.digits:
        table[ord(c)] = _DIGITS
    for i, c in enumerate(_MARKS):
        table[ord(c)] = 53 + i
    return table


_CODE = _codes()


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers of the candidates and their surroundings, one row each ``BODY`` characters, and whose row each is.
    Places beyond the text, or beyond a candidate that ends early and its right part, are padding."""
    codes = np.full(len(text) + LEFT + BODY + RIGHT, _PAD, np.int64)
    codes[LEFT : LEFT + len(text)] = _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 127)]
    first = np.array([a for a, _ in spans])
    last = np.array([b for _, b in spans])
    count = -(-(last - first) // BODY)
    own = np.repeat(np.arange(len(spans)), count)
    start = first[own] + BODY * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    size = np.minimum(last[own] - start, BODY)
    # after a body that ends early its right part follows at its fixed place
    at = np.arange(WIDTH)[None, :]
    place = np.where(at < LEFT + BODY, start[:, None] + at, start[:, None] + at - BODY + size[:, None])
    rows = codes[place]
    rows[(at >= LEFT + size[:, None]) & (at < LEFT + BODY)] = _PAD
    return rows, own


class CharCnn:
    """Embedding by convolution, ReLU, maximum and mean over the candidate's and the left part, one logit."""

    def __init__(self, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.w = rnd.normal(0, 0.25, (KERNEL, _CLASSES, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rnd.normal(0, 0.1, 3 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _maps(self, x: np.ndarray) -> np.ndarray:
        n = WIDTH - KERNEL + 1
        h = np.broadcast_to(self.b, (len(x), n, FILTERS)).copy()
        for k in range(KERNEL):
            h += self.w[k][x[:, k : k + n]]
        return np.maximum(h, 0)

    def _pooled(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, body = h[:, : LEFT - 1], h[:, LEFT - 1 :]
        at_left, at_body = left.argmax(1), body.argmax(1)
        top = [np.take_along_axis(p, a[:, None, :], 1)[:, 0] for p, a in ((left, at_left), (body, at_body))]
        return np.concatenate([*top, body.mean(1)], 1), at_left, at_body

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [self._pooled(self._maps(x[i : i + 2048]))[0] @ self.v + self.c for i in range(0, len(x), 2048)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 128, rate: float = 0.004) -> None:
        rnd = np.random.default_rng(11)
        params = [self.w, self.b, self.v, self.c]
        m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        n = WIDTH - KERNEL + 1
        for _ in range(epochs):
            order = rnd.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                h = self._maps(xb)
                z, at_left, at_body = self._pooled(h)
                p = 1 / (1 + np.exp(-(z @ self.v + self.c)))
                g = ((p - yb) / len(xb)).astype(np.float32)
                dz = g[:, None] * self.v
                dh = np.zeros_like(h)
                rows, cols = np.arange(len(xb))[:, None], np.arange(FILTERS)[None, :]
                dh[:, LEFT - 1 :] += (dz[:, 2 * FILTERS :] / (n - LEFT + 1))[:, None, :]
                dh[rows, at_left, cols] += dz[:, :FILTERS]
                dh[rows, at_body + LEFT - 1, cols] += dz[:, FILTERS : 2 * FILTERS]
                dh *= h > 0
                flat = dh.reshape(-1, FILTERS)
                dw = np.empty_like(self.w)
                for k in range(KERNEL):
                    hot = np.zeros((flat.shape[0], _CLASSES), np.float32)
                    hot[np.arange(flat.shape[0]), xb[:, k : k + n].ravel()] = 1
                    dw[k] = hot.T @ flat
                grads, step = [dw, flat.sum(0), z.T @ g, g.sum(keepdims=True)], step + 1
                for q, (param, grad) in enumerate(zip(params, grads, strict=True)):
                    m[q] = 0.9 * m[q] + 0.1 * grad
                    s[q] = 0.999 * s[q] + 0.001 * grad * grad
                    param -= rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(s[q] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by Newton steps, then the highest threshold that keeps the recall."""
        z = self.logits(x).astype(np.float64)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.scale, self.shift = float(a), float(b)
        hits = np.sort(self.probability(z)[y == 1])
        self.threshold = float(hits[int(math.floor((1 - recall) * len(hits) + 1e-9))]) if len(hits) else 0.5

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z.astype(np.float64) + self.shift, -30, 30)))


def labelled_findings(rows: int, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) by a seeded generator; half are keys."""
    rnd = random.Random(seed)
    b64, alnum = string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits

    def some(alphabet: str, n: int) -> str:
        return "".join(rnd.choice(alphabet) for _ in range(n))

    # fixed values: syllables of the four languages
    parts = "the on er re ing ed ation th or en an ti es ha nd st ly wh un tion ness able ous ship ful sh ch ght ck".split()
    parts += "ein der die das und sch ich keit heit ung zu pf be ver ge auf mit ach au eu tz lich zer ent nicht".split()
    parts += "que elle eau aux eux oux ment vi ai ou est les des tre eur ier oir mente ción con de la per pro com os as ado ido gar lla rr".split()

    def word() -> str:
        return "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))

    def prose(n: int) -> str:
        return " ".join(word() for _ in range(n))

    keys = [
        lambda: some(b64, rnd.randint(20, 88)) + rnd.choice(["", "=", "=="]),
        lambda: some(alnum, rnd.randint(20, 64)),
        lambda: some("0123456789ABCDEF", rnd.randint(24, 64)),
        lambda: some(string.ascii_uppercase + "234567", rnd.randint(16, 52)),
        lambda: rnd.choice(["sk-", "pk_live_", "ghp_", "xoxb-", "glpat-", "rk_test_", "npm_", "dop_v1_"]) + some(alnum, rnd.randint(20, 48)),
        lambda: "eyJ" + some(alnum + "-_", rnd.randint(20, 60)) + ".eyJ" + some(alnum + "-_", 30) + "." + some(alnum + "-_", 30),
        lambda: some(alnum + "-_", rnd.randint(22, 43)),
        lambda: some(alnum, rnd.randint(12, 20)),
        lambda: some(string.ascii_lowercase + string.digits, rnd.randint(14, 32)),
    ]
    looks = [
        lambda: "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        lambda: word() + "." + word() + f".{rnd.randint(0, 99):02d}",
        lambda: "/".join(word() for _ in range(rnd.randint(2, 5))) + f"/{rnd.randint(1, 9999)}",
        lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}T{rnd.randint(0, 23):02d}.{rnd.randint(10, 59)}.{rnd.randint(10, 59)}Z",
        lambda: "_".join(word() for _ in range(rnd.randint(2, 5))) + f"_{rnd.randint(1, 99)}",
        lambda: f"www.{word()}{rnd.randint(1, 99)}.example.{rnd.choice(['com', 'org', 'net'])}",
        lambda: f"v{rnd.randint(0, 20)}.{rnd.randint(0, 30)}.{rnd.randint(0, 99)}-{word()}.{rnd.randint(1, 9)}",
        lambda: word() + word() + word() + str(rnd.randint(1, 9999)),
        lambda: f"{word()}-{word()}-{word()}-{rnd.randint(1, 2030)}",
        lambda: "=" * rnd.randint(10, 30) + word() + str(rnd.randint(1, 9)) + "-" * rnd.randint(10, 30),
        lambda: rnd.choice("-_./").join(word() for _ in range(rnd.randint(3, 7))),
        lambda: "".join(word() for _ in range(rnd.randint(2, 5))),
        lambda: "".join(word() for _ in range(rnd.randint(2, 4))).upper() + rnd.choice(["", "."]),
        lambda: "".join(word() for _ in range(rnd.randint(2, 4))) + rnd.choice([".", "..", "-", "_", "/"]),
        lambda: "".join(word().title() for _ in range(rnd.randint(3, 6))),
        lambda: rnd.choice("-=._/+") * rnd.randint(16, 80),
        lambda: some(string.digits, rnd.randint(16, 30)),
    ]
    settings = ["key = ", "KEY: ", "auth=", "Authorization: Bearer ", "export CRED=", "client_id: '", 'credentials": "', "use ", "signing key ", "access: ", "hash ", "id ", "see ", "", "file ", "version "]
    out = []
    for i in range(rows):
        label = i % 2
        body = rnd.choice(keys if label else looks)()
        while len(body) < LEAST:
            body += word()
        before = prose(rnd.randint(0, 6)) + rnd.choice([" ", "\n", ". "]) + rnd.choice(settings)
        text = before + body + rnd.choice([" ", '"', "'", "\n", ". ", ","]) + prose(rnd.randint(0, 3))
        out.append((text, len(before), len(before) + len(body), label))
    return out


def first_windows(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    return np.stack([windows(t, [(a, b)])[0][0] for t, a, b, _ in found])


@lru_cache(maxsize=4)
def train(rows: int = TRAIN_ROWS, recall: float = RECALL) -> CharCnn:
    """The network, fitted on three quarters of the findings and calibrated on the rest; always the same one."""
    found = labelled_findings(rows)
    x = first_windows(found)
    y = np.array([label for *_, label in found], np.float64)
    net, held = CharCnn(), np.arange(rows) % 8 >= 6
    net.fit(x[~held], y[~held])
    net.calibrate(x[held], y[held], recall)
    return net


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Findings of the fixed patterns by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if _HEX_RUN in text.encode("utf-8", "replace").translate(_HEX_BYTES):
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that meet no base span."""
    out, k = [], 0
    for m in _KEYISH.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][2] <= a:
            k += 1
        if any(s < b and e > a for _, s, e in base[max(0, k - 3) :]):
            continue
        out.append((a, b))
    return out


def scan(texts: list[str], net: CharCnn) -> list[tuple[list, list]]:
    """For each text the base spans and all spans, by start, then kind as listed, then end."""
    bases = [base_spans(t) for t in texts]
    rows, owner, where = [], [], []
    for i, t in enumerate(texts):
        if spans := candidates(t, bases[i]):
            w, own = windows(t, spans)
            rows.append(w)
            owner.append(own + len(where))
            where += [(i, a, b) for a, b in spans]
    every = [list(b) for b in bases]
    if where:
        p = net.probability(net.logits(np.concatenate(rows)))
        best = np.zeros(len(where))
        np.maximum.at(best, np.concatenate(owner), p)
        for (i, a, b), score in zip(where, best, strict=True):
            if score >= net.threshold:
                every[i].append(("generic", a, b))
    return [(b, sorted(e, key=_order)) for b, e in zip(bases, every, strict=True)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(df: DataFrame, text_col: str = "text", carry: list[str] | None = None, net: CharCnn | None = None) -> DataFrame:
    """``df`` with ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` (base ones and ``generic``).

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind as listed, comma-joined; the digest is
    over the base ones. A null or empty text has none; a very long text is read whole, and a very long candidate in as
    many windows as cover it. Repeated rows stay; an empty table gives an empty one; input columns of these names are
    replaced. Scores equal to the threshold count as found. The network (a fixed number of weights) is trained on the driver and goes with the
    tasks.
    """
    net = net or train()

    def make():
        def run(texts):
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for base, every in scan(texts, net):
                for held, k in zip(counts, KINDS, strict=False):
                    held.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            return [*counts, digests, spans]

        return run

    fields = [(f"n_{k}", T.LongType()) for k in KINDS[:3]] + [("base_sha256", T.StringType()), ("spans", T.StringType())]
    return append_columns(df, text_col, fields, make, carry)
