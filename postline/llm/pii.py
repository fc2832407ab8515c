"""Personal data by candidate gradient boosting.

Base spans are exact pattern matches per kind. Beside them, high-recall generators propose overlapping candidate spans of
each kind, and of secrets (keys and tokens), which have no base pattern; boosted trees score each candidate from its format
and context, a calibrated threshold per kind selects, and what a base span of any kind or a better candidate already covers
is dropped. Base spans always stay.

No table holds labelled personal data, so the trees are trained on invented examples: ``examples`` writes formats and look-alikes
(versions, dates, order numbers, sums, hashes of commits) from a fixed seed into words of the documents themselves, of which
``vocabulary`` brings a bounded sample. Thresholds are calibrated on examples of another seed. The model is small, of fixed
size, and is broadcast. Generators go by what the formats allow: 64 characters before an at-sign and 63 in a part of a host
name; a longer one is left to the base pattern, which has no bound.

Defined results: a null or empty text has no spans; an empty table gives an empty table; matches are found in whole texts of
any length in time n log n; of candidates with equal scores the first by text, kind and place goes before; other columns are
carried along, but for ``spans``, which is replaced; repeated rows get equal spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postline.llm import samples

#: The kinds, in the order of results. The last has no base pattern.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Documents whose words the invented examples are written into, and words taken at most.
SAMPLE, WORDS = 200, 20_000
PRECISION = 0.98
SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
    ]
)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
NUMERIC = frozenset("0123456789+(). -")
CHUNK = re.compile(r"[0-9][0-9+(). -]*")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def part_ok(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def left_of(text: str, at: int, allowed: frozenset[str], stop: int) -> int:
    while at > stop and text[at - 1] in allowed:
        at -= 1
    return at


def chunks(text: str) -> list[tuple[int, int]]:
    """Maximal runs of NUMERIC characters that hold a digit: no match of a numeric kind crosses one's ends."""
    out, last = [], 0
    for m in CHUNK.finditer(text):
        out.append((left_of(text, m.start(), NUMERIC, last), m.end()))
        last = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the leftmost non-overlapping matches of each kind that pass its check."""
    out, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = left_of(text, m.start(), LOCAL, last)
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    for a, b in chunks(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text, a, b) if all(map(part_ok, m[0].split(".")))]
        for m in CARD.finditer(text, a, b):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text, a, b) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


#: The generators: wide on purpose, each match a candidate of its kind.
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,24}){1,3}", re.I)
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])")
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
LONG_NUMBER = re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ .-]?[0-9]{2,6}){2,5}(?![0-9])")
CALL_NUMBER = re.compile(r"(?<![0-9A-Za-z])(?:00|\()?[0-9]{1,4}\)?(?:[ ./-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9A-Za-z])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}")
GENERATORS = ((0, SPELLED), (1, DOTTED), (1, COLONS), (2, LONG_NUMBER), (3, CALL_NUMBER))
#: Words near a span that speak for a kind, or for none.
CUES = (
    re.compile(r"\b(?:e-?mail|mail|contact|write to|reach|correo|courriel|kontakt|schreib)", re.I),
    re.compile(r"\b(?:ip|host|server|client|address|login|from|peer|gateway|addr)\b", re.I),
    re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|cc)\b", re.I),
    re.compile(r"\b(?:phone|tel|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono|handy|appelez|llame)", re.I),
    re.compile(r"\b(?:token|secret|key|apikey|api|password|passwd|pwd|auth|bearer|credential|schlüssel|clé|clave|contraseña)", re.I),
    re.compile(r"\b(?:commit|sha|sha1|sha256|md5|checksum|digest|hash|etag|uuid|revision|file|url|path)\b", re.I),
    re.compile(r"\b(?:version|v|release|order|invoice|isbn|id|page|section|chapter|ref|sum|total|serial|part|build|no|year|bestell|factura)\b", re.I),
)
NEAR = 28


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping candidates, each within a stretch that has an at-sign, a digit or a spelled-out one."""
    out = []
    if "@" in text or "(at)" in text or "[at]" in text or "{at}" in text or " at " in text:
        for m in re.finditer(r"@|\(at\)|\[at\]|\{at\}| at (?=[A-Za-z0-9-]{1,63} ?(?:dot|\(dot|\[dot|\{dot|\.))", text):
            lo, hi = max(0, m.start() - 66), min(len(text), m.end() + 160)
            out += [(0, x.start(), x.end()) for x in SPELLED.finditer(text, lo, hi) if x.start() <= m.start() < x.end()]
    out += [(4, m.start(), m.end()) for m in SECRET.finditer(text)]
    last = -1
    for m in DIGIT.finditer(text):
        if m.start() < last:
            continue
        # a stretch of digits, marks and hexadecimal letters
        lo, end = max(0, m.start() - 6), m.end()
        while end < len(text) and (text[end] in NUMERIC or text[end] in ":/ABCDEFabcdef"):
            end += 1
        last = end
        if end - m.start() >= 7:
            lo = left_of(text, m.start(), frozenset("(:abcdefABCDEF"), lo)
            for kind, pattern in GENERATORS[1:]:
                out += [(kind, x.start(), x.end()) for x in pattern.finditer(text, lo, end)]
    return sorted(set(out))


def describe(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context features."""
    s = text[start:end]
    digits = "".join(DIGIT.findall(s))
    groups = [g for g in re.split("[^0-9]+", s) if g]
    sizes = [len(g) for g in groups]
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    near = f"{before} \n {after}"
    letters = len(s) - len(digits)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False)) if kind == 4 else 0
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(s),
        len(digits),
        len(groups),
        max(sizes, default=0),
        min(sizes, default=0),
        float(bool(digits) and luhn(digits)),
        float(len(groups) == 4 and all(part_ok(g) for g in groups)),
        float(sizes == [4, 4, 4, 4] or sizes == [4, 6, 5]),
        float(sizes[-2:] == [3, 4]),
        float(len(set(sizes)) == 1),
        float("@" in s),
        float("dot" in s.lower()),
        float(any(c in s for c in "([{")),
        s.count("."),
        s.count("-"),
        s.count(" "),
        s.count(":"),
        s.count("/"),
        turns / len(s),
        len(set(s)) if kind == 4 else 0,
        float(kind == 4 and all(c in "0123456789abcdef" for c in s.lower())),
        letters / len(s),
        float(before.rstrip()[-1:] in ("=", ":", '"', "'")),
        float(digits[:1] in ("3", "4", "5", "6")),
        float(digits[:1] == "0"),
        float(s[:1] == "(" or s[:2] == "00"),
        float(before[-1:].isalnum() or before[-1:] in ("#", "$", "=", "/", "€", '"')),
        float(after[:1].isalnum() or after[:1] in ("%", "$", "€", '"')),
        *(float(bool(c.search(near))) for c in CUES),
        *(float(bool(c.search(before))) for c in CUES),
    ]


@dataclass
class Trees:
    """Gradient-boosted trees of depth 3 with logistic loss: feature and cut of 7 nodes and 8 leaves each."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    a: float = 1.0
    b: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - 7]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return samples.sigmoid(self.a * self.margins(x) + self.b)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.25, ridge: float = 1.0) -> Trees:
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), start)
    cuts = [(np.unique(c)[:-1] + np.unique(c)[1:]) / 2 for c in x.T]
    cuts = [c if len(c) <= 16 else np.quantile(c, np.linspace(0, 1, 16)) for c in cuts]
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = samples.sigmoid(margin)
        g, h = y - p, p * (1 - p)
        f, c, v = np.zeros(7, np.int64), np.full(7, np.inf), np.zeros(8)
        node = np.zeros(len(y), np.int64)
        for depth in range(3):
            for n in range(2**depth - 1, 2 ** (depth + 1) - 1):
                own = np.flatnonzero(node == n)
                best = 1e-6
                whole = g[own].sum() ** 2 / (h[own].sum() + ridge)
                for k, options in enumerate(cuts):
                    for t in options:
                        right = x[own, k] > t
                        gr, hr = g[own][right].sum(), h[own][right].sum()
                        gl, hl = g[own].sum() - gr, h[own].sum() - hr
                        gain = gr * gr / (hr + ridge) + gl * gl / (hl + ridge) - whole
                        if gain > best:
                            best, f[n], c[n] = gain, k, t
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        for k in range(8):
            own = node == k + 7
            v[k] = rate * g[own].sum() / (h[own].sum() + ridge)
        margin += v[node - 7]
        features.append(f)
        thresholds.append(c)
        leaves.append(v)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


def examples(seed: int = 11, each: int = 60, words: tuple[str, ...] = ()) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, y): invented spans among these words, or invented ones."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: str(rng.choice(xs))
    num = lambda n: "".join(str(rng.integers(10)) for _ in range(n))
    made = lambda: "".join(pick(*"abcdefghilmnoprstu") for _ in range(int(rng.integers(3, 9))))
    word = lambda: words[int(rng.integers(len(words)))] if words else made()
    coded = lambda n, of: "".join(of[int(rng.integers(len(of)))] for _ in range(n))
    hexa, wide = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card(valid: bool) -> str:
        body = pick("4", "51", "55", "37", "6011") + num(14)
        body = body[:15]
        tail = next(str(d) for d in range(10) if luhn(body + str(d)) == valid)
        s = body + tail
        return pick(s, " ".join(s[i : i + 4] for i in range(0, 16, 4)), "-".join(s[i : i + 4] for i in range(0, 16, 4)), ".".join(s[i : i + 4] for i in range(0, 16, 4)))

    octet = lambda: str(int(rng.integers(1, 256)))
    makers = [
        (0, 1, lambda: f"{made()}{pick(' at ', '(at)', ' [at] ', ' (at) ')}{made()}{pick(' dot ', '(dot)', ' [dot] ')}{pick('com', 'org', 'net', 'de')}", ("email", "write to", "contact me:", "")),
        (0, 0, lambda: f"{made()} at {made()}. {made().title()}", ("we met", "", "look")),
        (0, 0, lambda: f"{made()}@{made()}", ("", "tag", "see")),
        (1, 1, lambda: ".".join(octet() for _ in range(4)), ("from host", "ip", "client", "")),
        (1, 1, lambda: ":".join(f"{int(rng.integers(1 << 16)):x}" for _ in range(8)), ("from host", "ip", "address", "")),
        (1, 0, lambda: ":".join(num(2) for _ in range(4)), ("time", "", "at")),
        (1, 0, lambda: ".".join(num(int(rng.integers(1, 4))) for _ in range(4)), ("version", "release", "section", "build")),
        (1, 0, lambda: ".".join(rng.permutation([str(int(rng.integers(256, 1000))), octet(), octet(), octet()]).tolist()), ("from host", "ip", "client", "")),
        (2, 1, lambda: card(True), ("card", "visa", "credit card", "")),
        (2, 1, lambda: card(False), ("card number", "visa card")),
        (2, 0, lambda: card(False), ("order", "invoice", "", "serial", "id")),
        (2, 0, lambda: num(int(rng.integers(9, 20))), ("order", "id", "", "isbn", "total")),
        (2, 0, lambda: f"{pick('19', '20')}{num(2)}-{num(2)}-{num(2)} {num(2)}", ("", "year", "on")),
        (3, 1, lambda: f"({num(3)}) {num(3)}-{num(4)}", ("call", "phone", "tel", "mobile")),
        (3, 1, lambda: f"{num(3)}-{num(3)}-{num(4)}", ("call", "phone", "tel", "fax")),
        (3, 1, lambda: f"00{num(2)} {num(3)} {num(3)} {num(4)}", ("call", "tel", "", "mobile")),
        (3, 0, lambda: f"{num(3)}-{num(3)}-{num(4)}", ("order", "part", "serial", "")),
        (3, 0, lambda: f"{pick('19', '20')}{num(2)}-{num(2)}-{num(2)}", ("", "on", "year", "from")),
        (3, 0, lambda: f"{num(3)} {num(3)} {num(3)}", ("total", "sum", "", "invoice")),
        (3, 0, lambda: num(int(rng.integers(7, 17))), ("order", "id", "", "total", "serial")),
        (3, 0, lambda: card(False), ("", "order", "id")),
        (3, 0, lambda: num(16), ("", "")),
        (2, 0, lambda: num(16), ("", "")),
        (3, 0, lambda: ".".join(octet() for _ in range(4)), ("from host", "ip", "")),
        (4, 1, lambda: coded(int(pick(32, 40, 48, 64)), hexa), ('token = "', "secret: ", "api_key=", "password ", 'key: "')),
        (4, 1, lambda: pick("sk-", "ghp_", "AKIA", "xoxb-", "") + coded(int(rng.integers(20, 44)), wide), ('token = "', "secret: ", "Bearer ", "api key ", "")),
        (4, 0, lambda: coded(int(pick(32, 40, 64)), hexa), ("commit ", "sha256 ", "md5: ", "checksum ", "digest ")),
        (4, 0, lambda: "-".join(coded(n, hexa) for n in (8, 4, 4, 4, 12)), ("id ", "uuid ", "", "see ")),
        (4, 0, lambda: "/".join(made() for _ in range(4)) + pick("1", "/2024", "/v2"), ("", "path ", "see ", "file ")),
        (4, 0, lambda: pick("-", "_").join([made(), made(), made(), num(2)]), ("", "see ", "page ")),
        (4, 0, lambda: "".join(made() for _ in range(4)) + num(1), ("", "the ", "and ")),
    ]
    out = []
    for kind, y, make, cues in makers:
        for _ in range(each):
            s, cue = make(), pick(*cues)
            head = f"{word()} {word()} {cue}{'' if cue[-1:] in ' ="' else ' '}".replace("  ", " ")
            out.append((f"{head}{s}{pick(' ', '. ', ', ')}{word()} {word()}", kind, len(head), len(head) + len(s), y))
    return out


@dataclass
class Model:
    trees: Trees
    thresholds: list[float]


@cache
def fit(words: tuple[str, ...] = ()) -> Model:
    """Trees, sigmoid and thresholds: the least score of each kind with a precision of PRECISION on examples of another seed."""
    known, unseen = examples(11, words=words), examples(12, words=words)
    x = np.array([describe(t, k, a, b) for t, k, a, b, _ in known])
    trees = boost(x, np.array([float(e[4]) for e in known]))
    x2, y2, kinds = np.array([describe(t, k, a, b) for t, k, a, b, _ in unseen]), np.array([e[4] for e in unseen]), np.array([e[1] for e in unseen])
    trees.a, trees.b = samples.fit_sigmoid(trees.margins(x2), y2.astype(float))
    p = trees.scores(x2)
    thresholds = []
    for k in range(len(KINDS)):
        own = kinds == k
        good = [t for t in np.unique(np.floor(p[own] * 1e4) / 1e4) if y2[own][p[own] >= t].mean() >= PRECISION]
        thresholds.append(max(0.5, float(min(good))) if good else 1.01)
    return Model(trees, thresholds)


def vocabulary(docs: DataFrame) -> tuple[str, ...]:
    """Words of at most SAMPLE documents, by a hash of the text; those with a digit or an at-sign are left out."""
    some = docs.filter("text <> ''").select("text").orderBy(F.xxhash64("text"), "text").limit(SAMPLE)
    found = some.select(F.explode(F.split("text", r"\s+")).alias("w")).filter(~F.col("w").rlike("[0-9@]") & (F.length("w") < 30) & (F.col("w") != ""))
    return tuple(r.w for r in found.distinct().orderBy(F.xxhash64("w"), "w").limit(WORDS).collect())


def covers(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span overlaps one of these sorted, disjoint ones."""
    at = bisect_left(taken, (end,))
    return at > 0 and taken[at - 1][1] > start


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(texts: list[str], model: Model) -> list[list[dict]]:
    """The spans of each text, base ones and selected candidates, by kind and start."""
    base = [base_spans(t) for t in texts]
    rows, x = [], []
    for i, t in enumerate(texts):
        taken = merged([(a, b) for _, a, b in base[i]])
        for kind, a, b in candidates(t):
            if not covers(taken, a, b):
                rows.append((i, kind, a, b))
                x.append(describe(t, kind, a, b))
    extra: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if rows:
        p = model.trees.scores(np.array(x))
        used: list[list[tuple[int, int]]] = [[] for _ in texts]
        for k in np.lexsort((np.arange(len(p)), -p)):
            i, kind, a, b = rows[k]
            if p[k] >= model.thresholds[kind] and not covers(used[i], a, b):
                insort(used[i], (a, b))
                extra[i].append((kind, a, b, float(p[k])))
    out = []
    for own, more in zip(base, extra, strict=True):
        both = sorted([(k, a, b, True, 1.0) for k, a, b in own] + [(k, a, b, False, p) for k, a, b, p in more])
        out.append([{"kind": KINDS[k], "start": a, "end": b, "base": f, "score": p} for k, a, b, f, p in both])
    return out


def with_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with ``spans``: kind, start and end (code points), base, score; by kind, then start."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(vocabulary(docs)))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def make(text: pa.Array) -> list[pa.Array]:
        out = []
        for at in range(0, len(text), 512):
            out += find([t or "" for t in text.slice(at, 512).to_pylist()], held.value)
        return [pa.array(out, arrow)]

    return samples.with_column(docs, ["spans"], [T.StructField("spans", T.ArrayType(SPAN))], make)


def redact(found: DataFrame) -> DataFrame:
    """found (of ``with_spans``) with each span's text replaced by its kind in brackets; overlapping spans become one."""

    def make(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            t, parts, last = t or "", [], 0
            for a, b in merged([(s["start"], s["end"]) for s in own or []]):
                kind = min((s["kind"] for s in own if a <= s["start"] < b), key=KINDS.index)
                parts += [t[last:a], f"[{kind.upper()}]"]
                last = b
            out.append("".join([*parts, t[last:]]))
        return pa.array(out, pa.string())

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.set_column(i, "text", make(b.column(i), b.column(b.schema.get_field_index("spans"))))

    return found.mapInArrow(run, found.schema)
