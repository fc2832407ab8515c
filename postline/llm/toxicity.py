"""Toxicity by weak supervision.

``VOTERS`` lexicon and pattern voters look at the words of a text and vote "toxic" or abstain: a voter for each of the fixed
word lists, one for each of the ``FAMILIES`` strongest word families mined from labelled documents (words of one beginning
that stand far more often in toxic ones), one for all weaker families, and one for each pattern over the hits. A generative
label model estimates, from the counts of vote patterns over all documents, how often each voter fires in either class and
which voters depend on one another (a spanning forest by conditional mutual information), by expectation maximisation.
Its posteriors label a bounded sample, on which a linear classifier over hashed words, word beginnings and votes is
trained. A sigmoid fitted on labels makes its margin a probability.

Bounds: vote patterns are counted by grouping, and are at most 2 ** VOTERS rows; families are mined from, and the classifier
is trained on, at most ``SAMPLE`` labelled documents (documented). All else covers all documents, by their whole texts, of
any length.

Defined results: a null or empty text has no votes and gets the score of the intercept; an empty table gives an empty
table; other columns are carried along, but for ``score``, which is replaced; without labels only the fixed lists and the
patterns vote; of labels that repeat an id the smallest holds, of documents that do the one with the least hash is learnt
from; families of equal strength rank by their hash; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postline.llm import samples, tokens

SAMPLE = 8_000
BUCKET_BITS = 18
THRESHOLD = 0.3
STEM_BYTES = 5
#: Mined word families with a voter of their own.
FAMILIES = 10
#: Hits in reach of one another, in words.
NEAR = 8
MIN_DOCS, MIN_RATIO = 5, 20.0
#: A pair of voters whose conditional mutual information is under this counts as independent.
DEPENDENT = 0.002
EPOCHS = 8
#: Insults, a voter for each list.
LEXICA = (
    ("idiot", "idiots", "moron", "morons", "stupid", "imbecile", "dumb", "fool"),
    ("scum", "trash", "garbage", "filth", "vermin"),
    ("loser", "losers", "clown", "clowns", "freak"),
    ("pathetic", "worthless", "disgusting", "useless", "hateful"),
    ("dummkopf", "arschloch", "abschaum", "idiotisch", "connard", "salaud", "imbécile", "ordure", "estúpido", "imbécil", "basura", "idiota"),
)
#: Patterns: three hits, three kinds of hit, a hit in each hundred words, two hits close together.
PATTERNS = 4
VOTERS = len(LEXICA) + FAMILIES + 1 + PATTERNS


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[tokens.Words, np.ndarray, np.ndarray]:
    """The words, a hash of each, and a hash of its first STEM_BYTES bytes (0: it has no more)."""
    words = tokens.Words(data, bounds, tokens.letter_table())
    full = words.hashes()
    cut = tokens.Words.__new__(tokens.Words)
    cut.data, cut.start, cut.end = data, words.start, np.minimum(words.end, words.start + STEM_BYTES)
    stem = cut.hashes()
    stem[words.end - words.start <= STEM_BYTES] = 0
    return words, full, stem


def hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(tokens.Words(data, np.array([0, len(data)]), tokens.letter_table()).hashes()[0])


@dataclass
class Lists:
    """Word hashes and the voter that each stands for; the same of stems."""

    words: np.ndarray
    word_voter: np.ndarray
    stems: np.ndarray
    stem_voter: np.ndarray

    @staticmethod
    def of(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(pairs), np.uint64)
        return keys, np.array([pairs[int(k)] for k in keys], np.int64)

    def votes(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece of texts: a vote matrix (0 or 1), the texts' first words, word hashes and stem hashes."""
        for _, data, bounds in tokens.slices(column):
            words, full, stem = word_hashes(data, bounds)
            n, docs = len(bounds) - 1, words.docs
            hits = np.zeros(n, np.int64)
            kinds = np.zeros((n, VOTERS), bool)
            places = []
            for keys, voter, h in ((self.words, self.word_voter, full), (self.stems, self.stem_voter, stem)):
                if len(keys) and len(h):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    found = np.flatnonzero(keys[at] == h)
                    kinds[docs[found], voter[at[found]]] = True
                    hits += np.bincount(docs[found], minlength=n)
                    places.append(found)
            v = kinds.copy()
            v[:, VOTERS - 4] = hits >= 3
            v[:, VOTERS - 3] = kinds.sum(axis=1) >= 3
            v[:, VOTERS - 2] = hits * 100 > np.diff(words.first)
            at = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
            close = at[:-1][(np.diff(at) <= NEAR) & (docs[at[1:]] == docs[at[:-1]])]
            v[docs[close], VOTERS - 1] = True
            yield v, words.first, full, stem


def buckets_of(votes: np.ndarray, first: np.ndarray, full: np.ndarray, stem: np.ndarray) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - BUCKET_BITS)
    a, b = (full >> shift).astype(np.int32), (tokens.mix(stem + np.uint64(1)) >> shift).astype(np.int32)
    for i in range(len(votes)):
        own = slice(first[i], first[i + 1])
        yield np.unique(np.concatenate([a[own], b[own], (1 << BUCKET_BITS) + np.flatnonzero(votes[i]).astype(np.int32)]))


@dataclass
class LabelModel:
    """Naive Bayes with a spanning forest: voter i depends on the class and on parent[i] (-1: on the class alone).
    rate[y, i, u]: how often i fires in class y if its parent's vote is u."""

    prior: float
    parent: np.ndarray
    rate: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.zeros((2, len(votes)))
        for y in (0, 1):
            logs[y] += np.log(self.prior if y else 1 - self.prior)
            for i, p in enumerate(self.parent):
                r = self.rate[y, i][votes[:, p].astype(int) if p >= 0 else np.zeros(len(votes), int)]
                logs[y] += np.log(np.where(votes[:, i], r, 1 - r))
        return samples.sigmoid(logs[1] - logs[0])


def forest(votes: np.ndarray, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A parent for each voter: the maximum spanning forest by mutual information given the class."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    v = votes.astype(float)
    total = weight.sum()
    if not total:  # no documents, so nothing depends on anything
        return np.full(m, -1)
    for y in (0, 1):
        w = weight * (q if y else 1 - q)
        mass = w.sum() + 1e-9
        one = (v.T @ w + 0.5) / (mass + 1)
        both = ((v * w[:, None]).T @ v + 0.25) / (mass + 1)
        for a, pa_, sign_a in ((1, one, 1), (0, 1 - one, -1)):
            for b, pb, _ in ((1, one, 1), (0, 1 - one, -1)):
                joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                joint = np.clip(joint, 1e-9, 1)
                info += mass / total * joint * np.log(joint / np.clip(np.outer(pa_, pb), 1e-9, 1))
    np.fill_diagonal(info, 0)
    parent = np.full(m, -1)
    inside, reach = {0}, {i: (info[0, i], 0) for i in range(1, m)}
    while reach:
        i = max(reach, key=lambda k: reach[k][0])
        gain, p = reach.pop(i)
        parent[i] = p if gain > DEPENDENT else -1
        inside.add(i)
        for k in reach:
            if info[i, k] > reach[k][0]:
                reach[k] = (info[i, k], i)
    return parent


def fit_label_model(votes: np.ndarray, weight: np.ndarray, prior: float = 0.1, rounds: int = 40) -> LabelModel:
    """From distinct vote patterns and their numbers of documents."""
    weight = weight.astype(float)
    q = np.where(votes.any(axis=1), 0.9, 0.02)
    m = votes.shape[1]
    model = LabelModel(prior, np.full(m, -1), np.zeros((2, m, 2)))
    for t in range(rounds):
        parent = forest(votes, weight, q) if t >= 5 and t % 5 == 0 else model.parent
        rate = np.zeros((2, m, 2))
        for y in (0, 1):
            w = weight * (q if y else 1 - q)
            # without evidence: a voter is right far more often than wrong, which also tells the classes apart
            strength, guess = max(1.0, 0.001 * weight.sum()), (0.3 if y else 0.002)
            for i, p in enumerate(parent):
                for u in (0, 1):
                    use = w if p < 0 else w * (votes[:, p] == u)
                    rate[y, i, u] = ((use * votes[:, i]).sum() + strength * guess) / (use.sum() + strength)
        prior = float(np.clip((weight @ q + 1) / (weight.sum() + 10), 1e-4, 0.9))
        model = LabelModel(prior, parent, np.clip(rate, 1e-5, 1 - 1e-5))
        q = model.posterior(votes)
    return model


@dataclass
class Model:
    lists: Lists
    label_model: LabelModel
    weight: np.ndarray = field(default_factory=lambda: np.zeros((1 << BUCKET_BITS) + VOTERS, np.float32))
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def margins(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([self.weight[r].sum() + self.bias for r in rows])

    def scores(self, column: pa.Array) -> np.ndarray:
        found = [self.margins(buckets_of(*x)) for x in self.lists.votes(column)]
        return samples.sigmoid(self.a * (np.concatenate(found) if found else np.zeros(0)) + self.b)


def mine(rows: list[np.ndarray], y: np.ndarray, skip: set[int]) -> dict[int, int]:
    """Hashes that stand in at least MIN_DOCS toxic texts and MIN_RATIO times as often in them as in others, with the number of
    those texts."""
    if not len(y) or not y.any() or y.all():
        return {}
    values, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    toxic = np.repeat(y == 1, [len(r) for r in rows])
    a, b = np.bincount(inverse[toxic], minlength=len(values)), np.bincount(inverse[~toxic], minlength=len(values))
    ratio = (a / y.sum()) / ((b + 0.5) / (len(y) - y.sum()))
    return {int(values[i]): int(a[i]) for i in np.flatnonzero((a >= MIN_DOCS) & (ratio >= MIN_RATIO)) if values[i] and int(values[i]) not in skip}


def fit_lists(words: list[np.ndarray], stems: list[np.ndarray], y: np.ndarray) -> Lists:
    """words and stems: of each text, its distinct words and each one's stem (0 where it is no longer than that)."""
    fixed = {hash_of(w): k for k, lexicon in enumerate(LEXICA) for w in lexicon}
    mined = mine(words, y, set(fixed))
    beginnings = mine([np.unique(r) for r in stems], y, set())
    stem_of: dict[int, int] = {}
    if mined:
        keys = np.array(sorted(mined), np.uint64)
        for w, t in zip(words, stems, strict=True):
            known = np.isin(w, keys)
            stem_of.update(zip(w[known].tolist(), t[known].tolist(), strict=True))
    family = {w: stem_of[w] or w for w in mined}
    strength = dict(beginnings)
    for w, f in family.items():
        strength[f] = max(strength.get(f, 0), mined[w])
    ranked = sorted(strength, key=lambda f: (-strength[f], f))
    voter = {f: len(LEXICA) + min(k, FAMILIES) for k, f in enumerate(ranked)}
    return Lists(*Lists.of(fixed | {w: voter[f] for w, f in family.items()}), *Lists.of({f: voter[f] for f in beginnings}))


def fit_classifier(model: Model, rows: list[np.ndarray], target: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
    """Logistic regression on posterior labels, by AdaGrad; then the sigmoid on the labels of rows that it wasn't trained on."""
    if not rows:
        return
    rng = np.random.default_rng(seed)
    kept_out = rng.random(len(rows)) < 0.3
    w, sums = np.zeros(len(model.weight)), np.full(len(model.weight), 1e-2)
    bias, bias_sum = float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))), 1.0
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~kept_out)):
            r = rows[i]
            g = 1 / (1 + np.exp(-np.clip(w[r].sum() + bias, -30, 30))) - target[i]
            sums[r] += g * g
            w[r] -= 0.3 * (g + 1e-4 * w[r]) / np.sqrt(sums[r])
            bias_sum += g * g
            bias -= 0.3 * g / np.sqrt(bias_sum)
    model.weight, model.bias = w.astype(np.float32), bias
    check = np.flatnonzero(kept_out)
    if y[check].min(initial=1) < y[check].max(initial=0):
        model.a, model.b = samples.fit_sigmoid(model.margins(rows[i] for i in check), y[check].astype(float))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    rows = samples.labelled_sample(docs, labels, label, allowed, sample)
    text_at = lambda b: b.column(b.schema.get_field_index("text"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[bytes]] = [[], []]
            for _, data, bounds in tokens.slices(text_at(b)):
                words, full, stem = word_hashes(data, bounds)
                for i in range(len(bounds) - 1):
                    own, at = np.unique(full[words.first[i] : words.first[i + 1]], return_index=True)
                    out[0].append(own.tobytes())
                    out[1].append(stem[words.first[i] + at].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("doc_id", "y")] + [pa.array(x, pa.binary()) for x in out], names=["doc_id", "y", "words", "stems"])

    got = rows.mapInArrow(hashes, "doc_id bigint, y int, words binary, stems binary").toArrow().sort_by("doc_id")
    y = np.array(got["y"].to_pylist(), dtype=np.int64)
    lists = fit_lists(samples.unpacked(got["words"], np.uint64), samples.unpacked(got["stems"], np.uint64), y)
    del got
    samples.release()
    held = spark.sparkContext.broadcast(lists)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes_ = [v @ (1 << np.arange(VOTERS)) for v, *_ in held.value.votes(text_at(b))]
            if codes_:
                found, n = np.unique(np.concatenate(codes_), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])

    table = docs.select("text").mapInArrow(patterns, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow().sort_by("pattern")
    codes = table["pattern"].to_numpy()
    votes = (codes[:, None] >> np.arange(VOTERS)) & 1 > 0 if len(codes) else np.zeros((0, VOTERS), bool)
    model = Model(lists, fit_label_model(votes, table["n"].to_numpy(), float(y.mean()) if len(y) else 0.1))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, codes_ = [], []
            for v, *rest in held.value.votes(text_at(b)):
                made += [r.tobytes() for r in buckets_of(v, *rest)]
                codes_.append(v @ (1 << np.arange(VOTERS)))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "y")] + [pa.array(np.concatenate(codes_) if codes_ else [], pa.int64()), pa.array(made, pa.binary())],
                names=["doc_id", "y", "code", "f"],
            )

    got = rows.mapInArrow(featured, "doc_id bigint, y int, code bigint, f binary").toArrow().sort_by("doc_id")
    if got.num_rows:
        seen = (got["code"].to_numpy()[:, None] >> np.arange(VOTERS)) & 1 > 0
        fit_classifier(model, samples.unpacked(got["f"]), model.label_model.posterior(seen), np.array(got["y"].to_pylist()))
    del got
    samples.release()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``score``, the probability of being toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return samples.with_column(docs, ["score"], [T.StructField("score", T.DoubleType())], lambda text: [pa.array(held.value.scores(text), pa.float64())])


def predicted(col: str = "score") -> Column:
    return (F.col(col) >= THRESHOLD).cast("int")
