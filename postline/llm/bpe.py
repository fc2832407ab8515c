"""BPE encoding and decoding in batched numpy merge rounds.

The words of a batch that aren't in the worker's table yet are laid out as one flat array of symbols. In each round
every word merges its lowest-rank pair, at all its places from left to right; pairs are found by binary search in the
sorted array of pair keys. Rounds end when no word has a pair left.

``Vocabulary.load`` reads a public tokenizer file of the kind BPE with word ends: NFC, lower case, white space dropped,
words and single digits and marks, byte-level symbols, ``</w>`` at a word's end; strings of added tokens in a text
become those tokens. Its tables have a fixed size and are broadcast.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated rows have the same ids; other columns are carried along, but for
``ids`` and ``decoded``, which are replaced; texts of any length are encoded whole; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postline.llm import samples

#: Words that a worker remembers; beyond this it starts anew.
REMEMBERED = 300_000
#: Texts encoded at a time.
TEXTS = 256
#: Unicode's white space, and the pattern of words of this kind of vocabulary.
SPACE = "\t-\r \x85\xa0  -     　"
LETTER, DIGIT = r"\p{L}", r"\p{N}"
#: Letters and digits that came after Unicode 16, which the pattern engine here knows and the one of the library doesn't: marks to it.
LATER_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda "
    "18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 "
    "1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead "
    "323b0-33479 3d000-3fc3f"
)
LATER_DIGITS = (
    "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
)
#: Capitals that came with Unicode 16 and 17, which lower-casing knows and Python's tables don't: (first, count, first small one).
LATER_CAPITALS = (
    (0x1C89, 1, 0x1C8A), (0xA7CB, 1, 0x264), (0xA7CC, 1, 0xA7CD), (0xA7CE, 1, 0xA7CF), (0xA7D2, 1, 0xA7D3), (0xA7D4, 1, 0xA7D5),
    (0xA7DA, 1, 0xA7DB), (0xA7DC, 1, 0x19B), (0x10D50, 22, 0x10D70), (0x16EA0, 25, 0x16EBB),
)
#: Marks that came after the tables by which the library puts marks in order; to it they are letters that combine with nothing.
LATER_MARKS = (
    "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 "
    "10f82-10f85 11070 1133b 1145e 11839-1183a 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 "
    "16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)
#: Two characters that it doesn't compose.
APART = ("\U00011935", "\U00011930")
END = "</w>"
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if it's visible, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


@dataclass
class Vocabulary:
    tokens: list[str]
    added: dict[str, int]
    inner: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    known: dict[str | int, int] = field(default_factory=dict)
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        vocab = d["model"]["vocab"]
        added = {a["content"]: a["id"] for a in d["added_tokens"]}
        names = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for name, i in chain(vocab.items(), added.items()):
            names[i] = name
        size = len(names)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        rows = {vocab[a] * size + vocab[b]: (k, vocab[a + b]) for k, (a, b) in reversed([*enumerate(pairs)])}
        keys = np.array(sorted(rows), np.int64)
        symbols = byte_symbols()
        return cls(
            names,
            added,
            np.array([vocab[s] for s in symbols], np.int64),
            np.array([vocab[s + END] for s in symbols], np.int64),
            keys,
            np.array([rows[k][0] for k in keys.tolist()], np.int64),
            np.array([rows[k][1] for k in keys.tolist()], np.int64),
        )

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "flat": np.zeros(0, np.int32), "size": np.zeros(0, np.int64)}

    def pair_ranks(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that start at these places; NONE where there is no such pair."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * len(self.tokens) + sym[nxt]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[found] == key) & (owner[at] == owner[nxt]) & (nxt > at)
        return np.where(hit, self.ranks[found], NONE), self.merged[found]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in one array, and how many each word has."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(b) for b in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum(sizes)
        sym = self.inner[data]
        sym[end - 1] = self.last[data[end - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        rank, into = self.pair_ranks(sym, owner, np.arange(len(sym)))
        done_sym, done_owner = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            best_here = np.repeat(best, np.diff(np.concatenate([starts, [len(sym)]])))
            open_ = best_here != NONE
            if not open_.all():
                done_sym.append(sym[~open_])
                done_owner.append(owner[~open_])
            # of places side by side (x x x), every second one
            place = np.flatnonzero(open_ & (rank == best_here))
            changed = np.zeros(len(sym), bool)
            if len(place):
                new_run = np.concatenate([[True], place[1:] != place[:-1] + 1])
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - run_start) % 2 == 0]
                sym[place] = into[place]
                open_[place + 1] = False
                changed[place] = True
            sym, owner, rank, into, changed = sym[open_], owner[open_], rank[open_], into[open_], changed[open_]
            # only pairs with a merged symbol have another rank
            changed[:-1] |= changed[1:]
            at = np.flatnonzero(changed)
            if len(at):
                rank[at], into[at] = self.pair_ranks(sym, owner, at)
        all_sym, all_owner = np.concatenate(done_sym), np.concatenate(done_owner)
        return all_sym[np.argsort(all_owner, kind="stable")].astype(np.int32), np.bincount(all_owner, minlength=len(words))

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of added tokens in it."""
        if not any(a in text for a in self.added):
            return words_of(text)
        cut = regex.split("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")", text)
        return [*chain.from_iterable([self.added[x]] if x in self.added else words_of(x) for x in cut)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. A word that was seen is a number, the place of its ids in the worker's table."""
        split = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.flat, self.size = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.known]
        named = [w for w in new if isinstance(w, str)]
        special = [w for w in new if not isinstance(w, str)]
        ids, sizes = self.merge_words(named) if named else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.known.update(zip([*named, *special], range(len(self.known), len(self.known) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, ids, np.array(special, np.int32)])
        self.size = np.concatenate([self.size, sizes, np.ones(len(special), np.int64)])
        counts = np.array([len(p) for p in split])
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        start, size = (np.cumsum(self.size) - self.size)[words], self.size[words]
        ends = np.cumsum(size)
        out = self.flat[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.split(out, cuts[:-1]) if texts else []

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def characters(ranges: str) -> str:
    """The inside of a character class, from ranges of code points in hexadecimal."""
    ends = [r.split("-") for r in ranges.split()]
    return "".join(rf"\U{int(e[0], 16):08x}-\U{int(e[-1], 16):08x}" for e in ends)


def word_pattern(letter: str = LETTER, digit: str = DIGIT, mark: str = "") -> regex.Pattern:
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|(?:[^{SPACE}{LETTER}{DIGIT}]{mark})+" if mark else rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|[^{SPACE}{letter}{digit}]+")


_letters, _digits = characters(LATER_LETTERS), characters(LATER_DIGITS)
_later = re.compile(f"[{_letters}{_digits}{characters(' '.join(f'{first:x}-{first + count - 1:x}' for first, count, _ in LATER_CAPITALS))}]")
_word = word_pattern()
_word_with_later = word_pattern(f"[{LETTER}--[{_letters}]]", f"[{DIGIT}--[{_digits}]]", f"|[{_letters}{_digits}]")
_small = {first + k: small + k for first, count, small in LATER_CAPITALS for k in range(count)}


_as_it_is = re.compile(f"[{characters(LATER_MARKS)}]|(?<={APART[0]})(?={APART[1]})")


def composed(text: str) -> str:
    """The text in NFC, by the tables of the library: what lies between LATER_MARKS by itself."""
    if not _as_it_is.search(text):
        return unicodedata.normalize("NFC", text)
    out, at = [], 0
    for m in _as_it_is.finditer(text):
        out += (unicodedata.normalize("NFC", text[at : m.start()]), m[0])
        at = m.end()
    return "".join([*out, unicodedata.normalize("NFC", text[at:])])


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case; letters and digits are those of Unicode 16, in texts that have later ones too."""
    if text.isascii():
        return _word.findall(text.lower())
    # character by character, so a final sigma is lower-cased like any other
    text = composed(text).replace("Σ", "σ")
    if _later.search(text):
        return _word_with_later.findall(text.translate(_small).lower())
    return _word.findall(text.lower())


def with_ids(docs: DataFrame, vocabulary: Vocabulary, decoded: bool = False) -> DataFrame:
    """docs with ``ids`` (array of int), the encoded text; with decoded, also what the ids decode to, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(text: pa.Array) -> list[pa.Array]:
        parts, shown = [], []
        for at in range(0, len(text), TEXTS):
            rows = held.value.encode([t or "" for t in text.slice(at, TEXTS).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), pa.int32())))
            if decoded:
                shown.append(pa.array([held.value.decode(r.tolist()) for r in rows], pa.string()))
        ids = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
        return [ids, pa.concat_arrays(shown) if shown else pa.array([], pa.string())] if decoded else [ids]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return samples.with_column(docs, ["ids", "decoded"][: 1 + decoded], fields[: 1 + decoded], make)


def with_text(encoded: DataFrame, vocabulary: Vocabulary, out: str = "decoded") -> DataFrame:
    """encoded with the tokens of its ``ids`` joined by a space, special ones included."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                ids = b.column(b.schema.get_field_index("ids"))
                made = pa.array([held.value.decode(x.as_py() or []) if x.is_valid else "" for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return encoded.mapInArrow(run, schema)
