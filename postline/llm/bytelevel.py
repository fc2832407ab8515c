"""Byte-level BPE by a sentencepiece model that is written from a vocabulary of ranks.

``Codec.load`` reads a rank file (a token's bytes in base64, its rank) and serialises a sentencepiece model of kind BPE: every
token is a piece, its bytes mapped to visible characters, its score the negative rank, so that the model merges the pair of
lowest rank first as the ranks demand; the normaliser is the identity and adds or escapes nothing. A piece's place is its id, and
the unknown piece that a model must have stands behind the last. Texts are cut into pre-tokens by the vocabulary's pattern; each
distinct one is mapped and encoded by the model once in a worker, in batches. A pre-token that is a token itself is that token.
Decoding joins the pieces of the ids and maps them back to bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; ids outside the vocabulary are an error in
decoding; columns named ``ids`` and ``decoded`` are replaced, others carried along; repeated rows are encoded alike;
texts and pre-tokens of any length are encoded whole; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postline.llm import samples
from postline.llm.bpe import LATER_DIGITS, LATER_LETTERS, byte_symbols, characters

#: Pre-tokens that a worker remembers, and their bytes; beyond either it starts anew.
REMEMBERED, REMEMBERED_BYTES = 300_000, 1 << 24
#: Texts encoded at a time, and their characters at most (but for a longer text).
TEXTS, CHARS = 256, 1 << 21
#: Numbers of fields, kinds and values in a sentencepiece model file.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE_MODEL, UNKNOWN_ID = 3, 2, 40
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5

#: Letters and digits that the pattern engine of the library doesn't know as such, and the symbol that takes their place for cutting.
_later, SYMBOL = re.compile(f"[{characters(LATER_LETTERS)}{characters(LATER_DIGITS)}]"), "\u2603"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def number(tag: int, value: int) -> bytes:
    return varint(tag << 3) + varint(value)


def message(tag: int, body: bytes) -> bytes:
    return varint(tag << 3 | 2) + varint(len(body)) + body


def single(tag: int, value: float) -> bytes:
    return varint(tag << 3 | 5) + struct.pack("<f", value)


def serialised(tokens: list[str]) -> bytes:
    """A sentencepiece BPE model with these pieces, the first merged first, and one for the unknown behind them."""
    out = [message(PIECES, message(PIECE, t.encode()) + single(SCORE, -float(rank)) + number(TYPE, NORMAL)) for rank, t in enumerate(tokens)]
    out.append(message(PIECES, message(PIECE, b"<unk>") + single(SCORE, 0.0) + number(TYPE, UNKNOWN)))
    out.append(message(TRAINER, number(MODEL_TYPE, BPE_MODEL) + number(UNKNOWN_ID, len(tokens))))
    plain = b"".join(number(flag, 0) for flag in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES))
    out.append(message(NORMALIZER, message(NAME, b"identity") + plain))
    return b"".join(out)


@dataclass
class Codec:
    """A vocabulary with its model; what was seen stays in the worker's copy."""

    tokens: list[bytes]
    pattern: str
    model: bytes
    encoder: sentencepiece.SentencePieceProcessor | None = None

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in tokens] != [*range(len(tokens))] or not {bytes([b]) for b in range(256)} <= ranks.keys():
            raise ValueError(f"{path}: ranks are to be 0, 1, 2, ... and to have every byte")
        symbols = byte_symbols()
        return cls(tokens, pattern, serialised(["".join(symbols[b] for b in t) for t in tokens]))

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "pattern": self.pattern, "model": self.model, "encoder": None}

    def prepare(self) -> None:
        """Loads the model, once in a worker."""
        if self.encoder is not None:
            return
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.pieces = self.encoder.id_to_piece([*range(len(self.tokens))])
        self.shown = dict(enumerate(byte_symbols()))
        self.hidden = {ord(symbol): b for b, symbol in self.shown.items()}
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.cut = regex.compile(self.pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.held = 0

    def pre_tokens(self, text: str) -> list[str]:
        """The matches of the pattern. Letters and digits later than Unicode 16 are symbols, as for the library."""
        self.prepare()
        if not text.isascii() and _later.search(text):
            return [text[m.start() : m.end()] for m in self.cut.finditer(_later.sub(SYMBOL, text))]
        return self.cut.findall(text)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        raw = [w.encode() for w in words]
        made = self.encoder.encode([b.decode("latin-1").translate(self.shown) for b in raw], num_threads=1)
        return [[self.whole[b]] if b in self.whole else ids for b, ids in zip(raw, made, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. A pre-token that was seen is a number, the place of its ids in the worker's table."""
        split = [self.pre_tokens(t) for t in texts]
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.known]
        if new:
            made = self.encode_words(new)
            self.known.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), np.int32)])
            self.size = np.concatenate([self.size, np.array([len(ids) for ids in made], np.int64)])
            self.held += sum(map(len, new))
        counts = np.array([len(words) for words in split], np.int64)
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        start, own = (np.cumsum(self.size) - self.size)[words], self.size[words]
        ends = np.cumsum(own)
        out = self.flat[np.repeat(start - ends + own, own) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return np.split(out, np.concatenate([[0], ends])[np.cumsum(counts)][:-1]) if texts else []

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The bytes of the ids: their pieces joined, each character mapped back to its byte."""
        self.prepare()
        ids = np.asarray(ids, np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.tokens):
            raise ValueError("an id that is not of this vocabulary")
        return "".join(map(self.pieces.__getitem__, ids.tolist())).translate(self.hidden).encode("latin-1")


def groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, at most TEXTS and CHARS at a time, but at least one."""
    held, chars = [], 0
    for t in texts:
        if held and (len(held) >= TEXTS or chars + len(t) > CHARS):
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(rows), pa.int32()))


def with_ids(docs: DataFrame, codec: Codec, decoded: bool = False) -> DataFrame:
    """docs with ``ids`` (array of int), the encoded text; with decoded, also the bytes that the ids decode to, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(codec)

    def make(text: pa.Array) -> list[pa.Array]:
        ids, back = [], []
        for texts in groups([t or "" for t in text.to_pylist()]):
            rows = held.value.encode(texts)
            ids.append(lists(rows))
            if decoded:
                back.append(pa.array([held.value.decode(r) for r in rows], pa.binary()))
        out = [pa.concat_arrays(ids) if ids else pa.array([], pa.list_(pa.int32()))]
        return [*out, pa.concat_arrays(back) if back else pa.array([], pa.binary())] if decoded else out

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return samples.with_column(docs, ["ids", "decoded"][: 1 + decoded], fields[: 1 + decoded], make)


def with_bytes(encoded: DataFrame, codec: Codec, out: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ``ids`` decode to; null ids decode to none."""
    held = encoded.sparkSession.sparkContext.broadcast(codec)
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                made = pa.array([held.value.decode(x.as_py() or []) for x in b.column(b.schema.get_field_index("ids"))], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return encoded.mapInArrow(run, schema)
