"""Fill-in-the-middle transformation of texts, cut between units by one numpy kernel over each Arrow batch's UTF-8 bytes.

A table gives every byte's class. Units start where a text starts and where two adjacent bytes' classes say so (after a line
feed for lines, after white space before something else for words); running sums of that mask, less what they were at the
text's start, number the units of every text, and one binary search finds the cuts of all texts together. What is cut is put
together again from the batch's bytes.

``transformed`` takes its random numbers as four columns of unsigned 32-bit integers, made from a hash of an id by ``draws``,
so that a text is treated the same way whenever and wherever it is computed. ``restored`` is its inverse, as a column.

Defined results: a null or empty text has no units and stays as it is, in plain form; a text that contains one of the marks
stays plain; a null id is hashed as the empty string, so such rows are alike but cut by their own units; repeated rows are
treated alike; texts of any length are cut whole; columns named like those that are added are replaced, others carried along;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks of the output, and the names of its forms.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Rows and bytes of text that are worked on at a time (more bytes only for a longer text).
ROWS, BYTES = 1_000, 1 << 23
DRAWS = ["_cut_a", "_cut_b", "_plain", "_order"]
MADE = [
    T.StructField("n_units", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


def line_classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of bytes, and which class after which starts a unit: anything after a line feed (1)."""
    table = np.zeros(256, np.uint8)
    table[0x0A] = 1
    return table, np.array([[False, False], [True, True]])


def word_classes() -> tuple[np.ndarray, np.ndarray]:
    """The same for words with the white space after them: anything but white space (1) after it."""
    table = np.zeros(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 1
    return table, np.array([[False, False], [True, False]])


UNITS = {"line": line_classes, "word": word_classes}


def draws(doc_id: str = "doc_id", seed: int = 7) -> dict[str, Column]:
    """The four numbers of a row: the first 8-digit groups of a SHA-256 over the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return {name: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k, name in enumerate(DRAWS)}


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of strings and the bounds of its rows in them; nulls are empty."""
    text = text.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    data = np.frombuffer(text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if text.buffers()[2] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def marked(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each row holds a mark."""
    kinds = np.zeros(256, bool)
    kinds[[m[1] for m in (PREFIX, SUFFIX, MIDDLE)]] = True
    at = np.flatnonzero((data[:-2] == ord("<")) & kinds[data[1:-1]] & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, np.int64)
    row = np.searchsorted(bounds, at, "right") - 1
    out = np.zeros(len(bounds) - 1, bool)
    out[row[at + 3 <= bounds[row + 1]]] = True
    return out


def kernel(text: pa.Array, numbers: list[np.ndarray], unit: str, fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """The columns of MADE for a batch."""
    data, bounds = text_bytes(text)
    begin, end = bounds[:-1], bounds[1:]
    table, starts_after = UNITS[unit]()
    kind = table[data]
    start = np.zeros(len(data), bool)
    start[1:] = starts_after[kind[:-1], kind[1:]]
    start[begin[begin < end]] = True
    place = np.flatnonzero(start)
    before = np.searchsorted(place, bounds)  # units of all texts before each text: the running sum at its start
    n = np.diff(before)
    first, second, plain_draw, order_draw = numbers
    a, b = first % (n + 1), second % (n + 1)
    # the place where so many units have ended: the start of the next one, or the text's end
    sentinel = np.append(place, len(data))
    cut = lambda k: np.where(k == n, end, sentinel[np.minimum(before[:-1] + k, len(place))])
    one, two = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    plain = (begin == end) | marked(data, bounds) | (plain_draw % 100 >= fim_percent)
    spm = ~plain & (order_draw % 100 < spm_percent)
    held, parts, size = memoryview(data), [], np.where(plain, end - begin, end - begin + 9)
    for i, (p, s, x, y, z, w) in enumerate(zip(plain.tolist(), spm.tolist(), begin.tolist(), one.tolist(), two.tolist(), end.tolist(), strict=True)):
        if p:
            parts.append(held[x:w])
        elif s:
            parts += (SUFFIX, held[z:w], PREFIX, held[x:y], MIDDLE, held[y:z])
        else:
            parts += (PREFIX, held[x:y], SUFFIX, held[z:w], MIDDLE, held[y:z])
    output = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(b"".join(parts))])
    form = pa.DictionaryArray.from_arrays(pa.array(np.where(plain, 0, np.where(spm, 2, 1)).astype(np.int8)), pa.array([PLAIN, PSM, SPM])).cast(pa.string())
    return [pa.array(n, pa.int64()), form, pa.array(chars[one] - chars[begin], pa.int64(), mask=plain), pa.array(chars[two] - chars[one], pa.int64(), mask=plain), output.cast(pa.string())]


def pieces(text: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces of a batch with at most ROWS rows and BYTES bytes, but at least a row."""
    sizes = np.diff(text_bytes(text)[1])
    first = filled = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and (filled + size > BYTES or i - first >= ROWS):
            yield first, i - first
            first, filled = i, 0
        filled += size
    if first < len(sizes):
        yield first, len(sizes) - first


def transformed(docs: DataFrame, doc_id: str = "doc_id", unit: str = "line", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """docs with n_units, form, prefix_chars, middle_chars (null if plain) and output. Of the texts, fim_percent are cut, and of
    those spm_percent have the suffix first."""
    docs = docs.drop(*[f.name for f in MADE], *DRAWS)
    schema = T.StructType([*docs.schema.fields, *MADE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, rows in pieces(whole.column(whole.schema.get_field_index("text"))):
                b = whole.slice(at, rows)
                numbers = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in DRAWS]
                made = kernel(b.column(b.schema.get_field_index("text")), numbers, unit, fim_percent, spm_percent)
                own = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name not in DRAWS]
                yield pa.RecordBatch.from_arrays([*own, *made], names=schema.names)

    return docs.withColumns(draws(doc_id, seed)).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from its output and form alone."""
    part = F.split(output, f"<[{PREFIX[1:2].decode()}{SUFFIX[1:2].decode()}{MIDDLE[1:2].decode()}]>", -1)
    get = lambda k: F.get(part, F.lit(k))
    return F.when(form == PSM, F.concat(get(1), get(3), get(2))).when(form == SPM, F.concat(get(2), get(3), get(1))).otherwise(output)
