"""Periodic runs, fill-in-the-middle and byte-level BPE against plain forms of the same rules, on awkward rows too."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postline.llm import bytelevel, fim, periodic, queries

DOCS = "doc_id bigint, text string, runs string, output string, ids string, decoded string, form int, n_words int"
AWKWARD = [
    None, "", " \n\t ", "one", "ab " * 30, "x y z " * 40 + "\n", "a\n\nb\nc", "\n\n\n", "<P> is a mark", "< P>\n<S\n>\n<M", "é\n☃ \U0001f600\nlast", "line <S>\n<M>", "long\n" * 5_000, "tail without end\n" * 3 + "x",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    prose = ["".join(rng.choice(["the ", "stone ", "12", "\n", "'ll ", "über ", "  ", "<P", "!?", "ա", "\t"]) for _ in range(rng.randrange(120))) for _ in range(40)]
    return [(i, t) for i, t in enumerate(AWKWARD + prose)] + [(3, "one"), (3, "one"), (None, "no id\nat all\n"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "r", "o", "i", "d", 1, 2) for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_text(df, *columns):
    return {(r["doc_id"], r["text"]): [r[c] for c in columns] for r in df.collect()}


def plain_runs(words, least=24, periods=3):
    """Every period, one word after another."""
    best = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q) and j > i:
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def repetitive(rng):
    words = []
    for _ in range(rng.randrange(7)):
        letters = rng.choice(["ab", "abcdefgh"])
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 14))]
        times = rng.randrange(1, 9)
        words += (unit * times)[: len(unit) * times - rng.randrange(len(unit))]
    return words


def test_runs_of_random_words_against_every_period():
    rng = random.Random(3)
    for _ in range(300):
        own = [repetitive(rng) for _ in range(3)]
        _, ids, bounds = periodic.interned([" ".join(w) for w in own])
        found = periodic.runs(ids, bounds).tolist()
        assert [[tuple(r[1:]) for r in found if r[0] == i] for i in range(3)] == [plain_runs(w) for w in own]


def test_runs_of_long_texts():
    for text, expected in (("a " * 30_000, (0, 30_000, 1)), ("x " + "a b c " * 9_000, (1, 27_000, 3)), (" ".join(str(i % 1_000) for i in range(20_500)), (0, 20_500, 1_000))):
        _, ids, bounds = periodic.interned([text])
        assert periodic.runs(ids, bounds).tolist() == [[0, *expected]]
    _, ids, bounds = periodic.interned(["a " * 23, "a " * 24, None, ("a b " * 11 + "a").strip()])
    assert periodic.runs(ids, bounds).tolist() == [[1, 0, 24, 1]]


def plain_collapsed(words):
    gone = {i for s, n, q in plain_runs(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_with_runs_on_awkward_rows(docs, rows, none):
    got = by_text(periodic.with_runs(docs), "n_words", "runs", "collapsed")
    for i, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        assert got[i, t] == [len(words), [*map(tuple, plain_runs(words))], plain_collapsed(words)]
    out = periodic.with_runs(none)
    assert out.count() == 0 and [c for c in out.columns if c in ("runs", "n_words", "output")] == ["output", "n_words", "runs"]
    assert periodic.with_runs(docs).count() == len(rows)


def test_runs_where_pieces_are_small(docs, rows, monkeypatch):
    texts = [t for _, t in rows]
    monkeypatch.setattr(periodic, "WORDS", 40)
    assert [t for g in periodic.groups(texts) for t in g] == texts and max(map(len, periodic.groups(texts))) < 12


def plain_planted(doc_id, words):
    """The texts of the query's contract, word by word."""
    import zlib

    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_op11_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(150)))) for i in range(600)] + [(700, None), (701, ""), (702, "  \n"), (None, "word " * 30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        words = plain_planted(i, (t or "").split()) if i is not None else t.split()
        own = plain_runs(words)
        best = max(own, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[i] == (len(own), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in own)), sha(plain_collapsed(words)))
    assert sum(bool(r[0]) for r in got.values()) > 20


def plain_fim(doc_id, text, unit=r"[^\n]*\n|[^\n]+", fim_percent=100, spm_percent=50):
    text = text or ""
    parts = re.findall(unit, text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return [len(parts), "plain", None, None, text]
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    spm = h[3] % 100 < spm_percent
    return [len(parts), "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"]


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+")])
def test_fim_against_plain_cuts(docs, rows, none, unit, pattern):
    out = fim.transformed(docs, unit=unit, fim_percent=80, spm_percent=30).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = by_text(out, "n_units", "form", "prefix_chars", "middle_chars", "output", "back")
    for i, t in rows:
        assert got[i, t] == [*plain_fim(i, t, pattern, 80, 30), t or ""]
    assert len({v[1] for v in got.values()}) == 3 and out.count() == len(rows)
    empty = fim.transformed(none)
    assert empty.count() == 0 and empty.columns == [*[c for c in none.columns if c not in ("output", "form")], *[f.name for f in fim.MADE]]


def test_fim_kernel_on_slices_and_small_pieces(rows, monkeypatch):
    texts = pa.array([t for _, t in rows])
    numbers = [np.array([(i or 0) * 7 + k for i, _ in rows]) for k in range(4)]
    whole = [c.to_pylist() for c in fim.kernel(texts, numbers, "line", 100, 50)]
    monkeypatch.setattr(fim, "BYTES", 200)
    parts = [fim.kernel(texts.slice(at, n), [x[at : at + n] for x in numbers], "line", 100, 50) for at, n in fim.pieces(texts)]
    assert len(parts) > 5 and [[v for p in parts for v in p[k].to_pylist()] for k in range(5)] == whole


def test_op12_restores_every_text(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(queries.op12_fill_in_middle(spark, str(tmp_path)).collect(), key=repr)
    expected = []
    for i, t in rows:
        n, form, prefix, middle, output = plain_fim(i, t)
        expected.append((i, n, form, prefix, middle, sha(output), sha(t or "")))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


@pytest.fixture(scope="module")
def codec():
    P = pytest.importorskip("public_tokenizers")
    return bytelevel.Codec.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(docs, rows, none, codec, library):
    out = bytelevel.with_ids(docs, codec, decoded=True)
    got = by_text(out, "ids", "decoded")
    for i, t in rows:
        assert got[i, t] == [library.encode_ordinary(t or ""), bytearray((t or "").encode())]
    again = by_text(bytelevel.with_bytes(bytelevel.with_ids(docs, codec), codec), "decoded")
    assert all(again[i, t] == [bytearray((t or "").encode())] for i, t in rows)
    assert bytelevel.with_ids(none, codec, decoded=True).count() == 0 and out.count() == len(rows)


def test_byte_bpe_of_all_characters_and_random_strings(codec, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}!{c}{c}" for c in chars[k : k + 500]) for k in range(0, len(chars), 500)]
    rng = random.Random(5)
    common = [*map(chr, range(0x500)), *" \n\t'sdtmlrev0123", "　", " ", "\x1c", "\x85", "՘", "\U0001f600"]
    texts += ["".join(rng.choice(common) for _ in range(rng.randrange(40))) for _ in range(3_000)]
    texts += [" " * 3_000 + "x", "a" * 20_000, "\n" * 5_000, "ab" * 9_000 + "!", "<|endoftext|> <unk>"]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        ids = codec.encode(part)
        assert [x.tolist() for x in ids] == library.encode_ordinary_batch(part)
        assert [codec.decode(x.tolist()).decode() for x in ids] == part


def test_byte_bpe_forgets_and_refuses(codec, library, monkeypatch):
    monkeypatch.setattr(bytelevel, "REMEMBERED", 3)
    for text in ("one two three four", "one two five six seven", ""):
        assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert codec.encode([]) == [] and codec.decode([]) == b""
    with pytest.raises(ValueError):
        codec.decode([len(codec.tokens)])
    assert [*bytelevel.groups(["a"] * 300)][0] == ["a"] * bytelevel.TEXTS
