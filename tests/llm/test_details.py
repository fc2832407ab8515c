"""Cases that earlier tests left out: odd marks, empty fits, shared phrases, folders."""

import os
import random
import time
import unicodedata
import warnings

import numpy as np
import pytest

from postline.llm import bpe, decontaminate, lines, tokens, toxicity

DOCS = "doc_id bigint, text string"


def test_composition_equals_the_library():
    nfc = pytest.importorskip("tokenizers.normalizers").NFC()
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))]
    rng = random.Random(2)
    for a in marks:
        text = "".join(f"a{a}{b}é{b}{a}" for b in marks)
        assert bpe.composed(text) == nfc.normalize_str(text)
    plain = [*"aeiouçéñ가각한", "\U00011935", "\U00011930", "\U00011938"]
    for _ in range(20_000):
        text = "".join(rng.choice(marks if rng.random() < 0.5 else plain) for _ in range(rng.randrange(1, 14)))
        assert bpe.composed(text) == nfc.normalize_str(text)


def test_bpe_of_mark_sequences(spark):
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rng = random.Random(3)
    marks = [chr(c) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))]
    texts = ["".join(rng.choice(marks) if rng.random() < 0.4 else rng.choice("ab É1!") for _ in range(60)) for _ in range(300)]
    out = bpe.with_ids(spark.createDataFrame(list(enumerate(texts)), DOCS), bpe.Vocabulary.load(public.path("word_bpe_49k.json")))
    for r in out.collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids


def test_toxicity_of_an_empty_table(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        assert (toxicity.forest(np.zeros((0, 5), bool), np.zeros(0), np.zeros(0)) == -1).all()


def test_many_items_with_a_phrase_that_a_text_repeats():
    words = 50_000
    phrases = decontaminate.Phrases.of([*range(400)], ["yes"] * 400, 10)
    data = np.frombuffer(b"yes " * words, np.uint8)
    began = time.time()
    made = decontaminate.shard(phrases, data, np.array([0, len(data)]), None)
    assert time.time() - began < 5
    assert made[0].to_pylist() == [words] and made[3].to_pylist() == [[*range(400)]] and made[1].to_pylist() == [[{"start": 0, "end": words}]]
    assert tokens.letter_table()[ord("y")]


def test_line_runs_lie_in_the_shared_folder_and_go(spark):
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    listing = lambda: {d for root, ds, _ in os.walk(at) for d in ds if d.startswith("line_run")}
    seen, write = [], lines.LineIndex.write_run

    class Watched(lines.LineIndex):
        def write_run(self, rows, level):
            name = write(self, rows, level)
            seen.append(len(listing()))
            return name

    docs = spark.createDataFrame([(k, "a line that many have\nown " + "x" * 9 + str(k)) for k in range(12)], DOCS)
    plain, lines.LineIndex = lines.LineIndex, Watched
    try:
        assert sum(r.n_dropped for r in lines.dedup_lines(docs).collect()) == 11
    finally:
        lines.LineIndex = plain
    assert seen and min(seen) > 0 and not listing() and not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]
