"""The pipeline's stages against brute force: awkward rows, repeated ids, columns with the operators' own names."""

import json
import os
import random
import re

import corpus_pipeline
import pytest

CLASHING = ("score", "n_words", "items", "spans", "word_spans", "n_lines", "n_dropped", "ids", "decoded", "own", "row", "hash", "component_id", "_beside_0", "_r_doc")
PLAIN = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """(documents, folder of the tables): each document has a value of its own in every clashing column."""
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared, phrase = text(8), text(12)
    rows = [(k, f"{text(40)}\n{shared}\n{text(20)}") for k in range(12)] + [(20, f"{text(10)} {phrase} {text(10)}"), (21, phrase), (30, None), (31, ""), (32, " \n "), (33, text(4_000))]
    rows += [(40 + k, f"{text(30)} you idiot scum, pathetic moron {text(5)}") for k in range(8)] + [(None, f"{text(15)}\n{shared}"), rows[3], (3, text(30))]
    columns = ["doc_id", "text", "n_chars", *CLASHING]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), *[f"{c} {k}" for c in CLASHING]) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING))
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 40)) for k in range(50)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, phrase), (2, None), (None, "x"), (3, "!!")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    assert docs.columns == columns
    return spark.read.parquet(f"{at}/documents.parquet"), at, phrase, shared


def beside(rows):
    return {tuple(r[c] for c in CLASHING): r for r in rows}


def untouched(docs, kept):
    """Every kept row has the clashing columns of one of docs, unchanged, and its n_chars counts its text."""
    before, after = beside(docs.collect()), kept.collect()
    assert kept.columns == docs.columns and len(beside(after)) == len(after) and beside(after).keys() <= before.keys()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    return before, beside(after)


def test_toxic_documents_go(spark, awkward):
    docs, at, *_ = awkward
    before, after = untouched(docs, corpus_pipeline.reject_toxic(spark, docs, at))
    gone = {r.doc_id for k, r in before.items() if k not in after}
    assert gone <= set(range(40, 48)) and len(gone) >= 6 and all(after[k].text == before[k].text for k in after)


def test_repeated_lines_go(spark, awkward):
    docs, at, _, shared = awkward
    before, after = untouched(docs, corpus_pipeline.drop_repeated_lines(spark, docs, at))
    assert after.keys() == before.keys()
    first = {}
    for r in before.values():
        for line in (r.text or "").split("\n") if r.doc_id is not None else []:
            first[line.strip()] = min(first.get(line.strip(), r.doc_id), r.doc_id)
    for k, r in before.items():
        lines = (r.text or "").split("\n")
        assert after[k].text == "\n".join(x for x in lines if r.doc_id is None or len(x.strip()) < 10 or first[x.strip()] == r.doc_id)
    assert sum(shared in (r.text or "") for r in after.values()) == 2


def test_benchmark_passages_go(spark, awkward):
    docs, at, phrase, _ = awkward
    before, after = untouched(docs, corpus_pipeline.remove_benchmark_passages(spark, docs, at))
    assert after.keys() == before.keys()
    for k, r in before.items():
        assert PLAIN.findall(after[k].text) == PLAIN.findall((r.text or "").replace(phrase, ""))


def test_run_chains_all_stages_and_cleans_up(spark, awkward):
    docs, at, phrase, _ = awkward
    pytest.importorskip("public_tokenizers")
    shared = spark.sparkContext.getCheckpointDir() or ""
    out = corpus_pipeline.run(spark, at)
    got = out.collect()
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and 0 < len(got) < docs.count()
    assert all(r.n_tokens == len(r.ids) and phrase not in r.decoded for r in got) and {r.doc_id for r in got if r.doc_id == 33} == {33}
    folder = (shared or spark.sparkContext.getCheckpointDir()).removeprefix("file:")
    assert sum(name.startswith("pipeline-") for name in os.listdir(folder)) == 1
    assert json.dumps([s for s, _ in corpus_pipeline.STAGES]) == '["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe_encoding"]'


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, awkward, stage):
    docs, at, *_ = awkward
    assert stage(spark, docs.limit(0), at).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(3)
    fresh = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    a, b, c, d = (fresh() for _ in range(4))
    rows = [
        (1, a, "s"), (2, b, "s"), (2, f"{a} end", "s"),  # a near copy of 1 under the id of another text
        (3, c, "s"), (3, c, "t"), (3, f"{c} end", "s"),  # one document of the group stays
        (4, d, "s"), (5, d, "s"), (6, "", "s"), (6, "", "s"), (7, None, "s"), (None, a, "s"), (None, a, "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]

    def similar(x, y):
        p, q = ({tuple((t or "").split()[i : i + 3]) for i in range(len((t or "").split()) - 2)} for t in (x, y))
        return bool(p and q) and len(p & q) / len(p | q) >= 0.8

    named = sorted({(i, t or "") for i, t, _ in rows if i is not None})
    groups = []
    for pair in named:
        hit = next((g for g in groups if any(similar(pair[1], t) for _, t in g)), None)
        groups.append([pair]) if hit is None else hit.append(pair)
    got = sorted((i, t or "") for i, t in kept if i is not None)
    assert len(got) == len(groups) == 6
    for g in groups:
        (one,) = [x for x in got if x in g]
        assert one[0] == g[0][0]
    assert sum(i is None for i, _ in kept) == 2
