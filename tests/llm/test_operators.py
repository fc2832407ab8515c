"""Each operator on awkward rows: nulls in any column, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import collections
import hashlib
import math
import os
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from postline.llm import bpe, chat, decontaminate, divergence, jaccard, lines, pii, quality, queries, repeats, tokens, toxicity
from postline.llm import components as components_module
from postline.llm.common import Scratch
from postline.llm.components import components, contracted

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORD, LETTER_WORD = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def prose(rng, n, words=("the", "of", "and", "tion", "era", "stone", "léger", "über", "Water", "is", "in", "a1", "quick", "brown")):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, prose(rng, rng.choice([3, 20, 80, 200])), rng.choice(["en", "de", None]), "s", 1) for i in range(30)]
    long = prose(rng, 6_000)
    out += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "   \n\t ", "en", "s", 5), (103, long, "en", "s", 1), (104, long[:9_000], "fr", "s", 1), (105, out[5][1], "en", "s", 1)]
    out += [out[3], out[3], (None, "a row without an id but with text", "en", "s", 1), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens_match_regular_expressions(rows):
    texts = [r[1] or "" for r in rows] + ["x", "\n", "aé\u00a0b c"]
    import pyarrow as pa

    for table, pattern in ((tokens.blank_table(), BLANK_WORD), (tokens.letter_table(), LETTER_WORD)):
        got = {}
        for first, data, bounds in tokens.slices(pa.array(texts), 200):
            w = tokens.Words(data, bounds, table)
            h = w.hashes()
            for i in range(len(bounds) - 1):
                own = slice(w.first[i], w.first[i + 1])
                got[first + i] = [bytes(data[a:b]).decode() for a, b in zip(w.start[own], w.end[own], strict=True)], h[own].tolist()
        assert [[x.translate(ASCII_LOWER) for x in got[i][0]] for i in range(len(texts))] == [pattern.findall(t.translate(ASCII_LOWER)) for t in texts]
        known = {}
        for i, t in enumerate(texts):
            for word, h in zip(got[i][0], got[i][1], strict=True):
                assert known.setdefault(word.translate(ASCII_LOWER), h) == h
        assert len(set(known.values())) == len(known)


def test_divergence_counts_and_verdicts(spark, docs, none):
    junk = [(1000 + i, " ".join(f"w{i}x{k} |" for k in range(80)), "en", "s", 1) for i in range(3)]
    clash = docs.unionByName(spark.createDataFrame(junk, DOCS)).withColumn("kept", F.lit("mine")).drop("kept")
    got = divergence.judge(clash).collect()
    texts = collections.defaultdict(list)
    for r in clash.collect():
        texts[r.doc_id].append(r.text)
    assert len(got) == clash.count()
    for r in got:
        if r.doc_id is None:
            continue
        t = texts[r.doc_id][0] or ""
        w = BLANK_WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = collections.Counter(grams)
        under = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
        full = [x for x in t.split("\n") if BLANK_WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(under))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)))
        assert r.base_failed == (len(w) < 50 or 100 * len(under) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert divergence.judge(none).count() == 0


def test_divergence_leaves_prose_and_drops_tables(spark):
    rng = random.Random(1)
    common = divergence.COMMON_WORDS["en"]
    body = lambda: " ".join(rng.choice(common) if rng.random() < 0.35 else "".join(rng.choice("abcdefghilmnoprst") for _ in range(6)) for _ in range(200))
    good = [(i, body(), "en", "s", 1) for i in range(40)]
    bad = [(100 + i, " | ".join("".join(rng.choice("abcdefghilmnoprst") for _ in range(7)) for _ in range(150)), "en", "s", 1) for i in range(3)]
    kept = {r.doc_id for r in divergence.judge(spark.createDataFrame(good + bad, DOCS)).filter("kept").collect()}
    assert kept == set(range(40))


def test_decontamination_against_brute_force(spark, docs, rows, none):
    rng = random.Random(9)
    passage = BLANK_WORD.findall(rows[8][1])[:14] if len(BLANK_WORD.findall(rows[8][1])) >= 14 else BLANK_WORD.findall(rows[103 - 70][1])[:14]
    items = [(1, " ".join(passage).upper()), (2, "quick brown"), (3, None), (4, "!!"), (None, "the of"), (5, "nowhere to be found in any text of the table at all"), (6, prose(rng, 30)), (7, " ".join(passage))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    phrases = collections.defaultdict(set)
    for i, t in items:
        w = LETTER_WORD.findall((t or "").translate(ASCII_LOWER)) if i is not None else []
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[k : k + n])].add(i)
    for d, t, *_ in rows:
        w = LETTER_WORD.findall((t or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for p, owners in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= owners
        want[d, t] = (len(w), len(hit), sorted(found))
    for words in (decontaminate.BLOCK_WORDS, 12):  # in one block, and in several
        out = decontaminate.mark(docs.withColumn("items", F.lit("mine")), benchmark, block_words=words).withColumn("n_hit", decontaminate.hit_words())
        got = out.collect()
        assert len(got) == len(rows)
        assert all((r.n_words, r.n_hit, sorted(r["items"])) == want[r.doc_id, r.text] for r in got)
    clean = {(r.doc_id, r.text) for r in decontaminate.without_spans(out).collect()}
    again = decontaminate.mark(spark.createDataFrame([(0, t) for _, t in clean if t], "doc_id bigint, text string"), benchmark.filter("item_id in (1, 7)"))
    assert again.filter(decontaminate.hit_words() > 0).count() == 0
    assert decontaminate.mark(none, benchmark).count() == 0 and decontaminate.mark(docs, benchmark.limit(0)).filter("size(spans) > 0").count() == 0


def test_line_dedup_against_brute_force(spark, none):
    rng = random.Random(2)
    pool = ["A Common Line of text", "  a common line of text\t", "short", "", "another shared line é", "ÀÉÎ upper line here"]
    rows = [(rng.randrange(50) * 2, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {i} {k} line" for k in range(rng.randrange(1, 9)))) for i in range(60)]
    rows = [*{r[0]: r for r in rows}.values(), (1, None), (3, ""), (None, "A Common Line of text")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("owner", F.lit("mine"))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    first = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                first[key(x)] = min(first.get(key(x), d), d)
    for batches in (1, 3):
        got = lines.dedup_lines(df, batches=batches).collect()
        assert len(got) == len(rows)
        want = collections.Counter()
        for d, t in rows:
            parts = (t or "").split("\n")
            kept = [x for x in parts if d is None or len(key(x)) < 10 or first[key(x)] == d]
            want[d, "\n".join(kept), len(parts), len(parts) - len(kept)] += 1
        assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == want
    assert lines.dedup_lines(none).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_line_runs_are_joined_in_their_order(spark, monkeypatch):
    """Neither a batch's join nor a compaction shuffles or sorts a run; tables go even if a batch fails."""
    plans, write = [], lines.LineIndex.write_run
    monkeypatch.setattr(lines.LineIndex, "write_run", lambda self, rows, level: (plans.append((level, rows._jdf.queryExecution().executedPlan().toString())), write(self, rows, level))[1])
    docs = spark.createDataFrame([(i, f"a line of its own {i}\nand a line that all have") for i in range(40)], "doc_id bigint, text string")
    assert lines.dedup_lines(docs).agg(F.sum("n_dropped")).first()[0] == 39
    assert [level for level, _ in plans] == [0, 0, 1, 0, 0, 1, 2]
    for level, plan in plans:
        assert plan.count("Exchange ") == (level == 0) and plan.count("Sort [") <= (level == 0) and not re.search("Python|Arrow", plan)
        assert "SortMergeJoin" in plan or plan.count("Scan parquet spark_catalog") == 0
    monkeypatch.setattr(lines.LineIndex, "compact", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        lines.dedup_lines(docs)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]
    assert spark.conf.get(lines.LineIndex.ORDERED) == "false"


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_against_brute_force(spark, none, monkeypatch, small):
    """small: bounds so low that buckets, groups and queries are split, leaders run out, and half of the tokens count as frequent."""
    if small:
        for name, value in {"LEADERS": 2, "GROUP": 3, "CHUNK": 4, "QUERIES": 2}.items():
            monkeypatch.setattr(jaccard, name, value)
        monkeypatch.setattr(jaccard, "hot_cells", lambda rows: np.arange(0, 1 << jaccard.SKETCH_BITS, 2, dtype=np.int32))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(rng.choice([1, 3, 9])):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.05]) else w for w in text]
            rows.append((rng.randrange(10**9), " ".join(copy)))
    shared = " ".join(word() for _ in range(30))
    rows += [(rng.randrange(10**9), f"{shared} {' '.join(word() for _ in range(60))}") for _ in range(25)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One Two"), (5, "one two"), (6, rows[0][1].upper()), (None, rows[0][1]), rows[0]]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("mine"))).collect()
    sets = {}
    for d, t in rows:
        w = BLANK_WORD.findall((t or "").translate(ASCII_LOWER))
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = [d for d in sets if d is not None]
    label = {d: d for d in ids}
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is not None:
            assert r.component_id == label[r.doc_id]
    assert jaccard.similar(none).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed")]


def test_texts_stay_in_their_buckets(spark):
    """Each distinct text is stored once, and a join by its hash shuffles only what is wanted of it."""
    docs = spark.createDataFrame([(i, f"text {i % 30}" if i % 7 else None) for i in range(90)], "doc_id bigint, text string")
    with Scratch(spark) as scratch:
        texts = jaccard.distinct_texts(docs, scratch)
        assert sorted(r.text for r in texts.collect()) == sorted({r.text for r in docs.collect() if r.text})
        joined = jaccard.with_text(texts, docs.select(F.xxhash64("text").alias("mark"), "doc_id").hint("merge"))
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        assert joined.count() == docs.filter("text IS NOT NULL").count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed")]


def shuffle_files(spark):
    """The sizes of the shuffle files that are on disk, by path."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def gone(spark, before):
    for _ in range(50):
        if not shuffle_files(spark).keys() - before:
            return True
        time.sleep(0.1)
    return False


def test_free_lets_go_of_the_last_shuffle(spark):
    with Scratch(spark) as scratch:
        before = shuffle_files(spark).keys()
        scratch.cut(spark.range(1000).groupBy(F.col("id") % 7).count())
        assert shuffle_files(spark).keys() - before
        scratch.free()
        assert gone(spark, before)


def test_jaccard_never_holds_all_shuffles(spark, monkeypatch):
    """Texts and prefixes move in passes: less than six tenths of the tokens' bytes are on disk at any time."""
    rng = random.Random(5)
    docs, words = 300, 400
    rows = [(k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(words))) for k in range(docs)]
    held, before = [0], shuffle_files(spark).keys()
    free = Scratch.free

    def spied(self, *dfs):
        held.append(sum(size for f, size in shuffle_files(spark).items() if f not in before))
        free(self, *dfs)
        gone(spark, before)

    monkeypatch.setattr(Scratch, "free", spied)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(k, k) for k in range(docs)]
    assert 0 < max(held) < 0.6 * 16 * docs * jaccard.prefix_size(words - 4)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    with Scratch(spark) as scratch:
        got = {r.node: r.label for r in components(contracted(spark.createDataFrame(edges, "a bigint, b bigint")), scratch).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)}


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_components_against_union_find(spark, monkeypatch, block):
    """Chains, a hub whose number is the largest, and random edges, contracted in blocks of few edges too."""
    monkeypatch.setattr(components_module, "BLOCK", block)
    rng = random.Random(block)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, 400 + k) for k in range(50)] + [(600 - k, 599 - k) for k in range(30)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    with Scratch(spark) as scratch:
        got = components(contracted(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)), scratch).collect()
    joined = {n for a, b in edges if a != b for n in (a, b)}
    assert len(got) == len(joined) and {r.node: r.label for r in got} == {n: root[n] for n in joined}


def test_repeats_against_brute_force(spark, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, f"{' '.join(word() for _ in range(rng.randrange(60)))} {passage[rng.randrange(60):]} {' '.join(word() for _ in range(rng.randrange(60)))}") for i in range(25)]
    rows += [(100, "x" * 300), (101, "ab" * 120), (102, "b" * 100), (103, "b" * 100), (104, "b" * 99), (105, None), (106, ""), (107, "é" * 90), (108, "é" * 90), (109, rows[3][1])]
    rows += [rows[3], (None, rows[3][1])]
    got = repeats.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit("mine"))).collect()
    assert len(got) == len(rows)
    seen, want = set(), {}
    for d, t in sorted({r for r in rows if r[0] is not None}):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        want[d] = (len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0 and bytes(r.kept) == r.text.encode()
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert repeats.dedup(none).count() == 0


@pytest.mark.parametrize("at_once", [10_000, 7])
def test_repeats_of_a_passage_that_every_document_goes_on_from(spark, monkeypatch, at_once):
    """No task gets all contexts of a crowded side, and the result is that of brute force."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    passage = " ".join(word() for _ in range(30))
    ends = [" ".join(word() for _ in range(25)) for _ in range(6)]
    rows = [(i, f"{' '.join(word() for _ in range(25))} {passage} {ends[i] if i < 6 else ' '.join(word() for _ in range(25))}") for i in range(60)]
    # ends that recur behind the passage, so that strings of crowded sides recur beyond it
    rows += [(100 + i, f"{word()} {passage} {ends[i % 6]} {word()}") for i in range(12)] + [rows[7], (8, "another text"), (8, rows[9][1])]
    monkeypatch.setattr(repeats, "CROWD", 16)
    monkeypatch.setattr(repeats, "ARRAY_BYTES", 1 << 18 if at_once > 7 else 1 << 10)
    groups, compared = [], repeats.compared
    monkeypatch.setattr(repeats, "compared", lambda r: (groups.append(r.groupBy("key").count().agg(F.max("count")).first()[0]), compared(r))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
    try:
        got = repeats.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        texts = spark.createDataFrame(rows, "doc_id bigint, text string").distinct().orderBy("doc_id", repeats.text_hash()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (groups[0] or 0) <= 16
    seen, want = set(), {}
    for d, t in texts:
        b, gone = t.encode(), bytearray(len(t))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want[d, t] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    assert [bytes(r.kept) for r in got] == [want[r.doc_id, r.text] for r in got] and sum(r.n_removed > 0 for r in got) > 60


def test_pii_base_and_candidates(spark, none):
    text = "mail a.b@x.org, ip 10.0.0.1 and 999.1.1.1, card 4242 4242 4242 4242, call +1 (555) 123-4567. phone (555) 123-4567, write to joe (at) mail (dot) com é"
    rows = [(1, text), (2, None), (3, ""), (4, "1" * 50_000 + " " + "a" * 50_000 + "@"), (5, "nothing here at all. 12 and 7"), (1, text)]
    out = pii.with_spans(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("mine")))
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append([(s["kind"], r.text[s["start"] : s["end"]], s["base"]) for s in r.spans])
    base = [(k, t) for k, t, b in got[1][0] if b]
    assert base == [("email", "a.b@x.org"), ("ip", "10.0.0.1"), ("card", "4242 4242 4242 4242"), ("phone", "+1 (555) 123-4567")]
    assert {(k, t) for k, t, b in got[1][0] if not b} == {("email", "joe (at) mail (dot) com"), ("phone", "(555) 123-4567")}
    assert got[2] == got[3] == got[5] == [[]] and len(got[1]) == 2
    shown = {r.doc_id: r.text for r in pii.redact(out).collect()}
    assert shown[1].startswith("mail [EMAIL], ip [IP] and 999.1.1.1, card [CARD], call [PHONE].")
    assert pii.with_spans(none).count() == 0


def test_pii_base_spans_against_plain_patterns():
    rng = random.Random(12)
    parts = ["0", "1", "25", "255", "256", "4242 4242 4242 4242", "4242-4242-4242-4241", "10.0.0.1", "1.2.3.4.5", "+1 (555) 123-4567", "+", ".", "-", " ", "  ", "(", ")", "a", "é", "@", "@x", "x.y@", "a@b.c", "_%", "@@", "..", "\n", "-.", "7" * 13]
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }

    def luhn(digits):
        doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
        return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0

    found = collections.Counter()
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        want = [(k, m.start(), m.end()) for k, (kind, (pattern, ok)) in enumerate(kinds.items()) for m in re.finditer(pattern, text) if ok(m[0])]
        assert pii.base_spans(text) == sorted(want), text
        found.update(k for k, *_ in want)
    assert min(found[k] for k in range(4)) > 50


def test_pii_many_spans_and_secrets():
    text = "key: 9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c, " * 3_000 + "commit 9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c and call (555) 123-4567 now " * 3_000
    (spans,) = pii.find([text], pii.fit())
    kinds = collections.Counter(s["kind"] for s in spans)
    assert kinds["secret"] == 3_000 and kinds["phone"] == 3_000
    assert all(a["end"] <= b["start"] for a, b in zip(sorted(spans, key=lambda s: s["start"]), sorted(spans, key=lambda s: s["start"])[1:]))


def test_pii_held_out_examples():
    import numpy as np

    model, unseen = pii.fit(), pii.examples(99)
    p = model.trees.scores(np.array([pii.describe(t, k, a, b) for t, k, a, b, _ in unseen]))
    y, taken = np.array([e[4] for e in unseen]), p >= np.array(model.thresholds)[[e[1] for e in unseen]]
    assert y[taken].mean() > 0.95 and taken[y == 1].mean() > 0.9


def labelled(spark, mark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        docs.append((i, prose(rng, 40) + (mark(rng) if bad else "")))
        labels.append((i, int(not bad), int(bad)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    labels += [(0, 1, 0), (None, 1, 1), (7, None, None)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_learns_and_scores_all(spark, none):
    docs, labels = labelled(spark, lambda rng: " | ".join(["zz"] * 20))
    model = quality.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = quality.score(docs.withColumn("score", F.lit("mine")), model).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id % 5 == 0 and r.doc_id < 300]
    assert sum((r.score >= 0.3) == (r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    empty = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {round(r.score, 3) for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(none, model).count() == 0


def test_toxicity_learns_and_scores_all(spark, none):
    docs, labels = labelled(spark, lambda rng: " " + rng.choice(["idiot", "vequta", "vequsse"]) + " you scum")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 2)
    got = toxicity.score(docs.withColumn("score", F.lit("mine")), model).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id % 4 == 2 and r.doc_id < 300]
    assert sum((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in held) / len(held) > 0.95
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).count() == 303
    assert toxicity.score(none, model).count() == 0


def test_quality_fit_against_a_dense_twin():
    """Log-count ratios and dual coordinate descent, over dense rows in plain loops."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 12)) + (20 if k % 2 else 0)).astype(np.int32) for k in range(80)]
    y = np.array([k % 2 if rng.random() < 0.85 else 1 - k % 2 for k in range(80)])
    model = quality.fit_rows(rows, y)
    draw = np.random.default_rng(7)
    fit = [k for k, out in enumerate(draw.random(80) < 0.25) if not out]
    count = [[sum(y[k] == c and b in rows[k] for k in fit) + quality.SMOOTHING for b in range(quality.BUCKETS)[:60]] for c in (0, 1)]
    total = [sum(c) + quality.SMOOTHING * (quality.BUCKETS - 60) for c in count]
    ratio = [math.log(q / total[1] / (p / total[0])) if p + q > 2 * quality.SMOOTHING else 0.0 for p, q in zip(*count, strict=True)]
    dense = []
    for r in rows:
        size = math.sqrt(sum(ratio[b] ** 2 for b in r) + 1e-9)
        dense.append([ratio[b] / size if b in r else 0.0 for b in range(60)])
    cap = [quality.PENALTY * 0.5 / max(sum(y[k] == c for k in fit) / len(fit), 0.02) for c in (0, 1)]
    w, bias, alpha = [0.0] * 60, 0.0, [0.0] * 80
    for _ in range(quality.EPOCHS):
        for k in draw.permutation(np.array(fit)):
            sign = 1 if y[k] else -1
            step = min(max(alpha[k] - (sign * (sum(a * b for a, b in zip(w, dense[k], strict=True)) + bias) - 1) / 2, 0.0), cap[y[k]]) - alpha[k]
            alpha[k] += step
            w, bias = [a + step * sign * b for a, b in zip(w, dense[k], strict=True)], bias + step * sign
    assert np.allclose(model.weight[:60], [a * b for a, b in zip(w, ratio, strict=True)], atol=1e-4) and abs(model.bias - bias) < 1e-6


def test_label_model_against_a_twin_over_documents(monkeypatch):
    """Expectation maximisation from counts of patterns equals that over documents one by one, with no voter depending on another."""
    monkeypatch.setattr(toxicity, "DEPENDENT", math.inf)
    rng = np.random.default_rng(3)
    truth = rng.random(400) < 0.2
    votes = rng.random((400, 4)) < np.where(truth[:, None], [0.7, 0.5, 0.4, 0.6], [0.02, 0.01, 0.05, 0.0])
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    got = toxicity.fit_label_model(patterns, n, 0.1).posterior(patterns)[which.ravel()]
    q = [0.9 if v.any() else 0.02 for v in votes]
    for _ in range(40):
        rate = []
        for y in (0, 1):
            w = [p if y else 1 - p for p in q]
            guess = 0.3 if y else 0.002
            rate.append([min(max((sum(a for a, v in zip(w, votes, strict=True) if v[i]) + guess) / (sum(w) + 1.0), 1e-5), 1 - 1e-5) for i in range(4)])
        prior = (sum(q) + 1) / 410
        odds = [math.log(prior / (1 - prior)) + sum(math.log(rate[1][i] / rate[0][i] if v[i] else (1 - rate[1][i]) / (1 - rate[0][i])) for i in range(4)) for v in votes]
        q = [1 / (1 + math.exp(-o)) for o in odds]
    assert np.allclose(got, q, atol=1e-6) and ((got > 0.5) == truth).mean() > 0.9


def test_bpe_equals_the_library(spark, rows, docs, none):
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("word_bpe_49k.json"))
    more = ["don't I'LL 'S", "a<|endoftext|>b <|startoftext|>C", "a" * 60 + " hahahaha", "ΑΣ ΣΑΣ İstanbul ﬁ", "日本語 123 ½", "🙂👍🏽 foo_bar... \x1c\x85"]
    # each character that has a later or an odd place in Unicode, by itself, in a word, beside marks and beside digits
    code_points = [c for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000]
    more += [" ".join(x.replace("?", chr(c)) for c in code_points[k : k + 4_000]) for x in ("?", "a?a", "!?!", "1?1") for k in range(0, len(code_points), 4_000)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string"))
    vocabulary = bpe.Vocabulary.load(public.path("word_bpe_49k.json"))
    both = bpe.with_ids(df.withColumn("ids", F.lit("mine")), vocabulary, decoded=True)
    apart = bpe.with_text(bpe.with_ids(df, vocabulary), vocabulary)
    for out in (both, apart):
        got = out.collect()
        assert len(got) == len(rows) + len(more)
        for r in got:
            want = library.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.with_ids(none, vocabulary).count() == 0


NODES = "tree bigint, node bigint, parent bigint, role string, text string, score double"


def test_chat_paths_escape_and_mask(spark):
    odd = r"\### Assistant: </turn> ok \l \\h <b>#"
    rows = [
        (1, 1, None, "user", odd, 0.0), (1, 2, 1, "assistant", odd, 1.0), (1, 3, 1, "assistant", "worse", 0.5), (1, 4, 2, "user", None, 2.0), (1, 5, 4, "assistant", "", 3.0), (1, 5, 4, "assistant", "", 3.0),
        (2, 1, 99, "system", "root by a missing parent", None), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (3, 3, 2, "user", "below", 1.0),
        (None, 1, None, "user", "x", 1.0), (4, None, None, "user", "x", 1.0), (5, 1, None, None, "a", None), (5, 2, 1, "a:\n### b", "c", None), (5, 3, 1, "assistant", "d", None),
    ]
    df = spark.createDataFrame(rows, NODES).withColumn("depth", F.lit("mine"))
    out = {r.tree: r for r in chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert set(out) == {1, 2, 5}
    assert [tuple(t) for t in out[1].back] == [("user", odd), ("assistant", odd), ("user", ""), ("assistant", "")]
    assert [tuple(t) for t in out[5].back] == [("", "a"), ("a:\n### b", "c")]
    for r in out.values():
        trained = [t for t in r.back if t.role == "assistant"]
        assert len(r.loss) == len(trained)
        for span, turn in zip(r.loss, trained, strict=True):
            cut = r.formatted[span.start : span.start + span.length]
            for plain, code in reversed(chat.CODES):
                cut = cut.replace(code, plain)
            assert cut == turn.text
    two = chat.format_conversations(df, branches=2).collect()
    assert sorted((r.tree, r.leaf) for r in two) == [(1, 3), (1, 5), (2, 1), (5, 2), (5, 3)]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_long_chain(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", str(i), 0.0) for i in range(300)]
    r = chat.format_conversations(spark.createDataFrame(rows, NODES)).first()
    assert r.n_turns == 300 and hashlib.sha256("".join(str(i) for i in range(0, 300, 2)).encode()).hexdigest() == hashlib.sha256("".join(r.formatted[s.start : s.start + s.length] for s in r.loss).encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
@pytest.mark.parametrize("name", ["op1_distribution_divergence", "op4_line_dedup", "op10_chat_formatting"])
def test_native_queries_plan_no_python(spark, monkeypatch, name):
    """Neither what a native query returns nor any table or run that it writes on the way."""
    plans, cut, write = [], Scratch.cut, lines.LineIndex.write_run
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(Scratch, "cut", lambda self, df, *rest, **named: (note(df), cut(self, df, *rest, **named))[1])
    monkeypatch.setattr(lines.LineIndex, "write_run", lambda self, rows, level: (note(rows), write(self, rows, level))[1])
    note(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert len(plans) > 1
    for plan in plans:
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
