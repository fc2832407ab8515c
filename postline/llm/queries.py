"""The queries of this subpackage: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postline.llm import bpe, bytelevel, chat, decontaminate, divergence, fim, jaccard, lines, periodic, pii, quality, repeats, toxicity
from postline.llm.common import crc_bucket, table

#: Fixed value: the conversation that op10 adds.
PROBE_TEXT = r"\### Assistant: </turn> ok"


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_sql() -> str:
    """The same rules as relations: a row for each document and bin of either histogram."""
    d = divergence
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = ", ".join(f"({quoted(lang)}, {k}, {quoted(w)})" for lang, own in d.COMMON_WORDS.items() for k, w in enumerate(own))
    bins = len(d.COMMON_WORDS["en"])
    classes = " UNION ALL ".join(
        f"SELECT doc_id, 'c' AS kind, {k} AS bin, length(text) - length(regexp_replace(text, {quoted(p + '+')}, '', 'g')) AS n FROM counted" for k, p in enumerate(d.CHAR_CLASSES)
    )

    def measured(k: int, source: str) -> str:
        return f"""
        sums{k} AS (SELECT l, kind, bin, sum(n) AS n FROM hist JOIN counted USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM {source}) GROUP BY ALL),
        ref{k} AS (SELECT l, kind, bin, n / nullif(sum(n) OVER (PARTITION BY l, kind), 0) AS q FROM sums{k}),
        pair{k} AS (SELECT doc_id, kind, p, q, (p + q) / 2 AS m FROM shares JOIN counted USING (doc_id) JOIN ref{k} USING (l, kind, bin) WHERE p IS NOT NULL AND q IS NOT NULL),
        js{k} AS (SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 0)) AS x FROM pair{k} GROUP BY ALL),
        judged{k} AS (SELECT c.doc_id, NOT base_failed
              AND NOT (n_chars >= {d.MIN_CHARS} AND coalesce(a.x, 0) > {d.MAX_CHAR_DISTANCE} + {d.CHANCE} / sqrt(n_chars))
              AND NOT (n_words >= {d.MIN_WORDS} AND coalesce(b.x, 0) > {d.MAX_WORD_DISTANCE} + {d.CHANCE} / sqrt(n_words)) AS kept
            FROM base c LEFT JOIN js{k} a ON a.doc_id = c.doc_id AND a.kind = 'c' LEFT JOIN js{k} b ON b.doc_id = c.doc_id AND b.kind = 'w'),
        clean{k} AS (SELECT doc_id FROM judged{k} WHERE kept)"""

    rounds = ",".join(measured(k, f"clean{k - 1}") for k in range(1, d.ROUNDS + 1))
    return f"""
    WITH common(l, bin, word) AS (VALUES {words}),
    counted AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({', '.join(map(quoted, d.COMMON_WORDS))}) THEN lang ELSE '*' END AS l,
                       regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM counted),
    windows AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    again AS (SELECT doc_id, i FROM windows WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    under AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM counted),
    dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    base AS (SELECT doc_id, length(text) AS n_chars, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                    CAST(length(text) - length(regexp_replace(text, {quoted(d.SYMBOLS + '+')}, '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(under.n, 0) AS n_repeat_words,
                    len(w) < {d.MIN_BASE_WORDS} OR coalesce(under.n, 0) * 100 > len(w) * {d.MAX_REPEAT_PERCENT} AS base_failed
             FROM counted LEFT JOIN dups USING (doc_id) LEFT JOIN under USING (doc_id)),
    classes AS ({classes}),
    found AS (SELECT doc_id, bin, count(*) AS n FROM placed JOIN counted USING (doc_id) JOIN common ON common.l = counted.l AND common.word = lower(rtrim(placed.word, '.,;:!?')) GROUP BY ALL),
    told AS (SELECT doc_id, bin, coalesce(found.n, 0) AS n FROM base CROSS JOIN range({bins}) r(bin) LEFT JOIN found USING (doc_id, bin)),
    hist AS (SELECT * FROM classes UNION ALL SELECT doc_id, 'c', {len(d.CHAR_CLASSES)}, greatest(any_value(n_chars) - sum(n), 0) FROM classes JOIN base USING (doc_id) GROUP BY doc_id
             UNION ALL SELECT doc_id, 'w', bin, n FROM told UNION ALL SELECT doc_id, 'w', {bins}, greatest(any_value(n_words) - sum(n), 0) FROM told JOIN base USING (doc_id) GROUP BY doc_id),
    shares AS (SELECT doc_id, kind, bin, n / nullif(sum(n) OVER (PARTITION BY doc_id, kind), 0) AS p FROM hist),
    clean0 AS (SELECT doc_id FROM base WHERE NOT base_failed),{rounds}
    SELECT base.* EXCLUDE (n_chars), kept FROM base JOIN judged{d.ROUNDS} USING (doc_id)"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontaminate.hit_words())
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out, "quality")
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", quality.predicted().alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[F.size(F.filter(base, is_kind(k))).cast("bigint").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown("spans").alias("spans"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )


def is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out, "toxic")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", toxicity.predicted().alias("predicted"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(vocabulary_path())
    both = bpe.with_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ", ".join(f"(-7L, {k}, '{role}')" for k, role in enumerate(("user", "assistant")))
    probe = spark.sql(f"SELECT * FROM VALUES {turns} AS t(conv_id, turn, role)").withColumn("text", F.lit(PROBE_TEXT))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    nodes = rows.withColumn("node", place).select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0).alias("score")
    )
    out = chat.format_conversations(nodes).select("tree", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = chat.under_mask(F.col("formatted"), F.col("loss"))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(trained).cast("bigint").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """documents of which each tenth, by the hash of its id, has its words from one on replaced by repetitions of some of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    n, g = F.size(words).cast("bigint"), F.floor(h / 10)
    first = g % n
    period = 1 + F.floor((n - first) / (3 + g % 8))
    whole = lambda c: c.cast("int")
    unit = F.slice(words, whole(first + 1), whole(period))
    repeated = F.slice(F.flatten(F.array_repeat(unit, whole(F.ceil((n - first) / period)))), F.lit(1), whole(n - first))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), whole(first)), repeated), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), planted).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # lengths and periods under 2 ** 26: quotients of doubles are equal only if the fractions are, and are ordered as they are
    by_exponent = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    shown = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", by_exponent).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(shown, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bytelevel.Codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = bytelevel.with_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), codec, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Equal words at a distance of up to a third of the text, and islands of them.
OP11_SQL = r"""
WITH bits AS (SELECT doc_id, text, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))) AS steps FROM documents),
cut AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
               xor(list_reduce(steps, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM bits),
planned AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM cut),
words AS (SELECT doc_id, n, CASE WHEN hit THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // parts) + 1])) ELSE w END AS w FROM planned),
placed AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(len(w))) AS i FROM words),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 3 <= x.n),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY ALL),
counted AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS shown FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM words LEFT JOIN counted USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP12_SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), []) AS u, sha256('7:' || doc_id) AS hex FROM documents),
drawn AS (SELECT *, len(u) AS n, CAST('0x' || hex[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || hex[9:16] AS BIGINT) % (len(u) + 1) AS b,
                 text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || hex[17:24] AS BIGINT) % 100 >= 100 AS plain,
                 CAST('0x' || hex[25:32] AS BIGINT) % 100 < 50 AS suffix_first FROM cut),
parts AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:n], '') AS suffix FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN suffix_first THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

OP10_SQL = r"""
WITH probe(conv_id, turn, role, text) AS (
  VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
          UNION ALL SELECT * FROM probe),
kept AS (SELECT *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') AS body,
                replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') AS head FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM kept GROUP BY conv_id
"""

OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM phrases),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, n FROM windows JOIN phrases USING (n, p)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP4_SQL = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS no FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered),
owned AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS lost FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT lost), '')) AS kept_sha256
FROM owned GROUP BY doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_distribution_divergence": op1_distribution_divergence,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_suffix_array": op6_suffix_array,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_byte_bpe": op13_byte_bpe,
}
SQL: dict[str, str] = {"op1_distribution_divergence": op1_sql(), "op2_decontamination": OP2_SQL, "op4_line_dedup": OP4_SQL, "op10_chat_formatting": OP10_SQL, "op11_periodic_runs": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
