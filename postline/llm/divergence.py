"""Quality rules by distribution divergence, with DataFrame operations only.

Each document gets a histogram of character classes and one of its language's common words. Sums over the documents of a
language that pass the base rules are that language's reference. A document is kept if it passes the base rules and the
Jensen-Shannon distance of neither histogram to its reference is over its limit; a distance is judged only if the
document has ``MIN_CHARS`` characters or ``MIN_WORDS`` words for it (the minimum-length guards).

Defined results: a null or empty text has no words and fails; a text of any length is counted whole; a null language, or one that isn't in ``COMMON_WORDS``, has
the pooled reference ``*`` and no common words; rows are judged one by one, so repeated rows get the same result; an
empty table gives an empty table; other columns are carried along unless their names begin with ``_q_``. Three-word
windows are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline.llm.common import BLANKS, cut

MIN_BASE_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CHARS, MIN_WORDS = 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, CHANCE = 0.18, 0.25, 0.5
ROUNDS = 2
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
#: Character classes, as patterns; what none of them has is "lower-case ASCII letter or other".
CHAR_CLASSES = ("[A-Z]", "[0-9]", r"[\x09-\x0D\x20]", "[.,;:'\"()?-]", SYMBOLS, r"[!@\[\]^_`{}~/\\=+]", r"[^\x00-\x7F]")
#: Frequent function words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "on", "with", "as", "was", "for", "be", "are", "this", "from", "by"),
    "de": ("der", "die", "das", "und", "ist", "von", "den", "im", "in", "zu", "mit", "auf", "nicht", "ein", "sich", "dem", "des", "eine"),
    "fr": ("le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "est", "que", "qui", "dans", "pour", "sur", "par", "au"),
    "es": ("el", "la", "los", "las", "de", "del", "y", "en", "que", "un", "una", "es", "por", "con", "se", "para", "su", "al"),
}
POOLED = "*"


def is_one_of(words: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*words)


def count_of(pattern: str) -> Column:
    """Characters of the text that the pattern of one character matches."""
    return F.char_length("text") - F.char_length(F.regexp_replace("text", F.lit(f"{pattern}+"), F.lit("")))


def repeated_words(words: str) -> Column:
    """Words in three-word windows that the text has twice or more."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(hashes)


def covered(windows: str) -> Column:
    """From the windows' hashes, the number of words under those found more than once: sorted with their places, equal ones are neighbours."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def pick(sorted_: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(sorted_, j)["h"] == F.get(sorted_, k)["h"], F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(places, lambda j: F.get(sorted_, j)["i"]))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
    # the sorted array is bound once, as the element of a one-element array
    total = F.get(F.transform(F.array(placed), lambda s: F.aggregate(pick(s), start, step, lambda acc: acc["n"])), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(total)


def features(docs: DataFrame) -> DataFrame:
    """docs, without its text, with the base counts and _q_lang, _q_chars and _q_words (the histograms, each with its rest as last bin)."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    trimmed = F.btrim(F.col("text"), F.lit(BLANK_CHARS))
    df = docs.withColumn("_q_list", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANKS}+")))
    df = df.withColumn("_q_lang", F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(POOLED))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    df = df.withColumns({"_q_windows": repeated_words("_q_list"), "_q_lines": lines})
    plain = F.transform("_q_list", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    few = F.lit(None)
    for lang, words in COMMON_WORDS.items():
        few = F.when(F.col("_q_lang") == lang, F.filter(plain, is_one_of(words))).otherwise(few)
    df = df.withColumn("_q_common", F.concat(F.lit(" "), F.array_join(few.cast("array<string>"), "  "), F.lit(" ")))
    n_words = F.size("_q_list").cast("bigint")
    counts = F.lit(None)
    for lang, words in COMMON_WORDS.items():
        each = [F.expr(f"(octet_length(_q_common) - octet_length(replace(_q_common, ' {w} ', ''))) div {len(w) + 2}").cast("bigint") for w in words]
        counts = F.when(F.col("_q_lang") == lang, F.array(*each)).otherwise(counts)
    counts = F.coalesce(counts.cast("array<bigint>"), F.array(*[F.lit(0).cast("bigint")] * len(COMMON_WORDS["en"])))
    classes = F.array(*[count_of(p).cast("bigint") for p in CHAR_CLASSES])
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    df = df.select(
        *[c for c in docs.columns if c != "text"],
        "_q_lang",
        n_words.alias("n_words"),
        F.char_length(F.array_join("_q_list", "")).cast("bigint").alias("word_chars"),
        count_of(SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint").alias("n_dup_lines"),
        covered("_q_windows").alias("n_repeat_words"),
        F.char_length("text").cast("bigint").alias("_q_n"),
        classes.alias("_q_chars"),
        counts.alias("_q_words"),
    )
    with_rest = lambda a, n: F.concat(a, F.array(F.greatest(F.col(n) - total(a), F.lit(0).cast("bigint"))))
    return df.withColumns({"_q_chars": with_rest(F.col("_q_chars"), "_q_n"), "_q_words": with_rest(F.col("_q_words"), "n_words")})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def language_references(featured: DataFrame) -> DataFrame:
    """_q_lang and the summed histograms of its rows: at most one row for each language of COMMON_WORDS and the pooled one."""
    n_chars, n_words = len(CHAR_CLASSES) + 1, len(COMMON_WORDS["en"]) + 1
    sums = [F.sum(F.get("_q_chars", F.lit(i))).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.get("_q_words", F.lit(i))).alias(f"w{i}") for i in range(n_words)]
    by = featured.groupBy("_q_lang").agg(*sums)
    return by.select(
        "_q_lang", F.array(*[f"c{i}" for i in range(n_chars)]).alias("_q_ref_chars"), F.array(*[f"w{i}" for i in range(n_words)]).alias("_q_ref_words")
    )


def jensen_shannon(a: str, b: str) -> Column:
    """The Jensen-Shannon distance (base 2) of two histograms; null if one has no mass."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("bigint"), lambda x, y: x + y)
    shares = lambda h: F.transform(h, lambda x: F.try_divide(x, total(h)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.when(x.isNotNull(), 0.0))
    terms = F.zip_with(shares(a), shares(b), lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2, F.lit(0.0)))


def judge(docs: DataFrame) -> DataFrame:
    """docs, without its text, with the base counts, base_failed, char_distance, word_distance and kept.

    The features, a few numbers a document, are written once: the references sum them and the verdict reads them again.
    """
    featured = cut(features(docs)).withColumn("base_failed", base_failed())
    clean = featured.filter(~F.col("base_failed"))
    for _ in range(ROUNDS):
        # documents that are far from the last references don't count in the next
        references = language_references(clean)
        clean = measured(featured, references).filter("kept").select(featured.columns)
    return measured(featured, references).drop("_q_lang", "_q_n", "_q_chars", "_q_words")


def measured(featured: DataFrame, references: DataFrame) -> DataFrame:
    """featured with its distances to the references, and kept. The references are a row for each language of a fixed list."""
    df = featured.join(F.broadcast(references), "_q_lang", "left")
    df = df.withColumns(
        {
            "char_distance": jensen_shannon("_q_chars", "_q_ref_chars"),
            "word_distance": jensen_shannon("_q_words", "_q_ref_words"),
        }
    )
    # a short text's histogram strays from its language's by chance, as 1 / sqrt(n)
    odd_chars = (F.col("_q_n") >= MIN_CHARS) & (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE + CHANCE / F.sqrt("_q_n"))
    odd_words = (F.col("n_words") >= MIN_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE + CHANCE / F.sqrt("n_words"))
    return df.withColumn("kept", ~F.col("base_failed") & ~odd_chars & ~odd_words).drop("_q_ref_chars", "_q_ref_words")
