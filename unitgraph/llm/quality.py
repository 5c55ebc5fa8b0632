"""Quality rules: base counts, and how far a document's histograms are from its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitgraph.llm.common import SPACE, WORD, join_counted
from unitgraph.plans.durable import durable

# Frequent words of four languages, the bins of the word histogram.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "on", "with",
    "der", "die", "und", "den", "das", "ist", "mit", "zu", "ein", "auf",
    "le", "la", "les", "et", "des", "un", "une", "que", "dans", "pour",
    "el", "los", "de", "y", "las", "por", "con", "una", "se", "del",
)
#: Bins of the word histogram: each frequent word, and all other words together.
WORD_BINS = len(COMMON_WORDS) + 1
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punct", "other")
WINDOW = 8


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the two histograms, all by expressions on the row itself.

    Columns are built step by step: each step reads the ones before, so Catalyst keeps the word array
    and the window hashes as values and does not compute them again. Windows are hashed by doubling:
    pairs of words, pairs of pairs, pairs of those; an array is read by position only once per step.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("_t", t).withColumn("_b", F.btrim("_t", F.lit(" \t\n\x0b\f\r")))
    step = step.withColumn("_w", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", f"{SPACE}+")))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    step = step.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).withColumn("_lines", lines)
    step = step.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("n_symbols", _count(F.col("_t"), r"[#*$%&|<>]"))
    step = step.withColumn("_h", F.col("_w"))
    for k in (1, 2, 4):
        step = step.withColumn("_h", F.zip_with(F.slice("_h", 1, F.greatest(F.size("_h") - k, F.lit(0))), F.slice("_h", 1 + k, F.greatest(F.size("_h") - k, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    # Sorting is for texts that repeat a window; most do not, and a hash set tells.
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    again = F.filter("_s", lambda x, i: same(x, i + 1) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))))
    step = step.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1), p + WINDOW) - p)), F.lit(0), lambda a, x: a + x)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # ASCII punctuation without the counted symbols.
    step = step.withColumn("_chars", F.length("_t").cast("long")).withColumn("_upper", _count(F.col("_t"), "[A-Z]")).withColumn("_digit", _count(F.col("_t"), "[0-9]")).withColumn("_punct", _count(F.col("_t"), r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]")).withColumn("_other", (F.octet_length("_t") - F.length("_t")).cast("long"))
    space = F.col("_chars") - F.col("word_chars")
    # Code points beyond ASCII count once for each byte after their first.
    lower = F.greatest(F.lit(0).cast("long"), F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("n_symbols") - F.col("_punct") - F.col("_other"))
    step = step.withColumn("classes", F.array(lower, F.col("_upper"), F.col("_digit"), space, F.col("n_symbols"), F.col("_punct"), F.col("_other")))
    # Each common word becomes one letter, so counting them is a matter of string lengths.
    letters = [chr(0x100 + i) for i in range(len(COMMON_WORDS))]
    letter_of = F.create_map(*[F.lit(x) for pair in zip(COMMON_WORDS, letters, strict=True) for x in pair])
    known = F.filter("_w", lambda w: w.isin(*COMMON_WORDS))
    step = step.withColumn("_c", F.array_join(F.transform(known, lambda w: F.element_at(letter_of, w)), ""))
    step = step.withColumn("common", F.array(*[(F.length("_c") - F.length(F.replace("_c", F.lit(x), F.lit("")))).cast("long") for x in letters], F.col("n_words") - F.length("_c")))
    return step.select(*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common").withColumns({"classes_total": _total("classes"), "common_total": _total("common")})


def _total(h: str) -> Column:
    return F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms with the same bins; null if one is empty.

    ``p`` and ``q`` name the columns; their totals are columns too, named ``<p>_total`` and ``<q>_total``. The
    bins are folded, not written out: code for all of them in one expression is more than Java compiles.
    """
    sp, sq = F.col(f"{p}_total"), F.col(f"{q}_total")

    def term(x: Column, y: Column) -> Column:
        a, b = x / sp, y / sq
        half = lambda v: F.when(v > 0, v * F.log2(v / ((a + b) / 2))).otherwise(0.0)
        return half(a) + half(b)

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(F.lit(0.0), total / 2)))


def language_references(counted: DataFrame) -> DataFrame:
    """Both histograms summed over every document of a language, and how many documents and words they hold."""
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(WORD_BINS)]
    out = counted.groupBy("_lang").agg(F.count(F.lit(1)).alias("_documents"), F.sum("n_words").alias("ref_words"), F.sum("classes_total").alias("ref_classes_total"), F.sum("common_total").alias("ref_common_total"), *sums)
    return out.select("_lang", "_documents", "ref_words", "ref_classes_total", "ref_common_total", F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_classes"), F.array(*[f"w{i}" for i in range(WORD_BINS)]).alias("ref_common"))


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def judge_quality(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_class_distance: float = 0.28, max_word_distance: float = 0.24,
    min_words: int = 50, min_words_common: int = 100, min_reference_words: int = 10_000,
) -> DataFrame:
    """Base counts, distances to the language's references, and the verdict ``kept``.

    A document fails at once (``base_failed``) with under 20 words, or with over 30 % of its words in
    repeated 8-word windows. Else its character classes and its words, each common one and the others
    together, are compared with the sums over all documents of its language. A distance counts only if
    there is enough to compare: ``min_words`` words in the document (``min_words_common`` for the second)
    and ``min_reference_words`` in the reference; a document that is too short to judge is kept.

    A language that holds many documents has its reference broadcast, so no text's counts are shuffled for
    it; rare languages, however many, meet theirs in a shuffle.

    Null texts count as empty, null languages as one language of their own. Long texts are judged whole.
    Repeated rows are judged alike. An empty table gives an empty result. Columns of ``docs`` but the text
    are returned too; one that is named as a result column gives way to it. Only DataFrame functions are used.
    """
    keep = [c for c in docs.columns if c != text and c not in RESULTS]
    rows = docs.select(F.struct(*keep).alias("_row"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.col(text).alias("_text"))
    counted = durable(base_counts(rows, "_text").drop("_text"))
    refs = durable(language_references(counted))
    joined = join_counted(counted, refs, ["_lang"], "_documents", most=10_000)
    judged = joined.withColumn("class_distance", js_distance("classes", "ref_classes")).withColumn("word_distance", js_distance("common", "ref_common"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    enough = (F.col("ref_words") >= min_reference_words) & (F.col("n_words") >= min_words)
    far = enough & ((F.col("class_distance") > max_class_distance) | ((F.col("n_words") >= min_words_common) & (F.col("word_distance") > max_word_distance)))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False))).select(*[F.col("_row")[c].alias(c) for c in keep], *RESULTS)
