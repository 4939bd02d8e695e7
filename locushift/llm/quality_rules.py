"""Quality rules: base counts and divergence from language references (native).

For each language the corpus itself is the reference: the share of characters by class (lower case, upper case,
digits, white space, marks) and the shares of the language's commonest words, all others as one share, both over all
documents. A document is kept while its own histograms stay within the limits of Jensen-Shannon distance (base 2, 0
to 1) from its language's; a histogram is judged only from ``min_chars`` characters or ``min_judged`` words on.
A language of fewer than ``min_reference`` words is no reference, nor is one for a document that is more than one part
in ``least_parts`` of it, as that would be judged against itself: such a document has no word distance, and its classes
(letters of any kind, digits, marks, so that no script is at a disadvantage) are held against those of the whole corpus.

Defined results: a null text has no words and fails the base rule (fewer than 20 words); a null
``lang`` is a language of its own; equal rows give equal results; an empty table gives an empty result; extra
columns are ignored by ``judged`` and kept by ``keep``. Texts are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, let, packed, where_once, words

COMMON = 31  # words of a reference
WORD_LIMIT = 0.45
WINDOW = 8
#: A language is a reference from so many words on, for documents that are at most one part in LEAST_PARTS of it.
MIN_REFERENCE, LEAST_PARTS = 300, 3
#: Letters that are neither lower nor upper case, and the marks that belong to letters.
OTHER_LETTERS = r"[\p{Lo}\p{Lm}\p{Lt}\p{M}]+"
#: So many languages' references (2 KB each) are broadcast.
SMALL = 4096


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.filter(p, lambda x, i: (F.try_element_at(p, i + 2)["h"] == x["h"]) | (F.when(i > 0, F.element_at(p, i)["h"] == x["h"]).otherwise(F.lit(False)))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.coalesce(F.least(F.try_element_at(s, i + 2) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda a, x: a + x))

    # slice() copies the whole array at each call, so windows are hashed from single elements.
    count = F.size(ws) - window + 1
    singly = F.transform(ws, lambda w: F.xxhash64(w))
    hashes = let(singly, lambda h: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)])))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(count >= 2, found).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Adds struct ``_q``: the base counts and the class counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.withColumn("_text", text).withColumn("_words", words(F.col("_text")))
    step = step.withColumn("_rest", F.regexp_replace("_text", r"\p{Ll}+", ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace("_rest", pattern, "")).cast("long")
    n_chars, n_rest = F.length("_text").cast("long"), F.length("_rest").cast("long")
    space, upper, digit = (n_rest - left(p) for p in (r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"\p{Nd}+"))
    step = step.withColumn("_n", F.struct(
        F.size("_words").cast("long").alias("n_words"),
        n_chars.alias("n_chars"),
        (n_chars - n_rest).alias("lower"), upper.alias("upper"), digit.alias("digit"), space.alias("space"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    ))
    mark = F.col("_n.n_chars") - F.col("_n.lower") - F.col("_n.upper") - F.col("_n.digit") - F.col("_n.space")
    step = step.withColumn("_q", F.struct(
        F.col("_n.n_words").alias("n_words"), (F.col("_n.n_chars") - F.col("_n.space")).alias("word_chars"), F.col("_n.n_symbols").alias("n_symbols"),
        F.col("_n.n_dup_lines").alias("n_dup_lines"), F.col("_n.n_repeat_words").alias("n_repeat_words"), F.col("_n.n_chars").alias("n_chars"),
        F.array("_n.lower", "_n.upper", "_n.digit", "_n.space", mark).alias("classes"),
    ))
    return step.drop("_words", "_rest", "_n")


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``_key``: the language, told apart from null."""
    return docs.withColumn("_key", F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("+"), "lang")))


def letters_digits_marks(lower: Column, upper: Column, digit: Column, space: Column, other: Column, n: Column) -> Column:
    """Counts of three classes from those of characters; white space is none of them."""
    letters = lower + upper + other
    return F.array(letters, digit, n - letters - digit - space)


def shares_of(counts: Column) -> Column:
    return let(counts, lambda c: F.transform(c, lambda x: x / F.greatest(F.aggregate(c, F.lit(0).cast("long"), lambda a, k: a + k), F.lit(1))))


def references(docs: DataFrame, n_common: int = COMMON, few: bool = False) -> DataFrame:
    """Per key: class shares, the commonest words and their shares (the rest as the last share), its characters and words,
    and the corpus's shares of letters, digits and marks. few: so are the keys."""
    base = keyed(docs.select("lang", "text").where(F.col("text").isNotNull()))
    rest = base.select("_key", F.length("text").alias("n"), F.regexp_replace("text", r"\p{Ll}+", "").alias("rest"))
    left = lambda pattern: F.length("rest") - F.length(F.regexp_replace("rest", pattern, ""))
    names = ("lower", "upper", "digit", "space", "other", "n")
    classes = rest.select("_key", (F.col("n") - F.length("rest")).alias("lower"), left(r"\p{Lu}+").alias("upper"), left(r"\p{Nd}+").alias("digit"), left(r"[\x20\x09-\x0D]+").alias("space"), left(OTHER_LETTERS).alias("other"), "n")
    classes = classes.groupBy("_key").agg(*[F.sum(c).alias(c) for c in names])
    pool = classes.agg(*[F.sum(c).alias(c) for c in names]).select(shares_of(letters_digits_marks(*[F.col(c) for c in names])).alias("_pool"))
    mark = F.col("n") - F.col("lower") - F.col("upper") - F.col("digit") - F.col("space")
    classes = classes.select("_key", F.col("n").alias("_ref_chars"), F.transform(F.array("lower", "upper", "digit", "space", mark), lambda x: x / F.greatest(F.col("n"), F.lit(1))).alias("_classes"))
    words_ = base.select("_key", F.explode(F.split(F.lower("text"), SPACE)).alias("word")).where(F.col("word") != "")
    counts = words_.groupBy("_key", "word").agg(F.count(F.lit(1)).alias("k")).withColumn("digits", F.length(F.bin("k")))
    # How many words have counts of so many binary digits tells, in a few rows, which words are out of question; what
    # is left is cut in salted parts first, as many words may have one count.
    sizes = counts.groupBy("_key", "digits").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    larger = F.sum("n").over(W.partitionBy("_key").orderBy(F.desc("digits")))
    bounds = sizes.withColumn("larger", larger).groupBy("_key").agg(F.sum("k").alias("total"), F.coalesce(F.max(F.when(F.col("larger") >= n_common, F.col("digits"))), F.lit(0)).alias("least"))
    order = [F.desc("k"), "word"]
    ranked = counts.join(F.broadcast(bounds) if few else bounds, "_key").where("digits >= least").withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64)))
    for parts in (["_key", "salt"], ["_key"]):
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy(*parts).orderBy(*order))).where(F.col("rank") <= n_common)
    top = ranked.groupBy("_key").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", "word", "k"))).alias("top"))
    shares = F.transform(F.col("top.k"), lambda k: k / F.col("total"))
    other = (F.col("total") - F.aggregate(F.col("top.k"), F.lit(0).cast("long"), lambda a, k: a + k)) / F.col("total")
    top = top.select("_key", "total", F.col("top.word").alias("_common"), F.concat(shares, F.array_repeat(F.lit(0.0), n_common - F.size("top")), F.array(other)).alias("_shares"))
    found = classes.join(top, "_key", "left").select("_key", "_classes", "_ref_chars", F.col("total").alias("_ref_words"), F.coalesce("_common", F.array().cast("array<string>")).alias("_common"), F.coalesce("_shares", F.array().cast("array<double>")).alias("_shares"))
    return found.crossJoin(F.broadcast(pool))  # one row


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def times_of(common: Column, spaced: Column, n_common: int) -> Column:
    """How often each common word stands in a text whose words have a space of their own on either side."""

    def times(i: int) -> Column:
        word = F.concat(F.lit(" "), F.get(common, F.lit(i)), F.lit(" "))
        return F.coalesce((F.octet_length(spaced) - F.octet_length(F.replace(spaced, word, F.lit("")))) / F.octet_length(word), F.lit(0.0))

    return F.array(*[times(i) for i in range(n_common)])


def judged(docs: DataFrame, min_words: int = 20, repeat_percent: int = 30, min_chars: int = 200, min_judged: int = 25, class_limit: float = 0.3, word_limit: float = WORD_LIMIT, n_common: int = COMMON, min_reference: int = MIN_REFERENCE, least_parts: int = LEAST_PARTS) -> DataFrame:
    """The documents with struct ``_v``: base counts, base_failed, both distances (null: too short) and kept.

    Each language's reference comes to its documents by broadcast if there are at most ``SMALL`` languages, else by a
    shuffle on the language, whose large partitions Spark splits.
    """
    step = keyed(docs)
    few = step.select("_key").distinct().limit(SMALL + 1).count() <= SMALL
    found = references(docs, n_common, few)
    step = step.join(F.broadcast(found) if few else found.hint("merge"), "_key", "left")
    step = measured(step)
    # Two spaces between words, so that each has its own on both sides.
    step = step.withColumn("_spaced", F.concat(F.lit(" "), F.regexp_replace(F.lower("_text"), SPACE, "  "), F.lit(" ")))
    step = step.withColumn("_times", times_of(F.col("_common"), F.col("_spaced"), n_common))
    n_words = F.greatest(F.col("_q.n_words"), F.lit(1))
    other = F.col("_q.n_words") - F.aggregate("_times", F.lit(0.0), lambda a, x: a + x)
    step = step.withColumn("_hist", F.transform(F.concat("_times", F.array(other)), lambda x: x / n_words))
    classes = F.transform("_q.classes", lambda x: x / F.greatest(F.col("_q.n_chars"), F.lit(1)))
    enough = (F.col("_ref_words") >= min_reference) & (least_parts * F.col("_q.n_words") <= F.col("_ref_words")) & (least_parts * F.col("_q.n_chars") <= F.col("_ref_chars"))
    enough = F.coalesce(enough, F.lit(False))
    # Only for the few documents without a reference are their other letters counted.
    other = F.length("_text") - F.length(F.regexp_replace("_text", OTHER_LETTERS, ""))
    pooled = shares_of(letters_digits_marks(*[F.get("_q.classes", F.lit(i)) for i in range(4)], other, F.col("_q.n_chars")))
    class_js = F.when(enough, js_distance(classes, F.col("_classes"))).otherwise(js_distance(pooled, F.col("_pool")))
    step = step.withColumn("_class_js", F.when(F.col("_q.n_chars") >= min_chars, class_js))
    step = step.withColumn("_word_js", F.when(enough & (F.col("_q.n_words") >= min_judged) & (F.size("_shares") > 0), js_distance(F.col("_hist"), F.col("_shares"))))
    failed = (F.col("_q.n_words") < min_words) | (100 * F.col("_q.n_repeat_words") > repeat_percent * F.col("_q.n_words"))
    passed = (F.coalesce(F.col("_class_js"), F.lit(0.0)) <= class_limit) & (F.coalesce(F.col("_word_js"), F.lit(0.0)) <= word_limit)
    counts = [F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    verdict = F.struct(*counts, failed.alias("base_failed"), (~failed & passed).alias("kept"), F.round("_class_js", 6).alias("class_js"), F.round("_word_js", 6).alias("word_js"))
    return step.select(*[F.col(f"`{c}`") for c in docs.columns], verdict.alias("_v"))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their columns."""
    return where_once(judged(packed(docs, "lang", "text"), **options), F.col("_v.kept")).select("_row.*")


def report(docs: DataFrame, **options) -> DataFrame:
    return judged(docs.select("doc_id", "lang", "text"), **options).select("doc_id", "_v.*")
