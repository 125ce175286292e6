"""Quality rules: base counts, then distribution divergence from language references.

DataFrame expressions only. For each document two histograms are taken over the whole text:
character classes, and the common words of each language, which are the most frequent ones
over all documents of that lang value. A language's reference is the mean histogram over all
its documents that pass the base rules; documents far from it are left out and the mean is
taken once more, so that junk does not shift it. Both rounds are small aggregates over counts
taken once. A document's verdict comes from its
Jensen-Shannon distances to the nearest reference.

Short texts scatter: a text below ``MIN_WORDS`` words is not judged by divergence, and each
threshold is raised by what sampling alone would add to a histogram of that many items.

Equality of 8-word windows is decided on 64-bit hashes of word hashes. In a text of a
million words the chance that two different windows agree is about 3 in 10^8.

Defined results: null text has no words and fails the base rules; repeated rows get the
same row each; documents without lang count for no reference but are judged by the nearest one;
documents of a language that has no reference, as fewer than ``LEAST_DOCUMENTS`` pass, and
all documents of a corpus without any are decided by the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.session import materialize, read_table

#: Common words of a language that make its histogram, and items that the sketch which finds them tracks.
COMMON, TRACKED = 16, 8192
#: Documents that a language needs for a reference.
LEAST_DOCUMENTS = 10
CLASSES = ("lower", "upper", "digit", "punctuation", "other")
WORD_GAP = r"[ \t-\r]+"
MIN_WORDS = 40
#: Jensen-Shannon divergence (bits) from the nearest reference above which a text is rejected.
MAX_CLASS_DIVERGENCE = 0.03
MAX_WORD_DIVERGENCE = 0.04
#: A key or some numbers in a clean text are no fault: the class limit is raised by this over the text's length.
SPARED_CHARS = 20.0
#: The wider limits within which a text counts for the second, cleaner round of references.
ROUGH_CLASS_DIVERGENCE = 0.03
ROUGH_WORD_DIVERGENCE = 0.05


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it often in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def repeated_window_words(words: Column, width: int = 8) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more.

    Windows are hashed in one pass. Where all differ, the answer is 0. Else they are sorted
    with their positions, those equal to a neighbour are kept, and each adds the words up to
    the next kept position, ``width`` at most: n log n for a text, whatever repeats in it.
    """

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(ordered, lambda p: F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(p, k + 1)["h"]).eqNullSafe(True)))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        steps = let(places, lambda q: F.transform(q, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(q, k + 1) - x, F.lit(width)))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, width))))
    count = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) <= width, 0).otherwise(count).cast("bigint")


def letter_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def common_words(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """The COMMON most frequent words of each language, over all its documents.

    A frequent-items sketch by language passes over every word; its state has a fixed size,
    so tasks send one small row a language. One row a language comes to the driver.
    """
    words = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.explode(letter_words(F.col(text))).alias("word"))
    rows = words.groupBy("lang").agg(F.expr(f"approx_top_k(word, {COMMON}, {TRACKED})").alias("top")).collect()
    return {r["lang"]: sorted(e["item"] for e in r["top"]) for r in rows}


def common_word_counts(text: Column, every: list[str]) -> Column:
    """Counts of the words of ``every`` in a text by word, and under "" of all its runs of letters.

    The common words are sorted, so a word's count is the distance to where the next begins.
    """

    def runs(s: Column) -> Column:
        kinds = F.array_distinct(s)
        starts = let(kinds, lambda d: F.transform(d, lambda w: F.array_position(s, w)))
        steps = let(starts, lambda a: F.transform(a, lambda x, k: F.coalesce(F.get(a, k + 1), F.size(s) + F.lit(1)) - x))
        return F.map_from_arrays(kinds, F.transform(steps, lambda x: x.cast("double")))

    def counts(all_words: Column) -> Column:
        common = F.sort_array(F.filter(all_words, lambda w: w.isin(every) if every else F.lit(False)))
        return F.map_concat(let(common, runs), F.create_map(F.lit(""), F.size(all_words).cast("double")))

    return let(letter_words(text), counts)


def base_counts(df: DataFrame, every: list[str], text: str = "text") -> DataFrame:
    """``df`` with the base counts, the histograms of classes and of the words ``every``, and base_failed. No shuffle."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_t", whole).withColumn("_w", words_of(F.col("_t")))
    df = df.withColumn("_c", F.array_join("_w", ""))
    rest, names = F.col("_c"), []
    for name, kind in zip(CLASSES, (r"\p{Ll}+", r"\p{Lu}+", r"\p{N}+", r"""[.,;:!?'"()\-]+"""), strict=False):
        df = df.withColumn(f"_{name}", F.regexp_replace(rest, kind, ""))
        names.append(F.length(rest) - F.length(f"_{name}"))
        rest = F.col(f"_{name}")
    names.append(F.length(rest))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("bigint"),
            "word_chars": F.length("_c").cast("bigint"),
            "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("bigint"),
            "n_dup_lines": let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("bigint")),
            "n_repeat_words": repeated_window_words(F.col("_w")),
            "class_counts": F.array(*[n.cast("double") for n in names]),
            "word_counts": common_word_counts(F.col("_t"), every),
        }
    )
    df = df.drop("_t", "_w", "_c", *[f"_{c}" for c in CLASSES[:-1]])
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def language_references(counted: DataFrame, words: dict[str, list[str]], lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of each language over all its documents that pass the base rules, of LEAST_DOCUMENTS at least.

    COMMON + 1 rows and one more come to the driver for each language.
    """
    if not words:
        return {}
    good = counted.filter(~F.col("base_failed") & F.col(lang).isNotNull())
    sums = good.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("class_counts")[k]).alias(f"c{k}") for k in range(len(CLASSES))]).filter(F.col("n") >= LEAST_DOCUMENTS)
    own = F.create_map(*[x for name, ws in words.items() for x in (F.lit(name), F.array(*map(F.lit, ["", *ws])))])
    pairs = good.select(F.col(lang).alias("lang"), F.explode("word_counts").alias("word", "n")).filter(F.array_contains(F.try_element_at(own, F.col("lang")), F.col("word")))
    counts = {(r["lang"], r["word"]): r["n"] for r in pairs.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()}
    found = {}
    for row in sums.collect():
        name, classes = row["lang"], [row[f"c{k}"] for k in range(len(CLASSES))]
        held, total = [counts.get((name, w), 0.0) for w in words.get(name, ())], counts.get((name, ""), 0.0)
        if sum(classes) and total:
            found[name] = ([x / sum(classes) for x in classes], [x / total for x in held] + [(total - sum(held)) / total])
    return dict(sorted(found.items()))


def jensen_shannon(shares: Column, reference: list[float]) -> Column:
    """Divergence in bits between an array of shares and a reference; its root is the distance."""

    def part(p: Column, q: Column) -> Column:
        mid = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / mid)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / mid)).otherwise(0.0)

    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), part)
    return F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2)


def divergences(counted: DataFrame, references: dict[str, tuple[list[float], list[float]]], words: dict[str, list[str]]) -> DataFrame:
    """``counted`` with class_divergence and word_divergence from the nearest reference (0 where there is none)."""
    df = counted.withColumn("_chars", F.greatest(F.lit(1.0), F.aggregate("class_counts", F.lit(0.0), lambda s, x: s + x)))
    df = df.withColumn("_class", F.transform("class_counts", lambda x: x / F.col("_chars")))
    near = []
    for k, (lang, (classes, own)) in enumerate(references.items()):
        total = F.greatest(F.try_element_at("word_counts", F.lit("")), F.lit(1.0))
        shares = F.array(*[F.coalesce(F.try_element_at("word_counts", F.lit(w)), F.lit(0.0)) / total for w in words[lang]])
        shares = let(shares, lambda c: F.concat(c, F.array(1.0 - F.aggregate(c, F.lit(0.0), lambda s, x: s + x))))
        df = df.withColumn(f"_near{k}", F.struct(jensen_shannon(shares, own).alias("word"), jensen_shannon(F.col("_class"), classes).alias("class")))
        near.append(F.col(f"_near{k}"))
    best = F.array_min(F.array(*near)) if near else F.struct(F.lit(0.0).alias("word"), F.lit(0.0).alias("class"))
    df = df.withColumn("_near", best)
    df = df.withColumns({"class_divergence": F.col("_near.class"), "word_divergence": F.col("_near.word")})
    return df.drop("_near", "_chars", "_class", *[f"_near{k}" for k in range(len(near))])


def scatter(bins: int, size: Column) -> Column:
    """Twice the mean divergence, in bits, between a source and the histogram of ``size`` draws from it."""
    return (bins - 1) / (4 * 0.6931471805599453 * F.greatest(size, F.lit(1)))


def is_far(class_limit: float, word_limit: float) -> Column:
    spared = SPARED_CHARS / F.greatest(F.col("word_chars"), F.lit(1))
    return (F.col("class_divergence") > class_limit + spared) | (F.col("word_divergence") > word_limit + scatter(17, F.col("n_words")))


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, base counts, divergences and kept of each document. Other columns are dropped.

    The counts are written to the shared folder once, as the references and the verdicts
    both read them.
    """
    narrow = df.select(F.struct(*keep).alias("keep"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    words = common_words(narrow)
    counted = materialize(base_counts(narrow, sorted({w for ws in words.values() for w in ws})).drop("text"), "quality")
    first = language_references(counted, words)
    near = divergences(counted, first, words).filter(~is_far(ROUGH_CLASS_DIVERGENCE, ROUGH_WORD_DIVERGENCE))
    known = language_references(near, words)
    out = divergences(counted, known, words)
    far = (F.col("n_words") >= MIN_WORDS) & is_far(MAX_CLASS_DIVERGENCE, MAX_WORD_DIVERGENCE)
    told = F.col("lang").isNull() | (F.col("lang").isin(*known) if known else F.lit(False))
    own = [c for c in out.columns if c not in ("keep", "lang", "class_counts", "word_counts")]
    return out.withColumn("kept", ~F.col("base_failed") & ~(far & told)).select("keep.*", *own, "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_divergence", "word_divergence")
    return quality_rules(docs).select(*cols)
