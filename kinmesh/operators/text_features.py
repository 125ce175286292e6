"""Feature maps of source texts: one wide projection a space, then rows (file_id, space, feature, value)."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.functions import text as X
from kinmesh.functions.features import safe_ratio
from kinmesh.session import materialize

#: Places of counts in the lists of :func:`kinmesh.functions.text.counted`.
_WORD, _CALLED, _INSIDE = ({w: k for k, w in enumerate(names)} for names in (X.WORDS, X.CALLS, X.NEEDLES))


def prepared(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with the counts that features read, as a struct; a null text counts as an empty one."""
    return files.withColumn("_c", X.counted(F.coalesce(F.col(text), F.lit(""))))


def _share(items: Column, test) -> Column:
    return F.size(F.filter(items, test)) / F.greatest(F.size(items), F.lit(1))


def line_buckets(lengths: Column) -> dict[str, Column]:
    return {
        "line_bucket:short_ratio": _share(lengths, lambda n: n <= 40),
        "line_bucket:medium_ratio": _share(lengths, lambda n: (n > 40) & (n <= 100)),
        "line_bucket:long_ratio": _share(lengths, lambda n: n > 100),
    }


def identifier_shapes(ids: Column) -> dict[str, Column]:
    return {f"identifier_shape:{name}_ratio": _share(ids, _matcher(pattern)) for name, pattern in X.SHAPES.items()}


def _matcher(pattern: str):
    return lambda w: w.rlike(pattern)


def token_categories(tokens: Column) -> dict[str, Column]:
    total = F.greatest(F.size(tokens), F.lit(1))
    size = lambda test: F.size(F.filter(tokens, test))
    keyword = size(lambda t: t.isin(*X.JAVA_KEYWORDS))
    name = size(lambda t: t.rlike(rf"^{X.IDENTIFIER}$") & ~t.isin(*X.JAVA_KEYWORDS))
    literal = size(lambda t: t.isin("NUM", "STR") | t.rlike(rf"^{X.NUMBER}$"))
    operator = size(lambda t: t.rlike(rf"^(?:{X.OPERATOR})$"))
    rest = F.greatest(F.lit(0), total - keyword - name - literal - operator)
    parts = {"keyword": keyword, "identifier": name, "literal": literal, "operator": operator, "punctuation": rest}
    return {f"token_category:{k}_ratio": v / total for k, v in parts.items()}


def _entries(scalars: dict[str, Column], tops: dict[str, Column]) -> Column:
    """An array of (feature, value): the scalars, then the counted items under their prefixes."""
    entry = lambda name, value: F.struct(name.alias("feature"), value.cast("double").alias("value"))
    fixed = F.array(*[entry(F.lit(k), v) for k, v in scalars.items()])
    return F.concat(fixed, *[_prefixed(prefix, counts, entry) for prefix, counts in tops.items()])


def _prefixed(prefix: str, counts: Column, entry) -> Column:
    return F.transform(counts, lambda e: entry(F.concat(F.lit(prefix), e["key"]), e["n"]))


def _of(items: Column, count: Column) -> Column:
    return items / F.greatest(count, F.lit(1))


def _entropy(counts: Column) -> Column:
    """Shannon entropy in bits from an array of counts; 0 where there are none."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n)
    return X.let(total, lambda t: F.aggregate(counts, F.lit(0.0), lambda s, n: s - n / t * F.log2(n / t)))


def _added(counts: str, places: dict[str, int], names: tuple[str, ...]) -> Column:
    return sum((F.get(f"_c.{counts}", F.lit(places[n])) for n in names), F.lit(0))


def _lengths(test=None, value=lambda e: e["n"], start=0) -> Column:
    """Sum of ``value`` over the lengths of non-empty lines, each with its number n of lines, that pass ``test``."""
    items = F.col("_c.lengths") if test is None else F.filter("_c.lengths", lambda e: test(e["key"]))
    kind = "double" if isinstance(start, float) else "bigint"
    return F.aggregate(items, F.lit(start).cast(kind), lambda s, e: (s + value(e)).cast(kind))


def expr_features(df: DataFrame) -> Column:
    c = lambda name: F.col(f"_c.{name}")
    at = lambda name, k: F.get(c(name), F.lit(k))
    lines = _lengths()
    mean = safe_ratio(_lengths(value=lambda e: e["n"] * e["key"]).cast("double"), lines)
    spread = X.let(mean, lambda m: F.sqrt(safe_ratio(_lengths(value=lambda e: e["n"] * (e["key"] - m) * (e["key"] - m), start=0.0), lines)))
    words = F.aggregate(c("words"), F.lit(0).cast("bigint"), lambda s, n: s + n)
    scalars = {
        "token_count": c("tokens"),
        "unique_token_ratio": safe_ratio(c("unique").cast("double"), c("tokens")),
        "masked_unique_token_ratio": _of(F.size(c("words")), words),
        "identifier_count": c("ids"),
        "identifier_length_mean": safe_ratio(c("id_chars").cast("double"), c("ids")),
        "line_length_mean": mean,
        "line_length_std": spread,
        "line_length_entropy": _entropy(F.transform(c("lengths"), lambda e: e["n"])),
        "comment_line_ratio": _of(c("comment_lines"), c("lines")),
        "comment_char_ratio": _of(c("comment_chars"), c("chars")),
        "masked_token_entropy": _entropy(c("words")),
        "method_signature_count": at("declared", 0),
        "constructor_signature_count": at("declared", 1),
        "import_stmt_count": F.size(c("imports")),
        "line_bucket:short_ratio": _of(_lengths(lambda n: n <= 40), lines),
        "line_bucket:medium_ratio": _of(_lengths(lambda n: (n > 40) & (n <= 100)), lines),
        "line_bucket:long_ratio": _of(_lengths(lambda n: n > 100), lines),
    }
    scalars |= {f"identifier_shape:{name}_ratio": _of(at("shapes", k), c("ids")) for k, name in enumerate(X.SHAPES)}
    parts = {name: at("categories", k) for k, name in enumerate(("keyword", "identifier", "literal", "operator"))}
    parts["punctuation"] = F.greatest(F.lit(0), F.greatest(c("tokens"), F.lit(1)) - sum(parts.values(), F.lit(0)))
    scalars |= {f"token_category:{name}_ratio": _of(n, c("tokens")) for name, n in parts.items()}
    scalars |= {f"keyword:{k}": _added("found", _WORD, (k,)) for k in X.EXPR_KEYWORDS}
    scalars |= {f"operator:{name}": at("signs", k) for k, name in enumerate(X.OPERATORS)}
    tops = {"expr_ngram:2:": "g2", "expr_ngram:3:": "g3", "line_skeleton:": "skeletons", "keyword_operator_pair:": "pairs", "call_name:": "calls"}
    return _entries(scalars, {prefix: c(name) for prefix, name in tops.items()})


def submission_chunks(files: DataFrame, most: int, first: int = 24, normalized: Column | None = None) -> DataFrame:
    """(sid, rank, path, part, text, chars, weight) of ``files`` (sid, path, text): the ``first`` chunks of each submission, by path and part.

    A file is cut by :func:`kinmesh.functions.text.packed_chunks`; parts count from 1, blank ones
    too, which are left out then. With ``normalized``, a column of the files, that form is cut,
    or the raw text where it is blank, and chunks are stripped; their weight goes by the
    length before. A null text has no chunk. Ranks cut before lists of a submission could meet.
    """
    blank = lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) == ""
    raw = F.coalesce(F.col("text"), F.lit(""))
    body = raw if normalized is None else F.when(F.coalesce(blank(normalized), F.lit(True)), raw).otherwise(normalized)
    parts = files.select("sid", "path", F.posexplode(X.packed_chunks(body, most)).alias("at", "chunk")).filter(~blank(F.col("chunk")))
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("path", "at"))
    kept = parts.withColumn("rank", rank).filter(F.col("rank") <= first)
    text = F.col("chunk") if normalized is None else F.regexp_replace("chunk", r"^\s+|\s+$", "")
    return kept.select("sid", "rank", "path", (F.col("at") + 1).alias("part"), text.alias("text"), F.length("chunk").cast("bigint").alias("chars"), F.greatest(F.lit(1.0), F.sqrt(F.length("chunk"))).alias("weight"))


def line_skeletons(masked: Column, k: int) -> Column:
    lines = F.filter(F.split(X.normalize_whitespace(masked), "\n"), lambda x: x != "")
    return X.top_counts(F.transform(lines, lambda x: F.substring(x, 1, 96)), k)


def keyword_operator_pairs(tokens: Column, k: int) -> Column:
    kept = F.filter(tokens, lambda t: t.isin(*X.JAVA_KEYWORDS) | t.rlike(rf"^(?:{X.OPERATOR})$"))
    pairs = X.let(kept, lambda a: F.filter(F.transform(a, lambda x, i: F.concat(x, F.lit("->"), F.get(a, i + 1))), lambda p: p.isNotNull()))
    return X.top_counts(pairs, k)


def top_grams(tokens: DataFrame, n: int, k: int) -> DataFrame:
    """(file_id, rank, gram, n) from (file_id, tokens): the ``k`` most frequent runs of n tokens of each file, then by gram.

    A file's tokens are one row, so its grams are counted where it lies and nothing but ids is
    shuffled. Rows that share an id are one file: only theirs are counted together.
    """

    @F.arrow_udf("array<struct<gram:string,n:bigint>>")
    def counted(rows: pa.Array, most: pa.Array) -> pa.Array:
        out = []
        for words, first in zip(rows, most.to_pylist(), strict=True):
            words = words.as_py() or []
            counts = Counter(map(" ".join, zip(*(words[shift:] for shift in range(n)), strict=False)))
            out.append([{"gram": g, "n": c} for g, c in sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:first]])
        return pa.array(out, pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())])))

    again = materialize(tokens.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("file_id", F.lit(True).alias("again")), "again")
    alone, parts = tokens, None
    if not again.isEmpty():
        both = tokens.join(again, tokens["file_id"].eqNullSafe(again["file_id"]), "left").select(tokens["file_id"], "tokens", "again")
        alone, parts = both.filter(F.col("again").isNull()), both.filter("again")
    whole = alone.select("file_id", F.posexplode(counted("tokens", F.lit(k))).alias("at", "g"))
    whole = whole.select("file_id", (F.col("at") + 1).alias("rank"), "g.gram", "g.n")
    if parts is None:
        return whole
    counts = parts.select("file_id", F.explode(counted("tokens", F.lit((1 << 31) - 1))).alias("g")).groupBy("file_id", "g.gram").agg(F.sum("g.n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "gram"))
    return whole.unionByName(counts.withColumn("rank", rank).filter(F.col("rank") <= k).select("file_id", "rank", "gram", "n"))


def call_names(code: Column, k: int) -> Column:
    found = F.regexp_extract_all(code, F.lit(rf"(?U)(?<!\w)({X.IDENTIFIER})\s*\("), F.lit(1))
    return X.top_counts(F.transform(F.filter(found, lambda w: ~w.isin(*X.JAVA_KEYWORDS)), lambda w: F.lower(w)), k)


def sem_features(df: DataFrame) -> Column:
    imports = F.col("_c.imports")
    scalars = {f"{k}_count": _added("found", _WORD, (k,)) for k in ("try", "catch", "throw")}
    scalars |= {f"{name}_usage": _added("found", _WORD, X.TYPE_FAMILIES[family]) for name, family in (("collection", "collections"), ("stream", "streams"), ("io", "io"))}
    scalars |= {f"type_family:{family}": _added("inside", _INSIDE, names) for family, names in X.TYPE_FAMILIES.items()}
    scalars |= {f"call_family:{family}": _added("called", _CALLED, names) for family, names in X.CALL_FAMILIES.items()}
    scalars["import_count_total"] = F.size(imports)
    total = sum((v.cast("double") for v in scalars.values()), F.lit(0.0))
    scalars["semantic_signal_density"] = total / F.greatest(F.col("_c.tokens"), F.lit(1))
    packages = F.array_distinct(F.filter(F.transform(imports, lambda p: F.substring_index(p, ".", 2)), lambda p: p != ""))
    return _entries(scalars, {"import_family:": F.transform(packages, lambda p: F.struct(F.lit(1).cast("bigint").alias("n"), p.alias("key")))})


def file_features(files: DataFrame, file_id: str = "file_id", sid: str = "sid", text: str = "text") -> DataFrame:
    """(space, sid, file_id, feature, value) for the spaces expr and sem. Per row, no shuffle."""
    df = prepared(files.select(F.col(sid).alias("sid"), F.col(file_id).alias("file_id"), F.col(text).alias("text")))
    both = F.array(F.struct(F.lit("expr").alias("space"), expr_features(df).alias("fs")), F.struct(F.lit("sem").alias("space"), sem_features(df).alias("fs")))
    long = df.select("sid", "file_id", F.explode(both).alias("s")).select("sid", "file_id", "s.space", F.explode("s.fs").alias("f"))
    return long.select("space", "sid", "file_id", "f.feature", "f.value")


def listed_files(files: DataFrame, file_id: str = "file_id", sid: str = "sid") -> DataFrame:
    """(space, sid, file_id) of :func:`file_features`, which has features of every file in both spaces; texts are not read."""
    return files.select(F.explode(F.array(F.lit("expr"), F.lit("sem"))).alias("space"), F.col(sid).alias("sid"), F.col(file_id).alias("file_id"))
