"""Queries on texts: every document is a file, its source the submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.functions import text as X
from kinmesh.operators import struct_features as ST
from kinmesh.operators import text_features as T
from kinmesh.session import materialize, read_table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("sid"), F.coalesce("text", F.lit("")).alias("text"))


def _wide(df: DataFrame, columns: dict) -> DataFrame:
    return df.select("file_id", *[F.round(v.cast("double"), 5).alias(k.split(":")[-1]) for k, v in columns.items()])


def text_tokens_ngrams(spark, sf_dir):
    """The 36 most frequent token pairs of each file, count downward, then pair."""
    return T.top_grams(files(spark, sf_dir).select("file_id", X.tokenize(F.col("text")).alias("tokens")), 2, 36)


def text_line_buckets(spark, sf_dir):
    df = files(spark, sf_dir).withColumn("n", F.transform(X.non_empty_lines(F.col("text")), lambda x: F.length(x)))
    return _wide(df, T.line_buckets(F.col("n")))


def text_identifier_shapes(spark, sf_dir):
    df = files(spark, sf_dir).withColumn("ids", X.identifiers(F.col("text")))
    return _wide(df, {"identifiers": F.size("ids")} | T.identifier_shapes(F.col("ids")))


def text_keyword_operator_counts(spark, sf_dir):
    df, t = files(spark, sf_dir), F.col("text")
    counts = {f"op_{k}": F.regexp_count(t, F.lit(p)) for k, p in X.OPERATORS.items()}
    return df.select("file_id", *[v.cast("bigint").alias(k) for k, v in counts.items()])


def text_token_categories(spark, sf_dir):
    return _wide(files(spark, sf_dir).withColumn("t", X.tokenize(F.col("text"))), T.token_categories(F.col("t")))


def text_token_entropy(spark, sf_dir):
    tokens = files(spark, sf_dir).select("file_id", F.explode_outer(X.tokenize(F.col("text"))).alias("token"))
    counts = tokens.groupBy("file_id", "token").agg(F.count("token").alias("n"))
    total, spread = F.sum("n"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n")).otherwise(0.0))
    return counts.groupBy("file_id").agg(F.round(F.when(total > 0, F.log2(F.greatest(total, F.lit(1))) - spread / F.greatest(total, F.lit(1))).otherwise(0.0), 5).alias("entropy"))


def text_call_names(spark, sf_dir):
    """The 16 most frequent names before an opening bracket."""
    df = files(spark, sf_dir).withColumn("t", T.call_names(F.col("text"), 16))
    return df.select("file_id", F.explode("t").alias("e")).select("file_id", F.col("e.key").alias("name"), F.col("e.n").alias("n"))


def text_substring_families(spark, sf_dir):
    t = F.col("text")
    sums = {k: sum((X.count_substring(t, n) for n in names), F.lit(0).cast("bigint")) for k, names in X.TYPE_FAMILIES.items()}
    return files(spark, sf_dir).select("file_id", *[v.alias(f"type_{k}") for k, v in sums.items()])


def text_masking(spark, sf_dir):
    """Digests of the masked forms, with the order of masks that keeps literals."""
    t = F.col("text")
    flat = X.normalize_whitespace(t)
    return files(spark, sf_dir).select("file_id", F.sha2(flat, 256).alias("whitespace"), F.sha2(X.mask_literals(t), 256).alias("literals"), F.sha2(X.mask_identifiers(t), 256).alias("identifiers"))


def content_hash_dedupe(spark, sf_dir):
    """One row for each distinct content: its digest, first file and number of files. Partial counts meet, not texts."""
    df = files(spark, sf_dir).select("file_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("n"))
    return df.groupBy("sha256").agg(F.min("file_id").alias("first_file"), F.count(F.lit(1)).alias("files"), F.max("n").cast("bigint").alias("chars"))


def text_chunks(spark, sf_dir):
    """Lines packed into chunks of 1000 characters; weight is the root of a chunk's length, at least 1."""
    df = files(spark, sf_dir).select("file_id", F.posexplode(X.packed_chunks(F.col("text"), 1000)).alias("chunk", "body"))
    return df.select("file_id", "chunk", F.length("body").cast("bigint").alias("chars"), F.round(F.greatest(F.lit(1.0), F.sqrt(F.length("body"))), 5).alias("weight"))


def submission_chunk_list(spark, sf_dir):
    """The first 24 chunks of 1000 characters of each ten documents in a row."""
    own = files(spark, sf_dir).select(F.expr("file_id div 10").alias("sid"), F.col("file_id").alias("path"), "text")
    out = T.submission_chunks(own, 1000)
    return out.select("sid", "path", F.col("part").cast("bigint").alias("part"), F.col("rank").cast("bigint").alias("rank"), "chars", F.round("weight", 5).alias("weight"))


def text_features(spark, sf_dir):
    """All text features of the spaces expr and sem of every file, summed up by feature."""
    long = T.file_features(files(spark, sf_dir))
    return long.groupBy("space", "sid", "feature").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("value"), 4).alias("value"))


def submission_features(spark, sf_dir):
    """Feature maps of every source, all features: counts added, ratios averaged, binaries any."""
    from kinmesh.operators.model import aggregate_features

    own = files(spark, sf_dir)
    return aggregate_features(T.file_features(own), T.listed_files(own)).select("space", "sid", "feature", F.round("value", 4).alias("value"))


METHOD_TEXT = "int take(int a) { if (a > 1) { return a; } return 0; } "
CALL_TEXT = "void run() { try { list.add(take(2)); print(take(3)); } catch (Error e) { throw e; } } "


def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Java source for each nation: one method for its region and each before it, then one that calls."""
    nation = read_table(spark, sf_dir, "nation")
    text = F.concat(F.lit("import java.util.List; // sources\nclass N"), F.col("n_nationkey").cast("string"), F.lit(" { "), F.repeat(F.lit(METHOD_TEXT), F.col("n_regionkey") + 1), F.lit(CALL_TEXT), F.lit("}\n"))
    return nation.select(F.col("n_nationkey").alias("file_id"), F.col("n_regionkey").cast("string").alias("sid"), text.alias("text"))


def source_struct_features(spark, sf_dir):
    """Counts of node kinds and the profile of methods of each source."""
    nodes = materialize(ST.syntax_nodes(java_sources(spark, sf_dir)), "nodes")
    found = ST.struct_features(nodes).filter(F.col("feature").rlike("^ast_(node|method_arity|method_statement):|^ast_(node_count|max_depth|max_control_depth|error_ratio|method_arity_mean|method_statement_max)$"))
    return found.select(F.col("file_id").cast("int").alias("file_id"), "feature", F.round("value", 6).alias("value"))


def source_call_names(spark, sf_dir):
    df = java_sources(spark, sf_dir).withColumn("t", T.call_names(F.col("text"), 16))
    return df.select("file_id", F.explode("t").alias("e")).select("file_id", F.col("e.key").alias("name"), F.col("e.n").alias("n"))


def source_keyword_counts(spark, sf_dir):
    features = T.file_features(java_sources(spark, sf_dir)).filter(F.col("feature").startswith("keyword:") | F.col("feature").isin("method_signature_count", "import_stmt_count", "try_count", "catch_count", "throw_count", "import_count_total"))
    return features.select("space", F.col("file_id").cast("int").alias("file_id"), "feature", "value")


_F = "f AS (SELECT doc_id AS file_id, source AS sid, coalesce(text, '') AS text FROM documents)"
_TOKEN = X.TOKEN.replace("'", "''")
_TOK = f"{_F}, k AS (SELECT file_id, regexp_extract_all(text, '{_TOKEN}') AS t FROM f)"
_JAVA = ", ".join(f"'{w}'" for w in X.JAVA_KEYWORDS)
_IDS = f"""ids AS (SELECT file_id, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: regexp_full_match(w, '{X.IDENTIFIER}') AND w NOT IN ({_JAVA})) AS ids FROM f)"""
_LINES = r"ln AS (SELECT file_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> '') AS l FROM f)"


def _ratio(items: str, test: str, name: str) -> str:
    return f"round(len(list_filter({items}, lambda x: {test})) / greatest(1, len({items})), 5) AS {name}"


SQL = {
    "text_tokens_ngrams": f"""WITH {_TOK}, g AS (SELECT file_id, t[i] || ' ' || t[i + 1] AS gram FROM (SELECT file_id, t, unnest(range(1, len(t))) AS i FROM k)),
  c AS (SELECT file_id, gram, count(*) AS n FROM g GROUP BY ALL)
  SELECT * FROM (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, gram) AS rank, gram, n FROM c) WHERE rank <= 36""",
    "text_line_buckets": f"WITH {_F}, {_LINES} SELECT file_id, {_ratio('l', 'length(x) <= 40', 'short_ratio')}, {_ratio('l', 'length(x) > 40 AND length(x) <= 100', 'medium_ratio')}, {_ratio('l', 'length(x) > 100', 'long_ratio')} FROM ln",
    "text_identifier_shapes": f"WITH {_F}, {_IDS} SELECT file_id, len(ids)::DOUBLE AS identifiers, {', '.join(_ratio('ids', f'regexp_matches(x, {chr(39)}{p}{chr(39)})', f'{n}_ratio') for n, p in X.SHAPES.items())} FROM ids",
    "text_keyword_operator_counts": f"WITH {_F} SELECT file_id, {', '.join(f'len(regexp_extract_all(text, {chr(39)}{p}{chr(39)})) AS op_{k}' for k, p in X.OPERATORS.items())} FROM f",
    "text_token_categories": f"""WITH {_TOK}, c AS (SELECT file_id, greatest(1, len(t)) AS total, len(list_filter(t, lambda x: x IN ({_JAVA}))) AS kw, len(list_filter(t, lambda x: regexp_full_match(x, '{X.IDENTIFIER}') AND x NOT IN ({_JAVA}))) AS idn,
    len(list_filter(t, lambda x: x IN ('NUM', 'STR') OR regexp_full_match(x, '{X.NUMBER}'))) AS lit, len(list_filter(t, lambda x: regexp_full_match(x, '{X.OPERATOR}'))) AS op FROM k)
  SELECT file_id, round(kw / total, 5) AS keyword_ratio, round(idn / total, 5) AS identifier_ratio, round(lit / total, 5) AS literal_ratio, round(op / total, 5) AS operator_ratio, round(greatest(0, total - kw - idn - lit - op) / total, 5) AS punctuation_ratio FROM c""",
    "text_token_entropy": f"""WITH {_TOK}, c AS (SELECT file_id, w, count(*) AS n FROM (SELECT file_id, unnest(t) AS w FROM k) GROUP BY ALL),
  e AS (SELECT file_id, -sum(p * log2(p)) AS entropy FROM (SELECT file_id, n / sum(n) OVER (PARTITION BY file_id) AS p FROM c) GROUP BY file_id)
  SELECT f.file_id, round(coalesce(entropy, 0), 5) AS entropy FROM f LEFT JOIN e USING (file_id)""",
    "text_call_names": rf"""WITH {_F}, w AS (SELECT file_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+\s*\(')) AS c FROM f),
  n AS (SELECT file_id, regexp_replace(c, '\s*\($', '') AS name FROM w), c AS (SELECT file_id, lower(name) AS name, count(*) AS n FROM n WHERE regexp_full_match(name, '{X.IDENTIFIER}') AND name NOT IN ({_JAVA}) GROUP BY ALL)
  SELECT file_id, name, n FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, name) AS rank FROM c) WHERE rank <= 16""",
    "text_substring_families": f"""WITH {_F} SELECT file_id, {', '.join('(' + ' + '.join(f"(length(text) - length(replace(text, '{n}', ''))) // {len(n)}" for n in names) + f')::BIGINT AS type_{k}' for k, names in X.TYPE_FAMILIES.items())} FROM f""",
    "content_hash_dedupe": f"WITH {_F} SELECT sha256(text) AS sha256, min(file_id) AS first_file, count(*) AS files, max(length(text)) AS chars FROM f GROUP BY ALL",
}
#: Nodes of the calling method and of its surroundings by kind, and of each other method.
_NODES = {
    "compilation_unit": (1, 0), "import": (1, 0), "scoped_identifier": (2, 0), "identifier": (19, 4), "class": (1, 0), "class_body": (1, 0), "method": (1, 1), "void_type": (1, 0), "integral_type": (0, 2),
    "formal_parameters": (1, 1), "parameter": (1, 1), "block": (3, 2), "if": (0, 1), "parenthesized_expr": (0, 1), "binary_expr": (0, 1), "literal": (2, 2), "return": (0, 2), "try": (1, 0), "catch": (1, 0),
    "catch_type": (1, 0), "type_identifier": (1, 0), "throw": (1, 0), "expression": (2, 0), "call": (4, 0), "argument_list": (4, 0),
}
_NODES["identifier"] = (3 + 1 + 1 + 2 + 1 + 1 + 1 + 1 + 1, 4)  # import, class, run, list.add, take, print, take, catch, throw
SQL["text_chunks"] = f"""WITH RECURSIVE {_F}, ln AS (SELECT file_id, string_split(text, chr(10)) AS l FROM f WHERE length(text) > 1000),
  r AS (SELECT file_id, 1 AS i, 0 AS chunk, length(l[1]) + 1 AS size FROM ln
    UNION ALL SELECT r.file_id, i + 1, CASE WHEN size + length(l[i + 1]) + 1 > 1000 THEN chunk + 1 ELSE chunk END, CASE WHEN size + length(l[i + 1]) + 1 > 1000 THEN length(l[i + 1]) + 1 ELSE size + length(l[i + 1]) + 1 END
    FROM r JOIN ln USING (file_id) WHERE i < len(l)),
  c AS (SELECT file_id, chunk, (sum(length(l[i])) + count(*) - 1)::BIGINT AS chars FROM r JOIN ln USING (file_id) GROUP BY ALL UNION ALL SELECT file_id, 0, length(text) FROM f WHERE length(text) <= 1000)
  SELECT file_id, chunk, chars, round(greatest(1.0, sqrt(chars)), 5) AS weight FROM c"""
SQL["submission_chunk_list"] = SQL["text_chunks"].split("  SELECT file_id, chunk, chars")[0].rstrip() + """,
  k AS (SELECT file_id // 10 AS sid, c.file_id AS path, chunk + 1 AS part, row_number() OVER (PARTITION BY file_id // 10 ORDER BY file_id, chunk) AS rank, chars FROM c JOIN f USING (file_id) WHERE length(text) > 1000 OR regexp_matches(text, '\\S'))
  SELECT sid, path, part, rank, chars, round(greatest(1.0, sqrt(chars)), 5) AS weight FROM k WHERE rank <= 24"""
_SOURCES = "s AS (SELECT n_nationkey AS file_id, n_regionkey + 1 AS m FROM nation)"
SQL |= {
    "source_struct_features": f"""WITH {_SOURCES}, k(kind, a, b) AS (VALUES {", ".join(f"('{k}', {a}, {b})" for k, (a, b) in _NODES.items())}), c AS (SELECT file_id, m, kind, a + b * m AS n FROM s, k)
  SELECT file_id, 'ast_node:' || kind AS feature, n::DOUBLE AS value FROM c WHERE n > 0
  UNION ALL SELECT file_id, 'ast_node_count', sum(n) FROM c GROUP BY file_id
  UNION ALL SELECT file_id, unnest(['ast_max_depth', 'ast_max_control_depth', 'ast_error_ratio', 'ast_method_arity_mean', 'ast_method_statement_max', 'ast_method_arity:0', 'ast_method_arity:1', 'ast_method_statement:3_5']),
    unnest([13.0, 3.0, 0.0, round(m / (m + 1), 6), 5.0, 1.0, m, m + 1]) FROM s""",
    "source_call_names": f"WITH {_SOURCES} SELECT file_id, unnest(['take', 'add', 'print', 'run']) AS name, unnest([m + 2, 1, 1, 1])::BIGINT AS n FROM s",
    "source_keyword_counts": f"""WITH {_SOURCES} SELECT 'expr' AS space, file_id, unnest({["keyword:" + k for k in X.EXPR_KEYWORDS] + ["method_signature_count", "import_stmt_count"]}) AS feature, unnest([m, 0, 0, 0, 2 * m, 1, 1, 1, 0, m + 1, 1])::DOUBLE AS value FROM s
  UNION ALL SELECT 'sem', file_id, unnest(['try_count', 'catch_count', 'throw_count', 'import_count_total']), unnest([1.0, 1.0, 1.0, 1.0]) FROM s""",
}
QUERIES = {name: globals()[name] for name in SQL} | {"text_masking": text_masking, "text_features": text_features, "submission_features": submission_features}
