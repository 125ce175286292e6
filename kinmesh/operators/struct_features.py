"""Structural features of sources: a table of syntax nodes, then aggregates over it.

Nodes are rows (sid, file_id, node, type, children, above, within), from :func:`syntax_nodes`
or any other reader: ``above`` are the types of the ancestors, ``within`` the methods whose
bodies hold the node. Kinds, paths, edges, shares and method profiles are DataFrame work over
these rows; every count is a partial aggregate by file and key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.functions.java import syntax_rows
from kinmesh.functions.text import comment_parts

#: Coarse kinds of node types; other types lose their ending.
KINDS = {
    "program": "compilation_unit", "class_declaration": "class", "interface_declaration": "interface", "enum_declaration": "enum", "record_declaration": "record",
    "annotation_type_declaration": "annotation_type", "method_declaration": "method", "constructor_declaration": "constructor", "field_declaration": "field",
    "constant_declaration": "field", "variable_declarator": "variable", "local_variable_declaration": "local_var", "formal_parameter": "parameter",
    "spread_parameter": "parameter", "catch_formal_parameter": "parameter", "receiver_parameter": "parameter", "if_statement": "if", "for_statement": "for",
    "enhanced_for_statement": "enhanced_for", "while_statement": "while", "do_statement": "do", "switch_expression": "switch", "switch_statement": "switch",
    "switch_block_statement_group": "case_group", "switch_label": "case", "try_statement": "try", "catch_clause": "catch", "finally_clause": "finally",
    "throw_statement": "throw", "return_statement": "return", "break_statement": "break", "continue_statement": "continue", "yield_statement": "yield",
    "assert_statement": "assert", "lambda_expression": "lambda", "method_invocation": "call", "super_method_invocation": "call", "object_creation_expression": "new",
    "array_creation_expression": "new", "assignment_expression": "assign_expr", "binary_expression": "binary_expr", "ternary_expression": "ternary_expr",
    "unary_expression": "unary_expr", "cast_expression": "cast_expr", "instanceof_expression": "binary_expr", "statement_expression": "statement_expr",
    "decimal_integer_literal": "literal", "decimal_floating_point_literal": "literal", "hex_integer_literal": "literal", "hex_floating_point_literal": "literal",
    "string_literal": "literal", "character_literal": "literal", "true": "literal", "false": "literal", "null_literal": "literal",
}
KEPT = ("array_access", "field_access", "annotation", "block", "class_body")
#: Groups of kinds.
CONTROL = ("if", "for", "enhanced_for", "while", "do", "switch", "case", "try", "catch", "finally", "throw", "return", "break", "continue", "lambda")
DECLARATIONS = ("class", "interface", "enum", "record", "annotation_type", "method", "constructor", "field", "parameter", "local_var")
STATEMENTS = (*CONTROL, "block", "assert", "local_var", "statement_expr", "yield")
EXPRESSIONS = ("binary_expr", "unary_expr", "assign_expr", "ternary_expr", "call", "new", "cast_expr", "array_access", "field_access", "literal")
#: Node types counted by their own name, beside those with one of the endings.
EXACT = (
    "program", "class_body", "formal_parameters", "argument_list", "annotation", "switch_block_statement_group", "switch_label", "modifiers",
    "type_identifier", "scoped_type_identifier", "type_arguments", "type_parameter", "dimensions", "block", "ERROR",
)
EXACT_ENDINGS = ("_declaration", "_statement", "_expression", "_clause", "_type", "_parameters")
METHODS = ("method_declaration", "constructor_declaration")
PARAMETERS = ("formal_parameter", "spread_parameter", "receiver_parameter")
STATEMENT_TYPES = ("local_variable_declaration", "statement_expression", "catch_clause", "finally_clause", "switch_block_statement_group")
PROVIDER = "java_reader"
#: Kinds of a path told from either end.
PATH = 5


def syntax_nodes(files: DataFrame, file_id: str = "file_id", sid: str = "sid", text: str = "text") -> DataFrame:
    """The node rows of each source. Null text is empty and has a root alone."""
    narrow = files.select(F.col(sid).cast("string").alias("sid"), F.col(file_id).cast("string").alias("file_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
    names = ["sid", "file_id", "node", "type", "children", "above", "within"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, f, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(zip(*syntax_rows(comment_parts(t)[0]), strict=True))
                n = len(rows[0])
                yield pa.RecordBatch.from_arrays([pa.array([s] * n, pa.string()), pa.array([f] * n, pa.string()), *map(pa.array, rows, kinds)], names=names)

    return narrow.mapInArrow(read, "sid string, file_id string, node int, type string, children int, above array<string>, within array<int>")


def coarse_kind(kind: Column) -> Column:
    """The kind of a node type: a fixed one, else the type without its ending."""
    out = F.replace(kind, F.lit("__"), F.lit("_"))
    for ending, tail in (("_clause", ""), ("_expression", "_expr"), ("_statement", ""), ("_declaration", "")):
        out = F.when(kind.endswith(ending), F.concat(F.substr(kind, F.lit(1), F.length(kind) - len(ending)), F.lit(tail))).otherwise(out)
    fixed = F.create_map(*[F.lit(x) for pair in (KINDS | {k: k for k in KEPT}).items() for x in pair])
    return F.coalesce(F.try_element_at(fixed, kind), out)


def is_exact(kind: Column) -> Column:
    found = kind.isin(*EXACT)
    for ending in EXACT_ENDINGS:
        found = found | kind.endswith(ending)
    return found


def told_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` with kind, path (kinds from the root to the node), depth and control depth."""
    path = F.transform(F.concat("above", F.array("type")), coarse_kind)
    df = nodes.withColumn("path", path).withColumn("kind", F.element_at("path", -1)).withColumn("depth", F.size("path"))
    return df.withColumn("control_depth", F.size(F.filter("path", lambda k: k.isin(*CONTROL))))


def counted(told: DataFrame) -> DataFrame:
    """(sid, file_id, what, key, n): counts of kinds, exact types, edges and paths of each file.

    A leaf adds its path; one longer than PATH adds its first and its last PATH kinds.
    """
    entry = lambda what, key: F.struct(F.lit(what).alias("what"), key.alias("key"))
    long = F.size("path") > PATH
    leaf = F.col("children") == 0
    entries = F.array(
        entry("node", F.col("kind")),
        F.when(is_exact(F.col("type")), entry("type", F.col("type"))),
        F.when(F.size("path") > 1, entry("edge", F.array_join(F.slice("path", -2, 2), "->"))),
        F.when(leaf, entry("path", F.array_join(F.slice("path", 1, PATH), ">"))),
        F.when(leaf & long, entry("path", F.array_join(F.slice("path", -PATH, PATH), ">"))),
    )
    return told.select("sid", "file_id", F.explode(F.array_compact(entries)).alias("e")).groupBy("sid", "file_id", "e.what", "e.key").agg(F.count(F.lit(1)).alias("n"))


def method_profiles(told: DataFrame) -> DataFrame:
    """(sid, file_id, method, arity, statements, controls) of each method and constructor; one without a body has none of both."""
    methods = told.filter(F.col("type").isin(*METHODS)).select("sid", "file_id", F.col("node").alias("method"))
    # parameters stand right under the list of the nearest method above them
    is_parameter = F.col("type").isin(*PARAMETERS) & (F.element_at("above", -1) == "formal_parameters") & F.element_at("above", -2).isin(*METHODS)
    statement = F.col("type").endswith("_statement") | F.col("type").isin(*STATEMENT_TYPES)
    inside = told.select("sid", "file_id", F.explode("within").alias("method"), statement.cast("int").alias("statement"), F.col("kind").isin(*CONTROL).cast("int").alias("control"))
    inside = inside.groupBy("sid", "file_id", "method").agg(F.sum("statement").alias("statements"), F.sum("control").alias("controls"))
    # nodes are numbered before their children, so a parameter's method is the last one begun before it
    marks = told.filter(is_parameter | F.col("type").isin(*METHODS)).select("sid", "file_id", "node", F.col("type").isin(*METHODS).alias("is_method"))
    begun = F.last(F.when(F.col("is_method"), F.col("node")), True).over(Window.partitionBy("sid", "file_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    arity = marks.withColumn("method", begun).filter(~F.col("is_method")).groupBy("sid", "file_id", "method").agg(F.count(F.lit(1)).alias("arity"))
    return methods.join(arity, ["sid", "file_id", "method"], "left").join(inside, ["sid", "file_id", "method"], "left").fillna(0, ["arity", "statements", "controls"])


def arity_bucket(n: Column) -> Column:
    return F.when(n <= 1, n.cast("string")).when(n <= 3, "2_3").otherwise("4_plus")


def statement_bucket(n: Column) -> Column:
    return F.when(n <= 2, "0_2").when(n <= 5, "3_5").when(n <= 10, "6_10").otherwise("11_plus")


def struct_features(nodes: DataFrame) -> DataFrame:
    """(space struct, sid, file_id, feature, value) from node rows.

    ``nodes`` are read several times; pass a written table. Every file has a root, so none is lost.
    """
    file = ["sid", "file_id"]
    told = told_nodes(nodes)
    counts = counted(told)
    total = told.groupBy(*file).agg(
        F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), F.avg("children").alias("branching"), F.count_if(F.col("children") == 0).alias("leaves"),
        F.max("control_depth").alias("control_depth"), F.count_if(F.col("type") == "ERROR").alias("errors"),
        *[F.count_if(F.col("kind").isin(*kinds)).alias(name) for name, kinds in (("control", CONTROL), ("decl", DECLARATIONS), ("stmt", STATEMENTS), ("expr", EXPRESSIONS), ("own", ("method", "constructor")), ("turns", ("if", "for", "while", "switch")))],
    )
    sums = counts.groupBy(*file, "what").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.count(F.lit(1)).alias("distinct"))
    bits = F.greatest(F.lit(0.0), F.log2("t") - F.col("s") / F.col("t"))
    spread = sums.groupBy(*file).agg(*[F.max(F.when(F.col("what") == w, v)).alias(f"{w}_{name}") for w in ("node", "type", "edge", "path") for name, v in (("bits", bits), ("distinct", F.col("distinct")))])
    methods = method_profiles(told)
    profile = methods.groupBy(*file).agg(*[f(c).alias(f"{c}_{name}") for c in ("arity", "statements", "controls") for name, f in (("mean", F.avg), ("max", F.max))])
    df = total.join(spread, file).join(profile, file, "left").na.fill(0)
    per_method = F.greatest(F.col("own"), F.lit(1))
    scalars = {
        "ast_node_count": F.col("nodes"), "ast_max_depth": F.col("depth"), "ast_avg_branching": F.col("branching"), "ast_leaf_ratio": F.col("leaves") / F.col("nodes"),
        "ast_unique_node_types": F.col("node_distinct"), "ast_unique_exact_node_types": F.col("type_distinct"), "ast_profile_entropy": F.col("node_bits"),
        "ast_error_ratio": F.col("errors") / F.col("nodes"), "ast_max_control_depth": F.col("control_depth"),
        "ast_method_arity_mean": F.col("arity_mean"), "ast_method_arity_max": F.col("arity_max"), "ast_method_statement_mean": F.col("statements_mean"), "ast_method_statement_max": F.col("statements_max"),
        "ast_method_control_mean": F.col("controls_mean"), "ast_method_control_max": F.col("controls_max"), "ast_control_per_method": F.col("turns") / per_method,
        "ast_path_entropy": F.col("path_bits"), "ast_edge_entropy": F.col("edge_bits"),
        **{f"ast_{k}_ratio": F.col(k) / F.col("nodes") for k in ("control", "decl", "stmt", "expr")}, "ast_stmt_per_method": F.col("stmt") / per_method, f"ast_provider:{PROVIDER}": F.lit(1.0),
    }
    entry = lambda name, value: F.struct(name.alias("feature"), value.cast("double").alias("value"))
    status = entry(F.when(F.col("errors") > 0, "ast_parse_status:recovered").otherwise("ast_parse_status:ok"), F.lit(1.0))
    fixed = df.select(*file, F.explode(F.array(*[entry(F.lit(k), v) for k, v in scalars.items()], status)).alias("f"))
    shares = counts.join(total.select(*file, "nodes"), file).join(sums.select(*file, "what", "t"), [*file, "what"])
    whole = F.when(F.col("what").isin("node", "type"), F.col("nodes")).otherwise(F.col("t"))
    name = lambda tail: F.concat(F.lit("ast_"), F.col("what"), F.lit(tail), F.col("key"))
    keyed = shares.select(*file, F.explode(F.array(entry(name(":"), F.col("n")), entry(name("_ratio:"), F.col("n") / whole))).alias("f"))
    buckets = F.array(F.concat(F.lit("ast_method_arity:"), arity_bucket(F.col("arity"))), F.concat(F.lit("ast_method_statement:"), statement_bucket(F.col("statements"))))
    spans = methods.select(*file, F.explode(buckets).alias("feature")).groupBy(*file, "feature").agg(F.count(F.lit(1)).alias("value"))
    spans = spans.select(*file, entry(F.col("feature"), F.col("value")).alias("f"))
    return fixed.unionByName(keyed).unionByName(spans).select(F.lit("struct").alias("space"), *file, "f.feature", "f.value")


def tree_previews(nodes: DataFrame, limit: int = 12) -> DataFrame:
    """(sid, file_id, what, rank, key, n): the ``limit`` most frequent kinds, exact types, edges and paths of each file, ties by key."""
    rank = F.row_number().over(Window.partitionBy("sid", "file_id", "what").orderBy(F.desc("n"), "key"))
    return counted(told_nodes(nodes)).withColumn("rank", rank).filter(F.col("rank") <= limit)
