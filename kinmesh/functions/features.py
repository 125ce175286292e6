"""Column rules on feature keys: kind, transform, scale, family, label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes and suffixes that decide a feature's kind.
BINARY_PREFIXES = ("import_family:", "ast_provider:", "ast_parse_status:")
RATIO_PREFIXES = ("line_bucket:", "identifier_shape:", "token_category:", "ast_node_ratio:", "ast_type_ratio:", "ast_edge_ratio:", "ast_path_ratio:")
RATIO_SUFFIXES = ("_ratio", "_mean", "_std", "_entropy", "_density", "_branching")
#: Comparison scales as (space, prefixes, exact keys, scale); the first that fits counts, else 1.
SCALES = (
    ("expr", ("expr_ngram:", "line_skeleton:", "keyword_operator_pair:", "call_name:"), (), 1.35),
    ("expr", ("keyword:", "operator:"), (), 1.15),
    ("expr", (), ("token_count", "identifier_count", "import_stmt_count", "line_length_mean", "line_length_std", "file_count"), 0.45),
    ("struct", ("ast_node_ratio:", "ast_type_ratio:", "ast_edge_ratio:", "ast_path_ratio:"), (), 1.35),
    ("struct", ("ast_method_arity:", "ast_method_statement:"), (), 1.15),
    ("struct", ("ast_node:", "ast_type:", "ast_edge:", "ast_path:"), (), 0.58),
    ("struct", (), ("ast_node_count", "ast_max_depth", "ast_unique_node_types", "ast_unique_exact_node_types", "file_count"), 0.6),
)
#: Families of features for explanations; order decides.
CONTROL_MARKS = (":if", ":for", ":while", ":switch", ":try", ":catch")
SIZE_KEYS = ("token_count", "identifier_count", "import_stmt_count", "file_count", "ast_node_count", "ast_max_depth", "ast_unique_node_types", "ast_unique_exact_node_types", "import_count_total")
SEMANTIC_KEYS = ("collection_usage", "stream_usage", "io_usage", "try_count", "catch_count", "throw_count", "semantic_signal_density")
#: German labels by prefix; %s stands for what follows the prefix.
LABELS = (
    ("line_skeleton:", "maskierte Zeilenform '%s'"),
    ("keyword_operator_pair:", "Keyword/Operator-Folge %s"),
    ("call_name:", "Aufrufname %s"),
    ("keyword:", "Keyword %s"),
    ("ast_node_ratio:", "AST-Knoten-Anteil %s"),
    ("ast_type_ratio:", "AST-Exact-Type-Anteil %s"),
    ("ast_edge_ratio:", "AST-Kanten-Anteil %s"),
    ("ast_path_ratio:", "AST-Pfad-Anteil %s"),
    ("ast_node:", "AST-Knoten %s"),
    ("ast_type:", "AST-Exact-Type %s"),
    ("ast_edge:", "AST-Kante %s"),
    ("ast_path:", "AST-Pfad %s"),
    ("ast_method_arity:", "Methoden-Arity-Bucket %s"),
    ("ast_method_statement:", "Methoden-Statement-Bucket %s"),
    ("call_family:", "Call-Familie %s"),
    ("type_family:", "Typ-/API-Familie %s"),
    ("import_family:", "Import-Familie %s"),
    ("ast_provider:", "AST-Provider %s"),
    ("ast_parse_status:", "AST-Parse-Status %s"),
)
#: German labels of operator groups.
OPERATOR_LABELS = {
    "assignment": "Zuweisungsoperatoren",
    "comparison": "Vergleichsoperatoren",
    "logic": "logische Operatoren",
    "arithmetic": "arithmetische Operatoren",
    "bitwise": "bitweise Operatoren",
}


#: German labels of families, and the families that a space's agreement is told by.
FAMILY_LABELS = {
    "surface": "Oberfläche",
    "calls": "Aufrufmuster",
    "control": "Kontrollfluss",
    "ast": "AST-Form",
    "size": "Größe/Volumen",
    "style": "Stil/Format",
    "semantics": "inhaltliches Signal",
    "parsing": "Parser-/AST-Status",
    "other": "sonstiges Signal",
}
AGREEMENT = {
    "expr": (("surface", "Oberfläche"), ("calls", "Aufrufmuster"), ("style", "Stil/Format"), ("size", "Größe")),
    "struct": (("control", "Kontrollfluss"), ("ast", "AST-Form"), ("style", "Methoden-/Blockprofil"), ("size", "Größe")),
    "sem": (("semantics", "Strategie-/API-Signal"), ("calls", "Aufrufmuster"), ("surface", "Oberflächenreste")),
    "fusion": (("surface", "Oberfläche"), ("control", "Struktur"), ("semantics", "Inhalt/Strategie")),
}


def family_label(family: Column) -> Column:
    out = family
    for name, label in FAMILY_LABELS.items():
        out = F.when(family == name, label).otherwise(out)
    return out


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def starts_with(key: Column, prefixes) -> Column:
    return _any(key.startswith(p) for p in prefixes)


def feature_kind(key: Column) -> Column:
    """binary, ratio or count, by the whole key."""
    ratio = starts_with(key, RATIO_PREFIXES) | _any(key.endswith(s) for s in RATIO_SUFFIXES) | key.contains("_per_")
    return F.when(starts_with(key, BINARY_PREFIXES), "binary").when(ratio, "ratio").otherwise("count")


def transform_value(kind: Column, value: Column) -> Column:
    return F.when(kind == "binary", (value > 0).cast("double")).when(kind == "ratio", value).otherwise(F.log1p(F.greatest(F.lit(0.0), value)))


def feature_scale(space: Column, key: Column) -> Column:
    out = F.lit(1.0)
    for name, prefixes, exact, scale in reversed(SCALES):
        out = F.when((space == name) & (starts_with(key, prefixes) | key.isin(*exact)), scale).otherwise(out)
    return out


def feature_family(key: Column) -> Column:
    ast = starts_with(key, ("ast_node_ratio:", "ast_type_ratio:", "ast_edge_ratio:", "ast_path_ratio:", "ast_node:", "ast_type:", "ast_edge:", "ast_path:"))
    return (
        F.when(starts_with(key, ("expr_ngram:", "keyword:", "operator:", "keyword_operator_pair:")), "surface")
        .when(key.startswith("line_skeleton:"), "style")
        .when(key.startswith("call_name:"), "calls")
        .when(starts_with(key, ("identifier_shape:", "token_category:", "line_bucket:")), "style")
        .when(key.isin(*SIZE_KEYS), "size")
        .when(ast & _any(key.contains(m) for m in CONTROL_MARKS), "control")
        .when(ast, "ast")
        .when(key.startswith("ast_"), "style")
        .when(starts_with(key, ("call_family:", "type_family:", "import_family:")) | key.isin(*SEMANTIC_KEYS), "semantics")
        .otherwise("other")
    )


def humanize_feature(key: Column) -> Column:
    """German label of a feature key."""
    after = F.substr(key, F.instr(key, ":") + 1)
    out = F.replace(key, F.lit("_"), F.lit(" "))
    for prefix, template in LABELS:
        head, tail = template.split("%s")
        out = F.when(key.startswith(prefix), F.concat(F.lit(head), after, F.lit(tail))).otherwise(out)
    operator = after
    for name, label in OPERATOR_LABELS.items():
        operator = F.when(after == name, label).otherwise(operator)
    gram = F.substr(after, F.instr(after, ":") + 1)
    return (
        F.when(key.startswith("expr_ngram:"), F.concat(F.lit("maskiertes Token-"), F.split_part(key, F.lit(":"), F.lit(2)), F.lit("-Gramm '"), gram, F.lit("'")))
        .when(key.startswith("operator:"), operator)
        .when(key.startswith("identifier_shape:"), F.concat(F.lit("Identifier-Form "), F.replace(after, F.lit("_"), F.lit(" "))))
        .when(key.startswith("token_category:"), F.concat(F.lit("Token-Mix "), F.replace(after, F.lit("_"), F.lit(" "))))
        .when(key.startswith("line_bucket:"), F.concat(F.lit("Zeilenlänge "), F.replace(after, F.lit("_ratio"), F.lit(""))))
        .otherwise(out)
    )


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
