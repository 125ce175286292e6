"""Source-text functions: comments, masks, tokens, counts of repeated items."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keywords that masking keeps. Those of Java, then those of Python that Java lacks.
JAVA_KEYWORDS = (
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default", "do", "double",
    "else", "enum", "extends", "final", "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int", "interface",
    "long", "native", "new", "package", "private", "protected", "public", "return", "short", "static", "strictfp", "super", "switch",
    "synchronized", "this", "throw", "throws", "transient", "try", "void", "volatile", "while", "var", "record",
)
PYTHON_KEYWORDS = (
    "False", "None", "True", "and", "as", "async", "await", "def", "del", "elif", "except", "from", "global", "in", "is", "lambda",
    "nonlocal", "not", "or", "pass", "raise", "with", "yield",
)
#: Patterns of identifiers, numbers, strings, tokens and operators.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
NUMBER = r"\d+(?:\.\d+)?"
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|==|!=|<=|>=|&&|\|\||[{}()\[\];,.<>+\-*/%=&|!:?]"
OPERATOR = r"==|!=|<=|>=|&&|\|\||[<>+\-*/%=&|!:?]"
OPERATORS = {
    "assignment": r"(?:=|\+=|-=|\*=|/=|%=)",
    "comparison": r"(?:==|!=|<=|>=|<|>)",
    "logic": r"(?:&&|\|\||!)",
    "arithmetic": r"(?:\+|-|\*|/|%)",
    "bitwise": r"(?:&|\||\^|~|<<|>>|>>>)",
}
#: Keywords counted, shapes of identifiers, words of type and call families.
EXPR_KEYWORDS = ("if", "for", "while", "switch", "return", "try", "catch", "throw", "new")
SHAPES = {
    "single_char": r"^[A-Za-z]$",
    "camel_case": r"^[a-z]+(?:[A-Z][a-z0-9]+)+$",
    "snake_case": r"^[a-z]+(?:_[a-z0-9]+)+$",
    "upper_case": r"^[A-Z][A-Z0-9_]*$",
}
TYPE_FAMILIES = {
    "collections": ("List", "Map", "Set", "Queue", "Deque", "ArrayList", "HashMap", "HashSet", "LinkedList"),
    "streams": ("stream", "Collectors", "Optional", "map", "filter", "reduce"),
    "io": ("File", "Path", "Files", "BufferedReader", "BufferedWriter", "Scanner", "PrintWriter"),
    "strings": ("StringBuilder", "StringBuffer", "substring", "split", "trim", "replace"),
    "numbers": ("Math", "Integer", "Long", "Double", "BigDecimal"),
    "concurrency": ("Thread", "Runnable", "Executor", "Future", "CompletableFuture", "synchronized"),
    "tests": ("assert", "Assertions", "Assert", "Test"),
}
CALL_FAMILIES = {
    "add": ("add", "append", "offer", "push"),
    "access": ("get", "set", "put", "peek", "poll"),
    "remove": ("remove", "pop", "clear"),
    "contains": ("contains", "containsKey", "containsValue", "equals", "matches"),
    "sort": ("sort", "sorted", "compareTo"),
    "parse": ("parseInt", "parseLong", "parseDouble", "valueOf"),
    "io": ("print", "println", "read", "write", "open", "close", "flush"),
}

#: A string (an open one runs to the end), or a comment with its line break; strings end at their own quote only.
_STRING_OR_COMMENT = re.compile(r"""("(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z))|//([^\n]*\n?)|/\*(.*?)(\*/|\Z)""", re.DOTALL)


def comment_parts(text: str) -> tuple[str, int, int]:
    """(text without comments, comment lines, comment characters).

    A line comment counts its characters after the slashes, its line break too, and one line
    if it has a break. A block comment counts its inside, both characters of its end, and its
    breaks, which stay in the text.
    """
    if "//" not in text and "/*" not in text:
        return text, 0, 0
    lines = chars = 0

    def cut(m: re.Match) -> str:
        nonlocal lines, chars
        if m[1] is not None:
            return m[1]
        if m[2] is not None:
            chars += len(m[2])
            if m[2].endswith("\n"):
                lines += 1
                return "\n"
            return ""
        breaks = m[3].count("\n")
        lines += breaks
        chars += len(m[3]) + len(m[4])
        return "\n" * breaks

    return _STRING_OR_COMMENT.sub(cut, text), lines, chars


def strip_comments(text: Column) -> Column:
    """A struct of text, comment_lines and comment_chars."""

    @F.arrow_udf("struct<text:string,comment_lines:int,comment_chars:int>")
    def run(texts: pa.Array) -> pa.Array:
        parts = [comment_parts(t or "") for t in texts.to_pylist()]
        kinds = (pa.string(), pa.int32(), pa.int32())
        return pa.StructArray.from_arrays([pa.array([p[k] for p in parts], kind) for k, kind in enumerate(kinds)], ["text", "comment_lines", "comment_chars"])

    return run(text)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it often in ``body``."""
    return F.transform(F.array(value), body)[0]


def normalize_whitespace(text: Column) -> Column:
    """LF line ends, lines trimmed and their gaps one blank, no blank at either end of the text."""
    lines = F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n")
    flat = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", ""))
    return F.regexp_replace(F.array_join(flat, "\n"), r"^\s+|\s+$", "")


def mask_identifiers(text: Column) -> Column:
    """Identifiers become ID; keywords of Java and Python stay. Word boundaries are those of Unicode."""
    kept = "|".join(JAVA_KEYWORDS + PYTHON_KEYWORDS)
    return F.regexp_replace(text, rf"(?U)(?<!\w)(?!(?:{kept})(?!\w)){IDENTIFIER}(?!\w)", "ID")


def mask_literals(text: Column) -> Column:
    """Closed strings become STR, then numbers NUM."""
    strings = F.regexp_replace(text, r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'""", "STR")
    return F.regexp_replace(strings, r"(?U)(?<!\w)\d+(?:\.\d+)?(?!\w)", "NUM")


def normalizations(text: Column, bare: Column) -> dict[str, Column]:
    """The six forms of a source. ``bare`` is the text without comments; the last form masks identifiers first, so words in strings are masked too."""
    return {
        "raw": text,
        "whitespace": normalize_whitespace(text),
        "no_comments": normalize_whitespace(bare),
        "masked_identifiers": normalize_whitespace(mask_identifiers(bare)),
        "masked_literals": normalize_whitespace(mask_literals(bare)),
        "ast_normalized": normalize_whitespace(mask_literals(mask_identifiers(bare))),
    }


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def identifiers(text: Column) -> Column:
    """Identifiers that are no Java keyword."""
    found = F.regexp_extract_all(text, F.lit(rf"(?U)(?<!\w){IDENTIFIER}(?!\w)"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*JAVA_KEYWORDS))


def non_empty_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")


def grams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a blank; none where there are fewer."""
    runs = let(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " ")))
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(runs)


def top_counts(items: Column, k: int | None = None) -> Column:
    """Array of (n, key) of distinct items by count downward, then key; the first ``k``.

    Equal items meet by sorting the array, so a text's cost is n log n and nothing is shuffled.
    """

    def runs(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), F.struct(i.alias("i"), x.alias("x")))), lambda e: e.isNotNull())
        counted = let(firsts, lambda f: F.transform(f, lambda e, j: F.struct((e["i"] - F.coalesce(F.get(f, j + 1)["i"], F.size(s))).alias("less"), e["x"].alias("key"))))
        ordered = F.array_sort(counted)
        return ordered if k is None else F.slice(ordered, 1, k)

    return F.transform(let(F.sort_array(items), runs), lambda e: F.struct((-e["less"]).cast("bigint").alias("n"), e["key"].alias("key")))


def entropy(items: Column) -> Column:
    """Shannon entropy in bits of the items; 0 where there are none."""

    def bits(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda s, e: s + e["n"])
        return let(total, lambda t: F.aggregate(counts, F.lit(0.0), lambda s, e: s - e["n"] / t * F.log2(e["n"] / t)))

    return let(top_counts(items), bits)


def count_substring(text: Column, needle: str) -> Column:
    """Occurrences without overlap, with no regard to word bounds."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def count_substrings(text: Column, needles: tuple[str, ...]) -> Column:
    """An array with :func:`count_substring` of each needle, in one trip to a worker."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[t.count(n) for n in needles] for t in (x or "" for x in texts.to_pylist())], pa.list_(pa.int64()))

    return run(text)


def top_grams(words: Column, sizes: dict[int, int]) -> Column:
    """A struct g2, g3, .. of :func:`top_counts` of :func:`grams` for each size and its number of items, counted by a table of each text."""
    entry = "array<struct<n:bigint,key:string>>"

    @F.arrow_udf(f"struct<{','.join(f'g{n}:{entry}' for n in sizes)}>")
    def run(rows: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("n", pa.int64()), ("key", pa.string())]))
        out = {n: [] for n in sizes}
        for row in rows:
            words = row.as_py() or []
            for n, most in sizes.items():
                counts = Counter(map(" ".join, zip(*(words[shift:] for shift in range(n)), strict=False)))
                out[n].append([{"n": c, "key": g} for g, c in sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:most]])
        return pa.StructArray.from_arrays([pa.array(out[n], kind) for n in sizes], [f"g{n}" for n in sizes])

    return run(words)


#: Patterns of imports, constructors and methods.
IMPORT = r"(?m)^\s*import\s+([A-Za-z0-9_.*]+)\s*;"
#: One word of the type stands for all: words before it start a match earlier and end none elsewhere, but cost a search each.
METHOD = r"(?U)\b[A-Za-z_][A-Za-z0-9_<>\[\]]+\s+[A-Za-z_][A-Za-z0-9_]*\s*\([^;{}]*\)\s*(?:throws\s+[^ {]+)?\{"
CONSTRUCTOR = r"(?U)\b([A-Z][A-Za-z0-9_]*)\s*\([^;{}]*\)\s*(?:throws\s+[^ {]+)?\{"
#: The words counted anywhere in a text, each once, and those counted between word boundaries.
NEEDLES = tuple(dict.fromkeys(n for names in TYPE_FAMILIES.values() for n in names))
WORDS = tuple(dict.fromkeys((*EXPR_KEYWORDS, "try", "catch", "throw", *(n for f in ("collections", "streams", "io") for n in TYPE_FAMILIES[f]))))
CALLS = tuple(n for names in CALL_FAMILIES.values() for n in names)

_JAVA = frozenset(JAVA_KEYWORDS)
_ASCII_WORD, _RUN, _TOKEN, _LINE = re.compile(IDENTIFIER), re.compile(r"\w+"), re.compile(TOKEN, re.ASCII), re.compile(r"\r\n|[\n\r]")
_CALL = re.compile(rf"\b({IDENTIFIER})\s*\(")
_STRING = re.compile(r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'""")
_BY_LETTER = {c: "|".join(w[1:] for w in JAVA_KEYWORDS + PYTHON_KEYWORDS if w[0] == c) for c in sorted({w[0] for w in JAVA_KEYWORDS + PYTHON_KEYWORDS})}
#: Numbers, which :func:`mask_literals` makes words, and words that :func:`mask_identifiers` does not keep.
_MASKED = re.compile(rf"\b(?:\d+(?:\.\d+)?|(?!(?:{'|'.join(f'{c}(?:{ends})' for c, ends in _BY_LETTER.items())})\b){IDENTIFIER})\b")
_NUMBER, _OPERATOR = re.compile(NUMBER, re.ASCII), re.compile(OPERATOR)
#: A line starts after any of the breaks that Java knows.
_IMPORT = re.compile(r"(?:\A|(?<=[\n\r\x85\u2028\u2029]))" + IMPORT.removeprefix("(?m)^"), re.ASCII)
_DECLARED = [re.compile(p.removeprefix("(?U)")) for p in (METHOD, CONSTRUCTOR)]
_SHAPES = [re.compile(p) for p in SHAPES.values()]
#: Signs between other characters, as these keep signs apart and belong to no operator.
_OTHER, _SIGNS = re.compile(r"[^-=+*/%!<>&|^~]+"), [re.compile(p) for p in OPERATORS.values()]


@lru_cache(1 << 16)
def _shape(run: str) -> int:
    """The shapes of a run of word characters as bits; one bit more if it is no identifier or a Java keyword."""
    if run in _JAVA or not _ASCII_WORD.fullmatch(run):
        return 1 << len(_SHAPES)
    return sum(1 << k for k, p in enumerate(_SHAPES) if p.match(run))


@lru_cache(1 << 16)
def _category(token: str) -> int:
    """Whether a token is a keyword, a name, a literal and an operator, as bits."""
    keyword = token in _JAVA
    name, literal = not keyword and _ASCII_WORD.fullmatch(token) is not None, token in ("NUM", "STR") or _NUMBER.fullmatch(token) is not None
    return keyword | name << 1 | literal << 2 | (_OPERATOR.fullmatch(token) is not None) << 3


def _top(counts: dict, k: int | None = None) -> list[tuple]:
    """Distinct items as (n, key) by count downward, then key; the first ``k``."""
    return [(n, key) for key, n in sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:k]]


def _by_bit(by_code: list[int], bits: int) -> list[int]:
    return [sum(n for code, n in enumerate(by_code) if code >> k & 1) for k in range(bits)]


def _runs(words: list[str]) -> tuple[dict, dict, dict]:
    """How often each word, two and three words in a row are found: shorter runs from the longest ones and the end."""
    three = Counter(zip(words, words[1:], words[2:], strict=False))
    two, one = Counter([tuple(words[-2:])] if len(words) > 1 else ()), Counter(words[-2:])
    for (a, b, _), n in three.items():
        two[a, b] += n
        one[a] += n
    return one, two, three


def text_counts(source: str) -> tuple:
    """What :data:`COUNTS` names, counted in one text."""
    code, comment_lines, comment_chars = comment_parts(source)
    lines = _LINE.split(source)
    lengths = Counter(n for n in (len(x.rstrip(" \t\n\x0b\f\r")) for x in lines) if n)
    runs, tokens, called = Counter(_RUN.findall(code)), _TOKEN.findall(code), Counter(_CALL.findall(code) if "(" in code else ())
    masked = _MASKED.sub("ID", _STRING.sub("STR", code) if '"' in code or "'" in code else code)
    one, two, three = _runs(_ASCII_WORD.findall(masked))
    by_shape, id_chars, no_id = [0] * (2 << len(_SHAPES)), 0, 1 << len(_SHAPES)
    for run, n in runs.items():
        shape = _shape(run)
        by_shape[shape] += n
        if shape < no_id:
            id_chars += n * len(run)
    by_token, by_category, signs = Counter(tokens), [0] * 16, set()
    for token, n in by_token.items():
        category = _category(token)
        by_category[category] += n
        if category & 9:
            signs.add(token)
    bare = _OTHER.sub(" ", code)
    declared = [sum(1 for _ in p.finditer(code)) if "{" in code else 0 for p in _DECLARED]
    # 48 words and their blanks are the 96 characters that count
    skeletons = (" ".join(x.split(None, 48))[:96] for x in masked.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return (
        comment_lines, comment_chars, len(lines) - (lines[-1] == ""), len(source), _top(lengths),
        len(tokens), len(by_token), sorted(one.values(), reverse=True), sum(by_shape[:no_id]), id_chars,
        _by_bit(by_shape[:no_id], len(_SHAPES)), _by_bit(by_category, 4), [len(p.findall(bare)) for p in _SIGNS], declared,
        [runs[w] for w in WORDS], [called[w] for w in CALLS], [code.count(w) for w in NEEDLES], _IMPORT.findall(code) if "import" in code else [],
        _top({" ".join(g): n for g, n in two.items()}, 36), _top({" ".join(g): n for g, n in three.items()}, 24), _top(Counter(filter(None, skeletons)), 28),
        _top(Counter(f"{a}->{b}" for a, b in pairwise(t for t in tokens if t in signs)), 20), _top(_lowered(called), 16),
    )


def _lowered(called: Counter) -> Counter:
    out = Counter()
    for name, n in called.items():
        if name not in _JAVA:
            out[name.lower()] += n
    return out


_ITEMS = pa.list_(pa.struct([("n", pa.int64()), ("key", pa.string())]))
#: Fields of :func:`counted`: whole numbers, lists of counts (in the order of the names above), and items as (n, key), most frequent first.
COUNTS = {
    **dict.fromkeys(("comment_lines", "comment_chars", "lines", "chars"), pa.int64()),
    "lengths": pa.list_(pa.struct([("n", pa.int64()), ("key", pa.int64())])),
    **dict.fromkeys(("tokens", "unique"), pa.int64()),
    "words": pa.list_(pa.int64()),
    **dict.fromkeys(("ids", "id_chars"), pa.int64()),
    **dict.fromkeys(("shapes", "categories", "signs", "declared", "found", "called", "inside"), pa.list_(pa.int64())),
    "imports": pa.list_(pa.string()),
    **dict.fromkeys(("g2", "g3", "skeletons", "pairs", "calls"), _ITEMS),
}


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = [0]
    for v in values:
        ends.append(ends[-1] + len(v))
    flat, item = list(chain.from_iterable(values)), kind.value_type
    if pa.types.is_struct(item):
        inner = pa.StructArray.from_arrays([pa.array([e[k] for e in flat], item.field(k).type) for k in range(2)], ["n", "key"])
    else:
        inner = pa.array(flat, item)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)


def counted(text: Column) -> Column:
    """A struct of :data:`COUNTS`: all that features count in a text, in one trip to a worker and one reading of its words.

    Equal words of a text are looked at once; ratios, means and names of features are left to the plan.
    """
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.string()): "array<string>", _ITEMS: "array<struct<n:bigint,key:string>>", COUNTS["lengths"]: "array<struct<n:bigint,key:bigint>>"}

    @F.arrow_udf(f"struct<{','.join(f'{name}:{kinds[kind]}' for name, kind in COUNTS.items())}>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [text_counts(t.as_py() or "") for t in texts]
        columns = list(zip(*rows, strict=True)) or [()] * len(COUNTS)
        return pa.StructArray.from_arrays([_column(v, kind) for v, kind in zip(columns, COUNTS.values(), strict=True)], list(COUNTS))

    return run(text)


def slugify(text: Column) -> Column:
    """Trimmed, blanks and other characters as _, none at the ends; 'assignment' where nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(F.trim(text), " ", "_"), r"[^A-Za-z0-9_\-]", "_")
    bare = F.regexp_replace(safe, r"^_+|_+$", "")
    return F.when(bare == "", "assignment").otherwise(bare)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("::", F.least(a, b), F.greatest(a, b))


def packed_chunks(text: Column, most: int) -> Column:
    """Lines packed greedily into chunks of at most ``most`` characters; a longer line stays whole."""
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("lines"), F.lit(0).alias("size"))

    def add(acc: Column, line: Column) -> Column:
        cost = F.length(line) + 1
        full = (F.size(acc["lines"]) > 0) & (acc["size"] + cost > most)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["lines"], "\n")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(line)).otherwise(F.concat(acc["lines"], F.array(line))).alias("lines"),
            F.when(full, cost).otherwise(acc["size"] + cost).alias("size"),
        )

    packed = F.aggregate(F.split(text, "\n"), begin, add, lambda acc: F.when(F.size(acc["lines"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["lines"], "\n")))).otherwise(acc["done"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)
