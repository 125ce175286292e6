"""Fill-in-middle transformation over an index of distinct texts.

1. Documents that hold one text are grouped: by its SHA-256, and within a digest by the text
   itself, so equality is one of content. A text whose copies are many, more than one row in
   ``SHARES`` is dealt into shares, so that no task gets a hot text's documents whole.
2. For each distinct text the ends of its lines are found once and kept as an Elias-Fano list:
   about 2 + log2(characters / lines) bits a line.
3. The index is joined back to the documents, which bring their id alone. Both sides are dealt
   by (digest, share) already, so the text travels once, and a share's ids are one list.
4. Each document selects its two cuts in the list, and built-in functions cut the text.

The forms put ``<P>``, ``<S>`` and ``<M>`` before prefix, suffix and middle. A text that holds
one of them is left plain, so an output can be read back (:func:`restore`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.session import own_name, read_table

SEED, RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text is hot if it has more than COPIES rows and more than one row in SHARES; at most SHARES texts are, which bounds what is broadcast.
SHARES, COPIES = 10_000, 256


def elias_fano(ends: np.ndarray) -> bytes:
    """A rising list of integers as bytes: count, low bits, the low parts packed, the high parts in unary."""
    n = len(ends)
    if not n:
        return b"\0" * 9
    low = max(0, (int(ends[-1]) // n).bit_length() - 1)
    lows = np.packbits((ends[:, None] >> np.arange(low)) & 1, axis=None, bitorder="little").tobytes() if low else b""
    high = (ends >> low) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1, np.uint8)
    bits[high] = 1
    return n.to_bytes(8, "big") + bytes([low]) + lows + np.packbits(bits, bitorder="little").tobytes()


def select(packed: bytes, k: int) -> int:
    """The k-th number of an Elias-Fano list, from 0."""
    n, low = int.from_bytes(packed[:8], "big"), packed[8]
    if not 0 <= k < n:
        raise IndexError(k)
    size = (n * low + 7) // 8
    ones = np.bitwise_count(np.frombuffer(packed, np.uint8, offset=9 + size)).cumsum()
    byte = int(np.searchsorted(ones, k + 1))
    rest, bits = k - (int(ones[byte - 1]) if byte else 0), packed[9 + size + byte]
    for _ in range(rest):
        bits &= bits - 1
    high = 8 * byte + (bits & -bits).bit_length() - 1 - k
    first = k * low
    window = int.from_bytes(packed[9 + first // 8 : 9 + (first + low + 7) // 8], "little") if low else 0
    return high << low | (window >> first % 8) & ((1 << low) - 1)


def line_ends(text: str) -> np.ndarray:
    """Code points before the end of each line; a last line may lack its line feed."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if not text.isascii() else np.frombuffer(text.encode(), np.uint8)
    ends = np.flatnonzero(points == 10) + 1
    return ends if not len(points) or points[-1] == 10 else np.append(ends, len(points))


def boundary_list(texts: pa.Array) -> pa.Array:
    return pa.array([elias_fano(line_ends(t.as_py() or "")) for t in texts], pa.binary())


def select_cuts(lists: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Code points before the ends of ``first`` and ``second`` lines; 0 lines end at 0."""
    out = [[], []]
    for packed, a, b in zip(lists, first.to_pylist(), second.to_pylist(), strict=True):
        held = packed.as_py()
        for kept, k in zip(out, (a, b), strict=True):
            kept.append(select(held, k - 1) if k else 0)
    return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in out], ["first", "second"])


def seeds(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:doc_id`` as unsigned integers; a null id has no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def hot_texts(df: DataFrame, text: Column, shares: int = SHARES) -> DataFrame:
    """(hash, n) of the texts that have more than one row in ``shares``, with the shares of about COPIES rows they get; at most ``shares`` rows."""
    least = max(COPIES, df.count() // shares)
    counts = df.groupBy(F.xxhash64(text).alias("hash")).count().filter(F.col("count") > least)
    return counts.select("hash", F.ceil(F.col("count") / COPIES).alias("n"))


def text_index(rows: DataFrame) -> DataFrame:
    """(digest, share, text): each distinct text of ``rows`` (digest, share, text) once.

    The set of a digest's texts compares contents; more than one text under a digest is an error.
    """
    held = rows.groupBy("digest", "share").agg(F.collect_set("text").alias("texts"))
    one = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("two texts have one digest")))
    return held.select("digest", "share", one.alias("text"))


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row for each input row: ``keep``, doc_id, text, n, form, prefix_chars, middle_chars, output.

    n are the text's lines, form is plain, psm or spm. A null text is empty and so plain, as is
    one that holds a mark, and the share of documents that ``rate`` (percent) leaves out;
    prefix_chars and middle_chars are null there. ``spm_rate`` is the percentage of spm among
    the rest. Each document has its own cuts, drawn from its id; rows with one id and text are
    alike, and null ids draw as one id. An empty table gives no rows; columns not named are dropped.
    """
    side = [F.col(doc_id).alias("doc_id"), *[F.col(c) for c in keep if c != doc_id]]
    body = F.coalesce(F.col(text), F.lit(""))
    hot = hot_texts(df, body)
    carried = df.select(F.struct(*side).alias("own"), body.alias("text")).withColumn("hash", F.xxhash64("text"))
    dealt = carried.join(F.broadcast(hot), "hash", "left")  # at most SHARES rows of two numbers
    share = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col("own")), F.col("n")).cast("int"))
    dealt = dealt.select("own", "text", F.sha2("text", 256).alias("digest"), share.alias("share"))
    index = text_index(dealt.select("digest", "share", "text"))
    # a share's documents: COPIES of a hot text, and of any other one row in SHARES at most
    owners = dealt.groupBy("digest", "share").agg(F.collect_list("own").alias("owners"))
    # a Python function forgets how its rows are dealt, so the lists are made behind the join
    bounded = index.join(owners, ["digest", "share"]).withColumn("bounds", F.arrow_udf(boundary_list, "binary")("text"))
    joined = bounded.select("text", "bounds", F.explode("owners").alias("own"))

    count = F.expr("cast(conv(hex(substring(bounds, 1, 8)), 16, 10) as bigint)")
    h1, h2, h3, h4 = seeds(F.col("own.doc_id"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= rate)
    rows = joined.withColumns({"n": count, "form": F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")})
    rows = rows.withColumns({"a": h1 % (F.col("n") + 1), "b": h2 % (F.col("n") + 1)})
    rows = rows.withColumn("cuts", F.arrow_udf(select_cuts, "struct<first:int,second:int>")("bounds", F.least("a", "b"), F.greatest("a", "b")))
    first, second = F.col("cuts.first"), F.col("cuts.second")
    prefix, middle = F.substr("text", F.lit(1), first), F.substr("text", first + 1, second - first)
    suffix = F.substr("text", second + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    whole = F.col("form") == "plain"
    output = F.when(whole, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("own.*", "text", "n", "form", F.when(~whole, first.cast("bigint")).alias("prefix_chars"), F.when(~whole, (second - first).cast("bigint")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""

    def between(left: str, right: str | None) -> Column:
        begin = F.instr(output, left) + F.lit(len(left))
        return F.substr(output, begin) if right is None else F.substr(output, begin, F.instr(output, right) - begin)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = F.sha2(restore(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored.alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines
  FROM documents
), h AS (
  SELECT doc_id, text, lines, len(lines) AS n,
    CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(lines[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(lines[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(lines[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM h
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
