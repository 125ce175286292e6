"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

1. A fingerprint for each text, in Arrow batches.
2. One row for each distinct fingerprint, by a partial aggregate, so that a group of equal
   texts costs its fingerprint once however large it is.
3. Each fingerprint goes to C(6, 3) = 20 blocks. Six parts cover the 64 bits; two
   fingerprints that differ in 3 bits or fewer agree on 3 parts at least, so they share a
   block. A block key has 31 to 33 bits, so that unrelated fingerprints meet rarely.
4. Blocks with one member end. A block with more than ``CHUNK`` members is dealt by hash
   into chunks and each pair of chunks becomes a task's row, so no row holds more than about
   two chunks. Within a row Hamming distances are verified and links are reduced to a
   spanning forest: near copies in any number give as many links as members, not pairs.
5. Components over the links, by :func:`kinmesh.operators.components.connected_components`.

Signed 64-bit integers hold the fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.operators.components import connected_components
from kinmesh.session import materialize, own_name, read_table

#: (first bit, width) of the six parts.
PARTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
MAX_DISTANCE = 3
CHUNK = 1024
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of one text as a signed 64-bit integer.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``width``
    words joined by a space and count as often as they occur. A text with fewer words is one
    shingle; without any it has fingerprint 0. A bit is 1 if over half the hashes have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[k:] for k in range(width)])) if len(words) >= width else (b" ".join(words),)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, width) for t in texts.to_pylist()], pa.int64())

    return run(text)


def block_keys(fp: Column) -> Column:
    """The 20 block keys: which three parts, and their bits."""
    keys = []
    for which, chosen in enumerate(combinations(PARTS, MAX_DISTANCE)):
        mask = sum(((1 << width) - 1) << first for first, width in chosen)
        keys.append(F.struct(F.lit(which).cast("tinyint").alias("part"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def forest(values: np.ndarray, limit: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of values that differ in ``limit`` bits or fewer.

    Breadth first: each reached value is compared with all not yet reached, in one array
    operation, and those near it are reached by it. A value is compared once as a source.
    """
    rest = np.unique(values)
    links: list[tuple[int, int]] = []
    queue: list[np.uint64] = []
    while len(rest) or queue:
        if not queue:
            if len(rest) < 2:
                break
            queue.append(rest[0])
            rest = rest[1:]
        source = queue.pop()
        near = np.bitwise_count(rest ^ source) <= limit
        if near.any():
            found = rest[near]
            rest = rest[~near]
            links += [(int(source), int(x)) for x in found]
            queue += list(found)
    return links


def fingerprint_links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints within 3 bits."""
    blocks = prints.select("fp", F.explode(block_keys(F.col("fp"))).alias("key")).select("key.part", "key.bits", "fp")
    sizes = blocks.groupBy("part", "bits").count().filter(F.col("count") > 1)
    dealt = blocks.join(sizes, ["part", "bits"]).withColumn("chunks", F.ceil(F.col("count") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = dealt.groupBy("part", "bits", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")).agg(F.collect_list("fp").alias("fps"))

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def linked(lists: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        out, at = [], 0
        for end in ends:
            found = forest(flat[at:end].astype(np.int64).view(np.uint64))
            out.append([{"a": int(np.uint64(a).view(np.int64)), "b": int(np.uint64(b).view(np.int64))} for a, b in found])
            at = end
        return pa.array(out, kind)

    return rows.filter(F.size("fps") > 1).select(F.explode(linked(F.col("fps"))).alias("l")).select("l.a", "l.b")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: doc_id, ``keep``, fp, group and component_id (smallest doc_id reachable).

    Fingerprints that differ in 3 bits or fewer are linked, and so are all documents of one
    fingerprint; ``group`` is the smallest fingerprint reachable. Null text is empty and has
    fingerprint 0; a null doc_id keeps its row and joins its component, whose id is the
    smallest id that is not null (null if there is none); repeated ids keep a row each; an
    empty table gives no rows. Columns not named are dropped.
    """
    prints = materialize(df.select(F.col(doc_id).alias("doc_id"), *keep, fingerprint_column(F.col(text), width).alias("fp")), "prints")
    own = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = connected_components(materialize(fingerprint_links(own), "links"))
    joined = own.join(found.select(F.col("node").alias("fp"), F.col("component").alias("group")), "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    groups = joined.groupBy("group").agg(F.min("first_id").alias("component_id"))
    ids = joined.join(groups, "group").select("fp", "group", "component_id")
    return prints.join(ids, "fp")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each group the row of the smallest doc_id stays.

    Null ids come last; rows that share the id are ordered by the digest of their text, and of
    rows equal in both any one stays. All columns are kept.
    """
    key = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    name = own_name(df, "row_key")
    keyed = df.withColumn(name, key)
    marked = near_duplicates(keyed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(name).alias("row_key")), keep=("row_key",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))["row_key"]
    chosen = marked.groupBy("group").agg(first.alias(name)).select(name)
    return keyed.join(chosen, name, "left_semi").dropDuplicates([name]).select(df.columns)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
