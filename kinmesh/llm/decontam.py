"""Benchmark decontamination by greedy string tiling.

1. Benchmark items give seeds: hashes of each run of ``MIN_TILE`` tokens.
2. One pass over the documents keeps the texts that hold a seed. The pass asks a Bloom filter
   of fixed size, filled from all seeds, so what is broadcast does not grow with the
   benchmark; a larger benchmark only lets more texts through to the next step.
3. The survivors' seeds join the benchmark's seeds and are counted by pair of text and item;
   pairs whose seeds cannot reach the threshold end here. Equal texts are joined once, under
   the digest of the text, and so are equal items; a seed that many texts hold is dealt into
   shares.
4. Each pair is tiled: the longest runs common to both that overlap nothing marked are
   marked first, again and again down to ``MIN_TILE`` tokens, with rolling hashes
   (Karp-Rabin) to find them and a comparison to confirm them. Tiles may lie in any order, so
   reordered passages are found. A pair counts if tiles cover ``MIN_COVERAGE`` of the item.

Tokens are lower-cased runs of letters, digits and underscores. A row of fewer than
``MIN_TILE`` tokens, in an item or a text, has its whole as its one seed: an item that short
is matched by texts that are as short and equal it, not by longer ones, where so few tokens
meet by chance. Null texts and texts without a token match nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm.bpe import Memo
from kinmesh.llm.skew import dealt_join
from kinmesh.session import materialize, own_name, read_table

MIN_TILE = 5
MIN_COVERAGE = 0.5
#: Bits of the filter and probes of a seed.
FILTER_BITS, PROBES = 1 << 24, 8
#: Digests of contaminated texts up to which they are broadcast (about 25 MB); beyond, both sides meet by a shuffle.
MOST_SENT = 200_000

find_tokens = re.compile(r"\w+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


def token_hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


class HashMemo(Memo):
    compute = staticmethod(token_hash)


class TokenHashes:
    """Hashes of a text's tokens, remembered for frequent tokens."""

    def __init__(self, size: int = 300_000):
        self.memo = HashMemo(size)

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = find_tokens(text.lower()) if text else ()
        return np.fromiter(map(self.memo.__getitem__, tokens), np.uint64, len(tokens))


def rolled(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` tokens, modulo 2^64."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        out = tokens[:n].copy()
        for k in range(1, size):
            out *= _BASE
            out += tokens[k : k + n]
        return out
    # h[i, 2m) = h[i, m) * B^m + h[i + m, m): halves are rolled once and put together
    half = size // 2
    left, right = rolled(tokens, half), rolled(tokens, size - half)
    return left[:n] * np.uint64(pow(int(_BASE), size - half, 1 << 64)) + right[half : half + n]


def probe(seeds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of the k-th probe of each seed."""
    mixed = seeds ^ (seeds >> np.uint64(29))
    at = (mixed + np.uint64(k) * ((seeds >> np.uint64(33)) | np.uint64(1))) & np.uint64(FILTER_BITS - 1)
    return (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)


def filter_of(seeds: np.ndarray) -> np.ndarray:
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for k in range(PROBES):
        byte, bit = probe(seeds, k)
        np.bitwise_or.at(table, byte, np.left_shift(np.uint8(1), bit))
    return table


def passing(table: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The seeds whose probes are all set; each probe asks only what passed those before."""
    for k in range(PROBES):
        if not len(seeds):
            break
        byte, bit = probe(seeds, k)
        seeds = seeds[(table[byte] >> bit & 1).astype(bool)]
    return seeds


class Side:
    """One side of a tiling: its tokens, which of them are free, and where runs may not cross."""

    def __init__(self, tokens: np.ndarray, places: np.ndarray):
        self.tokens, self.places, self.free = tokens, places, np.ones(len(tokens), bool)

    def starts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of free runs of ``size`` tokens that lie side by side, and their Karp-Rabin hashes."""
        n = len(self.tokens) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        used = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero((used[size:] == used[:n]) & (self.places[size - 1 :] - self.places[:n] == size - 1))
        return at, rolled(self.tokens, size)[at]


def meet(item: Side, text: Side, size: int) -> bool:
    """Whether free runs of ``size`` tokens are equal; hashes find, tokens confirm. Stops at the first."""
    i, h = item.starts(size)
    t, g = text.starts(size)
    for x in np.intersect1d(h, g):
        a = item.tokens[(at := i[h == x][0]) : at + size]
        if any(np.array_equal(a, text.tokens[at : at + size]) for at in t[g == x]):
            return True
    return False


def mark(item: Side, text: Side, size: int) -> list[tuple[int, int]]:
    """Mark equal free runs of ``size`` tokens, by place in the item, then in the text, and return their starts.

    A run that is no longer free never is again, so the places of a hash are read once.
    """
    i, h = item.starts(size)
    t, g = text.starts(size)
    near = np.isin(h, g)
    where: dict[int, list[int]] = {}
    for at in np.flatnonzero(np.isin(g, h[near]))[::-1]:
        where.setdefault(int(g[at]), []).append(int(t[at]))
    out = []
    for a, x in zip(i[near].tolist(), h[near].tolist(), strict=True):
        if not item.free[a : a + size].all():
            continue
        places, passed = where[x], []
        while places:
            b = places.pop()
            if not text.free[b : b + size].all():
                continue
            if np.array_equal(item.tokens[a : a + size], text.tokens[b : b + size]):
                item.free[a : a + size] = text.free[b : b + size] = False
                out.append((a, b))
                break
            passed.append(b)  # another run of the same hash
        places += passed[::-1]
    return out


def tile(text: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token rows: (place in item, place in text, length) of each tile.

    Each pass finds the greatest length at which free runs of both sides are equal, by
    Karp-Rabin hashes rolled at one length after the other (a run of a length holds one of each
    less, so lengths are searched by halving), and marks the runs of that length, by place in
    the item, then in the text, as long as they stay free. Passes go on below that length down
    to ``least``. Only the parts of the text that share a run of ``least`` with the item are read.
    """
    shared = np.isin(rolled(text, least), rolled(item, least))
    if not shared.any():
        return []
    kept = np.zeros(len(text) + 1, np.int64)
    np.add.at(kept, np.flatnonzero(shared), 1)
    np.add.at(kept, np.flatnonzero(shared) + least, -1)
    places = np.flatnonzero(np.cumsum(kept)[:-1] > 0)
    a, b = Side(item, np.arange(len(item))), Side(text[places], places)
    tiles, top = [], min(len(item), len(places))
    while a.free.any():
        low, high = least - 1, top
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if meet(a, b, middle) else (low, middle - 1)
        if low < least:
            break
        tiles += [(i, int(places[t]), low) for i, t in mark(a, b, low)]
        top = low - 1
    return tiles


def seeds_of(tokens: np.ndarray) -> np.ndarray:
    """Hashes of all runs of MIN_TILE tokens; of a shorter row the hash of the whole."""
    return rolled(tokens, min(MIN_TILE, max(1, len(tokens))))


def benchmark_seeds(items: DataFrame, text: str = "text") -> DataFrame:
    """(item_key, tokens, seeds, times): for each distinct text of the items its tokens, its distinct seeds and how often each occurs."""

    @F.arrow_udf("struct<tokens:array<bigint>,seeds:array<bigint>,times:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        hashes, out = TokenHashes(), []
        for t in texts.to_pylist():
            tokens = hashes(t)
            seeds, times = np.unique(seeds_of(tokens), return_counts=True)
            out.append({"tokens": tokens.view(np.int64), "seeds": seeds.view(np.int64), "times": times})
        longs = pa.list_(pa.int64())
        return pa.array(out, pa.struct([("tokens", longs), ("seeds", longs), ("times", longs)]))

    own = items.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    found = own.select(F.sha2("text", 256).alias("item_key"), run(F.col("text")).alias("s"))
    return materialize(found.select("item_key", "s.*").filter(F.size("seeds") > 0), "seeds")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """The filter of all seeds. Each task makes its part's bits; only arrays of the fixed size meet."""

    def bits(batches):
        table, any_seed = np.zeros(FILTER_BITS // 8, np.uint8), False
        for batch in batches:
            for s in batch.column(0).to_pylist():
                table |= filter_of(np.array(s or [], np.int64).view(np.uint64))
                any_seed = True
        if any_seed:
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(table[used].astype(np.int64))], names=["place", "bits"])

    rows = seeds.select("seeds").mapInArrow(bits, "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return table


def contaminated_texts(df: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(survivors with ``keep`` and text_key, verdicts by text_key and item_key).

    Verdicts hold coverage, n_tiles, longest_tile for each pair of texts that reaches
    MIN_COVERAGE. Every tile of n tokens begins n - MIN_TILE + 1 shared seeds of the item, so a
    pair whose shared seeds, with repeats, times MIN_TILE fall short of that share is not tiled.
    """
    bench = benchmark_seeds(items)
    sent = df.sparkSession.sparkContext.broadcast(seed_filter(bench))

    @F.arrow_udf("array<bigint>")
    def seeded(texts: pa.Array) -> pa.Array:
        hashes, table = TokenHashes(), sent.value
        return pa.array([np.unique(passing(table, seeds_of(hashes(t)))).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    own = F.struct(*keep).alias("keep") if keep else F.lit(None).alias("keep")
    narrow = df.select(own, F.col(text).alias("text")).withColumn("seeds", seeded(F.col("text"))).filter(F.size("seeds") > 0)
    held = materialize(narrow.withColumn("text_key", F.sha2("text", 256)).withColumn("keep", F.col("keep") if keep else F.lit(0)), "seeded")
    texts = held.select("text_key", "text", "seeds").dropDuplicates(["text_key"])
    seeds = bench.select("item_key", F.size("tokens").alias("size"), F.explode(F.arrays_zip("seeds", "times")).alias("z")).select("item_key", "size", "z.*")
    asked = texts.select("text_key", F.explode("seeds").alias("seeds"))
    met = dealt_join(asked, seeds, "seeds", F.col("text_key")).groupBy("text_key", "item_key", "size").agg(F.sum("times").alias("shared"))
    enough = met.filter(F.col("shared") * F.least("size", F.lit(MIN_TILE)) >= MIN_COVERAGE * F.col("size")).select("text_key", "item_key")
    pairs = enough.join(texts.select("text_key", "text"), "text_key").join(bench.select("item_key", "tokens"), "item_key")

    @F.arrow_udf("struct<covered:bigint,n_tiles:int,longest_tile:int>")
    def tiled(texts: pa.Array, tokens: pa.Array) -> pa.Array:
        hashes, out = TokenHashes(), []
        for t, item in zip(texts.to_pylist(), tokens.to_pylist(), strict=True):
            tiles = tile(hashes(t), np.array(item, np.int64).view(np.uint64), min(MIN_TILE, len(item)))
            out.append({"covered": sum(n for *_, n in tiles), "n_tiles": len(tiles), "longest_tile": max((n for *_, n in tiles), default=0)})
        return pa.array(out, pa.struct([("covered", pa.int64()), ("n_tiles", pa.int32()), ("longest_tile", pa.int32())]))

    judged = pairs.select("text_key", "item_key", F.size("tokens").alias("item_tokens"), tiled(F.col("text"), F.col("tokens")).alias("t"))
    verdicts = judged.select("text_key", "item_key", (F.col("t.covered") / F.col("item_tokens")).alias("coverage"), "t.n_tiles", "t.longest_tile").filter(F.col("coverage") >= MIN_COVERAGE)
    return held.select("keep.*", "text_key") if keep else held.select("text_key"), verdicts


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text covers no benchmark item; all columns, null texts included."""
    _, verdicts = contaminated_texts(df.select(text), items, text, keep=())
    bad = materialize(verdicts.select("text_key").distinct(), "leaks")
    name = own_name(df, "text_key")
    if bad.count() <= MOST_SENT:
        bad = F.broadcast(bad)
    return df.withColumn(name, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(bad.select(F.col("text_key").alias(name)), name, "left_anti").select(df.columns)


def contaminated_documents(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile): a row for each document with each item that it covers.

    Repeated rows keep a row each, null ids of documents and items too.
    """
    held, verdicts = contaminated_texts(df.select(F.col(doc_id).alias("doc_id"), text), items, text)
    ids = items.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.sha2(F.col(text), 256).alias("item_key"))
    return held.join(verdicts, "text_key").join(ids, "item_key").select("doc_id", "item_id", "coverage", "n_tiles", "longest_tile")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents only: a row for each with each item that it covers."""
    found = contaminated_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles", "longest_tile", F.lit(True).alias("contaminated"))
