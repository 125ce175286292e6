"""Best-fit packing by hierarchical residual packing.

1. Each document becomes a row of ids with an end mark, cut into pieces of ``capacity`` only
   where it is longer.
2. Each partition packs its own pieces best-fit, the longest first. Nothing is shuffled; the
   pieces are written once with the bin they went to.
3. Bins that are nearly full are done. What may still be joined goes up a tree of fan-in
   ``FAN``: a node takes the underfull bins of its children as items, packs them best-fit
   anew and passes on what is underfull still.
4. A joined bin is a link (bin, into, shift). Links are few, at most one for each partition and
   level; they are followed from the root down and joined to the pieces.

After a best-fit run at most one bin is filled to half or less, as two such would have been
joined. So a child brings at most one bin that can move, and a node loses no joint by passing
on, of each free size, only as many bins as can still come: ``(FAN - 1) * LEVELS``. What
reaches a node is bounded by the capacity, however many documents there are.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm.bpe import Deferred, Memo, byte_alphabet
from kinmesh.session import materialize, own_name, read_table

CAPACITY, END = 2048, 0
#: Children of a node, levels that the tree can have, and free tokens below which a bin is nearly full.
FAN, LEVELS, NEARLY = 16, 8, 16
#: Texts of a batch held as Python values at a time.
SLICE = 128


class Chunks(Memo):
    """The packed ids of what a text falls into.

    White space ends every match of the pattern and no normal form reaches across it, so the
    ids of a text are those of its parts, one after the other. Stretches of letters, marks and
    white space that no normal form changes are lower-cased and cut into the pattern's matches here,
    each merged by the library's model; other chunks between white space go to the library
    whole. Matches repeat far more often than chunks do, so the memo holds matches. Keys of
    chunks begin with a blank, as no match does.
    """

    def __init__(self, blob: bytes, size: int = 300_000):
        import re

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__(size)
        self.library = Tokenizer.from_buffer(blob)
        self.merged = self.library.model.tokenize
        self.table = {b: c for c, b in byte_alphabet().items()}
        # fixed pattern of the vocabulary, for the characters of ``plain``; letters and digits begin no other match and stand first
        letters = "a-zª-ªµ-µº-ºß-öø-ʯ"
        self.find = re.compile(rf"[{letters}]+|[0-9²³¹¼-¾]|'s|'t|'re|'ve|'m|'ll|'d|[^\s0-9²³¹¼-¾{letters}]+").findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # up to U+02AF nothing composes or is reordered, and so it is with these marks
        marks = "\x21-\x7e\xa1-ķĹ-ňŊ-ž‐-‧€"
        self.plain = re.compile(rf"[{marks}\s]*").fullmatch
        self.odd = re.compile(rf"(?<!\S)([{marks}]*+[^{marks}\s]\S*+)").split

    def compute(self, key: str) -> bytes:
        if key[0] == " ":
            ids = self.library.encode(key[1:], add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.merged(key if key.isascii() else "".join(map(self.table.__getitem__, key.encode())))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def keys_of(self, stretch: str) -> list[str]:
        """The matches of a stretch of plain characters; chunks that hold a special string stay whole."""
        if not any(s in stretch for s in self.special):
            return self.find(stretch.lower())
        return [key for chunk in stretch.split() for key in ([f" {chunk}"] if any(s in chunk for s in self.special) else self.find(chunk.lower()))]

    def text(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the library
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if self.plain(text):
            return b"".join(map(self.__getitem__, self.keys_of(text)))
        keys: list[str] = []
        for k, part in enumerate(self.odd(text)):  # stretches, and between each two an odd chunk
            keys += [f" {part}"] if k % 2 else self.keys_of(part)
        return b"".join(map(self.__getitem__, keys))


def piece_column(spark: SparkSession, vocabulary: str, text: Column, capacity: int = CAPACITY, end: int = END) -> Column:
    """Array of packed ids (little-endian unsigned 32-bit) of a text and its end mark, cut every ``capacity`` ids."""
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(Deferred(Chunks, f.read()))
    mark, step = struct.pack("<I", end), 4 * capacity

    @F.arrow_udf("array<binary>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chunks = sent.value
        for texts in batches:
            parts = []
            for at in range(0, len(texts), SLICE):
                rows = []
                for t in texts.slice(at, SLICE).to_pylist():
                    ids = chunks.text(t) + mark if t else mark
                    rows.append([ids[k : k + step] for k in range(0, len(ids), step)])
                parts.append(pa.array(rows, pa.list_(pa.binary())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.binary()))

    return cut(text)


def token_pieces(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: ``keep``, piece (from 0), start (ids before it), length and ids (packed).

    A document is the library's ids of its whole text, without special tokens, then ``end``.
    A null text is empty and has the end mark alone. Each row is a document, repeated ones
    too; other columns are dropped, so their names do not matter; an empty table has no pieces.
    """
    rows = df.select(*keep, F.posexplode(piece_column(df.sparkSession, vocabulary, F.col(text), capacity, end)).alias("piece", "ids"))
    return rows.select(*keep, "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.expr("octet_length(ids) div 4").alias("length"), "ids")


class BestFit:
    """Bins by free size; the smallest size that holds an item is read off a bit mask."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def put(self, name: int, free: int) -> None:
        if free:
            self.bins[free].append(name)
            self.mask |= 1 << free

    def take(self, length: int) -> tuple[int, int] | None:
        """(bin, free) of the fullest bin that holds ``length``, taken out; None if there is none."""
        fit = self.mask >> length
        if not fit:
            return None
        free = length + (fit & -fit).bit_length() - 1
        held = self.bins[free]
        name = held.pop()
        if not held:
            self.mask ^= 1 << free
        return name, free

    def underfull(self, nearly: int, most: int) -> list[tuple[int, int]]:
        """(bin, fill) of those with ``nearly`` or more free, at most ``most`` of a size."""
        return [(name, self.capacity - free) for free in range(max(1, nearly), self.capacity) for name in self.bins[free][:most]]


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, BestFit]:
    """(bin, offset) of each length, and the bins with space left; bins are numbered from 0."""
    fit = BestFit(capacity)
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        name, free = fit.take(length) or (n, capacity)
        n += name == n
        bins[k], offsets[k] = name, capacity - free
        fit.put(name, free - length)
    return bins, offsets, fit


def join_bins(names: list[int], fills: list[int], capacity: int) -> tuple[list[tuple[int, int, int]], BestFit]:
    """Underfull bins as items of a best-fit run: links (bin, into, shift) and the bins with space left.

    Bins over half full are there to receive; the others are placed in them, the fullest first.
    """
    fit, moving = BestFit(capacity), []
    for fill, name in sorted(zip(fills, names, strict=True), reverse=True):
        if 2 * fill > capacity:
            fit.put(name, capacity - fill)
        else:
            moving.append((fill, name))
    links = []
    for fill, name in moving:
        found = fit.take(fill)
        if found is None:
            fit.put(name, capacity - fill)
        else:
            links.append((name, found[0], capacity - found[1]))
            fit.put(found[0], found[1] - fill)
    return links, fit


def pack_locally(items: DataFrame, capacity: int, bin_: str, offset: str, fill: str) -> DataFrame:
    """``items`` with bin and offset, and one further row, with ``fill`` alone, for each bin that goes up the tree.

    A bin's number is its partition's, shifted, plus its place there. A task holds the rows
    of its partition, which should be thin.
    """
    schema = items.limit(0).withColumns({bin_: F.lit(0).cast("bigint"), offset: F.lit(0).cast("bigint"), fill: F.lit(0).cast("bigint")}).schema
    most = (FAN - 1) * LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        base = TaskContext.get().partitionId() << 32
        lengths = table["length"].to_numpy()
        if len(lengths) and (lengths.min() < 0 or lengths.max() > capacity):
            raise ValueError(f"an item is longer than {capacity}")
        bins, offsets, fit = best_fit_decreasing(lengths, capacity)
        out = table.append_column(bin_, pa.array(bins + base, pa.int64())).append_column(offset, pa.array(offsets, pa.int64())).append_column(fill, pa.nulls(len(lengths), pa.int64()))
        kind = pa.schema([f.with_nullable(True) for f in out.schema])
        yield from out.cast(kind).to_batches(10_000)
        up = fit.underfull(NEARLY, most)
        if up:
            columns = [pa.nulls(len(up), f.type) for f in table.schema]
            columns += [pa.array([base + name for name, _ in up], pa.int64()), pa.nulls(len(up), pa.int64()), pa.array([f for _, f in up], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    for field in schema.fields:
        field.nullable = True
    return items.mapInArrow(run, schema)


def merge_tree(opened: DataFrame, capacity: int) -> DataFrame | None:
    """(bin, into, shift) for each of the bins (node, bin, fill) that joins another; None if there is one node at most."""
    top = opened.agg(F.max("node")).first()[0]
    levels, most = [], (FAN - 1) * LEVELS

    def node(key: tuple[int, ...], rows: pd.DataFrame) -> pd.DataFrame:
        links, fit = join_bins(rows["bin"].tolist(), rows["fill"].tolist(), capacity)
        up = fit.underfull(NEARLY, most)
        out = [(key[0], name, None, into, shift) for name, into, shift in links] + [(key[0], name, fill, None, None) for name, fill in up]
        return pd.DataFrame(out, columns=["node", "bin", "fill", "into", "shift"]).astype({"bin": "Int64", "fill": "Int64", "into": "Int64", "shift": "Int64"})

    while top:
        parents = opened.withColumn("node", F.expr(f"node div {FAN}")).groupBy("node")
        level = materialize(parents.applyInPandas(node, "node bigint, bin bigint, fill bigint, into bigint, shift bigint"), "bins")
        levels.append(level.filter(F.col("into").isNotNull()).select("bin", "into", "shift"))
        opened, top = level.filter(F.col("into").isNull()).select("node", "bin", "fill"), top // FAN
    total = None
    for links in reversed(levels):  # a bin that took another in may have moved on a higher level
        if total is not None:
            above = total.select(F.col("bin").alias("into"), F.col("into").alias("last"), F.col("shift").alias("more"))
            links = links.join(above, "into", "left").select("bin", F.coalesce("last", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")).unionByName(total)
        total = links
    return total


def pack_best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a column length from 1 to ``capacity``) plus sequence_id and offset.

    The items of a sequence fill it from offset 0 without a gap. All rows are placed, repeated
    ones each for itself; other columns are carried and may hold nulls or any name but the
    two results, which are replaced; an empty table stays empty. Give thin rows: long values
    are better joined afterwards.
    """
    items = items.drop("sequence_id", "offset")
    name = own_name(items, "bin")
    offset, fill = own_name(items, "offset_in_bin"), own_name(items, "fill")
    packed = materialize(pack_locally(items, capacity, name, offset, fill), "packed")
    opened = packed.filter(F.col(fill).isNotNull()).select(F.shiftright(F.col(name), 32).alias("node"), F.col(name).alias("bin"), F.col(fill).alias("fill"))
    placed = packed.filter(F.col(fill).isNull()).drop(fill)
    links = merge_tree(opened, capacity)
    if links is None:
        return placed.withColumnsRenamed({name: "sequence_id", offset: "offset"})
    into, shift = own_name(placed, "into"), own_name(placed, "shift")
    moved = placed.join(links.select(F.col("bin").alias(name), F.col("into").alias(into), F.col("shift").alias(shift)), name, "left")
    return moved.select(*items.columns, F.coalesce(into, name).alias("sequence_id"), (F.col(offset) + F.coalesce(shift, F.lit(0))).alias("offset"))


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, n_pieces, ids) from rows of (sequence_id, offset, length, ids): the training rows themselves."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_pieces"), F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "").alias("ids")).withColumn("ids", F.unhex("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; the digest of a piece's ids goes with it instead of the ids."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    thin = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_best_fit(thin).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
