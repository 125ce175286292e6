"""Language-model scores from a log-frequency Bloom filter.

1. Texts are read in blocks. A block sends each distinct token and bigram of its texts once,
   with its count in the training texts among them (0 if there is none), to the shard of its
   hash. The number of shards grows with the tokens of all texts, so a shard's size does not.
   A token is its 64-bit hash. A bigram is a fingerprint of ``SPARE`` bits more than the
   training tokens have, up to 64: a bigram that was never seen meets a seen one once in a
   million, and sorted fingerprints pack into few bytes.
2. A shard adds up the counts of all blocks. It quantises a bigram's count c to a level
   q = 1 + floor(log2(c)) and enters the bigram in its filter once for each level 1..q. Every
   bigram that occurs in the training texts is entered, at any size of input.
3. The filter answers the blocks: for each bigram it is asked for level 1, 2, ... until one is
   missing; the last found level gives the count back within a factor of 2. False positives
   only lift a level, each with a probability of about 2^-19. Tokens get their exact counts.
4. The answers meet the block's texts under the block's number, and the texts are scored.
   P(w | v) = L * c(v, w) / c(v) + (1 - L) * P(w) after a v that was seen, P(w) at the start
   of a text and after any other. P(w) = c(w) / (N + 1), with 1 / (N + 1) left for all that
   was never seen.
5. The base needs the exact count of every token, and takes it from the same answers.

The filter is not broadcast: it holds every bigram and so grows with the corpus. Its shards
lie with the workers and the probes go to them.

Tokens are A-Z lower-cased runs without ASCII white space, then one end of text, written as
a line feed, which no token can be.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.llm.sampling import held_out
from kinmesh.session import materialize, read_table

END = b"\n"
HASHES = 10
#: Bits of a filter for each level that is entered: 32 of them with 10 hashes give false positives of about 2^-19.
BITS_EACH = 32
LAMBDA = 0.8
#: Tokens of all texts for each shard, and shards at least.
PER_SHARD, LEAST_SHARDS = 2_000_000, 48
#: Bits of a bigram's fingerprint beyond those of the number of training tokens.
SPARE = 20
#: Tokens of a block.
BLOCK = 1_000_000
BODY, WORDS, BIGRAMS, TOTALS = range(4)


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def token_totals(df: DataFrame, train: Column, text: str) -> tuple[int, int]:
    """How many tokens, ends included, the training texts have, and all texts."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^ \t-\r]+")) + F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    return tuple(df.agg(F.coalesce(F.sum(F.when(train, words)), none), F.coalesce(F.sum(words), none)).first())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in groups of 7 bits, low ones first; the eighth bit says that more follow."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        part = (values[live] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[starts[live] + k] = part | ((size[live] > k + 1).astype(np.uint8) << np.uint8(7))
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8)
    last = part < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]).astype(np.int64) if len(part) else np.zeros(0, np.int64)
    if not len(part):
        return np.zeros(0, np.uint64)
    place = np.arange(len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
    return np.bitwise_or.reduceat((part & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class LogBloom:
    """Counts of integer keys, quantised to levels and held as memberships."""

    def __init__(self, bits: int, hashes: int = HASHES):
        self.bits, self.hashes = max(64, bits), hashes
        self.table = np.zeros(-(-self.bits // 8), np.uint8)
        self.top = 1

    def places(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and step of each key's places at a level."""
        first = mix(keys.astype(np.uint64) ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        return first, mix(first ^ np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)

    def place(self, first: np.ndarray, step: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = (first + np.uint64(k) * step) % np.uint64(self.bits)
        return (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)

    def add(self, keys: np.ndarray, levels: np.ndarray) -> None:
        for level in range(1, int(levels.max(initial=0)) + 1):
            first, step = self.places(keys[levels >= level], level)
            for k in range(self.hashes):
                byte, bit = self.place(first, step, k)
                np.bitwise_or.at(self.table, byte, np.left_shift(np.uint8(1), bit))
        self.top = max(self.top, int(levels.max(initial=0)))

    def having(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Positions of the keys entered at a level; each hash is asked only where those before it hit."""
        first, step = self.places(keys, level)
        rest = np.arange(len(keys))
        for k in range(self.hashes):
            if not len(rest):
                break
            byte, bit = self.place(first[rest], step[rest], k)
            rest = rest[(self.table[byte] >> bit & 1).astype(bool)]
        return rest

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level found for each key, probing upward until one is missing."""
        found = np.zeros(len(keys), np.int16)
        live = np.arange(len(keys))
        for level in range(1, self.top + 1):
            live = live[self.having(keys[live], level)]
            if not len(live):
                break
            found[live] = level
        return found


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)); 0 for 0."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int16)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle, in logarithms, of the whole counts of a level (1, 2 to 3, 4 to 7, ...); 0 for level 0."""
    low = 2.0 ** (np.asarray(level, float) - 1)
    return np.where(level > 0, np.sqrt(low * np.maximum(2 * low - 1, low)), 0.0)


class Dealing:
    """How tokens and bigrams are hashed and dealt; it follows from the number of training tokens and of all."""

    def __init__(self, total: int, every: int):
        self.shards = max(LEAST_SHARDS, -(-every // PER_SHARD))
        self.bits = min(64, total.bit_length() + SPARE)

    def bigrams(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(mix(first ^ np.uint64(0x9E3779B97F4A7C15)) + second) >> np.uint64(64 - self.bits)

    def shard(self, keys: np.ndarray, bits: int) -> np.ndarray:
        """Shards are ranges of keys, so that sorted keys lie shard by shard."""
        top = keys >> np.uint64(max(0, bits - 32))
        return ((top * np.uint64(self.shards)) >> np.uint64(min(bits, 32))).astype(np.int64)


class Block:
    """Some texts as numbers: their distinct tokens by hash, and for each place in the texts its token."""

    def __init__(self, words: list[bytes], u: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes, self.sizes, self.u = hashes[order], sizes, place[u]
        self.end = int(place[words.index(END)])
        self.train = np.repeat(train, sizes)

    def body(self) -> bytes:
        """Sizes and tokens, frequent tokens by small numbers."""
        often = np.argsort(-np.bincount(self.u, minlength=len(self.hashes)), kind="stable")
        small = np.empty(len(often), np.int64)
        small[often] = np.arange(len(often))
        return pickle.dumps((pack(self.sizes), pack(small[self.u]), pack(often), self.end), 5)


def pairs_of(u: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that have a token after them in their text, and there both tokens in one integer."""
    at = np.flatnonzero(u[:-1] != end)
    return at, (u[at] << 32) | u[at + 1]


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.Array]]:
    """Blocks of about BLOCK tokens from batches (doc, train, text), each with its docs."""
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    ids, sizes, train, docs, size = [], [], [], [], 0

    def block() -> tuple[Block, pa.Array]:
        return Block(list(index), np.concatenate(ids), np.array(sizes, np.int64), np.array(train, bool)), pa.concat_arrays(docs)

    for batch in batches:
        begin = 0
        for k, (own, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
            words = tokens_of(text.as_py())
            ids.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
            train.append(bool(own))
            size += len(words)
            if size > BLOCK:
                docs.append(batch.column(0).slice(begin, k + 1 - begin))
                yield block()
                ids, sizes, train, docs, size, begin = [], [], [], [], 0, k + 1
                index.clear()
        if begin < batch.num_rows:
            docs.append(batch.column(0).slice(begin))
    if ids:
        yield block()


def runs_of(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, start, end) of the runs of equal sorted shards."""
    edges = np.flatnonzero(np.diff(shards, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(shards[a]), int(a), int(b)


def rows_of(rows: list[tuple], names: tuple[str, ...], docs: pa.Array | None, kind: pa.DataType) -> pa.RecordBatch:
    """A batch of (shard, block, kind, size, data, n) rows; ``docs`` belong to the first one."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
    held = pa.nulls(len(rows), kind)
    if docs is not None:
        held = pa.concat_arrays([docs.cast(kind), pa.nulls(len(rows) - 1, kind)])
    return pa.RecordBatch.from_arrays([*columns, held], names=names)


def ask_shards(texts: DataFrame, dealing: Dealing, row: T.StructType) -> DataFrame:
    """What each block asks of each shard, and the block's body with its docs, dealt by the block's number."""
    names = tuple(row.names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, (block, docs) in enumerate(blocks_of(batches)):
            me = first + number
            held = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            kind = held.type
            yield rows_of([(me % dealing.shards, me, BODY, None, block.body(), None)], names, held, kind)
            n = np.bincount(block.u[block.train], minlength=len(block.hashes))
            shards = dealing.shard(block.hashes, 64)
            yield rows_of([(s, me, WORDS, None, pack_sorted(block.hashes[a:b]), pack(n[a:b])) for s, a, b in runs_of(shards)], names, None, kind)
            at, pairs = pairs_of(block.u, block.end)
            if len(pairs):
                found, back = np.unique(pairs, return_inverse=True)
                n = np.bincount(back[block.train[at]], minlength=len(found))
                keys = dealing.bigrams(block.hashes[found >> 32], block.hashes[found & 0xFFFFFFFF])
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                yield rows_of([(s, me, BIGRAMS, None, pack_sorted(keys[a:b]), pack(n[a:b])) for s, a, b in runs_of(dealing.shard(keys, dealing.bits))], names, None, kind)

    return texts.mapInArrow(ask, row)


class Shard:
    """What the blocks ask of one shard. It is held packed until all are there."""

    def __init__(self):
        self.asked: dict[int, list[tuple[int, bytes, bytes]]] = {WORDS: [], BIGRAMS: []}

    def summed(self, kind: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each asking block the places of its keys, the distinct keys, and their sums."""
        parts = [unpack_sorted(keys) for _, keys, _ in self.asked[kind]]
        keys, back = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(back, np.concatenate([unpack(n) for *_, n in self.asked[kind]]), minlength=len(keys)).astype(np.int64)
        return np.split(back, np.cumsum([len(p) for p in parts])[:-1]), keys, n

    def answers(self, shard: int) -> Iterator[tuple]:
        if self.asked[WORDS]:
            places, _, n = self.summed(WORDS)
            for (block, keys, _), at in zip(self.asked[WORDS], places, strict=True):
                yield shard, block, WORDS, None, keys, pack(n[at])
            yield shard, -1, TOTALS, int((n > 0).sum()), None, None
        if self.asked[BIGRAMS]:
            places, keys, n = self.summed(BIGRAMS)
            levels = level_of(n)
            bloom = LogBloom(BITS_EACH * int(levels.sum()))
            bloom.add(keys[n > 0], levels[n > 0])
            found = bloom.levels(keys).astype(np.uint8)
            for (block, *_), at in zip(self.asked[BIGRAMS], places, strict=True):
                yield shard, block, BIGRAMS, None, found[at].tobytes(), None


def answer_blocks(asked: DataFrame, row: T.StructType) -> DataFrame:
    """The answers of all shards; bodies go through."""
    names = tuple(row.names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, kind = None, Shard(), None

        def settled() -> Iterator[pa.RecordBatch]:
            rows = []
            for r in shard.answers(now):
                rows.append(r)
                if len(rows) >= 64:
                    yield rows_of(rows, names, None, kind)
                    rows = []
            if rows:
                yield rows_of(rows, names, None, kind)

        for batch in batches:
            kind = batch.schema.field("docs").type
            kinds = batch.column("kind").to_pylist()
            for k, (s, what) in enumerate(zip(batch.column("shard").to_pylist(), kinds, strict=True)):
                if s != now:
                    if now is not None:
                        yield from settled()
                    now, shard = s, Shard()
                if what == BODY:
                    yield batch.slice(k, 1)
                else:
                    shard.asked[what].append((batch.column("block")[k].as_py(), batch.column("data")[k].as_py(), batch.column("n")[k].as_py()))
        if now is not None:
            yield from settled()

    return asked.repartition("shard").sortWithinPartitions("shard", "kind", "block").mapInArrow(answer, row)


def scored_block(dealing: Dealing, total: int, body: bytes, words: list[tuple[bytes, bytes]], levels: list[bytes]) -> list[np.ndarray]:
    """For each text of a block: tokens, known ones, the sum of log10(c + 1), and the model's log10 probability."""
    sizes, small, often, end = pickle.loads(body)
    sizes, u = unpack(sizes).astype(np.int64), unpack(often).astype(np.int64)[unpack(small).astype(np.int64)]
    hashes = np.concatenate([unpack_sorted(keys) for keys, _ in words])
    n = np.concatenate([unpack(c) for _, c in words]).astype(np.int64)
    single = np.maximum(n, 1) / (total + 1.0)
    p = single[u]
    at, pairs = pairs_of(u, end)
    if len(pairs):
        found, back = np.unique(pairs, return_inverse=True)
        keys = dealing.bigrams(hashes[found >> 32], hashes[found & 0xFFFFFFFF])
        level = np.empty(len(found), np.uint8)
        level[np.argsort(keys, kind="stable")] = np.frombuffer(b"".join(levels), np.uint8)
        joint, seen = count_of(level)[back], n[u[at]]
        after = at[seen > 0]
        share = np.minimum(joint[seen > 0] / seen[seen > 0], 1.0)
        p[after + 1] = (1 - LAMBDA) * p[after + 1] + LAMBDA * share
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    logs = np.log10(n + 1.0)
    return [sizes, np.add.reduceat((n > 0).astype(np.int64)[u], starts), np.add.reduceat(logs[u], starts), np.add.reduceat(np.log10(p), starts)]


def score_texts(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score for each row, with doc_id and ``keep``.

    The rows for which ``train`` holds are learned from, all are scored; null counts as false.
    A null text is empty: one end. Repeated rows keep a row each, null ids too. Without
    training rows N and V are 0. Other columns are dropped, whatever their names. A block is
    told by the task that read it and its place there, which a second run does not change.
    """
    train = F.coalesce(train, F.lit(False))
    total, every = token_totals(df, train, text)
    dealing = Dealing(total, every)
    texts = df.select(F.struct(F.col(doc_id).alias("doc_id"), *map(F.col, keep)).alias("doc"), train.alias("train"), F.col(text).alias("text"))
    doc = texts.schema["doc"].dataType
    row = T.StructType().add("shard", "long").add("block", "long").add("kind", "integer").add("size", "long").add("data", "binary").add("n", "binary").add("docs", T.ArrayType(doc))
    done = T.StructType().add("doc", doc).add("n_tokens", "long").add("n_known", "long").add("logs", "double").add("score", "double").add("distinct", "long")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, body, words, levels, distinct, kind = None, None, None, [], [], 0, None

        def closed() -> pa.RecordBatch:
            out = scored_block(dealing, total, body, words, levels)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3]), pa.nulls(len(docs), pa.int64())]
            return pa.RecordBatch.from_arrays([docs, *columns], names=done.names)

        for batch in batches:
            kind = batch.schema.field("docs").type.value_type
            for k, (block, what) in enumerate(zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if what == TOTALS:
                    distinct += batch.column("size")[k].as_py()
                    continue
                if block != now:
                    if now is not None:
                        yield closed()
                    now, words, levels = block, [], []
                data = batch.column("data")[k].as_py()
                if what == BODY:
                    docs, body = batch.column("docs").slice(k, 1).flatten(), data
                elif what == WORDS:
                    words.append((data, batch.column("n")[k].as_py()))
                else:
                    levels.append(data)
        if now is not None:
            yield closed()
        if distinct:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], pa.array([distinct], pa.int64())], names=done.names)

    answered = answer_blocks(ask_shards(texts, dealing, row), row)
    scored = materialize(answered.repartition("block").sortWithinPartitions("block", "kind", "shard").mapInArrow(finish, done), "scores")
    distinct = scored.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return scored.filter(F.col("distinct").isNull()).select("doc.*", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
    return score_texts(docs, ~F.col("held_out"), keep=("held_out",))
