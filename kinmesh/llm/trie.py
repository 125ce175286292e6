"""Prefix trie of conversations: owners by binary search, subtrees by chains.

A node is a distinct sequence of first turns; its owner is the smallest conversation that
starts with it. Who owns a node owns all that follow on its own path, so a conversation owns
the depths from a first one on: its chain.

1. Each turn gets a digest keyed by its place; a prefix's digest is the sum of those of its
   turns in four lanes of 40 bits. Sums need no order within a task, so long conversations are
   dealt into blocks of ``BLOCK`` turns and one may hold any share of the rows.
2. One aggregate over all prefixes gives the minima: the owner and the members of each.
3. Equal conversations are one. Each finds its first owned depth by binary search: a round
   joins the asked depth's digest with the minima. The last owner met above is its parent.
4. Chains hang on chains. Their totals are summed bottom-up in rounds that double the distance,
   and running sums along each chain give every node its subtree.

Digests of many members, and chains with many children, are hot keys. Those above one row in
``HOT`` are at most ``HOT`` many and are looked up by a broadcast; all others by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmesh.session import discard, materialize, read_table

#: Turns or ids of a block, bits of a lane, and the share of rows above which a key is hot.
BLOCK, LANE, HOT = 4096, 40, 10_000
LANES = ("l0", "l1", "l2", "l3")
EMPTY = hashlib.sha256(b"").hexdigest()


def running_sums(df: DataFrame, key: str, order: str, columns: tuple[str, ...], down: bool = False, modulus: int | None = None) -> DataFrame:
    """``df`` with each of ``columns`` summed over the rows of its key up to and with this one.

    ``order`` is a place from 0 on, unique in its key; ``down`` sums from the last place. The
    sums of whole blocks are added up first, so no task gets a key whole.
    """
    part = df.withColumn("block", F.expr(f"{order} div {BLOCK}"))
    sums = part.groupBy(key, "block").agg(*[F.sum(c).alias(c) for c in columns])
    kept = (lambda c: F.pmod(c, F.lit(modulus))) if modulus else (lambda c: c)
    before = Window.partitionBy(key).orderBy(F.desc("block") if down else F.asc("block")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(key, "block", *[F.sum(kept(F.col(c))).over(before).alias(f"{c}_base") for c in columns]).filter(F.col(f"{columns[0]}_base").isNotNull())
    within = Window.partitionBy(key, "block").orderBy(F.desc(order) if down else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = part.join(bases, [key, "block"], "left")
    total = {c: kept(F.sum(c).over(within) + F.coalesce(f"{c}_base", F.lit(0))) for c in columns}
    return joined.withColumns(total).drop("block", *[f"{c}_base" for c in columns])


def looked_up(asks: DataFrame, table: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """``asks`` with the columns of ``table``, whose keys are unique; null where there are none.

    Rows of ``table`` for which ``hot`` holds, which the caller bounds, are broadcast; the others shuffled.
    """
    first = asks.join(F.broadcast(table.filter(hot).withColumn("is_hot", F.lit(True))), keys, "left")
    cold = first.filter(F.col("is_hot").isNull()).select(asks.columns).join(table.filter(~hot), keys, "left")
    return first.filter("is_hot").drop("is_hot").unionByName(cold)


def numbered(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, key, words): the turns of each conversation in order, from 1, with a digest of role and text.

    Order is by turn, nulls first, then role and text; null role and text are empty. Rows
    without a conversation id belong to no conversation. Other columns are dropped.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = messages.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).cast("bigint"))
    sizes = rows.groupBy("conv_id", "part").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("conv_id", "part", F.sum("count").over(before).alias("base")).filter("base is not null")
    within = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "text")
    pos = (F.row_number().over(within) + F.coalesce("base", F.lit(0))).cast("bigint")
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return rows.join(bases, ["conv_id", "part"], "left").select("conv_id", pos.alias("pos"), key.alias("key"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each conversation c took its first turns from another.

    The first h = crc32(c) % ``heads`` turns are those of conversation c - c % ``group``, all
    if it has fewer and none if it is absent; c's own turns after its first h follow.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, "base": F.col("conv_id") - F.col("conv_id") % group})
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = materialize(convs.join(lengths, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv_id", "base", "n", "h", "k"), "convs")
    # a conversation stands once for each block of its turns
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"n div {BLOCK}"))))
    own = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).join(blocks.select("conv_id", "block", "h", "k"), ["conv_id", "block"]).filter(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "key", "words")
    first = turns.filter(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    taken = convs.filter("k > 0").select("conv_id", "base", "k").join(first, "base").filter(F.col("pos") <= F.col("k")).select("conv_id", "pos", "key", "words")
    return convs.select("conv_id"), own.unionByName(taken)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, words) of every prefix, the empty one too; words are those of its last turn."""
    mixed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("key")), 256)
    lanes = [F.conv(F.substring("mixed", 1 + 10 * k, 10), 16, 10).cast("bigint").alias(c) for k, c in enumerate(LANES)]
    rows = turns.withColumn("mixed", mixed).select("conv_id", "pos", "words", *lanes)
    sums = running_sums(rows, "conv_id", "pos", LANES, modulus=1 << LANE)
    digest = F.unhex(F.concat(*[F.lpad(F.hex(c), LANE // 4, "0") for c in LANES]))
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.unhex(F.lit("0" * LANE)).alias("digest"), F.lit(0).cast("bigint").alias("words"))
    return sums.select("conv_id", F.col("pos").alias("depth"), digest.alias("digest"), "words").unionByName(root)


def owned_chains(prefix: DataFrame, minima: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, f, m, parent) of each conversation that owns a node: its depths f to m, and the owner above f.

    A round asks, for each conversation that is not settled, for the owner at the middle of
    the depths left. What is asked lies between ``lo`` and ``hi``; the owner that stood
    above at the last refusal is that of depth f - 1.
    """
    rows = prefix.count()
    hot = F.col("members") * HOT > rows  # all members together are ``rows``, so fewer than HOT digests are hot
    table = minima.select("digest", "depth", F.col("conv_id").alias("owner"), F.col("n_convs").alias("members"))
    state = ends.groupBy("digest", "depth").agg(F.min("conv_id").alias("conv_id")).select("conv_id", F.col("depth").alias("m"), F.lit(0).cast("bigint").alias("lo"), (F.col("depth") + 1).alias("hi"), F.lit(None).cast("bigint").alias("parent"))
    state, settled = materialize(state, "state"), None
    while not state.isEmpty():
        asks = materialize(state.withColumn("depth", F.expr("(lo + hi) div 2")).join(prefix.select("conv_id", "depth", "digest"), ["conv_id", "depth"]), "asks")
        found = looked_up(asks, table, ["digest", "depth"], hot)
        owned = F.col("owner") == F.col("conv_id")
        step = materialize(
            found.select("conv_id", "m", F.when(owned, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(owned, F.col("parent")).otherwise(F.col("owner")).alias("parent")),
            "state",
        )
        discard(asks)
        done = step.filter("lo = hi and lo <= m").select("conv_id", F.col("lo").alias("f"), "m", "parent")
        settled = done if settled is None else settled.unionByName(done)
        state = step.filter("lo < hi")
    return state.limit(0).select("conv_id", F.col("lo").alias("f"), "m", "parent") if settled is None else settled


def subtree_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) of ``chains`` (conv_id, parent, leaves, saved), those of all chains below added.

    After k rounds a chain holds the sums of what lies less than 2^k below and the chain 2^k above.
    """
    n = chains.count()
    state = chains
    while not state.filter("parent is not null").isEmpty():
        sums = materialize(state.filter("parent is not null").groupBy("parent").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("members")), "sums")
        above = sums.select("parent", "members").join(state.select(F.col("conv_id").alias("parent"), F.col("parent").alias("next")), "parent")
        below = state.filter("parent is not null").select("conv_id", "parent")
        moved = looked_up(below, above, ["parent"], F.col("members") * HOT > n).select("conv_id", F.col("next").alias("parent"))
        added = state.drop("parent").join(sums.drop("members").withColumnRenamed("parent", "conv_id"), "conv_id", "left").join(moved, "conv_id", "left")
        plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        state = materialize(added.select("conv_id", "parent", plus("leaves"), plus("saved")), "totals")
        discard(sums)
    return state.select("conv_id", "leaves", "saved")


def id_digests(ends: DataFrame) -> DataFrame:
    """(digest, depth, ends_sha256): SHA-256 of the ids that end at a node, ascending and joined by commas.

    Ids are first joined in blocks by value, spread over all tasks; a node's blocks are then
    read in order and hashed as they come, so no task holds them together.
    """
    blocks = ends.groupBy("digest", "depth", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, schema = None, None, pa.schema([("digest", pa.binary()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, schema, strict=True)], schema=schema)

        for batch in batches:
            done = [[], [], []]
            for key in zip(*(batch.column(c).to_pylist() for c in ("digest", "depth", "ids")), strict=True):
                if key[:2] == at:
                    state.update(b"," + key[2].encode())
                    continue
                if at is not None:
                    for out, value in zip(done, (*at, state.hexdigest()), strict=True):
                        out.append(value)
                at, state = key[:2], hashlib.sha256(key[2].encode())
            yield row()
        if at is not None:
            done = [[at[0]], [at[1]], [state.hexdigest()]]
            yield row()

    return blocks.repartition("digest", "depth").sortWithinPartitions("digest", "depth", "block").select("digest", "depth", "ids").mapInArrow(run, "digest binary, depth bigint, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, each once) and their ``turns`` (conv_id, pos from 1, key, words).

    conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. A turn's ``key`` stands for its role and text, ``words`` for its tokens. A
    conversation without turns is a member of the root, which stands as soon as there is a
    conversation; without any there are no rows. Equal turns are told apart by their place.
    Prefixes count as equal if 160 bits of digest agree.
    """
    prefix = materialize(prefixes(convs, turns), "prefix")
    minima = materialize(prefix.groupBy("digest", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "minima")
    ends = materialize(prefix.groupBy("conv_id").agg(F.max(F.struct("depth", "digest")).alias("last")).select("conv_id", "last.*"), "ends")
    chains = materialize(owned_chains(prefix, minima, ends), "chains")

    saved = (F.col("n_convs") - 1) * F.col("words")
    hung = chains.filter("f > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("f") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    tips = chains.select("conv_id", F.col("m").alias("depth")).join(hung, ["conv_id", "depth"], "left").select("conv_id", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"))
    local = tips.join(minima.groupBy("conv_id").agg(F.sum(saved).alias("saved")), "conv_id")
    totals = subtree_totals(materialize(chains.select("conv_id", "parent").join(local, "conv_id"), "local"))

    number = lambda name: F.lit(None).cast("bigint").alias(name)
    below = chains.filter("f > 0").join(totals, "conv_id").select(F.col("parent").alias("conv_id"), (F.col("f") - 1).alias("depth"), F.lit(1).cast("bigint").alias("hung"), "leaves", "saved", number("above"), number("is_first"), number("is_last"))
    first = chains.select("conv_id", F.col("f").alias("depth"), number("hung"), number("leaves"), number("saved"), F.col("parent").alias("above"), F.lit(1).cast("bigint").alias("is_first"), number("is_last"))
    last = chains.select("conv_id", F.col("m").alias("depth"), number("hung"), number("leaves"), number("saved"), number("above"), number("is_first"), F.lit(1).cast("bigint").alias("is_last"))
    marks = below.unionByName(first).unionByName(last).groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("hung", "leaves", "saved")], *[F.max(c).alias(c) for c in ("above", "is_first", "is_last")])

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    nodes = minima.join(marks, ["conv_id", "depth"], "left").withColumn("n_children", zero("hung") + 1 - zero("is_last"))
    nodes = nodes.select("conv_id", "depth", "digest", "n_convs", "n_children", F.when(zero("is_first") == 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), (zero("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"), (zero("saved") + saved).alias("saved_tokens"))
    summed = running_sums(nodes, "conv_id", "depth", ("n_leaves", "saved_tokens"), down=True)
    named = summed.join(id_digests(ends), ["digest", "depth"], "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations after each took its first turns from another, as :func:`rebuilt` says."""
    turns = materialize(numbered(read_table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(*rebuilt(turns))


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
      lambda s, x: list_reduce(list_prepend(xor(s, x), [CAST(0 AS BIGINT) FOR _ IN range(8)]),
        lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END)), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), mixed AS (
  SELECT c.conv_id, 0 AS side, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS depth, sha256(length(role) || ':' || role || text) AS k,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM mixed
), p AS (
  SELECT conv_id, depth, sha256(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS d, words FROM placed
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), n AS (
  SELECT d, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY d, depth
), e AS (
  SELECT d, depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS x
  FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) USING (conv_id, depth) GROUP BY d, depth
), up AS (
  SELECT n.d, n.depth, q.d AS above, q.depth AS above_depth FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth
), kids AS (
  SELECT above AS d, above_depth AS depth, count(*) AS n_children FROM up WHERE above_depth = depth - 1 GROUP BY 1, 2
), sub AS (
  SELECT above AS d, above_depth AS depth, count(*) FILTER (WHERE kids.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM up JOIN n ON n.d = up.d AND n.depth = up.depth LEFT JOIN kids ON kids.d = up.d AND kids.depth = up.depth GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(kids.n_children, 0) AS BIGINT) AS n_children,
  sub.n_leaves, CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.x, sha256('')) AS ends_sha256
FROM n LEFT JOIN up ON up.d = n.d AND up.depth = n.depth AND up.above_depth = n.depth - 1
LEFT JOIN n o ON o.d = up.above AND o.depth = up.above_depth
LEFT JOIN kids ON kids.d = n.d AND kids.depth = n.depth JOIN sub ON sub.d = n.d AND sub.depth = n.depth
LEFT JOIN e ON e.d = n.d AND e.depth = n.depth
"""
