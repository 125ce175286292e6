"""Exact search of stated queries against all rows, block by block: the best k or every product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.operators.metric import crossed
from kinmesh.session import materialize

#: Rows of a block of queries, of rows, and of one set that is compared with itself; blocks written to a file.
QUERY_BLOCK, ROW_BLOCK, OWN_BLOCK, HELD = 256, 2048, 1024, 4
#: Steps from 0 to 1 of a product with six places, and how many of their counts are a row.
STEPS, GROUP = 1_000_000, 1000


def _blocked(df: DataFrame, block: int, name: str, id_col: str, vector: str) -> DataFrame:
    """A written table (name, name_ids, name_v) of blocks of about ``block`` rows, a few to a file; rows without a vector are left out."""
    df = df.filter(F.col(vector).isNotNull())
    blocks = max(1, -(-df.count() // block))
    dealt = df.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).alias(name), F.struct(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).alias("s"))
    held = dealt.groupBy(name).agg(F.sort_array(F.collect_list("s")).alias("s"))  # about a block's rows
    return materialize(held.select(name, F.col("s.id").alias(f"{name}_ids"), F.flatten("s.v").alias(f"{name}_v")).repartition(-(-blocks // HELD)), "blocks")


def block_pairs(queries: DataFrame, rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(q_ids, q_v, r_ids, r_v): each block of queries with each block of rows; vectors are laid end to end.

    The written blocks are read again for each part of the queries, so no copy is shuffled.
    """
    q, r = _blocked(queries, QUERY_BLOCK, "q", id_col, vector), _blocked(rows, ROW_BLOCK, "r", id_col, vector)
    return crossed(q, r, F.lit(True)).select("q_ids", "q_v", "r_ids", "r_v")


def own_products(rows: DataFrame, id_col: str = "id", vector: str = "v") -> DataFrame:
    """(i, j, similarity): the dot product of all i < j of ``rows``. Each pair of blocks meets once."""

    def products(batches):
        for batch in batches:
            for q_ids, q_v, r_ids, r_v in zip(*batch.columns, strict=True):
                ids, others = (x.values.to_numpy(zero_copy_only=False) for x in (q_ids, r_ids))
                a, b = (v.values.to_numpy(zero_copy_only=False).reshape(n, -1) for v, n in ((q_v, len(ids)), (r_v, len(others))))
                s, own, near = (a @ b.T).ravel(), np.repeat(ids, len(others)), np.tile(others, len(ids))
                # a block with itself has both orders
                keep = own < near if len(ids) == len(others) and (ids == others).all() else own != near
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, near)[keep]), pa.array(np.maximum(own, near)[keep]), pa.array(s[keep])], names=["i", "j", "similarity"])

    q = _blocked(rows, OWN_BLOCK, "q", id_col, vector)
    r = q.withColumnsRenamed({c: c.replace("q", "r", 1) for c in q.columns})
    return crossed(q, r, F.col("q") <= F.col("r")).select("q_ids", "q_v", "r_ids", "r_v").mapInArrow(products, "i bigint, j bigint, similarity double")


def own_nearest(rows: DataFrame, most: int, id_col: str = "id", vector: str = "v") -> tuple[DataFrame, DataFrame]:
    """((id, neighbor, rank, value), (value, n)): the ``most`` others of largest value for each of ``rows``, and how many pairs have each value.

    A value is the product of two rows within 0 and 1, with six places; ties go to the smaller
    id. Each pair of blocks meets once, and a task keeps the best of its blocks' rows and one
    count for each value that there can be, so that no pair leaves it.
    """

    def merged(best: tuple | None, ids: np.ndarray, v: np.ndarray, others: np.ndarray) -> tuple:
        m = v.shape[1]
        if m > most:
            # of equal values the first column has the smallest id
            at = np.argpartition(v.astype(np.int64) * m + np.arange(m - 1, -1, -1), m - most, axis=1)[:, m - most :]
            v, near = np.take_along_axis(v, at, 1), others[at]
        else:
            near = np.broadcast_to(others, v.shape)
        if best is not None:
            v, near = np.hstack([best[1], v]), np.hstack([best[2], near])
        order = np.lexsort((near, -v), axis=1)[:, :most]
        return ids, np.take_along_axis(v, order, 1), np.take_along_axis(near, order, 1)

    def kept(batches):
        counts, best = np.zeros((STEPS // GROUP + 1) * GROUP, np.int64), {}
        for batch in batches:
            for q, q_ids, q_v, r, r_ids, r_v in zip(*batch.columns, strict=True):
                ids, others = (x.values.to_numpy(zero_copy_only=False) for x in (q_ids, r_ids))
                a, b = (v.values.to_numpy(zero_copy_only=False).reshape(n, -1) for v, n in ((q_v, len(ids)), (r_v, len(others))))
                s = a @ b.T
                s[np.isnan(s)] = 1  # as the largest number is cut to 1
                v = np.floor(np.clip(s, 0, 1) * STEPS + 0.5).astype(np.int32)
                q, r = q.as_py(), r.as_py()
                counts += np.bincount(v[np.triu_indices(len(ids), 1)] if q == r else v.ravel(), minlength=len(counts))
                if q == r:
                    np.fill_diagonal(v, -1)
                else:
                    best[r] = merged(best.get(r), others, v.T, ids)
                best[q] = merged(best.get(q), ids, v, others)
        names = ["id", "neighbor", "step", "counts"]
        for ids, v, near in best.values():
            x, y = np.nonzero(v >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(near[x, y]), pa.array(v[x, y]), pa.nulls(len(x), pa.list_(pa.int64()))], names=names)
        groups = np.flatnonzero(counts.reshape(-1, GROUP).any(1)).tolist()
        told = pa.array([counts[g * GROUP : (g + 1) * GROUP] for g in groups], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(groups), pa.int64()), pa.nulls(len(groups), pa.int64()), pa.array([g * GROUP for g in groups], pa.int32()), told], names=names)

    q = _blocked(rows, OWN_BLOCK, "q", id_col, vector)
    r = q.withColumnsRenamed({c: c.replace("q", "r", 1) for c in q.columns})
    met = crossed(q, r, F.col("q") <= F.col("r")).select("q", "q_ids", "q_v", "r", "r_ids", "r_v")
    found = materialize(met.mapInArrow(kept, "id bigint, neighbor bigint, step int, counts array<bigint>"), "nearest")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("step"), "neighbor"))
    near = found.filter("counts is null").withColumn("rank", rank).filter(F.col("rank") <= most).select("id", "neighbor", "rank", (F.col("step") / STEPS).alias("value"))
    told = found.filter("counts is not null").select("step", F.posexplode("counts").alias("at", "n")).filter("n > 0")
    return near, told.groupBy((F.col("step") + F.col("at")).alias("step")).agg(F.sum("n").alias("n")).select((F.col("step") / STEPS).alias("value"), "n")


def block_products(queries: DataFrame, rows: DataFrame, id_col: str = "id", vector: str = "v") -> DataFrame:
    """(id, neighbor, similarity): the dot product of each query with each row but itself, one matrix product a pair of blocks.

    Vectors as in :func:`block_topk`. There are as many rows as pairs; they leave a task block by block.
    """

    def products(batches):
        for batch in batches:
            for q_ids, q_v, r_ids, r_v in zip(*batch.columns, strict=True):
                ids, others = (x.values.to_numpy(zero_copy_only=False) for x in (q_ids, r_ids))
                a, b = (v.values.to_numpy(zero_copy_only=False).reshape(n, -1) for v, n in ((q_v, len(ids)), (r_v, len(others))))
                s, own = (a @ b.T).ravel(), np.repeat(ids, len(others))
                near = np.tile(others, len(ids))
                keep = own != near
                yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(near[keep]), pa.array(s[keep])], names=["id", "neighbor", "similarity"])

    return block_pairs(queries, rows, id_col, vector).mapInArrow(products, "id bigint, neighbor bigint, similarity double")


def block_topk(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "id", vector: str = "v") -> DataFrame:
    """(id, neighbor, rank, similarity): the k rows of largest dot product for each query, itself left out.

    Queries and rows are dealt into blocks by hash; each pair of blocks is one matrix product
    in a task that returns its k best rows for each query, so that what is ranked at the end
    is k rows for each query and row block and not all pairs. Ties go to the smaller id. The
    vectors must have one size; unit vectors make it a cosine. Rows without a vector are left out.
    """
    met = block_pairs(queries, rows, id_col, vector)

    @F.arrow_udf("array<struct<id:bigint,neighbor:bigint,similarity:double>>")
    def best(q_ids: pa.Array, q_v: pa.Array, r_ids: pa.Array, r_v: pa.Array) -> pa.Array:
        out = []
        for a_ids, a_v, b_ids, b_v in zip(q_ids, q_v, r_ids, r_v, strict=True):
            ids, others = np.array(a_ids.as_py(), np.int64), np.array(b_ids.as_py(), np.int64)
            a = a_v.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            b = b_v.values.to_numpy(zero_copy_only=False).reshape(len(others), -1)
            s = a @ b.T
            s[ids[:, None] == others[None, :]] = -np.inf
            found = []
            for row, own in zip(s, ids, strict=True):
                edge = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                near = np.flatnonzero((row >= edge) & (row > -np.inf))
                near = near[np.lexsort((others[near], -row[near]))][:k]
                found += [{"id": int(own), "neighbor": int(others[x]), "similarity": float(row[x])} for x in near]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("id", pa.int64()), ("neighbor", pa.int64()), ("similarity", pa.float64())])))

    met = met.select(F.explode(best("q_ids", "q_v", "r_ids", "r_v")).alias("b")).select("b.*")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "neighbor", "rank", "similarity")
