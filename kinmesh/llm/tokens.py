"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is merged once and kept if it becomes one token; the
pre-tokens among those count as one by lookup and only the rest is merged
(:class:`kinmesh.llm.bpe.MergeCounter`). The proof runs on the driver and its outcome is
broadcast with the merges; both have the size of the vocabulary. Counting is per row: no
shuffle, and a worker's memory is the vocabulary and a bounded memo.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm.bpe import MergeCounter
from kinmesh.session import read_table

LIMIT = 1024


@functools.lru_cache(maxsize=2)
def counter_of(blob: bytes) -> MergeCounter:
    """The counter of a vocabulary file; its whole tokens are proved here, once, and the outcome is sent."""
    return MergeCounter(blob)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > limit) for each whole text.

    ``vocabulary`` is a tokenizer file with byte-level BPE, read on the driver and sent to
    the workers (its size is that of the file). Special strings inside texts count as their
    special token, the library's default; none is added at either end. A null text counts
    as empty. Existing columns of the three names are replaced; an empty table stays empty.
    """
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(counter_of(f.read()))

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        counter = sent.value
        return pa.array([counter.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return df.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"), "n_tokens": tokens(F.col(text))}).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
