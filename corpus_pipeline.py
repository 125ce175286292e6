"""A training corpus in five stages, each a DataFrame job over all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. Each result is written to the shared folder as Parquet and reread as the next
stage's docs. All stages but the last return the columns of ``docs``, extra ones included.

language   fits on the rows with lang and drops documents without a letter (``und``)
dedup      SimHash near-duplicates: of each group the smallest doc_id stays
decontam   drops documents that cover a benchmark item
secrets    replaces secrets in texts by marks of their kind; n_chars follows
encode     doc_id, lang, source, n_tokens, ids (packed little-endian 32-bit), ids_sha256, decoded_sha256

Null texts have no language and go at the first stage. Repeated rows are duplicates. An
empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm import codec, decontam, langid, secrets, simhash
from kinmesh.session import materialize, own_name, read_table

#: Rows of an Arrow batch in all stages.
BATCH_ROWS = 500
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
RANKS = "byte_bpe_50k.tiktoken"


def small_batches(spark: SparkSession) -> None:
    """Let at most BATCH_ROWS rows travel to a Python worker at once, since a row holds a whole text."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    name = own_name(docs, "found")
    found = docs.withColumn(name, langid.language_column(spark, langid.fit_languages(docs), F.col("text")))
    return found.filter(F.col(name)["lang"] != "und").select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    name = own_name(docs, "spans")
    found = docs.withColumn(name, secrets.secret_column(spark, secrets.fit_secrets(docs), F.col("text")))
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col(name))).withColumn("n_chars", F.length("text").cast("bigint"))
    return clean.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers

    coded = codec.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(RANKS))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("dedup", dedup), ("decontam", decontaminate), ("secrets", redact_secrets), ("encode", encode)]

#: SQL cannot express the fitted models of the first and fourth stage; tests/llm hold the run to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; the session's batch size is as before when they are done."""
    docs, batch = read_table(spark, sf_dir, "documents"), spark.conf.get(BATCH_KEY)
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(BATCH_KEY, batch)
    return docs
