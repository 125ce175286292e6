"""Bounded samples of labelled rows for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``remainder`` (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Characters of all texts of a sample.
MOST_CHARS = 60_000_000


def spots(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with the hash and the size by which rows are drawn in place of their text, so that joins before the draw move no text."""
    spot = F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(20))
    return df.withColumns({"spot_": spot, "size_": F.coalesce(F.length(text), F.lit(0))}).drop(text)


def fetched(rows: list, texts: DataFrame, key: str, text: str = "text") -> list[dict]:
    """Drawn ``rows`` (key and spot_ among them) with the texts that ``texts`` (key, text) has for them."""
    kind = dict(texts.dtypes)[key]
    wanted = texts.sparkSession.createDataFrame(list({(r[key], r["spot_"]) for r in rows}), f"{key} {kind}, spot_ bigint")  # a bounded sample
    with_spot = texts.select(key, text, F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(20)).alias("spot_"))
    found = {(r[key], r["spot_"]): r[text] for r in with_spot.join(F.broadcast(wanted), [key, "spot_"]).collect()}
    return [r.asDict() | {text: found[r[key], r["spot_"]]} for r in rows]


def bounded_sample(df: DataFrame, label: str, per_label: int, most: int, key: str, text: str = "text") -> list:
    """At most ``per_label`` rows of each label, about ``most`` in all, chosen by a hash of ``key`` and ``text``.

    Labels are counted over all rows. With many labels each has its share of ``most``, and no
    label is left out: the first row of a label always stays, whatever its length, so the bound on
    characters is passed by the first texts of long labels at most. A hash threshold passes about twice what a label needs, the rank of the
    hash cuts it to size, and equal rows are told apart by nothing, so the choice depends on the
    rows alone. Texts are whole; a label's further rows are taken, by their hash, as long as
    their texts stay within its part of MOST_CHARS; a text longer than the part is passed over.
    A table of :func:`spots` gives the same rows without their texts, which :func:`fetched` adds.
    """
    counts = df.groupBy(F.col(label).alias("label_")).agg(F.count(F.lit(1)).alias("label_rows"))
    total, labels = counts.agg(F.sum(F.least("label_rows", F.lit(per_label))), F.count(F.lit(1))).first()
    if not total:
        return []
    each = F.greatest(F.lit(1), F.floor(F.least(F.lit(per_label), F.col("label_rows")) * min(1.0, most / total))).cast("int")
    columns = df.columns
    df = df if "spot_" in columns else df.withColumns({"spot_": F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(20)), "size_": F.coalesce(F.length(text), F.lit(0))})
    joined = df.join(counts, df[label].eqNullSafe(F.col("label_"))).withColumn("each_", each)
    likely = joined.filter(F.pmod("spot_", F.lit(1 << 30)) < F.least(F.lit(1.0), (2 * F.col("each_") + 32) / F.col("label_rows")) * (1 << 30))
    by = Window.partitionBy("label_").orderBy("spot_")
    part = MOST_CHARS // labels
    size = F.col("size_")
    near = likely.withColumn("rank_", F.row_number().over(by)).filter((F.col("rank_") <= F.col("each_")) & ((F.col("rank_") == 1) | (size <= part)))
    chars = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0))
    chosen = near.withColumn("chars_", chars).filter((F.col("chars_") <= part) | (F.col("rank_") == 1)).select(*columns)
    return sorted(chosen.collect(), key=lambda r: tuple(str(x) for x in r))
