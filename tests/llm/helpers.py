"""Tables of awkward documents, and the tokenizers they are held to."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use inside or return.
CLASHES = ("n_tokens", "score", "ids", "seeds", "fp", "group", "component_id", "secrets", "kept", "n_words", "predicted", "token", "n", "coverage", "lang_pred", "over_limit", "n_bytes", "decoded", "base_failed", "_key", "_found", "_coded", "_text", "_seeds", "text_key", "row_key", "found", "coded", "spans", "keep", "rank", "doc")


def awkward(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "of", "Zeit", "año", "été", "run", "x1", "don't", "über", "token", "=", "<|endoftext|>", "#", "\t", "\n\n", "漢字", "🙂", "AKIA", "0f"]
    rows = [
        (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, " \n\t ", None, "a", 3), (3, "a" * 30_000, "en", "b", 30_000), (4, "the cat " * 8_000, "en", "b", 64_000),
        (5, "12 34 !!", "de", None, 8), (None, "a row without an id", "en", "a", 1), (None, "a row without an id", "en", "a", 1), (7, "same id one", "en", "a", 1), (7, "same id two", "en", "a", 1), (8, None, None, None, None),
        (9, "\x1c\x85  odd\x0bspaces", "en", "a", 1),
    ]
    for k in range(10, 10 + n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))
        rows.append((k, text, rng.choice(["en", "de", "fr"]), "c", len(text)))
    return rows + rows[-3:]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def save(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
