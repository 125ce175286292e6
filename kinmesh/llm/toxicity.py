"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to embeddings, each word to the sum of two rows of one table, so that words
which share one row still differ; filters of several widths run over the whole text, and the
largest response of each filter over all places feeds a logistic unit. It is fitted by Adam
on a bounded sample of labelled rows on the driver; the gradient of a maximum reaches one
place a filter, so a step costs little beyond its forward pass. Where the sample leaves rows out,
it is only the start: every labelled row then takes part in a distributed pass. Thresholds are calibrated for
each language on rows kept from fitting: a score of 0.5 is the threshold of the text's
language. The language itself is guessed from the same hashed words by a naive Bayes table,
never read from a column.

Scoring is per row without shuffle; the model's size is fixed.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm.bpe import Memo
from kinmesh.llm.sampling import bounded_sample, fetched, held_out, spots
from kinmesh.session import read_table

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
LANGUAGE_BUCKETS = 1 << 14
#: Bounds of the fitting sample: rows of each label and rows in all; whole texts are read.
PER_LABEL, MOST_ROWS = 1500, 3000
#: Labelled rows of a shard of the pass over all rows, and shards at most; words and rows of a shard held at once.
SHARD_ROWS, MOST_SHARDS, HELD_WORDS, HELD_ROWS = 10_000, 32, 1 << 21, 3000
#: Steps of a weight and of a logit, so that sums over shards are exact in any order.
STEP, BIN = 2.0**-32, 1e-3
#: Places scored at once, so that memory is bounded for any length of text.
BLOCK = 1 << 16

find_words = re.compile(r"[^\W_]+").findall


def buckets(word: str) -> int:
    """The two rows of a word, packed into one integer."""
    data = word.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) % BUCKETS) << 32 | zlib.crc32(data, 0x5EED) * 2654435761 % (1 << 32) % BUCKETS


class BucketMemo(Memo):
    compute = staticmethod(buckets)


class WordIds:
    """The two rows of each word of a text, (n, 2), remembered for frequent words."""

    def __init__(self, size: int = 300_000):
        self.memo = BucketMemo(size)

    def __call__(self, text: str | None) -> np.ndarray:
        words = find_words(text.lower()) if text else ()
        packed = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        return np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1).astype(np.int32)


class ToxicityModel:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
        self.kernels = {w: rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.bias = 0.0
        self.languages: list[str] = []
        self.word_logs = np.zeros((LANGUAGE_BUCKETS, 0), np.float32)
        self.thresholds: dict[str, float] = {}

    def pool(self, ids: np.ndarray, places: bool = False) -> tuple[np.ndarray, list]:
        """The largest response of each filter, not below 0, and where it lies."""
        best, where = [], []
        for w in WIDTHS:
            top, at = np.zeros(FILTERS, np.float32), np.full(FILTERS, -1)
            for start in range(0, max(0, len(ids) - w + 1), BLOCK):
                part = ids[start : start + BLOCK + w - 1]
                e = self.embedding[part[:, 0]]
                e += self.embedding[part[:, 1]]
                n = len(part) - w + 1
                response = e[:n] @ self.kernels[w][:DIM]
                for k in range(1, w):
                    response += e[k : k + n] @ self.kernels[w][k * DIM : (k + 1) * DIM]
                high = response.max(axis=0)
                if places:
                    at = np.where(high > top, response.argmax(axis=0) + start, at)
                top = np.maximum(top, high)
            best.append(top)
            where.append(at)
        return np.concatenate(best), where

    def flat(self) -> np.ndarray:
        """All weights as rows of DIM numbers, the embedding first."""
        rest = np.concatenate([*(k.ravel() for k in self.kernels.values()), self.out, [self.bias]]).astype(np.float64)
        return np.concatenate([self.embedding.astype(np.float64), np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])

    def set_flat(self, flat: np.ndarray) -> None:
        self.embedding, rest = flat[:BUCKETS].astype(np.float32), flat[BUCKETS:].ravel()
        for w, kernel in self.kernels.items():
            self.kernels[w], rest = rest[: kernel.size].reshape(kernel.shape).astype(np.float32), rest[kernel.size :]
        self.out, self.bias = rest[: len(self.out)].astype(np.float32), float(rest[len(self.out)])

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pool(ids)[0] @ self.out + self.bias)

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, rate: float = 0.01, batch: int = 32, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.kernels.values(), self.out]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        em, ev = np.zeros_like(self.embedding), np.zeros_like(self.embedding)
        bias_m = bias_v = 0.0
        weight = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                step += 1
                rows = order[at : at + batch]
                grads = [np.zeros_like(p) for p in params]
                touched: dict[int, np.ndarray] = {}
                bias_g = 0.0
                for r in rows:
                    ids = texts[r]
                    pooled, where = self.pool(ids, True)
                    err = (1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30))) - labels[r]) * weight[r] / len(rows)
                    grads[-1] += err * pooled
                    bias_g += err
                    back = err * self.out
                    for k, w in enumerate(WIDTHS):
                        for f in np.flatnonzero(where[k] >= 0):
                            g = back[k * FILTERS + f]
                            own = ids[where[k][f] : where[k][f] + w]
                            grads[k][:, f] += g * self.embedding[own].sum(axis=1).ravel()
                            for j, pair in enumerate(own.tolist()):
                                d = g * self.kernels[w][j * DIM : (j + 1) * DIM, f]
                                for row in pair:
                                    touched[row] = touched.get(row, 0) + d
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, (m, v) in zip(params, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * fix * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
                bias_m += 0.1 * (bias_g - bias_m)
                bias_v += 0.001 * (bias_g * bias_g - bias_v)
                self.bias -= rate * fix * bias_m / (np.sqrt(bias_v) + 1e-8)
                if touched:
                    words = np.fromiter(touched, np.int64, len(touched))
                    g = np.stack([touched[w] for w in words]).astype(np.float32)
                    em[words] += 0.1 * (g - em[words])
                    ev[words] += 0.001 * (g * g - ev[words])
                    self.embedding[words] -= (rate * fix * em[words] / (np.sqrt(ev[words]) + 1e-8)).astype(np.float32)

    def fit_language_table(self, texts: list[np.ndarray], langs: list[str | None]) -> None:
        self.languages = sorted({x for x in langs if x})
        counts = np.full((LANGUAGE_BUCKETS, len(self.languages)), 0.01, np.float64)
        for ids, lang in zip(texts, langs, strict=True):
            if lang:
                counts[:, self.languages.index(lang)] += np.bincount(ids[:, 0] % LANGUAGE_BUCKETS, minlength=LANGUAGE_BUCKETS)
        self.word_logs = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)

    def language(self, ids: np.ndarray) -> str:
        if not self.languages:
            return ""
        return self.languages[int(np.argmax(self.word_logs[ids[:, 0] % LANGUAGE_BUCKETS].sum(axis=0)))] if len(ids) else self.languages[0]

    def calibrate(self, texts: list[np.ndarray], labels: np.ndarray, least: int = 12) -> None:
        """The logit of best F1 over held-back rows, for each language with ``least`` of both labels, and "" for the rest."""
        logits = np.array([self.logit(ids) for ids in texts])
        langs = np.array([self.language(ids) for ids in texts])

        def best(z: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(-z)
            z, y = z[order], y[order]
            hits = np.cumsum(y)
            f1 = 2 * hits / (np.arange(len(z)) + 1 + y.sum())
            k = int(np.argmax(f1))
            return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 0.5)

        self.thresholds[""] = best(logits, labels) if 0 < labels.sum() < len(labels) else 0.0
        for lang in self.languages:
            mine = langs == lang
            if min(labels[mine].sum(), (1 - labels[mine]).sum()) >= least:
                self.thresholds[lang] = best(logits[mine], labels[mine])

    def score(self, ids: np.ndarray) -> float:
        """0 to 1; 0.5 is the threshold of the text's own language."""
        cut = self.thresholds.get(self.language(ids), self.thresholds.get("", 0.0))
        return float(1 / (1 + np.exp(-np.clip(self.logit(ids) - cut, -30, 30))))

    @classmethod
    def fit(cls, rows: list[tuple[str | None, int, str | None]]) -> ToxicityModel:
        """Fit on (text, label, lang) rows; a fifth sets the thresholds. Without both labels every score is below 0.5."""
        model, ids_of = cls(), WordIds()
        texts = [ids_of(t) for t, _, _ in rows]
        labels = np.array([int(y) for _, y, _ in rows], np.float64)
        if not 0 < labels.sum() < len(labels):
            model.bias, model.thresholds[""] = -1.0, 0.0
            return model
        check = np.arange(len(rows)) % 5 == 4
        model.fit_language_table(texts, [lang for _, _, lang in rows])
        model.train([t for t, c in zip(texts, check, strict=True) if not c], labels[~check])
        model.calibrate([t for t, c in zip(texts, check, strict=True) if c], labels[check])
        return model


def is_check(doc_id: str = "doc_id", text: str = "text"):
    """A fifth of the rows, by their hash, that sets thresholds and never fits weights."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text), F.lit(20)), F.lit(5)) == 4


def learn_all(start: ToxicityModel, rows: DataFrame) -> ToxicityModel:
    """``start`` after one pass over all ``rows`` (doc_id, text, label, lang), and their language table.

    Each partition trains its own copy; a weight moves by the mean over the partitions that moved it.
    """
    sent = rows.sparkSession.sparkContext.broadcast(start)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids_of = copy.deepcopy(sent.value), WordIds()
        texts, labels, counts, words, seen = [], [], {}, 0, False

        def flush() -> None:
            model.train(texts, np.array(labels, np.float64), epochs=1)
            texts.clear()
            labels.clear()

        for batch in batches:
            for text, label, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "lang")), strict=True):
                ids, seen = ids_of(text), True
                texts.append(ids)
                labels.append(label)
                words += len(ids)
                if lang:
                    counts[lang] = counts.get(lang, 0) + np.bincount(ids[:, 0] % LANGUAGE_BUCKETS, minlength=LANGUAGE_BUCKETS)
                if words >= HELD_WORDS or len(texts) >= HELD_ROWS:
                    flush()
                    words = 0
        if texts:
            flush()
        if seen:
            moved = model.flat() - sent.value.flat()
            at = np.flatnonzero(moved.any(axis=1))
            yield pa.RecordBatch.from_pydict({"lang": pa.nulls(len(at), pa.string()), "at": at, "n": np.ones(len(at), np.int64), "d": pa.array(list(np.rint(moved[at] / STEP).astype(np.int64)), pa.list_(pa.int64()))})
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "at": at, "n": found[at], "d": pa.array([[0] * DIM] * len(at), pa.list_(pa.int64()))})
            if not len(at):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "at": [0], "n": [0], "d": pa.array([[0] * DIM], pa.list_(pa.int64()))})

    sums = [F.sum(F.col("d")[k]).alias(f"d{k}") for k in range(DIM)]
    found = rows.mapInArrow(learn, "lang string, at bigint, n bigint, d array<bigint>").groupBy("lang", "at").agg(F.sum("n").alias("n"), *sums).toPandas()  # bounded by the model and the languages
    model = copy.deepcopy(start)
    own = found[found["lang"].isna()]
    flat = start.flat()
    flat[own["at"].to_numpy()] += own[[f"d{k}" for k in range(DIM)]].to_numpy(np.float64) * STEP / own["n"].to_numpy(np.float64)[:, None]
    model.set_flat(flat)
    told = found[~found["lang"].isna()]
    model.languages = sorted(told["lang"].unique())
    counts = np.full((LANGUAGE_BUCKETS, len(model.languages)), 0.01, np.float64)
    for k, lang in enumerate(model.languages):
        mine = told[told["lang"] == lang]
        counts[mine["at"].to_numpy(), k] += mine["n"].to_numpy()
    model.word_logs = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)
    return model


def calibrate_all(model: ToxicityModel, rows: DataFrame, least: int = 12) -> None:
    """:meth:`ToxicityModel.calibrate` over all ``rows`` by counts of their logits in steps of BIN."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids_of = sent.value, WordIds()
        for batch in batches:
            ids = [ids_of(t) for t in batch.column("text").to_pylist()]
            z = [round(min(30.0, max(-30.0, model.logit(i))) / BIN) for i in ids]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([model.language(i) for i in ids], pa.string()), "z": pa.array(z, pa.int64()), "label": batch.column("label")})

    found = rows.mapInArrow(place, "lang string, z bigint, label int").groupBy("lang", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).toPandas()

    def best(counts) -> float:
        by = counts.groupby("z")[["n", "y"]].sum().sort_index(ascending=False)
        z, hits = by.index.to_numpy() * BIN, by["y"].cumsum().to_numpy()
        k = int(np.argmax(2 * hits / (by["n"].cumsum().to_numpy() + hits[-1])))
        return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 0.5)

    model.thresholds = {"": best(found) if 0 < found["y"].sum() < found["n"].sum() else 0.0}
    for lang, mine in found.groupby("lang"):
        if lang and min(mine["y"].sum(), mine["n"].sum() - mine["y"].sum()) >= least:
            model.thresholds[lang] = best(mine)


def fit_toxicity(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", texts: DataFrame | None = None, whole: Callable[[int], DataFrame] | None = None) -> ToxicityModel:
    """Fit on all rows with a label: a sample of MOST_ROWS rows, PER_LABEL of each, gives the
    first weights and, where it leaves rows out, all rows go through :func:`learn_all`.

    With ``texts`` (doc_id, text), ``labelled`` holds :func:`kinmesh.llm.sampling.spots` and no
    texts; those of the drawn rows alone are read for the sample, and ``whole`` gives the labelled
    rows with their texts in a number of partitions by doc_id.
    """
    held = [F.col(text).alias("text")] if texts is None else [F.col("spot_"), F.col("size_")]
    names = [F.col(label).cast("int").alias("label"), F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang")]
    rows = labelled.filter(F.col(label).isin(0, 1)).select(*names, *held)
    found = bounded_sample(rows.select("label", "doc_id", *(["text"] if texts is None else ["spot_", "size_"]), "lang"), "label", PER_LABEL, MOST_ROWS, "doc_id")
    total = rows.count() if found else 0
    if texts is not None and found:
        found = fetched(found, texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
        found.sort(key=lambda r: tuple(str(r[c]) for c in ("label", "doc_id", "text", "lang")))
    mixed = sorted(found, key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    model = ToxicityModel.fit([(r["text"], r["label"], r["lang"]) for r in mixed])
    if total == len(found) or len({r["label"] for r in found}) < 2:
        return model
    shards = min(MOST_SHARDS, -(-total // SHARD_ROWS))
    every = labelled.repartition(shards, doc_id) if whole is None else whole(shards)
    every = every.filter(F.col(label).isin(0, 1)).select(*names, F.col(text).alias("text"))
    fitting = every.filter(~is_check()).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text", "label", "lang")
    model = learn_all(model, fitting)
    calibrate_all(model, every.filter(is_check()))
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``df`` with score and predicted for each whole text; null text is empty. Existing columns of these names are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        model, ids_of = sent.value, WordIds()
        return pa.array([model.score(ids_of(t)) for t in texts.to_pylist()], pa.float64())

    return df.withColumn("score", run(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    own = docs.filter(~F.col("held_out"))

    def whole(shards: int) -> DataFrame:
        return own.repartition(shards, "doc_id").join(labels.repartition(shards, "doc_id"), "doc_id")

    model = fit_toxicity(spots(own, "doc_id").join(labels, "doc_id"), texts=own, whole=whole)
    return score_toxicity(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "score", "predicted")
