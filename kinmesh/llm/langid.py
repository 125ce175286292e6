"""Language identification in two steps: family, then language within it.

A text becomes hashed counts of character 1- to 3-grams of its lower-cased letters, scaled to
unit length. One-versus-rest linear support vector machines choose the family; within a
family of several languages, one linear machine for each pair votes (one versus one). The
machines are fitted in numpy on a bounded sample of labelled rows on the driver and travel
to the workers in the closure; their size depends on the number of languages only.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm.sampling import bounded_sample, held_out
from kinmesh.session import own_name, read_table

#: Families of closely related languages. A language not named is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "tr", "uz"),
}
BITS = 14
#: Bounds of the fitting sample: rows a language and rows in all. Whole texts are read.
PER_LANGUAGE, MOST_ROWS = 300, 2000

_LETTERS = np.zeros(0x110000, bool)


def letters() -> np.ndarray:
    """Which code points are letters; filled once per process."""
    if not _LETTERS[ord("a")]:
        _LETTERS[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def grams(text: str) -> np.ndarray | None:
    """Hashed 1- to 3-gram counts of a text, scaled to unit length; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]  # runs of other characters become one blank
    x = codes[keep].astype(np.uint32)
    shift = np.uint32(32 - BITS)
    one = x * np.uint32(2654435761)
    parts = [one >> shift]
    if len(x) > 1:
        two = (one[:-1] ^ (x[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        parts.append(two >> shift)
        if len(x) > 2:
            parts.append(((two[:-1] ^ (x[2:] * np.uint32(668265263))) * np.uint32(374761393)) >> shift)
    counts = np.bincount(np.concatenate(parts), minlength=1 << BITS).astype(np.float32)
    return counts / np.sqrt(counts @ counts)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 12, strength: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """A linear support vector machine by averaged subgradient steps (Pegasos); y is +1 or -1. Classes weigh alike."""
    rng = np.random.default_rng(seed)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, b, mean_b, step = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0, 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            step += 1
            rows = order[at : at + 64]
            rate = 1 / (strength * (step + 100))
            wrong = rows[y[rows] * (x[rows] @ w + b) < 1]
            w *= 1 - rate * strength
            pull = weight[wrong] * y[wrong] / len(rows)
            w += np.float32(rate) * (pull.astype(np.float32) @ x[wrong])
            b += 0.01 * rate * strength * 100 * pull.sum()
            mean += (w - mean) / step
            mean_b += (b - mean_b) / step
    return mean, float(mean_b)


def fit_slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The scale that turns margins into probabilities by a logistic curve (Platt's, without offset)."""
    scales = np.geomspace(0.2, 8, 40)
    losses = [np.logaddexp(0, -s * margin * y).mean() for s in scales]
    return float(scales[int(np.argmin(losses))])


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class LanguageModel:
    def __init__(self, families: dict[str, str]):
        self.groups: dict[str, list[str]] = {}
        for lang, family in sorted(families.items()):
            self.groups.setdefault(family, []).append(lang)
        self.family_machines: dict[str, tuple] = {}
        self.pair_machines: dict[tuple[str, str], tuple] = {}

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> LanguageModel:
        """Fit on (text, lang) rows; rows without a letter are left out. An empty sample gives a model that knows nothing."""
        pairs = [(g, lang) for text, lang in rows if text and (g := grams(text)) is not None]
        names = {lang for _, lang in pairs}
        home = {lang: next((f for f, members in FAMILIES.items() if lang.split("-")[0].split("_")[0].lower() in members), lang) for lang in names}
        model = cls(home)
        if not pairs:
            return model
        x = np.stack([g for g, _ in pairs])
        langs = np.array([lang for _, lang in pairs])
        kin = np.array([home[lang] for lang in langs])

        def machine(rows_: np.ndarray, y: np.ndarray) -> tuple:
            check = np.arange(len(y)) % 5 == 4
            if (y[~check] > 0).any() and (y[~check] < 0).any() and check.any():
                w, b = fit_svm(x[rows_][~check], y[~check])
                slope = fit_slope(x[rows_][check] @ w + b, y[check])
            else:
                w, b = fit_svm(x[rows_], y)
                slope = 1.0
            return w, b, slope

        if len(model.groups) > 1:
            every = np.arange(len(kin))
            for family in model.groups:
                model.family_machines[family] = machine(every, np.where(kin == family, 1.0, -1.0))
        for members in model.groups.values():
            for a, b in combinations(members, 2):
                rows_ = np.flatnonzero((langs == a) | (langs == b))
                model.pair_machines[a, b] = machine(rows_, np.where(langs[rows_] == a, 1.0, -1.0))
        return model

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); ``und`` and 0 if the text is null or has no letter."""
        g = grams(text) if text else None
        if g is None or not self.groups:
            return "und", 0.0
        if self.family_machines:
            shares = {f: sigmoid(s * float(g @ w + b)) for f, (w, b, s) in self.family_machines.items()}
            family = max(shares, key=lambda f: (shares[f], f))
            score = shares[family] / max(sum(shares.values()), 1e-12)
        else:
            family, score = next(iter(self.groups)), 1.0
        members = self.groups[family]
        if len(members) == 1:
            return members[0], score
        votes, mass = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            w, bias, s = self.pair_machines[a, b]
            p = sigmoid(s * float(g @ w + bias))
            votes[a if p >= 0.5 else b] += 1
            mass[a] += p
            mass[b] += 1 - p
        best = max(members, key=lambda m: (votes[m], mass[m], m))
        return best, score * mass[best] / (len(members) - 1)


def fit_languages(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on at most MOST_ROWS rows with text and lang, PER_LANGUAGE a language."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    return LanguageModel.fit([(r["text"], r["lang"]) for r in bounded_sample(rows, "lang", PER_LANGUAGE, MOST_ROWS, "doc_id")])


def language_column(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """A struct of lang and score for a text."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        found = [sent.value.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return run(text)


def identify_languages(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score for each whole text; no shuffle. Existing columns of these names are replaced."""
    name = own_name(df, "found")
    out = df.withColumn(name, language_column(df.sparkSession, model, F.col(text)))
    return out.withColumns({"lang_pred": F.col(name)["lang"], "score": F.col(name)["score"]}).drop(name)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = fit_languages(docs.filter(~F.col("held_out")))
    return identify_languages(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
