"""Secret scans: base rules, then a character convolutional network over every other candidate.

Base findings stay as they are. Beyond them, each token that could be a secret (12 or more of
the characters of keys in a run; where a base finding covers a part of the run, each part
that is left) is read with its surroundings by a network in numpy: character embeddings with
a flag for inside or outside the candidate, filters of two widths, their largest responses,
and a logistic unit. Windows have a fixed size; a candidate longer than one is read through
windows that overlap by half, the last at its end, and takes the largest of their scores. Its
span is whole.

The network is fitted on labelled findings: base findings of a bounded sample of documents
and generated secrets as positives; prose, numbers, addresses, identifiers and versions as
negatives. Thresholds go by the candidate's shape (digits, both cases, separators) and keep
``RECALL`` of held-back positives.

Scanning is per row without shuffle.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmesh.session import read_table

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
#: Candidates known to be none: a long word of prose (letters alone, small after the first or all capital), numbers and
#: addresses in digits, and what stands behind the sign of a mail address.
PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9.+/-]+|(?<=@).+")

CONTEXT, INSIDE, DIM, FILTERS, WIDTHS = 16, 40, 8, 24, (3, 5)
SPAN = 2 * CONTEXT + INSIDE
#: Bounds of the fitting sample: documents read, findings taken from them, findings generated.
FIT_DOCUMENTS, FIT_FINDINGS, GENERATED = 2000, 1000, 16_000
RECALL = 0.97
#: Windows of one finding that the fit reads.
FIRST_WINDOWS = 8
#: Held-back positives from which a shape of candidates has a threshold of its own.
LEAST_CHECKED = 40


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three base rules by start, then kind.

    Leftmost matches without overlap, short ones dropped after matching. For the access and
    hex rules a minimum in the pattern gives the same, as their runs are maximal; the assign
    rule keeps its plain pattern, since a dropped match still uses up what it covers.
    """
    out = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Candidate spans: runs, and of runs that spans in ``taken`` touch the parts beside them, from 12 characters on."""
    out, k, taken = [], 0, sorted(taken)
    reach = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.end()
        while k < len(taken) and taken[k][0] < end:
            free = max(start, reach)
            out.append((free, taken[k][0]))
            reach = max(reach, taken[k][1])
            k += 1
        out.append((max(start, reach), end))
    trimmed = ((a, a + len(text[a:b].rstrip(".-"))) for a, b in out if b - a >= 12)
    return [(a, b) for a, b in trimmed if b - a >= 12]


def shape_of(candidate: str) -> int:
    """What a candidate is made of: 1 with digits, 2 with small and capital letters, 4 with separators."""
    return bool(re.search("[0-9]", candidate)) + 2 * bool(re.search("[a-z]", candidate) and re.search("[A-Z]", candidate)) + 4 * bool(re.search(r"[/_.=+-]", candidate))


def window_starts(start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin: each half a window on, the last so that it ends with the candidate."""
    last = max(start, end - INSIDE)
    return [*range(start, last, INSIDE // 2), last]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate and its surroundings: characters up to 127, others as 1, beyond the text 0; inside adds 128."""
    def codes(s: str, size: int, left: bool) -> np.ndarray:
        row = np.zeros(size, np.int16)
        c = np.fromiter((ord(x) if ord(x) < 128 else 1 for x in s), np.int16, len(s))
        if len(s):
            row[size - len(s) :] = c if left else row[size - len(s) :]
            if not left:
                row[: len(s)] = c
        return row

    before = codes(text[max(0, start - CONTEXT) : start], CONTEXT, True)
    inside = codes(text[start : min(end, start + INSIDE)], INSIDE, False)
    after = codes(text[end : end + CONTEXT], CONTEXT, False)
    return np.concatenate([before, np.where(inside > 0, inside + 128, 0), after])


class SecretModel:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.3, (256, DIM)).astype(np.float32)
        self.kernels = [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.bias, self.threshold, self.thresholds = np.zeros(1, np.float32), 0.0, {}

    def forward(self, x: np.ndarray) -> tuple:
        e = self.embedding[x]
        pooled, places = [], []
        for w, kernel, shift in zip(WIDTHS, self.kernels, self.shifts, strict=True):
            n = x.shape[1] - w + 1
            patches = np.stack([e[:, k : k + n] for k in range(w)], axis=2).reshape(len(x), n, w * DIM)
            response = patches @ kernel + shift
            at = response.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(response, at[:, None], 1)[:, 0], 0))
            places.append((patches, at))
        h = np.concatenate(pooled, axis=1)
        return h @ self.out + self.bias[0], h, places

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[k : k + 1024])[0] for k in range(0, len(x), 1024)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        params = [self.embedding, *self.kernels, *self.shifts, self.out, self.bias]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                step += 1
                z, h, places = self.forward(x[rows])
                err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
                grads = [np.zeros_like(p) for p in params]
                grads[-2][:], grads[-1][0] = h.T @ err, err.sum()
                back = np.outer(err, self.out) * (h > 0)
                for k, (w, (patches, where)) in enumerate(zip(WIDTHS, places, strict=True)):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    chosen = np.take_along_axis(patches, where[:, :, None], 1)
                    grads[1 + k][:] = np.einsum("bfd,bf->df", chosen, g)
                    grads[1 + len(WIDTHS) + k][:] = g.sum(axis=0)
                    deep = (g[:, :, None] * self.kernels[k].T[None]).reshape(len(rows), FILTERS, w, DIM)
                    chars = x[rows][np.arange(len(rows))[:, None, None], where[:, :, None] + np.arange(w)]
                    np.add.at(grads[0], chars.ravel(), deep.reshape(-1, DIM))
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, (m, v) in zip(params, grads, state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * fix * m / (np.sqrt(v) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, shapes: np.ndarray) -> None:
        """A threshold for each shape with LEAST_CHECKED held-back positives, and one for all others.

        It is the highest that keeps RECALL of the positives, or lower: a quarter of the way from
        nearly all negatives to that point where they lie apart, in logits.
        """
        z = self.logits(x)

        def best(chosen: np.ndarray) -> float:
            high = float(np.quantile(z[chosen & (y == 1)], 1 - RECALL))
            others = z[chosen & (y == 0)]
            low = float(np.quantile(others, 0.998)) if len(others) else high - 4
            return low + (high - low) / 4 if low < high else high

        every = np.ones(len(y), bool)
        self.threshold = best(every) if (y == 1).any() else 0.0
        self.thresholds = {int(s): best(shapes == s) for s in np.unique(shapes) if ((shapes == s) & (y == 1)).sum() >= LEAST_CHECKED}

    def is_secret(self, x: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return self.logits(x) >= np.array([self.thresholds.get(int(s), self.threshold) for s in shapes])


def generated_findings(n: int, seed: int = 17) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): secrets of common shapes and look-alikes, in varied surroundings."""
    rng = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda letters, size: "".join(rng.choice(letters) for _ in range(size))
    syllables = ("an", "the", "ing", "ion", "er", "st", "re", "en", "der", "ung", "que", "les", "ado", "que", "ment")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    names = "user file data name list path index value server client config report image table order price world people water sound place great work part take year live give most very thing help line turn cause mean differ move right old tell boy follow show large spell air play small end home read hand port add land here must big high such light kind need house picture try again animal point mother near build self earth father head stand own page should country found answer school grow study still learn plant cover food sun four between state keep eye never last let thought city tree cross farm hard start might story".split()
    named = lambda n: [rng.choice(names) for _ in range(n)]
    short = [x for x in names if len(x) < 5] + ["do", "go", "we", "so", "up", "no", "my", "if", "us", "me", "am", "ok"]
    onsets = "b c d f g h j k l m n p r s t v w z br ch dr fl fr gr kl pl qu sch schl schw sp st str th tr".split()
    cores = "a e i o u a e i o u ae oe ue ai au ei eu ie io ou".split()
    codas = ["", "", "", *"f l m n r s t ch ck ff ft ll mm mpf ng nn nt rg rt ss st tz".split()]
    spoken = lambda: "".join(rng.choice(onsets) + rng.choice(cores) + rng.choice(codas) for _ in range(rng.randint(3, 10)))
    secrets = (
        lambda: pick(lower + upper + digit, rng.randint(24, 64)),
        lambda: pick(lower + upper + digit + "+/", rng.randint(30, 60)) + rng.choice(("", "=", "==")),
        lambda: rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-", "key-", "SG.")) + pick(lower + upper + digit, rng.randint(20, 40)),
        lambda: "eyJ" + pick(lower + upper + digit, 30) + "." + pick(lower + upper + digit + "_-", 40),
        lambda: pick("0123456789abcdef", rng.randint(16, 23)) + pick(upper, 2) + pick("0123456789abcdef", 8),
        lambda: pick("0123456789ABCDEF", rng.randint(32, 64)),
        lambda: pick(lower + upper, rng.randint(24, 64)),
        lambda: pick(lower + upper + digit, rng.randint(12, 24)),
        lambda: pick(lower + digit, rng.randint(16, 48)),
        lambda: pick(lower + digit, rng.randint(16, 26)),
        lambda: pick(upper + digit, rng.randint(16, 40)),
        lambda: pick("0123456789abcdef", rng.randint(15, 40)),
        lambda: pick("0123456789abcdef", rng.randint(15, 20)),
        lambda: pick(lower, rng.randint(20, 48)),
        lambda: pick(lower, rng.randint(26, 48)),
        lambda: rng.choice("-_.").join(pick(lower + digit, rng.randint(4, 8)) for _ in range(rng.randint(3, 5))),
    )
    plain = (
        lambda: word() + word() + str(rng.randint(1, 9999)) + word(),
        lambda: "-".join(word() for _ in range(3)) + "-" + str(rng.randint(1900, 2100)),
        lambda: f"{word()}.{word()}.v{rng.randint(1, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}",
        lambda: f"www.{word()}{rng.randint(1, 99)}.com/{word()}/{word()}",
        lambda: f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}",
        lambda: word().upper() + "_" + word().upper() + "_" + str(rng.randint(1, 999)),
        lambda: f"{word()}_{word()}_{rng.randint(1, 99)}_{word()}",
        lambda: "+".join(word() for _ in range(4)) + str(rng.randint(0, 9)),
        lambda: "".join(word() for _ in range(4)),
        lambda: "".join(word() for _ in range(4)).capitalize(),
        lambda: "".join(word() for _ in range(4)).upper(),
        spoken,
        lambda: spoken().capitalize(),
        lambda: "/".join(word() for _ in range(rng.randint(4, 16))),
        lambda: f"www.{word()}.org/" + "/".join(rng.choice((word(), str(rng.randint(1, 2100)))) for _ in range(rng.randint(4, 16))),
        lambda: pick(digit, rng.randint(12, 20)),
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: f"{word()}.{rng.randint(1, 99)}",
        lambda: f"mail{rng.randint(0, 9)}.{word()}.{rng.choice(('com', 'org', 'net'))}",
        lambda: spoken() + str(rng.randint(1, 9999)),
        lambda: spoken() + rng.choice("-_.") + spoken() + rng.choice(("", str(rng.randint(1, 99)))),
        lambda: f"{spoken()}_{rng.randint(1, 99)}_{spoken()}",
        lambda: "".join(x.capitalize() for x in named(rng.randint(2, 5))),
        lambda: "".join(rng.choice(short).capitalize() for _ in range(rng.randint(3, 7))),
        lambda: "".join(x.capitalize() for x in named(rng.randint(2, 4))) + str(rng.randint(1, 2100)),
        lambda: "".join([named(1)[0], *(x.capitalize() for x in named(rng.randint(2, 4)))]),
        lambda: rng.choice("_-./").join(named(rng.randint(3, 7))),
        lambda: rng.choice("_-").join(named(rng.randint(2, 4))) + f"-{rng.randint(1, 400)}." + rng.choice(("json", "java", "txt", "png", "tar.gz", "html")),
        lambda: "".join(named(rng.randint(3, 6))) + rng.choice(("", str(rng.randint(1, 2100)))),
        lambda: f"{named(1)[0]}{rng.randint(0, 9)}.{named(1)[0]}.{rng.choice(('example', 'test', 'local'))}.{rng.choice(('com', 'org', 'net'))}",
        lambda: rng.choice("-=._+/") * rng.randint(12, 60),
    )
    out = []
    for k in range(n):
        label = k % 2
        token = rng.choice(secrets if label else plain)()
        left = " ".join(word() for _ in range(4)) + rng.choice((" ", " = ", ": ", ' "', "\n"))
        out.append((left + token + rng.choice((" ", '"', ".", "\n")) + word(), len(left), len(left) + len(token), label))
    return out


def labelled_windows(documents: DataFrame, doc_id: str, text: str, share: float) -> DataFrame:
    """(label, shape, codes): windows of the findings of a share of the documents, chosen by a hash of id and text.

    Base findings are positives: keys, hexadecimal runs, and the values of long assignments.
    Candidates that ``PLAIN`` knows are negatives. Findings are read where the texts
    are; a row is one window.
    """
    spot = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text), F.lit(3)), F.lit(1 << 30))
    chosen = documents.filter(F.col(text).isNotNull() & (spot < int((1 << 30) * share))).select(F.col(text).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                taken = base_spans(t)
                rows = [(1, a, b) for a, b, kind in taken if kind != "assign"]
                rows += [(1, m.start(2), m.end(2)) for m in ASSIGN.finditer(t) if len(m[2]) >= 16]
                rows += [(0, a, b) for a, b in candidates(t, taken) if PLAIN.fullmatch(t, a, b)]
                # a base finding may hold the whole of a long text; its first windows are enough to learn from
                out = [(y, shape_of(t[a:b]), window(t, at, min(b, at + INSIDE)).tobytes()) for y, a, b in rows for at in window_starts(a, b)[:FIRST_WINDOWS]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["label", "shape", "codes"])

    return chosen.mapInArrow(read, "label int, shape int, codes binary")


def fit_secrets(documents: DataFrame | None, doc_id: str = "doc_id", text: str = "text") -> SecretModel:
    """Fit on generated findings and on those of about FIT_DOCUMENTS documents, FIT_FINDINGS windows of each label at most.

    What comes to the driver are windows of fixed size; which ones is settled by their hashes.
    Without documents, or with an empty table, the generated findings alone are used.
    """
    x, y, shapes = [], [], []
    if documents is not None and (total := documents.count()):
        found = labelled_windows(documents, doc_id, text, min(1.0, FIT_DOCUMENTS / total))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("codes"), "codes")))
        for r in sorted(ranked.filter(F.col("rank") <= FIT_FINDINGS).select("label", "shape", "codes").collect()):
            x.append(np.frombuffer(r["codes"], np.int16))
            y.append(r["label"])
            shapes.append(r["shape"])
    for t, a, b, label in generated_findings(GENERATED):
        for at in window_starts(a, b):
            x.append(window(t, at, min(b, at + INSIDE)))
            y.append(label)
            shapes.append(shape_of(t[a:b]))
    x, y, shapes = np.stack(x), np.array(y, np.float32), np.array(shapes)
    order = np.random.default_rng(1).permutation(len(y))
    check, rest = order[: len(order) // 4], order[len(order) // 4 :]
    model = SecretModel()
    model.fit(x[rest], y[rest])
    model.calibrate(x[check], y[check], shapes[check])
    return model


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def secret_column(spark: SparkSession, model: SecretModel, text: Column) -> Column:
    """All spans (kind, start, end) of a whole text, in code points, by start, then kind."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        model, found, windows, rest, secret = sent.value, [], [], [], set()

        def settle() -> None:
            if windows:
                secret.update(r[:3] for r, s in zip(rest, model.is_secret(np.stack(windows), np.array([r[3] for r in rest])), strict=True) if s)
            windows.clear()
            rest.clear()

        for k, t in enumerate(texts.to_pylist()):
            spans = base_spans(t) if t else []
            found.append(spans)
            for a, b in candidates(t, spans) if t else ():
                shape = shape_of(t[a:b])
                for at in window_starts(a, b):
                    rest.append((k, a, b, shape))
                    windows.append(window(t, at, min(b, at + INSIDE)))
                    if len(windows) >= 4096:
                        settle()
        settle()
        for k, a, b in sorted(secret):
            found[k].append((a, b, "model"))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.array([[{"kind": c, "start": a, "end": b} for a, b, c in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))] for spans in found], kind)

    return run(text)


def scan_secrets(df: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """``df`` with ``secrets``, the spans of :func:`secret_column`.

    A null text is empty and has none. An existing column of that name is replaced; repeated
    rows get the same spans each.
    """
    return df.withColumn("secrets", secret_column(df.sparkSession, model, F.col(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by a mark of its kind; where spans overlap, one mark stands for their union.

    Spans come by start; the text between them and the marks are joined once, in time linear in both.
    """
    @F.arrow_udf("string")
    def cut(texts: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), rows.to_pylist(), strict=True):
            parts, at = [], 0
            for s in found or ():
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[REDACTED:{s['kind']}]"]
                at = max(at, s["end"])
            out.append(t if t is None or not parts else "".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return cut(text, spans)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, fit_secrets(docs))
    base = F.filter("secrets", lambda s: s["kind"] != "model")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
