"""Language ID: multinomial logistic regression on TF-IDF character n-grams, by follow-the-regularised-leader."""

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    """per_label bounds the training sample: about that many documents of each language, chosen by a hash of the id."""

    dims: int = 1 << 16
    longest: int = 3
    per_label: int = 1500
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.001
    calibration: float = 0.2


def _letter_table() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a mark (which belongs to words, but makes none), else 0."""
    import unicodedata

    return np.array([2 * (kind == "L") + (kind == "M") for kind in (unicodedata.category(chr(c))[0] for c in range(0x110000))], np.uint8)


class Grams:
    """Hashed character n-grams of a text: letters lower-cased, anything between words one space."""

    def __init__(self, dims: int, longest: int):
        self.dims, self.longest, self.letters = dims, longest, _letter_table()

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams' slots, ascending, and how often each occurs; none if the text has no letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.letters[codes]
        letter = kind > 0
        if not (kind == 2).any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        line = np.where(letter, codes, 32)
        line = np.concatenate([[32], line, [32]])
        line = line[np.append(True, (line[1:] != 32) | (line[:-1] != 32))].astype(np.uint64)
        found, h = [], np.zeros(len(line), np.uint64)
        for n in range(self.longest):
            if n >= len(line):
                break
            h = h[: len(line) - n] * np.uint64(0x100000001B3) + line[n:] + np.uint64(n + 1)
            found.append((mix(h) >> np.uint64(32)).astype(np.int64) % self.dims)
        full = np.bincount(np.concatenate(found), minlength=self.dims)
        slots = np.flatnonzero(full)
        return slots, full[slots]

    def weights(self, text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF of length one: (1 + ln count) * idf."""
        slots, n = self.counts(text)
        value = (1 + np.log(n)) * idf[slots]
        size = np.sqrt((value * value).sum())
        return slots, (value / size if size else value).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes, dims) and biases by per-coordinate FTRL-proximal with elastic net, an example at a time."""
    z, n = np.zeros((classes, p.dims + 1)), np.zeros((classes, p.dims + 1))

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    rng = np.random.default_rng(1)
    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            slots, value = np.append(rows[k][0], p.dims), np.append(rows[k][1], np.float32(1.0))
            zz, nn = z[:, slots], n[:, slots]
            w = solve(zz, nn, p.l1)
            error = softmax(w @ value)
            error[labels[k]] -= 1
            g = error[:, None] * value[None]
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / p.alpha
            z[:, slots] = zz + g - sigma * w
            n[:, slots] = nn + g * g
    w = solve(z, n, p.l1)
    return w[:, :-1].astype(np.float32), w[:, -1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search over its logarithm.

    Targets are smoothed by 1 in n + 2, else logits that tell all n labels apart would be scaled up without end."""
    n, classes = logits.shape
    target = np.full((n, classes), 1 / (n + 2) / max(classes - 1, 1))
    target[np.arange(n), labels] = 1 - 1 / (n + 2)

    def loss(t):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-30))).sum(axis=1).mean()

    low, high, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def sample_share(key: str, seed: int):
    """A number in [0, 1) from a hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / F.lit(float(1 << 53))


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    params: LanguageParams


def train_language(rows: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit on rows of (id, text, label) with a label.

    Document frequencies count every row's whole text; the weights are fitted in one task on the sample, the temperature
    on a share of it that the weights don't see. Rows without a letter teach nothing. Without rows the model has no
    labels."""
    p = params
    spark = rows.sparkSession

    def document_frequency(batches):
        grams, total, n = Grams(p.dims, p.longest), np.zeros(p.dims, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                slots, _ = grams.counts(text)
                total[slots] += 1
                n += len(slots) > 0
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(total[slots], n))], ["slot", "n"])

    # At most dims + 1 rows, whatever the table's size.
    df = rows.select("text").mapInArrow(document_frequency, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    seen = {r["slot"]: r["n"] for r in df}
    total = seen.pop(-1, 0)
    idf = np.full(p.dims, np.log(1.0 + total))
    idf[list(seen)] = np.log((1.0 + total) / (1.0 + np.array(list(seen.values()), np.float64))) + 1e-3
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return LanguageModel([], idf, np.zeros((0, p.dims), np.float32), np.zeros(0), 1.0, p)
    share = F.create_map(*(F.lit(x) for k in labels for x in (k, min(1.0, p.per_label / counts[k]))))[F.col("label")]
    code = F.create_map(*(F.lit(x) for i, k in enumerate(labels) for x in (k, i)))[F.col("label")]
    picked = rows.withColumn("draw", sample_share("id", 6)).filter(F.col("draw") < share).select("id", "text", code.alias("label"))

    def features(batches):
        grams = Grams(p.dims, p.longest)
        for batch in batches:
            pairs = [grams.weights(t, idf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([s.astype(np.int32) for s, _ in pairs], pa.list_(pa.int32())), pa.array([v for _, v in pairs], pa.list_(pa.float32()))], ["id", "label", "slots", "vals"])

    def fit(batches):
        ids, ys, xs = [], [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            ys += batch.column("label").to_pylist()
            xs += [(s.values.to_numpy().astype(np.int64), v.values.to_numpy()) for s, v in zip(batch.column("slots"), batch.column("vals"))]
        order = [k for k in sorted(range(len(ids)), key=lambda k: (ids[k], ys[k])) if len(xs[k][0])]
        order = np.random.default_rng(2).permutation(np.array(order, np.int64))
        xs, ys = [xs[k] for k in order], np.array([ys[k] for k in order], np.int64)
        apart = int(len(xs) * p.calibration)
        w, bias = fit_ftrl(xs[apart:], ys[apart:], len(labels), p)
        logits = np.array([w[:, s] @ v + bias for s, v in xs[:apart]]).reshape(apart, len(labels))
        t = fit_temperature(logits, ys[:apart]) if apart else 1.0
        out = io.BytesIO()
        np.savez_compressed(out, w=w, bias=bias, t=t)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    kind = picked.schema["id"].dataType.simpleString()
    got = picked.mapInArrow(features, f"id {kind}, label int, slots array<int>, vals array<float>").repartition(1).mapInArrow(fit, "model binary").first()
    if got is None:
        return LanguageModel([], idf, np.zeros((0, p.dims), np.float32), np.zeros(0), 1.0, p)
    m = np.load(io.BytesIO(bytes(got["model"])))
    return LanguageModel(labels, idf, m["w"], m["bias"], float(m["t"]), p)


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score (the calibrated probability of lang_pred) of each whole text.

    A text that is null or has no letter is "und" with score 0, as all are under a model without labels. Columns of docs
    with the new names are replaced; an empty table gives an empty result."""
    own = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    labels, idf, w, bias, t, p = model.labels, model.idf.astype(np.float32), np.ascontiguousarray(model.weights.T), model.bias, model.temperature, model.params

    def run(batches):
        grams = Grams(p.dims, p.longest)
        for batch in batches:
            names, scores = [], []
            for text in batch.column(text_col).to_pylist():
                slots, value = grams.weights(text, idf)
                if not len(slots) or not labels:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                q = softmax((value @ w[slots] + bias) / t)
                k = int(q.argmax())
                names.append(labels[k])
                scores.append(float(q[k]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*own, "lang_pred", "lang_score"])
            pa.default_memory_pool().release_unused()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in own)).schema]
    return docs.select(*(F.col(f"`{c}`") for c in own)).mapInArrow(run, ", ".join([*fields, "lang_pred string", "lang_score double"]))


def train_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows a model may learn from: a known language, and crc32 of the id as text not 1 modulo 3."""
    rows = docs.filter((F.crc32(F.col(id_col).cast("string")) % 3 != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))


def keep_identified(docs: DataFrame, min_score: float = 0.3, params: LanguageParams = LanguageParams()) -> DataFrame:
    """docs whose language is told: not undetermined, and with a score of min_score or more. All columns stay as they are.

    The model is trained on docs' own labelled rows; without any, or without letters, nothing is told and all rows go."""
    aside = {c: f"_driftloom_{c}" for c in docs.columns if c in ("lang_pred", "lang_score")}
    found = identify_language(docs.withColumnsRenamed(aside), train_language(train_rows(docs), params))
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= min_score)).drop("lang_pred", "lang_score")
    return kept.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)
