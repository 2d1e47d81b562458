"""Quality classifier by positive-unlabelled learning with a non-negative risk."""

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix
from .language import sample_share


@dataclass(frozen=True)
class QualityParams:
    """positives and unlabelled bound the samples the fit uses: about that many documents of each, by a hash of the id.

    The rest counts and scores all documents. slack: how far below zero the risk of the unlabelled may fall."""

    positives: int = 3000
    unlabelled: int = 9000
    shapes: int = 256
    epochs: int = 60
    batch: int = 512
    rate: float = 0.02
    decay: float = 1e-4
    slack: float = 0.05


def _class_table() -> np.ndarray:
    """A character's class: ASCII marks stand for themselves, letters by case, digits, spaces, line ends, anything else."""
    import unicodedata

    kinds = {"Lu": 1, "Lt": 1, "Ll": 2, "Lo": 2, "Lm": 2, "Nd": 3}
    out = np.zeros(0x20000, np.uint64)
    for c in range(0x20000):
        kind = unicodedata.category(chr(c))
        out[c] = 5 if c == 10 else 4 if chr(c).isspace() else kinds.get(kind, c if 32 < c < 127 else 6)
    return out


class Style:
    """What a text looks like, whatever its language: shares of kinds of characters, words and lines, and the shapes of
    character triples."""

    #: Measures before the shapes.
    MEASURES = 18

    def __init__(self, shapes: int):
        self.shapes, self.classes = shapes, _class_table()

    def of(self, text: str | None) -> np.ndarray:
        text = text or ""
        out = np.zeros(self.MEASURES + self.shapes, np.float32)
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x1FFFF)
        kind = self.classes[codes]
        n = max(len(kind), 1)
        words, lines = text.split(), text.split("\n")
        m = max(len(words), 1)
        share = lambda x: float(np.count_nonzero(x)) / n
        letters = np.count_nonzero((kind == 1) | (kind == 2))
        marks = (kind > 6) & ~np.isin(kind, (46, 44))
        sizes = [len(w) for w in words]
        same = sum(a == b for a, b in zip(words, words[1:]))
        starts = [x.lstrip()[:1] for x in lines if x.strip()]
        out[: self.MEASURES] = (
            np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), letters / n, float(np.count_nonzero(kind == 1)) / max(letters, 1), share(kind == 3), share(marks), share(kind == 33), share(kind == 124), share((kind == 46) | (kind == 44)), share(kind == 6),
            len(set(words)) / m, same / m, sum(sizes) / m, (max(sizes) if sizes else 0) / (sum(sizes) + 1), sum(w[-1] not in ".,;:" and not w[-1].isalnum() for w in words) / m, sum(s.isupper() for s in starts) / max(len(starts), 1), len(set(lines)) / len(lines),
        )
        if len(kind) > 2:
            slot = (mix(kind[:-2] * np.uint64(1000003) + kind[1:-1] * np.uint64(1009) + kind[2:]) >> np.uint64(40)).astype(np.int64) % self.shapes
            out[self.MEASURES :] = np.sqrt(np.bincount(slot, minlength=self.shapes) / len(slot))
        return out


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, p: QualityParams) -> tuple[np.ndarray, float]:
    """A linear scorer of least non-negative unbiased risk with the logistic loss, by Adam.

    The risk is prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]). Where a batch's second part falls below
    -slack, the step goes up that part instead, so that the classifier can't fit the unlabelled away."""
    rng = np.random.default_rng(3)
    d = xp.shape[1]
    w, m, v, t = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1), 0
    xp, xu = np.hstack([xp, np.ones((len(xp), 1))]), np.hstack([xu, np.ones((len(xu), 1))])
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    steps = max(1, -(-max(len(xp), len(xu)) // p.batch))
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs) + 1e-4
        for _ in range(steps):
            a, b = xp[rng.integers(0, len(xp), p.batch)], xu[rng.integers(0, len(xu), p.batch)]
            sa, sb = sigmoid(a @ w), sigmoid(b @ w)
            negative = np.logaddexp(0, b @ w).mean() - prior * np.logaddexp(0, a @ w).mean()
            plus = prior * ((sa - 1) @ a) / len(a)
            minus = (sb @ b) / len(b) - prior * (sa @ a) / len(a)
            g = plus + minus if negative >= -p.slack else -minus
            g[:-1] += p.decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, by best bin estimation (Garg and others, 2021).

    Both are scores, of texts that the scorer wasn't fitted on, by a scorer of positives against unlabelled. Above any
    threshold, the unlabelled's share over the positives' share bounds the prior from above; of all thresholds that one is
    taken whose bound, with a term for the samples' sizes, is the least."""
    cuts = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / len(x)
    p, u = above(positive), above(unlabelled)
    noise = np.sqrt(np.log(4 / delta) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / delta) / (2 * len(positive)))
    best = int(np.argmin((u + (1 + gamma) * noise) / p))
    return float(u[best] / p[best])


def fit_with_prior(xp: np.ndarray, xu: np.ndarray, p: QualityParams) -> tuple[np.ndarray, float, float]:
    """Weights, bias and the class prior, which is estimated first.

    Halves take turns in fitting a scorer of positives against unlabelled (the same risk, at first with a prior of a half,
    then with the first estimate) and being scored by it. The prior is the estimates' mean less the standard error of a
    share of so many unlabelled, within 0.05 and 0.98: one too high harms the fit more than one as much too low."""
    if min(len(xp), len(xu)) < 2:
        return *fit_nnpu(xp, xu, 0.5, p), 0.5
    prior = 0.5
    for _ in range(2):
        found = []
        for k in (0, 1):
            w, bias = fit_nnpu(xp[k::2], xu[k::2], prior, p)
            found.append(estimate_prior(xp[1 - k :: 2] @ w + bias, xu[1 - k :: 2] @ w + bias))
        prior = float(np.clip(np.mean(found), 0.05, 0.98))
    prior = max(0.05, prior - float(np.sqrt(prior * (1 - prior) / len(xu))))
    return *fit_nnpu(xp, xu, prior, p), prior


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    params: QualityParams


def train_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Fit on (id, text) and (id, label 0 or 1).

    Positives are documents whose labels are all 1, the unlabelled are drawn from all of docs; labels of 0 are not used.
    The class prior is estimated from the two, see fit_with_prior(). Without positives or documents the model scores
    everything at 0.5."""
    p = params
    known = labels.filter(F.col("label").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.min("label").alias("label"))
    ones = known.filter("label = 1").count()
    width = Style.MEASURES + p.shapes
    zero = QualityModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5, p)
    total = docs.count()
    if not ones or not total:
        return zero
    # The drawn labels are about p.positives rows, whatever the table's size.
    drawn = known.filter((F.col("label") == 1) & (sample_share("id", 10) < min(1.0, p.positives / ones))).select(F.col("id").alias("_id"))
    trusted = docs.join(F.broadcast(drawn), F.col("id") == F.col("_id")).select("id", "text", F.lit(1).alias("trusted"))
    web = docs.filter(sample_share("id", 11) < min(1.0, p.unlabelled / total)).select("id", "text", F.lit(0).alias("trusted"))

    def features(batches):
        style = Style(p.shapes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("trusted"), pa.array([style.of(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float32()))], ["id", "trusted", "x"])

    def fit(batches):
        ids, flags, xs = [], [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            flags += batch.column("trusted").to_pylist()
            xs += [x.values.to_numpy() for x in batch.column("x")]
        order = sorted(range(len(ids)), key=lambda k: (flags[k], ids[k] is None, ids[k] or 0))
        x, flag = np.array([xs[k] for k in order], np.float64).reshape(len(order), width), np.array([flags[k] for k in order])
        if not (flag == 1).any() or not (flag == 0).any():
            return
        mean, scale = x[flag == 0].mean(axis=0), x[flag == 0].std(axis=0) + 1e-3
        x = np.clip((x - mean) / scale, -8, 8)
        w, bias, prior = fit_with_prior(x[flag == 1], x[flag == 0], p)
        out = io.BytesIO()
        np.savez_compressed(out, mean=mean, scale=scale, w=w, bias=bias, prior=prior)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = trusted.unionByName(web).mapInArrow(features, f"id {kind}, trusted int, x array<float>")
    got = rows.repartition(1).mapInArrow(fit, "model binary").first()
    if got is None:
        return zero
    m = np.load(io.BytesIO(bytes(got["model"])))
    return QualityModel(m["mean"], m["scale"], m["w"], float(m["bias"]), float(m["prior"]), p)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with quality_score, the modelled probability that a text is of quality; null and empty texts too.

    A column of docs of that name is replaced; an empty table gives an empty result."""
    own = [c for c in docs.columns if c != "quality_score"]
    m = model

    def run(batches):
        style = Style(m.params.shapes)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            score = np.zeros(0)
            if texts:
                x = np.clip((np.array([style.of(t) for t in texts], np.float64) - m.mean) / m.scale, -8, 8)
                score = 1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(score, pa.float64())], [*own, "quality_score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in own)).schema]
    return docs.select(*(F.col(f"`{c}`") for c in own)).mapInArrow(run, ", ".join([*fields, "quality_score double"]))
