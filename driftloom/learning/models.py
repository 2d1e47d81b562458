"""Models: factory, search, calibration, nested validation, packaging, prediction. Fits are pyspark.ml's."""

import itertools
import json
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.storage import materialise, scratch_path
from driftloom.operators import neighbours, rollup

from . import curves, forest, prepare
from .boost import Boosted, BoostParams, fit_boosted
from .ranks import with_rank

#: Ranges of hyper-parameters: (low, high) of numbers, whole where both are, or a list of choices.
SPACES: dict[str, dict] = {
    "gbt": {"maxIter": (5, 40), "maxDepth": (2, 6), "stepSize": (0.02, 0.3), "subsamplingRate": (0.6, 1.0)},
    "rf": {"numTrees": (20, 100), "maxDepth": (3, 10), "featureSubsetStrategy": ["auto", "sqrt", "log2"]},
    "lr": {"regParam": (0.0001, 1.0), "elasticNetParam": (0.0, 1.0)},
    "svm": {"regParam": (0.0001, 1.0)},
    "rbf_svm": {"regParam": (0.0001, 1.0), "gamma": (0.001, 1.0)},
    "knn": {"k": (1, 15)},
    "boost": {"trees": (10, 60), "depth": (2, 5), "rate": (0.03, 0.3), "l2": (0.1, 10.0), "columns": (0.5, 1.0)},
}
#: Random features that stand for the kernel of an rbf_svm.
WAVES = 128
_CLASSES = {"gbt": GBTClassifier, "rf": RandomForestClassifier, "lr": LogisticRegression, "svm": LinearSVC}


def make(name: str, features: Sequence[str], params: dict | None = None, weight: str | None = None, seed: int = 1) -> "Pipeline | Knn | Booster":
    """An unfitted model. boost is boost.fit_boosted's. rbf_svm is a linear SVM on random Fourier features (Rahimi and Recht), whose inner products
    come near exp(-gamma |x - y|^2); like knn, it wants scaled features."""
    params = dict(params or {})
    if name == "knn":
        return Knn(list(features), **params)
    if name == "boost":
        return Booster(list(features), BoostParams(**{"seed": seed, **params}), weight)
    extra = {"weightCol": weight} if weight else {}
    if name in ("gbt", "rf"):
        extra["seed"] = seed
    if name == "rbf_svm":
        first = _waves(features, params.pop("gamma", 1.0 / len(features)), seed)
        return Pipeline(stages=[*first, LinearSVC(featuresCol="_x", labelCol="y", **extra, **params)])
    if name not in _CLASSES:
        raise ValueError(f"unknown model {name}: one of {sorted([*_CLASSES, 'boost', 'rbf_svm', 'knn'])}")
    clf = _CLASSES[name](featuresCol="_x", labelCol="y", **extra, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), clf])


def _waves(features: Sequence[str], gamma: float, seed: int) -> list:
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (WAVES, len(features))), rng.uniform(0, 2 * math.pi, WAVES)
    rows = ", ".join("array(" + ", ".join(f"{v!r}D" for v in map(float, [*row, shift])) + ")" for row, shift in zip(w, b))
    x = ", ".join(f"cast(`{f}` as double)" for f in features)
    wave = f"transform(array({rows}), w -> {math.sqrt(2 / WAVES)!r}D * cos(aggregate(zip_with(array({x}, 1.0D), w, (p, q) -> p * q), 0.0D, (s, v) -> s + v)))"
    names = [f"_wave{k}" for k in range(WAVES)]
    each = ", ".join(f"_waves[{k}] AS {n}" for k, n in enumerate(names))
    return [SQLTransformer(statement=f"SELECT *, {wave} AS _waves FROM __THIS__"), SQLTransformer(statement=f"SELECT *, {each} FROM __THIS__"), VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="keep")]


@dataclass
class Knn:
    """k nearest neighbours with a model's surface: its fit keeps the training rows in shared storage."""

    features: list[str]
    k: int = 5
    path: str | None = None

    def fit(self, df: DataFrame) -> "Knn":
        path = scratch_path(df.sparkSession, "knn")
        df.select("y", *self.features).withColumn("_training", F.monotonically_increasing_id()).write.parquet(path)
        return Knn(self.features, self.k, path)

    def score(self, df: DataFrame) -> DataFrame:
        held = materialise(df.withColumn("_query", F.monotonically_increasing_id()), "queries")
        prob = neighbours.knn_scores(held, df.sparkSession.read.parquet(self.path), self.features, "_query", "_training", "y", self.k)
        return held.join(prob, "_query").drop("_query").select(*df.columns, "prob")


@dataclass
class Booster:
    """Second-order boosted trees with a model's surface."""

    features: list[str]
    params: BoostParams
    weight: str | None = None

    def fit(self, df: DataFrame) -> Boosted:
        return fit_boosted(df, self.features, self.params, weight=self.weight)


def score(model: "PipelineModel | Knn | Boosted", df: DataFrame) -> DataFrame:
    """df with prob: the model's probability of 1, or a logistic of its margin where it has none."""
    if isinstance(model, (Knn, Boosted)):
        return model.score(df)
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.withColumn("prob", p).select(*df.columns, "prob")


def sample_params(name: str, seed: int, override: dict | None = None) -> dict:
    """A random point of the model's space; override fixes (a value) or narrows (a range, choices) single ones."""
    rnd, out = random.Random(seed), {}
    for k, space in {**SPACES[name], **(override or {})}.items():
        if isinstance(space, list):
            out[k] = rnd.choice(space)
        elif isinstance(space, tuple):
            low, high = space
            out[k] = rnd.randint(low, high) if isinstance(low, int) and isinstance(high, int) else round(low * (high / low) ** rnd.random(), 6) if low > 0 else round(rnd.uniform(low, high), 6)
        else:
            out[k] = space
    return out


def objective(scored: DataFrame) -> float:
    """Mean of F1 at one half and the area under the ROC curve."""
    scored = materialise(scored.select("y", "prob"), "scores")  # else each pass would score the rows anew
    a = curves.auc(scored.withColumnRenamed("prob", "score")).first()["roc_auc"] or 0.0
    f = curves.metrics(scored.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))).first()["f1"]
    return (a + f) / 2


def seeds(first: int, n: int) -> list[int]:
    """n different seeds from one."""
    rnd = random.Random(first)
    return rnd.sample(range(1 << 30), n)


def with_folds(df: DataFrame, group: str, folds: int, dataset: str | None = None) -> DataFrame:
    s = df.withColumn("_s", prepare.stratum(F.col("y"), F.col(dataset) if dataset else None))
    return df.join(prepare.group_folds(s, group, "_s", folds), group)


def cross_validate(held: DataFrame, name: str, features: Sequence[str], params: dict, folds: int, seed: int = 1) -> list[float]:
    """The objective on each fold of held (its column fold), of models fitted on the others."""
    return [objective(score(make(name, features, params, seed=seed).fit(held.filter(F.col("fold") != k)), held.filter(F.col("fold") == k))) for k in range(folds)]


def _tried(params: dict, values: list[float]) -> dict:
    return {"params": params, "objective": sum(values) / len(values), "folds": values}


def random_search(df: DataFrame, name: str, features: Sequence[str], group: str, calls: int = 10, folds: int = 3, seed: int = 1, override: dict | None = None) -> list[dict]:
    """Parameters and their mean objective over grouped folds, the best first."""
    held = materialise(with_folds(df, group, folds), "folds")
    points = ((s, sample_params(name, s, override)) for s in seeds(seed, calls))
    return sorted((_tried(p, cross_validate(held, name, features, p, folds, s)) for s, p in points), key=lambda t: -t["objective"])


def grid_search(df: DataFrame, name: str, features: Sequence[str], group: str, grid: dict[str, Sequence], folds: int = 3, most: int | None = None, seed: int = 1) -> list[dict]:
    """As random_search() over all points of a grid, or most of them drawn at random."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if most is not None and most < len(points):
        points = random.Random(seed).sample(points, most)
    held = materialise(with_folds(df, group, folds), "folds")
    return sorted((_tried(p, cross_validate(held, name, features, p, folds, seed)) for p in points), key=lambda t: -t["objective"])


def place_params(name: str, params: dict, override: dict | None = None) -> list[float]:
    """A point of the model's space in the unit cube: numbers by their (logarithmic) place in their range, choices by
    their place in the list; fixed ones are left out."""
    out = []
    for k, space in {**SPACES[name], **(override or {})}.items():
        if isinstance(space, list):
            out.append(space.index(params[k]) / max(len(space) - 1, 1))
        elif isinstance(space, tuple):
            low, high = map(float, space)
            v = float(params[k])
            out.append((math.log(v / low) / math.log(high / low) if low > 0 else (v - low) / (high - low)) if high > low else 0.0)
    return out


def expected_improvement(known: np.ndarray, values: np.ndarray, points: np.ndarray, width: float = 0.3, noise: float = 1e-3) -> np.ndarray:
    """How much a Gaussian process through the known values expects each point to exceed the best of them."""
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2) / (2 * width**2))
    scale = values.std() or 1.0
    y = (values - values.mean()) / scale
    inverse = np.linalg.inv(kernel(known, known) + noise * np.eye(len(known)))
    across = kernel(points, known)
    mean, sd = across @ inverse @ y, np.sqrt(np.maximum(1 + noise - ((across @ inverse) * across).sum(axis=1), 1e-12))
    z = (mean - y.max()) / sd
    below = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
    return scale * ((mean - y.max()) * below + sd * np.exp(-z * z / 2) / math.sqrt(2 * math.pi))


def gaussian_search(df: DataFrame, name: str, features: Sequence[str], group: str, calls: int = 10, folds: int = 3, seed: int = 1, override: dict | None = None, start: int = 5, candidates: int = 500) -> list[dict]:
    """As random_search(): the first start points are random, then each is, of random candidates, the one of the greatest
    expected improvement under a Gaussian process."""
    held = materialise(with_folds(df, group, folds), "folds")
    tried: list[dict] = []
    for n, s in enumerate(seeds(seed, calls)):
        params = sample_params(name, s, override)
        if n >= start and place_params(name, params, override):
            options = [sample_params(name, c, override) for c in seeds(s, candidates)]
            place = lambda all_: np.array([place_params(name, p, override) for p in all_])
            gain = expected_improvement(place([t["params"] for t in tried]), np.array([t["objective"] for t in tried]), place(options))
            params = options[int(np.argmax(gain))]
        tried.append(_tried(params, cross_validate(held, name, features, params, folds, s)))
    return sorted(tried, key=lambda t: -t["objective"])


SEARCHES = {"random": random_search, "gaussian": gaussian_search}


def combine_params(tried: Sequence[dict], how: str = "best", share: float = 0.1) -> dict:
    """One set from many: the best, or the plain or objective-weighted mean of the best share (whole numbers rounded,
    choices by the most frequent)."""
    ranked = sorted(tried, key=lambda t: -t["objective"])
    if how == "best":
        return ranked[0]["params"]
    top = ranked[: max(1, round(share * len(ranked)))] if how == "top" else ranked
    weight = [t["objective"] if how == "weighted" else 1.0 for t in top]
    out = {}
    for k, v in top[0]["params"].items():
        values = [t["params"][k] for t in top]
        if isinstance(v, str):
            out[k] = max(sorted(set(values)), key=values.count)
        else:
            mean = sum(w * x for w, x in zip(weight, values)) / sum(weight)
            out[k] = round(mean) if isinstance(v, int) else round(mean, 6)
    return out


# --- calibration


@dataclass
class Calibrator:
    """Maps scores to probabilities: a logistic line or a step function."""

    kind: str
    a: float = 1.0
    b: float = 0.0
    at: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def apply(self, df: DataFrame, col: str = "prob") -> DataFrame:
        if self.kind == "sigmoid":
            p = F.least(F.greatest(F.col(col), F.lit(1e-6)), F.lit(1 - 1e-6))
            return df.withColumn(col, 1 / (1 + F.exp(-(self.a * F.ln(p / (1 - p)) + self.b))))
        if not self.at:
            return df
        at, value = np.array(self.at), np.array(self.value)

        @F.pandas_udf("double")
        def steps(x: pd.Series) -> pd.Series:
            # The last step at or under the score, found by halving: a list as an expression is passed whole for each row.
            q = x.to_numpy(np.float64)
            k = np.searchsorted(at, q, side="right")
            a, b = np.clip(k - 1, 0, len(at) - 1), np.clip(k, 0, len(at) - 1)
            span = at[b] - at[a]
            line = value[a] + np.divide((q - at[a]) * (value[b] - value[a]), span, out=np.zeros(len(q)), where=span > 0)
            return pd.Series(np.where(k == 0, value[0], np.where(k == len(at), value[-1], line)))

        x = F.col(col).cast("double")
        return df.withColumn(col, F.when(x.isNotNull(), steps(x)))


def fit_calibrator(scored: DataFrame, kind: str = "sigmoid", col: str = "prob") -> Calibrator:
    """Platt's logistic on the log-odds with smoothed targets, or isotonic regression."""
    # Equal scores are one row with its weights, which fits the same.
    each = scored.groupBy(F.col(col).alias("p")).agg(F.sum("y").cast("double").alias("ones"), F.count("y").cast("double").alias("n"))
    each = materialise(each.filter("p IS NOT NULL AND n > 0"), "scores")
    if kind == "isotonic":
        m = IsotonicRegression(featuresCol="p", labelCol="rate", weightCol="n").fit(each.withColumn("rate", F.col("ones") / F.col("n")))
        return Calibrator("isotonic", at=[float(x) for x in m.boundaries], value=[float(x) for x in m.predictions])
    n = each.agg(F.sum("ones").alias("p"), F.sum("n").alias("n")).first()
    p1, p0 = (n["p"] + 1) / (n["p"] + 2), 1 / (n["n"] - n["p"] + 2)
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    # A smoothed target is the row twice, as 1 and as 0, by its weights.
    rows = each.select(F.ln(p / (1 - p)).alias("s"), "n", (F.col("ones") * p1 + (F.col("n") - F.col("ones")) * p0).alias("t"))
    both = rows.select("s", F.lit(1.0).alias("y"), F.col("t").alias("w")).unionByName(rows.select("s", F.lit(0.0).alias("y"), (F.col("n") - F.col("t")).alias("w")))
    m = make("lr", ["s"], {"regParam": 0.0}, weight="w").fit(both).stages[-1]
    return Calibrator("sigmoid", a=float(m.coefficients[0]), b=float(m.intercept))


# --- validation and packages


@dataclass
class Package:
    """A model with all that a prediction needs."""

    model: PipelineModel
    features: list[str]
    calibrator: dict | None
    threshold: float
    name: str
    params: dict

    def save(self, path: str) -> None:
        """The model by its own writer and a side-car of JSON; what the path held moves to <path>.back."""
        spark = SparkSession.active()
        to = spark._jvm.org.apache.hadoop.fs.Path
        fs = to(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(to(path)):
            fs.delete(to(f"{path}.back"), True)
            fs.rename(to(path), to(f"{path}.back"))
        self.model.write().overwrite().save(f"{path}/model")
        side = {k: getattr(self, k) for k in ("features", "calibrator", "threshold", "name", "params")}
        spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/side")


def load_package(path: str) -> Package:
    side = json.loads(SparkSession.active().read.text(f"{path}/side").first()["value"])
    return Package(model=PipelineModel.load(f"{path}/model"), **side)


def out_of_fold(df: DataFrame, name: str, features: Sequence[str], group: str, params: dict | None = None, folds: int = 3, seed: int = 1, synthetic: str | None = None) -> tuple[DataFrame, list]:
    """Scores (group, y, fold, prob) of grouped folds by models that didn't see them, and those models. synthetic names a
    column of made rows, which train but aren't scored."""
    held = materialise(with_folds(df, group, folds), "folds")
    fitted, parts = [], None
    for k in range(folds):
        seen = held.filter(F.col("fold") != k)
        unseen = held.filter((F.col("fold") == k) & ~F.col(synthetic)) if synthetic else held.filter(F.col("fold") == k)
        fitted.append(make(name, features, params, seed=seed).fit(seen))
        one = score(fitted[-1], unseen).select(group, "y", "fold", "prob")
        parts = one if parts is None else parts.unionByName(one)
    return materialise(parts, "scores"), fitted


def choose_threshold(scored: DataFrame, threshold: str) -> float:
    """A fixed number, one half ('default'), or the best of the curves of prob and y ('f1', 'roc', 'pr')."""
    fixed = curves.parse_threshold(threshold)
    if fixed is None:
        fixed = 0.5 if threshold == "default" else curves.operating_point(scored.withColumnRenamed("prob", "score"), threshold).first()["threshold"]
    return float(fixed)


def train_package(df: DataFrame, name: str, features: Sequence[str], group: str, params: dict | None = None, calibrate: str | None = "sigmoid", threshold: str = "f1", folds: int = 3) -> Package:
    """Fit on all rows; the calibrator and the threshold come from scores of grouped folds that the models didn't see."""
    scores, _ = out_of_fold(df, name, features, group, params, folds)
    cal = fit_calibrator(scores, calibrate) if calibrate else None
    if cal:
        scores = cal.apply(scores)
    return Package(make(name, features, params).fit(df), list(features), asdict(cal) if cal else None, choose_threshold(scores, threshold), name, params or {})


@dataclass
class Ensemble:
    """Models of grouped folds, each calibrated on the fold that it didn't see; their mean is the probability."""

    models: list
    calibrators: list[Calibrator]

    def score(self, df: DataFrame) -> DataFrame:
        held = df.withColumn("_row", F.monotonically_increasing_id())
        held, parts = materialise(held, "rows"), None
        for model, cal in zip(self.models, self.calibrators):
            one = cal.apply(score(model, held)).select("_row", "prob")
            parts = one if parts is None else parts.unionByName(one)
        return held.join(parts.groupBy("_row").agg(F.avg("prob").alias("prob")), "_row").drop("_row")


def train_ensemble(df: DataFrame, name: str, features: Sequence[str], group: str, params: dict | None = None, calibrate: str = "sigmoid", folds: int = 3, seed: int = 1, synthetic: str | None = None, weight: str | None = None) -> Ensemble:
    """An ensemble over grouped folds. Rows marked synthetic train but never calibrate; weight names a column of weights
    that the models are fitted with."""
    held = materialise(with_folds(df, group, folds), "folds")
    fitted, cals = [], []
    for k in range(folds):
        unseen = held.filter(F.col("fold") == k)
        unseen = unseen.filter(~F.col(synthetic)) if synthetic else unseen
        fitted.append(make(name, features, params, weight, seed).fit(held.filter(F.col("fold") != k)))
        cals.append(fit_calibrator(materialise(score(fitted[-1], unseen).select("y", "prob"), "scores"), calibrate))
    return Ensemble(fitted, cals)


def predict(package: Package, df: DataFrame, level: str = "night", subject: str = "id") -> DataFrame:
    """Nights with prob and pred (at or above the threshold), or patients with means and votes (strictly above)."""
    scored = score(package.model, df)
    if package.calibrator:
        scored = Calibrator(**package.calibrator).apply(scored)
    nights = scored.withColumn("pred", (F.col("prob") >= package.threshold).cast("int"))
    if level == "night":
        return nights
    truth = nights if "y" in nights.columns else nights.withColumn("y", F.lit(None).cast("int"))
    summed = truth.groupBy(subject).agg(F.avg("prob").alias("mean_prob_per_night"), F.sum("pred").cast("long").alias("sum_nights_pred"), F.count("*").alias("n_total_nights"), F.max("y").alias("ground_truth"))
    return rollup.patient_votes(summed, package.threshold)


ROW = "repeat int, fold int, kind string, threshold double, roc_auc double, average_precision double, " + ", ".join(f"{c} double" for c in curves.METRICS) + ", params string"


def nested_validation(df: DataFrame, name: str, features: Sequence[str], group: str, outer: int = 3, inner: int = 2, calls: int = 3, repeats: int = 1, seed: int = 1, search: str = "random", calibrate: str | None = "sigmoid", threshold: str = "f1", manifest: str | None = None, progress: Callable[[dict], None] | None = None, done: Sequence[dict] = ()) -> DataFrame:
    """A row for each repeat, outer fold and model on the unseen fold: threshold, AUC and metrics.

    'default' has the default parameters and a threshold of one half; 'searched' has the parameters that the search
    found on inner folds, and a calibrator and threshold from its inner out-of-fold scores. Each row is added to the
    manifest as it is made, if there is a path for one, and given to progress; a run that was broken off goes on from its
    manifest, or from rows given as done."""
    spark, rows = df.sparkSession, list(done)
    if manifest and _exists(spark, manifest):
        rows += [r.asDict() for r in spark.read.schema(ROW).json(manifest).collect()]  # a row for each fold and model
    have = {(x["repeat"], x["fold"], x["kind"]) for x in rows}
    for r, s in enumerate(seeds(seed, repeats)):
        held = materialise(with_folds(df.withColumn("_r", F.lit(s)), group, outer), "outer").drop("_r")
        for k in range(outer):
            if {(r, k, "default"), (r, k, "searched")} <= have:
                continue
            train, test = held.filter(F.col("fold") != k).drop("fold"), held.filter(F.col("fold") == k).drop("fold")
            for kind in ("default", "searched"):
                if (r, k, kind) in have:
                    continue
                params, cal, cut = {}, None, 0.5
                if kind == "searched":
                    params = SEARCHES[search](train, name, features, group, calls, inner, s + k)[0]["params"]
                    inside, _ = out_of_fold(train, name, features, group, params, inner, s)
                    cal = fit_calibrator(inside, calibrate) if calibrate else None
                    cut = choose_threshold(cal.apply(inside) if cal else inside, threshold)
                got = score(make(name, features, params, seed=s).fit(train), test)
                got = materialise((cal.apply(got) if cal else got).select("y", "prob"), "scores")
                m = curves.metrics(got.withColumn("pred", (F.col("prob") >= cut).cast("int"))).first()
                a = curves.auc(got.withColumnRenamed("prob", "score")).first()
                row = {"repeat": r, "fold": k, "kind": kind, "threshold": cut, "roc_auc": a["roc_auc"], "average_precision": a["average_precision"], **{c: m[c] for c in curves.METRICS}, "params": json.dumps(params)}
                rows.append(row)
                if manifest:
                    spark.createDataFrame([tuple(row.values())], ROW).coalesce(1).write.mode("append").json(manifest)
                if progress:
                    progress(row)
    names = [f.split()[0] for f in ROW.split(", ")]
    return spark.createDataFrame([tuple(x[n] for n in names) for x in rows], ROW)


def _exists(spark: SparkSession, path: str) -> bool:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(to))


def searched_params(results: DataFrame) -> DataFrame:
    """repeat, fold, name, value: the parameters that each outer fold's search chose, as numbers or texts."""
    values = F.explode(F.from_json("params", "map<string,string>")).alias("name", "value")
    return results.filter("kind = 'searched'").select("repeat", "fold", values)


def final_params(df: DataFrame, name: str, features: Sequence[str], group: str, calls: int = 10, folds: int = 3, repeats: int = 1, seed: int = 1, search: str = "random", how: str = "best") -> dict:
    """Parameters for a model of all rows: the searches of several repeats over the whole table, made one by how."""
    tried = [t for s in seeds(seed, repeats) for t in SEARCHES[search](df, name, features, group, calls, folds, s)]
    return combine_params(tried, how)


def summarise_validation(results: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric of each kind of model over folds."""
    names = ["roc_auc", "average_precision", *curves.METRICS]
    return results.groupBy("kind").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))


def binomial_tail(hits: int, rounds: int) -> float:
    """The chance of so many hits or more, if each round were a toss."""
    return sum(math.comb(rounds, k) for k in range(hits, rounds + 1)) / 2**rounds


def importance_rank(df: DataFrame, features: Sequence[str], rounds: int = 10, seed: int = 1, level: float = 0.05) -> DataFrame:
    """feature, hits, state, rank: how often a forest finds a feature more important than every shuffled copy of all, and
    whether that is more ('confirmed') or less ('rejected') than tosses would give, at the level over all features
    (Boruta); 'tentative' otherwise.

    A copy holds the features of another row, drawn without replacement within blocks of rows in a random order; the label
    stays."""
    spark = df.sparkSession
    blocks, hits = forest.make_blocks(df, features, seed), dict.fromkeys(features, 0)
    for s in seeds(seed, rounds):
        m = forest.importances(blocks, s)
        top = max(m[len(features) :])
        for f, v in zip(features, m):
            hits[f] += int(v > top)
    sure = level / len(features)
    state = {f: "confirmed" if binomial_tail(h, rounds) <= sure else "rejected" if binomial_tail(rounds - h, rounds) <= sure else "tentative" for f, h in hits.items()}
    table = spark.createDataFrame([(f, h, state[f]) for f, h in hits.items()], "feature string, hits int, state string")
    return with_rank(table, "hits", "max", descending=True)
