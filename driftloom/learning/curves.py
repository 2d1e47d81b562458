"""ROC and precision-recall curves, thresholds and metrics of scored rows (score, y)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running

METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1")


def curve(df: DataFrame, score: str = "score", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """A row for each score as a threshold (predicted 1: score at least that): tp, fp, tpr, fpr, precision."""
    t = running(df, score, {"ones": F.sum(F.col(y).cast("long")), "n": F.count("*")}, keys, descending=True)
    totals = df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.sum(F.col(y).cast("long")).alias("_p"), F.count("*").alias("_n"))
    t = t.join(totals, list(keys)) if keys else t.crossJoin(F.broadcast(totals))  # one row
    tp, fp = F.col("cum_ones"), F.col("cum_n") - F.col("cum_ones")
    return t.select(*keys, F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"), F.try_divide(tp, F.col("_p")).alias("tpr"), F.try_divide(fp, F.col("_n") - F.col("_p")).alias("fpr"), (tp / (tp + fp)).alias("precision"), "_p", "_n")


def roc_curve(df: DataFrame, **names) -> DataFrame:
    return curve(df, **names).select(*names.get("keys", ()), "threshold", "tpr", "fpr")


def pr_curve(df: DataFrame, **names) -> DataFrame:
    return curve(df, **names).select(*names.get("keys", ()), "threshold", "precision", F.col("tpr").alias("recall"))


def auc(df: DataFrame, score: str = "score", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (the share of pairs in order, ties half) and average precision."""
    t = running(df, score, {"ones": F.sum(F.col(y).cast("long")), "n": F.count("*")}, keys, descending=True)
    zeros = F.col("n") - F.col("ones")
    above = F.col("cum_ones") - F.col("ones")
    group = t.groupBy(*keys)
    s = group.agg(F.sum(zeros * above + zeros * F.col("ones") / 2).alias("_u"), F.sum("ones").alias("_p"), F.sum(zeros).alias("_q"), F.sum(F.col("ones") * F.col("cum_ones") / F.col("cum_n")).alias("_a"))
    return s.select(*keys, F.try_divide("_u", F.col("_p") * F.col("_q")).alias("roc_auc"), F.try_divide("_a", "_p").alias("average_precision"))


def operating_point(df: DataFrame, kind: str = "roc", score: str = "score", y: str = "y") -> DataFrame:
    """The threshold nearest (0, 1) on the ROC curve ('roc'), nearest (1, 1) on precision-recall ('pr'), or of the highest
    F1 ('f1'); of equals the highest."""
    c = curve(df, score, y)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr")), F.lit(0.0))
    cost = {"roc": F.sqrt(F.pow("fpr", F.lit(2)) + F.pow(1 - F.col("tpr"), 2)), "pr": F.sqrt(F.pow(1 - F.col("precision"), 2) + F.pow(1 - F.col("tpr"), 2)), "f1": -f1}[kind]
    best = c.agg(F.min(F.struct(F.round(cost, 12).alias("cost"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), F.abs("b.cost").alias("value"))


def macro_threshold(df: DataFrame, group: str, score: str = "score", y: str = "y", steps: int = 400, more: Sequence[float] = ()) -> DataFrame:
    """The threshold of an even grid (and more) with the highest mean balanced accuracy over groups, the lowest of equals.

    Rows are counted into the grid's cells first, so the grid (bounded) meets counts and not rows."""
    cell = F.greatest(F.least(F.floor(F.round(F.col(score) * steps, 9)), F.lit(steps)), F.lit(-1)).cast("int")  # the last grid line at or under the score
    counts = df.groupBy(group, cell.alias("cell")).agg(F.sum(F.col(y).cast("long")).alias("p"), (F.count("*") - F.sum(F.col(y).cast("long"))).alias("q"))
    line = counts.select(group, "cell", "p", "q", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    per = line.groupBy(group, "k").agg(F.sum(F.when(F.col("cell") >= F.col("k"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("cell") < F.col("k"), F.col("q")).otherwise(0)).alias("tn"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    ba = per.filter("p > 0 and q > 0").groupBy("k").agg(F.avg((F.col("tp") / F.col("p") + F.col("tn") / F.col("q")) / 2).alias("ba"))
    best = ba.agg(F.max(F.struct(F.round("ba", 9).alias("ba"), (-F.col("k")).alias("k"))).alias("b"))
    return best.select((-F.col("b.k") / float(steps)).alias("threshold"), F.col("b.ba").alias("balanced_accuracy"))


def parse_threshold(name: str) -> float | None:
    """'0.42', 'fixed:0.42' and 'fixed_0.42' are 0.42; a method's name is None."""
    text = name.strip().removeprefix("fixed").lstrip(":_")
    try:
        return float(text)
    except ValueError:
        return None


def counts(pred: Column, y: Column) -> list[Column]:
    return [F.count_if((pred == a) & (y == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))]


def metrics(df: DataFrame, pred: str = "pred", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Counts and metrics of predicted labels; undefined ones are 0."""
    c = df.groupBy(*keys).agg(*counts(F.col(pred), F.col(y)))
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.withColumns({
        "accuracy": div(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (div(tp, tp + fn) + div(tn, tn + fp)) / 2, "precision": div(tp, tp + fp), "recall": div(tp, tp + fn),
        "specificity": div(tn, tn + fp), "f1": div(2 * tp, 2 * tp + fp + fn),
    })


def calibration_bins(df: DataFrame, bins: int = 10, score: str = "score", y: str = "y") -> DataFrame:
    """Mean score and rate of ones in even bins of the score."""
    cell = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(cell).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration_error(df: DataFrame, bins: int = 10, score: str = "score", y: str = "y") -> DataFrame:
    """Brier score, and the bins' mean distance of score and rate by their rows."""
    b = calibration_bins(df, bins, score, y).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return df.agg(F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier")).crossJoin(F.broadcast(b))  # two rows


#: Rounds of a bootstrap that one row of work draws.
ROUNDS = 50


def bootstrap(df: DataFrame, rounds: int = 2000, pred: str = "pred", y: str = "y", score: str | None = None, seed: int = 1, buckets: int = 1024) -> DataFrame:
    """metric, mean, sd, low and high (95 % interval) over resamples of the rows, drawn with replacement within each class.

    Rows are counted once, by bucket of the score (0 to 1), predicted label and class: at most 4 * buckets counts, however
    many rows. A resample of a class is a multinomial draw of its counts, so rounds cost buckets and not rows; they are
    dealt to tasks. With a score there are roc_auc and average_precision as well, scores of a bucket counting as ties."""
    import numpy as np
    import pandas as pd

    names = [*METRICS, *(("roc_auc", "average_precision") if score else ())]
    cell = F.greatest(F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1)), F.lit(0)).cast("int") if score else F.lit(0)
    one = F.col(y) == 1
    cells = df.groupBy(cell.alias("cell"), (F.col(pred) == 1).alias("picked")).agg(F.count_if(one).alias("p"), F.count_if(~one).alias("q"))
    listed = cells.agg(F.sort_array(F.collect_list(F.struct("cell", "picked", "p", "q"))).alias("cells"))
    work = df.sparkSession.range(-(-rounds // ROUNDS)).withColumn("n", F.least(F.lit(ROUNDS), F.lit(rounds) - F.col("id") * ROUNDS)).crossJoin(F.broadcast(listed))  # one row

    def draw(frames):
        for frame in frames:
            for part, n, cells in zip(frame["id"], frame["n"], frame["cells"]):
                if not len(cells):
                    continue
                bucket, picked, p, q = (np.array([c[k] for c in cells]) for k in ("cell", "picked", "p", "q"))
                rng = np.random.default_rng([seed, int(part)])
                again = lambda c: rng.multinomial(c.sum(), c / c.sum(), size=int(n)) if c.sum() else np.zeros((int(n), len(c)), np.int64)
                p, q = again(p), again(q)
                tp, fp = p[:, picked].sum(axis=1), q[:, picked].sum(axis=1)
                fn, tn = p.sum(axis=1) - tp, q.sum(axis=1) - fp
                div = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
                recall = div(tp, tp + fn)
                found = {"accuracy": div(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (recall + div(tn, tn + fp)) / 2, "precision": div(tp, tp + fp), "recall": recall, "f1": div(2 * tp, 2 * tp + fp + fn)}
                if score:
                    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
                    p, q = (np.add.reduceat(c, edge, axis=1)[:, ::-1] for c in (p, q))  # by falling score
                    above, all_ = p.cumsum(axis=1), p.cumsum(axis=1) + q.cumsum(axis=1)
                    ones, zeros = p.sum(axis=1), q.sum(axis=1)
                    found["roc_auc"] = np.where(ones * zeros > 0, div((q * (above - p) + q * p / 2).sum(axis=1), ones * zeros), np.nan)
                    ap = np.divide(p * above, all_, out=np.zeros(p.shape), where=all_ > 0).sum(axis=1)
                    found["average_precision"] = np.where(ones > 0, div(ap, ones), np.nan)
                yield pd.DataFrame(found)

    drawn = work.repartition(-(-rounds // ROUNDS)).mapInPandas(draw, ", ".join(f"{c} double" for c in names))
    v = F.when(~F.isnan("value"), F.col("value"))
    return drawn.unpivot([], names, "metric", "value").groupBy("metric").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.percentile(v, F.lit(0.025)).alias("low"), F.percentile(v, F.lit(0.975)).alias("high"))


def roc_on_grid(df: DataFrame, steps: int, score: str = "score", y: str = "y") -> DataFrame:
    """The ROC curve at even false-positive rates, on lines between its points; it starts at (0, 0)."""
    c = curve(df, score, y).groupBy("fpr").agg(F.max("tpr").alias("tpr"))
    start = df.sparkSession.createDataFrame([(0.0, 0.0)], "fpr double, tpr double")
    points = c.unionByName(start).groupBy("fpr").agg(F.max("tpr").alias("tpr")).filter(F.col("fpr").isNotNull())
    # Each point serves the few grid lines up to it: the last point at or under and the first at or over are aggregates.
    cell = points.select(F.struct("fpr", "tpr").alias("p"), F.floor(F.round(F.col("fpr") * steps, 9)).cast("int").alias("low"), F.ceil(F.round(F.col("fpr") * steps, 9)).cast("int").alias("high"))
    under = cell.groupBy(F.col("high").alias("k")).agg(F.max("p").alias("a"))
    over = cell.groupBy(F.col("low").alias("k")).agg(F.min("p").alias("b"))
    lines = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))  # the grid
    joined = lines.join(under, "k", "left").join(over, "k", "left")
    back, ahead = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    filled = joined.select("k", F.max("a").over(back).alias("a"), F.min("b").over(ahead).alias("b"))
    x, a, b = F.col("k") / float(steps), F.col("a"), F.coalesce("b", "a")
    share = F.coalesce(F.try_divide(x - a["fpr"], b["fpr"] - a["fpr"]), F.lit(0.0))
    return filled.select(x.alias("fpr"), (a["tpr"] + share * (b["tpr"] - a["tpr"])).alias("tpr"))
