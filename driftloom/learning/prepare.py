"""What comes before a fit: scaling, class and dataset weights, rebalancing, folds, oversampling, feature rankings."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.storage import materialise
from driftloom.operators.neighbours import nearest_vectors

from .ranks import with_rank


def fit_scaler(df: DataFrame, features: Sequence[str], kind: str = "standard", keys: Sequence[str] = ()) -> DataFrame:
    """A row for each group: <feature>_shift and <feature>_scale of standard, minmax or robust scaling; a scale of 0 is 1."""
    q = lambda f: F.percentile(F.col(f), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    pair = {"standard": lambda f: (F.avg(f), F.stddev_pop(f)), "minmax": lambda f: (F.min(f).cast("double"), (F.max(f) - F.min(f)).cast("double")), "robust": lambda f: (q(f)[1], q(f)[2] - q(f)[0])}[kind]
    safe = lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s)
    cols = [c for f in features for s, d in [pair(f)] for c in (s.alias(f"{f}_shift"), safe(d).alias(f"{f}_scale"))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *cols)


def macro_scaler(per_group: DataFrame, features: Sequence[str], weighted: bool = False) -> DataFrame:
    """One row for unseen groups: the groups' parameters averaged, plainly or by size."""
    w = F.col("n").cast("double") if weighted else F.lit(1.0)
    return per_group.agg(F.sum("n").alias("n"), *((F.sum(F.col(c) * w) / F.sum(w)).alias(c) for f in features for c in (f"{f}_shift", f"{f}_scale")))


def scale(df: DataFrame, scaler: DataFrame, features: Sequence[str], keys: Sequence[str] = (), fallback: DataFrame | None = None) -> DataFrame:
    """df with the features scaled by its group's row, or by the fallback's where the group has none."""
    cols = [c for f in features for c in (f"{f}_shift", f"{f}_scale")]
    if not keys:
        joined = df.crossJoin(F.broadcast(scaler.select(*cols)))  # one row
    else:
        joined = df.join(scaler.select(*keys, *cols), list(keys), "left")
        if fallback is not None:
            other = fallback.select(*(F.col(c).alias(f"_{c}") for c in cols))
            joined = joined.crossJoin(F.broadcast(other)).withColumns({c: F.coalesce(c, f"_{c}") for c in cols}).drop(*(f"_{c}" for c in cols))  # one row
    return joined.withColumns({f: (F.col(f) - F.col(f"{f}_shift")) / F.col(f"{f}_scale") for f in features}).drop(*cols)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """n / (classes * rows of the class) for each class."""
    c = df.groupBy(y).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return c.crossJoin(F.broadcast(total)).select(y, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))  # one row


def dataset_weights(df: DataFrame, dataset: str, y: str | None = None) -> DataFrame:
    """A weight for the rows of each dataset (and class), inverse to its rows, that sums up to the table's rows."""
    by = [dataset, *([y] if y else [])]
    c = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return c.crossJoin(F.broadcast(total)).select(*by, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))  # one row


def draw_order(key: str, seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), key)


def rebalance_targets(df: DataFrame, dataset: str, y: str, method: str, cap: int | None = None) -> DataFrame:
    """Rows to keep of each dataset and class. Methods: none, min, median, cap_absolute, cap_to_second_largest.

    A dataset over the target keeps the class ratio, rounded; classes of few rows keep one at least."""
    sizes = df.groupBy(dataset).agg(F.count("*").alias("_size"))
    if method == "none":
        limit = F.max("_size").cast("double")
    elif method == "min":
        limit = F.min("_size").cast("double")
    elif method == "median":
        limit = F.percentile("_size", F.lit(0.5))
    elif method == "cap_absolute":
        if cap is None:
            raise ValueError("cap_absolute needs a cap")
        limit = F.lit(float(cap))
    elif method == "cap_to_second_largest":
        top = F.sort_array(F.collect_list("_size"), asc=False)  # one number for each dataset
        limit = F.coalesce(F.try_element_at(top, F.lit(2)), F.max("_size")).cast("double")
    else:
        raise ValueError(f"unknown method {method}")
    rows = df.groupBy(dataset, y).agg(F.count("*").alias("n")).join(sizes, dataset).crossJoin(F.broadcast(sizes.agg(limit.alias("_limit"))))  # one row
    share = F.least(F.lit(1.0), F.floor("_limit") / F.col("_size"))
    return rows.select(dataset, y, "n", F.greatest(F.round(F.col("n") * share).cast("long"), F.lit(1)).alias("target"))


def rebalance(df: DataFrame, dataset: str, y: str, key: str, method: str, cap: int | None = None, seed: int = 42) -> DataFrame:
    targets = rebalance_targets(df, dataset, y, method, cap).select(dataset, y, "target")
    w = Window.partitionBy(dataset, y).orderBy(draw_order(key, seed), key)
    return df.withColumn("_k", F.row_number().over(w)).join(targets, [dataset, y]).filter("_k <= target").drop("_k", "target")


def stratum(y: Column, dataset: Column | None = None) -> Column:
    return y.cast("string") if dataset is None else F.concat_ws("_", dataset.cast("string"), y.cast("string"))


def _into_fold(held: np.ndarray, counts: np.ndarray, total: np.ndarray) -> int:
    """The fold that a group goes to, whose counts are added to those held by fold."""
    folds, strata = held.shape
    share = (held[None] + np.eye(folds)[:, :, None] * counts) / total
    # numpy's std and mean, without what they add for a group at a time.
    apart = share - np.add.reduce(share, axis=1, keepdims=True) / folds
    cost = (np.add.reduce(np.sqrt(np.add.reduce(apart * apart, axis=1) / folds), axis=1) / strata).tolist()
    size = np.add.reduce(held, axis=1).tolist()
    best = min(range(folds), key=lambda k: (round(cost[k], 12), size[k]))
    held[best] += counts
    return best


def spread_groups(counts: np.ndarray, folds: int) -> np.ndarray:
    """The fold of each group, from its counts by stratum (groups, strata)."""
    total, held, place = counts.sum(axis=0), np.zeros((folds, counts.shape[1])), np.zeros(len(counts), int)
    for i in np.argsort(-counts.std(axis=1), kind="stable"):
        place[i] = _into_fold(held, counts[i], total)
    return place


def group_folds(df: DataFrame, group: str, stratum_col: str, folds: int) -> DataFrame:
    """group, fold: whole groups in one fold each, with strata spread evenly.

    Groups are put, the most uneven first, into the fold that keeps the strata's shares most even, then into the smaller;
    groups or strata that are null have none. That is by nature one after the other: Spark counts and sorts the groups, and
    one task takes them as a stream, holding the folds' counts and no more of the groups than a batch."""
    kind = df.schema[group].dataType.simpleString()
    known = df.select(F.col(group).alias("g"), F.col(stratum_col).cast("string").alias("s")).filter("g IS NOT NULL AND s IS NOT NULL")
    counts = materialise(known.groupBy("g", "s").agg(F.count("*").alias("n")), "counts")
    all_ = sorted((r["s"], r["n"]) for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect())  # a row for each stratum
    at, total = {s: k for k, (s, _) in enumerate(all_)}, np.array([float(n) for _, n in all_])

    def dense(batches):
        for pdf in batches:
            wide = np.zeros((len(pdf), len(at)))
            for i, own in enumerate(pdf["own"]):
                for x in own:
                    wide[i, at[x["s"]]] += x["n"]
            yield pd.DataFrame({"g": pdf["g"], "_uneven": wide.std(axis=1) if len(at) else 0.0, "_counts": list(wide)})

    def assign(batches):
        held = np.zeros((folds, len(at)))
        for pdf in batches:
            yield pd.DataFrame({"g": pdf["g"], "fold": [_into_fold(held, c, total) for c in pdf["_counts"]]})

    listed = counts.groupBy("g").agg(F.collect_list(F.struct("s", "n")).alias("own"))
    wide = listed.mapInPandas(dense, f"g {kind}, _uneven double, _counts array<double>")
    placed = wide.repartition(1).sortWithinPartitions(F.col("_uneven").desc(), "g").mapInPandas(assign, f"g {kind}, fold int")
    return materialise(placed.select(F.col("g").alias(group), "fold"), "folds")


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """fold: each group's number in order, for leaving one group (patient, dataset) out at a time."""
    each = df.select(group).distinct()
    return df.join(each.withColumn("fold", F.row_number().over(Window.orderBy(group)) - 1), group)


def smote(df: DataFrame, features: Sequence[str], y: str, group: str, k: int = 5, seed: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """df and synthetic rows of the smaller class until both are even, within each fold or dataset of keys.

    A synthetic row lies between a row and one of its k nearest of the class, and has the group of the nearer; synthetic
    marks the new rows. The rows of the smaller class (of as many, the one with the smaller label) take turns, as their
    hashes order them; neighbours are sought by blocks, so no class need fit in a task. A class of one row has no
    neighbours and stays as it is."""
    keys, names = list(keys), list(features)
    held = materialise(df.select(*keys, group, y, *(F.col(f).cast("double").alias(f) for f in names)).withColumn("_id", F.monotonically_increasing_id()), "smote")
    sizes = held.groupBy(*keys, y).agg(F.count("*").alias("_n"))
    over = sizes.groupBy(*keys).agg(F.min(F.struct("_n", F.col(y).alias("_y"))).alias("_small"), F.max("_n").alias("_most"), F.count("*").alias("_classes"))
    over = over.filter("_classes > 1 AND _small._n > 1").select(*keys, F.col("_small._y").alias("_y"), F.col("_small._n").alias("_m"), (F.col("_most") - F.col("_small._n")).alias("_need"))
    small = held.join(over, keys) if keys else held.crossJoin(F.broadcast(over))  # without keys, one row
    small = materialise(small.filter(F.col(y) == F.col("_y")).withColumn("_turn", F.xxhash64(F.lit(seed), "_id").cast("double")), "smaller")
    # Everyone gets a share of what is needed, the first by their hashes one more.
    turns = with_rank(small, "_turn", "min", keys)
    copies = F.floor(F.col("_need") / F.col("_m")) + (F.col("rank") <= F.col("_need") % F.col("_m")).cast("int")
    made = turns.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    vectors = small.select(*keys, "_id", *names)
    near = nearest_vectors(vectors, vectors.withColumnRenamed("_id", "_other"), names, "_id", "_other", k, keys, others=True)
    near = near.groupBy(*keys, "_id").agg(F.sort_array(F.collect_list(F.struct("place", "_other"))).alias("_near"))
    uniform = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "_id", "_copy"), F.lit(1 << 30)) / float(1 << 30)
    drawn = made.join(near, [*keys, "_id"]).withColumn("_other", F.element_at("_near", (F.floor(uniform(1) * F.size("_near")) + 1).cast("int"))["_other"]).withColumn("_t", uniform(2))
    ends = small.select(F.col("_id").alias("_other"), F.col(group).alias("_group"), *(F.col(f).alias(f"_to_{f}") for f in names))
    new = drawn.join(ends, "_other").select(*keys, F.when(F.col("_t") <= 0.5, F.col(group)).otherwise(F.col("_group")).alias(group), y, *((F.col(f) + F.col("_t") * (F.col(f"_to_{f}") - F.col(f))).alias(f) for f in names))
    return held.drop("_id").withColumn("synthetic", F.lit(False)).unionByName(new.withColumn("synthetic", F.lit(True)))


# --- rankings of features


def ensemble_rank(scores: DataFrame, name: str, weights: dict[str, float]) -> DataFrame:
    """Rank of the weighted mean of methods' ranks, over those that ranked a feature; ties get the highest rank."""
    parts = [(F.col(m), w) for m, w in weights.items()]
    top = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts[1:]), F.coalesce(parts[0][0], F.lit(0.0)) * parts[0][1])
    under = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    return with_rank(scores.select(name, F.round(F.try_divide(top, under), 9).alias("score")), "score", "max", name="rank")


def fair_rank(ranks: DataFrame, name: str, rank: str, how: str = "mean") -> DataFrame:
    """Features in one order from their ranks in several datasets: by mean, median or Borda count, ties by name."""
    value = {"mean": F.avg(rank), "median": F.percentile(rank, F.lit(0.5)), "borda": -F.sum(-F.col(rank)).cast("double")}[how]
    found = ranks.groupBy(name).agg(F.round(value, 9).alias("score"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy("score", name)))  # a row for each feature


def variance_rank(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, variance (of values scaled to [0, 1]), rank, the most varied first."""
    row = df.agg(*(F.round(F.var_pop(f) / F.nullif(F.pow(F.max(f) - F.min(f), 2), F.lit(0.0)), 9).alias(f) for f in features)).first()  # a number for each feature, which the ranks would find anew each time
    long = df.sparkSession.createDataFrame([(f, row[f]) for f in features], "feature string, variance double")
    return with_rank(long, "variance", "max", descending=True)


#: Features from which on mrmr() picks a part only, and how many.
MANY, PICKED = 1000, 200


def f_statistic(r: np.ndarray, n: int) -> np.ndarray:
    """The F of a feature's means over two classes, from its correlation with their labels 0 and 1."""
    return r**2 / np.maximum(1 - r**2, 1e-12) * (n - 2)


def mrmr(correlation: np.ndarray, relevance: np.ndarray, most: int | None = None) -> list[int]:
    """Features in order of relevance over mean absolute correlation with those picked before; the first by relevance.

    Of MANY features or more, PICKED are picked (or most, if given); the others aren't in the order."""
    k = len(relevance)
    most = most or (PICKED if k >= MANY else k)
    picked, total, free = [], np.zeros(k), np.ones(k, bool)
    for _ in range(min(most, k)):
        score = relevance / np.maximum(total / len(picked), 1e-9) if picked else np.asarray(relevance, float)
        best = int(np.argmax(np.where(free, score, -np.inf)))
        picked.append(best)
        free[best] = False
        total += np.abs(correlation[best])
    return picked
