"""Registered queries on statistics, oversampling, rankings, searches, calibration and validation, each with its SQL or
with what its result must satisfy."""

import json

from pyspark.sql import functions as F

from driftloom import config
from driftloom.functions.storage import materialise, scratch_path, spread
from driftloom.learning import curves, evaluate, loader, models, prepare, stats
from driftloom.queries_tables import SCORED, predicted, read, rounded, scored

QUERIES: dict = {}
SQL: dict[str, str] = {}
WIDTH = 64
FEATURES = [f"x{k}" for k in range(WIDTH)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark, sf_dir, y=None):
    """embeddings as nights: 40 subjects, a label and all numbers of a vector."""
    e = read(spark, sf_dir, "embeddings")
    y = (F.col("label") % 2) if y is None else y
    return e.select("vec_id", (F.col("vec_id") % 40).alias("id"), y.cast("int").alias("y"), *(F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(WIDTH)))


# --- statistics

N = f"{SCORED}, m AS (SELECT avg(score) AS m, stddev_samp(score) AS sd, CAST(count(*) AS DOUBLE) AS n FROM s)"
#: Student's quantile at 0.975 by the expansion in 1 / degrees of freedom (Abramowitz and Stegun 26.7.5).
T = "(1.959963984540054 + 2.3722712320 / (n - 1) + 2.8224986162 / (n - 1) ** 2 + 2.5558497 / (n - 1) ** 3)"


@query(f"WITH {N} SELECT CAST(n AS BIGINT) AS n, round(m, 6) AS mean, round(sd, 6) AS sd, round(m - {T} * sd / sqrt(n), 6) AS low, round(m + {T} * sd / sqrt(n), 6) AS high FROM m")
def mean_interval(spark, sf_dir):
    return rounded(stats.mean_interval(scored(spark, sf_dir), "score"))


#: The normal distribution function by the series of the error function, for |z| under 4.
PHI = "0.5 + list_sum(list_transform(range(0, 60), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * (z / sqrt(2)) ** (2 * i + 1) / (gamma(i + 1.0) * (2 * i + 1)))) / sqrt(pi())"


@query(f"""WITH {N}, c AS (SELECT (score - m) / sd AS z, n, count(*) AS k FROM (SELECT score FROM s), m GROUP BY ALL), f AS (SELECT n, k, sum(k) OVER (ORDER BY z) AS high, {PHI} AS f FROM c), g AS (SELECT n, f, CAST(high AS DOUBLE) AS high, CAST(high - k AS DOUBLE) AS low FROM f),
  a AS (SELECT max(n) AS n, max(greatest(high / n - f, f - low / n)) AS ks, -max(n) - sum((high * high - low * low) * ln(f) + ((n - low) * (n - low) - (n - high) * (n - high)) * ln(1 - f)) / max(n) AS ad FROM g), b AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * ks AS l, ad * (1 + 0.75 / n + 2.25 / (n * n)) AS a2 FROM a)
  SELECT n, round(ks, 6) AS ks, round(least(greatest(2 * (exp(-2 * l * l) - exp(-8 * l * l) + exp(-18 * l * l) - exp(-32 * l * l)), 0), 1), 6) AS ks_p, round(ad, 4) AS anderson, round(least(CASE WHEN a2 >= 0.6 THEN exp(1.2937 - 5.709 * a2 + 0.0186 * a2 * a2) WHEN a2 >= 0.34 THEN exp(0.9177 - 4.279 * a2 - 1.38 * a2 * a2) WHEN a2 > 0.2 THEN 1 - exp(-8.318 + 42.796 * a2 - 59.938 * a2 * a2) ELSE 1 - exp(-13.436 + 101.14 * a2 - 223.73 * a2 * a2) END, 1), 6) AS anderson_p FROM b""")
def normality_tests(spark, sf_dir):
    got = stats.normality_report(scored(spark, sf_dir), "score")
    return got.select("n", *(F.round(c, 4 if c == "anderson" else 6).alias(c) for c in ("ks", "ks_p", "anderson", "anderson_p")))


@query("SELECT kind, normal FROM (SELECT unnest(['even', 'normal', 'skewed']) AS kind, unnest([false, true, false]) AS normal)")
def shapiro_planted(spark, sf_dir):
    """Which of three samples planted in the embeddings' rows each test takes for normal, at one in a thousand."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].alias("v"))
    # Sums of twelve even numbers, spread by hashes: near normal.
    near = sum(F.pmod(F.xxhash64("vec_id", "v", F.lit(i)), F.lit(10007)) / 10007 for i in range(12)) - 6
    out = None
    for kind, value in (("even", F.col("vec_id").cast("double")), ("normal", near), ("skewed", F.exp(F.col("vec_id") % 500 / 150.0))):
        r = stats.normality_report(rows.select(value.alias("v")), "v")
        one = r.select(F.lit(kind).alias("kind"), ((F.col("shapiro_p") > 0.001) & (F.col("anderson_p") > 0.001)).alias("normal"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH t AS (SELECT count(*) FILTER (r_regionkey < 2 AND n_nationkey % 2 = 0) AS a, count(*) FILTER (r_regionkey < 2 AND n_nationkey % 2 = 1) AS b, count(*) FILTER (r_regionkey >= 2 AND n_nationkey % 2 = 0) AS c, count(*) FILTER (r_regionkey >= 2 AND n_nationkey % 2 = 1) AS d FROM nation JOIN region ON n_regionkey = r_regionkey),
  k AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS x FROM t),
  w AS (SELECT *, lgamma(a + b + 1.0) - lgamma(x + 1.0) - lgamma(a + b - x + 1.0) + lgamma(c + d + 1.0) - lgamma(a + c - x + 1.0) - lgamma(c + d - (a + c - x) + 1.0) - (lgamma(a + b + c + d + 1.0) - lgamma(a + c + 1.0) - lgamma(b + d + 1.0)) AS l FROM k)
  SELECT CAST(max(a + b + c + d) AS BIGINT) AS n, 2::INTEGER AS rows, round(sum(exp(l)) FILTER (l <= (SELECT l + 1e-9 FROM w WHERE x = a)), 6) AS p FROM w""")
def exact_independence(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select((F.col("n_regionkey") < 2).alias("part"), (F.col("n_nationkey") % 2).alias("odd"))
    return rounded(stats.independence(n, "part", "odd"))


@query("SELECT unnest(['accuracy', 'balanced_accuracy', 'precision', 'recall', 'f1', 'roc_auc', 'average_precision']) AS metric, true AS covers, true AS near")
def bootstrap_ci(spark, sf_dir):
    """Whether the interval of each metric covers the metric itself, and its mean is near, over 2,000 rounds."""
    p = predicted(spark, sf_dir)
    point = curves.metrics(p).crossJoin(F.broadcast(curves.auc(p))).unpivot([], [*curves.METRICS, "roc_auc", "average_precision"], "metric", "point")  # one row each
    return curves.bootstrap(p, 2000, score="score").join(point, "metric").select("metric", (F.col("point") >= F.col("low") - 1e-9).__and__(F.col("point") <= F.col("high") + 1e-9).alias("covers"), (F.abs(F.col("mean") - F.col("point")) < 0.02).alias("near"))


# --- folds, oversampling, rankings


@query("SELECT count(DISTINCT o_custkey) AS n_groups, 5::BIGINT AS n_folds, true AS whole, true AS even FROM orders")
def group_folds(spark, sf_dir):
    """Whole groups in one fold each, strata spread evenly."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    folds = prepare.group_folds(o, "o_custkey", "o_orderstatus", 5)
    share = o.join(folds, "o_custkey").groupBy("fold", "o_orderstatus").agg(F.count("*").alias("n"))
    even = share.groupBy("o_orderstatus").agg((F.max("n") - F.min("n") <= 0.1 * F.avg("n") + 3).alias("e")).agg(F.bool_and("e").alias("even"))
    each = folds.groupBy("o_custkey").agg(F.count("*").alias("c"), F.first("fold").alias("fold"))
    return each.agg(F.count("*").alias("n_groups"), F.count_distinct("fold").alias("n_folds"), (F.max("c") == 1).alias("whole")).crossJoin(F.broadcast(even))  # one row


@query("""WITH c AS (SELECT CAST(label % 4 = 0 AS INTEGER) AS y, count(*) AS n FROM embeddings GROUP BY 1) SELECT y, max(n) OVER () AS n, max(n) OVER () - n AS n_synthetic, true AS inside, true AS owned FROM c""")
def smote_rows(spark, sf_dir):
    """Oversampled to even classes; new rows lie within the class's ranges and have the group of a row of the class."""
    e = vectors(spark, sf_dir, F.col("label") % 4 == 0).withColumn("subject", F.col("vec_id"))
    got = materialise(prepare.smote(e, FEATURES, "y", "subject"), "smote")
    box = got.filter(~F.col("synthetic")).groupBy("y").agg(*(f(c).alias(f"_{n}_{c}") for c in FEATURES for n, f in (("a", F.min), ("b", F.max))))
    ok = F.lit(True)
    for c in FEATURES:
        ok = ok & F.col(c).between(F.col(f"_a_{c}") - 1e-9, F.col(f"_b_{c}") + 1e-9)
    own = e.select("subject", F.col("y").alias("_own"))
    return got.join(box, "y").join(own, "subject", "left").groupBy("y").agg(F.count("*").alias("n"), F.count_if("synthetic").alias("n_synthetic"), F.bool_and(ok).alias("inside"), F.bool_and(F.coalesce(F.col("_own") == F.col("y"), F.lit(False))).alias("owned"))


def _long(y="label % 2"):
    return f"v AS (SELECT vec_id, CAST({y} AS INTEGER) AS y, unnest(embedding)::DOUBLE AS v, 'x' || (generate_subscripts(embedding, 1) - 1) AS feature FROM embeddings)"


def _place(value, by="DESC"):
    return f"CAST(count(*) OVER (ORDER BY {value} {by} NULLS LAST RANGE UNBOUNDED PRECEDING) AS DOUBLE)"


@query(f"""WITH {_long()}, r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM v),
  t AS (SELECT feature, sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT feature, v, count(*) AS c FROM v GROUP BY 1, 2) GROUP BY 1),
  c AS (SELECT feature, abs(corr(v, CAST(y AS DOUBLE))) AS p, abs(corr(rv, ry)) AS s, sum(CASE WHEN y = 1 THEN rv END) - sum(y) * (sum(y) + 1) / 2.0 AS u, CAST(sum(y) AS DOUBLE) AS n1, CAST(count(*) - sum(y) AS DOUBLE) AS n0, round(var_pop((v - a) / nullif(b - a, 0)), 9) AS w FROM (SELECT *, min(v) OVER (PARTITION BY feature) AS a, max(v) OVER (PARTITION BY feature) AS b FROM r) GROUP BY 1),
  z AS (SELECT c.*, greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM c JOIN t USING (feature))
  SELECT feature, {_place("round(p, 12)")} AS correlation, {_place("round(s, 12)")} AS rank_correlation, {_place("round(z, 12)")} AS significance, {_place("w")} AS variance FROM z""")
def rank_features(spark, sf_dir):
    """Rankings of all numbers of the embeddings against a label."""
    return loader.rank_features(vectors(spark, sf_dir), FEATURES).select("feature", "correlation", "rank_correlation", "significance", "variance")


@query("SELECT 'x' || unnest(range(64)) AS feature, true AS known, unnest(range(64)) = 0 AS first")
def mrmr_order(spark, sf_dir):
    """All features have a place in the order of relevance and redundancy; the one that tells the label is the first."""
    df = vectors(spark, sf_dir).withColumn("x0", F.col("y") + F.col("x0") / 100)
    got = loader.rank_features(df, FEATURES)
    return got.select("feature", F.col("mrmr").between(1, 64).alias("known"), (F.col("mrmr") == 1).alias("first"))


@query("SELECT * FROM (VALUES ('x0', 'confirmed'), ('x1', 'confirmed'), ('x2', 'rejected'), ('x3', 'rejected')) AS t(feature, state)")
def boruta_planted(spark, sf_dir):
    """Two features that tell the label, and two of noise, from the orders' keys and prices."""
    k = F.col("o_totalprice")
    y = F.pmod(F.xxhash64(k), F.lit(2))
    noise = lambda n: F.pmod(F.xxhash64("o_orderkey", k, F.lit(n)), F.lit(1000)) / 1000
    df = spread(read(spark, sf_dir, "orders")).select(y.cast("int").alias("y"), (y + noise(1) * 1.5).alias("x0"), (y - noise(2) * 1.5).alias("x1"), F.round(noise(3)).alias("x2"), F.round(noise(4)).alias("x3"))
    return models.importance_rank(df, ["x0", "x1", "x2", "x3"]).select("feature", "state")


# --- models, searches, calibration


def _planted(spark, sf_dir):
    """The orders as nights of 50 subjects, spread over a square by their keys and prices, of label 1 within a disc: no line
    parts them from the others."""
    u = lambda n: F.pmod(F.xxhash64("o_orderkey", "o_totalprice", F.lit(n)), F.lit(2001)) / 1000 - 1
    df = spread(read(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 50).alias("id"), u(1).alias("x0"), u(2).alias("x1"))
    return materialise(df.withColumn("y", (F.col("x0") ** 2 + F.col("x1") ** 2 < 0.6).cast("int")), "planted")


@query("SELECT unnest(['gbt', 'rf', 'lr', 'svm', 'rbf_svm', 'knn']) AS name, unnest([true, true, false, false, true, true]) AS bends")
def model_factory(spark, sf_dir):
    """Which models tell a disc from what is around it (on unseen rows, an accuracy over 0.85)."""
    df = _planted(spark, sf_dir)
    train, test = df.filter("key % 3 <> 0"), df.filter("key % 3 = 0")
    params = {"gbt": {"maxIter": 15, "maxDepth": 4}, "rf": {"numTrees": 20, "maxDepth": 7}, "rbf_svm": {"gamma": 1.0, "regParam": 0.0005}, "knn": {"k": 7}}
    rows = []
    for name in ("gbt", "rf", "lr", "svm", "rbf_svm", "knn"):
        got = models.score(models.make(name, ["x0", "x1"], params.get(name)).fit(train), test).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
        rows.append((name, curves.metrics(got).first()["accuracy"] > 0.85))
    return spark.createDataFrame(rows, "name string, bends boolean")


@query("SELECT unnest(['random', 'gaussian', 'grid']) AS search, unnest([6, 6, 4]) AS n, true AS ranked, true AS in_space, true AS found")
def searches(spark, sf_dir):
    """Points tried by each search: ranked, within the space, the best beating a useless setting."""
    df = _planted(spark, sf_dir).withColumn("x0", F.col("x0") + F.col("y"))
    low, high = models.SPACES["lr"]["regParam"]
    out = []
    for name in ("random", "gaussian", "grid"):
        if name == "grid":
            tried = models.grid_search(df, "lr", ["x0", "x1"], "id", {"regParam": [0.001, 0.5], "elasticNetParam": [0.0, 1.0]}, 2)
        else:
            more = {"start": 3, "candidates": 60} if name == "gaussian" else {}
            tried = models.SEARCHES[name](df, "lr", ["x0", "x1"], "id", 6, 2, **more)
        scores = [t["objective"] for t in tried]
        out.append((name, len(tried), scores == sorted(scores, reverse=True), all(low <= t["params"]["regParam"] <= high and 0 <= t["params"]["elasticNetParam"] <= 1 for t in tried), scores[0] > 0.6))
    return spark.createDataFrame(out, "search string, n int, ranked boolean, in_space boolean, found boolean")


TRIED = "t AS (SELECT s_suppkey AS k, CAST(s_suppkey * 5 % 7 + 1 AS DOUBLE) AS a, CAST(s_nationkey AS VARCHAR) AS c, (s_suppkey * 37 % 1009 + 1) / 1009.0::DOUBLE AS o FROM supplier), n AS (SELECT count(*) AS n FROM t), r AS (SELECT *, row_number() OVER (ORDER BY o DESC, k) AS place FROM t)"


@query(f"""WITH {TRIED} SELECT 'best' AS how, max(a) FILTER (place = 1) AS value FROM r UNION ALL SELECT 'mean', round(avg(a), 6) FROM t UNION ALL SELECT 'top', round(avg(a) FILTER (place <= greatest(1, n // 10)), 6) FROM r, n
  UNION ALL SELECT 'weighted', round(sum(o * a) / sum(o), 6) FROM t UNION ALL SELECT 'choice', CAST((SELECT c FROM t GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) AS DOUBLE) UNION ALL SELECT 'seeds', CAST(n AS DOUBLE) FROM n""")
def combined_params(spark, sf_dir):
    """One set of parameters from the suppliers' many, and as many different seeds from one."""
    rows = read(spark, sf_dir, "supplier").orderBy("s_suppkey").collect()
    tried = [{"params": {"a": float(r["s_suppkey"] * 5 % 7 + 1), "c": str(r["s_nationkey"])}, "objective": (r["s_suppkey"] * 37 % 1009 + 1) / 1009} for r in rows]
    out = [(how, round(models.combine_params(tried, how)["a"], 6)) for how in ("best", "mean", "top", "weighted")]
    out += [("choice", float(models.combine_params(tried, "mean")["c"])), ("seeds", float(len(set(models.seeds(1, len(rows))))))]
    return spark.createDataFrame(out, "how string, value double")


@query("SELECT unnest(['sigmoid', 'isotonic', 'ensemble']) AS kind, true AS like_rates, true AS in_range, true AS ordered")
def calibrated(spark, sf_dir):
    """Calibrated probabilities meet the rates that they tell, within 0.1 in each third of the rows, and keep their order."""
    df = _planted(spark, sf_dir)
    raw = df.select("id", "y", "x0", "x1", F.pow(F.pmod(F.xxhash64("key", F.lit(9)), F.lit(1000)) / 1000, F.lit(3)).alias("prob")).withColumn("y", (F.pmod(F.xxhash64("x0", "x1"), F.lit(1000)) / 1000 < F.pow("prob", F.lit(1 / 3))).cast("int"))
    raw, out = materialise(raw, "raw"), None
    for kind in ("sigmoid", "isotonic", "ensemble"):
        if kind == "ensemble":
            made = raw.withColumn("made", F.pmod(F.xxhash64("x0"), F.lit(10)) == 0).withColumnRenamed("prob", "p")
            got = models.train_ensemble(made, "lr", ["p"], "id", folds=3, synthetic="made").score(made).withColumnRenamed("p", "raw")
        else:
            got = models.fit_calibrator(raw, kind).apply(raw.withColumn("raw", F.col("prob")))
        got = materialise(got.select("raw", "prob", "y"), "calibrated")
        third = got.withColumn("t", F.floor(F.pow("raw", F.lit(1 / 3)) * 2.999)).groupBy("t").agg(F.avg("prob").alias("p"), F.avg("y").alias("r"))
        like = third.agg((F.max(F.abs(F.col("p") - F.col("r"))) < 0.1).alias("like_rates"))
        one = got.agg(F.bool_and(F.col("prob").between(0, 1)).alias("in_range"), (F.corr("raw", "prob") > 0.8).alias("ordered")).crossJoin(F.broadcast(like))  # one row
        out = one.withColumn("kind", F.lit(kind)) if out is None else out.unionByName(one.withColumn("kind", F.lit(kind)))
    return out.select("kind", "like_rates", "in_range", "ordered")


@query("SELECT CAST(vec_id % 40 AS BIGINT) AS id, count(*) AS n_total_nights, CAST((vec_id % 40) % 2 AS INTEGER) AS ground_truth, true AS votes_follow, true AS same_after_loading FROM embeddings GROUP BY vec_id % 40")
def train_logistic(spark, sf_dir):
    """Subject-level predictions of a calibrated package, saved twice and read back."""
    df = materialise(vectors(spark, sf_dir).withColumn("y", (F.col("id") % 2).cast("int")), "vectors")
    package = models.train_package(df, "lr", FEATURES, "id", {"regParam": 0.01}, folds=2)
    path = scratch_path(spark, "package")
    package.save(path)
    package.save(path)  # what was there is kept beside it
    again = models.predict(models.load_package(f"{path}.back"), df, "patient").select("id", F.col("mean_prob_per_night").alias("_again"))
    got = models.predict(models.load_package(path), df, "patient").join(again, "id")
    follows = F.col("pred_mean") == (F.col("mean_prob_per_night") > package.threshold).cast("int")
    return got.select("id", "n_total_nights", "ground_truth", follows.alias("votes_follow"), (F.abs(F.col("mean_prob_per_night") - F.col("_again")) < 1e-9).alias("same_after_loading"))


@query("SELECT repeat, fold, kind, true AS scored, true AS kept FROM (SELECT 0::INTEGER AS repeat, CAST(unnest([0, 1]) AS INTEGER) AS fold), (SELECT unnest(['default', 'searched']) AS kind)")
def nested_run(spark, sf_dir):
    """A nested validation that is broken off after three rows and goes on from its manifest, which is then whole."""
    df = _planted(spark, sf_dir).withColumn("x0", F.col("x0") + F.col("y"))
    path, seen = f"{scratch_path(spark, 'run')}/manifest", []

    class Stop(Exception):
        pass

    def stop(row):
        seen.append(row)
        if len(seen) == 3:
            raise Stop

    try:
        models.nested_validation(df, "lr", ["x0", "x1"], "id", outer=2, inner=2, calls=2, manifest=path, progress=stop)
    except Stop:
        pass
    done = models.nested_validation(df, "lr", ["x0", "x1"], "id", outer=2, inner=2, calls=2, manifest=path)
    first = {(r["repeat"], r["fold"], r["kind"]): r["roc_auc"] for r in seen}
    rows = [(r["repeat"], r["fold"], r["kind"], r["roc_auc"] > 0.6 and 0 < r["threshold"] < 1, first.get((r["repeat"], r["fold"], r["kind"]), r["roc_auc"]) == r["roc_auc"]) for r in done.collect()]
    return spark.createDataFrame(rows, "repeat int, fold int, kind string, scored boolean, kept boolean")


@query("SELECT CAST(unnest(['2', '2', '1', 'elasticNetParam regParam']) AS VARCHAR) AS value, unnest(['default', 'searched', 'final', 'names']) AS what")
def validation_summary(spark, sf_dir):
    """Summaries of a nested run and the parameters that it ends in."""
    df = _planted(spark, sf_dir).withColumn("x0", F.col("x0") + F.col("y"))
    got = materialise(models.nested_validation(df, "lr", ["x0", "x1"], "id", outer=2, inner=2, calls=1, search="gaussian"), "nested")
    rows = [(str(r["n"]), r["kind"]) for r in models.summarise_validation(got).collect()]
    names = sorted({r["name"] for r in models.searched_params(got).collect()})
    last = models.final_params(df, "lr", ["x0", "x1"], "id", 1, 2, how="top")
    return spark.createDataFrame([*rows, ("1" if sorted(last) == names else "0", "final"), (" ".join(names), "names")], "value string, what string")


# --- evaluating, settings


@query(f"WITH {SCORED}, p AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred FROM s) SELECT dataset, count(*) AS n, round(avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1")
def scores_by_dataset(spark, sf_dir):
    s = scored(spark, sf_dir).withColumnRenamed("score", "prob")
    n = s.groupBy("dataset").agg(F.count("*").alias("n"))
    return rounded(evaluate.by_dataset(s, 0.5, "dataset", ["accuracy"]).join(n, "dataset").select("dataset", "n", "accuracy"))


def _each(df, f, out: str):
    """f over the values of each row of df, as one column."""
    import pyarrow as pa

    (name, kind), own = out.split(), df.columns

    def run(batches):
        for batch in batches:
            got = [f(*v) for v in zip(*(batch.column(c).to_pylist() for c in own))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(got, {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[kind])], [*own, name])

    return df.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), out]))


@query("SELECT name, max(value) AS value, count(*) AS n FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN v WHEN 1 THEN 'fixed:' || v WHEN 2 THEN 'fixed_' || v ELSE 'f' || v END AS name, CASE WHEN c_custkey % 4 < 3 THEN CAST(v AS DOUBLE) END AS value FROM (SELECT c_custkey, '0.' || c_nationkey AS v FROM customer)) GROUP BY 1")
def threshold_names(spark, sf_dir):
    """Names of thresholds, written in four ways, and the number that each is."""
    v, k = F.concat(F.lit("0."), F.col("c_nationkey").cast("string")), F.col("c_custkey") % 4
    names = read(spark, sf_dir, "customer").select(F.when(k == 0, v).when(k == 1, F.concat(F.lit("fixed:"), v)).when(k == 2, F.concat(F.lit("fixed_"), v)).otherwise(F.concat(F.lit("f"), v)).alias("name"))
    return _each(names, curves.parse_threshold, "value double").groupBy("name").agg(F.max("value").alias("value"), F.count("*").alias("n"))


@query("""SELECT s_suppkey AS k, CASE WHEN s_nationkey = s_suppkey % 5 THEN '{}' ELSE '{"b.c": [' || s_nationkey || ', ' || s_suppkey % 5 || ']}' END AS differs, '{"a": ' || s_suppkey || ', "b": {"c": ' || s_suppkey % 5 || ', "time(s)": ' || (s_nationkey + 2) || '}}' AS merged, '{"a": ' || s_suppkey || '}' AS without_b, CAST(s_nationkey + 1 AS DOUBLE) AS fs FROM supplier""")
def nested_settings(spark, sf_dir):
    """Settings of each supplier: their differences, merging with times added up, leaving out, and as a dataclass."""
    from driftloom.plans.process import ProcessConfig

    def told(k, n):
        a, b = {"a": k, "b": {"c": n, "time(s)": n}}, {"a": k, "b": {"c": k % 5, "time(s)": 2}}
        gone = config.differences(config.without(a, ["time(s)"]), config.without(b, ["time(s)"]))
        return json.dumps([json.dumps({x: list(v) for x, v in gone.items()}), json.dumps(config.with_times(a, b), sort_keys=True), json.dumps(config.without(a, ["b"])), config.from_dict(ProcessConfig, {"fs": n + 1}).fs])

    got = _each(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")), told, "said string")
    said = F.from_json("said", "array<string>")
    return got.select("k", said[0].alias("differs"), said[1].alias("merged"), said[2].alias("without_b"), said[3].cast("double").alias("fs"))


@query("SELECT CAST(event_id // 50 AS BIGINT) AS row, true AS low_when_clustered, true AS high_when_even FROM events GROUP BY 1 HAVING count(*) = 50")
def hopkins_planted(spark, sf_dir):
    """Every fifty events as points: in three tight clusters they score low, at even distances high."""
    from driftloom.operators import features as ft

    r = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).cast("long").alias("row"), (F.col("event_id") % 50).alias("k"), "value")
    whole = r.groupBy("row").agg(F.count("*").alias("n")).filter("n = 50")
    df = r.join(whole, "row", "left_semi").select("row", (F.col("k") % 3 * 100 + F.col("value") % 1).alias("tight"), (F.col("k") * 1.0).alias("even"))
    got = ft.kernel_features(df, ["row"], ["even"], ["tight", "even"], ["clusters"])
    return got.select("row", (F.col("hopkins_score_tight") < 0.2).alias("low_when_clustered"), (F.col("hopkins_score_even") > 0.6).alias("high_when_even"))
