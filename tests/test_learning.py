"""Statistics, curves, preparation and models against plain versions."""

import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.learning import curves, models, prepare, ranks, stats


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(1)
    rows = [(i, round(rnd.random(), 2), int(rnd.random() < 0.4), "ab"[i % 2]) for i in range(300)] + [(300, None, 1, "a")]
    return spark.createDataFrame(rows, "id long, score double, y int, dataset string").cache()


def test_area_by_curve_is_area_by_pairs(spark, scored):
    rows = [(r["score"], r["y"]) for r in scored.collect() if r["score"] is not None]
    p, q = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))
    assert curves.auc(scored).first()["roc_auc"] == pytest.approx(want)
    c = sorted((r["fpr"], r["tpr"]) for r in curves.roc_curve(scored).collect())
    assert np.trapezoid([0, *(y for _, y in c)], [0, *(x for x, _ in c)]) == pytest.approx(want)
    by = {r["dataset"]: r["roc_auc"] for r in curves.auc(scored, keys=["dataset"]).collect()}
    assert set(by) == {"a", "b"}


def test_ranks_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, None), (5, None), (6, -2.0)], "id long, v double")
    get = lambda **k: {r["id"]: r["rank"] for r in ranks.with_rank(df, "v", **k).collect()}
    assert get() == {6: 1, 2: 2, 1: 4, 3: 4, 4: 6, 5: 6} and get(kind="min") == {6: 1, 2: 2, 1: 3, 3: 3, 4: 5, 5: 5} and get(kind="mean")[1] == 3.5
    assert get(descending=True)[1] == 2 and {r["id"] for r in ranks.top_k(df, "v", 3).collect()} == {1, 3, 2}


def test_running_sums_over_cells(spark):
    rnd = random.Random(3)
    values = [round(rnd.gauss(0, 100), 1) for _ in range(2000)]
    got = {r["v"]: r["cum_n"] for r in ranks.running(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"n": F.count("*")}).collect()}
    assert got == {v: sum(x <= v for x in values) for v in set(values)}


def test_distributions():
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and stats.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5)
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert stats.exact_independence([[3, 1], [1, 3]]) == pytest.approx((2 * 16 + 2 * 1) / comb(8, 4))
    assert stats.exact_independence([[5, 0], [0, 5], [5, 0]]) < 0.01 and stats.exact_independence([[0, 0]]) == 1.0
    rng = np.random.default_rng(0)
    assert stats.shapiro_wilk(rng.normal(size=80)) > 0.96 > stats.shapiro_wilk(rng.exponential(size=80))


def test_normality(spark):
    rng = np.random.default_rng(1)
    made = lambda x: stats.normality(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").first()
    a, b = made(rng.normal(size=400)), made(rng.exponential(size=400))
    assert a["anderson"] < 1 < b["anderson"] and a["ks"] < 0.06 < b["ks"]


def test_metrics_and_thresholds(spark, scored):
    assert curves.parse_threshold("fixed:0.42") == 0.42 == curves.parse_threshold("fixed_0.42") == curves.parse_threshold("0.42") and curves.parse_threshold("f1") is None
    point = curves.operating_point(scored).first()["threshold"]
    best = min(curves.roc_curve(scored).collect(), key=lambda r: (round(r["fpr"] ** 2 + (1 - r["tpr"]) ** 2, 12), -r["threshold"]))
    assert point == best["threshold"]
    none = curves.metrics(spark.createDataFrame([(0, 1)], "pred int, y int")).first()
    assert none["precision"] == 0 and none["f1"] == 0
    b = {r["metric"]: r for r in curves.bootstrap(scored.dropna().withColumn("pred", (F.col("score") > 0.5).cast("int")), 60).collect()}
    m = curves.metrics(scored.dropna().withColumn("pred", (F.col("score") > 0.5).cast("int"))).first()
    assert all(b[k]["low"] <= m[k] <= b[k]["high"] for k in curves.METRICS)


def test_bootstrap_equals_resampling_rows(spark):
    """Means, deviations and intervals of 2,000 rounds against rows drawn one by one within each class."""
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.3).astype(int)
    score = np.round(np.clip(0.3 + 0.25 * y + 0.2 * rng.normal(size=400), 0, 0.999), 2)  # within buckets of 1 / 1,024 no two differ
    pred = (score >= 0.45).astype(int)
    df = spark.createDataFrame([(float(s), int(p), int(t)) for s, p, t in zip(score, pred, y)], "score double, pred int, y int")
    got = {r["metric"]: r for r in curves.bootstrap(df, 2000, score="score").collect()}
    one, zero, found = np.flatnonzero(y == 1), np.flatnonzero(y == 0), {k: [] for k in got}
    for _ in range(1500):
        k = np.concatenate([rng.choice(one, len(one)), rng.choice(zero, len(zero))])
        s, p, t = score[k], pred[k], y[k]
        tp, fp, fn, tn = ((p == a) & (t == b) for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)))
        tp, fp, fn, tn = tp.sum(), fp.sum(), fn.sum(), tn.sum()
        order = np.argsort(-s, kind="stable")
        ends = np.flatnonzero(np.diff(s[order], append=-1))
        hits, picked = np.cumsum(t[order])[ends], ends + 1
        values = {
            "accuracy": (tp + tn) / 400, "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2, "precision": tp / (tp + fp), "recall": tp / (tp + fn), "f1": 2 * tp / (2 * tp + fp + fn),
            "roc_auc": ((s[t == 1][:, None] > s[t == 0]).mean() + (s[t == 1][:, None] == s[t == 0]).mean() / 2), "average_precision": (np.diff(hits, prepend=0) * hits / picked).sum() / hits[-1],
        }
        for m, v in values.items():
            found[m].append(v)
    assert got.keys() == found.keys() and len(found) == 7
    for m, v in found.items():
        v = np.array(v)
        assert got[m]["mean"] == pytest.approx(v.mean(), abs=4 * v.std() / np.sqrt(1500)) and got[m]["sd"] == pytest.approx(v.std(), rel=0.1)
        assert got[m]["low"] == pytest.approx(np.quantile(v, 0.025), abs=0.35 * v.std()) and got[m]["high"] == pytest.approx(np.quantile(v, 0.975), abs=0.35 * v.std())


def test_pruned_neighbours_equal_the_block_search(spark, monkeypatch):
    """On clusters a query meets few cells; on any rows, with repeats and ties, it finds what the search of all finds."""
    from driftloom.operators import neighbours

    monkeypatch.setattr(neighbours, "PER_PIVOT", 20)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8)) * 20
    x = np.concatenate([centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)), np.repeat(centres[:2], 30, axis=0), rng.integers(0, 2, (60, 8))])
    names = [f"x{k}" for k in range(8)]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names))
    q = df.filter("id % 7 = 0").withColumnRenamed("id", "q")
    for others in (False, True):
        ref = df if not others else df.withColumnRenamed("id", "q2")
        want = neighbours.nearest_vectors(q, ref, names, "q", "q2" if others else "id", 4, others=others)
        got = neighbours.pruned_neighbours(q, ref, names, "q", "q2" if others else "id", 4, others)
        cols = ["q", "q2" if others else "id", "place"]
        assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())
        visited = got.select("q", "visited", "cells").distinct().agg(F.avg("visited").alias("v"), F.max("cells").alias("c")).first()
        assert visited["v"] < visited["c"] / 3
    few = neighbours.pruned_neighbours(q.limit(2), df.limit(2), names, "q", "id", 4)
    assert few.count() == 4 and neighbours.pruned_neighbours(q, df.limit(0), names, "q", "id", 4).count() == 0 and neighbours.pruned_neighbours(q.limit(0), df, names, "q", "id").count() == 0


def test_isotonic_steps_of_any_number_are_one_expression(spark):
    rng = np.random.default_rng(2)
    at = np.sort(rng.random(3000))
    value = np.sort(rng.random(3000))
    x = np.concatenate([rng.random(400), at[:50], [-1.0, 2.0]])
    cal = models.Calibrator("isotonic", at=at.tolist(), value=value.tolist())
    got = {r["x"]: r["prob"] for r in cal.apply(spark.createDataFrame([(float(v), float(v)) for v in x], "x double, prob double")).collect()}
    assert [got[float(v)] for v in x] == pytest.approx(np.interp(x, at, value))
    step = models.Calibrator("isotonic", at=[0.2, 0.5, 0.5, 0.9], value=[0.1, 0.1, 0.6, 0.6])
    got = [r["prob"] for r in step.apply(spark.createDataFrame([(0.1,), (0.4,), (0.5,), (0.7,), (None,)], "prob double")).collect()]
    assert got == pytest.approx([0.1, 0.1, 0.6, 0.6, None])


def test_bootstrap_of_one_class_and_of_nothing(spark):
    got = {r["metric"]: r for r in curves.bootstrap(spark.createDataFrame([(0.5, 1, 1)] * 3, "score double, pred int, y int"), 120, score="score").collect()}
    assert got["recall"]["mean"] == 1 and got["roc_auc"]["mean"] is None and got["average_precision"]["mean"] == 1
    assert curves.bootstrap(spark.createDataFrame([], "score double, pred int, y int"), 60, score="score").count() == 0


def test_folds_hold_groups_together(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(g, int(g % 3 == 0)) for g in range(60) for _ in range(rnd.randrange(1, 9))], "g long, y int")
    folds = prepare.group_folds(df, "g", "y", 4)
    assert folds.count() == 60 == folds.select("g").distinct().count()
    shares = [r["s"] for r in df.join(folds, "g").groupBy("fold").agg(F.avg("y").alias("s")).collect()]
    assert len(shares) == 4 and max(shares) - min(shares) < 0.15


def test_smote_evens_classes(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, int(i < 8), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))], "id long, y int, a double, b double")
    got = prepare.smote(df, ["a", "b"], "y", "id").collect()
    ones = [r for r in got if r["y"] == 1]
    assert len(ones) == 32 == sum(r["y"] == 0 for r in got) and sum(r["synthetic"] for r in got) == 24
    box = [(min(c), max(c)) for c in zip(*((r["a"], r["b"]) for r in ones if not r["synthetic"]))]
    assert all(box[0][0] <= r["a"] <= box[0][1] and box[1][0] <= r["b"] <= box[1][1] and r["id"] < 8 for r in ones)


def test_scaling_of_unseen_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 10.0), ("c", 6.0)], "d string, v double")
    fitted = prepare.fit_scaler(df.filter("d <> 'c'"), ["v"], "standard", ["d"])
    got = {(r["d"], round(r["v"], 6)) for r in prepare.scale(df, fitted, ["v"], ["d"], prepare.macro_scaler(fitted, ["v"])).collect()}
    assert got == {("a", -1.0), ("a", 1.0), ("b", 0.0), ("c", 0.0)}


def test_rebalance_methods(spark):
    df = spark.createDataFrame([(i, d, i % 4 == 0) for i, d in enumerate(["a"] * 40 + ["b"] * 20 + ["c"] * 8)], "id long, d string, y boolean")
    size = lambda m, **k: {r["d"]: r["n"] for r in prepare.rebalance(df, "d", "y", "id", m, **k).groupBy("d").agg(F.count("*").alias("n")).collect()}
    assert size("none") == {"a": 40, "b": 20, "c": 8} and size("min") == {"a": 8, "b": 8, "c": 8} and size("median")["a"] == 20 and size("cap_absolute", cap=12)["b"] == 12 and size("cap_to_second_largest")["a"] == 20
    for bad in ({"method": "cap_absolute"}, {"method": "odd"}):
        with pytest.raises(ValueError):
            prepare.rebalance_targets(df, "d", "y", **bad)


def test_mrmr_avoids_doubles():
    c = np.array([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1]])
    assert prepare.mrmr(c, np.array([1.0, 0.95, 0.6])) == [0, 2, 1]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        y = g % 2
        for _ in range(6):
            rows.append((f"s{g}", y, float(rng.normal(1.5 * y)), float(rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "id string, y int, a double, b double, c double").cache()


def test_package_round_trip(spark, table, tmp_path):
    p = models.train_package(table, "lr", ["a", "b", "c"], "id", {"regParam": 0.01}, folds=2)
    got = models.predict(p, table, "patient").collect()
    assert len(got) == 40 and sum(r["pred_mean"] == r["ground_truth"] for r in got) >= 30
    p.save(str(tmp_path / "p"))
    p.save(str(tmp_path / "p"))
    assert (tmp_path / "p.back" / "model").exists()
    again = models.load_package(str(tmp_path / "p"))
    a, b = ([round(r["prob"], 9) for r in models.predict(x, table).orderBy("id", "a").collect()] for x in (p, again))
    assert a == b and again.threshold == p.threshold


def test_isotonic_is_monotone(spark, table):
    s = models.score(models.make("lr", ["a"]).fit(table), table)
    cal = models.fit_calibrator(s, "isotonic")
    got = [(r["x"], r["prob"]) for r in cal.apply(s.withColumn("x", F.col("prob"))).select("x", "prob").collect()]
    ordered = [v for _, v in sorted(got)]
    assert all(p <= q + 1e-12 for p, q in zip(ordered, ordered[1:]))


def test_search_and_importance(spark, table):
    assert models.sample_params("rf", 3) == models.sample_params("rf", 3) and models.sample_params("lr", 1, {"regParam": 0.5})["regParam"] == 0.5
    tried = [{"params": {"maxDepth": 3, "stepSize": 0.1, "k": "x"}, "objective": 0.9}, {"params": {"maxDepth": 6, "stepSize": 0.3, "k": "y"}, "objective": 0.3}]
    assert models.combine_params(tried)["maxDepth"] == 3 and models.combine_params(tried, "weighted") == {"maxDepth": 4, "stepSize": 0.15, "k": "x"}
    got = {r["feature"]: r["rank"] for r in models.importance_rank(table, ["a", "b", "c"], 2).collect()}
    assert got["a"] == 1


def test_nested_validation(spark, table):
    seen = []
    r = models.nested_validation(table, "lr", ["a", "b"], "id", outer=2, inner=2, calls=1, progress=seen.append)
    again = models.nested_validation(table, "lr", ["a", "b"], "id", outer=2, inner=2, calls=1, done=seen)
    assert again.count() == 4
    grid = models.grid_search(table, "lr", ["a"], "id", {"regParam": [0.01, 0.1, 10.0], "elasticNetParam": [0.0]}, folds=2, most=2)
    assert len(grid) == 2 and grid[0]["objective"] >= grid[1]["objective"]
    assert r.count() == 4 == len(seen) and models.summarise_validation(r).filter("roc_auc_mean > 0.7").count() == 2


def test_stream_islands_equal_batch(spark):
    from driftloom.functions.storage import materialise
    from driftloom.operators import segments
    from driftloom.streaming import segments as streams

    rnd = random.Random(8)
    rows = [(k, (t + 9000) * 1_000_000, bool(rnd.random() < 0.5)) for k in range(3) for t in range(60)]
    df = spark.createDataFrame(rows, "recording_id long, us long, flag boolean")
    want = {(r["recording_id"], r["flag"], r["start_us"], r["end_us"], r["n"]) for r in segments.islands(df, ["recording_id"], ["us"], "flag").collect()}
    shaped = df.select("recording_id", F.timestamp_micros("us").alias("time"), "flag")
    end = spark.createDataFrame([(99, 10_000_000_000, True), (99, 20_000_000_000, True)], "recording_id long, us long, flag boolean").select("recording_id", F.timestamp_micros("us").alias("time"), "flag")
    held = materialise(shaped.filter(F.second("time") % 2 == 0), "even")
    folder = held.inputFiles()[0].rsplit("/", 1)[0]
    for part in (shaped.filter(F.second("time") % 2 == 1), end.limit(1), end.orderBy(F.col("time").desc()).limit(1)):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 10).parquet(folder)
    q = streams.islands(stream, "60 seconds").writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["recording_id"], r["flag"], round(r["start_time"].timestamp() * 1e6), round(r["end_time"].timestamp() * 1e6), r["n"]) for r in spark.table("runs").collect() if r["recording_id"] != 99}
    assert got <= want and len(got) >= len(want) - 3


def test_smote_by_keys_and_blocks(spark, monkeypatch):
    from driftloom.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(f, i, int(i < 6 + f), *(float(v) for v in rng.normal(size=2))) for f in range(2) for i in range(30)] + [(2, 0, 1, 0.0, 0.0), (2, 1, 0, 1.0, 1.0), (2, 2, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "fold long, id long, y int, a double, b double")
    got = prepare.smote(df, ["a", "b"], "y", "id", k=3, keys=["fold"]).collect()
    for f in range(2):
        own = [r for r in got if r["fold"] == f]
        assert sum(r["y"] == 1 for r in own) == sum(r["y"] == 0 for r in own) == 30 - 6 - f
        real = {r["id"]: (r["a"], r["b"]) for r in own if r["y"] == 1 and not r["synthetic"]}
        for r in (r for r in own if r["synthetic"]):
            # On the line from some row to one of its three nearest, nearer to the row whose group it has.
            fits = []
            for p in real:
                near = sorted((q for q in real if q != p), key=lambda q: np.hypot(real[p][0] - real[q][0], real[p][1] - real[q][1]))[:3]
                for q in near:
                    a, b, c = np.array(real[p]), np.array(real[q]), np.array([r["a"], r["b"]])
                    t = float((c - a) @ (b - a) / ((b - a) @ (b - a)))
                    fits.append(np.allclose(a + t * (b - a), c) and -1e-9 <= t <= 1 + 1e-9 and r["id"] == (p if t <= 0.5 else q))
            assert any(fits)
    assert not any(r["synthetic"] for r in got if r["fold"] == 2)


def test_nearest_vectors_against_all_pairs(spark, monkeypatch):
    from driftloom.operators import neighbours

    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(60, 3)), 1)
    df = spark.createDataFrame([(i % 2, i, *map(float, v)) for i, v in enumerate(x)], "g long, id long, a double, b double, c double")
    for block in (9, 20_000):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got = neighbours.nearest_vectors(df.withColumnRenamed("id", "q"), df, list("abc"), "q", "id", 4, ["g"], others=True).collect()
        found = {(r["q"], r["place"]): (r["id"], round(r["distance"], 9)) for r in got}
        for i in range(60):
            near = sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 9), j) for j in range(60) if j != i and j % 2 == i % 2)[:4]
            assert [found[i, k + 1] for k in range(4)] == [(j, d) for d, j in near]
        assert len(got) == 240
