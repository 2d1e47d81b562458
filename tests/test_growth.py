"""Steps whose work once grew faster than the input: each test failed before its finding was settled."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from driftloom.functions import storage
from driftloom.learning import forest, loader, models, ranks, stats
from driftloom.operators import segments, timeaxis
from driftloom.plans import process


def test_a_forest_is_grown_from_counts_of_whole_tables(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 3000
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = (x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1], "c": np.where(x[:, 2] > 2, np.nan, x[:, 2])}))
    blocks = forest.make_blocks(df, ["a", "b", "c"])
    held = blocks.df.collect()
    codes = np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(-1, 3) for r in held])
    labels = np.concatenate([np.frombuffer(r["y"], np.uint8) for r in held])
    assert len(codes) == n and labels.sum() == y.sum() and codes.max() == blocks.bins - 1 == 31 and blocks.classes == 2
    # Rows stay whole, in another order: the label meets the second number as before.
    assert np.corrcoef(codes[:, 1], labels)[0, 1] == pytest.approx(np.corrcoef(pd.Series(x[:, 1]).rank(), y)[0, 1], abs=0.02)
    got = forest.importances(blocks, 3)
    assert got.sum() == pytest.approx(1) and got.argmax() == 1 and got[1] > 0.6 and (forest.importances(blocks, 3) == got).all()
    monkeypatch.setattr(models, "make", None)  # no round fits a model of a library on rows shuffled anew
    told = {r["feature"]: r["state"] for r in models.importance_rank(df, ["a", "b", "c"], 8).collect()}
    assert told["b"] == "confirmed" and set(told.values()) <= {"confirmed", "rejected", "tentative"}


def test_splits_of_counts_equal_all_cuts():
    n = np.random.default_rng(0).integers(0, 9, (3, 6, 3)).astype(float)
    n = n * (n[0].sum() / n.sum(axis=(1, 2)))[:, None, None]
    n[1:, 0] += n[0].sum(axis=0) - n[1:].sum(axis=1)  # each feature has all rows, by class
    f, b, gain = forest.best_split(n)
    impure = lambda c: c.sum() - (c**2).sum() / max(c.sum(), 1)
    every = {(i, k): impure(n[0].sum(axis=0)) - impure(n[i, : k + 1].sum(axis=0)) - impure(n[i, k + 1 :].sum(axis=0)) for i in range(3) for k in range(5) if min(n[i, : k + 1].sum(), n[i, k + 1 :].sum()) >= 1}
    assert gain == pytest.approx(max(every.values())) and every[f, b] == pytest.approx(gain)


def test_features_are_ranked_from_one_running_count(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 30_000
    y = (rng.random(n) < 0.4).astype(int)
    x = {"weak": y + 4 * rng.normal(size=n), "strong": y + rng.normal(size=n), "stronger": np.round(y + 0.7 * rng.normal(size=n), 1), "none": rng.normal(size=n), "few": np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 3, n) + y)}
    frame = pd.DataFrame({"y": y, **x})
    df = spark.createDataFrame(frame)
    tested = {r["feature"]: r for r in stats.mann_whitney(df.unpivot("y", list(x), "feature", "v"), "v", "y", ["feature"]).collect()}
    for f in x:
        known = frame[["y", f]].dropna()
        assert tested[f]["rho"] == pytest.approx(np.corrcoef(known[f].rank(), known["y"])[0, 1], abs=1e-12)
    # p is 0 for both, but one is far surer than the other.
    assert tested["strong"]["p"] == tested["stronger"]["p"] == 0
    monkeypatch.setattr(stats, "spearman", None)
    got = {r["feature"]: r for r in loader.rank_features(df.drop("few"), ["weak", "strong", "stronger", "none"]).collect()}
    for how in ("correlation", "rank_correlation", "significance"):
        assert [got[f][how] for f in ("stronger", "strong", "weak", "none")] == [1, 2, 3, 4]
    monkeypatch.undo()
    ranks = loader.rank_features(df.withColumn("y", df.y + 2), ["weak", "strong", "none"]).collect()
    assert {r["feature"]: r["rank_correlation"] for r in ranks} == {"strong": 1, "weak": 2, "none": 3}


def test_running_sums_deal_each_value_once(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (0, 2.0, 0), (0, 1.0, 0), (1, 5.0, 1), (1, 5.0, 1), (1, -3.0, 0), (1, None, 1)], "g long, v double, y long")
    t = ranks.running(df, "v", {"ones": F.sum("y"), "n": F.count("*")}, ["g"])
    assert sorted(map(tuple, t.collect())) == [(0, 1.0, 1, 2, 1, 2), (0, 2.0, 0, 1, 1, 3), (1, -3.0, 0, 1, 0, 1), (1, 5.0, 2, 2, 2, 3)]
    plan = t._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning" in line and " v#" in line]
    assert len(dealt) == 1  # the ends and the cells' totals are no sums of each value


@pytest.mark.parametrize("kind", ["sigmoid", "isotonic"])
def test_calibrators_take_equal_scores_as_one_row(spark, kind, monkeypatch):
    rng = np.random.default_rng(9)
    q = rng.integers(1, 20, 4000) / 20
    y = (rng.random(4000) < q**2).astype(int)
    held, write = [], models.materialise
    monkeypatch.setattr(models, "materialise", lambda df, name: held.append(write(df, name)) or held[-1])
    cal = models.fit_calibrator(spark.createDataFrame(pd.DataFrame({"prob": q, "y": y})), kind)
    assert [h.count() for h in held] == [19]
    asked = spark.createDataFrame([(0.0,), *((float(v),) for v in np.unique(q)), (1.0,)], "prob double")
    got = [r[0] for r in cal.apply(asked).coalesce(1).collect()]
    assert got == sorted(got)
    assert got[1:-1] == pytest.approx(pd.Series(y).groupby(q).mean().tolist(), abs=0.1)


def test_an_objective_scores_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x

    df = spark.createDataFrame([(k / 10, int(k > 4)) for k in range(10)], "x double, y int").withColumn("prob", told("x"))
    assert models.objective(df) == pytest.approx((1 + 1) / 2) and seen.value == 10


def test_samples_are_made_by_as_many_tasks_as_they_need(spark, tmp_path, monkeypatch):
    from driftloom import queries_signal
    from driftloom.functions import storage

    monkeypatch.setattr(storage, "TASK_ROWS", 1000)
    spark.range(queries_signal.HOST * 4).select(F.col("id").alias("event_id"), F.lit(1.0).alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    made = queries_signal.hosts(spark, str(tmp_path), 10)
    sizes = made.groupBy(F.spark_partition_id()).count().collect()
    assert made.count() == queries_signal.HOST * 40 and max(r["count"] for r in sizes) <= 1500


def test_the_plan_keeps_little_on_disk_and_leaves_even_samples(spark, monkeypatch):
    """Every step's table and shuffle stayed until the session's end, and samples that were the grid were brought to it."""
    k = np.arange(3 * 3600)
    x = np.where(k % 3600 < 1800, 0.3 * np.sin(k), 0.1)
    pdf = pd.DataFrame({"recording_id": 1 + k % 2, "time": pd.Timestamp("2024-01-01 20:00") + pd.to_timedelta(k // 2 * 10, unit="s"), "x": x, "y": x / 2, "z": 1 - x})
    cfg = process.ProcessConfig(fs=0.1, lowpass_hz=None, highpass_hz=None, bin_s=60, epoch_s=60, smooth_s=600, still_sd=0.001)
    made, write = [], storage.materialise
    monkeypatch.setattr(process, "materialise", lambda df, name: made.append((name, write(df, name))) or made[-1][1])
    early = pdf.copy()
    early.loc[[100, 201], "time"] += pd.Timedelta("1s")  # brought back to the grid
    brought = process.process(spark.createDataFrame(early), cfg)
    assert [name for name, _ in made].count("signal") == 1
    monkeypatch.setattr(process.tx, "resample_nearest_struct", None)
    done = process.process(spark.createDataFrame(pdf), cfg)
    shown = lambda df: df.orderBy("recording_id", "us").toPandas()
    pd.testing.assert_frame_equal(shown(done), shown(brought))
    left = [name for name, df in made if name in ("clean", "signal") and spark._jvm.java.io.File(df._jdf.inputFiles()[0].replace("file:", "").replace("//", "/")).exists()]
    assert not left


def test_places_and_steps_of_a_recording_come_of_its_stretches(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"id": rng.permutation(n), "recording_id": rng.choice(["a", "b", None], n), "us": np.cumsum(rng.integers(0, 3, n)) * 20_000_000})
    df = spark.createDataFrame(pdf)
    w = timeaxis.ordered(["recording_id"], ["us", "id"])
    want = {r["id"]: r["k"] for r in df.withColumn("k", F.row_number().over(w)).collect()}
    got = timeaxis.numbered_rows(df, ["recording_id"], ["us", "id"], "k")
    assert "_span" in got._jdf.queryExecution().optimizedPlan().toString() and {r["id"]: r["k"] for r in got.collect()} == want
    plain = timeaxis.with_gaps(df, ["recording_id"], ["us", "id"]).filter("gap_us > 0 AND gap_us <= 60000000").groupBy("recording_id").agg(F.count("*").alias("n"), F.round(1e6 / F.avg("gap_us"), 2).alias("r")).collect()
    told = timeaxis.sample_rate(df, ["recording_id"], ["us", "id"])
    assert {r["recording_id"]: (r["n_steps"], r["rate_hz"]) for r in told.collect()} == {r["recording_id"]: (r["n"], r["r"]) for r in plain}


def test_nights_are_found_once(spark, monkeypatch):
    """Bouts and a night's numbers each sorted all samples anew to find the nights."""
    k = np.arange(9 * 360)
    pdf = pd.DataFrame({"recording_id": 1, "us": k * 10_000_000 + 22 * segments.HOUR_US, "x": np.where(k % 30 < 3, 0.9, 0.1), "y": 0.0, "z": 0.0, "wear": True, "sptw": (k > 100) & (k < 3000), "sleep_bout": k % 7 > 2})
    done = spark.createDataFrame(pdf)
    nights = process.nights_of(done)
    want = process.movements(done).orderBy("start_us").collect()
    monkeypatch.setattr(process, "nights_of", None)
    bouts = process.movements(done, nights=nights)
    assert len(want) > 10 and bouts.orderBy("start_us").collect() == want
    assert process.global_features(done, bouts, nights=nights).count() == 1
