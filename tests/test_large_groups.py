"""What must hold for groups of any size, and after a run that was killed."""

import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftloom.functions.storage import scratch_path
from driftloom.operators import features as ft
from driftloom.operators.order import exact_quantiles
from driftloom.sources import tables


def plain_entropy(x, m=3, tolerance=0.2):
    r, n, a, b = tolerance * np.std(x, ddof=1), len(x) - m, 0, 0
    for i in range(n):
        for j in range(i + 1, n):
            if all(abs(x[i + k] - x[j + k]) <= r for k in range(m)):
                b += 1
                a += abs(x[i + m] - x[j + m]) <= r
    return -np.log(a / b) if a and b else float("nan")


@pytest.mark.parametrize("seed", range(6))
def test_entropy_equals_the_loop_over_pairs(seed):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=150), np.round(rng.normal(size=200), 1), np.cumsum(rng.normal(size=180)), np.tile([0.0, 1.0, 0.5], 40), rng.integers(0, 2, 130).astype(float), np.sin(np.arange(210) / 5)][seed]
    assert ft.sample_entropy(x) == pytest.approx(plain_entropy(x), nan_ok=True)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 4), st.floats(0.01, 3), st.integers(0, 9))
def test_near_pairs_equal_the_direct_count(n, width, r, seed):
    p = np.round(np.random.default_rng(seed).normal(size=(n, width)), seed % 3)
    near = (np.abs(p[:, None] - p[None]) <= r).all(axis=2)
    assert ft.near_pairs(p, r) == (near.sum() - n) // 2


def test_entropy_of_a_long_recording_takes_seconds():
    began = time.time()
    x = np.random.default_rng(1).normal(size=200_000)
    assert 2 < ft.sample_entropy(x) < 2.6  # of noise: -ln of the chance that two differ by a fifth of a deviation at most
    assert time.time() - began < 60
    assert np.isnan(ft.sample_entropy(np.ones(50_000))) and ft.sample_entropy(np.tile([0.0, 1.0], 20_000)) == pytest.approx(0, abs=1e-3)


def test_cubics_go_through_what_is_a_cubic():
    x = np.array([0.0, 1.1, 2.3, 3.0, 4.8, 6.0])
    f = lambda v: 2 - v + 0.5 * v**2 - 0.1 * v**3
    at = np.array([0.0, 0.4, 1.1, 2.9, 5.5, 6.0, -0.1, 6.1])
    assert ft.cubic_at(x, f(x), at)[:6] == pytest.approx(f(at[:6])) and np.isnan(ft.cubic_at(x, f(x), at)[6:]).all()
    assert np.isnan(ft.cubic_at(x[:3], f(x[:3]), at)).all()
    y = np.array([1.0, 0.0, 2.0, -1.0, 0.5, 0.0])
    assert ft.cubic_at(x, y, x) == pytest.approx(y)
    jump = lambda e: np.diff(ft.cubic_at(x, y, np.array([x[1] - 3 * e, x[1] - 2 * e, x[1] - e, x[1], x[1] + e, x[1] + 2 * e, x[1] + 3 * e])), 3)
    assert np.ptp(jump(1e-2)) < 1e-8  # one cubic on both sides of the second point


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(3)
    parts = [("a", rng.normal(size=4000)), ("b", np.repeat([1.0, 2.0], 700)), ("c", [5.0]), ("d", np.append(rng.random(300), 1e12)), ("e", np.append(rng.random(50), [np.inf, -np.inf])), ("f", [np.nan, np.nan]), ("g", np.append(rng.integers(0, 9, 500), np.nan).astype(float))]
    df = spark.createDataFrame(pd.DataFrame({"k": np.repeat([n for n, _ in parts], [len(v) for _, v in parts]), "v": np.concatenate([v for _, v in parts])})).withColumn("v", F.when(F.col("v") != 7, F.col("v")))
    shares = (0.0, 0.013, 0.25, 0.5, 0.9, 1.0)
    want = {r["k"]: r["q"] for r in df.filter(~F.isnan("v")).groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    for buckets in (4096, 3):
        got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", shares, buckets).collect()}
        assert got.keys() == want.keys() == set("abcdeg")
        for k in got:
            assert got[k] == pytest.approx(want[k], nan_ok=True)
    assert exact_quantiles(df.limit(0), ["k"], "v", shares).count() == 0


def frame(spark, names, n=30):
    return spark.createDataFrame([(r, k, float(k)) for r in names for k in range(n)], "recording_id string, us long, x double").repartition(6)


def test_a_killed_write_leaves_nothing_half_done(spark):
    path = scratch_path(spark, "processed")
    assert tables.write_processed(frame(spark, ["a", "b 1"]), path) == ["recording_id=a", "recording_id=b 1"] or len(tables.committed(spark, path)) == 2
    fs, to = tables._store(spark, path)
    # a run killed in its writing, one killed between move and entry, and one whose move left a part only
    frame(spark, ["c"], 7).write.partitionBy("recording_id").parquet(f"{path}/_staged/gone")
    frame(spark, ["d"], 5).drop("recording_id").write.parquet(f"{path}/recording_id=d")
    got = tables.read_processed(spark, path)
    assert got.groupBy("recording_id").count().collect() and {r["recording_id"]: r["count"] for r in got.groupBy("recording_id").count().collect()} == {"a": 30, "b 1": 30}
    fresh = tables.write_processed(frame(spark, ["a", "b 1", "c", "d"]), path)
    assert fresh == ["recording_id=c", "recording_id=d"]
    counts = {r["recording_id"]: (r["n"], r["d"]) for r in spark.read.parquet(path).groupBy("recording_id").agg(F.count("*").alias("n"), F.count_distinct("us").alias("d")).collect()}
    assert counts == {k: (30, 30) for k in ("a", "b 1", "c", "d")} and len(tables.committed(spark, path)) == 4
    assert tables.write_processed(frame(spark, ["a", "d"]), path) == []
    assert len(fs.listStatus(to(f"{path}/recording_id=c"))) <= 3  # one file of rows, and its marks


def test_nothing_written_reads_as_nothing(spark):
    path = scratch_path(spark, "none")
    assert tables.read_processed(spark, path) is None and tables.committed(spark, path) == []
    assert tables.write_processed(frame(spark, []), path) == [] and tables.read_processed(spark, path) is None


def test_features_of_new_recordings_only(spark, monkeypatch):
    """A second run makes features of the recording that came since, and keeps the others'."""
    from driftloom import api

    root, seen = scratch_path(spark, "dataset"), []
    at = lambda k: f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}"

    def put(name):
        fs, to = tables._store(spark, root)
        spark.createDataFrame([(at(k), 0.1, 0.2, 1.0) for k in range(120)], "time string, x double, y double, z double").coalesce(1).write.csv(f"{root}/part-{name}", header=True)
        part = next(x.getPath() for x in fs.listStatus(to(f"{root}/part-{name}")) if x.getPath().getName().startswith("part-"))
        fs.mkdirs(to(f"{root}/raw"))
        fs.rename(part, to(f"{root}/raw/{name}.csv"))

    def features(processed, config):
        names = sorted(r[0] for r in processed.select("recording_id").distinct().collect())
        seen.append(names)
        return spark.createDataFrame([(n, 0, 1.5) for n in names], "recording_id string, night int, f double")

    monkeypatch.setattr(api, "night_features", features)
    cfg = api.ProcessConfig(fs=1.0, lowpass_hz=None, highpass_hz=None, calibrate=False, sleep=False)
    for names in (["one", "two"], ["one", "two", "six"]):
        for n in names:
            if n not in [x for s in seen for x in s]:
                put(n)
        spark.createDataFrame([(f"{n}.csv", n) for n in names], "filename string, ID string").coalesce(1).write.mode("overwrite").csv(f"{root}/meta", header=True)
        api.process_dataset(spark, f"{root}/raw", f"{root}/meta", f"{root}/out", cfg)
    assert seen == [["one", "two"], ["six"]]
    assert sorted(r["recording_id"] for r in spark.read.csv(f"{root}/out/night_features", header=True).collect()) == ["one", "six", "two"]
