"""Kernels against closed forms, and whole plans on a made recording."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import features as ft
from driftloom.operators import rollup, validate
from driftloom.operators import segments as seg
from driftloom.operators import signal as sig
from driftloom.operators import timeaxis as tx
from driftloom.plans import process as plan

KEY = ["recording_id"]


def gain(sections, f, fs):
    z = np.exp(2j * np.pi * f / fs)
    return np.prod([abs((b0 + b1 / z + b2 / z**2) / (a0 + a1 / z + a2 / z**2)) for b0, b1, b2, a0, a1, a2 in sections])


def test_butterworth_gains():
    low, high, band = sig.butterworth_sections(100, None, 20), sig.butterworth_sections(100, 0.8, None), sig.butterworth_sections(100, 5, 20)
    assert gain(low, 0, 100) == pytest.approx(1) and gain(low, 20, 100) == pytest.approx(0.5**0.5) and gain(low, 45, 100) < 1e-4
    assert gain(high, 0, 100) < 1e-9 and gain(high, 0.8, 100) == pytest.approx(0.5**0.5) and gain(high, 30, 100) == pytest.approx(1, abs=1e-6)
    assert gain(band, 5, 100) == pytest.approx(0.5**0.5) == gain(band, 20, 100) and gain(band, 10, 100) == pytest.approx(1, abs=1e-3)
    for bad in ((100, None, 60), (100, 20, 5), (100, None, None)):
        with pytest.raises(ValueError):
            sig.butterworth_sections(*bad)


def test_filter_keeps_phase():
    t = np.arange(1000) / 100
    x = np.stack([np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 2 * t) + np.sin(2 * np.pi * 40 * t)], axis=1)
    y = sig.filter_both_ways(sig.butterworth_sections(100, None, 10), x)
    assert np.abs(y[100:-100] - x[100:-100, :1]).max() < 1e-2
    assert sig.filter_both_ways(sig.butterworth_sections(100, None, 10), np.ones((100, 1))) == pytest.approx(1)
    with pytest.raises(ValueError):
        sig.filter_both_ways(sig.butterworth_sections(100, None, 10), np.ones((5, 1)))


def test_sphere_fit_finds_offset_and_gain():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(400, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    offset, scale = np.array([0.03, -0.05, 0.02]), np.array([1.04, 0.97, 1.01])
    o, g, before, after, used = sig.fit_sphere((u - offset) / scale)
    assert used and after < 0.001 < before and np.allclose(o, offset, atol=0.005) and np.allclose(g, scale, atol=0.005)
    assert not sig.fit_sphere(np.abs(u))[4] and not sig.fit_sphere(u[:10])[4]


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 1.5, 2.5, 0])
    p, high = ft.find_peaks(x)
    assert p.tolist() == [1, 4, 7, 9] and high.tolist() == [1, 3, 0.5, 2.5]
    assert ft.find_peaks(x, distance=3)[0].tolist() == [1, 4, 9] and ft.find_peaks(x, height=2, prominence=1)[0].tolist() == [4, 9]
    assert len(ft.find_peaks(np.zeros(5))[0]) == 0


def test_spectrum():
    t = np.arange(1000) / 100
    f, p = ft.welch(np.sin(2 * np.pi * 8 * t), 100)
    assert f[p.argmax()] == 8
    noise = np.random.default_rng(0).normal(size=200_000)
    for how in ("mean", "median"):
        assert ft.welch(noise, 100, how)[1][5:45].mean() == pytest.approx(2 / 100, rel=0.05)
    assert ft.spectral(np.sin(2 * np.pi * 8 * t), ft.Setup())["f1"] == 8


def test_autocorrelation_and_nonlinear():
    t = np.arange(600) / 100
    a = ft.autocorrelation(np.sin(2 * np.pi * 2 * t), 200)
    assert a[0] == pytest.approx(1) and 45 <= ft.find_peaks(a, prominence=0.1)[0][0] <= 55
    assert np.isnan(ft.autocorrelation(np.ones(50), 10)).all()
    rng = np.random.default_rng(1)
    assert ft.sample_entropy(rng.normal(size=500)) > ft.sample_entropy(np.sin(2 * np.pi * t)) and np.isnan(ft.sample_entropy(np.ones(50)))
    assert abs(np.mean([ft.hurst_rs(rng.normal(size=2000)) for _ in range(8)]) - 0.5) < 0.1 < ft.hurst_rs(np.cumsum(rng.normal(size=2000))) - 0.5


def test_hopkins_and_clusters():
    rng = np.random.default_rng(5)
    even, lumps = rng.uniform(size=300), np.concatenate([rng.normal(c, 0.003, 60) for c in (0.1, 0.35, 0.6, 0.9)])
    assert 0.4 < ft.hopkins(even) < 0.6 and ft.hopkins(lumps) < 0.2 and np.isnan(ft.hopkins(np.ones(4)))
    assert ft.clusters(np.concatenate([lumps, [0, 1]]), ft.Setup())["kde_n_peaks"] >= 3


def rows_frame(spark, n=500, seed=0):
    rng = np.random.default_rng(seed)
    us = np.sort(rng.integers(0, 60 * tx.DAY_US, n))
    return spark.createDataFrame([(int(k % 3), int(u), int(i), float(v)) for i, (k, u, v) in enumerate(zip(rng.integers(0, 3, n), us, rng.normal(size=n)))], "recording_id long, us long, id long, value double")


def test_islands_part_the_rows(spark):
    df = rows_frame(spark).withColumn("flag", F.when(F.col("value") > 1.2, None).otherwise(F.col("value") > 0))
    whole = seg.islands(df, KEY, ["us", "id"], "flag", span_us=10**18).orderBy("recording_id", "start_us").collect()
    cut = seg.islands(df, KEY, ["us", "id"], "flag", span_us=tx.DAY_US).orderBy("recording_id", "start_us").collect()
    strip = lambda rows: [(r["recording_id"], r["flag"], r["start_us"], r["end_us"], r["n"]) for r in rows]
    assert strip(whole) == strip(cut) and sum(r["n"] for r in cut) == 500
    one = seg.segments(df.limit(1).withColumn("flag", F.lit(True)), KEY, ["us", "id"], "flag").collect()
    assert [(r["length_us"], r["n"]) for r in one] == [(0, 1)]


def test_sessions_do_not_depend_on_spans(spark):
    df = rows_frame(spark)
    gap = tx.DAY_US // 2
    a, b = (sorted(tuple(r) for r in seg.sessions(df, KEY, gap, span_us=s).select("recording_id", "start_us", "end_us", "n").collect()) for s in (10**18, tx.DAY_US))
    assert a == b and sum(r[3] for r in a) == 500
    step = spark.createDataFrame([(1, 0), (1, gap), (1, 2 * gap + 1)], "recording_id long, us long")
    assert sorted(r["n"] for r in seg.sessions(step, KEY, gap).collect()) == [1, 2]


def test_points_and_intervals(spark):
    points = rows_frame(spark)
    held = seg.sessions(points.filter("value > 0"), KEY, tx.DAY_US)
    got = {(r["id"], r["inside"]) for r in seg.points_in_intervals(points, held, KEY).collect()}
    intervals = [tuple(r) for r in held.select("recording_id", "start_us", "end_us").collect()]
    assert got == {(r["id"], any(k == r["recording_id"] and a <= r["us"] <= b for k, a, b in intervals)) for r in points.collect()} and len(got) == 500


def test_night_overlap_edges(spark):
    h = seg.HOUR_US
    cases = [((0, 5 * h), 5.0), ((8 * h, 23 * h), 2.0), ((20 * h, 34 * h), 11.0), ((0, 49 * h), 0.0), ((10 * h, 12 * h), 0.0)]
    df = spark.createDataFrame([(a, b) for (a, b), _ in cases], "start_us long, end_us long")
    assert [r["o"] for r in df.select(seg.night_overlap_h(F.col("start_us"), F.col("end_us")).alias("o")).collect()] == [o for _, o in cases]


def test_duplicates_go_altogether(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 1, 1.0), (1, 2, 2.0)], "recording_id long, us long, value double")
    once = tx.drop_duplicate_times(df, KEY, "us")
    assert [r["us"] for r in once.collect()] == [2] and tx.drop_duplicate_times(once, KEY, "us").count() == 1


def test_resampled_grid_is_even(spark):
    df = rows_frame(spark, 200)
    got = tx.resample_nearest(df.dropDuplicates(["recording_id", "us"]), KEY, tx.DAY_US // 4, "value").orderBy("recording_id", "us").collect()
    for k in range(3):
        us = [r["us"] for r in got if r["recording_id"] == k]
        assert set(np.diff(us)) == {tx.DAY_US // 4}


def test_validation(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, float("nan"))], "recording_id long, x double, y double, z double").withColumn("time", F.lit("2024-01-01").cast("timestamp_ntz"))
    with pytest.raises(ValueError):
        validate.check_recording(df.drop("x"))
    with pytest.raises(ValueError):
        validate.check_recording(df.withColumn("odd", F.lit(1)))
    with pytest.raises(Exception, match="missing axes"):
        validate.check_recording(df).collect()
    assert validate.check_recording(df, most_missing=1.0).count() == 1
    assert validate.missing_processed(df) == ["wear", "sptw", "sleep_bout"] and not validate.is_processed(df)


def test_rollup_checks(spark):
    nights = spark.createDataFrame([("a", 0.5, 1, 1), ("a", 0.5, 0, 1)], "id string, prob double, pred int, truth int")
    p = rollup.patient_votes(rollup.night_to_patient(nights, "id", "prob", "pred", "truth"), 0.5).first()
    assert (p["pred_mean"], p["pred_majority"], p["pred_any"], p["pred_all"]) == (0, 1, 1, 0)
    mixed = nights.union(spark.createDataFrame([("a", 0.5, 1, 0)], nights.schema))
    with pytest.raises(Exception, match="ground truth"):
        rollup.night_to_patient(mixed, "id", "prob", "pred", "truth").collect()
    with pytest.raises(ValueError):
        rollup.movement_to_night(nights, ["id"], ["prob"], ["mode"])


def test_features_can_be_registered(spark):
    ft.register_feature("span", lambda x, s: {"span": float(x.max() - x.min())})
    df = rows_frame(spark, 60)
    got = ft.kernel_features(df, KEY, ["us"], ["value"], ["span"]).collect()
    want = {r["recording_id"]: r["s"] for r in df.groupBy("recording_id").agg((F.max("value") - F.min("value")).alias("s")).collect()}
    assert {r["recording_id"]: r["span_value"] for r in got} == pytest.approx(want)


def made_recording(spark, hz=4, hours=19):
    """Two recordings from 14:00: still and flat at night with short jerks, moving by day."""
    rows = []
    for name, seed in (("r1", 1), ("r2", 2)):
        rng = np.random.default_rng(seed)
        n = hours * 3600 * hz
        s = np.arange(n) / hz
        night = (s >= 8 * 3600) & (s < 17 * 3600)
        angle = np.where(night, 0.2, np.interp(s, s[:: 20 * hz], rng.uniform(-1.4, 1.4, len(s[:: 20 * hz]))))
        xyz = np.stack([np.cos(angle), np.zeros(n), np.sin(angle)], axis=1) + rng.normal(0, np.where(night, 0.02, 0.1)[:, None], (n, 3))
        for at in rng.uniform(9 * 3600, 16 * 3600, 60):
            k = (s >= at) & (s < at + 6)
            xyz[k] += rng.normal(0, 0.8, (k.sum(), 3))
        rows.append((name, s, xyz))
    import pandas as pd

    start = pd.Timestamp("2024-03-01 14:00")
    pdf = pd.concat([pd.DataFrame({"recording_id": name, "time": start + pd.to_timedelta(s, unit="s"), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]}) for name, s, v in rows])
    return spark.createDataFrame(pdf, "recording_id string, time timestamp_ntz, x double, y double, z double")


def test_recording_to_night_features(spark):
    cfg = plan.ProcessConfig(fs=4.0, lowpass_hz=None, highpass_hz=0.3, resample=True)
    done = plan.process(made_recording(spark), cfg)
    n = done.groupBy("recording_id").agg(F.count("*").alias("n"), F.avg(F.col("sptw").cast("int")).alias("s"), F.avg(F.col("wear").cast("int")).alias("w")).collect()
    assert len(n) == 2 and all(r["n"] == 19 * 3600 * 4 and 0.3 < r["s"] < 0.6 and r["w"] > 0.9 for r in n)
    nights = plan.nights_of(done).collect()
    assert len(nights) == 2 and all(7 <= r["length_h"] <= 10 for r in nights)
    found = plan.night_features(done, cfg, ["mean", "std"]).collect()
    assert len(found) == 2 and all(r["n_moves"] > 10 and r["sleep_eff"] > 0.5 and r["mean_mag_mean"] > 0 for r in found)
    assert {f"{f}_mean" for f in ft.local_feature_names()} <= set(found[0].asDict())
    assert plan.restrict_to_nights(done).filter("sptw").count() <= done.filter("sptw").count()


def test_blocks_of_a_filter_equal_its_recursion():
    rng = np.random.default_rng(6)
    x, row = rng.normal(size=(700, 2)), sig.butterworth_sections(100, None, 20)[0]
    s1 = s2 = np.zeros(2)
    want = []
    for v in x:
        y = row[0] * v + s1
        s1, s2 = row[1] * v - row[4] * y + s2, row[2] * v - row[5] * y
        want.append(y)
    assert np.allclose(sig.run_section(row, x, np.zeros((2, 2))), want)
    t = np.arange(400_000)
    assert len(sig.filter_both_ways(sig.butterworth_sections(100, None, 20), np.stack([t, t, t], axis=1) * 1e-5)) == len(t)


def test_wide_medians_equal_narrow_ones(spark, monkeypatch):
    df = rows_frame(spark, 400)
    get = lambda **k: sorted(map(tuple, tx.rolling_medians(df, KEY, ["us", "id"], ["value"], 20, **k).collect()))
    narrow = get()
    monkeypatch.setattr(tx, "WIDE", 5)
    for piece in (7, 50, 10_000):
        assert [(a, b, None if c is None else round(c, 9)) for a, b, c in get(piece=piece)] == [(a, b, None if c is None else round(c, 9)) for a, b, c in narrow]


def test_butterworth_by_pieces_equals_the_whole(spark):
    rng = np.random.default_rng(3)
    n = 9000
    x = np.cumsum(rng.normal(size=n)) / 10 + np.sin(np.arange(n) / 5)
    df = spark.createDataFrame([("a", i * 10_000, float(v)) for i, v in enumerate(x)] + [("b", i * 10_000, float(i)) for i in range(5)], "recording_id string, us long, x double")
    for low, high in ((None, 20), (0.8, None), (5, 20)):
        sections = sig.butterworth_sections(100, low, high)
        whole = sig.filter_both_ways(sections, x[:, None])[:, 0]
        for even in (True, False):
            got = sig.butterworth(df, ["recording_id"], ["x"], 100, low, high, even=even, piece=1).orderBy("recording_id", "us").toPandas()
            assert got["x"][:n].to_numpy() == pytest.approx(whole, abs=1e-9) and got["filtered"][:n].all()
            assert got["x"][n:].tolist() == [0, 1, 2, 3, 4] and not got["filtered"][n:].any()


def test_wide_and_narrow_medians_treat_nulls_alike(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 2, i, None if rng.random() < 0.1 else float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "recording_id long, us long, v double")
    for width in (3, 60):
        got = {(r["recording_id"], r["row"]): r["v_median"] for r in tx.rolling_medians(df, ["recording_id"], ["us"], ["v"], width, piece=70).collect()}
        for rec in (0, 1):
            own = [v for k, _, v in rows if k == rec]
            for i in range(len(own)):
                known = [v for v in own[max(0, i - width + 1) : i + 1] if v is not None]
                want = None if i + 1 < width or not known else float(np.median(known))
                assert got[rec, i + 1] == (None if want is None else pytest.approx(want)), (width, rec, i)


def test_grid_cells_meet_their_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    times = np.unique(rng.integers(0, 5_000, 60)) * 7
    df = spark.createDataFrame([(1, int(t), float(t)) for t in times] + [(2, 5, 1.0)], "recording_id long, us long, v double")
    want = tx.resample_nearest(df, ["recording_id"], 50, "v").toPandas().sort_values(["recording_id", "us"])
    line = tx.resample_linear(df, ["recording_id"], 50, "v").toPandas().sort_values(["recording_id", "us"])
    monkeypatch.setattr(tx, "CELL_STEPS", 7)
    got = tx.resample_nearest(df, ["recording_id"], 50, "v").toPandas().sort_values(["recording_id", "us"])
    assert got.to_numpy().tolist() == want.to_numpy().tolist() and len(got) == (times[-1] - times[0]) // 50 + 2
    assert tx.resample_linear(df, ["recording_id"], 50, "v").toPandas().sort_values(["recording_id", "us"]).to_numpy() == pytest.approx(line.to_numpy())
    plain = [min(times, key=lambda t: (abs(t - g), t)) for g in range(int(times[0]), int(times[-1]) + 1, 50)]
    assert got[got["recording_id"] == 1]["v"].tolist() == [float(t) for t in plain]
