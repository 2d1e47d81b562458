"""Filters, medians and the plan over recordings of many rates; ambiguities settled one after the other."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.operators import signal as sig
from driftloom.operators import timeaxis as tx

KEY = ["recording_id"]


@pytest.mark.parametrize("fs", [30.0, 60.0, 70.0, 90.0, 128.0])
def test_filters_keep_every_row_at_any_rate(spark, fs):
    n, step = 30_000, round(1e6 / fs)
    x = np.random.default_rng(0).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"recording_id": "a", "us": np.arange(n) * step, "x": x}))
    got = sig.butterworth(df, KEY, ["x"], fs, low=0.8, even=True, piece=4000).orderBy("us").toPandas()
    assert len(got) == n and got["filtered"].all() and (got["us"] == np.arange(n) * step).all()
    want = sig.filter_both_ways(sig.butterworth_sections(fs, 0.8, None), x[:, None])[:, 0]
    assert got["x"].to_numpy() == pytest.approx(want, abs=1e-9)


def test_filters_keep_every_row_over_gaps(spark):
    us = np.concatenate([np.arange(9000), np.arange(40_000, 49_000)]) * 16_667
    df = spark.createDataFrame(pd.DataFrame({"recording_id": "a", "us": us, "x": np.sin(us / 1e6)}))
    for even in (True, False):
        got = sig.butterworth(df, KEY, ["x"], 60.0, high=5.0, even=even, piece=4000)
        assert got.count() == len(us) == got.select("us").distinct().count()


def test_each_recording_is_filtered_at_its_rate(spark):
    rng, parts, rates = np.random.default_rng(1), [], []
    for k, fs in enumerate((50.0, 100.0, 12.5, 1.0)):
        n = 4000 if k < 3 else 50
        parts.append(pd.DataFrame({"recording_id": str(k), "us": np.arange(n) * round(1e6 / fs), "x": rng.normal(size=n)}))
        rates.append((str(k), fs, round(1e6 / fs)))
    df = spark.createDataFrame(pd.concat(parts))
    got = sig.butterworth(df, KEY, ["x"], spark.createDataFrame(rates, "recording_id string, fs double, step_us long"), low=1.0, even=True).toPandas()
    for k, part in enumerate(parts):
        own = got[got["recording_id"] == str(k)].sort_values("us")
        want = part["x"] if k == 3 else sig.filter_both_ways(sig.butterworth_sections(rates[k][1], 1.0, None), part[["x"]].to_numpy())[:, 0]  # 1 Hz is too slow
        assert len(own) == len(part) and own["x"].to_numpy() == pytest.approx(np.asarray(want), abs=1e-9) and own["filtered"].all() == (k < 3)


def test_medians_leave_nan_out_at_any_width(spark):
    x = np.random.default_rng(2).normal(size=200)
    x[70] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"recording_id": "a", "us": range(200), "x": x, "width": 51}))
    for rows in (5, 50, 51, "width"):
        got = tx.rolling_medians(df, KEY, ["us"], ["x"], rows).orderBy("row").toPandas()["x_median"].to_numpy()
        n = rows if isinstance(rows, int) else 51
        want = pd.Series(x).rolling(n, min_periods=1).median().to_numpy()
        want[: n - 1] = np.nan
        assert got == pytest.approx(want, nan_ok=True)


def test_rates_are_told_from_steps_and_headers(spark):
    rows = [(r, int(k * step + j)) for r, step, jitter in (("even", 20_000, 0), ("odd", 21_000, 300), ("off", 21_000, 300), ("slow", 3_000_000, 500)) for k in range(300) for j in [(k * 7919) % (jitter + 1)]]
    heads = spark.createDataFrame([("off", 12.5), ("odd", 50.0)], "recording_id string, header_hz double")
    got = {r["recording_id"]: (r["fs"], r["step_us"], r["resample"]) for r in tx.inferred_rates(spark.createDataFrame(rows, "recording_id string, us long"), KEY, ["us"], heads).collect()}
    assert got["even"] == (50.0, 20_000, False) and got["odd"] == (50.0, 20_000, True) and got["off"] == (12.5, 80_000, True)
    assert got["slow"][2] is False and got["slow"][0] == 0.33


def settle(us, wear, sptw, bout):
    """One island after another, on masks that the ones before have changed; which island and window each is, and whether a
    window is overnight, is known from the start."""
    hour, day = 3_600_000_000, 86_400_000_000
    wear, sptw, bout = wear.copy(), sptw.copy(), bout.copy()

    def spans(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        return [(us[a], us[b - 1]) for a, b in zip(edge[::2], edge[1::2])]

    def overnight(a, b):
        date = (a - 12 * hour) // day * day
        return a < date + 32 * hour and b > date + 22 * hour

    def clear(a, b):
        inside = (us >= a) & (us <= b)
        sptw[inside] = bout[inside] = False

    windows = spans(sptw)
    for a, b in spans(~wear & sptw):
        own = [w for w in windows if w[0] <= a and w[1] >= b]
        long_h, sh, eh = (b - a) / hour, a // hour % 24, b // hour % 24
        night = (sh >= 22 or sh <= 8) and (eh >= 22 or eh <= 8)
        if a < us[0] + 4 * hour:
            clear(us[0], b)
        elif b > us[-1] - 4 * hour:
            if any(overnight(*w) for w in own) and long_h > 4:
                clear(*own[0])
            else:
                clear(us[-1] // day * day + 8 * hour, us[-1])
        elif night and long_h < 4:
            wear[(us >= a) & (us <= b)] = True
        elif not night and (sh < 9 or eh > 22):
            clear(a, b)
        elif not night and (not all(overnight(*w) for w in own) or long_h > 4):
            clear(*own[0])
        elif not night and long_h < 4:
            clear(a, b)
    return wear, sptw, bout


def test_ambiguities_equal_settling_them_one_by_one(spark):
    """Rules only take sleep away and only give wear, and none reads a mask, so that the order can't matter."""
    frames, want, changed = [], [], 0
    rnd = random.Random(9)
    for k in range(12):
        n = 6 * 24 * 4  # four days of ten minutes
        us = 1_704_067_200_000_000 + rnd.randrange(24) * 3_600_000_000 + np.arange(n) * 600_000_000
        runs = lambda least, most: np.concatenate([np.full(rnd.randrange(least, most), b) for _ in range(n) for b in (True, False)])[:n]
        wear, sptw = ~(runs(1, 40) & runs(2, 60)), runs(20, 90)
        bout = sptw & runs(3, 20)
        frames.append(pd.DataFrame({"recording_id": k, "us": us, "wear": wear, "sptw": sptw, "sleep_bout": bout}))
        a, b, c = settle(us, wear, sptw, bout)
        want.append(pd.DataFrame({"recording_id": k, "us": us, "wear": a, "sptw": b, "sleep_bout": c}))
        changed += int((a != wear).any()) + int((b != sptw).any())
    got = sig.resolve_ambiguities(spark.createDataFrame(pd.concat(frames)), KEY, ["us"]).select("recording_id", "us", "wear", "sptw", "sleep_bout").orderBy("recording_id", "us").toPandas()
    assert got.astype({"recording_id": "int64"}).equals(pd.concat(want, ignore_index=True).astype({"recording_id": "int64"})) and changed > 15
    rules = sig.ambiguity_rules(spark.createDataFrame(pd.concat(frames)), KEY, ["us"]).groupBy("rule").agg(F.count("*")).collect()
    assert {"1", "2b", "3a", "3b", "3c"} <= {r["rule"] for r in rules}
