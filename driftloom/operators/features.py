"""Features of movement bouts and nights: moments, quantiles, energy, intervals as SQL; spectra, peaks and non-linear
measures as NumPy kernels that Spark runs a bout at a time."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.grouped import runs
from driftloom.functions.storage import gathered

from .order import exact_quantiles
from .timeaxis import ordered

HOUR_US = 3_600_000_000


# --- as aggregates


def moments(value: str, name: str | None = None) -> list[Column]:
    """Mean, population deviation, biased skewness and excess kurtosis."""
    n = name or value
    return [F.avg(value).alias(f"mean_{n}"), F.stddev_pop(value).alias(f"std_{n}"), F.skewness(value).alias(f"skew_{n}"), F.kurtosis(value).alias(f"kurt_{n}")]


def quantiles(value: str, name: str | None = None) -> list[Column]:
    n = name or value
    q = F.percentile(F.col(value), F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return [*(q[k].alias(f"{c}_{n}") for k, c in enumerate(("min", "q25", "med", "q75", "max"))), (q[3] - q[1]).alias(f"iqr_{n}")]


def quantiles_of_many(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    """quantiles() of each key, for groups of any size."""
    n = name or value
    q = exact_quantiles(df, keys, value, (0.0, 0.25, 0.5, 0.75, 1.0))
    return q.select(*keys, *(F.col("q")[k].alias(f"{c}_{n}") for k, c in enumerate(("min", "q25", "med", "q75", "max"))), (F.col("q")[3] - F.col("q")[1]).alias(f"iqr_{n}"))


def energy(value: str, axes: Sequence[str]) -> list[Column]:
    """Signal magnitude area and root mean square of the value, mean power of the axes."""
    power = sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0]))
    return [F.sum(F.abs(value)).alias("sma"), F.avg(power).alias("power"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms")]


def poincare(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Spread of each value against the next: across (sd1) and along (sd2) the diagonal, their ratio and ellipse's area."""
    pairs = df.withColumn("_next", F.lead(value).over(ordered(keys, order))).filter(F.col("_next").isNotNull())
    root = F.sqrt(F.lit(2.0))
    sd1, sd2 = F.stddev_pop((F.col("_next") - F.col(value)) / root), F.stddev_pop((F.col("_next") + F.col(value)) / root)
    found = pairs.groupBy(*keys).agg(sd1.alias("sd1"), sd2.alias("sd2"))
    return found.withColumns({"sd_ratio": F.try_divide("sd2", "sd1"), "ellipse_area": F.col("sd1") * F.col("sd2") * F.pi()})


def intervals_between(bouts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the seconds from each bout's end to the next's start: mean, population deviation and variance, their ratio, iqr."""
    gap = (F.lead("start_us").over(ordered(keys, ["start_us"])) - F.col("end_us")) / 1e6
    g = bouts.withColumn("_gap", gap).filter(F.col("_gap").isNotNull()).groupBy(*keys)
    q = F.percentile(F.col("_gap"), F.array(F.lit(0.25), F.lit(0.75)))
    found = g.agg(F.avg("_gap").alias("iei_mean"), F.stddev_pop("_gap").alias("iei_std"), F.var_pop("_gap").alias("iei_var"), (q[1] - q[0]).alias("iei_iqr"))
    return found.withColumn("iei_cv", F.try_divide("iei_std", "iei_mean"))


def bouts_per_hour(bouts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bouts.groupBy(*keys).agg(F.count("*").alias("n_moves"), F.try_divide(F.count("*").cast("double"), (F.max("end_us") - F.min("start_us")) / HOUR_US).alias("n_moves_per_h"))


def durations(bouts: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = bouts.withColumn("dur", (F.col("end_us") - F.col("start_us")) / 1e6)
    q = F.percentile(F.col("dur"), F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return d.groupBy(*keys).agg(*moments("dur"), *(q[k].alias(f"{c}_dur") for k, c in enumerate(("q25", "med", "q75"))))


def sleep_share(df: DataFrame, keys: Sequence[str], order: Sequence[str], asleep: str, us: str = "us") -> DataFrame:
    """Sleep efficiency (time of steps that end asleep over the window's length) and the window over sleep, its inverse."""
    step = F.col(us) - F.lag(us).over(ordered(keys, order))
    found = df.withColumn("_step", step).groupBy(*keys).agg(F.sum(F.when(F.col(asleep), F.col("_step"))).alias("_asleep"), (F.max(us) - F.min(us)).alias("_all"))
    return found.select(*keys, F.try_divide("_asleep", "_all").alias("sleep_eff"), F.try_divide("_all", "_asleep").alias("window_over_sleep"))


def kernel_density(bouts: DataFrame, keys: Sequence[str], width: float = 0.04, points: int = 400) -> DataFrame:
    """Density of bouts' midpoints, scaled to [0, 1] in each group, on an even grid: Gaussian kernels of the given width.

    The midpoints of a group are one array, so the grid isn't joined with them."""
    w = Window.partitionBy(*keys)
    mid = (F.col("start_us") + F.col("end_us")) / 2.0
    scaled = bouts.withColumn("_m", mid).withColumns({"_a": F.min("_m").over(w), "_b": F.max("_m").over(w)}).withColumn("_x", F.try_divide(F.col("_m") - F.col("_a"), F.col("_b") - F.col("_a")))
    listed = scaled.filter(F.col("_x").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_x"))
    at = listed.select(*keys, "_x", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("slot"))
    g = F.col("slot") / float(points - 1)
    total = F.aggregate("_x", F.lit(0.0), lambda s, x: s + F.exp(-F.pow((g - x) / width, 2) / 2))
    return at.select(*keys, "slot", (total / (F.size("_x") * width * F.sqrt(2 * F.pi()))).alias("density"))


# --- kernels


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """Biased autocorrelation of lags 0 to lags; all NaN for a constant series."""
    c = x - x.mean()
    total = (c * c).sum()
    n = len(c)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(c, size)
    return np.fft.irfft(f * np.conj(f), size)[: min(lags, n - 1) + 1] / total if total > 0 else np.full(min(lags, n - 1) + 1, np.nan)


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict local maxima; of a plateau the middle, the lower of two."""
    out, n, k = [], len(x), 1
    while k < n - 1:
        if x[k - 1] < x[k]:
            end = k
            while end < n - 1 and x[end + 1] == x[k]:
                end += 1
            if end < n - 1 and x[end + 1] < x[k]:
                out.append((k + end) // 2)
            k = end
        k += 1
    return np.array(out, np.int64)


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the lowest points on either side, up to a higher sample or the end."""
    out = np.zeros(len(peaks))
    for i, p in enumerate(peaks):
        higher = np.flatnonzero(x[:p] > x[p])
        left = x[(higher[-1] + 1 if len(higher) else 0) : p + 1].min()
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : p + 1 + (higher[0] if len(higher) else len(x))].min()
        out[i] = x[p] - max(left, right)
    return out


def find_peaks(x: np.ndarray, height: float | None = None, distance: float = 1, prominence: float | None = None, plateaus: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Peaks and their prominences: by height, then of those nearer than distance the higher, then by prominence. plateaus:
    whether several equal samples can be a peak."""
    peaks = local_maxima(x)
    if not plateaus:
        peaks = peaks[(x[peaks - 1] < x[peaks]) & (x[peaks + 1] < x[peaks])]
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), bool)
        for i in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(peaks - peaks[i]) < np.ceil(distance)
                near[i] = False
                keep &= ~near
        peaks = peaks[keep]
    high = prominences(x, peaks)
    if prominence is not None:
        peaks, high = peaks[high >= prominence], high[high >= prominence]
    return peaks, high


def welch(x: np.ndarray, fs: float, average: str = "median") -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density: periodic Hann windows of one second, half overlapping, means removed;
    averaged by the mean, or by the median over its bias."""
    size = max(1, int(min(fs, len(x))))
    step = size - size // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    parts = np.array([x[k : k + size] for k in range(0, len(x) - size + 1, step)])
    parts = (parts - parts.mean(axis=1, keepdims=True)) * window
    power = np.abs(np.fft.rfft(parts, axis=1)) ** 2 / (fs * (window**2).sum())
    power[:, 1 : -1 if size % 2 == 0 else None] *= 2
    n = len(parts)
    if average == "median":
        i = 2.0 * np.arange(1, (n - 1) // 2 + 1)
        power = np.median(power, axis=0) / (1 + (1 / (i + 1) - 1 / i).sum())
    else:
        power = power.mean(axis=0)
    return np.fft.rfftfreq(size, 1 / fs), power


#: Points of a leaf of the tree that counts near pairs, and comparisons made at once.
LEAF, AT_ONCE = 32, 1 << 22


def near_pairs(points: np.ndarray, r: float) -> int:
    """How many pairs of points (n, dimensions) differ by at most r in every coordinate.

    A tree of boxes, each halved at the middle of its widest side: two boxes that lie within r of each other whole count
    at once, two farther apart not at all, and only what is left is compared point by point. Exact up to the sign of
    differences, which is that of a direct comparison."""
    n, width = points.shape
    order = np.arange(n)
    starts, ends, kids = [0], [n], [-1]
    k = 0
    while k < len(starts):
        a, b = starts[k], ends[k]
        if b - a > LEAF:
            own = points[order[a:b]]
            side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], half)]
            kids[k] = len(starts)
            starts += [a, a + half]
            ends += [a + half, b]
            kids += [-1, -1]
        k += 1
    sorted_ = points[order]
    starts_, ends_, kids_ = np.array(starts), np.array(ends), np.array(kids)
    low, high = np.empty((len(starts), width)), np.empty((len(starts), width))
    for k in range(len(starts) - 1, -1, -1):
        c = kids[k]
        low[k] = sorted_[starts[k] : ends[k]].min(axis=0) if c < 0 else np.minimum(low[c], low[c + 1])
        high[k] = sorted_[starts[k] : ends[k]].max(axis=0) if c < 0 else np.maximum(high[c], high[c + 1])
    padded = np.vstack([sorted_, np.full((LEAF, width), np.inf)])
    lanes = np.arange(LEAF)
    total, todo = 0, [np.zeros((1, 2), np.int64)]
    while todo:
        pair = todo.pop()
        if len(pair) > 1 << 16:
            todo += [pair[1 << 16 :]]
            pair = pair[: 1 << 16]
        p, q = pair.T
        size = (ends_ - starts_)
        same = p == q
        apart = np.maximum(low[p] - high[q], low[q] - high[p]).max(axis=1) > r
        whole = ~apart & (np.maximum(high[p] - low[q], high[q] - low[p]).max(axis=1) <= r)
        total += int(np.where(same, size[p] * (size[p] - 1) // 2, size[p] * size[q])[whole].sum())
        left = ~apart & ~whole
        p, q, same = p[left], q[left], same[left]
        leaves = (kids_[p] < 0) & (kids_[q] < 0)
        for at in range(0, int(leaves.sum()), AT_ONCE // (LEAF * LEAF)):
            x, y, s = (v[leaves][at : at + AT_ONCE // (LEAF * LEAF)] for v in (p, q, same))
            i, j = starts_[x][:, None] + lanes, starts_[y][:, None] + lanes
            i, j = np.where(i < ends_[x][:, None], i, n), np.where(j < ends_[y][:, None], j, n)
            near = (i < n)[:, :, None] & (j < n)[:, None, :] & (~s[:, None, None] | (lanes[:, None] < lanes[None]))
            with np.errstate(invalid="ignore"):
                for d in range(width):
                    near &= np.abs(padded[i, d][:, :, None] - padded[j, d][:, None, :]) <= r
            total += int(near.sum())
        p, q, same = p[~leaves], q[~leaves], same[~leaves]
        if not len(p):
            continue
        one = same  # of a box with itself: its halves with themselves and with each other
        c = kids_[p[one]]
        halves = [np.stack([c, c], 1), np.stack([c + 1, c + 1], 1), np.stack([c, c + 1], 1)]
        p, q = p[~one], q[~one]
        first = (kids_[q] < 0) | ((kids_[p] >= 0) & (size[p] >= size[q]))
        for big, other in ((p[first], q[first]), (q[~first], p[~first])):
            halves += [np.stack([kids_[big], other], 1), np.stack([kids_[big] + 1, other], 1)]
        todo.append(np.concatenate(halves))
    return total


def sample_entropy(x: np.ndarray, m: int = 3, tolerance: float = 0.2) -> float:
    """-ln of the share of pairs of m-long stretches within tolerance deviations that stay so one sample longer."""
    r = tolerance * x.std(ddof=1) if len(x) > 1 else 0.0
    n = len(x) - m
    if n < 2 or r == 0 or np.isnan(r):
        return float("nan")
    stretches = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, m + 1))
    b = near_pairs(stretches[:, :m], r)
    a = near_pairs(stretches, r) if b else 0
    return float(-np.log(a / b)) if a and b else float("nan")


def cubic_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through the points whose third derivative is continuous at the second and the last but one (not a
    knot), at other places; NaN outside the points, and everywhere if there are fewer than four."""
    n = len(x)
    if n < 4:
        return np.full(len(at), np.nan)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)  # for the second derivatives
    k = np.arange(1, n - 1)
    a[k, k - 1], a[k, k], a[k, k + 1], b[k] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:], 6 * np.diff(slope)
    a[0, :3], a[-1, -3:] = [h[1], -(h[0] + h[1]), h[0]], [h[-1], -(h[-2] + h[-1]), h[-2]]
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v = at - x[i], x[i + 1] - at
    out = (m[i] * v**3 + m[i + 1] * u**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * v + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * u
    return np.where((at >= x[0]) & (at <= x[-1]), out, np.nan)


def hurst_rs(x: np.ndarray) -> float:
    """Slope of log rescaled range against log length over even partitions, less the range expected of noise (Anis and
    Lloyd), plus one half."""
    from math import lgamma

    n = len(x)
    sizes = [s for s in np.unique(np.round(np.logspace(np.log10(8), np.log10(max(n // 2, 8)), 12)).astype(int)) if 8 <= s <= n // 2]
    logs = []
    for s in sizes:
        parts = x[: n // s * s].reshape(-1, s)
        dev = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
        sd = parts.std(axis=1, ddof=1)
        ok = sd > 0
        if ok.any():
            i = np.arange(1, s)
            ratio = np.exp(lgamma((s - 1) / 2) - lgamma(s / 2)) / np.sqrt(np.pi)
            expected = ratio * np.sqrt((s - i) / i).sum()
            logs.append((np.log(s), np.log(((dev.max(axis=1) - dev.min(axis=1))[ok] / sd[ok]).mean()) - np.log(expected)))
    if len(logs) < 2:
        return float("nan")
    a, b = np.array(logs).T
    return float(np.polyfit(a, b, 1)[0] + 0.5)


def hopkins(points: np.ndarray, seed: int = 42) -> float:
    """Nearest-neighbour distances among points scaled to [0, 1], over those plus the ones from as many uniform points to
    the data: low where points cluster, about a half where they are uniform."""
    n = len(points)
    if n < 2 or points.max() == points.min():
        return float("nan")
    x = np.sort((points - points.min()) / (points.max() - points.min()))
    gaps = np.diff(x)
    own = np.minimum(np.append(gaps, np.inf), np.append(np.inf, gaps)).sum()
    u = np.random.default_rng(seed).uniform(0, 1, n)
    k = np.searchsorted(x, u)
    near = np.minimum(np.abs(u - x[np.clip(k - 1, 0, n - 1)]), np.abs(x[np.clip(k, 0, n - 1)] - u)).sum()
    return float(own / (own + near))


# --- families of kernels, by name


@dataclass(frozen=True)
class Setup:
    fs: float = 100.0
    bands: tuple = (1, 2, 4, 8, 16)
    peak_distance_s: float = 0.2
    peak_prominence: float = 0.25
    acf_prominence: float = 0.1
    entropy_m: int = 3
    kde_width: float = 0.04
    kde_points: int = 400
    kde_height: float = 0.5
    kde_prominence: float = 0.15
    kde_distance: int = 39
    kde_margin: float = 0.075
    plateaus: bool = True


def spectral(x: np.ndarray, s: Setup) -> dict[str, float]:
    f, p = welch(x, s.fs)
    asd = np.sqrt(p)
    on = {float(v): k for k, v in enumerate(f)}
    if all(float(b) in on for b in s.bands):
        out = {f"asd_{b}": float(asd[on[float(b)]]) for b in s.bands}
    else:  # a bout of under a second has its frequencies elsewhere
        out = {f"asd_{b}": float(v) for b, v in zip(s.bands, cubic_at(f, asd, np.array(s.bands, float)))}
    peaks, _ = find_peaks(asd, plateaus=s.plateaus)
    best = peaks[np.argsort(-asd[peaks], kind="stable")][:3]
    for k in range(3):
        out[f"f{k + 1}"], out[f"p{k + 1}"] = (float(f[best[k]]), float(asd[best[k]])) if k < len(best) else (0.0, 0.0)
    total = asd.sum()
    share = asd[asd > 0] / total if total > 0 else np.zeros(0)
    return {**out, "sp_entropy": float(-(share * np.log(share)).sum()), "avg_sp_power": float(total)}


def autocorr(x: np.ndarray, s: Setup) -> dict[str, float]:
    a = autocorrelation(x, int(2 * s.fs))
    if np.isnan(a).any():
        return dict.fromkeys(("ac_max", "loc_max", "ac_min", "loc_min", "zero_crossings"), float("nan"))
    top, _ = find_peaks(a, prominence=s.acf_prominence, plateaus=s.plateaus)
    low, _ = find_peaks(-a, prominence=s.acf_prominence, plateaus=s.plateaus)
    pick = lambda k: (float(a[k[0]]), float(k[0] / s.fs)) if len(k) else (0.0, 0.0)
    (m, ml), (n, nl) = pick(top), pick(low)
    return {"ac_max": m, "loc_max": ml, "ac_min": n, "loc_min": nl, "zero_crossings": float((np.diff(np.signbit(a)) != 0).sum())}


def peaks(x: np.ndarray, s: Setup) -> dict[str, float]:
    p, high = find_peaks(x, distance=s.peak_distance_s * s.fs, prominence=s.peak_prominence, plateaus=s.plateaus)
    if not len(p):
        return dict.fromkeys(("peaks_per_sec", "avg_peak_prom", "max_peak_prom", "min_peak_prom"), 0.0)
    return {"peaks_per_sec": len(p) / (len(x) / s.fs), "avg_peak_prom": float(high.mean()), "max_peak_prom": float(high.max()), "min_peak_prom": float(high.min())}


def nonlinear(x: np.ndarray, s: Setup) -> dict[str, float]:
    return {"samp_en": sample_entropy(x, s.entropy_m), "hurst_rs": hurst_rs(x)}


def clusters(x: np.ndarray, s: Setup) -> dict[str, float]:
    """Peaks of the density of points scaled to [0, 1], but for those at the margins."""
    none = dict.fromkeys(("kde_n_peaks", "kde_avg_prom", "kde_max_prom", "kde_min_prom"), 0.0)
    if len(x) < 2 or x.max() == x.min():
        return {"hopkins_score": float("nan"), **none}
    z, g = (x - x.min()) / (x.max() - x.min()), np.linspace(0, 1, s.kde_points)
    density = np.exp(-(((g[:, None] - z[None]) / s.kde_width) ** 2) / 2).sum(axis=1) / (len(z) * s.kde_width * np.sqrt(2 * np.pi))
    p, high = find_peaks(density, s.kde_height, s.kde_distance, s.kde_prominence, s.plateaus)
    inside = (g[p] > s.kde_margin) & (g[p] < 1 - s.kde_margin)
    high = high[inside]
    found = {"kde_n_peaks": float(len(high)), "kde_avg_prom": float(high.mean()), "kde_max_prom": float(high.max()), "kde_min_prom": float(high.min())} if len(high) else none
    return {"hopkins_score": hopkins(x), **found}


def differential(x: np.ndarray, s: Setup) -> dict[str, float]:
    """Steps from sample to sample, a second: mean and deviation of their sizes, the largest, and the share that rise."""
    d = np.diff(x) * s.fs
    return {"step_mean": float(np.abs(d).mean()), "step_std": float(np.abs(d).std()), "step_max": float(np.abs(d).max()), "step_up": float((d > 0).mean())}


FAMILIES: dict[str, Callable] = {"differential": differential, "spectral": spectral, "autocorr": autocorr, "peaks": peaks, "nonlinear": nonlinear, "clusters": clusters}


def register_feature(name: str, fn: Callable[[np.ndarray, Setup], dict[str, float]]) -> None:
    """Add a family: fn gets a bout's values in order and returns the same named numbers for any of them."""
    FAMILIES[name] = fn


def kernel_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], families: Sequence[str], setup: Setup = Setup(), least: int = 8) -> DataFrame:
    """The families' numbers for each group and value column, named <number>_<value>; null for groups under least rows,
    and where a number is undefined."""
    fns = [FAMILIES[f] for f in families]
    probe = np.sin(np.arange(max(int(setup.fs) * 2, 64)) / 3.0)
    numbers = [f"{n}_{v}" for v in values for fn in fns for n in fn(probe, setup)]
    kinds = df.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + "".join(f", {n} double" for n in numbers)
    held = [f"_v{i}" for i in range(len(values))]

    def told(parts) -> list:
        out = {}
        for i, v in enumerate(values):
            x = np.concatenate([p.column(held[i]).to_numpy(zero_copy_only=False) for p in parts])
            x = x[np.isfinite(x)]
            for fn in fns:
                out |= {f"{n}_{v}": y for n, y in (fn(x, setup) if len(x) >= least else {}).items()}
        return [None if y is None or np.isnan(y) else float(y) for y in (out.get(n) for n in numbers)]

    def made(rows, types):
        cols = list(zip(*rows))
        own = [pa.array(c, t) for c, t in zip(cols, [*types, *[pa.float64()] * len(numbers)])]
        return pa.RecordBatch.from_arrays(own, [*keys, *numbers])

    def run(batches):
        at, parts, rows, types = None, [], [], []
        for key, part in runs(batches, list(keys)):
            if parts and key != at:
                rows.append((*at, *told(parts)))
                parts = []
                if len(rows) == 1000:
                    yield made(rows, types)
                    rows = []
            at, types = key, [part.schema.field(k).type for k in keys]
            parts.append(part)
        if parts:
            yield made([*rows, (*at, *told(parts))], types)

    order = [F.col(o).asc_nulls_last() for o in order]
    dealt = gathered(df.withColumns({h: F.col(v).cast("double") for h, v in zip(held, values)}), *keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, *held).mapInArrow(run, schema)


def local_feature_names() -> list[str]:
    """The 92 numbers of a movement bout, over magnitude and axes."""
    four = ("mag", "x", "y", "z")
    probe, s = np.sin(np.arange(200) / 3.0), Setup()
    names = [f"{m}_{c}" for c in four for m in ("mean", "std", "skew", "kurt")] + [f"{m}_{c}" for c in four for m in ("min", "q25", "med", "q75", "max", "iqr")] + ["sma", "power", "rms"]
    names += [f"{n}_mag" for n in spectral(probe, s)] + [f"{n}_{c}" for c in four for n in autocorr(probe, s)] + [f"{n}_mag" for n in peaks(probe, s)]
    return names + [f"{n}_{c}" for c in four for n in nonlinear(probe, s)] + ["sd1", "sd2", "sd_ratio", "ellipse_area"]


def global_feature_names() -> list[str]:
    """The 20 numbers of a night."""
    return ["iei_mean", "iei_std", "iei_var", "iei_cv", "iei_iqr", "hopkins_score", "kde_n_peaks", "kde_avg_prom", "kde_max_prom", "kde_min_prom", "n_moves_per_h", "mean_dur", "std_dur", "skew_dur", "kurt_dur", "q25_dur", "med_dur", "q75_dur", "sleep_eff", "window_over_sleep"]


