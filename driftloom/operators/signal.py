"""Signal operators of recordings: angles, non-wear, sleep windows and bouts, ambiguities, movement, calibration, filters."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.numeric import quantile, z_angle
from driftloom.functions.storage import dealt, materialise

from .segments import HOUR_US, contained_in, joined_runs, local_runs, points_in, segments, sessions
from .timeaxis import DAY_US, anchored_bins, bin_stats, ordered, rolling_median, rolling_medians


def z_angle_change(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | str) -> DataFrame:
    """Epochs of rows samples (a number, or a column that is one in each recording): mean z-angle of the trailing medians of x, y, z over rows samples, and its absolute change.

    The first rows - 1 samples have no median; the last epoch may be short; the first change is 0. df may tell each
    sample's place in its recording as _rn."""
    angles = rolling_medians(df, keys, order, ["x", "y", "z"], rows, "_rn")
    if isinstance(rows, int):
        width = F.lit(rows)
    else:
        angles, width = angles.join(df.groupBy(*keys).agg(F.max(rows).alias("_rows")), list(keys)), F.col("_rows")
    angles = angles.filter(F.col("_rn") >= width).withColumnsRenamed({f"{c}_median": f"_{c}" for c in "xyz"})
    angles = angles.withColumn("epoch", F.floor((F.col("_rn") - width) / width).cast("long")).withColumn("_angle", z_angle(F.col("_x"), F.col("_y"), F.col("_z")))
    means = angles.groupBy(*keys, "epoch").agg(F.avg("_angle").alias("angle"))
    change = F.abs(F.col("angle") - F.lag("angle").over(ordered(keys, ["epoch"])))
    return means.withColumn("change", F.coalesce(change, F.lit(0.0)))


def sleep_windows(epochs: DataFrame, keys: Sequence[str], smooth: int, day_epochs: int, least: int, gap: int, share: float = 0.1, factor: float = 15.0) -> DataFrame:
    """Sleep windows of each day: runs of epochs whose rolling median change is under factor times the day's quantile.

    Runs shorter than least epochs go, runs less than gap apart merge, never over the end of a day. Epochs are stamped with
    the start of their rolling window. keys, day, first_epoch, last_epoch."""
    smoothed = rolling_median(epochs, keys, ["epoch"], "change", smooth).filter(F.col("median").isNotNull())
    placed = smoothed.withColumn("p", F.col("epoch") - (smooth - 1)).withColumn("day", F.floor(F.col("p") / day_epochs).cast("long"))
    day = [*keys, "day"]
    limits = placed.groupBy(*day).agg((quantile(F.col("median"), share) * factor).alias("threshold"))
    below = placed.join(limits, day).withColumn("below", F.col("median") < F.col("threshold"))
    runs = segments(below, day, ["p"], "below", us="p").filter(F.col("length_us") >= least)
    w = Window.partitionBy(*day).orderBy("start_us")
    cut = F.coalesce((F.col("start_us") - F.lag("end_us").over(w) >= gap).cast("int"), F.lit(0))
    grouped = runs.withColumn("_id", F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*day, "_id")
    return grouped.agg(F.min("start_us").alias("first_epoch"), F.max("end_us").alias("last_epoch")).drop("_id")


def _quiet(epochs: DataFrame, windows: DataFrame, keys: Sequence[str], quiet: float) -> DataFrame:
    """Epochs of each window (its last one left out), found by an equal join on the listed epochs."""
    each = windows.filter(F.col("last_epoch") > F.col("first_epoch")).select(*keys, F.col("first_epoch").alias("window_epoch"), F.explode(F.sequence(F.col("first_epoch"), F.col("last_epoch") - 1)).alias("epoch"))
    return epochs.join(each, [*keys, "epoch"]).withColumn("quiet", F.col("change") <= quiet)


def sleep_bouts(epochs: DataFrame, windows: DataFrame, keys: Sequence[str], quiet: float = 5.0, least: int = 60) -> DataFrame:
    """Runs of at least least quiet epochs within each window: keys, window_epoch, first_epoch, last_epoch."""
    found = segments(_quiet(epochs, windows, keys, quiet), [*keys, "window_epoch"], ["epoch"], "quiet", us="epoch").filter(F.col("n") >= least)
    return found.select(*keys, "window_epoch", F.col("start_us").alias("first_epoch"), F.col("end_us").alias("last_epoch"))


def sleep_stats(epochs: DataFrame, windows: DataFrame, keys: Sequence[str], quiet: float = 5.0) -> DataFrame:
    """Of each window: epochs, sleep epochs, efficiency (their ratio) and waking epochs between the first and last sleep."""
    q = _quiet(epochs, windows, keys, quiet)
    group = [*keys, "window_epoch"]
    ends = q.filter("quiet").groupBy(*group).agg(F.min("epoch").alias("_f"), F.max("epoch").alias("_l"))
    wake = F.count_if(~F.col("quiet") & (F.col("epoch") > F.col("_f")) & (F.col("epoch") < F.col("_l")))
    return q.join(ends, group, "left").groupBy(*group).agg(F.count("*").alias("n_epochs"), F.count_if("quiet").alias("n_sleep"), (F.count_if("quiet") / F.count("*")).alias("efficiency"), wake.alias("wake_after_onset"))


def still_bins(df: DataFrame, keys: Sequence[str], axes: Sequence[str], bin_us: int, still_sd: float, first: DataFrame | None = None) -> DataFrame:
    """keys, bin, bin_start_us, still (whether every axis is), and the axes' means of still bins. first: see anchored_bins()."""
    bins = bin_stats(anchored_bins(df, keys, bin_us, first=first), keys, axes)
    still = F.lit(True)
    for a in axes:
        still = still & F.coalesce(F.col(f"{a}_sd") < still_sd, F.lit(False))
    return bins.withColumn("still", still).select(*keys, "bin", "bin_start_us", "still", *(F.when(F.col("still"), F.col(f"{a}_mean")).alias(f"{a}_mean") for a in axes))


def nonwear_segments(df: DataFrame, keys: Sequence[str], axes: Sequence[str], bin_us: int, still_sd: float, least_us: int, bins: DataFrame | None = None) -> DataFrame:
    """Intervals of bins where every axis is still, longer than least_us from the first bin's start to the last's. bins:
    still_bins(), where they are known."""
    bins = still_bins(df, keys, axes, bin_us, still_sd) if bins is None else bins
    runs = segments(bins, keys, ["bin_start_us"], "still", us="bin_start_us")
    return runs.filter(F.col("length_us") > least_us).select(*keys, "start_us", "end_us")


def movement_thresholds(df: DataFrame, keys: Sequence[str], value: str, within: Column, least: float = 0.1) -> DataFrame:
    """Mean plus population deviation of the absolute value over the rows within, at least least."""
    v = F.when(within, F.abs(value))
    return df.groupBy(*keys).agg(F.greatest(F.avg(v) + F.stddev_pop(v), F.lit(least)).alias("threshold"))


def movement_bouts(df: DataFrame, keys: Sequence[str], value: str, within: Column, gap_us: int, us: str = "us") -> DataFrame:
    """Bouts of rows within whose absolute value is above the recording's threshold, joined over steps up to gap_us."""
    hits = df.join(movement_thresholds(df, keys, value, within), list(keys)).filter(within & (F.abs(value) > F.col("threshold")))
    return sessions(hits, keys, gap_us, us)


def overnight(start_us: Column, end_us: Column) -> Column:
    """Whether a window, dated by its start less 12 h, starts before 8 o'clock of the next day and ends after 22 o'clock."""
    date = F.floor((start_us - 12 * HOUR_US) / DAY_US) * DAY_US
    return (start_us < date + 32 * HOUR_US) & (end_us > date + 22 * HOUR_US)


def ambiguity_rules(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit_h: float = 4.0, us: str = "us") -> DataFrame:
    """Islands of not wear and sptw, and the rule that settles each: keys, start_us, end_us, rule, first_a, first_b, rec_b.

    first_a and first_b: the first window that holds the island. 'open' islands are left as they are."""
    # One sort of the samples gives the runs of both masks.
    local = materialise(local_runs(df.withColumn("_amb", ~F.col("wear") & F.col("sptw")), keys, order, ["_amb", "sptw"], us), "runs")
    amb = joined_runs(local, keys, "_amb").filter("_amb").select(*keys, "start_us", "end_us")
    windows = joined_runs(local, keys, "sptw").filter("sptw").select(*keys, F.struct(F.col("start_us").alias("a"), F.col("end_us").alias("b")).alias("window"), "start_us", "end_us")
    span = local.groupBy(*keys).agg(F.min("start_us").alias("rec_a"), F.max("end_us").alias("rec_b"))
    over = overnight(F.col("window.a"), F.col("window.b"))
    held = contained_in(amb, windows, keys, "window").groupBy(*keys, "start_us", "end_us")
    c = held.agg(F.bool_or(over).alias("_any"), F.bool_and(over).alias("_all"), F.min("window").alias("_first")).join(span, list(keys))
    hour = lambda t: F.floor(t / HOUR_US) % 24
    long_h, sh, eh = (F.col("end_us") - F.col("start_us")) / HOUR_US, hour(F.col("start_us")), hour(F.col("end_us"))
    inside = ((sh >= 22) | (sh <= 8)) & ((eh >= 22) | (eh <= 8))
    edge = int(limit_h * HOUR_US)
    rule = (
        F.when(F.col("start_us") < F.col("rec_a") + edge, "1")
        .when((F.col("end_us") > F.col("rec_b") - edge) & F.col("_any") & (long_h > limit_h), "2a")
        .when(F.col("end_us") > F.col("rec_b") - edge, "2b")
        .when(inside & (long_h < limit_h), "3a")
        .when(~inside & ((sh < 9) | (eh > 22)), "3b")
        .when(~inside & (~F.col("_all") | (long_h > limit_h)), "3c")
        .when(~inside & F.col("_all") & (long_h < limit_h), "3d")
        .otherwise("open")
    )
    return c.select(*keys, "start_us", "end_us", rule.alias("rule"), F.col("_first.a").alias("first_a"), F.col("_first.b").alias("first_b"), "rec_a", "rec_b")


def resolve_ambiguities(df: DataFrame, keys: Sequence[str], order: Sequence[str], us: str = "us") -> DataFrame:
    """df with wear, sptw and sleep_bout after the rules: all are decided on the masks as they were, then applied at once."""
    clear, worn = settled_intervals(materialise(ambiguity_rules(df, keys, order, us=us), "rules"), keys)  # both uses would find the islands anew
    return settled(points_in(df, {"_clear": clear, "_worn": worn}, keys, us))


def settled_intervals(rules: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The intervals in which ambiguity_rules() take sleep away, and those in which they give wear."""
    r = F.col("rule")
    clear = rules.filter(r.isin("1", "2a", "2b", "3b", "3c", "3d")).select(
        *keys,
        F.when(r == "1", F.col("rec_a")).when(r == "2b", F.floor(F.col("rec_b") / DAY_US) * DAY_US + 8 * HOUR_US).when(r.isin("2a", "3c"), F.col("first_a")).otherwise(F.col("start_us")).alias("start_us"),
        F.when(r == "2b", F.col("rec_b")).when(r.isin("2a", "3c"), F.col("first_b")).otherwise(F.col("end_us")).alias("end_us"),
    ).filter("end_us >= start_us")
    return clear, rules.filter(r == "3a").select(*keys, "start_us", "end_us")


def settled(df: DataFrame) -> DataFrame:
    """The masks after _clear and _worn, which go."""
    masks = {c: F.col(c) & ~F.col("_clear") for c in ("sptw", "sleep_bout") if c in df.columns}
    return df.withColumns({**masks, "wear": F.col("wear") | F.col("_worn")}).drop("_clear", "_worn")


# --- sphere calibration


def fit_sphere(x: np.ndarray, least_points: int = 50, reach: float = 0.3, most: int = 1000, tolerance: float = 1e-4, accept_g: float = 0.01) -> tuple[np.ndarray, np.ndarray, float, float, bool]:
    """Offsets and gains that bring resting points (n, 3) onto the unit sphere, error before and after, and whether to
    use them: enough points, each axis beyond reach on both sides, and an error within accept_g.

    Each round fits every axis by weighted least squares to its point on the sphere; points with large errors weigh less."""
    offset, gain = np.zeros(3), np.ones(3)
    radius = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
    before = float(np.abs(radius - 1).mean()) if len(x) else float("nan")
    if len(x) < least_points or (x.min(axis=0) > -reach).any() or (x.max(axis=0) < reach).any():
        return offset, gain, before, before, False
    last, weights = np.inf, np.ones(len(x))
    for _ in range(most):
        now = offset + x * gain
        size = np.linalg.norm(now, axis=1)
        goal = now / size[:, None]
        for k in range(3):
            w, a, b = weights, now[:, k], goal[:, k]
            ma, mb = np.average(a, weights=w), np.average(b, weights=w)
            spread = np.average((a - ma) ** 2, weights=w)
            slope = np.average((a - ma) * (b - mb), weights=w) / spread if spread else 1.0
            shift = mb - slope * ma
            offset[k], gain[k] = shift + slope * offset[k], slope * gain[k]
        error = np.abs(np.linalg.norm(offset + x * gain, axis=1) - 1)
        high = np.quantile(error, 0.995)
        weights = np.maximum(1 - error / high, 0) if high > 0 else np.ones(len(x))
        if not weights.any():
            weights = np.ones(len(x))
        mean = float(error.mean())
        if last - mean < tolerance * last:
            break
        last = mean
    return offset, gain, before, mean, mean <= accept_g


def fit_calibration(df: DataFrame, keys: Sequence[str], bin_us: int = 10_000_000, still_sd: float = 0.015, bins: DataFrame | None = None) -> DataFrame:
    """keys, offset, gain (arrays of x, y, z), error_before, error_after, used: fitted to the means of still bins.

    The bins are aggregated by Spark; a recording of a week has 60,480 of 10 s at most, which one task fits. bins:
    still_bins(), where they are known."""
    bins = still_bins(df, keys, ["x", "y", "z"], bin_us, still_sd) if bins is None else bins
    still = bins.filter("still").select(*keys, "bin", "x_mean", "y_mean", "z_mean")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        o, g, a, b, used = fit_sphere(pdf[["x_mean", "y_mean", "z_mean"]].to_numpy())
        if not used:
            o, g = np.zeros(3), np.ones(3)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "offset": [o.tolist()], "gain": [g.tolist()], "error_before": [a], "error_after": [b], "used": [bool(used)]})

    return still.groupBy(*keys).applyInPandas(fit, f"{schema}, offset array<double>, gain array<double>, error_before double, error_after double, used boolean")


def apply_calibration(df: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """x, y, z as offset + gain * value; recordings without a fit stay as they are."""
    joined = df.join(fits.select(*keys, "offset", "gain"), list(keys), "left")
    axis = lambda k, c: F.coalesce(F.col("offset")[k] + F.col("gain")[k] * F.col(c), F.col(c))
    return joined.withColumns({c: axis(k, c) for k, c in enumerate("xyz")}).drop("offset", "gain")


# --- Butterworth filters


def butterworth_sections(fs: float, low: float | None, high: float | None, order: int = 5) -> np.ndarray:
    """Second-order sections (rows b0 b1 b2 a0 a1 a2) of low-, high- or band-pass Butterworth filters.

    Analog poles on the unit circle, pre-warped to the cut-offs over the whole-number Nyquist rate fs // 2, and mapped by
    the bilinear transform."""
    nyquist = fs // 2
    cuts = [c for c in (low, high) if c]
    if not cuts or any(not 0 < c < nyquist for c in cuts) or (low and high and low >= high):
        raise ValueError("cut-offs must lie between 0 and half the rate, the lower first")
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warp = [2 * np.tan(np.pi * c / nyquist / 2) for c in cuts]
    if low and high:
        width, centre = warp[1] - warp[0], warp[0] * warp[1]
        half = poles * width / 2
        root = np.sqrt(half**2 - centre + 0j)
        p, z, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    elif high:
        p, z, gain = poles * warp[0], np.zeros(0), warp[0] ** order
    else:
        p, z, gain = warp[0] / poles, np.zeros(order), float(np.real(np.prod(-poles)) ** -1)
    zd, pd_ = (2 + z) / (2 - z), (2 + p) / (2 - p)
    k = float(np.real(gain * np.prod(2 - z) / np.prod(2 - p)))
    zd = np.concatenate([zd, -np.ones(len(p) - len(z))])
    # Conjugate poles make a section; a real pole is one of first order. Zeros go two to a section.
    pairs = [(q, np.conj(q)) for q in pd_[np.imag(pd_) > 1e-12]] + [(q,) for q in np.sort(np.real(pd_[np.abs(np.imag(pd_)) <= 1e-12]))]
    left, rows = list(np.sort(np.real(zd))), []
    for n, pair in enumerate(sorted(pairs, key=lambda q: abs(q[0]))):
        zeros = [left.pop(0 if i % 2 == 0 else -1) for i in range(len(pair))]
        b, a = np.real(np.poly(zeros)), np.real(np.poly(pair))
        rows.append(np.concatenate([np.pad(b * (k if n == 0 else 1), (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))]))
    return np.array(rows)


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The section's state after a long constant input of 1 (transposed direct form)."""
    gain = b.sum() / a.sum()
    s2 = b[2] - a[2] * gain
    return np.array([b[1] - a[1] * gain + s2, s2])


def run_section(row: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 256) -> np.ndarray:
    """One second-order section over x (n, columns) from a state (2, columns), a block of samples at a time.

    Within a block the output is a triangular matrix times the input plus what the block's first state adds; only those
    states go from block to block."""
    b, a = row[:3], row[3:]
    step, into = np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    response = np.array([b[0], *(p[0] @ into for p in powers[: block - 1])])
    k = np.arange(block)
    inside = np.where(k[:, None] >= k, response[np.abs(k[:, None] - k)], 0.0)
    adds, ends = np.stack([p[0] for p in powers[:block]]), np.stack([powers[block - 1 - j] @ into for j in range(block)], axis=1)
    n, blocks = len(x), -(-len(x) // block)
    parts = np.zeros((blocks * block, x.shape[1]))
    parts[:n] = x
    parts = parts.reshape(blocks, block, -1)
    gains, states = ends @ parts, np.empty((blocks, 2, x.shape[1]))
    for i in range(blocks):
        states[i] = state
        state = powers[block] @ state + gains[i]
    return (inside @ parts + adds @ states).reshape(blocks * block, -1)[:n]


def filter_both_ways(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering of x (n, columns): forward, then backward, over ends continued point-symmetrically."""
    pad = 3 * (2 * len(sections) + 1)
    if len(x) <= pad:
        raise ValueError("the series is shorter than the filter's run-in")
    y = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for row in sections:
            y = run_section(row, y, _steady(row[:3], row[3:])[:, None] * y[0])
        y = y[::-1]
    return y[pad:-pad]


#: Samples of a recording that a task filters at a time, and the share of a state that may be left when it counts as gone.
PIECE, FADED = 500_000, 1e-14


def settling(sections: np.ndarray) -> int:
    """Samples after which a state of the sections has faded to nothing: by the slowest pole, times the sections."""
    slowest = max(float(np.abs(np.roots(row[3:])).max()) for row in sections)
    return int(np.ceil(len(sections) * np.log(FADED) / np.log(slowest))) if 0 < slowest < 1 else 1


def butterworth(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fs: float | DataFrame, low: float | None = None, high: float | None = None, order: int = 5, us: str = "us", even: bool = False, piece: int = PIECE) -> DataFrame:
    """df with the columns filtered along time in each recording, and filtered, whether it was done.

    fs: the rate of all, or keys, fs and step_us of each recording, which may have few different rates. A recording is
    filtered in pieces, each with as many samples of its neighbours on both sides as a state of the filter needs to fade,
    so the result is that of the whole series to rounding, whatever the recording's length. even: samples are steps of
    step_us (1 / fs, rounded to microseconds) apart, so that times number them; otherwise they are numbered in order, one
    recording in one sort. A recording too short for the filter, or too slow for its cut-offs, stays as it is."""
    one = not isinstance(fs, DataFrame)
    rates = [float(fs)] if one else sorted(r["fs"] for r in fs.select("fs").distinct().collect() if r["fs"] is not None)
    setups: dict[float, np.ndarray] = {}
    for rate in rates:
        try:
            setups[rate] = butterworth_sections(rate, low, high, order)
        except ValueError:
            if one:
                raise
    warm = max((settling(s) + 3 * (2 * len(s) + 1) for s in setups.values()), default=1)
    piece = max(piece, 4 * warm)
    known = df.withColumns({"_fs": F.lit(rates[0]), "_step": F.lit(round(1e6 / rates[0]))}) if one else df.join(fs.select(*keys, F.col("fs").alias("_fs"), F.col("step_us").alias("_step")), list(keys), "left")
    rows_of = lambda span: span.agg(F.sum("_n")).first()[0] or 0
    if even:
        span = materialise(df.groupBy(*keys).agg(F.min(us).alias("_t0"), F.max(us).alias("_t1"), F.count("*").alias("_n")), "span")
        place = lambda t: F.coalesce(F.round((t - F.col("_t0")) / F.col("_step")).cast("long"), F.lit(0))
        numbered = known.join(span, list(keys)).withColumns({"_k": place(F.col(us)), "_end": place(F.col("_t1"))}).drop("_t0", "_t1", "_n")
    else:
        span = materialise(df.groupBy(*keys).agg((F.count("*") - 1).alias("_end"), F.count("*").alias("_n")), "span")
        numbered = dealt(known.join(span.drop("_n"), list(keys)), rows_of(span), *keys).withColumn("_k", F.row_number().over(ordered(keys, [us])).cast("long") - 1)
    first, last = F.greatest(F.floor((F.col("_k") - warm) / piece), F.lit(0)), F.least(F.floor((F.col("_k") + warm) / piece), F.floor(F.col("_end") / piece))
    pieces = numbered.withColumn("_piece", F.explode(F.sequence(first, last))).drop("_step", "_end")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", filtered boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k", kind="stable")
        own = (pdf["_k"] // piece == pdf["_piece"].iloc[0]).to_numpy()
        sections, done = setups.get(float(pdf["_fs"].iloc[0])), False
        if sections is not None:
            try:
                pdf[list(columns)] = filter_both_ways(sections, pdf[list(columns)].to_numpy(np.float64))
                done = True
            except ValueError:
                pass
        return pdf[own].drop(columns=["_k", "_piece", "_fs"]).assign(filtered=done)

    return dealt(pieces, rows_of(span), *keys, "_piece").groupBy(*keys, "_piece").applyInPandas(run, schema)
