"""The time axis of recordings: gaps, rates, duplicates, truncation, bins, rolling and resampled values.

A recording is rows of one key with a time in microseconds (us), ordered by us and a tie-breaker."""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.numeric import micros, quantile

DAY_US = 86_400_000_000
#: Time of a recording that one task sorts, where what comes before it is told by a few numbers.
SPAN_US = 6 * 3_600_000_000


def ordered(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def spanned(df: DataFrame, time: str, span_us: int = SPAN_US) -> DataFrame:
    """Add _span, the number of the stretch of time; a time that is no whole number of microseconds is read as one."""
    kind = dict(df.dtypes)[time]
    us = F.col(time) if kind in ("bigint", "int") else micros(F.col(time)) if kind.startswith("timestamp") else F.lit(0)
    return df.withColumn("_span", F.floor(us / span_us).cast("long"))


def numbered_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add each row's place from 1 in its recording: by its place in a stretch of time, and the rows of those before."""
    cut = spanned(df, order[0])
    group = [*keys, "_span"]
    held = cut.groupBy(*group).agg(F.count("*").alias("_rows_in"))
    before = F.coalesce(F.sum("_rows_in").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = held.select(*(F.col(c).alias(f"_of_{c}") for c in group), before.alias("_before"))
    same = [cut[c].eqNullSafe(before[f"_of_{c}"]) for c in group]
    joined = cut.join(before, same).drop(*(f"_of_{c}" for c in group))
    return joined.withColumn(name, F.row_number().over(ordered(group, order)) + F.col("_before")).drop("_span", "_before")


def with_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], us: str = "us") -> DataFrame:
    """Add gap_us, the step from the row before; null at a recording's first row."""
    return df.withColumn("gap_us", F.col(us) - F.lag(us).over(ordered(keys, order)))


def sample_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], longest_gap_s: float = 60.0, more: Sequence[Column] = ()) -> DataFrame:
    """Rate of each recording from steps of at most longest_gap_s: mean (1 / mean step), population deviation of 1 / step,
    both to 2 digits, and whether all steps are one. more: other aggregates of gap_us."""
    # Steps within stretches of time, and those from a stretch's last row to the next one's first.
    cut, group = spanned(df.select(*dict.fromkeys([*keys, *order, "us"])), "us"), [*keys, "_span"]
    ends = cut.groupBy(*group).agg(F.min("us").alias("_a"), F.max("us").alias("_b"))
    between = ends.withColumn("gap_us", F.col("_a") - F.lag("_b").over(ordered(keys, ["_span"])))
    within = cut.withColumn("gap_us", F.col("us") - F.lag("us").over(ordered(group, order)))
    gaps = within.select(*keys, "gap_us").unionByName(between.select(*keys, "gap_us"))
    steps = gaps.filter((F.col("gap_us") > 0) & (F.col("gap_us") <= longest_gap_s * 1e6))
    s = F.col("gap_us") / 1e6
    return steps.groupBy(*keys).agg(
        F.count("*").alias("n_steps"),
        F.round(1 / F.avg(s), 2).alias("rate_hz"),
        F.round(F.stddev_pop(1 / s), 2).alias("rate_sd"),
        (F.min("gap_us") == F.max("gap_us")).alias("uniform"),
        *more,
    )


def target_rate(rate: Column, header: Column, uniform: Column, wanted: Column, tolerance: float = 0.1) -> Column:
    """The rate to resample to, null if none is needed: the nearest multiple of 10 (ties up), or the header's if that is
    more than tolerance off; a uniform recording is resampled only to a wanted rate that differs."""
    tens = F.floor(rate / 10 + 0.5) * 10
    near = F.when(F.abs(tens - header) > tolerance * header, header).otherwise(tens)
    return F.when(~uniform, F.coalesce(wanted, near)).when(wanted != rate, wanted)


def inferred_rates(df: DataFrame, keys: Sequence[str], order: Sequence[str], headers: DataFrame | None = None, wanted: float | None = None) -> DataFrame:
    """keys, fs (the rate to work at), step_us (between samples at it) and resample, whether the recording must be brought
    to it first. headers: keys and header_hz, where known; wanted: one rate for all. A recording of one row has none."""
    rates = sample_rate(df, keys, order, more=[F.min("gap_us").alias("least_gap_us")])
    rates = rates.join(headers.select(*keys, "header_hz"), list(keys), "left") if headers is not None else rates.withColumn("header_hz", F.lit(None).cast("double"))
    to = target_rate(F.col("rate_hz"), F.col("header_hz"), F.col("uniform"), F.lit(wanted).cast("double"))
    to = F.when(to > 0, to)  # the nearest multiple of ten of a slow recording is none
    fs = F.coalesce(to.cast("double"), F.col("rate_hz"))
    step = F.when(to.isNotNull(), F.round(F.lit(1e6) / to)).otherwise(F.col("least_gap_us")).cast("long")
    return rates.select(*keys, fs.alias("fs"), step.alias("step_us"), to.isNotNull().alias("resample"))


def drop_duplicate_times(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Remove every row whose time occurs more than once in its recording: none of several is right.

    A stretch of a recording's time is sorted at a time; a row is compared with the ones beside it."""
    w = ordered([*keys, "_span"], [time])
    like = lambda side: side(F.lit(1)).over(w).isNotNull() & side(time).over(w).eqNullSafe(F.col(time))
    marked = spanned(df, time).withColumn("_again", like(F.lag) | like(F.lead))
    return marked.filter(~F.col("_again")).drop("_again", "_span")


def truncate_days(df: DataFrame, keys: Sequence[str], days: int, us: str = "us", first: DataFrame | None = None) -> DataFrame:
    """Rows up to days after each recording's first, the last moment included.

    The first times are an aggregate joined back, so no window holds a recording. first: keys and _first, where known."""
    first = df.groupBy(*keys).agg(F.min(us).alias("_first")) if first is None else first
    return df.join(first, list(keys)).filter(F.col(us) <= F.col("_first") + days * DAY_US).drop("_first")


def anchored_bins(df: DataFrame, keys: Sequence[str], width_us: int, us: str = "us", first: DataFrame | None = None) -> DataFrame:
    """Add bin, the number of the width_us-wide bin counted from the recording's first row, and bin_start_us. first: keys
    and _first, where known."""
    first = df.groupBy(*keys).agg(F.min(us).alias("_first")) if first is None else first
    at = F.floor((F.col(us) - F.col("_first")) / width_us).cast("long")
    return df.join(first, list(keys)).withColumn("bin", at).withColumn("bin_start_us", F.col("_first") + F.col("bin") * width_us).drop("_first")


def bin_stats(binned: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Count, mean and sample deviation of the values of each bin."""
    stats = [f(v).alias(f"{v}_{n}") for v in values for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))]
    return binned.groupBy(*keys, "bin", "bin_start_us").agg(F.count("*").alias("n"), *stats)


def count_bins(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, value: str) -> DataFrame:
    """Means of runs of size consecutive rows (the last may be short) and their absolute change, 0 for the first."""
    numbered = df.withColumn("run", F.floor((F.row_number().over(ordered(keys, order)) - 1) / size).cast("long"))
    means = numbered.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    change = F.abs(F.col("mean") - F.lag("mean").over(ordered(keys, ["run"])))
    return means.withColumn("change", F.coalesce(change, F.lit(0.0)))


def rolling_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int, name: str = "median") -> DataFrame:
    """Median of the last rows values; null until there are that many."""
    w = ordered(keys, order)
    full = F.row_number().over(w) >= rows
    return df.withColumn(name, F.when(full, quantile(F.col(value), 0.5).over(w.rowsBetween(-(rows - 1), 0))))


#: Rows from which a rolling median is kept by pandas' sorted window instead of by sorting every frame, and the rows of a
#: recording that one task then takes at a time.
WIDE, PIECE = 50, 500_000


def rolling_medians(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], rows: int | str, number: str = "row", piece: int = PIECE) -> DataFrame:
    """keys, number (each row's place from 1) and <value>_median of the last rows values; null until there are that many.

    Nulls and NaN are left out of a frame. rows may name a column that is one number in each recording; df may have number
    already. A frame's median costs its width in an expression, so wide ones go to pandas. Both take a piece of a recording
    at a time; the rows that the next piece's first windows need are dealt to it as well."""
    numbered = df if number in df.columns else numbered_rows(df, keys, order, number)
    width = F.lit(rows) if isinstance(rows, int) else F.col(rows)
    own = F.floor((F.col(number) - 1) / piece)
    last = F.floor((F.col(number) - 1 + width - 1) / piece)
    if isinstance(rows, int) and rows <= WIDE:
        dealt = numbered.select(*keys, number, *values, F.explode(F.when(own == last, F.array(own)).otherwise(F.sequence(own, last))).alias("_piece"))
        frame = ordered([*keys, "_piece"], [number]).rowsBetween(-(rows - 1), 0)

        def median(v: str) -> tuple[Column, Column]:
            known = F.sort_array(F.collect_list(F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))).over(frame))  # NaN counts as missing, as pandas has it
            n = F.size(f"_{v}_sorted")
            at = lambda k: F.get(f"_{v}_sorted", F.floor(k / 2).cast("int"))
            return known, F.when(F.col(number) >= rows, F.when(n % 2 == 1, at(n - 1)).otherwise(0.5 * at(n - 2) + 0.5 * at(n)))

        found = dealt.withColumns({f"_{v}_sorted": median(v)[0] for v in values}).filter(F.col("_piece") == own)
        return found.select(*keys, number, *(median(v)[1].alias(f"{v}_median") for v in values))
    dealt = numbered.select(*keys, number, *values, width.alias("_width"), F.explode(F.sequence(own, last)).alias("_piece"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + f", {number} long, " + ", ".join(f"{v}_median double" for v in values)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(number)
        out, n = pdf[[*keys, number]].copy(), int(pdf["_width"].iloc[0])
        for v in values:
            m = pdf[v].astype(float).rolling(n, min_periods=1).median()  # of the known values, as the expression's
            out[f"{v}_median"] = m.where(pdf[number] >= n)
        return out[((out[number] - 1) // piece) == pdf["_piece"].iloc[0]]

    return dealt.groupBy(*keys, "_piece").applyInPandas(run, schema)


def fill_both(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "filled") -> DataFrame:
    """The next known value, else the last one."""
    w = ordered(keys, order)
    ahead = F.first(value, True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    back = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.coalesce(ahead, back))


#: Steps of the grid in one cell: what a window sorts at once, and an array holds.
CELL_STEPS = 65_536


def _step(step_us: int | str) -> Column:
    """A step in microseconds, or the column that holds it, one number in each recording."""
    return F.lit(step_us).cast("long") if isinstance(step_us, int) else F.col(step_us).cast("long")


def _cells(df: DataFrame, keys: Sequence[str], step_us: int | str, us: str) -> DataFrame:
    """keys, _cell, _from, _to, _step: the grid's first and last time in each stretch of CELL_STEPS steps of the time axis."""
    step = F.col("_step")
    width = step * CELL_STEPS
    span = df.groupBy(*keys).agg(F.min(us).alias("_a"), F.max(us).alias("_b"), F.max(_step(step_us)).alias("_step"))
    each = span.select(*keys, "_a", "_b", "_step", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))).alias("_cell"))
    first = F.greatest(F.col("_a"), F.col("_a") + F.ceil((F.col("_cell") * width - F.col("_a")) / step) * step)
    return each.select(*keys, "_cell", first.alias("_from"), F.least(F.col("_b"), (F.col("_cell") + 1) * width - 1).alias("_to"), "_step")


def _points():
    return F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to", "_step")).otherwise(F.array().cast("array<bigint>"))


def grid(df: DataFrame, keys: Sequence[str], step_us: int | str, us: str = "us") -> DataFrame:
    """Evenly spaced times from each recording's first row to its last, made a cell at a time."""
    return _cells(df, keys, step_us, us).select(*keys, F.explode(_points()).alias(us))


def _around(df: DataFrame, keys: Sequence[str], step_us: int | str, value: str, us: str) -> DataFrame:
    """The grid's times with the samples before (or at) and after (or at) each; one row for each time is taken.

    A cell of the time axis is sorted at a time: what lies before its first and after its last sample comes from the
    other cells' ends, of which a recording has few."""
    sample = F.struct(F.col(us).alias("_t"), F.col(value).alias("_v"))
    at = df.select(*keys, us, F.floor(F.col(us) / (_step(step_us) * CELL_STEPS)).alias("_cell"), sample.alias("_s"))
    ends = at.groupBy(*keys, "_cell").agg(F.min_by("_s", us).alias("_first"), F.max_by("_s", us).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_cell")
    cells = _cells(df, keys, step_us, us).join(ends, [*keys, "_cell"], "left").select(
        *keys, "_cell", "_from", "_to", "_step",
        F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    points = cells.select(*keys, F.explode(_points()).alias(us), "_cell", "_earlier", "_later")
    kind = at.schema["_s"].dataType
    none = F.lit(None).cast(kind)
    both = at.select(*keys, us, "_cell", "_s", none.alias("_earlier"), none.alias("_later"), F.lit(0).alias("_grid")).unionByName(points.select(*keys, us, "_cell", none.alias("_s"), "_earlier", "_later", F.lit(1).alias("_grid")))
    back = Window.partitionBy(*keys, "_cell").orderBy(us, "_grid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys, "_cell").orderBy(F.col(us).desc(), "_grid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumns({"before": F.coalesce(F.last("_s", True).over(back), "_earlier"), "after": F.coalesce(F.last("_s", True).over(ahead), "_later")})
    return found.filter("_grid = 1")


def resample_nearest(df: DataFrame, keys: Sequence[str], step_us: int | str, value: str, us: str = "us") -> DataFrame:
    """The nearest sample's value at each time of the grid; of two as near, the earlier. Times must be distinct."""
    left, right = F.col(us) - F.col("before._t"), F.col("after._t") - F.col(us)
    near = F.when(F.col("after").isNull() | (left <= right), F.col("before._v")).otherwise(F.col("after._v"))
    return _around(df, keys, step_us, value, us).select(*keys, us, near.alias(value))


resample_nearest_struct = resample_nearest  # the value may be a struct of several columns


def resample_linear(df: DataFrame, keys: Sequence[str], step_us: int | str, value: str, us: str = "us") -> DataFrame:
    """The value at each time of the grid on the line between the samples around it. Times must be distinct."""
    a, b = F.col("before"), F.col("after")
    share = (F.col(us) - a["_t"]) / F.nullif(b["_t"] - a["_t"], F.lit(0))
    return _around(df, keys, step_us, value, us).select(*keys, us, (a["_v"] + F.coalesce(share, F.lit(0.0)) * (F.coalesce(b["_v"], a["_v"]) - a["_v"])).alias(value))


def noon_day(us: Column) -> Column:
    """The number of the day, noon to noon, since 1970-01-01 12:00."""
    return F.floor((us - DAY_US // 2) / DAY_US).cast("long")


def day_thresholds(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.1, factor: float = 15.0, us: str = "us") -> DataFrame:
    """Each noon-to-noon day's quantile times a factor."""
    return df.withColumn("day", noon_day(F.col(us))).groupBy(*keys, "day").agg(F.count("*").alias("n"), (quantile(F.col(value), share) * factor).alias("threshold"))


def day_chunks(df: DataFrame, keys: Sequence[str], days: int = 1, us: str = "us") -> DataFrame:
    """Add chunk, the number of the span of days counted from midnight of the first row's day."""
    first = df.groupBy(*keys).agg((F.floor(F.min(us) / DAY_US) * DAY_US).alias("_midnight"))
    return df.join(first, list(keys)).withColumn("chunk", F.floor((F.col(us) - F.col("_midnight")) / (days * DAY_US)).cast("long")).drop("_midnight")
