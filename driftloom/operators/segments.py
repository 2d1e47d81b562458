"""Runs, sessions, and joins of points and intervals with intervals.

Runs and sessions are found in two levels: within spans of time of a recording, then over the spans' few results. One
recording may thus hold any share of all rows without being one task's work."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeaxis import DAY_US, SPAN_US

HOUR_US = 3_600_000_000


def _spans(df: DataFrame, us: str, span_us: int) -> DataFrame:
    return df.withColumn("_span", F.floor(F.col(us) / span_us).cast("long"))


def local_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flags: Sequence[str], us: str = "us", span_us: int = SPAN_US) -> DataFrame:
    """Runs of consecutive rows with equal flags within spans of time, as joined_runs() takes them for each of the flags."""
    spanned = _spans(df, us, span_us)
    w = Window.partitionBy(*keys, "_span").orderBy(*order)
    edge = F.row_number().over(w) == 1
    for flag in flags:
        edge = edge | ~F.col(flag).eqNullSafe(F.lag(flag).over(w))
    local = spanned.withColumn("_run", F.sum(edge.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return local.groupBy(*keys, "_span", "_run", *flags).agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("n"))


def joined_runs(local: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Local runs one after the other with equal flag as one: keys, island, flag, start_us, end_us, n."""
    v = Window.partitionBy(*keys).orderBy("_span", "_run")
    new = (~F.col(flag).eqNullSafe(F.lag(flag).over(v)) | (F.row_number().over(v) == 1)).cast("int")
    merged = local.withColumn("island", F.sum(new).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy(*keys, "island", flag).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, us: str = "us", span_us: int = SPAN_US) -> DataFrame:
    """Maximal runs of consecutive rows with equal flag: keys, flag, start_us, end_us, n. A run of one row has length 0.

    order begins with us. A null flag is a value of its own."""
    return joined_runs(local_runs(df, keys, order, [flag], us, span_us), keys, flag)


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, condition: bool = True, us: str = "us") -> DataFrame:
    """The islands where flag is condition, with length_us."""
    found = islands(df, keys, order, flag, us).filter(F.col(flag) == F.lit(condition))
    return found.select(*keys, "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("length_us"), "n")


def sessions(df: DataFrame, keys: Sequence[str], gap_us: int, us: str = "us", span_us: int = SPAN_US) -> DataFrame:
    """Rows joined while the step to the next is at most gap_us: keys, start_us, end_us, n."""
    spanned = _spans(df, us, span_us)
    w = Window.partitionBy(*keys, "_span").orderBy(us)
    apart = (F.col(us) - F.lag(us).over(w) > gap_us).cast("int")
    local = spanned.withColumn("_run", F.sum(F.coalesce(apart, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.groupBy(*keys, "_span", "_run").agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("n"))
    return merge_close(local.drop("_span", "_run"), keys, gap_us, strict=False)


def merge_close(intervals: DataFrame, keys: Sequence[str], gap_us: int, strict: bool = True) -> DataFrame:
    """Join intervals whose gap to the one before is under gap_us (strict), or at most gap_us; n adds up if there is one.

    The intervals of a key must not overlap."""
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    gap = F.col("start_us") - F.lag("end_us").over(w)
    new = F.coalesce((gap >= gap_us) if strict else (gap > gap_us), F.lit(False)).cast("int")
    grouped = intervals.withColumn("_group", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_group")
    more = [F.sum("n").alias("n")] if "n" in intervals.columns else []
    return grouped.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_parts"), *more).drop("_group")


def drop_short(intervals: DataFrame, least_us: int) -> DataFrame:
    return intervals.filter(F.col("end_us") - F.col("start_us") >= least_us)


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], us: str = "us", name: str = "inside", cell_us: int = DAY_US) -> DataFrame:
    """Add whether the point lies in any interval of its key, ends included.

    Intervals are cut into cells of time, so the join is an equal join on key and cell with a filter: no key's points
    meet all of its intervals, and no side is broadcast unless Spark has sized it."""
    return points_in(points, {name: intervals}, keys, us, cell_us)


def points_in(points: DataFrame, intervals: dict[str, DataFrame], keys: Sequence[str], us: str = "us", cell_us: int = DAY_US) -> DataFrame:
    """points_in_intervals() of several tables of intervals, by name, in one join."""
    every = None
    for k, some in enumerate(intervals.values()):
        one = some.select(*keys, F.lit(k).alias("_kind"), F.col("start_us").alias("_a"), F.col("end_us").alias("_b"))
        every = one if every is None else every.unionByName(one)
    cells = every.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / cell_us), F.floor(F.col("_b") / cell_us))))
    # One list of intervals for each key and cell: rows of points are never multiplied.
    kind = lambda k: F.collect_list(F.when(F.col("_kind") == k, F.struct("_a", "_b"))).alias(f"_in{k}")
    listed = cells.groupBy(*keys, "_cell").agg(*(kind(k) for k in range(len(intervals))))
    joined = points.withColumn("_cell", F.floor(F.col(us) / cell_us)).join(listed, [*keys, "_cell"], "left")
    inside = {name: F.coalesce(F.exists(f"_in{k}", lambda i: F.col(us).between(i["_a"], i["_b"])), F.lit(False)) for k, name in enumerate(intervals)}
    return joined.withColumns(inside).drop("_cell", *(f"_in{k}" for k in range(len(intervals))))


def contained_in(inner: DataFrame, outer: DataFrame, keys: Sequence[str], outer_id: str, cell_us: int = DAY_US) -> DataFrame:
    """Pairs of an interval and each interval of outer that holds it whole: inner's columns and outer_id.

    Both are found by the cell where the inner one begins."""
    cells = outer.select(*keys, outer_id, F.col("start_us").alias("_a"), F.col("end_us").alias("_b"), F.explode(F.sequence(F.floor(F.col("start_us") / cell_us), F.floor(F.col("end_us") / cell_us))).alias("_cell"))
    found = inner.withColumn("_cell", F.floor(F.col("start_us") / cell_us)).join(cells, [*keys, "_cell"])
    return found.filter((F.col("_a") <= F.col("start_us")) & (F.col("_b") >= F.col("end_us"))).drop("_a", "_b", "_cell")


def best_overlap(nights: DataFrame, windows: DataFrame, keys: Sequence[str], night_id: str, window_id: str, slack_us: int = 120_000_000, least: float = 0.5, cell_us: int = DAY_US) -> DataFrame:
    """For each night the window that overlaps it most, first of equals, if that is at least a share of the night.

    slack_us widens the windows at both ends. keys, night_id, window_id, overlap_us."""
    cut = lambda a, b: F.explode(F.sequence(F.floor(a / cell_us), F.floor(b / cell_us)))
    n = nights.select(*keys, night_id, F.col("start_us").alias("_a"), F.col("end_us").alias("_b"), cut(F.col("start_us"), F.col("end_us")).alias("_cell"))
    wide = windows.select(*keys, window_id, F.col("start_us").alias("_s"), (F.col("start_us") - slack_us).alias("_c"), (F.col("end_us") + slack_us).alias("_d"))
    v = wide.withColumn("_cell", cut(F.col("_c"), F.col("_d")))
    overlap = F.least("_b", "_d") - F.greatest("_a", "_c")
    pairs = n.join(v, [*keys, "_cell"]).withColumn("overlap_us", overlap).filter("overlap_us > 0").select(*keys, night_id, window_id, "_a", "_b", "_s", "overlap_us").distinct()
    best = pairs.groupBy(*keys, night_id, "_a", "_b").agg(F.min(F.struct(-F.col("overlap_us"), "_s", window_id)).alias("_best"))
    return best.select(*keys, night_id, F.col(f"_best.{window_id}").alias(window_id), (-F.col("_best.col1")).alias("overlap_us"), "_a", "_b").filter(F.col("overlap_us") >= least * (F.col("_b") - F.col("_a"))).drop("_a", "_b")


def night_overlap_h(start_us: Column, end_us: Column, night_from: int = 22, night_to: int = 9) -> Column:
    """Hours that an interval shares with nights from night_from to night_to o'clock.

    Within a day: with the night before and the night after. Over one midnight: with that night. Over more: 0."""
    first, last = F.floor(start_us / DAY_US), F.floor(end_us / DAY_US)
    shared = lambda day: F.greatest(F.least(end_us, (day + 1) * DAY_US + night_to * HOUR_US) - F.greatest(start_us, day * DAY_US + night_from * HOUR_US), F.lit(0)) / HOUR_US
    return F.when(first == last, shared(first - 1) + shared(first)).when(last - first == 1, shared(first)).otherwise(F.lit(0.0))


def select_nights(windows: DataFrame, keys: Sequence[str], least_overlap_h: float = 2.0, least_length_h: float = 4.0) -> DataFrame:
    """Windows with enough night overlap and length, numbered from 0 by start in each recording."""
    length = (F.col("end_us") - F.col("start_us")) / HOUR_US
    picked = windows.withColumn("overlap_h", night_overlap_h(F.col("start_us"), F.col("end_us"))).withColumn("length_h", length).filter((F.col("overlap_h") >= least_overlap_h) & (F.col("length_h") > least_length_h))
    return picked.withColumn("night", (F.row_number().over(Window.partitionBy(*keys).orderBy("start_us")) - 1).cast("long"))
