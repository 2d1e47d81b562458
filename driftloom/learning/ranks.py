"""Ranks and running sums over whole tables without a one-task window: by range buckets, then within them."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the value that are summed apart. Their totals, BUCKETS + 2 rows for each group, are all that one task sees.
BUCKETS = 1024


def running(df: DataFrame, value: str, sums: dict[str, Column], keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """A row for each value of each group, with the sums over it (name) and over all values up to it (cum_name)."""
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    span = known.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    share = F.coalesce((F.col(value).cast("double") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    cut = known.crossJoin(F.broadcast(span)).withColumn("_cell", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS)).cast("int")).drop("_lo", "_hi")  # one row
    at = F.col("_cell").desc() if descending else F.col("_cell")
    # The ends and the cells' totals are small sums over the rows; only the sums of each value are dealt by their cells.
    cells = cut.groupBy(*keys, "_cell").agg(*(c.alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "_cell", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    each = cut.groupBy(*keys, "_cell", value).agg(*(c.alias(n) for n, c in sums.items()))
    inside = Window.partitionBy(*keys, "_cell").orderBy(F.col(value).desc() if descending else F.col(value)).rowsBetween(Window.unboundedPreceding, 0)
    joined = each.withColumns({f"_i_{n}": F.sum(n).over(inside) for n in sums}).join(cells, [*keys, "_cell"])
    return joined.select(*keys, value, *sums, *((F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(f"cum_{n}") for n in sums))


def rank_table(df: DataFrame, value: str, keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Each value's rank among the values of its group: rank_min, rank_max (ties get the lowest, highest) and rank_mean."""
    t = running(df, value, {"_m": F.count("*")}, keys, descending)
    low, high = F.col("cum__m") - F.col("_m") + 1, F.col("cum__m")
    return t.select(*keys, value, low.alias("rank_min"), high.alias("rank_max"), ((low + high) / 2.0).alias("rank_mean"))


def with_rank(df: DataFrame, value: str, kind: str = "max", keys: Sequence[str] = (), descending: bool = False, name: str = "rank") -> DataFrame:
    """df with the rank of value; null values come after all others ('max' and 'mean': as one tie)."""
    ranks = rank_table(df, value, keys, descending).select(*keys, value, F.col(f"rank_{kind}").alias(name))
    out = df.join(ranks, [*keys, value], "left")
    if keys:
        totals = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(value).alias("_k"))
        out = out.join(totals, list(keys))
    else:
        out = out.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"), F.count(value).alias("_k"))))  # one row
    last = {"max": F.col("_n"), "min": F.col("_k") + 1, "mean": (F.col("_n") + F.col("_k") + 1) / 2.0}[kind]
    return out.withColumn(name, F.coalesce(F.col(name), last)).drop("_n", "_k").select(*df.columns, name)


def top_k(df: DataFrame, value: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose rank among the highest values is at most k; ties with the last are left out as a whole."""
    return with_rank(df, value, "max", keys, descending=True).filter(F.col("rank") <= k)
