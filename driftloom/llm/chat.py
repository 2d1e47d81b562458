"""Chat formatting on DataFrame functions only."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, each turn's place in it, two rolling 64-bit hashes of the turns up to it, and how many turns there are.

    The exclusive or of hashes that hold their place identifies a prefix and needs no ordered list in memory."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = lambda seed: F.xxhash64(F.lit(seed), F.col("place"), F.col("role"), F.col("role").isNull(), F.col("text"), F.col("text").isNull())
    return (
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("place", F.row_number().over(order))
        .select("conv_id", "place", F.bit_xor(part(1)).over(so_far).alias("h1"), F.bit_xor(part(2)).over(so_far).alias("h2"), F.count("*").over(Window.partitionBy("conv_id")).alias("turns"))
    )


def format_chats(turns: DataFrame, open_mark: str = "<|", close_mark: str = "|>\n", end_mark: str = "<|end|>\n") -> DataFrame:
    """Collapse logged snapshots and render each maximal conversation as one text.

    A conversation whose turns (role and text, in order of turn) are the first turns of a longer one goes; of equal
    ones the smallest conv_id stays. Returns conv_id, n_turns, rendered.

    Turns sort by turn, then role, then text, nulls first, so ties have one order. A null role renders as "unknown", a
    null text as empty; both differ from those strings when compared. Turns with null conv_id make one conversation
    with that id, which goes before others among equals. Repeated rows are turns of their own. An empty table gives an
    empty result; other columns are ignored. One conversation is one output row and must fit in it."""
    hashed = materialise(prefix_hashes(turns), "prefixes")  # sorted once; without texts
    whole = hashed.filter(F.col("place") == F.col("turns"))
    best = whole.groupBy("place", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("has"), F.col("conv_id").alias("conv_id"))).alias("first"))
    shorter = hashed.filter(F.col("place") < F.col("turns")).select("place", "h1", "h2").distinct()
    kept = best.join(shorter, ["place", "h1", "h2"], "left_anti").select(F.col("first.conv_id").alias("_keep"))
    rendered = lambda t: F.concat(F.lit(open_mark), F.coalesce(t["role"], F.lit("unknown")), F.lit(close_mark), F.coalesce(t["text"], F.lit("")), F.lit(end_mark))
    return (
        turns.select("conv_id", "turn", "role", "text")
        .join(kept, F.col("conv_id").eqNullSafe(F.col("_keep")), "left_semi")
        .groupBy("conv_id")
        .agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("parts"))
        .select("conv_id", "n_turns", F.array_join(F.transform("parts", rendered), "").alias("rendered"))
    )
