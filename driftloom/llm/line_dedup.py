"""Line dedup on DataFrame functions only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialise

#: A line is common if more rows than this share (1 / HOT) of all hold it, and more than HOT_ROWS.
HOT, HOT_ROWS = 512, 4096


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key occurs in at least min_docs documents, save those of the smallest id that holds it.

    A key is the line without white space at both ends, A-Z lower-cased; keys under min_chars code points never count.
    Returns all columns of docs and kept_text, n_lines, n_dropped.

    Null or empty text: one empty line. Null id: its lines count for nobody and none is dropped. Rows that repeat an id
    with the same text are one document; a line that repeats within the smallest document stays each time. An empty
    table gives an empty result. Columns of docs named kept_text, n_lines or n_dropped are replaced.

    Lines are reduced to 16-byte hashes before any shuffle, counts are combined before it, and only ids, positions and
    one copy of each text travel."""
    own = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    base = docs.select(*own, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_driftloom_body")).withColumn("_driftloom_same", F.xxhash64("_driftloom_body"))
    key = F.btrim(F.col("_line"), F.lit(SPACES))
    lines = (
        base.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_driftloom_id"), "_driftloom_same", F.posexplode(F.split(ascii_lower(F.col("_driftloom_body")), "\n", -1)).alias("_pos", "_line"))
        .withColumn("_key", key)
        .filter(F.char_length("_key") >= min_chars)
        .select("_driftloom_id", "_driftloom_same", "_pos", F.unhex(F.md5("_key")).alias("_hash"))
    )
    lines = materialise(lines, "lines")  # both the counts and the join below read it
    groups = lines.groupBy("_hash")
    if min_docs == 2:
        counted = groups.agg(F.min("_driftloom_id").alias("_first"), F.max("_driftloom_id").alias("_last"), F.count("*").alias("_rows")).filter(F.col("_first") != F.col("_last"))
    else:
        counted = groups.agg(F.min("_driftloom_id").alias("_first"), F.count_distinct("_driftloom_id").alias("_n"), F.count("*").alias("_rows")).filter(F.col("_n") >= min_docs)
    counted = materialise(counted.select("_hash", "_first", "_rows"), "repeated-lines")
    # Lines so common that one task would get many: at most HOT of them can each have that share of all lines, so they are
    # broadcast, and the lines that hold them are never brought together.
    limit = max(HOT_ROWS, -(-lines.count() // HOT))
    hot = counted.filter(F.col("_rows") > limit).select("_hash", F.col("_first").alias("_hot"))
    marked = lines.join(F.broadcast(hot), "_hash", "left")
    rest = marked.filter(F.col("_hot").isNull()).join(counted.filter(F.col("_rows") <= limit).select("_hash", "_first"), "_hash")
    common = marked.filter(F.col("_hot").isNotNull()).withColumn("_first", F.col("_hot"))
    spots = ["_driftloom_id", "_driftloom_same", "_pos", "_first"]
    dropped = (
        rest.select(*spots).unionByName(common.select(*spots))
        .filter(F.col("_driftloom_id") != F.col("_first"))
        .groupBy("_driftloom_id", "_driftloom_same")
        .agg(F.collect_set("_pos").alias("_driftloom_drop"))
    )
    split = F.split("_driftloom_body", "\n", -1)
    joined = base.join(dropped, (F.col(id_col) == F.col("_driftloom_id")) & (base["_driftloom_same"] == dropped["_driftloom_same"]), "left").select(*(base[c] for c in own), base["_driftloom_body"], "_driftloom_drop")
    lines_of = joined.withColumn("_driftloom_lines", split)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_driftloom_lines") - 1), F.col("_driftloom_drop")), lambda i: F.element_at("_driftloom_lines", i + 1))
    return lines_of.select(
        *own,
        F.when(F.col("_driftloom_drop").isNull(), F.col("_driftloom_body")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size("_driftloom_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_driftloom_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
