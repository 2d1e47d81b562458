"""Registered queries that train models, run streams or whole plans."""

from pyspark.sql import functions as F

from driftloom.functions.storage import materialise, scratch_path
from driftloom.learning import boost, nested
from driftloom.queries_time import REC, flagged, recordings
from driftloom.streaming import segments as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bounded_stream(spark, sf_dir):
    """The samples as a stream that ends: files of Parquet read once."""
    held = materialise(flagged(spark, sf_dir).select("recording_id", F.col("time").cast("timestamp").alias("time"), "value", "flag"), "stream")
    return spark.readStream.schema(held.schema).parquet(held.inputFiles()[0].rsplit("/", 1)[0])


def drain(stream, name: str, mode: str):
    """What the stream's last batch gives, written to files by the executors: nothing of it passes the driver."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-marks")
    put = lambda batch, _: batch.write.mode("overwrite").parquet(out)  # noqa: E731  a complete batch has all rows
    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {REC} SELECT recording_id, date_trunc('day', time) AS start_time, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM r GROUP BY 1, 2")
def stream_bins(spark, sf_dir):
    got = drain(streams.bins(bounded_stream(spark, sf_dir), "1 day", "40 days"), "stream_bins", "complete")
    return got.select("recording_id", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"""WITH {REC}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY recording_id ORDER BY us) > 21600000000 THEN 1 ELSE 0 END AS cut FROM r), k AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS id FROM g)
  SELECT recording_id, min(time) AS start_time, max(time) AS end_time, count(*) AS n FROM k GROUP BY recording_id, id""")
def stream_sessions(spark, sf_dir):
    got = drain(streams.sessions(bounded_stream(spark, sf_dir), "6 hours", "40 days"), "stream_sessions", "complete")
    return got.select("recording_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_time", "end_time")), "n")


# --- boosted trees and nested validation on the embeddings

#: Numbers of an embedding that are features here.
WIDTH = 6


def nights(spark, sf_dir):
    """embeddings as nights of subjects: y tells the label's parity, features are an embedding's first numbers in steps of
    an eighth, the first missing in each eleventh row, with twice the label's parity added to the second in two of three rows."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    y = (F.col("label") % 2).cast("int")
    step = lambda k: F.floor(F.col("embedding")[k].cast("double") * 8)
    x = [F.when(F.col("vec_id") % 11 != 0, step(0)), step(1) + F.when(F.col("vec_id") % 3 != 0, 2 * y).otherwise(0), *(step(k) for k in range(2, WIDTH))]
    return e.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select((F.col("vec_id") % 60).alias("id"), y.alias("y"), *(c.cast("double").alias(f"x{k}") for k, c in enumerate(x)))


_STEP = "floor(CAST(embedding[{}] AS DOUBLE) * 8)"
NIGHTS = f"""d AS (SELECT vec_id, vec_id % 60 AS id, label % 2 AS y, CASE WHEN vec_id % 11 <> 0 THEN {_STEP.format(1)} END AS x0, {_STEP.format(2)} + CASE WHEN vec_id % 3 <> 0 THEN label % 2 * 2 ELSE 0 END AS x1, {", ".join(f"{_STEP.format(k + 1)} AS x{k}" for k in range(2, WIDTH))} FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL)"""


def _finder(rows: str, out: str) -> str:
    """CTEs named out: for each node of rows (vec_id, node, g, h, and f, v long) its best cut (f, c, missing left, gain)."""
    return f"""{out}_t AS (SELECT node, sum(g) AS tg, sum(h) AS th FROM {rows} WHERE f = 0 GROUP BY 1),
  {out}_v AS (SELECT node, f, v, sum(g) AS g, sum(h) AS h FROM {rows} WHERE v IS NOT NULL GROUP BY 1, 2, 3),
  {out}_m AS (SELECT node, f, coalesce(sum(g) FILTER (v IS NULL), 0) AS mg, coalesce(sum(h) FILTER (v IS NULL), 0) AS mh FROM {rows} GROUP BY 1, 2),
  {out}_c AS (SELECT node, f, v, m, sum(g) OVER (PARTITION BY node, f, m ORDER BY v) + m * mg AS gl, sum(h) OVER (PARTITION BY node, f, m ORDER BY v) + m * mh AS hl, tg, th FROM {out}_v JOIN {out}_m USING (node, f) JOIN {out}_t USING (node), (SELECT unnest([1, 0]) AS m)),
  {out}_g AS (SELECT *, (gl ** 2 / (hl + 1) + (tg - gl) ** 2 / (th - hl + 1) - tg ** 2 / (th + 1)) / 2 AS gain FROM {out}_c WHERE hl >= 1 AND th - hl >= 1),
  {out} AS (SELECT node, f, v, m, gl, hl, tg, th, gain FROM {out}_g WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, v, m DESC) = 1)"""


@query(f"""WITH {NIGHTS}, p AS (SELECT avg(y) AS p FROM d), l AS (SELECT vec_id, unnest(range({WIDTH})) AS f, unnest([{", ".join(f"x{k}" for k in range(WIDTH))}]) AS v, p - y AS g, p * (1 - p) AS h FROM d, p),
  r0 AS (SELECT *, 0 AS node FROM l), {_finder("r0", "s0")},
  side AS (SELECT l.vec_id, CASE WHEN coalesce(l.v <= s0.v, s0.m = 1) THEN 1 ELSE 2 END AS node FROM l JOIN s0 ON l.f = s0.f), r1 AS (SELECT l.*, side.node FROM l JOIN side USING (vec_id)), {_finder("r1", "s1")},
  a AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1)
  SELECT CAST(node AS BIGINT) AS node, CAST(f AS BIGINT) AS feature, CAST(v AS DOUBLE) AS cut, round(gain, 6) AS gain, round(-0.1 * gl / (hl + 1), 6) AS left_value, round(-0.1 * (tg - gl) / (th - hl + 1), 6) AS right_value FROM a""")
def boosted_splits(spark, sf_dir):
    """The first tree of a boosted model: feature, cut and gain of its nodes, and what stands at their two sides."""
    model = boost.fit_boosted(nights(spark, sf_dir), [f"x{k}" for k in range(WIDTH)], boost.BoostParams(trees=1, depth=2))
    tree = model.trees[0]
    rows = []
    for n in range(3):
        if (f := int(tree.feature[n])) >= 0:
            cut = model.edges[f][tree.bin[n]] if tree.bin[n] < len(model.edges[f]) else spark_max(spark, sf_dir, f)
            rows.append((n, f, float(cut), round(float(tree.gain[n]), 6), round(float(tree.value[2 * n + 1]), 6), round(float(tree.value[2 * n + 2]), 6)))
    return spark.createDataFrame(rows, "node long, feature long, cut double, gain double, left_value double, right_value double")


def spark_max(spark, sf_dir, feature: int) -> float:
    """The largest value of a feature: the cut that parts known values from missing ones."""
    return nights(spark, sf_dir).agg(F.max(f"x{feature}")).first()[0]


@query(f"WITH {NIGHTS} SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_ones, 0::BIGINT AS n_outside, true AS apart FROM d")
def boosted_scores(spark, sf_dir):
    """A boosted model's probabilities of the rows that it learned from: higher for ones than for zeros."""
    rows = nights(spark, sf_dir)
    got = boost.fit_boosted(rows, [f"x{k}" for k in range(WIDTH)], boost.BoostParams(trees=12, depth=3, rate=0.3)).score(rows)
    return got.agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_ones"), F.count_if((F.col("prob") <= 0) | (F.col("prob") >= 1)).alias("n_outside"), (F.avg(F.when(F.col("y") == 1, F.col("prob"))) > F.avg(F.when(F.col("y") == 0, F.col("prob"))) + 0.1).alias("apart"))


@query(f"""WITH {NIGHTS}, s AS (SELECT id, count(*) AS c FROM d GROUP BY 1), k AS (SELECT count(*) AS n, count(*) FILTER (c >= 4) AS m FROM d JOIN s USING (id))
  SELECT CAST(r AS INTEGER) AS repeat, kind, subjects, CAST(CASE WHEN subjects = 'all' THEN n ELSE m END AS BIGINT) AS n, 3::BIGINT AS folds, true AS in_range, true AS tuned FROM k, (SELECT unnest([0, 1]) AS r), (SELECT unnest(['default', 'searched']) AS kind), (SELECT unnest(['all', 'min_4_nights']) AS subjects)""")
def nested_in_parallel(spark, sf_dir):
    """Nested validation of two repeats and three outer folds, a job a search round: each subject's nights are judged once a
    repeat, all of them and those of subjects with four nights or more."""
    setup = nested.NestedSetup("boost", tuple(f"x{k}" for k in range(WIDTH)), calls=3, override={"trees": (3, 8), "depth": (2, 3)})
    got, _ = nested.parallel_nested(nights(spark, sf_dir), setup, outer=3, repeats=2)
    good = F.col("threshold").between(0, 1) & F.coalesce(F.col("roc_auc").between(0, 1), F.lit(True)) & F.col("f1").between(0, 1)
    return got.groupBy("repeat", "kind", "subjects").agg(F.sum("n").alias("n"), F.countDistinct("fold").alias("folds"), F.bool_and(good).alias("in_range"), F.bool_and((F.col("kind") == "default") | (F.length("params") > 2)).alias("tuned"))


@query(f"""WITH {NIGHTS} SELECT CAST(r AS INTEGER) AS repeat, CAST(k AS INTEGER) AS fold, 4::BIGINT AS n, true AS first_random, true AS known_best FROM (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1, 2]) AS k)""")
def nested_history(spark, sf_dir):
    """The candidates of each outer fold's Gaussian search: all but the first chosen by what is known, each with its mean
    objective over inner folds."""
    setup = nested.NestedSetup("lr", tuple(f"x{k}" for k in range(WIDTH)), calls=4, search="gaussian", start=2, override={"elasticNetParam": 0.0})
    got, history = nested.parallel_nested(nights(spark, sf_dir), setup, outer=3, repeats=2)
    best = got.filter("kind = 'searched' AND subjects = 'all'").select("repeat", "fold", F.col("params").alias("_chosen"))
    top = history.groupBy("repeat", "fold").agg(F.count("*").alias("n"), F.countDistinct("params").alias("_d"), F.max_by("params", F.struct("objective", -F.col("turn"))).alias("_best"))
    return top.join(best, ["repeat", "fold"]).select("repeat", "fold", "n", (F.col("_d") > 1).alias("first_random"), (F.col("_best") == F.col("_chosen")).alias("known_best"))
