"""Further registered queries: neighbours, grids of curves, summaries, selections."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.learning import curves, evaluate, loader, prepare
from driftloom.operators import neighbours, validate
from driftloom.operators import segments as seg
from driftloom.queries_tables import CURVE, SCORED, predicted, read, rounded, scored
from driftloom.queries_time import HOUR, ISLANDS, KEY, ORDER, REC, active, flagged, recordings

NIGHTS_P = "n AS (SELECT o_custkey AS id, o_orderkey AS night, round(o_totalprice / 500000, 9) AS prob, CAST(o_custkey % 3 = 0 AS INTEGER) AS y FROM orders)"


def _nights(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("night"), F.round(F.col("o_totalprice") / 500000, 9).alias("prob"), (F.col("o_custkey") % 3 == 0).cast("int").alias("y"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey, least(p_retailprice - lag(p_retailprice) OVER w, lead(p_retailprice) OVER w - p_retailprice) AS nearest FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)".replace("least(", "round(least(").replace(" - p_retailprice) AS", " - p_retailprice), 6) AS"))
def nearest_number(spark, sf_dir):
    got = neighbours.nearest_number(read(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_partkey")
    return rounded(got.select("p_partkey", "nearest"))


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
  p AS (SELECT q.vec_id AS query, r.vec_id AS vec_id, sqrt((q.a - r.a) ** 2 + (q.b - r.b) ** 2 + (q.c - r.c) ** 2) AS d FROM v q, v r WHERE q.vec_id % 50 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS place FROM p)
  SELECT query, vec_id, round(d, 6) AS distance, place::INTEGER AS place FROM k WHERE place <= 3""")
def nearest_vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("abc")))
    return rounded(neighbours.nearest_vectors(v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query"), v, list("abc"), "query", "vec_id", 3))


@query("""WITH p AS (SELECT q.vec_id AS query, r.vec_id AS vec_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS d FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS place FROM p)
  SELECT query, vec_id, round(d, 6) AS distance, place::INTEGER AS place, true AS pruned FROM k WHERE place <= 5""")
def pruned_neighbours(spark, sf_dir):
    """The five nearest vectors by all numbers of an embedding; no query meets more cells than there are."""
    names = [f"x{k}" for k in range(64)]
    v = read(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(names)))
    got = neighbours.pruned_neighbours(v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query"), v, names, "query", "vec_id", 5)
    return rounded(got.select("query", "vec_id", "distance", "place", (F.col("visited") <= F.col("cells")).alias("pruned")))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def look_up_one(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return neighbours.look_up_one(c, read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("c_custkey", "n_name")


@query(f"""WITH {CURVE}, pt AS (SELECT fpr, max(tpr) AS tpr FROM (SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT fp / q, tp / p FROM k) GROUP BY 1), g AS (SELECT unnest(range(21)) / 20.0::DOUBLE AS x),
  a AS (SELECT g.x, pt.fpr AS x0, pt.tpr AS y0 FROM g ASOF JOIN pt ON g.x >= pt.fpr), b AS (SELECT g.x, pt.fpr AS x1, pt.tpr AS y1 FROM g ASOF JOIN pt ON g.x <= pt.fpr)
  SELECT round(x, 6) AS fpr, round(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 6) AS tpr FROM a JOIN b USING (x)""")
def roc_on_grid(spark, sf_dir):
    return rounded(curves.roc_on_grid(scored(spark, sf_dir), 20))


@query(f"WITH {ISLANDS} SELECT recording_id, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_samples, round(sum(end_us - start_us) / {HOUR}.0, 6) AS hours, round(max(end_us - start_us) / {HOUR}.0, 6) AS longest_h FROM s WHERE flag GROUP BY 1")
def segment_summary(spark, sf_dir):
    h = F.col("length_us") / HOUR
    return rounded(active(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("n_segments"), F.sum("n").alias("n_samples"), F.sum(h).alias("hours"), F.max(h).alias("longest_h")))


@query(f"WITH {REC}, a AS (SELECT recording_id, min(us) AS a, max(us) AS b, count(*) AS n FROM r GROUP BY 1) SELECT recording_id, make_timestamp(a) AS start_time, make_timestamp(b) AS end_time, n, round((b - a) / 86400000000.0, 6) AS days FROM a")
def recording_spans(spark, sf_dir):
    span = (F.max("us") - F.min("us")) / 86_400_000_000
    return rounded(recordings(spark, sf_dir).groupBy(*KEY).agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("n"), span.alias("days")))


@query(f"WITH {SCORED} SELECT dataset || '_' || y AS stratum, count(*) AS n FROM s GROUP BY 1")
def strata(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(prepare.stratum(F.col("y"), F.col("dataset")).alias("stratum")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def select_features(spark, sf_dir):
    return validate.select_features(read(spark, sf_dir, "part"), ["p_size", "not_there", "p_retailprice"], ["p_partkey"])


@query("SELECT o_orderkey, rank FROM (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_orderkey", "rank")


@query("SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS dearest, arg_min(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY 1")
def arg_extremes(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("dearest"), F.min_by("o_orderkey", "o_totalprice").alias("cheapest"))


@query("SELECT trim(c_mktsegment) AS segment, lower(trim(c_name)) AS name FROM customer")
def trim_strings(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias(" segment "), F.concat(F.lit(" "), F.lower("c_name")).alias("name"))
    return validate.trim_strings(c)


@query(f"""WITH {SCORED}, p AS (SELECT *, CAST(score >= 0.45 AS INTEGER) AS pred FROM s), c AS (SELECT dataset, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 1) AS fn, count(*) FILTER (pred = 0 AND y = 0) AS tn FROM p GROUP BY 1)
  SELECT round(avg((tp + tn) / (tp + fp + fn + tn)), 6) AS accuracy_mean, round(stddev_pop((tp + tn) / (tp + fp + fn + tn)), 6) AS accuracy_sd FROM c""")
def fold_scores(spark, sf_dir):
    per = curves.metrics(predicted(spark, sf_dir), keys=["dataset"])
    return rounded(per.agg(F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_sd")))


@query(f"WITH {ISLANDS}, l AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY recording_id ORDER BY start_us) > {24 * HOUR} THEN 1 ELSE 0 END AS cut FROM s WHERE flag), k AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id ORDER BY start_us) AS id FROM l) SELECT recording_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_parts, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY recording_id, id")
def merge_touching_segments(spark, sf_dir):
    return seg.merge_close(seg.segments(flagged(spark, sf_dir), KEY, ORDER, "flag"), KEY, 24 * HOUR, strict=False)


# --- loading and evaluating


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 0 END AS y FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def label_map(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("y", loader.label_of(F.concat(F.lit(" "), F.initcap("c_mktsegment")), {"Building": 1, "machinery ": 0}))
    return c.filter("y IS NOT NULL").select("c_custkey", "y")


def _moves(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    return read(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("id", F.lit("").alias("record_id"), F.col("l_orderkey").alias("night"), F.col("l_quantity").alias("time_diff"), F.col("l_discount").alias("f"))


@query("""WITH w AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 5 <> 0),
  n AS (SELECT o_custkey AS id, l_orderkey AS night, avg(l_discount) AS m, quantile_cont(l_discount, 0.9) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0.5 AND l_quantity < 40 GROUP BY 1, 2)
  SELECT n.id, max(y) AS y, round(avg(m) + 1.7e-9, 7) AS f_mean, round(avg(p) + 1.7e-9, 7) AS f_p90 FROM n JOIN w ON n.id = w.id GROUP BY 1""")
def load_patients(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    meta = c.select(F.col("c_custkey").alias("ID"), F.col("c_mktsegment").alias("diagnosis"), F.when(F.col("c_custkey") % 5 == 0, "1").otherwise("0").alias("exclude"))
    got = loader.load_set(_moves(spark, sf_dir), meta, ["f"], {"building": 1, "machinery": 0}, "patient", longest_s=40.0, functions=["mean", "p90"])
    return got.select("id", "y", *(F.round(F.col(x) + 1.7e-9, 7).alias(x) for x in ("f_mean", "f_p90")))


@query(f"""WITH {NIGHTS_P}, p AS (SELECT id, avg(prob) AS m, sum(CASE WHEN prob >= 0.4 THEN 1 ELSE 0 END) AS s, count(*) AS k, max(y) AS y FROM n GROUP BY 1), v AS (SELECT y, CAST(m > 0.4 AS INTEGER) AS pred_mean, CAST(s >= k / 2.0 AS INTEGER) AS pred_majority FROM p),
  l AS (SELECT 'pred_mean' AS way, y, pred_mean AS pred FROM v UNION ALL SELECT 'pred_majority', y, pred_majority FROM v UNION ALL SELECT 'pred_any', y, greatest(pred_mean, pred_majority) FROM v UNION ALL SELECT 'pred_all', y, least(pred_mean, pred_majority) FROM v)
  SELECT way, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 1) AS fn, count(*) FILTER (pred = 0 AND y = 0) AS tn FROM l GROUP BY 1""")
def patient_scores(spark, sf_dir):
    nights = _nights(spark, sf_dir)
    return evaluate.patient_scores(evaluate.patient_table(nights, 0.4)).select("way", "tp", "fp", "fn", "tn")


@query(f"""WITH {NIGHTS_P}, c AS (SELECT count(*) FILTER (prob >= 0.4 AND y = 1) AS tp, count(*) FILTER (prob >= 0.4 AND y = 0) AS fp, count(*) FILTER (prob < 0.4 AND y = 1) AS fn, count(*) FILTER (prob < 0.4 AND y = 0) AS tn, avg((prob - y) ** 2) AS b FROM n)
  SELECT tp, fp, fn, tn, round(b, 6) AS brier, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def night_scores(spark, sf_dir):
    return rounded(evaluate.night_scores(_nights(spark, sf_dir), 0.4).select("tp", "fp", "fn", "tn", "brier", "accuracy"))
