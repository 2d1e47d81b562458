"""Registered queries on features, roll-ups, joins, cleaning and learning, each with its SQL where SQL can state it.

Movement: lineitem; night: order; subject: customer; dataset: nation or source; label: labels.quality."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.numeric import finite, record_key
from driftloom.learning import curves, prepare, ranks, stats
from driftloom.operators import features as ft
from driftloom.operators import rollup, validate
from driftloom.queries_time import HOUR, KEY, ORDER, REC, active, recordings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# --- features

@query("""WITH d AS (SELECT l_orderkey, l_quantity, l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey) AS e FROM lineitem), m AS (SELECT l_orderkey, avg(l_quantity) AS a, avg(e ** 2) AS m2, avg(e ** 3) AS m3, avg(e ** 4) AS m4 FROM d GROUP BY 1)
  SELECT l_orderkey, round(a, 9) AS mean_mag, round(sqrt(m2), 9) AS std_mag, round(CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 END, 9) AS skew_mag, round(CASE WHEN m2 > 0 THEN m4 / m2 ** 2 - 3 END, 9) AS kurt_mag FROM m""")
def feat_moments(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*ft.moments("l_quantity", "mag")), 9)


@query("SELECT l_orderkey, round(min(l_quantity), 6) AS min_mag, round(quantile_cont(l_quantity, 0.25), 6) AS q25_mag, round(quantile_cont(l_quantity, 0.5), 6) AS med_mag, round(quantile_cont(l_quantity, 0.75), 6) AS q75_mag, round(max(l_quantity), 6) AS max_mag, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS iqr_mag FROM lineitem GROUP BY 1")
def feat_quantiles(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*ft.quantiles("l_quantity", "mag")))


@query("SELECT l_orderkey, round(sum(abs(l_quantity)), 9) AS sma, round(avg(l_discount * l_discount + l_tax * l_tax), 9) AS power, round(sqrt(avg(l_quantity * l_quantity)), 9) AS rms FROM lineitem GROUP BY 1")
def feat_energy(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*ft.energy("l_quantity", ["l_discount", "l_tax"])), 9)


@query(f"""WITH {REC}, p AS (SELECT recording_id, value, lead(value) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS nx FROM r),
  s AS (SELECT recording_id, stddev_pop((nx - value) / sqrt(2)) AS sd1, stddev_pop((nx + value) / sqrt(2)) AS sd2 FROM p WHERE nx IS NOT NULL GROUP BY 1)
  SELECT recording_id, round(sd1, 6) AS sd1, round(sd2, 6) AS sd2, round(sd2 / nullif(sd1, 0), 6) AS sd_ratio, round(sd1 * sd2 * pi(), 4) AS ellipse_area FROM s""")
def feat_poincare(spark, sf_dir):
    found = ft.poincare(recordings(spark, sf_dir), KEY, ORDER, "value")
    return rounded(found.withColumn("ellipse_area", F.round("ellipse_area", 4)))


BOUTS = f"""{REC}, e AS (SELECT *, value > 30 AS flag, lag(value > 30) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS p FROM r),
  i AS (SELECT *, sum(CASE WHEN flag IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS island FROM e),
  b AS (SELECT recording_id, min(us) AS start_us, max(us) AS end_us FROM i WHERE flag GROUP BY recording_id, island)"""


@query(f"""WITH {BOUTS}, g AS (SELECT recording_id, (lead(start_us) OVER (PARTITION BY recording_id ORDER BY start_us) - end_us) / 1e6 AS gap FROM b)
  SELECT recording_id, round(avg(gap), 4) AS iei_mean, round(stddev_pop(gap), 4) AS iei_std, round(stddev_pop(gap) / avg(gap), 6) AS iei_cv, round(quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25), 4) AS iei_iqr FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def feat_iei(spark, sf_dir):
    found = ft.intervals_between(active(spark, sf_dir), KEY)
    return found.select("recording_id", *(F.round(c, d).alias(c) for c, d in (("iei_mean", 4), ("iei_std", 4), ("iei_cv", 6), ("iei_iqr", 4))))


@query(f"WITH {BOUTS} SELECT recording_id, count(*) AS n_moves, round(count(*) / nullif((max(end_us) - min(start_us)) / {HOUR}.0, 0), 6) AS n_moves_per_h FROM b GROUP BY 1")
def feat_moves_per_h(spark, sf_dir):
    return rounded(ft.bouts_per_hour(active(spark, sf_dir), KEY))


@query(f"""WITH {BOUTS}, d AS (SELECT recording_id, (end_us - start_us) / 1e6 AS dur FROM b), c AS (SELECT *, dur - avg(dur) OVER (PARTITION BY recording_id) AS e FROM d),
  m AS (SELECT recording_id, avg(dur) AS a, avg(e ** 2) AS m2, avg(e ** 3) AS m3, avg(e ** 4) AS m4, quantile_cont(dur, 0.25) AS q1, quantile_cont(dur, 0.5) AS q2, quantile_cont(dur, 0.75) AS q3 FROM c GROUP BY 1)
  SELECT recording_id, round(a, 3) AS mean_dur, round(sqrt(m2), 3) AS std_dur, round(CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 END, 5) AS skew_dur, round(CASE WHEN m2 > 0 THEN m4 / m2 ** 2 - 3 END, 5) AS kurt_dur, round(q1, 3) AS q25_dur, round(q2, 3) AS med_dur, round(q3, 3) AS q75_dur FROM m""")
def feat_durations(spark, sf_dir):
    found = ft.durations(active(spark, sf_dir), KEY)
    return found.select("recording_id", *(F.round(c, 5 if c[:4] in ("skew", "kurt") else 3).alias(c) for c in found.columns[1:]))


@query(f"""WITH {BOUTS}, m AS (SELECT recording_id, (start_us + end_us) / 2.0 AS m FROM b), x AS (SELECT recording_id, (m - min(m) OVER w) / nullif(max(m) OVER w - min(m) OVER w, 0) AS x FROM m WINDOW w AS (PARTITION BY recording_id)),
  g AS (SELECT CAST(unnest(range(40)) AS INTEGER) AS slot)
  SELECT recording_id, slot, round(sum(exp(-(((slot / 39.0 - x) / 0.04) ** 2) / 2)) / (count(*) * 0.04 * sqrt(2 * pi())), 8) AS density FROM x, g WHERE x IS NOT NULL GROUP BY 1, 2""")
def feat_kde_density(spark, sf_dir):
    return rounded(ft.kernel_density(active(spark, sf_dir), KEY, points=40), 8)


@query(f"""WITH {REC}, s AS (SELECT recording_id, us, us - lag(us) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS step, y > 20 AS asleep FROM r)
  SELECT recording_id, round(sum(CASE WHEN asleep THEN step END) / CAST(max(us) - min(us) AS DOUBLE), 6) AS sleep_eff, round(CAST(max(us) - min(us) AS DOUBLE) / sum(CASE WHEN asleep THEN step END), 6) AS window_over_sleep FROM s GROUP BY 1""")
def feat_sleep_share(spark, sf_dir):
    asleep = recordings(spark, sf_dir).withColumn("asleep", F.col("y") > 20)
    return rounded(ft.sleep_share(asleep, KEY, ORDER, "asleep"))


# --- roll-ups and joins

FEATURES = ("l_quantity", "l_extendedprice")


def _rollup_sql() -> str:
    parts = []
    for f in FEATURES:
        g1 = f"CASE WHEN count(*) >= 3 AND max(s_{f}) > 0 THEN avg(e_{f} ** 3) / max(s_{f}) ** 3 * sqrt(count(*) * (count(*) - 1.0)) / (count(*) - 2) END"
        g2 = f"CASE WHEN count(*) >= 4 AND max(s_{f}) > 0 THEN ((count(*) + 1.0) * (avg(e_{f} ** 4) / max(s_{f}) ** 4 - 3) + 6) * (count(*) - 1) / ((count(*) - 2.0) * (count(*) - 3)) END"
        q = lambda p, f=f: f"quantile_cont({f}, {p})"
        near, shape = lambda x: f"round({x} + 1.7e-7, 5)", lambda x: f"round({x} + 1.7e-9, 7)"  # off the ties of exact fractions
        parts += [f"{near(f'avg({f})')} AS {f}_mean", f"{near(f'stddev_samp({f})')} AS {f}_std", f"{shape(g1)} AS {f}_skew", f"{shape(g2)} AS {f}_kurt", f"{near(f'avg(abs(e_{f}))')} AS {f}_mad", f"{near(q(0.75) + ' - ' + q(0.25))} AS {f}_iqr", f"{near(q(0.1))} AS {f}_p10", f"{near(q(0.9))} AS {f}_p90"]
    cols = ", ".join(f"{f}, {f} - avg({f}) OVER w AS e_{f}, stddev_pop({f}) OVER w AS s_{f}" for f in FEATURES)
    return f"WITH d AS (SELECT l_orderkey, {cols} FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, count(*) AS n, {', '.join(parts)} FROM d GROUP BY l_orderkey"


@query(_rollup_sql())
def rollup_movement_to_night(spark, sf_dir):
    found = rollup.movement_to_night(read(spark, sf_dir, "lineitem"), ["l_orderkey"], FEATURES)
    return found.withColumns({c: F.round(F.col(c) + 1.7e-9, 7) if c.endswith(("skew", "kurt")) else F.round(F.col(c) + 1.7e-7, 5) for c, t in found.dtypes if t == "double"})


NIGHTS = "n AS (SELECT o_custkey, o_orderkey, round(o_totalprice / 500000, 9) AS prob, CAST(o_totalprice / 500000 >= 0.5 AS INTEGER) AS pred, CAST(o_custkey % 3 = 0 AS INTEGER) AS truth FROM orders)"


def nights_of(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    p = F.col("o_totalprice") / 500000
    return o.select("o_custkey", "o_orderkey", F.round(p, 9).alias("prob"), (p >= 0.5).cast("int").alias("pred"), (F.col("o_custkey") % 3 == 0).cast("int").alias("truth"))


@query(f"WITH {NIGHTS} SELECT o_custkey, round(avg(prob) + 1.7e-9, 7) AS mean_prob_per_night, round(sum(prob), 9) AS sum_nights_prob, max(prob) AS max_prob_per_night, round(avg(pred) + 1.7e-9, 7) AS mean_pred_per_night, CAST(sum(pred) AS BIGINT) AS sum_nights_pred, max(truth) AS ground_truth, count(*) AS n_total_nights FROM n GROUP BY 1")
def rollup_night_to_patient(spark, sf_dir):
    found = rollup.night_to_patient(nights_of(spark, sf_dir), "o_custkey", "prob", "pred", "truth")
    means = {c: F.round(F.col(c) + 1.7e-9, 7) for c in ("mean_prob_per_night", "mean_pred_per_night")}  # off the ties of exact fractions
    return found.withColumns({**means, "sum_nights_prob": F.round("sum_nights_prob", 9)})


@query(f"""WITH {NIGHTS}, p AS (SELECT o_custkey, avg(prob) AS m, sum(pred) AS s, count(*) AS k FROM n GROUP BY 1), v AS (SELECT o_custkey, CAST(m > 0.3 AS INTEGER) AS a, CAST(s >= k / 2.0 AS INTEGER) AS b FROM p)
  SELECT o_custkey, a AS pred_mean, b AS pred_majority, greatest(a, b) AS pred_any, least(a, b) AS pred_all FROM v""")
def patient_votes(spark, sf_dir):
    patients = rollup.night_to_patient(nights_of(spark, sf_dir), "o_custkey", "prob", "pred", "truth")
    return rollup.patient_votes(patients, 0.3).select("o_custkey", "pred_mean", "pred_majority", "pred_any", "pred_all")


@query("""WITH l AS (SELECT l_orderkey AS o_orderkey, avg(l_quantity) AS mean_qty, max(l_returnflag) AS o_orderstatus FROM lineitem GROUP BY 1)
  SELECT o.o_orderkey, coalesce(CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderstatus END, l.o_orderstatus) AS o_orderstatus, round(mean_qty, 6) AS mean_qty FROM orders o LEFT JOIN l ON o.o_orderkey = l.o_orderkey""")
def merge_global_local(spark, sf_dir):
    left = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("o_orderstatus"))
    local = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("mean_qty"), F.max("l_returnflag").alias("o_orderstatus"))
    return rounded(rollup.merge_levels(left, local, ["o_orderkey", "record_id"]))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS night FROM orders")
def night_numbers(spark, sf_dir):
    return rollup.number_nights(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS night_list FROM orders GROUP BY 1")
def concat_group(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("night_list"))


@query("""WITH p AS (SELECT l_linestatus || l_returnflag AS feature, l_linenumber % 3 AS fold FROM lineitem)
  SELECT feature, count(*) FILTER (fold = 0) AS fold_0, count(*) FILTER (fold = 1) AS fold_1, count(*) FILTER (fold = 2) AS fold_2, count(*) AS total FROM p GROUP BY 1""")
def pivot_feature_counts(spark, sf_dir):
    picks = read(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("feature"), (F.col("l_linenumber") % 3).alias("fold"))
    return rollup.selection_frequency(picks, "feature", "fold", [0, 1, 2])


@query("SELECT l_orderkey AS k, l_quantity AS a, NULL::DOUBLE AS b FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def union_features(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("a"))
    return a.unionByName(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("b")), allowMissingColumns=True)


@query("SELECT coalesce(c_custkey, o_custkey) AS custkey, c_name, n FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey")
def outer_align(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, sf_dir, "customer")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full").select(F.coalesce("c_custkey", "o_custkey").alias("custkey"), "c_name", "n")


@query("SELECT p_brand AS o_dataset, round(avg(p_retailprice), 6) AS mean_price, min(p_name) AS first_name FROM part GROUP BY 1")
def patient_feature_means(spark, sf_dir):
    return rounded(read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("o_dataset")).agg(F.avg("p_retailprice").alias("mean_price"), F.min("p_name").alias("first_name")))


# --- cleaning

DIRTY = "d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 13 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS v, CASE WHEN o_orderkey % 5 = 0 THEN ' N/A ' WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderstatus END AS s FROM orders)"


def dirty(spark, sf_dir):
    k = F.col("o_orderkey")
    v = F.when(k % 7 == 0, None).when(k % 11 == 0, float("inf")).when(k % 13 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"), F.when(k % 5 == 0, " N/A ").when(k % 17 == 0, "").otherwise(F.col("o_orderstatus")).alias("s"))


@query(f"WITH {DIRTY} SELECT o_orderkey, v, s FROM d WHERE v IS NOT NULL AND isfinite(v) AND lower(trim(s)) NOT IN ('', 'n/a')")
def problem_values(spark, sf_dir):
    return validate.drop_problems(dirty(spark, sf_dir))


@query(f"WITH {DIRTY} SELECT o_orderkey, CASE WHEN v IS NULL OR NOT isfinite(v) THEN 0 ELSE v END AS v, CASE WHEN lower(trim(s)) IN ('', 'n/a') THEN 'unknown' ELSE s END AS s FROM d")
def replace_problem_values(spark, sf_dir):
    return validate.replace_problems(dirty(spark, sf_dir), excluded=["o_orderkey"])


@query(f"WITH {DIRTY} SELECT 0::BIGINT AS o_orderkey, count(*) FILTER (v IS NULL OR NOT isfinite(v)) AS v, count(*) FILTER (lower(trim(s)) IN ('', 'n/a')) AS s FROM d")
def count_problem_values(spark, sf_dir):
    return validate.count_problems(dirty(spark, sf_dir))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '1' WHEN c_custkey % 5 = 1 THEN '?' ELSE '0' END AS exclude FROM customer")
def meta_exclusion(spark, sf_dir):
    k = F.col("c_custkey") % 5
    mark = F.when(k == 0, F.when(F.col("c_custkey") % 2 == 0, " Yes").otherwise("1.0")).when(k == 1, "?").when(k == 2, "").when(k == 3, "no")
    return read(spark, sf_dir, "customer").select("c_custkey", validate.exclusion(mark).alias("exclude"))


@query("SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'rec' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS record_id FROM orders")
def meta_record_ids(spark, sf_dir):
    blank = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.lit("  ").alias("record_id"))
    return validate.name_records(blank, "o_custkey", ["o_orderdate", "o_orderkey"], "record_id").select("o_orderkey", "record_id")


@query("""WITH t AS (SELECT r_name AS name, CAST(count(*) AS BIGINT) AS a, CAST(sum(n_nationkey) AS BIGINT) AS b FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
  SELECT name, a, b, false AS summary FROM t UNION ALL SELECT 'all of them', CAST(sum(a) AS BIGINT), CAST(sum(b) AS BIGINT), true FROM t UNION ALL SELECT 'Total', 1, 1, true""")
def meta_summary_rows(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    t = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("name")).agg(F.count("*").alias("a"), F.sum("n_nationkey").alias("b"))
    whole = t.unionByName(t.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("name", F.lit("all of them")))
    marked = validate.is_summary_row(whole, ["name"], ["a", "b"])
    named = validate.is_summary_row(spark.sql("SELECT 'Total' AS name, 1L AS a, 1L AS b"), ["name"], ["a", "b"])
    return marked.unionByName(named)


@query("""WITH c AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0), o AS (SELECT DISTINCT o_custkey AS k FROM orders)
  SELECT k, 'missing' AS state FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'extra' FROM o WHERE k NOT IN (SELECT k FROM c)""")
def files_missing_extra(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"))
    return validate.missing_and_extra(c, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 8)")
def min_nights_filter(spark, sf_dir):
    return validate.at_least(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 8)


@query("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return validate.duplicate_keys(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) || '_' || c_mktsegment END AS record_key FROM customer")
def key_building(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    record = F.when(F.col("c_custkey") % 6 == 0, "None").when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))
    return c.select("c_custkey", record_key(F.col("c_custkey"), record).alias("record_key"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events")
def json_roundtrip(spark, sf_dir):
    parsed = F.from_json("props", "k long")
    return read(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("json"))


@query("SELECT page_id, url_decode(replace(url, '/', '%2F')) AS url FROM pages")
def url_decode(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.url_decode(F.replace("url", F.lit("/"), F.lit("%2F"))).alias("url"))


@query("SELECT o_orderkey, CASE WHEN isfinite(v) THEN v END AS v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 13 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS v FROM orders)")
def finite_values(spark, sf_dir):
    k = F.col("o_orderkey")
    v = F.when(k % 11 == 0, float("inf")).when(k % 13 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", finite(v).alias("v"))


# --- ranks, correlations, tests

SCORED = "s AS (SELECT d.doc_id AS id, round(1 / (1 + exp(-(d.n_chars - 1500) / 1500.0)), 4) AS score, l.quality AS y, d.source AS dataset, d.n_chars AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def scored(spark, sf_dir):
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), read(spark, sf_dir, "labels")
    score = 1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1500.0))
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.round(score, 4).alias("score"), F.col("quality").alias("y"), F.col("source").alias("dataset"), F.col("n_chars").alias("n"))


@query("SELECT doc_id, n_chars, rank FROM (SELECT doc_id, n_chars, count(*) OVER (ORDER BY n_chars DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank FROM documents) WHERE rank <= 50")
def top_k_rank(spark, sf_dir):
    return ranks.top_k(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 50)


@query("SELECT doc_id, count(*) OVER (ORDER BY n_chars RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank FROM documents")
def rank_max(spark, sf_dir):
    return ranks.with_rank(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars").drop("n_chars")


@query("SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rank FROM documents")
def rank_average(spark, sf_dir):
    return ranks.with_rank(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "mean", ["lang"]).select("doc_id", "rank")


@query("""WITH p AS (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) + count(*) OVER (PARTITION BY p_size) - 1 AS a, CASE WHEN p_partkey % 4 > 0 THEN rank() OVER (ORDER BY p_retailprice DESC) + count(*) OVER (PARTITION BY p_retailprice) - 1 END AS b FROM part),
  s AS (SELECT p_partkey, round((coalesce(a, 0) + coalesce(b, 0) * 0.2) / (1 + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END), 9) AS score FROM p)
  SELECT p_partkey, round(score, 6) AS score, count(*) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank FROM s""")
def ensemble_rank(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    both = ranks.with_rank(ranks.with_rank(p, "p_size", name="a"), "p_retailprice", name="b", descending=True)
    methods = both.select("p_partkey", F.col("a").cast("double").alias("a"), F.when(F.col("p_partkey") % 4 > 0, F.col("b").cast("double")).alias("b"))
    return rounded(prepare.ensemble_rank(methods, "p_partkey", {"a": 1.0, "b": 0.2}))


@query("WITH q AS (SELECT p_brand AS name, avg(p_size) AS m FROM part GROUP BY 1) SELECT name, round(m, 6) AS score, CAST(row_number() OVER (ORDER BY round(m, 9), name) AS INTEGER) AS rank FROM q")
def fair_rank(spark, sf_dir):
    return rounded(prepare.fair_rank(read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), "p_size"), "name", "p_size"))


@query("""WITH v AS (SELECT 'p_retailprice' AS feature, round(var_pop(p_retailprice) / (max(p_retailprice) - min(p_retailprice)) ** 2, 9) AS variance FROM part UNION ALL SELECT 'p_size', round(var_pop(p_size) / (max(p_size) - min(p_size)) ** 2, 9) FROM part)
  SELECT feature, round(variance, 6) AS variance, count(*) OVER (ORDER BY variance DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank FROM v""")
def variance_rank(spark, sf_dir):
    return rounded(prepare.variance_rank(read(spark, sf_dir, "part"), ["p_retailprice", "p_size"]))


@query(f"""WITH {SCORED}, k AS (SELECT *, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM s)
  SELECT 'n' AS feature, round(corr(n, y), 6) AS pearson, round(corr(rn, ry), 6) AS spearman FROM k""")
def corr_label(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(stats.pearson(s, ["n"], "y").withColumnRenamed("r", "pearson").join(stats.spearman(s, ["n"], "y").withColumnRenamed("r", "spearman"), "feature"))


@query(f"""WITH {SCORED}, p AS (SELECT sum(CASE WHEN (a.n > b.n) THEN 1 WHEN a.n < b.n THEN -1 ELSE 0 END) AS c FROM s a JOIN s b ON a.y = 1 AND b.y = 0), t AS (SELECT sum(k * (k - 1) / 2.0) AS ties FROM (SELECT count(*) AS k FROM s GROUP BY n)), z AS (SELECT count(*) AS m, sum(y) AS p FROM s)
  SELECT 'n' AS feature, round(c / sqrt((m * (m - 1) / 2.0 - ties) * (p * (m - p))), 6) AS tau FROM p, t, z""")
def kendall_label(spark, sf_dir):
    return rounded(stats.kendall_binary(scored(spark, sf_dir), "n", "y"))


@query(f"""WITH {SCORED}, g AS (SELECT count(n) FILTER (y = 1) AS n1, avg(n) FILTER (y = 1) AS m1, var_samp(n) FILTER (y = 1) AS v1, count(n) FILTER (y = 0) AS n0, avg(n) FILTER (y = 0) AS m0, var_samp(n) FILTER (y = 0) AS v0 FROM s)
  SELECT round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 4) AS dof, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS effect FROM g""")
def welch_t(spark, sf_dir):
    return rounded(stats.welch_t(scored(spark, sf_dir), "n", "y").select("t", F.round("dof", 4).alias("dof"), "effect"))


@query(f"""WITH {SCORED}, k AS (SELECT *, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS r FROM s), t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM s GROUP BY n)),
  a AS (SELECT sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0 AS u, sum(y) AS n1, count(*) AS m FROM k), b AS (SELECT *, n1 * (m - n1) / 2.0 AS mu, n1 * (m - n1) / 12.0 * (m + 1 - ties / (m * (m - 1.0))) AS v FROM a, t)
  SELECT round(CAST(u AS DOUBLE), 6) AS u, round(sign(u - mu) * greatest(abs(u - mu) - 0.5, 0) / sqrt(v), 6) AS z FROM b""")
def mann_whitney_u(spark, sf_dir):
    return rounded(stats.mann_whitney(scored(spark, sf_dir), "n", "y").select("u", "z"))


@query("SELECT p_partkey, round(exp(ln(a) + ln(b)) * (1 - ln(a) - ln(b)), 6) AS p FROM (SELECT p_partkey, (p_size + 1) / 60.0 AS a, (p_partkey % 50 + 1) / 60.0 AS b FROM part)")
def combine_p(spark, sf_dir):
    return rounded(read(spark, sf_dir, "part").select("p_partkey", stats.fisher_combined([(F.col("p_size") + 1) / 60.0, (F.col("p_partkey") % 50 + 1) / 60.0]).alias("p")))


@query(f"WITH {SCORED}, c AS (SELECT corr(n, y) AS r, count(*) AS k FROM s) SELECT round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(k - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(k - 3)), 6) AS high FROM c")
def correlation_interval(spark, sf_dir):
    c = scored(spark, sf_dir).agg(F.corr(F.col("n").cast("double"), F.col("y").cast("double")).alias("r"), F.count("*").alias("k"))
    low, high = stats.correlation_interval(F.col("r"), F.col("k"))
    return rounded(c.select("r", low.alias("low"), high.alias("high")))


# --- curves and metrics

CURVE = f"{SCORED}, c AS (SELECT score, sum(y) AS ones, count(*) AS n FROM s GROUP BY 1), k AS (SELECT score, ones, n, sum(ones) OVER w AS tp, sum(n - ones) OVER w AS fp, sum(ones) OVER () AS p, sum(n - ones) OVER () AS q FROM c WINDOW w AS (ORDER BY score DESC))"


@query(f"WITH {CURVE} SELECT score AS threshold, round(tp / p, 6) AS tpr, round(fp / q, 6) AS fpr FROM k")
def roc_curve(spark, sf_dir):
    return rounded(curves.roc_curve(scored(spark, sf_dir)))


@query(f"WITH {CURVE} SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM k")
def pr_curve(spark, sf_dir):
    return rounded(curves.pr_curve(scored(spark, sf_dir)))


@query(f"WITH {CURVE}, l AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS tp0, lag(fp, 1, 0) OVER (ORDER BY score DESC) AS fp0 FROM k) SELECT round(sum((fp - fp0) * (tp + tp0) / 2.0) / (max(p) * max(q)), 6) AS roc_auc, round(sum((tp - tp0) * tp / (tp + fp)) / max(p), 6) AS average_precision FROM l")
def auc(spark, sf_dir):
    return rounded(curves.auc(scored(spark, sf_dir)))


@query(f"WITH {CURVE}, d AS (SELECT score, round(sqrt((fp / q) ** 2 + (1 - tp / p) ** 2), 12) AS d FROM k) SELECT score AS threshold, round(d, 6) AS value FROM d ORDER BY d, score DESC LIMIT 1")
def operating_point(spark, sf_dir):
    return rounded(curves.operating_point(scored(spark, sf_dir)))


@query(f"WITH {CURVE}, d AS (SELECT score, round(2 * tp / (tp + fp + p), 12) AS f FROM k) SELECT score AS threshold, round(f, 6) AS value FROM d ORDER BY f DESC, score DESC LIMIT 1")
def best_f1_threshold(spark, sf_dir):
    return rounded(curves.operating_point(scored(spark, sf_dir), "f1"))


@query(f"""WITH {SCORED}, g AS (SELECT unnest(range(401)) AS k), b AS (SELECT dataset, k, avg(CASE WHEN y = 1 THEN CASE WHEN round(score * 400, 9) >= k THEN 1.0 ELSE 0 END END) AS tpr, avg(CASE WHEN y = 0 THEN CASE WHEN round(score * 400, 9) < k THEN 1.0 ELSE 0 END END) AS tnr FROM s, g GROUP BY 1, 2),
  m AS (SELECT k, round(avg((tpr + tnr) / 2), 9) AS ba FROM b WHERE tpr IS NOT NULL AND tnr IS NOT NULL GROUP BY 1) SELECT k / 400.0 AS threshold, round(ba, 6) AS balanced_accuracy FROM m ORDER BY ba DESC, k LIMIT 1""")
def macro_ba_threshold(spark, sf_dir):
    return rounded(curves.macro_threshold(scored(spark, sf_dir), "dataset"))


PRED = f"{SCORED}, p AS (SELECT *, CAST(score >= 0.45 AS INTEGER) AS pred FROM s)"


def predicted(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.45).cast("int"))


@query(f"WITH {PRED}, c AS (SELECT dataset, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 1) AS fn, count(*) FILTER (pred = 0 AND y = 0) AS tn FROM p GROUP BY 1) SELECT dataset, tp, fp, fn, tn FROM c")
def confusion(spark, sf_dir):
    return curves.metrics(predicted(spark, sf_dir), keys=["dataset"]).select("dataset", "tp", "fp", "fn", "tn")


@query(f"""WITH {PRED}, c AS (SELECT count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 1) AS fn, count(*) FILTER (pred = 0 AND y = 0) AS tn FROM p)
  SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def metrics_binary(spark, sf_dir):
    return rounded(curves.metrics(predicted(spark, sf_dir)).drop("tp", "fp", "fn", "tn"))


@query(f"WITH {SCORED} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS rate FROM s GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return rounded(curves.calibration_bins(scored(spark, sf_dir)))


@query(f"WITH {SCORED}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, abs(avg(score) - avg(y)) AS d FROM s GROUP BY 1) SELECT (SELECT round(avg((score - y) ** 2), 6) FROM s) AS brier, round(sum(n * d) / sum(n), 6) AS ece FROM b")
def brier(spark, sf_dir):
    return rounded(curves.calibration_error(scored(spark, sf_dir)))


@query(f"WITH {PRED} SELECT dataset, count(*) AS n_wrong FROM p WHERE pred <> y GROUP BY 1")
def misclassified(spark, sf_dir):
    return predicted(spark, sf_dir).filter("pred <> y").groupBy("dataset").agg(F.count("*").alias("n_wrong"))


# --- weights, scaling, folds


@query(f"WITH {SCORED}, c AS (SELECT dataset, y, count(*) AS n FROM s GROUP BY 1, 2) SELECT dataset, y, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def dataset_weights(spark, sf_dir):
    return rounded(prepare.dataset_weights(scored(spark, sf_dir), "dataset", "y"))


@query(f"WITH {SCORED}, c AS (SELECT y, count(*) AS n FROM s GROUP BY 1) SELECT y, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return rounded(prepare.class_weights(scored(spark, sf_dir), "y"))


def parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))


@query("SELECT p_partkey, p_brand, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size FROM part")
def scale_standard(spark, sf_dir):
    p = parts(spark, sf_dir)
    return rounded(prepare.scale(p, prepare.fit_scaler(p, ["p_retailprice", "p_size"]), ["p_retailprice", "p_size"]))


@query("SELECT p_partkey, p_brand, round((p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w), 6) AS p_retailprice, p_size::DOUBLE AS p_size FROM part WINDOW w AS (PARTITION BY p_brand)")
def scale_minmax(spark, sf_dir):
    p = parts(spark, sf_dir)
    return rounded(prepare.scale(p, prepare.fit_scaler(p, ["p_retailprice"], "minmax", ["p_brand"]), ["p_retailprice"], ["p_brand"]))


@query("WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT p_partkey, p_brand, round((p_retailprice - b) / (c - a), 6) AS p_retailprice, p_size::DOUBLE AS p_size FROM part, q")
def scale_robust(spark, sf_dir):
    p = parts(spark, sf_dir)
    return rounded(prepare.scale(p, prepare.fit_scaler(p, ["p_retailprice"], "robust"), ["p_retailprice"]))


@query("""WITH g AS (SELECT p_brand, avg(p_size) AS m, stddev_pop(p_size) AS s FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#3' GROUP BY 1), a AS (SELECT avg(m) AS m, avg(CASE WHEN s = 0 THEN 1 ELSE s END) AS s FROM g)
  SELECT p_partkey, p_brand, p_retailprice, round((p_size - coalesce(g.m, a.m)) / coalesce(CASE WHEN g.s = 0 THEN 1 ELSE g.s END, a.s), 6) AS p_size FROM part LEFT JOIN g USING (p_brand), a""")
def scale_per_dataset_macro(spark, sf_dir):
    p = parts(spark, sf_dir)
    fitted = prepare.fit_scaler(p.filter("p_partkey % 2 = 0 AND p_brand < 'Brand#3'"), ["p_size"], "standard", ["p_brand"])
    return rounded(prepare.scale(p, fitted, ["p_size"], ["p_brand"], prepare.macro_scaler(fitted, ["p_size"])).select("p_partkey", "p_brand", "p_retailprice", "p_size"))


@query(f"""WITH {SCORED}, z AS (SELECT dataset, count(*) AS size FROM s GROUP BY 1), c AS (SELECT dataset, y, count(*) AS n FROM s GROUP BY 1, 2), m AS (SELECT quantile_cont(size, 0.5) AS lim FROM z)
  SELECT dataset, y, n, CAST(greatest(round(n * least(1.0, floor(lim) / size)), 1) AS BIGINT) AS target FROM c JOIN z USING (dataset), m""")
def rebalance_counts(spark, sf_dir):
    return prepare.rebalance_targets(scored(spark, sf_dir), "dataset", "y", "median")


@query(f"""WITH {SCORED}, z AS (SELECT dataset, count(*) AS size FROM s GROUP BY 1), c AS (SELECT dataset, y, count(*) AS n FROM s GROUP BY 1, 2), m AS (SELECT min(size) AS lim FROM z)
  SELECT dataset, y, least(n, CAST(greatest(round(n * least(1.0, floor(lim) / size)), 1) AS BIGINT)) AS kept FROM c JOIN z USING (dataset), m""")
def rebalance_rows(spark, sf_dir):
    return prepare.rebalance(scored(spark, sf_dir), "dataset", "y", "id", "min").groupBy("dataset", "y").agg(F.count("*").alias("kept"))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS fold FROM orders")
def leave_one_dataset_out(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return prepare.leave_one_out(o, "o_orderpriority").select("o_orderkey", F.col("fold").cast("long").alias("fold"))
