"""Registered queries on the time axis and segments, each with its SQL. Recording: events.user_id."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.numeric import from_micros, micros, z_angle
from driftloom.operators import segments as seg
from driftloom.operators import signal as sig
from driftloom.operators import timeaxis as tx

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY, ORDER = ["recording_id"], ["us", "event_id"]
HOUR, DAY = 3_600_000_000, 86_400_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as recordings: x is the value, y and z come from the properties and the id."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("recording_id"), "event_id", F.col("ts").alias("time"), micros(F.col("ts")).alias("us"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("y"), (F.col("event_id") % 7).cast("double").alias("z"), "event_type",
    )


REC = "r AS (SELECT user_id AS recording_id, event_id, ts AS time, epoch_us(ts) AS us, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, CAST(event_id % 7 AS DOUBLE) AS z, event_type FROM events)"
ISLANDS = f"""{REC},
  e AS (SELECT *, value > 30 AS flag, lag(value > 30) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS p FROM r),
  i AS (SELECT *, sum(CASE WHEN flag IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS island FROM e),
  s AS (SELECT recording_id, island, flag, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM i GROUP BY recording_id, island, flag)"""


def flagged(spark, sf_dir):
    return recordings(spark, sf_dir).withColumn("flag", F.col("value") > 30)


def active(spark, sf_dir):
    return seg.segments(flagged(spark, sf_dir), KEY, ORDER, "flag")


@query(f"WITH {ISLANDS} SELECT recording_id, start_us, end_us, end_us - start_us AS length_us, n FROM s WHERE flag")
def segment_islands(spark, sf_dir):
    return active(spark, sf_dir)


@query(f"WITH {ISLANDS} SELECT recording_id, start_us, end_us, end_us - start_us AS length_us, n FROM s WHERE NOT flag")
def segment_islands_false(spark, sf_dir):
    return seg.segments(flagged(spark, sf_dir), KEY, ORDER, "flag", False)


@query(f"""WITH {REC}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY recording_id ORDER BY us) > {6 * HOUR} THEN 1 ELSE 0 END AS cut FROM r),
  k AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS id FROM g)
  SELECT recording_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM k GROUP BY recording_id, id""")
def movement_sessions(spark, sf_dir):
    return seg.sessions(recordings(spark, sf_dir), KEY, 6 * HOUR).select("recording_id", "start_us", "end_us", "n")


MERGED = f"""{ISLANDS}, l AS (SELECT * FROM s WHERE flag AND end_us - start_us >= {HOUR}),
  g AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY recording_id ORDER BY start_us) >= {24 * HOUR} THEN 1 ELSE 0 END AS cut FROM l),
  k AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id ORDER BY start_us) AS id FROM g),
  w AS (SELECT recording_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_parts, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY recording_id, id)"""


def windows_of(spark, sf_dir):
    return seg.merge_close(seg.drop_short(active(spark, sf_dir), HOUR), KEY, 24 * HOUR)


@query(f"WITH {MERGED} SELECT * FROM w")
def merge_close_segments(spark, sf_dir):
    return windows_of(spark, sf_dir)


@query(f"""WITH {REC}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS gap_us FROM r)
  SELECT recording_id, count(*) AS n_steps, round(1 / avg(gap_us / 1e6), 2) AS rate_hz, round(stddev_pop(1 / (gap_us / 1e6)), 2) AS rate_sd, min(gap_us) = max(gap_us) AS uniform
  FROM g WHERE gap_us > 0 AND gap_us <= 86400000000 GROUP BY recording_id""")
def sample_gap_stats(spark, sf_dir):
    return tx.sample_rate(recordings(spark, sf_dir), KEY, ORDER, 86400.0)


@query(f"""WITH {REC}, g AS (SELECT *, lag(us) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS p FROM r)
  SELECT recording_id, event_id, us - p AS gap_us FROM g""")
def sample_gaps(spark, sf_dir):
    return tx.with_gaps(recordings(spark, sf_dir), KEY, ORDER).select("recording_id", "event_id", "gap_us")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, (o_orderkey % 97) + 3.3 AS rate, CASE WHEN o_orderkey % 3 = 0 THEN 100.0 WHEN o_orderkey % 3 = 1 THEN 30.0 END AS header, o_orderkey % 2 = 0 AS uniform, CASE WHEN o_orderkey % 5 = 0 THEN 50.0 END AS wanted FROM orders)
  SELECT o_orderkey, CASE WHEN NOT uniform THEN coalesce(wanted, CASE WHEN abs(floor(rate / 10 + 0.5) * 10 - header) > 0.1 * header THEN header ELSE floor(rate / 10 + 0.5) * 10 END) WHEN wanted <> rate THEN wanted END AS target_hz FROM o""")
def target_sample_rate(spark, sf_dir):
    o, key = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    header = F.when(key % 3 == 0, 100.0).when(key % 3 == 1, 30.0)
    return o.select("o_orderkey", tx.target_rate((key % 97).cast("double") + 3.3, header, key % 2 == 0, F.when(key % 5 == 0, 50.0)).alias("target_hz"))


@query(f"""WITH {REC}, m AS (SELECT recording_id, event_id, date_trunc('hour', time) AS time FROM r)
  SELECT recording_id, event_id, time FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, time) AS n FROM m) WHERE n = 1""")
def drop_duplicate_times(spark, sf_dir):
    hourly = recordings(spark, sf_dir).select("recording_id", "event_id", F.date_trunc("hour", F.col("time").cast("timestamp")).cast("timestamp_ntz").alias("time"))
    return tx.drop_duplicate_times(hourly, KEY, "time")


@query(f"""WITH {REC}, f AS (SELECT *, min(us) OVER (PARTITION BY recording_id) AS a FROM r) SELECT recording_id, event_id, time FROM f WHERE us <= a + {7 * DAY}""")
def truncate_days(spark, sf_dir):
    return tx.truncate_days(recordings(spark, sf_dir), KEY, 7).select("recording_id", "event_id", "time")


@query(f"""WITH {REC}, f AS (SELECT *, min(us) OVER (PARTITION BY recording_id) AS a FROM r), b AS (SELECT *, (us - a) // {DAY} AS bin FROM f)
  SELECT recording_id, CAST(bin AS BIGINT) AS bin, CAST(a + bin * {DAY} AS BIGINT) AS bin_start_us, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_sd FROM b GROUP BY recording_id, bin, a""")
def bin_anchor_stats(spark, sf_dir):
    found = tx.bin_stats(tx.anchored_bins(recordings(spark, sf_dir), KEY, DAY), KEY, ["value"])
    return found.withColumns({c: F.round(c, 6) for c in ("value_mean", "value_sd")})


@query(f"""WITH {REC}, n AS (SELECT *, (row_number() OVER (PARTITION BY recording_id ORDER BY us, event_id) - 1) // 5 AS run FROM r),
  m AS (SELECT recording_id, run, count(*) AS n, avg(value) AS mean FROM n GROUP BY recording_id, run)
  SELECT recording_id, CAST(run AS BIGINT) AS run, n, round(mean, 6) AS mean, round(coalesce(abs(mean - lag(mean) OVER (PARTITION BY recording_id ORDER BY run)), 0), 6) AS change FROM m""")
def count_bins_mean(spark, sf_dir):
    found = tx.count_bins(recordings(spark, sf_dir), KEY, ORDER, 5, "value")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "change")})


@query(f"""WITH {REC} SELECT recording_id, event_id, round(CASE WHEN row_number() OVER w >= 9 THEN quantile_cont(value, 0.5) OVER (w ROWS 8 PRECEDING) END, 6) AS median FROM r
  WINDOW w AS (PARTITION BY recording_id ORDER BY us, event_id)""")
def rolling_median(spark, sf_dir):
    return tx.rolling_median(recordings(spark, sf_dir), KEY, ORDER, "value", 9).select("recording_id", "event_id", F.round("median", 6).alias("median"))


@query(f"""WITH {REC}, k AS (SELECT *, CASE WHEN value > 30 THEN value END AS known FROM r)
  SELECT recording_id, event_id, coalesce(first_value(known IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(known IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING)) AS filled FROM k
  WINDOW w AS (PARTITION BY recording_id ORDER BY us, event_id)""")
def fill_forward_back(spark, sf_dir):
    known = recordings(spark, sf_dir).withColumn("known", F.when(F.col("value") > 30, F.col("value")))
    return tx.fill_both(known, KEY, ORDER, "known").select("recording_id", "event_id", "filled")


GRID = f"""{REC}, a AS (SELECT recording_id, min(us) AS a, max(us) AS b FROM r GROUP BY recording_id),
  g AS (SELECT recording_id, unnest(range(a, b + 1, {6 * HOUR})) AS us FROM a),
  d AS (SELECT recording_id, us, min(value) AS value FROM r GROUP BY recording_id, us),
  b AS (SELECT g.recording_id, g.us, d.us AS t0, d.value AS v0 FROM g ASOF LEFT JOIN d ON g.recording_id = d.recording_id AND g.us >= d.us),
  c AS (SELECT g.recording_id, g.us, d.us AS t1, d.value AS v1 FROM g ASOF LEFT JOIN d ON g.recording_id = d.recording_id AND g.us <= d.us)"""


@query(f"WITH {GRID} SELECT recording_id, us, CASE WHEN t1 IS NULL OR us - t0 <= t1 - us THEN v0 ELSE v1 END AS value FROM b JOIN c USING (recording_id, us)")
def resample_nearest(spark, sf_dir):
    return tx.resample_nearest(recordings(spark, sf_dir), KEY, 6 * HOUR, "value")


@query(f"WITH {GRID} SELECT recording_id, us, round(CASE WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (us - t0) / (t1 - t0) END, 6) AS value FROM b JOIN c USING (recording_id, us)")
def resample_linear(spark, sf_dir):
    return tx.resample_linear(recordings(spark, sf_dir), KEY, 6 * HOUR, "value").withColumn("value", F.round("value", 6))


@query(f"""WITH {REC} SELECT recording_id, CAST((us - {DAY // 2}) // {DAY} AS BIGINT) AS day, count(*) AS n, round(quantile_cont(value, 0.1) * 15, 6) AS threshold FROM r GROUP BY ALL""")
def noon_day_threshold(spark, sf_dir):
    return tx.day_thresholds(recordings(spark, sf_dir), KEY, "value").withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH {REC}, f AS (SELECT *, min(us) OVER (PARTITION BY recording_id) // {DAY} * {DAY} AS a FROM r) SELECT recording_id, CAST((us - a) // {3 * DAY} AS BIGINT) AS chunk, count(*) AS n FROM f GROUP BY ALL""")
def day_chunks(spark, sf_dir):
    return tx.day_chunks(recordings(spark, sf_dir), KEY, 3).groupBy("recording_id", "chunk").agg(F.count("*").alias("n"))


@query(f"""WITH {MERGED} SELECT r.recording_id, r.event_id, count(w.start_us) > 0 AS inside FROM r LEFT JOIN w ON r.recording_id = w.recording_id AND r.us BETWEEN w.start_us AND w.end_us GROUP BY r.recording_id, r.event_id""")
def interval_mask_join(spark, sf_dir):
    return seg.points_in_intervals(recordings(spark, sf_dir), windows_of(spark, sf_dir), KEY).select("recording_id", "event_id", "inside")


@query(f"""WITH {MERGED} SELECT i.recording_id, i.start_us, i.end_us, w.start_us AS window_start FROM s i JOIN w ON i.recording_id = w.recording_id AND w.start_us <= i.start_us AND w.end_us >= i.end_us WHERE i.flag""")
def containment_join(spark, sf_dir):
    outer = windows_of(spark, sf_dir).withColumn("window_start", F.col("start_us"))
    return seg.contained_in(active(spark, sf_dir).select("recording_id", "start_us", "end_us"), outer, KEY, "window_start")


NIGHTS = f"""n AS (SELECT recording_id, d AS night, d * {DAY} + {22 * HOUR} AS a, (d + 1) * {DAY} + {9 * HOUR} AS b FROM (SELECT DISTINCT recording_id, us // {DAY} AS d FROM r))"""


def nights_of(spark, sf_dir):
    days = recordings(spark, sf_dir).select("recording_id", F.floor(F.col("us") / DAY).cast("long").alias("night")).distinct()
    return days.select("recording_id", "night", (F.col("night") * DAY + 22 * HOUR).alias("start_us"), ((F.col("night") + 1) * DAY + 9 * HOUR).alias("end_us"))


@query(f"""WITH {MERGED}, {NIGHTS}, p AS (SELECT n.recording_id, n.night, w.start_us AS window_start, n.b - n.a AS size, least(n.b, w.end_us + 120000000) - greatest(n.a, w.start_us - 120000000) AS overlap_us FROM n JOIN w ON n.recording_id = w.recording_id AND w.end_us + 120000000 > n.a AND w.start_us - 120000000 < n.b),
  bo AS (SELECT *, row_number() OVER (PARTITION BY recording_id, night ORDER BY overlap_us DESC, window_start) AS rn FROM p WHERE overlap_us > 0)
  SELECT recording_id, CAST(night AS BIGINT) AS night, window_start, overlap_us FROM bo WHERE rn = 1 AND overlap_us >= 0.5 * size""")
def best_overlap_join(spark, sf_dir):
    windows = windows_of(spark, sf_dir).withColumn("window_start", F.col("start_us"))
    return seg.best_overlap(nights_of(spark, sf_dir), windows, KEY, "night", "window_start")


OVERLAP = f"""CASE WHEN end_us // {DAY} = start_us // {DAY} THEN (greatest(least(end_us, (start_us // {DAY}) * {DAY} + {9 * HOUR}) - greatest(start_us, (start_us // {DAY} - 1) * {DAY} + {22 * HOUR}), 0) + greatest(least(end_us, (start_us // {DAY} + 1) * {DAY} + {9 * HOUR}) - greatest(start_us, (start_us // {DAY}) * {DAY} + {22 * HOUR}), 0)) / {HOUR}.0
  WHEN end_us // {DAY} - start_us // {DAY} = 1 THEN greatest(least(end_us, (start_us // {DAY} + 1) * {DAY} + {9 * HOUR}) - greatest(start_us, (start_us // {DAY}) * {DAY} + {22 * HOUR}), 0) / {HOUR}.0 ELSE 0 END"""


@query(f"WITH {ISLANDS} SELECT recording_id, start_us, end_us, round(CAST({OVERLAP} AS DOUBLE), 6) AS overlap_h FROM s WHERE flag")
def night_overlap(spark, sf_dir):
    return active(spark, sf_dir).select("recording_id", "start_us", "end_us", F.round(seg.night_overlap_h(F.col("start_us"), F.col("end_us")), 6).alias("overlap_h"))


@query(f"""WITH {ISLANDS}, q AS (SELECT *, CAST({OVERLAP} AS DOUBLE) AS o, (end_us - start_us) / {HOUR}.0 AS l FROM s WHERE flag)
  SELECT recording_id, start_us, end_us, round(o, 6) AS overlap_h, round(CAST(l AS DOUBLE), 6) AS length_h, row_number() OVER (PARTITION BY recording_id ORDER BY start_us) - 1 AS night FROM q WHERE o >= 2 AND l > 4""")
def night_select(spark, sf_dir):
    found = seg.select_nights(active(spark, sf_dir).select("recording_id", "start_us", "end_us"), KEY)
    return found.withColumns({c: F.round(c, 6) for c in ("overlap_h", "length_h")})


ZANGLE = f"""{REC}, m AS (SELECT *, row_number() OVER w AS rn, quantile_cont(value, 0.5) OVER (w ROWS 4 PRECEDING) AS mx, quantile_cont(y, 0.5) OVER (w ROWS 4 PRECEDING) AS my, quantile_cont(z, 0.5) OVER (w ROWS 4 PRECEDING) AS mz FROM r WINDOW w AS (PARTITION BY recording_id ORDER BY us, event_id)),
  a AS (SELECT *, degrees(atan(mz / sqrt(mx * mx + my * my))) AS angle FROM m WHERE rn >= 5),
  c AS (SELECT recording_id, (row_number() OVER (PARTITION BY recording_id ORDER BY us, event_id) - 1) // 5 AS epoch, angle FROM a),
  d AS (SELECT recording_id, epoch, avg(angle) AS angle FROM c GROUP BY recording_id, epoch)"""


@query(f"WITH {ZANGLE} SELECT recording_id, CAST(epoch AS BIGINT) AS epoch, round(coalesce(abs(angle - lag(angle) OVER (PARTITION BY recording_id ORDER BY epoch)), 0), 6) AS change FROM d")
def z_angle_change(spark, sf_dir):
    r = recordings(spark, sf_dir).withColumnRenamed("value", "x")
    return sig.z_angle_change(r, KEY, ORDER, rows=5).select("recording_id", "epoch", F.round("change", 6).alias("change"))


@query(f"""WITH {REC}, f AS (SELECT *, min(us) OVER (PARTITION BY recording_id) AS a FROM r), b AS (SELECT recording_id, a, (us - a) // {DAY} AS bin, stddev_samp(value) AS sd FROM f GROUP BY ALL),
  e AS (SELECT *, coalesce(sd < 25, false) AS still, lag(coalesce(sd < 25, false)) OVER (PARTITION BY recording_id ORDER BY bin) AS p FROM b),
  i AS (SELECT *, sum(CASE WHEN still IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY bin) AS island FROM e),
  s AS (SELECT recording_id, a, min(bin) AS x, max(bin) AS y FROM i WHERE still GROUP BY recording_id, a, island)
  SELECT recording_id, CAST(a + x * {DAY} AS BIGINT) AS start_us, CAST(a + y * {DAY} AS BIGINT) AS end_us FROM s WHERE (y - x) * {DAY} > {DAY // 2}""")
def nonwear_segments(spark, sf_dir):
    return sig.nonwear_segments(recordings(spark, sf_dir), KEY, ["value"], DAY, 25.0, DAY // 2)


@query(f"""WITH {REC}, t AS (SELECT recording_id, greatest(avg(CASE WHEN z <> 3 THEN abs(value) END) + stddev_pop(CASE WHEN z <> 3 THEN abs(value) END), 0.1) AS threshold FROM r GROUP BY recording_id)
  SELECT recording_id, round(threshold, 6) AS threshold FROM t""")
def adaptive_threshold(spark, sf_dir):
    found = sig.movement_thresholds(recordings(spark, sf_dir), KEY, "value", F.col("z") != 3)
    return found.withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH {REC}, t AS (SELECT recording_id, greatest(avg(CASE WHEN z <> 3 THEN abs(value) END) + stddev_pop(CASE WHEN z <> 3 THEN abs(value) END), 0.1) AS threshold FROM r GROUP BY recording_id),
  c AS (SELECT r.recording_id, us, event_id FROM r JOIN t USING (recording_id) WHERE z <> 3 AND abs(value) > threshold),
  g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY recording_id ORDER BY us) > {12 * HOUR} THEN 1 ELSE 0 END AS cut FROM c),
  k AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS id FROM g)
  SELECT recording_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM k GROUP BY recording_id, id""")
def movement_bouts(spark, sf_dir):
    return sig.movement_bouts(recordings(spark, sf_dir), KEY, "value", F.col("z") != 3, 12 * HOUR).select("recording_id", "start_us", "end_us", "n")


SLEEP = f"""{ZANGLE}, ch AS (SELECT recording_id, epoch, coalesce(abs(angle - lag(angle) OVER (PARTITION BY recording_id ORDER BY epoch)), 0) AS change FROM d),
  rm AS (SELECT recording_id, epoch, CASE WHEN row_number() OVER w >= 3 THEN quantile_cont(change, 0.5) OVER (w ROWS 2 PRECEDING) END AS m FROM ch WINDOW w AS (PARTITION BY recording_id ORDER BY epoch)),
  rk AS (SELECT recording_id, epoch - 2 AS p, m, (epoch - 2) // 6 AS day FROM rm WHERE m IS NOT NULL),
  th AS (SELECT recording_id, day, quantile_cont(m, 0.1) * 15 AS threshold FROM rk GROUP BY recording_id, day),
  bl AS (SELECT rk.*, m < threshold AS below, threshold FROM rk JOIN th USING (recording_id, day)),
  ed AS (SELECT *, lag(below) OVER (PARTITION BY recording_id, day ORDER BY p) AS q FROM bl),
  il AS (SELECT *, sum(CASE WHEN below IS DISTINCT FROM q THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, day ORDER BY p) AS island FROM ed),
  wi AS (SELECT recording_id, day, min(p) AS first_epoch, max(p) AS last_epoch FROM il WHERE below GROUP BY recording_id, day, island),
  lo AS (SELECT * FROM wi WHERE last_epoch - first_epoch >= 1),
  gp AS (SELECT *, CASE WHEN first_epoch - lag(last_epoch) OVER (PARTITION BY recording_id, day ORDER BY first_epoch) >= 3 THEN 1 ELSE 0 END AS cut FROM lo),
  gk AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id, day ORDER BY first_epoch) AS id FROM gp),
  sw AS (SELECT recording_id, CAST(day AS BIGINT) AS day, CAST(min(first_epoch) AS BIGINT) AS first_epoch, CAST(max(last_epoch) AS BIGINT) AS last_epoch FROM gk GROUP BY recording_id, day, id)"""


def epochs_of(spark, sf_dir):
    r = recordings(spark, sf_dir).withColumnRenamed("value", "x")
    return sig.z_angle_change(r, KEY, ORDER, rows=5)


def sleep_windows_of(spark, sf_dir):
    return sig.sleep_windows(epochs_of(spark, sf_dir), KEY, smooth=3, day_epochs=6, least=1, gap=3)


@query(f"WITH {SLEEP} SELECT * FROM sw")
def sptw_detect(spark, sf_dir):
    return sleep_windows_of(spark, sf_dir)


@query(f"""WITH {SLEEP}, qu AS (SELECT ch.recording_id, sw.day, sw.first_epoch, sw.last_epoch, ch.epoch, ch.change <= 5 AS quiet FROM ch JOIN sw ON ch.recording_id = sw.recording_id AND ch.epoch >= sw.first_epoch AND ch.epoch < sw.last_epoch),
  e2 AS (SELECT *, lag(quiet) OVER (PARTITION BY recording_id, first_epoch ORDER BY epoch) AS q FROM qu),
  i2 AS (SELECT *, sum(CASE WHEN quiet IS DISTINCT FROM q THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, first_epoch ORDER BY epoch) AS island FROM e2)
  SELECT recording_id, first_epoch AS window_epoch, CAST(min(epoch) AS BIGINT) AS first_epoch, CAST(max(epoch) AS BIGINT) AS last_epoch FROM i2 WHERE quiet GROUP BY recording_id, first_epoch, island HAVING count(*) >= 1""")
def sleep_bouts(spark, sf_dir):
    return sig.sleep_bouts(epochs_of(spark, sf_dir), sleep_windows_of(spark, sf_dir), KEY, quiet=5.0, least=1)


@query(f"""WITH {SLEEP}, qu AS (SELECT ch.recording_id, sw.first_epoch, sw.last_epoch, ch.change <= 5 AS quiet, ch.epoch FROM ch JOIN sw ON ch.recording_id = sw.recording_id AND ch.epoch >= sw.first_epoch AND ch.epoch < sw.last_epoch)
  SELECT recording_id, first_epoch AS window_epoch, count(*) AS n_epochs, count(*) FILTER (quiet) AS n_sleep, round(count(*) FILTER (quiet) / count(*), 6) AS efficiency, coalesce(count(*) FILTER (NOT quiet AND epoch > f AND epoch < l), 0) AS wake_after_onset
  FROM (SELECT *, min(CASE WHEN quiet THEN epoch END) OVER (PARTITION BY recording_id, first_epoch) AS f, max(CASE WHEN quiet THEN epoch END) OVER (PARTITION BY recording_id, first_epoch) AS l FROM qu) GROUP BY recording_id, first_epoch""")
def sptw_stats(spark, sf_dir):
    found = sig.sleep_stats(epochs_of(spark, sf_dir), sleep_windows_of(spark, sf_dir), KEY, quiet=5.0)
    return found.withColumn("efficiency", F.round("efficiency", 6))


@query(f"""WITH {REC}, b AS (SELECT recording_id, us, event_id, z = 3 AS off, y > 20 AS night FROM r), e AS (SELECT *, off AND night AS amb, lag(off AND night) OVER w AS p FROM b WINDOW w AS (PARTITION BY recording_id ORDER BY us, event_id)),
  i AS (SELECT *, sum(CASE WHEN amb IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS island FROM e),
  s AS (SELECT recording_id, min(us) AS start_us, max(us) AS end_us FROM i WHERE amb GROUP BY recording_id, island),
  e2 AS (SELECT *, lag(night) OVER w AS p FROM b WINDOW w AS (PARTITION BY recording_id ORDER BY us, event_id)),
  i2 AS (SELECT *, sum(CASE WHEN night IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS island FROM e2),
  w AS (SELECT recording_id, min(us) AS a, max(us) AS b FROM i2 WHERE night GROUP BY recording_id, island),
  h AS (SELECT recording_id, min(us) AS rec_a, max(us) AS rec_b FROM r GROUP BY recording_id),
  c AS (SELECT s.recording_id, s.start_us, s.end_us, bool_or({{over}}) AS any_over, bool_and({{over}}) AS all_over, rec_a, rec_b FROM s JOIN w ON s.recording_id = w.recording_id AND w.a <= s.start_us AND w.b >= s.end_us JOIN h ON s.recording_id = h.recording_id GROUP BY ALL),
  t AS (SELECT *, (end_us - start_us) / {HOUR}.0 AS l, start_us // {HOUR} % 24 AS sh, end_us // {HOUR} % 24 AS eh FROM c),
  u AS (SELECT *, (sh >= 22 OR sh <= 8) AND (eh >= 22 OR eh <= 8) AS inn FROM t)
  SELECT recording_id, start_us, end_us, CASE WHEN start_us < rec_a + {4 * HOUR} THEN '1' WHEN end_us > rec_b - {4 * HOUR} THEN CASE WHEN any_over AND l > 4 THEN '2a' ELSE '2b' END WHEN inn AND l < 4 THEN '3a' WHEN NOT inn AND (sh < 9 OR eh > 22) THEN '3b' WHEN NOT inn AND (NOT all_over OR l > 4) THEN '3c' WHEN NOT inn AND all_over AND l < 4 THEN '3d' ELSE 'open' END AS rule FROM u""".replace(
        "{over}", f"(w.a < ((w.a - {12 * HOUR}) // {DAY}) * {DAY} + {32 * HOUR} AND w.b > ((w.a - {12 * HOUR}) // {DAY}) * {DAY} + {22 * HOUR})"
    ))
def ambiguity_rules(spark, sf_dir):
    r = recordings(spark, sf_dir).select("recording_id", "us", "event_id", (F.col("z") != 3).alias("wear"), (F.col("y") > 20).alias("sptw"))
    return sig.ambiguity_rules(r, KEY, ORDER).select("recording_id", "start_us", "end_us", "rule")


@query(f"WITH {REC} SELECT recording_id, event_id, round(0.1 + value * 1.02, 6) AS x, round(-0.2 + y * 0.98, 6) AS y, round(0.05 + z * 1.01, 6) AS z FROM r")
def calibrate_affine(spark, sf_dir):
    r = recordings(spark, sf_dir).withColumnRenamed("value", "x")
    fits = r.select("recording_id").distinct().select("recording_id", *(F.array(*map(F.lit, v)).alias(c) for c, v in (("offset", (0.1, -0.2, 0.05)), ("gain", (1.02, 0.98, 1.01)))))
    return sig.apply_calibration(r, fits, KEY).select("recording_id", "event_id", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("SELECT event_id, 2000 + ((event_id * 2654435761) % 4294967296 >> 26) AS year_part, ((event_id * 2654435761) % 4294967296 >> 6) & 63 AS minute_part, (event_id % 50)::INTEGER AS second_part FROM events")
def packed_fields(spark, sf_dir):
    from driftloom.functions.packed import bits

    word = (F.col("event_id") * 2654435761) % 4294967296
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (bits(word, 26, 6) + 2000).alias("year_part"), bits(word, 6, 6).alias("minute_part"), (F.col("event_id") % 50).cast("int").alias("second_part"))


@query("SELECT event_id, make_timestamp(2000 + event_id % 64, 1 + event_id % 12, 1 + event_id % 28, event_id % 24, event_id % 60, (event_id % 60)::DOUBLE) AS time FROM events")
def decode_packed_time(spark, sf_dir):
    from driftloom.functions.packed import packed_time

    e = F.col("event_id")
    word = F.shiftleft(e % 64, 26) + F.shiftleft(1 + e % 12, 22) + F.shiftleft(1 + e % 28, 17) + F.shiftleft(e % 24, 12) + F.shiftleft(e % 60, 6) + e % 60
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", packed_time(word).alias("time"))


@query("SELECT event_id, CASE WHEN event_id % 4096 >= 2048 THEN event_id % 4096 - 4096 ELSE event_id % 4096 END AS value FROM events")
def decode_hex12(spark, sf_dir):
    from driftloom.functions.packed import hex12

    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", hex12(F.lpad(F.hex(F.col("event_id") % 4096), 3, "0"), 1).alias("value"))


@query("SELECT event_id, CAST(255 - xor(xor(event_id % 256, event_id // 256 % 256), 30) AS INTEGER) AS checksum FROM events")
def xor_checksum(spark, sf_dir):
    from driftloom.functions.packed import xor_checksum as checksum

    e = F.col("event_id")
    data = F.unhex(F.concat(F.lit("1E"), F.lpad(F.hex(e % 256), 2, "0"), F.lpad(F.hex(F.floor(e / 256) % 256), 2, "0")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", checksum(data).alias("checksum"))


@query(f"WITH {REC} SELECT recording_id, event_id, round(degrees(atan(z / sqrt(value * value + y * y))), 6) AS angle FROM r")
def z_angle_samples(spark, sf_dir):
    return recordings(spark, sf_dir).select("recording_id", "event_id", F.round(z_angle(F.col("value"), F.col("y"), F.col("z")), 6).alias("angle"))


@query(f"WITH {ISLANDS} SELECT recording_id, make_timestamp(start_us) AS start_time, make_timestamp(end_us) AS end_time FROM s WHERE flag")
def segment_times(spark, sf_dir):
    return active(spark, sf_dir).select("recording_id", from_micros(F.col("start_us")).alias("start_time"), from_micros(F.col("end_us")).alias("end_time"))
