"""Registered queries on the few-call surface, the command line, streams that end in append mode, and small operators."""

import contextlib
import io
import json
import tempfile

from pyspark.sql import functions as F

from driftloom import api, config
from driftloom.__main__ import main
from driftloom.functions.numeric import from_micros
from driftloom.functions.storage import TASK_ROWS, gathered, materialise, scratch_path
from driftloom.learning import loader, models, prepare
from driftloom.operators import diary, rollup
from driftloom.operators import features as ft
from driftloom.plans import process as plan
from driftloom.queries_learning import FEATURES, _each, vectors
from driftloom.queries_signal import BEGIN, HOSTS, V, hosts, planted
from driftloom.queries_tables import read, rounded
from driftloom.queries_time import ISLANDS, KEY, REC, flagged, recordings
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


# --- streams in append mode


def _arriving(spark, sf_dir):
    """The samples as files that arrive one after the other: the first twenty days, the others, and a last one with the
    fifth day's samples again, long after their time, and a far sample of another recording, which ends the stream's time."""
    r = flagged(spark, sf_dir).select(F.col("recording_id").cast("long").alias("recording_id"), F.col("time").cast("timestamp").alias("time"), "value", "flag")
    r = materialise(r, "samples")
    first, rows = r.agg(F.min("time").alias("t"), F.count("*").alias("n")).first()
    files = max(1, -(-rows // TASK_ROWS))  # of a part, which are one trigger's
    at = lambda days: F.lit(first) + F.expr(f"interval {days} days")
    late = r.filter((F.col("time") >= at(4)) & (F.col("time") < at(5)))
    end = r.limit(1).select(F.lit(-1).cast("long").alias("recording_id"), at(400).alias("time"), "value", "flag")
    path = scratch_path(spark, "arriving")
    for part in (r.filter(F.col("time") < at(20)), r.filter(F.col("time") >= at(20)), late.unionByName(end)):
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return spark.readStream.schema(r.schema).option("maxFilesPerTrigger", files).parquet(path)


def _drain(stream):
    """What the stream gives in append mode, written to files and read back."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-marks")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {REC} SELECT recording_id, date_trunc('day', time) AS start_time, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM r GROUP BY 1, 2")
def stream_append_bins(spark, sf_dir):
    """Bins of a day, each given once its time has passed; samples that come weeks late are left out."""
    got = _drain(streams.bins(_arriving(spark, sf_dir), "1 day", "1 hour"))
    return got.select("recording_id", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"""WITH {REC}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY recording_id ORDER BY us) > 21600000000 THEN 1 ELSE 0 END AS cut FROM r), k AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id ORDER BY us, event_id) AS id FROM g)
  SELECT recording_id, min(time) AS start_time, max(time) AS end_time, count(*) AS n FROM k GROUP BY recording_id, id""")
def stream_append_sessions(spark, sf_dir):
    got = _drain(streams.sessions(_arriving(spark, sf_dir), "6 hours", "1 hour"))
    return got.select("recording_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_time", "end_time")), "n")


@query(f"WITH {ISLANDS} SELECT recording_id, flag, make_timestamp(start_us) AS start_time, make_timestamp(end_us) AS end_time, n FROM s WHERE flag IS NOT NULL")
def stream_islands(spark, sf_dir):
    """Runs of equal flag, each given when the next begins or time has passed it."""
    got = _drain(streams.islands(_arriving(spark, sf_dir), "1 hour"))
    return got.filter("recording_id >= 0").select("recording_id", "flag", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_time", "end_time")), "n")


# --- a folder of recordings, end to end


@query(f"""WITH {HOSTS}, n AS (SELECT count(*) AS n FROM hosts), r AS (SELECT 'files' AS step, 'gone.csv missing, odd.csv extra' AS result UNION ALL SELECT 'first', n || ' recordings' FROM n UNION ALL SELECT 'resumed', n || ' recordings' FROM n UNION ALL SELECT 'nights', 3 * n || ' nights' FROM n
  UNION ALL SELECT 'features', 3 * n || ' rows, 20 night numbers, named bouts' FROM n UNION ALL SELECT 'series', 'series of ' || n FROM n UNION ALL SELECT 'header', 'none of text' UNION ALL SELECT 'deleted', 'processed gone' UNION ALL SELECT 'awake', 4 * n || ' days of ' || n FROM n) SELECT * FROM r""")
def process_folder(spark, sf_dir):
    """The planted recordings as text files in a folder with metadata: the command line processes them, resumes, writes
    night features and series, and cleans up."""
    root = scratch_path(spark, "folder")
    rows = planted(spark, sf_dir).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    gathered(rows.select("recording_id", "time", "x", "y", "z"), "recording_id").write.partitionBy("recording_id").csv(f"{root}/parts", header=True)
    names = sorted(f"r{r['recording_id']}" for r in hosts(spark, sf_dir, 1).select("recording_id").distinct().collect())  # a row for each recording
    for name in names:
        _move_part(spark, f"{root}/parts/recording_id={name[1:]}", f"{root}/raw/{name}.csv")
    spark.createDataFrame([("1",)], "a string").coalesce(1).write.csv(f"{root}/parts/odd", header=True)
    _move_part(spark, f"{root}/parts/odd", f"{root}/raw/odd.csv")
    spark.createDataFrame([(f"{n}.csv", n) for n in [*names, "gone"]], "filename string, ID string").coalesce(1).write.csv(f"{root}/meta", header=True)
    cfg = '{"fs": 0.1, "lowpass_hz": null, "highpass_hz": null, "bin_s": 60, "epoch_s": 60, "smooth_s": 600, "still_sd": 0.001, "move_gap_s": 60.0, "least_bouts": 5}'
    settings = config.from_dict(api.ProcessConfig, json.loads(cfg))
    state = api.process_dataset(spark, f"{root}/raw", f"{root}/meta", f"{root}/out", settings, features=False)
    out = [("files", ", ".join(sorted(f"{r['filename']} {r['state']}" for r in state.collect())))]
    count = lambda: f"{spark.read.parquet(f'{root}/out/processed').select('recording_id').distinct().count()} recordings"
    out.append(("first", count()))
    awake = api.day_features(spark.read.parquet(f"{root}/out/processed"))
    out.append(("awake", f"{awake.count()} days of {awake.select('recording_id').distinct().count()}"))
    api.process_dataset(spark, f"{root}/raw", f"{root}/meta", f"{root}/out", settings, series=True)
    out += [("resumed", count()), ("nights", f"{spark.read.json(f'{root}/out/nights').count()} nights")]
    got = spark.read.csv(f"{root}/out/night_features", header=True, inferSchema=True)
    night = [c for c in ft.global_feature_names() if c in got.columns]
    out.append(("features", f"{got.count()} rows, {len(night)} night numbers, {'named' if any(c.startswith('mean_mag_') for c in got.columns) else 'no'} bouts"))
    out.append(("series", f"series of {spark.read.csv(f'{root}/out/day_series', header=True).select('recording_id').distinct().count()}"))
    out.append(("header", "none of text" if api.load(spark, f"{root}/raw/{names[0]}.csv", header_only=True) == (None, {}) else "some"))
    with contextlib.redirect_stdout(io.StringIO()), tempfile.TemporaryDirectory() as own:  # the driver reads settings
        with open(f"{own}/settings.json", "w") as f:
            f.write(cfg)
        main(["process", f"{root}/raw", f"{root}/meta", f"{root}/gone", "-sf", "-c", f"{own}/settings.json"])
    api._remove(spark, f"{root}/out/processed")
    out.append(("deleted", "processed there" if api._there(spark, f"{root}/out/processed") else "processed gone"))
    return spark.createDataFrame(out, "step string, result string")


def _move_part(spark, folder: str, to: str) -> None:
    fs, path = api._path(spark, folder)
    part = next(x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("part-"))
    fs.mkdirs(api._path(spark, to.rsplit("/", 1)[0])[1])
    fs.rename(part, api._path(spark, to)[1])


@query("SELECT * FROM (VALUES ('train', '40 patients'), ('test', '3 tables'), ('named', '40 patients'), ('unknown', 'refused'), ('validate', '4 rows, 2 kinds, 4 in the manifest'), ('pooled', 'a package')) AS t(step, result)")
def command_line(spark, sf_dir):
    """Training, testing, prediction by a named model, nested validation and pooled training from feature files."""
    root = scratch_path(spark, "learning")
    df = materialise(vectors(spark, sf_dir).select("id", F.col("vec_id").alias("night"), "y", *FEATURES).withColumn("y", (F.col("id") % 2).cast("int")).withColumn("x0", F.col("x0") + F.col("y")), "vectors")
    df.write.csv(f"{root}/all", header=True)
    df.filter("id % 4 < 2").write.csv(f"{root}/a", header=True)
    df.filter("id % 4 >= 2").write.csv(f"{root}/b", header=True)
    size = lambda p: spark.read.csv(p, header=True).count()
    out = []
    main(["train", f"{root}/all", "--out", f"{root}/models/own/model2", "-m", "lr"])
    main(["predict", f"{root}/models/own/model2", f"{root}/all", f"{root}/predicted"])
    out.append(("train", f"{size(f'{root}/predicted')} patients"))
    main(["test", "own", f"{root}/all", f"{root}/tested", "--models", f"{root}/models"])
    out += [("test", f"{sum(api._there(spark, f'{root}/tested/{n}') for n in ('night_scores', 'patients', 'patient_scores'))} tables"), ("named", f"{size(f'{root}/tested/predictions')} patients")]
    try:
        api.load_named(f"{root}/models", "other")
    except ValueError:
        out.append(("unknown", "refused"))
    main(["validate", f"{root}/all", "--out", f"{root}/run", "-m", "lr", "--outer", "2", "--inner", "2", "--calls", "1", "--search", "random"])
    held = spark.read.csv(f"{root}/run/validation", header=True)
    out.append(("validate", f"{held.count()} rows, {held.select('kind').distinct().count()} kinds, {spark.read.json(f'{root}/run/manifest').count()} in the manifest"))
    main(["train", f"{root}/a", f"{root}/b", "--out", f"{root}/pooled", "-m", "lr", "--calibrate", "none", "--threshold", "0.5"])
    out.append(("pooled", "a package" if models.load_package(f"{root}/pooled").threshold == 0.5 else "none"))
    return spark.createDataFrame(out, "step string, result string")


@query(f"WITH {HOSTS} SELECT recording_id, CAST(k AS BIGINT) AS bin_us, CAST(({BEGIN} + k * 3600000000) // 86400000000 AS BIGINT) AS day, true AS worn FROM hosts, (SELECT unnest(range(72)) AS k)")
def day_series_bins(spark, sf_dir):
    """What a plot of days shows: a bin an hour of planted recordings (counted from the first)."""
    df = planted(spark, sf_dir).withColumn("us", F.unix_micros(F.col("time").cast("timestamp"))).withColumns({"wear": F.lit(True), "sptw": F.lit(False)})
    got = api.day_series(df, 3600)
    return got.select("recording_id", ((F.col("bin_us") - BEGIN) / 3_600_000_000).cast("long").alias("bin_us"), "day", (F.col("wear") == 1).alias("worn"))


# --- small operators


@query("""WITH d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 24 AS h, o_custkey % 60 AS m, o_custkey % 12 AS h2 FROM orders),
  p AS (SELECT id, 0 AS pair, epoch_us(CAST(day AS TIMESTAMP)) AS d, (h * 60 + m) * 60000000 AS a, h2 * 3600000000 AS b FROM d UNION ALL SELECT id, 1, epoch_us(CAST(day AS TIMESTAMP)), 4 * 3600000000, 7 * 3600000000 FROM d WHERE id % 3 = 0),
  t AS (SELECT id, pair, d + a + CASE WHEN a < 18000000000 THEN 86400000000 ELSE 0 END AS s, d + b + CASE WHEN b < 18000000000 THEN 86400000000 ELSE 0 END AS e FROM p)
  SELECT id, CAST(pair AS INTEGER) AS pair, CAST(s AS BIGINT) AS start_us, CAST(CASE WHEN e < s THEN e + 86400000000 ELSE e END AS BIGINT) AS end_us FROM t""")
def sleep_diary(spark, sf_dir):
    """Pairs of clock times, written in several ways, as intervals."""
    h, m = F.col("o_orderkey") % 24, F.col("o_custkey") % 60
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit(" "), h.cast("string"), F.when(h % 2 == 0, ":").otherwise("."), F.lpad(m.cast("string"), 2, "0")).alias("a1"),
        (F.col("o_custkey") % 12).cast("string").alias("b1"), F.when(F.col("o_orderkey") % 3 == 0, "04:00:00").when(F.col("o_orderkey") % 3 == 1, "soon").alias("a2"), F.lit("7.00").alias("b2"),
    )
    return diary.diary_intervals(o, ["id"], "day", [("a1", "b1"), ("a2", "b2")])


@query(f"""WITH {V}, d AS (SELECT recording_id, (v - lag(v) OVER (PARTITION BY recording_id ORDER BY k)) * 4 AS d FROM t), g AS (SELECT recording_id, avg(abs(d)) AS a, stddev_pop(abs(d)) AS b, max(abs(d)) AS c, avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END) AS e FROM d WHERE d IS NOT NULL GROUP BY 1)
  SELECT ids.recording_id, round(a, 6) AS step_mean_value, round(b, 6) AS step_std_value, round(c, 6) AS step_max_value, round(e, 6) AS step_up_value FROM ids LEFT JOIN g USING (recording_id)""")
def feat_differential(spark, sf_dir):
    return rounded(ft.kernel_features(recordings(spark, sf_dir), KEY, ["us", "event_id"], ["value"], ["differential"], ft.Setup(fs=4.0)))


@query("SELECT l_returnflag AS name, count(*) FILTER (l_linenumber = 1) AS fold_1, count(*) FILTER (l_linenumber = 2) AS fold_2, count(*) FILTER (l_linenumber = 3) AS fold_3, count(*) FILTER (l_linenumber <= 3) AS total FROM lineitem GROUP BY 1")
def selection_frequency(spark, sf_dir):
    picks = read(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").select(F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("fold"))
    return rollup.selection_frequency(picks, "name", "fold", [1, 2, 3])


@query("SELECT c_custkey % 9 AS id, count(*) AS n, 8::BIGINT AS others FROM customer GROUP BY 1")
def leave_one_patient_out(spark, sf_dir):
    """Each patient is a fold, tested against all others."""
    c = prepare.leave_one_out(read(spark, sf_dir, "customer").select((F.col("c_custkey") % 9).alias("id")), "id")
    seen = c.groupBy("fold").agg(F.count_distinct("id").alias("k")).agg(F.max("k").alias("most"), F.count("*").alias("folds"))
    return c.groupBy("id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(seen)).select("id", "n", (F.col("folds") - F.col("most")).alias("others"))  # one row


@query("SELECT count(*) AS n, count(*) AS n_places, true AS mixed FROM customer")
def shuffled_rows(spark, sf_dir):
    """A reproducible order of rows that has little to do with their keys."""
    c = read(spark, sf_dir, "customer").select("c_custkey", prepare.draw_order("c_custkey", 42).alias("place"))
    return c.agg(F.count("*").alias("n"), F.count_distinct("place").alias("n_places"), (F.abs(F.corr(F.col("c_custkey").cast("double"), F.col("place").cast("double"))) < 0.2).alias("mixed"))


@query("SELECT vec_id, CAST(vec_id % 40 AS BIGINT) AS id FROM embeddings WHERE vec_id % 40 IN (SELECT id FROM (SELECT unnest([1, 2, 3]) AS id))")
def select_samples(spark, sf_dir):
    """Rows of chosen subjects, as a fold chooses them."""
    chosen = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    return vectors(spark, sf_dir).join(chosen, "id", "left_semi").select("vec_id", F.col("id").cast("long").alias("id"))


@query("SELECT 'x' || unnest(range(64)) AS feature, true AS same")
def ranking_cache(spark, sf_dir):
    """A ranking that is kept and read again for the same rows and features."""
    path, df = scratch_path(spark, "ranking"), materialise(vectors(spark, sf_dir), "vectors")
    first, again = loader.cached_ranking(df, FEATURES, path), loader.cached_ranking(df, FEATURES, path)
    kept = F.lit(sorted(first.inputFiles()) == sorted(again.inputFiles()))
    return first.select("feature", F.col("rank").alias("a")).join(again.select("feature", F.col("rank").alias("b")), "feature").select("feature", ((F.col("a") == F.col("b")) & kept).alias("same"))


@query("SELECT lower(c_mktsegment) AS dataset, CASE WHEN c_custkey % 4 < 3 THEN '#' || length(c_mktsegment) END AS color, count(*) AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN c_mktsegment ELSE 'no ' || c_mktsegment END AS c_mktsegment FROM customer) GROUP BY 1, 2")
def dataset_names(spark, sf_dir):
    """Customers' segments as datasets, by their own names and others, with their colours; some that nobody knows."""
    c = read(spark, sf_dir, "customer")
    known = [r[0] for r in c.select("c_mktsegment").distinct().collect()]  # a handful of segments
    d = config.Datasets({s.lower(): f"#{len(s)}" for s in known}, {f"{s} site": s.lower() for s in known} | {s: s.lower() for s in known})
    k, s = F.col("c_custkey") % 4, F.col("c_mktsegment")
    names = c.select(F.when(k == 0, s).when(k == 1, F.concat(F.lower(s), F.lit("_Site"))).when(k == 2, F.concat(s, F.lit(" - site"))).otherwise(F.concat(F.lit("no "), F.lower(s))).alias("name"))
    got = _each(_each(names, lambda n: d.resolve(n)[0], "dataset string"), lambda n, _: d.resolve(n)[1], "color string")
    return got.groupBy("dataset", "color").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, CAST(CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN o_custkey % 5 + 1 END AS INTEGER) AS n FROM orders")
def literal_lists(spark, sf_dir):
    """Lists of times and of numbers as text, and text that is no list: how many things each has."""
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("o_custkey") % 5).cast("int")), lambda i: i.cast("string")), ", ")
    text = F.when(k == 0, F.format_string("['%s', '%s']", day, day)).when(k == 1, F.concat(F.lit("["), numbers, F.lit("]"))).when(k == 2, F.col("o_orderpriority")).otherwise("")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text"))
    return _each(rows, lambda _, t: None if (got := config.literal_list(t)) is None else len(got), "n int").select("k", "n")


@query(f"WITH {HOSTS} SELECT recording_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS night, true AS moves, true AS numbers FROM hosts")
def bout_features(spark, sf_dir):
    """Movement bouts of planted nights, each with its 92 numbers."""
    k = F.col("k")
    r = hosts(spark, sf_dir, 52).filter(k < 3 * 8640)
    hour = k / 360 % 24
    wave = F.when(k % 360 < 4, F.sin(k % 360 * 2.5 + F.col("value"))).otherwise(0.0)
    night = (hour >= 10) & (hour < 18)
    done = r.select("recording_id", (F.lit(BEGIN) + k.cast("long") * 10_000_000).alias("us"), (wave * 0.5).alias("x"), (wave * 0.3 + 0.1).alias("y"), (1 + F.abs(wave) * 0.2).alias("z"), F.lit(True).alias("wear"), night.alias("sptw"), (night & (k % 360 >= 4)).alias("sleep_bout"))
    done = materialise(done.withColumn("time", from_micros(F.col("us"))), "done")
    cfg = plan.ProcessConfig(fs=0.1, move_gap_s=60.0, least_bouts=1)
    bouts = materialise(plan.movements(done, cfg), "bouts")
    local = plan.local_features(done, bouts, cfg, shortest_s=0.0, longest_s=600.0)
    have = [c for c in ft.local_feature_names() if c in local.columns]
    return local.groupBy("recording_id", F.col("night").cast("long").alias("night")).agg((F.count("*") >= 5).alias("moves"), F.lit(len(have) == 92).alias("numbers"))
