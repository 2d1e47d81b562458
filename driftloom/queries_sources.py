"""Registered queries on sources and sinks: samples packed as recorder files and read back, text, features, metadata."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.functions.storage import scratch_path
from driftloom.learning import loader
from driftloom.operators import validate
from driftloom.sources import recorders, splits, tables, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: 2024-01-01 00:00:00, where the packed recordings begin.
BEGIN = 1_704_067_200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def samples(spark, sf_dir):
    """events as seven long recordings of raw counts: k numbers the samples of each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("recording_id", (F.col("user_id") % 7).cast("string"))
    k = F.row_number().over(Window.partitionBy("recording_id").orderBy("event_id")) - 1
    return e.select("recording_id", k.cast("long").alias("k"), (F.col("event_id") % 1021 - 510).alias("x"), (F.col("user_id") % 511 - 255).alias("y"), F.floor(F.col("value") % 500).cast("long").alias("z"))


S = "s AS (SELECT CAST(user_id % 7 AS VARCHAR) AS recording_id, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) - 1 AS k, event_id % 1021 - 510 AS x, user_id % 511 - 255 AS y, CAST(floor(value % 500) AS BIGINT) AS z, count(*) OVER (PARTITION BY user_id % 7) AS n FROM events)"
AT = f"make_timestamp(CAST({BEGIN}000000 + "


#: A file of one block knows one time only: all its samples have it.
BLOCKS = f"WITH {S} SELECT recording_id, {AT}CASE WHEN n < 240 THEN 119 ELSE k END * 1000000 AS BIGINT)) AS time, x / 256.0::DOUBLE AS x, y / 256.0::DOUBLE AS y, z / 256.0::DOUBLE AS z FROM s WHERE k < n - n % 120"


@query(BLOCKS)
def read_block_files(spark, sf_dir):
    """Samples as block files, 120 a block, and back."""
    g = samples(spark, sf_dir).withColumns({c: F.col(c) / 256 for c in "xyz"})
    return recorders.decode_files(writers.pack_files(g, ".cwa", BEGIN, 1)).select("recording_id", "time", "x", "y", "z")


def files_of(spark, sf_dir, kind: str, hz: int, scale: float = 1.0) -> str:
    """The folder in shared storage with events' recordings as files of a kind."""
    path = scratch_path(spark, "files")
    splits.write_files(writers.pack_files(samples(spark, sf_dir).withColumns({c: F.col(c) / scale if scale != 1 else F.col(c) for c in "xyz"}), kind, BEGIN, hz), path)
    return path


@query(BLOCKS)
def read_block_ranges(spark, sf_dir):
    """Block files read in ranges of four blocks, by as many tasks: times go over the ranges' edges."""
    return splits.read_ranges(spark, files_of(spark, sf_dir, ".cwa", 1, 256), rangeBytes=2048).select("recording_id", "time", "x", "y", "z")


@query(f"WITH {S}, n AS (SELECT recording_id, max(n) AS n FROM s GROUP BY 1) SELECT recording_id, CAST(ceil((1024 + 512 * (n // 120)) / 4096.0) AS BIGINT) AS ranges, CAST(n // 120 AS BIGINT) AS blocks, CAST(n // 120 * 120 AS BIGINT) AS samples, CASE WHEN n >= 120 THEN CAST({BEGIN}000000 + CASE WHEN n < 240 THEN 119 ELSE 0 END * 1000000 AS BIGINT) END AS first_us, CASE WHEN n >= 120 THEN CAST({BEGIN}000000 + (n // 120 * 120 - 1) * 1000000 AS BIGINT) END AS last_us, CASE WHEN n < 120 THEN 'no valid block' END AS problem FROM n")
def block_range_summary(spark, sf_dir):
    """Ranges, blocks, samples and span of each block file, and which files hold none."""
    return splits.read_summary(spark, files_of(spark, sf_dir, ".cwa", 1, 256), rangeBytes=4096).select("recording_id", "ranges", "blocks", "samples", "first_us", "last_us", "problem")


@query(f"WITH {S} SELECT recording_id, '2024-01-01 00:00:00' AS logging_start, 'AX3' AS device_type, 1::BIGINT AS device_id, 100.0::DOUBLE AS rate_hz FROM s GROUP BY 1")
def block_file_headers(spark, sf_dir):
    g = samples(spark, sf_dir).withColumns({c: F.col(c) / 256 for c in "xyz"})
    h = recorders.decode_headers(writers.pack_files(g, ".cwa", BEGIN, 1))
    return h.select("recording_id", *(F.get_json_object("header", f"$.{c}").alias(c) for c in ("logging_start", "device_type")), F.get_json_object("header", "$.device_id").cast("long").alias("device_id"), F.get_json_object("header", "$.rate_hz").cast("double").alias("rate_hz"))


@query(f"WITH {S} SELECT recording_id, {AT}k * 500000 AS BIGINT)) AS time, round((x * 100 - 50) / 25600.0::DOUBLE, 9) AS x, round((y * 100 - 50) / 25600.0::DOUBLE, 9) AS y, round((z * 100 - 50) / 25600.0::DOUBLE, 9) AS z, 7.0::DOUBLE AS light, CAST(k % 3 = 0 AS DOUBLE) AS button, 20.5::DOUBLE AS temperature FROM s")
def read_page_files(spark, sf_dir):
    """Raw counts as page files of hex digits, and back by the header's gains and offsets."""
    got = recorders.decode_files(writers.pack_files(samples(spark, sf_dir), ".bin", BEGIN, 2))
    return got.select("recording_id", "time", *(F.round(c, 9).alias(c) for c in "xyz"), "light", "button", "temperature")


PAGES_AT = f"{AT}k * 500000 AS BIGINT)) AS time, round((x * 100 - 50) / 25600.0::DOUBLE, 9) AS x, round((z * 100 - 50) / 25600.0::DOUBLE, 9) AS z, CAST(k % 3 = 0 AS DOUBLE) AS button, 20.5::DOUBLE AS temperature"


@query(f"WITH {S} SELECT recording_id, {PAGES_AT} FROM s")
def read_page_ranges(spark, sf_dir):
    """Page files in ranges that cut pages anywhere."""
    got = splits.read_ranges(spark, files_of(spark, sf_dir, ".bin", 2), rangeBytes=1536)
    return got.select("recording_id", "time", F.round("x", 9).alias("x"), F.round("z", 9).alias("z"), "button", "temperature")


@query(f"WITH {S} SELECT recording_id, 25600.0::DOUBLE AS x_gain, 50.0::DOUBLE AS x_offset, ceil(count(*) / 30.0) AS pages FROM s GROUP BY 1")
def page_file_headers(spark, sf_dir):
    h = recorders.decode_headers(writers.pack_files(samples(spark, sf_dir), ".bin", BEGIN, 2))
    number = lambda path: F.get_json_object("header", path).cast("double")
    return h.select("recording_id", number("$.calibration_data.x_gain").alias("x_gain"), number("$.calibration_data.x_offset").alias("x_offset"), number("$.memory_status.number_of_pages").alias("pages"))


@query(f"WITH {S} SELECT recording_id, {AT}k * 250000 AS BIGINT)) AS time, x / 256.0::DOUBLE AS x, y / 256.0::DOUBLE AS y, z / 256.0::DOUBLE AS z, CAST((k // 4) % 900 AS DOUBLE) AS light FROM s WHERE k < n - n % 4")
def read_record_files(spark, sf_dir):
    """Raw counts as record files, a record a second with its checksum, and back."""
    got = recorders.decode_files(writers.pack_files(samples(spark, sf_dir), ".gt3x", BEGIN, 4))
    return got.select("recording_id", "time", "x", "y", "z", "light")


@query(f"WITH {S} SELECT recording_id, {AT}k * 250000 AS BIGINT)) AS time, x / 256.0::DOUBLE AS x, y / 256.0::DOUBLE AS y, z / 256.0::DOUBLE AS z, CAST((k // 4) % 900 AS DOUBLE) AS light FROM s WHERE k < n - n % 4")
def read_record_streams(spark, sf_dir):
    """Record files as streams of bounded memory."""
    return splits.read_ranges(spark, files_of(spark, sf_dir, ".gt3x", 4)).select("recording_id", "time", "x", "y", "z", "light")


@query(f"WITH {S} SELECT recording_id, 4.0::DOUBLE AS sample_rate, '2024-01-01 00:00:00' AS start_date, 4.1::DOUBLE AS battery_voltage FROM s GROUP BY 1")
def record_file_headers(spark, sf_dir):
    h = recorders.decode_headers(writers.pack_files(samples(spark, sf_dir), ".gt3x", BEGIN, 4))
    return h.select("recording_id", F.get_json_object("header", "$.sample_rate").cast("double").alias("sample_rate"), F.get_json_object("header", "$.start_date").alias("start_date"), F.get_json_object("header", "$.battery_voltage").cast("double").alias("battery_voltage"))


@query("SELECT m.raw, CASE WHEN m.raw < 2048 THEN m.raw ELSE m.raw - 4096 END AS signed FROM (SELECT DISTINCT event_id % 4096 AS raw FROM events) m")
def record_samples12(spark, sf_dir):
    """The packed 12-bit samples of older record files, decoded from their bytes."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            raw = batch.column("raw").to_numpy()
            both = np.stack([raw >> 4, (raw & 15) << 4 | raw >> 8, raw & 255], axis=1).astype(np.uint8)  # twice the number
            got = [int(recorders.activity12(row.tobytes() * 3)[0, 1]) for row in both]
            yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(got, pa.int64())], ["raw", "signed"])

    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 4096).alias("raw")).distinct().mapInArrow(run, "raw long, signed long")


@query("SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, method FROM (SELECT (raw - 3 * 2 / 500.0::DOUBLE) * 2 / 500.0 AS x, (raw - 5 * 2 / 400.0::DOUBLE) * 2 / 400.0 AS y, (raw + 2 * 2 / 1000.0::DOUBLE) * 2 / 1000.0 AS z, 1::BIGINT AS method FROM (SELECT DISTINCT event_id % 500 AS raw FROM events) UNION ALL SELECT raw / 256.0::DOUBLE, raw / 256.0::DOUBLE, raw / 256.0::DOUBLE, 0 FROM (SELECT DISTINCT event_id % 500 AS raw FROM events))")
def counts_as_g(spark, sf_dir):
    """Counts as g by six points, and by one scale where a file says that it is calibrated."""
    import numpy as np
    import pyarrow as pa

    six = {"isCalibrated": False, "calibrationMethod": 1, **{f"positiveZeroGOffset{c}": v for c, v in zip("XYZ", (250, 200, 500))}, **{f"negativeZeroGOffset{c}": v for c, v in zip("XYZ", (-250, -200, -500))}, **{f"zeroGOffset{c}": v for c, v in zip("XYZ", (3, 5, -2))}}

    def run(batches):
        for batch in batches:
            raw = np.repeat(batch.column("raw").to_numpy()[:, None], 3, axis=1)
            for method, cal in ((1, six), (0, None)):
                g = recorders.counts_to_g(raw, {"acceleration_scale": 256.0, "sample_rate": 30}, cal, 16)
                yield pa.RecordBatch.from_arrays([*(pa.array(g[:, k]) for k in range(3)), pa.array(np.full(len(g), method))], ["x", "y", "z", "method"])

    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 500).alias("raw")).distinct()
    return raw.mapInArrow(run, "x double, y double, z double, method long").select(*(F.round(c, 6).alias(c) for c in "xyz"), "method")


@query("SELECT ts AS time, round(value, 3) AS x, round(value / 2, 3) AS y, CAST(event_id AS DOUBLE) AS z FROM events")
def read_text_recording(spark, sf_dir):
    """A recording as text with other names and marks, whose dialect the head tells."""
    path = scratch_path(spark, "recording")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"), F.round("value", 3).alias("acc_x"), F.round(F.col("value") / 2, 3).alias("acc_y"), F.col("event_id").alias("acc_z"))
    e.write.csv(path, sep=";", header=True)
    return tables.read_csv_recording(spark, path, "r").select("time", "x", "y", "z")


@query("SELECT CAST(user_id % 5 AS BIGINT) AS recording_id, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def write_and_resume(spark, sf_dir):
    """Processed recordings written in two goes: those that are there aren't written again."""
    path = scratch_path(spark, "processed")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 5).alias("recording_id"), "event_id", "value")
    tables.write_processed(e.filter("recording_id < 3"), path)
    tables.write_processed(e, path)
    return spark.read.parquet(path).groupBy(F.col("recording_id").cast("long").alias("recording_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS f, CAST(NULL AS DOUBLE) AS g, 'kept' AS state FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, NULL, 'missing' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT 'x' || c_custkey, NULL, NULL, 'extra' FROM customer WHERE c_custkey % 3 = 2")
def features_round_trip(spark, sf_dir):
    """Features to text and info to JSON and back; the metadata tell which subjects are missing and extra."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    own = c.select(F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit("x"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("id"), F.col("c_acctbal").alias("f"), "c_custkey").filter("c_custkey % 3 <> 1").drop("c_custkey")
    path, info = scratch_path(spark, "features"), scratch_path(spark, "info")
    tables.write_features(own, path)
    kept, state = tables.read_features(spark, path, c.filter("c_custkey % 3 <> 2").select(F.col("c_custkey").cast("string").alias("ID")))
    tables.write_info(kept.select("id", "f", F.lit(float("nan")).alias("g")), info)
    found = spark.read.schema("id string, f double, g double").json(info).withColumn("state", F.lit("kept"))
    none = F.lit(None).cast("double")
    return found.unionByName(state.select("id", none.alias("f"), none.alias("g"), "state"))


@query("SELECT c_custkey::VARCHAR || '.cwa' AS filename, 'p' || c_nationkey AS \"ID\", CASE WHEN c_custkey % 4 = 0 THEN '1' WHEN c_custkey % 4 = 1 THEN '?' ELSE '0' END AS exclude, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) = 1 THEN '' ELSE 'rec' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey::VARCHAR || '.cwa') END AS \"record_ID\" FROM customer")
def read_metadata_table(spark, sf_dir):
    """A metadata table of text, with blanks, marks of many kinds, a total and a note."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    mark = F.element_at(F.array(F.lit("yes"), F.lit(" ? "), F.lit(""), F.lit("0.0")), (F.col("c_custkey") % 4 + 1).cast("int"))
    own = c.select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".cwa ")).alias("filename"), F.concat(F.lit("p"), "c_nationkey").alias("ID"), mark.alias("exclude"))
    path = scratch_path(spark, "metadata")
    own.unionByName(spark.createDataFrame([("total", "25", ""), (None, "a note", None)], "filename string, ID string, exclude string")).write.csv(path, header=True, sep=",")
    return tables.read_metadata(spark, path).select("filename", "ID", "exclude", "record_ID")


@query("SELECT 'good' AS name, 'fine' AS state UNION ALL SELECT 'columns', 'refused' UNION ALL SELECT 'nulls', 'refused' UNION ALL SELECT 'labels', 'refused'")
def checks_raise(spark, sf_dir):
    """Which tables the checks of recordings and labels refuse."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("r").alias("recording_id"), F.col("ts").alias("time"), *(F.col("value").alias(c) for c in "xyz"))
    cases = {
        "good": lambda: validate.check_recording(e), "columns": lambda: validate.check_recording(e.drop("z")), "nulls": lambda: validate.check_recording(e.withColumn("x", F.lit(None).cast("double"))).count(),
        "labels": lambda: loader.check_binary(e.select(F.lit(3).alias("y"))).count(),
    }
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, "fine"))
        except Exception:  # that it is refused is the result
            rows.append((name, "refused"))
    return spark.createDataFrame(rows, "name string, state string")


