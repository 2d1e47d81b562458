"""Intermediate tables in storage that all machines share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, deleted when the session ends. Where that is unset, a local session (tests)
    makes a folder, and a cluster raises: its machines would each write one of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="driftloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return path


#: Spark's setting by which the files of a query's shuffles go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once under spark.checkpoint.dir and read it back: lineage ends there, and lost executors lose nothing. The
    files of its shuffles are deleted at once, not when the driver's memory is swept: a plan of many steps holds one step's."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if where.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() + "/"):
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Rows that one task sorts or groups in memory, about.
TASK_ROWS = 1 << 20


def spread(df: DataFrame, rows: int = 0) -> DataFrame:
    """df in at least as many partitions as the session has cores, or as rows rows need that it is to grow to: a small file is
    one partition, whatever is done to it."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(parts) if df._jdf.rdd().getNumPartitions() < parts else df


def dealt(df: DataFrame, rows: int, *by: str, most: int = TASK_ROWS) -> DataFrame:
    """df dealt by the columns over as many tasks as rows rows need, where that is more than Spark's number of partitions,
    which doesn't grow with a table."""
    parts = -(-rows // most)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def gathered(df: DataFrame, *by: str) -> DataFrame:
    """df with all rows of equal values of the columns in one partition, for steps that read a sorted partition's groups.

    A repartition by the columns themselves is left out where a join below has dealt by them; if that join turns out small and
    is then done without dealing, the groups lie scattered. Nothing else deals by this hash."""
    return df.repartition(F.xxhash64(*by))
