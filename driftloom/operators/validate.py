"""Checks and cleaning of tables: schemas, missing and impossible values, keys, exclusion marks, metadata."""

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("time", "x", "y", "z")
OPTIONAL = ("light", "temperature", "battery", "button", "wear", "sptw", "sleep_bout")


def check_recording(df: DataFrame, keys: Sequence[str] = ("recording_id",), most_missing: float = 0.0) -> DataFrame:
    """df, if its columns are a recording's and rows with missing axes are at most a share; else an error.

    The share is checked as the rows are read (an aggregate in the plan), not by an extra action."""
    names = set(df.columns) - set(keys)
    missing, unknown = set(REQUIRED) - names, names - set(REQUIRED) - set(OPTIONAL)
    if missing or unknown:
        raise ValueError(f"missing columns {sorted(missing)}, unknown columns {sorted(unknown)}")
    if not isinstance(df.schema["time"].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError("time must be a timestamp")
    gap = reduce(or_, (F.col(c).isNull() | F.isnan(c) for c in "xyz"))
    share = df.agg(F.coalesce(F.avg(gap.cast("int")), F.lit(0.0)).alias("_share"))
    checked = df.crossJoin(F.broadcast(share))  # one row
    return checked.filter(F.when(F.col("_share") > most_missing, F.raise_error(F.lit("too many rows with missing axes"))).otherwise(F.lit(True))).drop("_share")


def is_processed(df: DataFrame) -> bool:
    return {"wear", "sptw"} <= set(df.columns)


def missing_processed(df: DataFrame) -> list[str]:
    return [c for c in ("wear", "sptw", "sleep_bout") if c not in df.columns]


def is_problem(df: DataFrame, column: str) -> Column:
    """Null, NaN or infinite in numbers; null, blank, 'n/a', 'null' and the like in strings."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if isinstance(kind, T.StringType):
        return c.isNull() | F.lower(F.trim(c)).isin("", "n/a", "na", "nan", "null", "none")
    return c.isNull()


def drop_problems(df: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Rows without a problem value outside the excluded columns."""
    return df.filter(reduce(and_, (~is_problem(df, c) for c in df.columns if c not in excluded), F.lit(True)))


def replace_problems(df: DataFrame, number: float = 0.0, text: str = "unknown", excluded: Sequence[str] = ()) -> DataFrame:
    kinds = {c: df.schema[c].dataType for c in df.columns if c not in excluded}
    fill = lambda k: F.lit(text) if isinstance(k, T.StringType) else F.lit(number).cast(k) if isinstance(k, T.NumericType) else F.lit(None)
    return df.withColumns({c: F.when(is_problem(df, c), fill(k)).otherwise(F.col(c)) for c, k in kinds.items()})


def count_problems(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count_if(is_problem(df, c)).alias(c) for c in df.columns))


def trim_strings(df: DataFrame) -> DataFrame:
    names = [c.strip() for c in df.columns]
    out = df.toDF(*names)
    return out.withColumns({f.name: F.trim(f.name) for f in out.schema if isinstance(f.dataType, T.StringType)})


def exclusion(mark: Column) -> Column:
    """'1' for marks that exclude, '?' for doubtful ones, else '0'."""
    m = F.lower(F.trim(mark.cast("string")))
    return F.when(m.isin("1", "1.0", "yes", "y", "true", "x"), "1").when(m.isin("?", "maybe", "unsure"), "?").otherwise("0")


def name_records(df: DataFrame, subject: str, order: Sequence[str], record: str) -> DataFrame:
    """record, where blank: null for a subject's only recording, else rec1, rec2, ... in order."""
    w = Window.partitionBy(subject)
    blank = F.col(record).isNull() | (F.trim(record) == "")
    number = F.concat(F.lit("rec"), F.row_number().over(w.orderBy(*order)))
    return df.withColumn(record, F.when(~blank, F.trim(record)).when(F.count("*").over(w) > 1, number))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def is_summary_row(df: DataFrame, text: Sequence[str], numbers: Sequence[str], tokens: Sequence[str] = ("total", "sum", "summary", "mean", "average", "note"), share: float = 0.8) -> DataFrame:
    """df with summary: rows that name a total, whose numbers mostly equal their column's sum or count over the other
    rows, or that have under two filled cells."""
    totals = df.agg(*(F.sum(c).alias(f"_s_{c}") for c in numbers), *(F.count(c).alias(f"_n_{c}") for c in numbers))
    wide = df.crossJoin(F.broadcast(totals))  # one row
    named = reduce(or_, (F.lower(F.trim(c)).rlike(rf"^({'|'.join(tokens)})\b") for c in text), F.lit(False))
    hits = sum(((F.col(c) == F.col(f"_s_{c}") - F.col(c)) | (F.col(c) == F.col(f"_n_{c}") - 1)).cast("int") for c in numbers)
    filled = sum((F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).cast("int") for c in [*text, *numbers])
    flag = F.coalesce(named, F.lit(False)) | (F.coalesce(hits, F.lit(0)) >= share * len(numbers)) | (filled < 2)
    return wide.withColumn("summary", flag).drop(*(f"_{k}_{c}" for c in numbers for k in "sn"))


def missing_and_extra(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys only one side has: state 'missing' or 'extra'."""
    a, b = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("state", F.lit("missing")).unionByName(b.join(a, list(keys), "left_anti").withColumn("state", F.lit("extra")))


def at_least(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of groups of n rows or more."""
    few = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).drop("_n")
    return df.join(few, list(keys), "left_semi")


def select_features(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys and the named columns df has, in the order asked for; an error if it has none."""
    have = [n for n in names if n in df.columns]
    if not have:
        raise ValueError("none of the features is there")
    return df.select(*keys, *have)
