"""Expressions with one stated convention each: degrees of freedom, bias, quantile rule, rounding, null and NaN."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(time: Column) -> Column:
    """Microseconds since the epoch of a time without zone, read as UTC."""
    return F.unix_micros(time.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def quantile(value: Column, share: float) -> Column:
    """Exact quantile, linear between neighbours."""
    return F.percentile(value, F.lit(share))


def iqr(value: Column) -> Column:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return q[1] - q[0]


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness G1; null under three values."""
    n = F.count(value).cast("double")
    return F.when(n >= 3, F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis G2; null under four values."""
    n = F.count(value).cast("double")
    return F.when(n >= 4, ((n + 1) * F.kurtosis(value) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)))


def finite(value: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def norm(*axes: Column) -> Column:
    return F.sqrt(sum((a * a for a in axes[1:]), axes[0] * axes[0]))


def z_angle(x: Column, y: Column, z: Column) -> Column:
    """Angle in degrees of the z axis against the horizontal plane: upright (x and y 0) it is 90 or -90, without any axis
    NaN."""
    flat = F.hypot(x, y)
    return F.degrees(F.atan(F.when(flat == 0, z * F.lit(float("inf"))).otherwise(z / flat)))


def record_key(subject: Column, record: Column) -> Column:
    """subject, or subject_record if the record says anything ('', none, nan and null say nothing)."""
    said = F.trim(record.cast("string"))
    said = F.when(~F.lower(said).isin("", "none", "nan", "null"), said)
    return F.when(said.isNull(), subject.cast("string")).otherwise(F.concat_ws("_", subject.cast("string"), said))
