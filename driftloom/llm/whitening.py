"""Embedding whitening: exact centring, MLlib's Gramian matrix, a local eigendecomposition, whitening in mapInPandas."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Scaled entries are held within this bound; a long holds the offset beside it.
LARGEST = 2.0**62


@dataclass(frozen=True)
class WhiteningParams:
    """An entry c becomes floor(scale * c) + offset; components: how many of the largest are kept."""

    scale: int = 1024
    offset: int = 100_000
    components: int = 8


@dataclass(frozen=True)
class Whitening:
    """Count and sums of the fit list, eigenvalues by falling size, unit eigenvectors as columns, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def scaled_vectors(rows: DataFrame, vec_col: str = "embedding", params: WhiteningParams = WhiteningParams()) -> DataFrame:
    """The rows whose vector is not null and holds no null, NaN or infinite entry, with it scaled to longs in _x.

    Scaled entries beyond 2 ** 62 either way are held at that bound, which a long can hold."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * float(params.scale), F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(params.offset))
    return rows.filter(v.isNotNull() & ~F.coalesce(odd, F.lit(False))).withColumn("_x", scaled)


def exact_sums(scaled: DataFrame) -> tuple[int, list[int]]:
    """Rows and per-dimension sums of _x, as whole numbers of any size.

    Each task sends a row for each dimension. Vectors of different lengths are an error."""

    def add(batches):
        n, sums = 0, None
        for batch in batches:
            for some in (batch.column("_x").slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                widths = np.unique(np.diff(some.offsets.to_numpy()))
                if len(widths) > 1 or (sums is not None and len(sums) != widths[0]):
                    raise ValueError("vectors differ in length")
                x = some.flatten().to_numpy().reshape(len(some), widths[0])
                fits = np.abs(x).max(initial=0) < 2**50
                sums = [a + int(b) for a, b in zip(sums or [0] * widths[0], x.sum(axis=0) if fits else x.astype(object).sum(axis=0))]
                n += len(some)
        if n:
            yield pa.RecordBatch.from_pylist([{"dim": k, "total": str(s), "n": n, "width": len(sums)} for k, s in enumerate([*sums, 0])], schema=pa.schema([("dim", pa.int32()), ("total", pa.string()), ("n", pa.int64()), ("width", pa.int32())]))

    found = scaled.select("_x").mapInArrow(add, "dim int, total string, n long, width int").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.min("width").alias("low"), F.max("width").alias("high")).collect()
    if not found:
        return 0, []
    if min(r["low"] for r in found) != max(r["high"] for r in found):
        raise ValueError("vectors differ in length")
    sums = {r["dim"]: int(r["total"]) for r in found}
    return found[0]["n"], [sums[k] for k in range(len(sums) - 1)]  # the row past the last dimension counts vectors of none


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: int64 where that holds every entry, else Python's whole numbers."""
    largest = max(map(abs, sums), default=0)
    if n * int(max(x.max(initial=0), -x.min(initial=0))) + largest < 2**63:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(y: np.ndarray) -> list[int | None]:
    """Each row's sum of squares, exact; None where a long can't hold it."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2**63:
        return (y * y).sum(axis=1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in y]
    return [v if v < 2**63 else None for v in found]


def gramian(rows: DataFrame, col: str) -> np.ndarray:
    """Sum of the outer products of the vectors in an array<double> column, by MLlib's RowMatrix.

    Tasks add up what they have; the driver gets one matrix of width by width."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(col)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fit_whitening(scaled: DataFrame, params: WhiteningParams = WhiteningParams()) -> Whitening:
    """The largest components of the covariance (divisor n) of _x.

    Rows are centred exactly, (n * x - sums) / n, before they meet a rounding, so no offset cancels digits. Components
    whose eigenvalue is zero but for rounding can't be scaled to one and are left out."""
    n, sums = exact_sums(scaled)
    none = Whitening(n, tuple(sums), np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    if not n or not sums:
        return none

    def centre(frames):
        for frame in frames:
            y = centred(np.stack(frame["_x"].to_numpy()), n, none.sums)
            yield pd.DataFrame({"c": list(y.astype(np.float64) / n)})

    covariance = gramian(scaled.select("_x").mapInPandas(centre, "c array<double>"), "c") / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors, trace = values[::-1], vectors[:, ::-1], float(np.trace(covariance))
    k = int((values[: params.components] > len(sums) * np.finfo(np.float64).eps * max(trace, 0.0)).sum())
    return Whitening(n, none.sums, values[:k].copy(), vectors[:, :k].copy(), trace)


def whiten(scaled: DataFrame, fit: Whitening) -> DataFrame:
    """scaled with deviation (long: sum of (n * x - sums) ** 2, null if no long holds it) in place of _x, and whitened,
    an array of one double for each component."""
    own = [c for c in scaled.columns if c not in ("_x", "deviation", "whitened")]
    matrix = fit.vectors / np.sqrt(fit.values)[None]
    sent = scaled.sparkSession.sparkContext.broadcast((fit.n, fit.sums, matrix))  # width by components

    def run(frames):
        n, sums, m = sent.value
        for frame in frames:
            out = frame.drop(columns="_x")
            if len(frame):
                y = centred(np.stack(frame["_x"].to_numpy()), n, sums)
                out["deviation"] = pd.array(squares(y), dtype="Int64")
                out["whitened"] = list((y.astype(np.float64) / n) @ m)
                yield out

    kept = scaled.select(*(F.col(f"`{c}`") for c in own), "_x")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_x"]
    return kept.mapInPandas(run, ", ".join([*fields, "deviation long", "whitened array<double>"]))


def identity_error(whitened: DataFrame, width: int) -> float:
    """The largest absolute entry of the covariance of the column whitened, minus the identity; 0 without components.

    Means are taken first and the rows centred by them before they are multiplied."""
    if not width:
        return 0.0
    w = F.col("whitened")
    row = whitened.agg(F.count("*").alias("n"), *(F.avg(w[k]).alias(f"m{k}") for k in range(width))).first()
    means = F.array(*(F.lit(row[f"m{k}"]) for k in range(width)))
    parts = gramian(whitened.select(F.zip_with(w, means, lambda a, b: a - b).alias("c")), "c")
    return float(np.abs(parts / row["n"] - np.eye(width)).max())


def whiten_embeddings(rows: DataFrame, vec_col: str = "embedding", params: WhiteningParams = WhiteningParams()) -> DataFrame:
    """Each sound row's whitened vector, with n, deviation, explained (each component's share of the trace) and
    identity_error.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out; null and repeated ids are rows like
    others. Without rows, without entries or without any variance there are no components: whitened is empty. Vectors of
    different lengths are an error. Columns of rows with the new names are replaced."""
    new = ("n", "deviation", "whitened", "explained", "identity_error", "_x")
    scaled = scaled_vectors(rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in new or c == vec_col)), vec_col, params)
    fit = fit_whitening(scaled, params)
    done = materialise(whiten(scaled, fit), "whitened")
    error = identity_error(done, len(fit.values))
    shares = F.array(*(F.lit(float(v / fit.trace)) for v in fit.values)).cast("array<double>")
    return done.withColumns({"n": F.lit(fit.n).cast("long"), "explained": shares, "identity_error": F.lit(error)})
