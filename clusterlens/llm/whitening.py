"""Embedding whitening from the exact characteristic polynomial (operator 11).

Entries become integers, so the scatter matrix - n times the sum of products
less the product of sums - is exact whatever the order in which tasks add up;
a common offset of all entries cancels in it. Its characteristic polynomial is
found modulo primes, each prime a Spark row, and put together by Chinese
remaindering; each component - root and null space, see ``spectrum`` - is a Spark
row again. What passes through the driver is bounded by the dimension: the
scatter matrix, the polynomial and the components, never anything of the rows.

Rows are never grouped by vector: a vector that many rows share is just added
up in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import spectrum
from clusterlens.llm.common import picked
from clusterlens.session import ship_package

#: x = floor(SCALE * entry) + OFFSET
SCALE, OFFSET = 64, 1_000_000
#: Components that are kept at most.
COMPONENTS = 32
#: Integer entries lie within +-2**LIMIT_BITS of the offset.
LIMIT_BITS = 40
#: Rows of which products are added at once: 2**11 products of two 20-bit limbs are exact in a double.
CHUNK = 2048


def integers(vector: Column) -> Column:
    """floor(SCALE * entry) of every entry, without the offset; null where the vector is
    null or holds a null, a non-finite entry or one beyond the limit."""
    bound = float(1 << LIMIT_BITS)
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) < bound, F.lit(False)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def usable(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> tuple[DataFrame, int]:
    """(vec_id, y) of the rows that take part, and their dimension.

    Left out are vectors that are null, empty, hold a null or non-finite entry (or
    one beyond +-2**34 before scaling), or whose length isn't the commonest one
    (the greater of two).
    """
    rows = picked(vectors, vec_id=vec_id, vector=vector).select("vec_id", integers(F.col("vector")).alias("y"))
    rows = rows.where("size(y) > 0")
    lengths = rows.groupBy(F.size("y").alias("d")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return rows.where(F.size("y") == d), d


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("y")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(y: np.ndarray) -> np.ndarray:
    """y' y, exactly, as Python integers, for a chunk of at most CHUNK rows."""
    if np.abs(y).max(initial=0) < 1 << 20:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    high, low = (y >> 20).astype(float), (y & ((1 << 20) - 1)).astype(float)
    hh, hl, ll = ((a.T @ b).astype(np.int64).astype(object) for a, b in ((high, high), (high, low), (low, low)))
    return (hh << 40) + ((hl + hl.T) << 20) + ll


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of y, and n y'y - (sum y)'(sum y) of all rows (vec_id, y), exactly."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            y = _matrix(batch, d)
            y = np.c_[np.ones(len(y), np.int64), y]
            for begin in range(0, len(y), CHUNK):
                total = total + _products(y[begin:begin + CHUNK])
        i, j = np.triu_indices(d + 1)
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                               "v": pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38))})

    sums = (rows.select("y").mapInArrow(partial, "i int, j int, v decimal(38,0)")
            .groupBy("i", "j").agg(F.sum("v").alias("v")))
    total = np.zeros((d + 1, d + 1), object)
    for r in sums.collect():  # (d + 1) (d + 2) / 2 rows
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = int(r["v"])
    n, s = int(total[0, 0]), total[0, 1:]
    return n, [int(x) for x in s], [[int(x) for x in r] for r in n * total[1:, 1:] - np.outer(s, s)]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> spectrum.Poly:
    """Coefficients, constant first, of the monic characteristic polynomial of a scatter matrix."""
    d = len(matrix)
    primes = spectrum.enough_primes(spectrum.coefficient_bits(sum(matrix[i][i] for i in range(d)), d))
    whole = np.array(matrix, object)

    def modular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column(0).to_pylist()
            found = [spectrum.polynomial_mod((whole % p).astype(np.int64), p).tolist() for p in ps]
            yield pa.record_batch({"p": pa.array(ps, pa.int64()), "c": pa.array(found, pa.list_(pa.int64()))})

    tasks = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    return spectrum.remaindered([tuple(r) for r in tasks.mapInArrow(modular, "p long, c array<long>").collect()])


@dataclass
class Whitener:
    """What ``fit`` learnt, bounded by the dimension.

    ``axes`` (components x d) are unit vectors by falling eigenvalue of the
    covariance, ``deviations`` the square roots of these eigenvalues, ``explained``
    their shares of the trace. ``sums`` are those of y = x - OFFSET.
    """

    n: int
    sums: list[int]
    axes: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray


def fit(spark: SparkSession, rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitener:
    """The first components of all rows (vec_id, y).

    Components without variance can't be whitened and are left out, so there are
    at most as many as the rank; none if there are no rows or all are equal.
    """
    ship_package(spark)
    n, sums, matrix = scatter(rows, d) if d else (0, [], [])
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return Whitener(n, sums, np.empty((0, d)), np.empty(0), np.empty(0))
    poly = characteristic_polynomial(spark, matrix)
    zeros = next(i for i, c in enumerate(poly) if c)
    positive = poly[zeros:]
    free = spectrum.square_free(positive)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = spectrum.components(matrix, positive, free, k)
                if found:
                    yield pa.record_batch({
                        "k": pa.array([f[0] for f in found], pa.int32()),
                        "variance": pa.array([float(f[1] / (n * n)) for f in found], pa.float64()),
                        "explained": pa.array([float(f[1] / trace) for f in found], pa.float64()),
                        "axis": pa.array([f[2] for f in found], pa.list_(pa.float64()))})

    wanted = min(components, d - zeros)
    tasks = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "k int").repartition(wanted)
    found = sorted(tasks.mapInArrow(solve, "k int, variance double, explained double, axis array<double>").collect())
    found = found[:wanted]  # the last eigenspace may reach beyond
    return Whitener(n, sums, np.array([r["axis"] for r in found]), np.sqrt([r["variance"] for r in found]),
                    np.array([r["explained"] for r in found]))


def _whitened(model: Whitener, y: np.ndarray) -> np.ndarray:
    """Rows of y, centred exactly up to one rounding, on the axes, in units of deviation."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    part = np.array([s % model.n / model.n for s in model.sums])
    return ((y - whole) - part) @ model.axes.T / model.deviations


def _deviations(model: Whitener, y: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2; None where it doesn't fit 64 bits."""
    far = int(np.abs(y).max(initial=0)) * model.n + max(map(abs, model.sums))
    kind = np.int64 if far * far * y.shape[1] < 1 << 63 else object
    apart = y.astype(kind) * model.n - np.array(model.sums, kind)
    return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(1).tolist()]


def transform(rows: DataFrame, model: Whitener) -> DataFrame:
    """vec_id, deviation (null beyond 64 bits), whitened (one double for each component)
    of every row (vec_id, y). No components give empty arrays."""
    d = len(model.sums)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch, d)
            w = _whitened(model, y)
            ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_deviations(model, y), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "y").mapInArrow(apply, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the covariance of all rows' whitened values less the identity."""
    d, k = len(model.sums), len(model.axes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = _whitened(model, _matrix(batch, d))
            w = np.c_[np.ones(len(w)), w]
            total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    total = np.zeros((k + 1, k + 1))
    sums = rows.select("y").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in sums.collect():  # (k + 1) (k + 2) / 2 rows
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["v"]
    mean = total[0, 1:] / model.n
    return float(np.abs(total[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    model = fit(spark, rows, d)
    error = identity_error(rows, model) if len(model.axes) else 0.0
    each = transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.get(explained, "at").alias("explained"), F.lit(error).alias("identity_error"))
