"""Whitening of embeddings: principal components of unit variance, from one pass of mergeable moments.

Entries become whole numbers, and each distinct vector counts once. Each partition of the distinct vectors gives count,
mean and scatter about its own mean, batch by batch; two such are merged by Chan's formula (Chan, Golub, LeVeque, 1979),
in the partition and then in a treeReduce, so that no products of uncentred numbers are ever added up and only a few
matrices reach the driver. There eigh() gives the components. A second pass of the same kind over the whitened vectors
verifies that their covariance is the identity.

A matrix of d x d doubles is held per task, and by the driver a few of them: d is bounded by the model that made the
vectors (8 MB at 1,000 dimensions), the number of rows is not.

Edge cases: vectors that are null, empty or hold null or non-finite entries are dropped; where lengths differ, the most
frequent length stays (of equally frequent ones the longest); whole numbers end at 2^40 on both sides; repeated rows
have results of their own but count once in the fit; a component without variance (one vector only, constant dimensions) has a null
`whitened` and no part in identity_error; `deviation` is null where it doesn't fit a long; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from factline.session import durable, forget, small_batches

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = 1 << 40
Moments = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # count, sums (whole numbers), mean and scatter about it


def whole(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null for a vector that is dropped."""
    values = vector.cast("array<double>")
    bad = F.exists(values, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    bound = lambda c: F.least(F.greatest(c, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    to_long = lambda c: F.floor(bound(c * SCALE)) + SHIFT
    return F.when((F.size(values) > 0) & ~bad, F.transform(values, to_long))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(x: np.ndarray, shift: int | float = 0) -> Moments:
    """Count, sums, mean and scatter about the mean of rows; x is centred before it is multiplied."""
    y = x - shift
    sums = y.sum(axis=0)
    mean = sums / len(y)
    c = y - mean
    return len(x), sums, mean, c.T @ c


def merged(a: Moments | None, b: Moments) -> Moments:
    """Chan's pairwise formula; None stands for no rows."""
    if a is None:
        return b
    n = a[0] + b[0]
    if a[1].dtype.kind in "iO":  # of whole numbers the difference of the means is exact, however far from 0 they are
        delta = ((b[1].astype(object) * a[0] - a[1].astype(object) * b[0]) / (a[0] * b[0])).astype(float)
    else:
        delta = b[2] - a[2]
    return n, a[1] + b[1], a[2] + delta * (b[0] / n), a[3] + b[3] + np.outer(delta, delta) * (a[0] * b[0] / n)


def _reduced(vectors: DataFrame, column: str, change: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments:
    """The moments of all rows (one at least) of an array column, through `change` (a function of a matrix) if given."""
    sums_of = np.int64 if change is None else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Moments | None = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                held = merged(held, moments(x, SHIFT) if change is None else moments(change(x)))
        if held is not None:
            yield pa.RecordBatch.from_pydict({"n": [held[0]], **{k: [v.tobytes()] for k, v in zip(("sums", "mean", "scatter"), held[1:])}})

    def unpacked(row: Row) -> Moments:
        mean = np.frombuffer(row["mean"])
        sums = np.frombuffer(row["sums"], sums_of)
        return row["n"], sums.astype(object) if change is None else sums, mean, np.frombuffer(row["scatter"]).reshape(len(mean), -1)

    parts = vectors.select(column).mapInArrow(run, "n long, sums binary, mean binary, scatter binary")
    return parts.rdd.map(unpacked).treeReduce(merged, depth=3)


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S; unit components (rows) with variances e, in falling order; trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def scaled(self) -> np.ndarray:
        """Whether a component has variance beyond rounding."""
        return self.variances > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S in whole numbers as long as they fit a double exactly, else as Python's."""
        fits = max(self.n * (np.abs(x).max(initial=0) + 1.0), float(np.abs(self.sums).max())) < 2.0**62
        return self.n * x - self.sums.astype(np.int64) if fits else self.n * x.astype(object) - self.sums

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of whole-number rows; components without variance are NaN."""
        e = np.where(self.scaled(), self.variances, np.nan)
        return ((self.centred(x) / self.n).astype(float) @ self.components.T) / np.sqrt(e)


def fit(distinct: DataFrame, column: str = "x", most: int = COMPONENTS) -> Whitening:
    """Components of the rows (one at least) of an array<long> column."""
    n, sums, _, scatter = _reduced(distinct, column)
    values, vectors = np.linalg.eigh(scatter / n)
    order = np.argsort(-values, kind="stable")[:most]
    components = vectors[:, order].T
    # of both signs that whose entry of largest size is positive
    largest = components[np.arange(len(components)), np.abs(components).argmax(axis=1)]
    components = components * np.where(largest < 0, -1.0, 1.0)[:, None]
    return Whitening(n, sums + n * SHIFT, components, values[order], float(np.trace(scatter) / n))


def identity_error(distinct: DataFrame, model: Whitening, column: str = "x") -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, in size."""
    has = model.scaled()
    if not has.any():
        return 0.0
    got = _reduced(distinct, column, lambda x: model.apply(x)[:, has])
    return float(np.abs(got[3] / got[0] - np.eye(int(has.sum()))).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """RESULT: a row for each vector that is not dropped and each of its first `most` components."""
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = embeddings.select(F.col("vec_id").cast("long"), whole(F.col(vector)).alias("x")).where("x is not null")
    distinct = durable(rows.select("x").distinct(), "distinct-vectors")
    sizes = distinct.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    size = sizes[0]["size"]
    same = distinct.where(F.size("x") == size)
    model = fit(same, "x", most)
    error = identity_error(same, model)
    forget(distinct)
    held = spark.sparkContext.broadcast(model)  # most x size numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = len(m.components)
        share = m.variances / m.trace if m.trace > 0 else np.zeros(k)
        for batch in batches:
            r = batch.num_rows
            if not r:
                continue
            x = _matrix(batch.column(1))
            centred = m.centred(x)
            if np.square(centred.astype(float)).sum(axis=1).max() < 2.0**62:
                deviation = pa.array(np.square(centred).sum(axis=1), pa.int64())
            else:  # exact, beyond what a long multiplies
                deviation = pa.array([d if d < 2**63 else None for d in (sum(int(v) ** 2 for v in row) for row in centred)], pa.int64())
            white = pa.array(m.apply(x).reshape(-1), from_pandas=True)
            each = pa.array(np.repeat(np.arange(r), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, m.n)), deviation.take(each), white, pa.array(np.tile(share, r)), pa.array(np.full(r * k, error))],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return rows.where(F.size("x") == size).mapInArrow(run, RESULT)
