"""Whitening of segment embeddings: exact integer scatter, pivoted Cholesky, one-sided Jacobi."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.llm.batches import bound_batches
from stridemill.scale import checkpoint

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
LIMB_BITS = 20
GRAM_ROWS = 4096
SWEEPS = 60
FIXED_POINT = 1 << 30


def usable(vector: str) -> Column:
    """Not null, and without null or non-finite entries."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, number), F.lit(False))


def limb_grams(y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Exact ``y.T @ y`` of integers as (power of two, integer matrix) summands.

    Entries are cut into limbs of ``LIMB_BITS`` bits. A product of two limbs over ``GRAM_ROWS`` rows stays below 2**53,
    so the products run in floating point without rounding.
    """
    for at in range(0, len(y), GRAM_ROWS):
        rest = y[at : at + GRAM_ROWS].copy()
        limbs = []
        while True:
            low = ((rest + (1 << LIMB_BITS - 1)) & ((1 << LIMB_BITS) - 1)) - (1 << LIMB_BITS - 1)
            limbs.append(low.astype(np.float64))
            rest = (rest - low) >> LIMB_BITS
            if not rest.any():
                break
        for a in range(len(limbs)):
            for b in range(len(limbs)):
                yield LIMB_BITS * (a + b), (limbs[a].T @ limbs[b]).astype(np.int64)


def integer_moments(vectors: DataFrame, column: str, size: int, center: list[int]) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and product sums of ``x - center`` over all rows, as Python integers.

    Tasks send one row per entry of their own matrix, Spark adds them up before the driver reads ``size**2`` rows.
    """
    middle = np.array(center, np.int64)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, sums, grams = 0, np.zeros(size, dtype=object), {}
        for frame in frames:
            if not len(frame):
                continue
            y = np.stack(frame[column].to_numpy()).astype(np.int64) - middle
            rows += len(y)
            sums = sums + np.array([int(v) for v in y.astype(object).sum(0)] if abs(y).max() > 1 << 40 else y.sum(0).tolist(), dtype=object)
            for power, gram in limb_grams(y):
                grams[power] = grams.get(power, 0) + gram.astype(object)
        if rows:
            i, j = np.divmod(np.arange(size * size), size)
            for power, gram in grams.items():
                yield pd.DataFrame({"i": i, "j": j, "power": power, "value": [str(v) for v in gram.ravel()]})
            yield pd.DataFrame({"i": -1, "j": np.arange(size), "power": 0, "value": [str(v) for v in sums]})
            yield pd.DataFrame({"i": [-2], "j": [0], "power": [0], "value": [str(rows)]})

    totals = (
        vectors.select(column).mapInPandas(partial, "i int, j int, power int, value string")
        .groupBy("i", "j", "power").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    )
    count, sums, products = 0, [0] * size, [[0] * size for _ in range(size)]
    for r in totals:
        if r["i"] == -2:
            count = int(r["value"])
        elif r["i"] == -1:
            sums[r["j"]] = int(r["value"])
        else:
            products[r["i"]][r["j"]] += int(r["value"]) << r["power"]
    return count, sums, products


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``l`` and ``order`` with ``a[order][:, order] = l @ l.T``; as many columns as ``a`` has rank."""
    a = a.copy()
    size = len(a)
    order = np.arange(size)
    l = np.zeros((size, size))  # noqa: E741
    floor = size * np.finfo(float).eps * max(float(np.diag(a).max(initial=0.0)), 0.0)
    for k in range(size):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if a[p, p] <= floor:
            return l[:, :k], order
        a[[k, p]] = a[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        l[[k, p]] = l[[p, k]]
        order[[k, p]] = order[[p, k]]
        l[k, k] = math.sqrt(a[k, k])
        l[k + 1 :, k] = a[k + 1 :, k] / l[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(l[k + 1 :, k], l[k + 1 :, k])
    return l, order


def one_sided_jacobi(l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Squared norms and unit columns, largest first, after rotating the columns of ``l`` until all are orthogonal.

    They are the eigenvalues and eigenvectors of ``l @ l.T``. Raises when ``SWEEPS`` sweeps do not suffice.
    """
    l = l.copy()  # noqa: E741
    rank = l.shape[1]
    tolerance = len(l) * np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for p in range(rank - 1):
            for q in range(p + 1, rank):
                x, y = l[:, p], l[:, q]
                a, b, c = x @ x, y @ y, x @ y
                if abs(c) <= tolerance * math.sqrt(a * b):
                    continue
                turned = True
                zeta = (b - a) / (2 * c)
                t = math.copysign(1.0, zeta) / (abs(zeta) + math.hypot(1.0, zeta))
                cos = 1 / math.hypot(1.0, t)
                l[:, p], l[:, q] = cos * (x - t * y), cos * (y + t * x)
        if not turned:
            break
    else:
        raise ArithmeticError(f"columns are not orthogonal after {SWEEPS} sweeps")
    values = (l * l).sum(0)
    order = np.argsort(-values, kind="stable")
    values, l = values[order], l[:, order]  # noqa: E741
    return values, l / np.sqrt(values)


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``sums``; ``axes`` has a unit component per row, ``values`` their variances."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def apart(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``; as Python integers where a long could overflow."""
        if self.n * (int(abs(x).max(initial=0)) + 1) >= 1 << 61:
            x = x.astype(object)
        return x * self.n - np.array(self.sums, dtype=x.dtype)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.apart(x) / self.n).astype(np.float64) @ self.axes.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[str]:
        """Sum over dimensions of the squares of ``n * x - S``, exact, as decimal digits."""
        apart = self.apart(x)
        if apart.dtype == object or abs(apart).max(initial=0) >= 1 << 53:
            return [str(v) for v in (apart.astype(object) ** 2).sum(1)]
        high, low = apart >> 26, apart & (1 << 26) - 1
        parts = zip((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist(), strict=True)
        return [str((a << 52) + (b << 27) + c) for a, b, c in parts]


def fit_whitening(vectors: DataFrame, column: str = "x", components: int = COMPONENTS) -> Whitening | None:
    """Fit on a table of integer vectors, one row each (repeat rows count again); None without rows.

    The covariance is formed from integers, centred exactly, and rounded once. The driver holds numbers of the order of
    ``dimensions**2`` only. Raises ValueError when vectors differ in length.
    """
    lengths = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if not lengths[1]:
        return None
    if lengths[0] != lengths[1]:
        raise ValueError(f"embeddings of {lengths[0]} and of {lengths[1]} dimensions cannot share one whitening")
    size = lengths[1]
    middle = vectors.select(F.posexplode(column).alias("d", "v")).groupBy("d").agg(F.avg("v").alias("v")).collect()
    center = [0] * size
    for r in middle:
        center[r["d"]] = round(r["v"])
    n, sums, products = integer_moments(vectors, column, size, center)
    spread = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    # quotients of Python integers are rounded once
    covariance = np.array([[v / (n * n) for v in row] for row in spread])
    triangle, order = pivoted_cholesky(covariance)
    values, columns = one_sided_jacobi(triangle)
    kept = min(components, len(values))
    axes = np.zeros((kept, size))
    axes[:, order] = columns.T[:kept]
    axes *= np.sign(axes[np.arange(kept), np.abs(axes).argmax(1)])[:, None]
    total = [s + n * c for s, c in zip(sums, center, strict=True)]
    return Whitening(n, total, axes, values[:kept], sum(spread[i][i] for i in range(size)) / (n * n))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "x") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all rows.

    Values are rounded to multiples of 1 / ``FIXED_POINT`` and added as integers, so partitioning does not show.
    """
    size = len(model.values)

    def fixed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                z = model.project(np.stack(frame[column].to_numpy()).astype(np.int64))
                yield pd.DataFrame({"z": list(np.rint(z * FIXED_POINT).astype(np.int64))})

    n, sums, products = integer_moments(vectors.select(column).mapInPandas(fixed, "z array<long>"), "z", size, [0] * size)
    worst = 0.0
    for i in range(size):
        for j in range(size):
            worst = max(worst, abs((n * products[i][j] - sums[i] * sums[j]) / (n * n * FIXED_POINT**2) - (i == j)))
    return worst


def whiten_segments(segments: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of segment embeddings, one row per segment and component.

    In: ``segment_id, vector``. Out: ``segment_id, component, n, deviation, whitened, explained, identity_error``.
    Rows whose vector is null or holds a null or non-finite entry are left out. Every entry c becomes the integer
    ``x = floor(64 * c) + 1000000``; 64 * c beyond 2**52 either way is held there. The fit uses every distinct x once:
    ``n`` of them with sums S. ``component`` counts from 1 by falling variance, up to ``components`` of them or as many
    as the vectors span: components without variance have no rows, nor have tables of one distinct vector.
    ``deviation`` is the sum over dimensions of (n x - S)^2 as decimal(38,0), ``whitened`` the coordinate over its standard
    deviation, ``explained`` the component's share of all variance, ``identity_error`` the largest error of the
    whitened covariance, equal in all rows. A component's sign makes its largest entry positive.

    Repeated and null ids are rows of their own. Vectors of different length raise ValueError. Copies are dropped by a
    partial aggregate, so a vector that holds a third of the rows gathers nowhere. Other columns are not carried; an
    empty table gives an empty result.
    """
    bound_batches(segments.sparkSession, 4096)
    id_type = segments.schema["segment_id"].dataType.simpleString()
    scaled = F.transform("vector", lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-(2.0**52))), F.lit(2.0**52)))
    rows = segments.filter(usable("vector")).select("segment_id", F.transform(scaled, lambda c: (F.floor(c) + OFFSET).cast("long")).alias("x"))
    distinct = checkpoint(rows.select("x").distinct())
    model = fit_whitening(distinct, "x", components)
    schema = f"segment_id {id_type}, component int, n long, _digits string, whitened double, explained double"
    if model is None or not len(model.values):
        error, out = 0.0, rows.sparkSession.createDataFrame([], schema)
    else:
        error = identity_error(distinct, model)
        share = model.values / model.trace
        count = len(model.values)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack(batch.column("x").to_numpy(zero_copy_only=False)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("segment_id").take(pa.array(np.repeat(np.arange(len(x)), count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * count, model.n, np.int64)),
                        pa.array([d for d in model.deviations(x) for _ in range(count)]),
                        pa.array(model.project(x).ravel()), pa.array(np.tile(share, len(x))),
                    ],
                    names=["segment_id", "component", "n", "_digits", "whitened", "explained"],
                )

        out = rows.mapInArrow(told, schema)
    return out.select(
        "segment_id", "component", "n", F.col("_digits").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error")
    )
