"""Embedding whitening by LOBPCG.

1. Entries become integers; the fit list is each different vector once, a written table.
   Its size and sums are exact, and every row is centred before anything is multiplied:
   x - S/n is one rounding away from exact.
2. Locally optimal block preconditioned conjugate gradients (Knyazev, 2001, without a
   preconditioner) for the leading eigenvectors of the covariance V: tasks add up
   Y'(Y B) over their centred rows Y for a block B of a few columns, Spark adds up the
   tasks' sums, so V itself is never formed.  Each round is one such product, of the residuals
   and previous directions; Rayleigh-Ritz on iterate, residual and direction blocks, made orthonormal,
   gives the next iterate.  Some guard columns beyond the asked ones speed it up.
3. It ends when residuals |V u - e u| of all asked components, of a product made anew for
   the iterate, are at most ``CERTIFIED`` of the largest eigenvalue and no longer fall.
4. Rows are projected on the components and divided by sqrt(e); one more pass over the
   fit list measures how far the whitened covariance is from the identity.

The driver holds blocks of a vector's length by a few dozen columns, whatever the number of rows.

Defined cases: a row whose vector is null, holds null or non-finite entries, or entries
beyond 2^46, or is shorter than the longest takes no part; components whose
eigenvalue is under ``ZERO`` of the largest don't exist, so a fit list of one vector (or of
empty ones) gives no rows; n vectors give n - 1 components at most; a deviation beyond 64 bits is
null; ids may be null or repeat, each row has its own result; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices, tidy
from .hard_negatives import matrix
from .storage import drop_table, read, write_table

CERTIFIED = 1e-12
#: Residuals of so little of it are not worth another round.
SMALLEST = 1e-15
ZERO = 1e-9
ROUNDS = 500
_SPLIT = 26  # bits of the lower halves of entries, which are added up apart


def integers(rows: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x): the rows without null or non-finite entries; x: floor(scale * entry) + shift."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    narrow = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("v IS NOT NULL")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * F.lit(float(scale)) < F.lit(float(1 << 52))))
    return narrow.filter(finite).select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift).cast("long")).alias("x"))


def summed(rows: DataFrame, of, kind: str) -> dict[int, int | float]:
    """The sums over all batches of what ``of(x)`` gives: (cells, numbers); added up in each task, then by Spark."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, 4096):
            for name, part in of(b.column("x")).items():
                total[name] = total[name] + part if name in total else part
        if total:
            every = np.concatenate(list(total.values()), axis=None)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every))), pa.array(every)], ["cell", "v"])

    sums = rows.select("x").mapInArrow(run, f"cell long, v {kind}").groupBy("cell").agg(F.sum("v").alias("v"))
    return {r.cell: r.v for r in sums.collect()}  # as many as of() gives for one batch


@dataclass
class Centre:
    """Size and sums of the fit list; the nearest whole numbers to the means, and what is left of the sums beside them."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.near = [round(s / self.n) if self.n else 0 for s in self.sums]
        self.left = [s - self.n * c for s, c in zip(self.sums, self.near)]

    def centred(self, x: pa.Array) -> np.ndarray:
        """x - S/n in doubles."""
        return (matrix(x, len(self.near), np.int64) - np.array(self.near, np.int64)) - np.array([r / self.n for r in self.left])

    def deviations(self, x: pa.Array) -> pa.Array:
        """The exact sums of (n x - S)^2."""
        off = matrix(x, len(self.near), np.int64) - np.array(self.near, np.int64)
        rough = ((off.astype(float) * self.n - np.array(self.left, float)) ** 2).sum(axis=1)
        out = np.zeros(len(off), np.int64)
        small = rough < 9e18
        z = off[small] * np.int64(self.n) - np.array(self.left, np.int64) if small.any() else np.zeros((0, 0), np.int64)
        out[small] = (z * z).sum(axis=1)
        out, far = list(out), np.flatnonzero(~small)
        for k in far:
            d = sum((int(o) * self.n - r) ** 2 for o, r in zip(off[k], self.left))
            out[k] = d if d < 1 << 63 else None
        return pa.array(out, pa.int64())


def centre(fit: DataFrame, width: int) -> Centre:
    mask = np.int64((1 << _SPLIT) - 1)

    def of(x: pa.Array) -> dict[str, np.ndarray]:
        m = matrix(x, width, np.int64)
        return {"n": np.array([len(m)]), "low": (m & mask).sum(axis=0), "high": (m >> _SPLIT).sum(axis=0)}

    got = summed(fit, of, "long")
    return Centre(got.get(0, 0), [got.get(1 + i, 0) + (got.get(1 + width + i, 0) << _SPLIT) for i in range(width)])


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the orthonormal ``against``."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8][:, : block.shape[0] - against.shape[1]]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def leading(product, width: int, count: int, guard: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(vectors, values, certificates) of the ``count`` largest eigenvalues, falling, of the operator ``product(block)``."""
    rng = np.random.default_rng(seed)
    x = np.linalg.qr(rng.standard_normal((width, min(width, count + guard))))[0]
    vx, p, best, stale, fresh = product(x), np.zeros((width, 0)), np.inf, 0, True
    for _ in range(ROUNDS):
        values, c = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        values, c = values[::-1], c[:, ::-1]
        x, vx = x @ c, vx @ c
        r = vx - x * values
        size = np.linalg.norm(r[:, :count], axis=0)
        worst = float(size.max())
        stale = 0 if worst < best / 2 else stale + 1
        best = min(best, worst)
        settled = values[0] <= 0 or worst <= CERTIFIED * values[0] and (stale >= 3 or worst <= SMALLEST * values[0])
        if settled and fresh:
            return x[:, :count], values[:count], size.tolist()
        if settled:
            vx, fresh = product(x), True  # a certificate rests on no recurrence
            continue
        r = orthonormal(r, x)
        both = np.hstack([r, orthonormal(p, np.hstack([x, r]))])
        if not both.shape[1]:  # the iterate spans everything
            vx, fresh = product(x), True
            continue
        basis, images = np.hstack([x, both]), np.hstack([vx, product(both)])
        _, c = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        c = c[:, ::-1][:, : x.shape[1]]
        p, x, vx, fresh = both @ c[x.shape[1] :], basis @ c, images @ c, False
    raise RuntimeError(f"residuals of {worst:.1e} after {ROUNDS} rounds, against an eigenvalue of {values[0]:.1e}")


@dataclass
class Whitening:
    """What :func:`fit` found: apply() whitens rows."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    certificates: list[float]
    identity_error: float

    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def apply(self, rows: DataFrame, id_col: str) -> DataFrame:
        """A row for each row of ``rows`` (id, x) and component."""
        own, weights, explained = self.centre, self.weights(), self.values / self.trace if self.trace else self.values
        k, error = len(self.values), self.identity_error

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 4096):
                w = own.centred(b.column("x")) @ weights
                each = pa.array(np.repeat(np.arange(b.num_rows), k))
                m = b.num_rows * k
                columns = [b.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(m, own.n)), own.deviations(b.column("x")).take(each)]
                columns += [pa.array(w.ravel()), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(m, error))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        rows = rows.filter(F.size("x") == len(own.sums)) if k else rows.limit(0)
        return rows.mapInArrow(run, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)


def fit(rows: DataFrame, components: int) -> Whitening:
    """Components of the different vectors of ``rows`` (id, x)."""
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    vectors = write_table(rows.filter(F.size("x") == width).select("x").distinct(), "op12-fit")
    own = centre(vectors, width)
    if own.n < 2 or not width:
        drop_table(vectors)
        return Whitening(own, np.zeros((width, 0)), np.zeros(0), 0.0, [], 0.0)

    trace = 0.0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal trace

        def of(x: pa.Array) -> dict[str, np.ndarray]:
            y = own.centred(x)
            return {"trace": np.array([(y * y).sum()]), "image": y.T @ (y @ block)}

        got = summed(vectors, of, "double")
        trace = got[0] / own.n
        return np.array([got[1 + i] for i in range(block.size)]).reshape(block.shape) / own.n

    count = min(components, width, own.n - 1)
    u, e, certificates = leading(product, width, count, max(8, count // 2))
    real = e > ZERO * e[0]
    out = Whitening(own, u[:, real], e[real], trace, certificates, 0.0)
    weights, k = out.weights(), int(real.sum())

    def of(x: pa.Array) -> dict[str, np.ndarray]:
        w = own.centred(x) @ weights
        return {"sums": w.sum(axis=0), "products": w.T @ w}

    got = summed(vectors, of, "double")
    mean = np.array([got[i] for i in range(k)]) / own.n
    products = np.array([got[k + i] for i in range(k * k)]).reshape(k, k) / own.n
    out.identity_error = float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    drop_table(vectors)
    return out


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error for every row and component."""
    own = integers(rows, id_col, vector_col, scale, shift)
    return fit(own, components).apply(own, id_col)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))
