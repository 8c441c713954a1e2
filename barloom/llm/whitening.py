"""Whitening of embeddings by Jacobi-Davidson: leading eigenvectors of a covariance that is never formed.

Vectors are stored once as blocks of integers.  A product of the covariance
with a few directions is one Spark job: each task centres its blocks, forms
C' (C W) and sends one small matrix.  On the driver are only matrices of
dimension by directions.

Each round takes Ritz pairs of the search space, locks those whose residual has
reached double precision, solves the projected correction equations of the
others with a few steps of MINRES, all in step so that one job serves them all,
and adds the corrections to the space; a space that has grown too wide restarts
from its best Ritz vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

COMPONENTS = 32
BLOCK = 4096  # vectors of a stored block
INNER = 5  # steps of MINRES for a correction
ROUNDS = 200
GUARD = 8  # directions beyond those wanted
LARGEST = 2.0**46  # of an entry: 64 times it is an exact integer
FAN = 64  # partial sums that the driver adds up itself


def vector_blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """Blocks (ids, x) of the finite vectors of the commonest length, x = floor(64 * c) + 1000000, and that length."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    widths = kept.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = widths[0].width if widths else 0

    def run(batches):
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            if values.size and np.abs(values).max() >= LARGEST:
                raise ArithmeticError(f"an entry of {np.abs(values).max()} leaves no exact integers")
            x = np.floor(64.0 * values).astype(np.int64) + 1_000_000
            for lo in range(0, batch.num_rows, BLOCK):
                ids = pa.array([batch.column("vec_id").slice(lo, BLOCK).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[lo : lo + BLOCK].tobytes()], pa.binary())], ["ids", "x"])

    return store(kept.where(F.size("v") == width).mapInArrow(run, "ids array<long>, x binary"), "op11-blocks"), width


def summed(blocks: DataFrame, tasks: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], dtype, width: int) -> np.ndarray:
    """Sum of part(x) over all blocks: one matrix per task, added up in groups of tasks first where there are many."""

    def run(batches):
        total = np.zeros(shape, dtype=dtype)
        for batch in batches:
            for raw in batch.column("x"):
                total += part(np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(-1, width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches):
        total = np.zeros(shape, dtype=dtype)
        for batch in batches:
            for raw in batch.column("m"):
                total += np.frombuffer(raw.as_buffer(), dtype=dtype).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = blocks.select("x").mapInArrow(run, "m binary")
    if tasks > FAN:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(add, "m binary")
    return np.sum([np.frombuffer(r.m, dtype=dtype).reshape(shape) for r in parts.collect()], axis=0)


def orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns spanning what `new` adds to the bases; directions that add nothing are dropped."""
    out = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        for base in bases:
            out = out - base @ (base.T @ out)
        q, r = np.linalg.qr(out)
        out = q[:, np.abs(np.diag(r)) > 1e-10]
    for base in bases:
        out = out - base @ (base.T @ out)
    return np.linalg.qr(out)[0] if out.shape[1] else out


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, tolerance: float = 1e-12) -> np.ndarray:
    """MINRES from zero for symmetric systems, one per column, advanced together."""
    tiny = np.finfo(float).tiny
    k = rhs.shape[1]
    x, v_old, v = np.zeros_like(rhs), np.zeros_like(rhs), rhs.copy()
    beta = np.linalg.norm(v, axis=0)
    eta, live, first = beta.copy(), beta > tiny, beta.copy()
    norm = np.zeros(k)
    v = v / np.maximum(beta, tiny)
    c_old, c, s_old, s = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    w_old, w = np.zeros_like(rhs), np.zeros_like(rhs)
    for step in range(steps):
        if not live.any():
            break
        av = apply(v)
        alpha = np.sum(v * av, axis=0)
        av = av - alpha * v - (beta if step else 0.0) * v_old
        beta_new = np.linalg.norm(av, axis=0)
        r3, r2 = s_old * (beta if step else 0.0), s * alpha + c_old * c * (beta if step else 0.0)
        r1_hat = c * alpha - c_old * s * (beta if step else 0.0)
        r1 = np.maximum(np.hypot(r1_hat, beta_new), tiny)
        c_old, s_old, c, s = c, s, r1_hat / r1, beta_new / r1
        w_old, w = w, (v - r3 * w_old - r2 * w) / r1
        x = x + np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        norm = np.maximum(norm, np.hypot(alpha, beta_new))
        # beyond this a system is solved, or its Krylov space ends and the next direction would be noise
        live = live & (np.abs(eta) > tolerance * first) & (beta_new > 1e-10 * norm)
        v_old, v, beta = v, av / np.maximum(beta_new, tiny), beta_new
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest eigenvalues, unit eigenvectors and residual norms of a positive semidefinite operator given by `product`."""
    width = min(dim, wanted + GUARD)
    largest = min(dim, 3 * width)
    space = orthonormal(np.random.default_rng(seed).standard_normal((dim, width)))
    image = product(space)
    locked, locked_image = np.zeros((dim, 0)), np.zeros((dim, 0))
    worst = []
    for _ in range(ROUNDS):
        if not space.shape[1]:  # all of it is locked, as with equal eigenvalues: go on in fresh directions
            space = orthonormal(np.random.default_rng(seed + locked.shape[1]).standard_normal((dim, width)), locked)
            image = product(space)
        small = space.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, ritz_image = space @ y, image @ y
        residual = ritz_image - ritz * theta
        if locked.shape[1]:
            residual = residual - locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        scale = max([abs(theta[0])] if len(theta) else [0.0], default=0.0)
        scale = max(scale, float(np.abs(np.sum(locked * locked_image, axis=0)).max(initial=0.0)))
        exact = 4 * dim * np.finfo(float).eps * scale  # what rounding leaves of a product
        left = wanted - locked.shape[1]
        done = 0
        while done < min(left, len(theta)) and norms[done] <= exact:
            done += 1
        if done:  # lock in order, so that no smaller pair takes the place of a larger one
            locked, locked_image = np.hstack([locked, ritz[:, :done]]), np.hstack([locked_image, ritz_image[:, :done]])
            ritz, ritz_image, theta, residual, norms = ritz[:, done:], ritz_image[:, done:], theta[done:], residual[:, done:], norms[done:]
        left = wanted - locked.shape[1]
        if left == 0:
            break
        if not len(theta):
            space, image = ritz, ritz_image
            continue
        space, image = ritz, ritz_image
        if space.shape[1] + left > largest:
            space, image = space[:, : max(left, width - locked.shape[1])], image[:, : max(left, width - locked.shape[1])]
        open_ = np.flatnonzero(norms[:left] > exact)
        u, shift, r = ritz[:, open_], theta[open_], residual[:, open_]

        def off(t):
            t = t - locked @ (locked.T @ t)
            return t - u * np.sum(u * t, axis=0)

        def corrected(t):
            t = off(t)
            return off(product(t) - t * shift)

        fresh = orthonormal(minres(corrected, -off(r), INNER, 1e-3), locked, space)
        if not fresh.shape[1]:  # the space holds all there is: products are as exact as they get
            worst.append(norms[:left].max())
            fresh = orthonormal(np.random.default_rng(seed + len(worst)).standard_normal((dim, left)), locked, space)
            if not fresh.shape[1]:
                image = product(space)  # of the basis itself, without the roundings of earlier rotations
                if len(worst) > 3:
                    raise ArithmeticError(f"residuals stay at {worst[-1]:.3e}, above {exact:.3e}")
                continue
        space, image = np.hstack([space, fresh]), np.hstack([image, product(fresh)])
    # one more Rayleigh-Ritz step over the locked vectors, on fresh products
    locked = np.linalg.qr(locked)[0]
    image = product(locked)
    small = locked.T @ image
    theta, y = np.linalg.eigh((small + small.T) / 2)
    theta, y = theta[::-1], y[:, ::-1]
    vectors = locked @ y
    return theta, vectors, np.linalg.norm(image @ y - vectors * theta, axis=0)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row of `rows` (vec_id, embedding).

    Rows whose vector is null, empty, or holds null or non-finite entries go,
    as do rows of another length than the commonest (the longer one in a tie).
    Repeated rows and rows without a vec_id count and are returned like any
    other.  Components without variance are left out, so equal vectors, a single
    row and an empty table give an empty result.  Entries must keep x and the
    exact deviation inside 64 bits; beyond that the query fails with an error.
    Other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks, width = vector_blocks(rows)
    if not width:
        return rows.sparkSession.createDataFrame([], schema)
    tasks = blocks.rdd.getNumPartitions()
    # exact count and sums
    totals = summed(blocks, tasks, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), (width + 1,), np.int64, width)
    n, sums = int(totals[0]), totals[1:]

    def centred(x):
        return (n * x - sums).astype(np.float64) / n

    def product(directions):
        def part(x):
            c = centred(x)
            return c.T @ (c @ directions)

        return summed(blocks, tasks, part, directions.shape, np.float64, width) / n

    trace = float(summed(blocks, tasks, lambda x: np.square(centred(x)).sum(axis=0), (width,), np.float64, width).sum() / n)
    if trace == 0.0:
        return rows.sparkSession.createDataFrame([], schema)
    values, vectors, _ = jacobi_davidson(product, width, min(components, width))
    some = values > width * np.finfo(float).eps * values[0]
    values, vectors = values[some], vectors[:, some]
    k = len(values)
    scaled = vectors / np.sqrt(values)

    def moments(x):
        z = centred(x) @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)[None, :]])

    both = summed(blocks, tasks, moments, (k + 1, k), np.float64, width)
    covariance = both[:k] / n - np.outer(both[k] / n, both[k] / n)
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = values / trace

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column("ids"), batch.column("x"), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(-1, width)
                off = n * x - sums
                if math.isqrt(2**63 // width) <= int(np.abs(off).max(initial=0)):
                    raise ArithmeticError("a deviation does not fit 64 bits")
                deviation = np.square(off).sum(axis=1)
                z = (off.astype(np.float64) / n) @ scaled
                rows, total = len(x), len(x) * k
                own = ids.values.take(pa.array(np.repeat(np.arange(rows), k)))
                columns = [own, np.tile(np.arange(1, k + 1, dtype=np.int32), rows), np.full(total, n), np.repeat(deviation, k), z.ravel(), np.tile(explained, rows), np.full(total, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema_names)

    schema_names = [field.split()[0] for field in schema.split(", ")]
    return blocks.mapInArrow(run, schema)
