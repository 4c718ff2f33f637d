"""Whitened vectors: leading eigenvectors of a covariance that is never formed.

A Jacobi-Davidson iteration for all wanted pairs at once runs on the driver over vectors as long as a row;
each product with the covariance is one Spark job over the centred rows. Correction equations, projected
against the Ritz vectors, are solved roughly by MINRES; pairs whose residual is at double precision are locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm.staging import stage

MOST = 16
SCALE = 64
BEYOND = 2.0**40  # components from here on cannot be counted exactly
EPS = np.finfo(np.float64).eps
Product = Callable[[np.ndarray], np.ndarray]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def minres(apply: Product, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions for independent right-hand sides, one column each, from zero."""
    x, w, w_old, v_old = (np.zeros_like(b) for _ in range(4))
    beta = np.linalg.norm(b, axis=0)
    v, eta = b * _ratio(np.ones_like(beta), beta), beta.copy()
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        main = c * alpha - c_old * s * beta
        rho = np.hypot(main, beta_new)
        w, w_old = (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) * _ratio(np.ones_like(rho), rho), w
        c, c_old, s, s_old = _ratio(main, rho), c, _ratio(beta_new, rho), s
        x, eta = x + c * eta * w, -s * eta
        v, v_old, beta = p * _ratio(np.ones_like(beta_new), beta_new), v, beta_new
    return x


def _fresh(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to orthonormal bases."""
    size = np.linalg.norm(t, axis=0)
    t = t[:, size > 0] / size[size > 0]
    for _ in range(3):
        for q in bases:
            t = t - q @ (q.T @ t)
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-10 * max(1.0, s[0] if len(s) else 0.0)]
    return t


def jacobi_davidson(product: Product, dim: int, wanted: int, inner: int = 5, guard: int = 4, basis: int = 0, rounds: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    ``product`` multiplies it with a block of columns. The search space starts from random vectors, ``guard``
    more than wanted, and is cut back to its best part beyond ``basis`` columns. A pair is locked, in order,
    once its residual is below 1e-14 times the root of the dimension, relative to the largest eigenvalue, or once
    it stays, below 1e-11, where the products' own rounding keeps it.
    """
    block = min(dim, wanted + guard)
    basis = min(dim, basis or 5 * block)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    q = _fresh(np.random.default_rng(seed).standard_normal((dim, block)))
    vq = product(q)
    best: dict[int, list[float]] = {}
    for _ in range(rounds):
        h = q.T @ vq
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        top = max(abs(theta[0]), values.max(initial=0.0))
        few = min(len(theta), wanted - len(values))
        u = q @ s[:, :few]
        r = vq @ s[:, :few] - u * theta[:few]
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        done = 0
        while done < few:
            seen = best.setdefault(len(values) + done, [])
            seen.append(float(size[done]))
            stays = len(seen) > 3 and size[done] <= 1e-11 * top and min(seen[-2:]) > 0.5 * min(seen[:-2])
            if size[done] > 1e-14 * np.sqrt(dim) * top and not stays and top > 0:
                break
            done += 1
        if done:
            locked, values = np.hstack([locked, u[:, :done]]), np.concatenate([values, theta[:done]])
            q, vq = q @ s[:, done:], vq @ s[:, done:]
            u, theta, r, few = u[:, done:], theta[done:], r[:, done:], few - done
        else:
            q, vq = q @ s, vq @ s
        if len(values) >= wanted:
            break
        if len(theta) > basis - few:
            q, vq = q[:, : max(few, basis // 2)], vq[:, : max(few, basis // 2)]
        fixed = np.hstack([locked, u])
        project = lambda y, fixed=fixed: y - fixed @ (fixed.T @ y)
        shift = theta[:few]
        t = minres(lambda y, shift=shift, project=project: project(product(y) - shift * y), project(-r), inner)
        t = _fresh(t, locked, q)
        if t.shape[1] == 0:
            t = _fresh(np.random.default_rng(seed + len(best)).standard_normal((dim, 2)), locked, q)
        if t.shape[1]:
            vt = product(t)
        else:  # the whole space is searched: compute its products anew
            t, vt = np.zeros((dim, 0)), np.zeros((dim, 0))
            vq = product(q)
        q, vq = np.hstack([q, t]), np.hstack([vq, vt])
    else:
        raise RuntimeError(f"{wanted - len(values)} pairs did not settle in {rounds} rounds")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


def counted(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows (vec_id, x): components as whole numbers floor(64 c), of rows that can be used."""
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < BEYOND))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], column: str, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in parts of about 16 MB with their rows as a matrix of whole numbers."""
    step = max(1, (1 << 21) // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def _exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for _, x in _blocks(batches, "x", dim):
            for at in range(0, len(x), 1 << 16):  # 2^46 times 2^16 still fits a long
                total = [a + int(b) for a, b in zip(total, x[at : at + (1 << 16)].sum(0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([*total, n], pa.decimal128(38, 0))], names=["i", "s"])

    rows = {r.i: int(r.s) for r in fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return rows.get(dim, 0), [rows.get(i, 0) for i in range(dim)]


def _gather(fit: DataFrame, mean: np.ndarray, part: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
    """Sum over all centred rows of what ``part`` makes of a block: one job, combined by row of the result."""
    dim = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width), np.longdouble)
        for _, x in _blocks(batches, "x", dim):
            total += part(x.astype(np.float64) - mean)
        total = total.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *map(pa.array, total.T.copy())], names=["i", *[f"c{k}" for k in range(width)]])

    schema = ", ".join(["i int", *[f"c{k} double" for k in range(width)]])
    sums = fit.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)])
    out = np.zeros((height, width))
    for r in sums.collect():
        out[r.i] = r[1:]
    return out


def whiten(vectors: DataFrame, most: int = MOST, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row.

    Left out: null and empty vectors, null or non-finite components, components of 2^40 or more, and vectors
    whose length is not that of most distinct vectors (ties: the shorter). Repeated vectors count once in the fit. Components
    are numbered by falling eigenvalue, the largest entry of each is positive. A component without variance
    has null whitened values; a deviation beyond a long is null. No usable rows give no rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = counted(vectors, vec_id, vector)
    fit = stage(rows.select("x").distinct(), "whitening-fit")
    usual = fit.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    dim = usual.dim
    fit, rows = fit.where(F.size("x") == dim), rows.where(F.size("x") == dim)
    n, sums = _exact_sums(fit, dim)
    mean = np.array([s / n for s in sums])
    trace = _gather(fit, mean, lambda c: (c * c).sum(0)[:, None], dim, 1).sum() / n
    product = lambda b: _gather(fit, mean, lambda c: c.T @ (c @ b), dim, b.shape[1]) / n
    values, u = jacobi_davidson(product, dim, min(most, dim))
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    spread = values > dim * EPS * max(values[0], 0.0)
    scale = np.where(spread, np.sqrt(np.where(spread, values, 1.0)), np.nan)
    basis = u[:, spread] / scale[spread]
    k = int(spread.sum())
    identity_error = 0.0
    if k:
        centre = _gather(fit, mean, lambda c: (c @ basis).sum(0)[:, None], k, 1)[:, 0] / n
        square = lambda z: z.T @ z
        identity_error = float(np.abs(_gather(fit, mean, lambda c: square(c @ basis - centre), k, k) / n - np.eye(k)).max())
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = len(values)
        for batch, x in _blocks(batches, "x", dim):
            z = ((x.astype(np.float64) - mean) @ u) / scale
            far = float(np.abs(x).max(initial=0)) * n + max(map(abs, sums))
            if dim * far * far < 2.0**62:
                deviation = pa.array(((n * x - np.array(sums)) ** 2).sum(1).repeat(every))
            else:
                exact = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
                deviation = pa.array([d if d < 1 << 63 else None for d in exact for _ in range(every)], pa.int64())
            ids = batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(np.arange(len(x)).repeat(every)))
            flat = z.ravel()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, every + 1, dtype=np.int32), len(x))), pa.array(np.full(len(flat), n)), deviation,
                 pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, len(x)), from_pandas=True), pa.array(np.full(len(flat), identity_error))],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    return rows.mapInArrow(run, schema)


def op13_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors, whitened along their sixteen leading components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
