"""Pairwise sums of many columns by matrix products.

A task adds up, per Arrow batch of rows X with presence mask M, the products
``M'M`` (rows of a pair), ``X'M`` (sum of the first where the second is there),
``(X^2)'M`` and ``X'X``, and the pairwise extremes, from which a column that is
constant over the pair's rows is told exactly.  Tasks are merged in a tree of
bounded fan-in; the plan's size does not depend on the number of pairs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import num

#: Partial results that one task of the tree merges.
FAN_IN = 32
_FIELDS = "n array<double>, s array<double>, q array<double>, p array<double>, lo array<double>, hi array<double>, odd array<double>"
_PARTS = ("n", "s", "q", "p", "lo", "hi", "odd")


class PairSums:
    """Sums over pairs of ``m`` columns; row i, column j: of column i over the
    rows where both are present."""

    def __init__(self, m: int):
        self.n, self.s, self.q, self.p, self.odd = (np.zeros((m, m)) for _ in range(5))
        self.lo, self.hi = np.full((m, m), np.inf), np.full((m, m), -np.inf)

    def add(self, x: np.ndarray) -> None:
        """A block of rows; NaN is missing."""
        mask = ~np.isnan(x)
        finite = np.isfinite(x)
        ones = mask.astype(np.float64)
        v = np.where(finite, x, 0.0)
        self.n += ones.T @ ones
        self.s += v.T @ ones
        self.q += (v * v).T @ ones
        self.p += v.T @ v
        self.odd += (mask & ~finite).astype(np.float64).T @ ones  # infinite values: r is undefined
        # columns present in the same rows share their extremes
        packed = np.packbits(mask, axis=0).T
        _, first, which = np.unique(packed, axis=0, return_index=True, return_inverse=True)
        for g, j in enumerate(first):
            rows = x[mask[:, j]]
            if len(rows):
                cols = np.flatnonzero(which.ravel() == g)
                low = np.fmin.reduce(rows, axis=0, initial=np.inf)
                high = np.fmax.reduce(rows, axis=0, initial=-np.inf)
                self.lo[:, cols] = np.minimum(self.lo[:, cols], low[:, None])
                self.hi[:, cols] = np.maximum(self.hi[:, cols], high[:, None])

    def merge(self, parts: dict) -> None:
        for name in _PARTS:
            own, other = getattr(self, name), parts[name].reshape(self.n.shape)
            if name == "lo":
                np.minimum(own, other, out=own)
            elif name == "hi":
                np.maximum(own, other, out=own)
            else:
                own += other

    def batch(self):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([getattr(self, p).ravel()]) for p in _PARTS], list(_PARTS))


def _parts(batch, i: int) -> dict:
    return {p: batch.column(p)[i].values.to_numpy() for p in _PARTS}


def pair_sums(df: DataFrame, cols: list[str]) -> tuple[PairSums, list[float]]:
    """Sums of the columns less a shift each (their mean), and the shifts."""
    from ..session import ship_package

    ship_package(df.sparkSession)
    m = len(cols)
    finite = [F.when(F.abs(num(c)) < float("inf"), num(c)) for c in cols]
    means = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(finite)]).first()
    shift = [means[f"m{i}"] or 0.0 for i in range(m)]
    values = df.select(*[(num(c) - F.lit(shift[i])).alias(f"v{i}") for i, c in enumerate(cols)])

    def add(batches):
        sums = PairSums(m)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sums.add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns]))
        yield sums.batch()

    def merge(batches):
        sums, some = PairSums(m), False
        for batch in batches:
            for i in range(batch.num_rows):
                sums.merge(_parts(batch, i))
                some = True
        if some:
            yield sums.batch()

    tasks = values.rdd.getNumPartitions()
    level = values.mapInArrow(add, _FIELDS)
    while tasks > 1:
        tasks = math.ceil(tasks / FAN_IN)
        level = level.repartition(tasks).mapInArrow(merge, _FIELDS)
    total = PairSums(m)
    for row in level.collect():  # one row
        total.merge({p: np.array(row[p]) for p in _PARTS})
    return total, shift


def correlations(sums: PairSums) -> np.ndarray:
    """Pearson r of every pair over the rows where both are present; 0 where a
    side is constant there, infinite or absent; the diagonal is 1 or 0."""
    n = np.maximum(sums.n, 1.0)
    mean_a, mean_b = sums.s / n, sums.s.T / n
    cov = sums.p / n - mean_a * mean_b
    var_a, var_b = sums.q / n - mean_a ** 2, sums.q.T / n - mean_b ** 2
    fixed = (sums.n == 0) | ~(sums.lo < sums.hi) | ~(sums.lo.T < sums.hi.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where((var_a > 0) & (var_b > 0), cov / np.sqrt(var_a * var_b), 0.0)
    np.fill_diagonal(r, 1.0)
    r[fixed | (sums.odd > 0) | (sums.odd.T > 0)] = 0.0
    return r
