"""Exact running sums in a global order without a one-partition window.

Keys are range-bucketed with approximate quantile split points (only load
balance depends on them, not correctness); a window *inside* each bucket adds
the running sum, and the per-bucket totals (at most ``buckets`` rows per
partition key) give each bucket its offset.  The number of buckets grows with
the rows, so that a window task sorts about ``BUCKET_ROWS`` at any size."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1_000_000
MIN_BUCKETS = 8


def bucket_count(rows: int) -> int:
    return max(MIN_BUCKETS, math.ceil(rows / BUCKET_ROWS))


def cumulative(df: DataFrame, order_col: str, sum_cols: list[str], partition_by: list[str] | None = None,
               descending: bool = False, buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows with order value <= (or >=
    when descending) the row's, within ``partition_by``.  ``order_col``
    values must be unique within a partition (pre-aggregate ties)."""
    keys = list(partition_by or [])
    o = (-F.col(order_col) if descending else F.col(order_col)).cast("double")
    work = df.withColumn("__o", o)
    if buckets is None:
        buckets = bucket_count(work.count())
    probs = [i / buckets for i in range(1, buckets)]
    qs = work.agg(F.percentile_approx("__o", probs, max(10000, 10 * buckets)).alias("q")).collect()[0]["q"] or []
    splits = [float("-inf")] + sorted({float(x) for x in qs}) + [float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    work = Bucketizer(splits=splits, inputCol="__o", outputCol="__b", handleInvalid="keep").transform(work)
    w = Window.partitionBy(*keys, "__b").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    for c in sum_cols:
        work = work.withColumn(f"__l_{c}", F.sum(c).over(w))
    totals = work.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    tw = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{c}").over(tw), F.lit(0)).alias(f"__off_{c}")
                                            for c in sum_cols])
    # no hint: keys x buckets rows, which Spark broadcasts only below its size limit
    out = work.join(offsets, keys + ["__b"], "left")
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"__l_{c}") + F.col(f"__off_{c}"))
    return out.drop("__o", "__b", *[f"__l_{c}" for c in sum_cols], *[f"__off_{c}" for c in sum_cols])
