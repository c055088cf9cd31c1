"""Exact order statistics at scale.

Spark's exact ``percentile`` keeps every distinct value of a group in one hash
map and merges them in one task -- fine for 60k rows, fatal for a column of
10^12 doubles.  ``percentile_approx`` scales but does not interpolate, so it
cannot reproduce pandas / DuckDB quantiles.

``order_statistics`` finds the exact k-th smallest values with a few passes of
ordinary, map-side-combined aggregation:

1. every requested rank starts in a *bracket* ``[lo, hi]`` (column min/max)
   holding ``cnt`` values, ``below`` values lying under it;
2. one pass buckets the values of every open bracket into ``bins``
   equal-width buckets (``groupBy(bracket, bucket).agg(count, min, max)``)
   -- the collected histogram has at most ``brackets x bins`` rows;
3. the bucket holding the rank becomes the new bracket, tightened to the
   bucket's real min/max;
4. once a bracket holds at most ``exact_limit`` values (or a single value) the
   pass groups by the value itself and the answer is read off.

Each pass is a scan + partial aggregation whose shuffle is bounded by
``brackets x bins`` rows per map task, independent of data size; a skewed
value (a third of all rows equal) simply ends as a min==max bucket.  Bucket
assignment is monotone in the value, so buckets are contiguous value ranges
and the walk is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 2048
EXACT_LIMIT = 20000


def order_statistics(long_df: DataFrame, requests: dict, bounds: dict,
                     key: str = "column_name", value: str = "value",
                     bins: int = BINS, exact_limit: int = EXACT_LIMIT,
                     max_passes: int = 80) -> dict:
    """Exact k-th smallest values per key.

    ``long_df``: rows (key, value double) without NULLs.
    ``requests``: key -> iterable of 0-based ranks.
    ``bounds``: key -> (min, max, n) of the non-null values.
    Returns {(key, rank): value}.
    """
    spark = long_df.sparkSession
    result: dict = {}
    brackets = []
    for k, ranks in requests.items():
        lo, hi, n = bounds[k]
        ranks = sorted({int(r) for r in ranks})
        if not ranks:
            continue
        if n is None or n == 0:
            for r in ranks:
                result[(k, r)] = None
            continue
        if lo == hi:
            for r in ranks:
                result[(k, r)] = float(lo)
            continue
        brackets.append({"key": k, "lo": float(lo), "hi": float(hi), "below": 0, "cnt": int(n), "ranks": ranks})

    passes = 0
    while brackets:
        passes += 1
        if passes > max_passes:  # pragma: no cover - needs adversarial floats
            raise RuntimeError("order statistics did not converge")
        rows = []
        for i, b in enumerate(brackets):
            width = (b["hi"] - b["lo"]) / bins if b["cnt"] > exact_limit else 0.0
            if width > 0 and (b["lo"] + width == b["lo"]):
                width = 0.0
            rows.append((i, b["key"], b["lo"], b["hi"], width))
        br = spark.createDataFrame(rows, "bid int, bkey string, lo double, hi double, w double")
        v = F.col(value)
        joined = long_df.join(
            F.broadcast(br),
            (F.col(key) == F.col("bkey")) & (v >= F.col("lo")) & (v <= F.col("hi")))
        bucket = F.when(F.col("w") > 0,
                        F.least(F.lit(float(bins - 1)), F.floor((v - F.col("lo")) / F.col("w")).cast("double"))
                        ).otherwise(v)
        hist = (joined.groupBy("bid", bucket.alias("bucket"))
                .agg(F.count(F.lit(1)).alias("c"), F.min(v).alias("mn"), F.max(v).alias("mx"))
                .collect())
        per: dict = {}
        for r in hist:
            per.setdefault(r["bid"], []).append((r["bucket"], r["c"], r["mn"], r["mx"]))
        nxt = []
        for i, b in enumerate(brackets):
            groups = sorted(per.get(i, []))
            value_mode = rows[i][4] == 0.0
            running = b["below"]
            gi = 0
            opened: dict = {}
            for rank in b["ranks"]:
                while gi < len(groups) and running + groups[gi][1] <= rank:
                    running += groups[gi][1]
                    gi += 1
                if gi >= len(groups):  # pragma: no cover - rank beyond n
                    result[(b["key"], rank)] = None
                    continue
                _, c, mn, mx = groups[gi]
                if value_mode or mn == mx:
                    result[(b["key"], rank)] = float(mn)
                else:
                    nb = opened.get(gi)
                    if nb is None:
                        nb = {"key": b["key"], "lo": float(mn), "hi": float(mx), "below": running,
                              "cnt": int(c), "ranks": []}
                        opened[gi] = nb
                        nxt.append(nb)
                    nb["ranks"].append(rank)
        brackets = nxt
    return result


def interpolated_quantiles(long_df: DataFrame, probs: list[float], bounds: dict,
                           key: str = "column_name", value: str = "value") -> dict:
    """Linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``).

    Returns {key: {p: value}}."""
    requests = {}
    plan = {}
    for k, (_, _, n) in bounds.items():
        if not n:
            continue
        ranks = set()
        for p in probs:
            pos = p * (n - 1)
            lo_r, hi_r = math.floor(pos), math.ceil(pos)
            plan[(k, p)] = (pos, lo_r, hi_r)
            ranks.update((lo_r, hi_r))
        requests[k] = ranks
    stats = order_statistics(long_df, requests, bounds, key=key, value=value)
    out: dict = {k: {} for k in bounds}
    for (k, p), (pos, lo_r, hi_r) in plan.items():
        a, b = stats[(k, lo_r)], stats[(k, hi_r)]
        out[k][p] = a if lo_r == hi_r else a + (b - a) * (pos - lo_r)
    for k, (_, _, n) in bounds.items():
        if not n:
            out[k] = {p: None for p in probs}
    return out


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], bounds: dict | None = None) -> dict:
    """Exact interpolated quantiles of numeric columns (NaN folded to NULL)."""
    from .columns import long_form, num

    if not cols:
        return {}
    if bounds is None:
        aggs = []
        for c in cols:
            aggs += [F.min(num(c)).alias(f"mn_{c}"), F.max(num(c)).alias(f"mx_{c}"), F.count(num(c)).alias(f"n_{c}")]
        row = df.agg(*aggs).collect()[0]
        bounds = {c: (row[f"mn_{c}"], row[f"mx_{c}"], row[f"n_{c}"]) for c in cols}
    return interpolated_quantiles(long_form(df, cols), probs, bounds)
