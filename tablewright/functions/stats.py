"""Shared aggregate plans: moments, value counts, modes.

All of them are single ``agg`` / ``groupBy`` jobs with partial (map-side)
aggregation; the only thing that reaches the driver is one row per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import as_text, long_form, num
from .selection import interpolated_quantiles


def moments_row(df: DataFrame, cols: list[str]) -> dict:
    """One aggregate job: count/mean/std/min/max/skew/kurt per column.

    Returns {col: {n, mean, std, std_pop, min, max, g1, g2}} (Spark's raw
    population skewness / excess kurtosis; corrections applied by callers)."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = num(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_samp(x).alias(f"sd{i}"), F.stddev_pop(x).alias(f"sdp{i}"),
                 F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.skewness(x).alias(f"g1_{i}"), F.kurtosis(x).alias(f"g2_{i}")]
    row = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        out[c] = {"n": row[f"n{i}"], "mean": row[f"mean{i}"], "std": row[f"sd{i}"],
                  "std_pop": row[f"sdp{i}"], "min": row[f"mn{i}"], "max": row[f"mx{i}"],
                  "g1": row[f"g1_{i}"], "g2": row[f"g2_{i}"]}
    return out


def sample_skewness(n, g1, std_pop):
    """pandas / DuckDB bias-corrected skewness from Spark's population g1."""
    if n is None or n < 3:
        return None
    if std_pop == 0 or g1 is None:
        return 0.0
    return g1 * (n * (n - 1)) ** 0.5 / (n - 2)


def sample_kurtosis(n, g2, std_pop):
    """pandas / DuckDB bias-corrected excess kurtosis from population g2."""
    if n is None or n < 4:
        return None
    if std_pop == 0 or g2 is None:
        return 0.0
    return ((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * g2 + 6)


def profile_numeric(df: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75)) -> dict:
    """Moments + exact interpolated quantiles per column (decision table)."""
    m = moments_row(df, cols)
    bounds = {c: (m[c]["min"], m[c]["max"], m[c]["n"]) for c in cols}
    q = interpolated_quantiles(long_form(df, cols), list(probs), bounds) if cols else {}
    for c in cols:
        m[c]["q"] = q.get(c, {})
    return m


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, count) over non-null values of ``cols`` (as text).

    One Expand + one hash aggregate; a hot value is pre-aggregated per map
    task so skew never reaches a single reducer."""
    long = long_form(df, cols, cast="string")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """Top-k per column by count desc, value asc.

    ``row_number() <= k`` is planned as a partial WindowGroupLimit before the
    shuffle, so only k rows per column per map task move."""
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mode_values(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value per column, ties -> smallest (as text)."""
    if not cols:
        return {}
    rows = top_values(value_counts(df, cols), 1).collect()
    return {r["column_name"]: r["value"] for r in rows}


def typed_modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value per column in the column's own type (ties ->
    smallest in that type's order). One grouping job per column type
    family; numeric columns order numerically."""
    out = {}
    if not cols:
        return out
    longs = []
    for c in cols:
        longs.append(df.select(F.lit(c).alias("column_name"), F.col(c).alias("v")).where(F.col("v").isNotNull()))
    # group by column type so the union is well typed
    by_type: dict = {}
    for c, part in zip(cols, longs):
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(part)
    for parts in by_type.values():
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        counts = u.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("count"))
        w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("v").asc())
        for r in counts.withColumn("rk", F.row_number().over(w)).where("rk = 1").collect():
            out[r["column_name"]] = r["v"]
    return out


__all__ = ["moments_row", "profile_numeric", "value_counts", "top_values", "mode_values",
           "typed_modes", "sample_skewness", "sample_kurtosis", "as_text"]
