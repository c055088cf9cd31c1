"""Distinct and frequent values without raw text in a cardinality shuffle.

* :func:`beyond`: one scan builds a mergeable theta sketch per column.  A sketch
  holds at least ``2^LG_ENTRIES`` distinct hashes before it estimates, and
  collisions only lower its count, so a column above a limit of at most
  :data:`SURE` is certainly above it and can be left out.
* :func:`hashed_counts`: exact counts per value, grouped by a 128-bit hash and
  the value's first :data:`HEAD` characters.
* :func:`frequent_values`: the most frequent values.  Counts and heads decide;
  only values longer than their head that may be among the first are read again
  in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import long_form

LG_ENTRIES = 12
SURE = 1 << (LG_ENTRIES - 1)
HEAD = 32
#: Values read again in full are looked up by broadcast up to this many.
BROADCAST_VALUES = 10_000


def beyond(df: DataFrame, cols: list[str], limit: int) -> set:
    """Columns that certainly hold more than ``limit`` distinct values."""
    if limit > SURE:
        raise ValueError(f"the sketch is sure up to {SURE} values, not {limit}")
    if not cols:
        return set()
    sketch = [F.theta_sketch_estimate(F.theta_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string"))),
                                                         LG_ENTRIES)).alias(f"s{i}") for i, c in enumerate(cols)]
    row = df.agg(*sketch).first()
    return {c for i, c in enumerate(cols) if row[f"s{i}"] > limit}


def _hashed(df: DataFrame, cols: list[str]) -> DataFrame:
    v = F.col("value")
    return long_form(df, cols, cast="string").select(
        "column_name", F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2"), "value")


def hashed_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, h1, h2, head, whole, count) of the non-null values as text;
    ``whole`` says that the head is all of the value."""
    v = F.col("value")
    rows = _hashed(df, cols).select("column_name", "h1", "h2", F.substring(v, 1, HEAD).alias("head"),
                                    (F.length(v) <= HEAD).alias("whole"))
    return rows.groupBy("column_name", "h1", "h2", "head", "whole").agg(F.count(F.lit(1)).alias("count"))


def cardinalities(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, cardinality): exact distinct non-null values."""
    return _hashed(df, cols).select("column_name", "h1", "h2").distinct().groupBy("column_name").agg(
        F.count(F.lit(1)).alias("cardinality"))


def distinct_counts(df: DataFrame, cols: list[str]) -> dict:
    """{column: distinct non-null values}, one scan for all columns."""
    out = {c: 0 for c in cols}
    if cols:
        out.update({r["column_name"]: r["cardinality"] for r in cardinalities(df, cols).collect()})
    return out


def frequent_values(df: DataFrame, cols: list[str], k: int, counts: DataFrame | None = None) -> DataFrame:
    """(column_name, value, count, rank): the ``k`` most frequent values of each
    column, equal counts by value."""
    counts = hashed_counts(df, cols) if counts is None else counts
    first = Window.partitionBy("column_name").orderBy(F.col("count").desc(), "head")
    # rank, not row number: values with one count and head are told apart below
    near = cut_lineage(counts.withColumn("r", F.rank().over(first)).where(F.col("r") <= k).drop("r"))
    out = near.where("whole").select("column_name", F.col("head").alias("value"), "count")
    n_long = near.where("not whole").count()
    if n_long:
        wanted = near.where("not whole").select("column_name", "h1", "h2", "count")
        if n_long <= BROADCAST_VALUES:
            wanted = F.broadcast(wanted)
        full = _hashed(df, cols).join(wanted, ["column_name", "h1", "h2"]).select("column_name", "value", "count").distinct()
        out = out.unionByName(full)
    order = Window.partitionBy("column_name").orderBy(F.col("count").desc(), "value")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
