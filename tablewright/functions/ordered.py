"""Scans in the order of any key: fills, ranks and dense numbers.

Rows are range-partitioned (by Spark's sampled boundaries) on the whole order,
group columns first, so that a group or a moment of any size is dealt out over
tasks; the order columns may be of any type, equal or null.  A task scans its
range once, batch by batch, and what goes on from range to range is one row per
range: the carry of the group that the range ends in.  The same plan holds at
every size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package

_OWN = "__part int, __at bigint, __open boolean"


def group_hash(cols: list[str]) -> list[Column]:
    """128 bits of the group columns; nulls are equal to each other alone."""
    flags = [F.col(c).isNull() for c in cols]
    values = [*[F.col(c) for c in cols], *flags] or [F.lit(0)]
    return [F.xxhash64(*values).alias("__g1"), F.xxhash64(F.lit("second"), *values).alias("__g2")]


def _dealt(df: DataFrame, group: list[str], order: list[Column], desc: bool = False) -> DataFrame:
    """Ranges of (group, order); rows that agree in both are dealt out by where
    they come from."""
    told = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    work = df.select("*", *group_hash(group), F.xxhash64(*told).alias("__tie"),
                     F.spark_partition_id().alias("__from"))
    by = [*[F.col(c).asc() for c in group], *order, F.col("__tie"), F.col("__from")]
    return work.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie", "__from")


def _scan(dealt: DataFrame, extra: T.StructType, make) -> DataFrame:
    """``make()`` gives ``fn(batch, starts) -> arrays`` of the extra columns,
    where ``starts`` marks the rows that begin a group."""
    import pyarrow as pa

    ship_package(dealt.sparkSession)
    names = [*dealt.columns, *extra.names, "__part", "__at", "__open"]

    def run(batches):
        from pyspark import TaskContext

        part, fn, at, last, first = TaskContext.get().partitionId(), make(), 0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = np.column_stack([batch.column(c).to_numpy() for c in ("__g1", "__g2")])
            starts = np.ones(n, bool)
            starts[1:] = (g[1:] != g[:-1]).any(axis=1)
            starts[0] = last is None or bool((g[0] != last).any())
            first = g[0] if first is None else first
            open_ = (g == first).all(axis=1)  # the group may have begun in an earlier range
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *fn(batch, starts), pa.array(np.full(n, part, np.int32)),
                 pa.array(np.arange(at, at + n)), pa.array(open_)], names)
            at, last = at + n, g[-1]

    out = T.StructType(dealt.schema.fields + extra.fields + T.StructType.fromDDL(_OWN).fields)
    return cut_lineage(dealt.mapInArrow(run, out))


def _carried(scanned: DataFrame, value: str, how) -> DataFrame:
    """Per range and group what earlier ranges that end in the group hand on:
    as many rows as ranges, so it is broadcast."""
    edges = scanned.groupBy("__part").agg(F.max_by(F.struct("__g1", "__g2", value), "__at").alias("e")).select("__part", "e.*")
    first = scanned.where("__at = 0").select("__part", "__g1", "__g2")
    every = first.withColumn("__v", F.lit(None).cast(scanned.schema[value].dataType)).withColumn("__edge", F.lit(0)) \
        .unionByName(edges.withColumnRenamed(value, "__v").withColumn("__edge", F.lit(1)))
    # a range's own first row comes before its edge
    before = Window.partitionBy("__g1", "__g2").orderBy("__part", "__edge").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("__carry", how(F.col("__v")).over(before)).where("__edge = 0") \
        .select("__part", "__carry")


def _finish(scanned: DataFrame, carried: DataFrame) -> DataFrame:
    out = scanned.join(F.broadcast(carried), "__part", "left")
    return out.withColumn("__carry", F.when(F.col("__open"), F.col("__carry")))


def directional_fill(df: DataFrame, col: str, order_by: list[str], partition_by: list[str] | None = None,
                     direction: str = "forward") -> DataFrame:
    """Replace NULLs in ``col`` with the previous (forward) or next (backward)
    non-null value in ``order_by`` order within ``partition_by``; leading
    (trailing) NULLs stay NULL.  Rows of one moment see each other's values, the
    largest of which goes on."""
    import pyarrow as pa

    group = list(partition_by or [])
    moment = [F.col(c).asc() if direction == "forward" else F.col(c).desc() for c in order_by]
    dealt = _dealt(df, group, [*moment, F.col(col).asc_nulls_last()])

    def make():
        held = [None]

        def fn(batch, starts):
            values = batch.column(col)
            n = len(values)
            if held[0] is None:
                held[0] = pa.nulls(1, values.type)
            # place 0 holds what the group had at the end of the batch before
            joined = pa.concat_arrays([held[0], values])
            there = ~values.is_null().to_numpy(zero_copy_only=False)
            place = np.arange(1, n + 1)
            begun = np.maximum.accumulate(np.where(starts, place, 0))
            seen = np.maximum.accumulate(np.where(there, place, 0))
            source = np.where(seen >= begun, seen, 0)
            known = (source > 0) | (begun == 0)
            got = joined.take(pa.array(source, mask=~known))
            held[0] = got.slice(n - 1, 1)
            return [got]
        return fn

    extra = T.StructType([T.StructField("__fill", df.schema[col].dataType)])
    scanned = _scan(dealt, extra, make)
    out = _finish(scanned, _carried(scanned, "__fill", lambda v: F.last(v, ignorenulls=True)))
    return out.withColumn(col, F.coalesce("__fill", "__carry")).select(*df.columns)


def ranked(df: DataFrame, order_by: list, partition_by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` and each row's 1-based place in ``order_by`` (names or columns)
    within ``partition_by``; rows that agree in all of it are numbered in some
    order."""
    import pyarrow as pa

    order = [F.col(c).asc() if isinstance(c, str) else c for c in order_by]
    dealt = _dealt(df, list(partition_by or []), order)

    def make():
        before = [0]

        def fn(batch, starts):
            place = np.arange(len(starts))
            begun = np.maximum.accumulate(np.where(starts, place, -1))
            rank = np.where(begun >= 0, place - begun + 1, place + 1 + before[0])
            before[0] = int(rank[-1])
            return [pa.array(rank)]
        return fn

    scanned = _scan(dealt, T.StructType.fromDDL("__rank bigint"), make)
    out = _finish(scanned, _carried(scanned, "__rank", F.sum))
    return out.withColumn(name, F.col("__rank") + F.coalesce("__carry", F.lit(0))).select(*df.columns, name)
