"""Exact k-nearest-neighbour search through an index of blocks.

Distances are Euclidean over the coordinates that both rows have, scaled by
``total / shared`` (a plain Euclidean distance where nothing is missing).

1. Rows that agree in every coordinate share their distances, so only the ``k``
   smallest ids of each vector stay, and each distinct query is searched once:
   a value held by a third of the rows is as cheap as any other.
2. Every donor goes to its nearest pivot (a bounded sample of the donors).  A
   range partitioning by (group, missing pattern, pivot, radius) deals the
   donors out, also within a large cell, and packs them into blocks of at most
   :data:`BLOCK_ROWS` rows.  A block knows its bounding box and its range of
   radii around the pivot.
3. A lower bound of the distance to a block: the scaled distance to its box
   over the shared coordinates, and, where nothing is missing on either side,
   the triangle inequality at the pivot.  Each query first visits the block
   with the smallest bound; its k-th distance there limits the blocks it still
   has to visit.  Both rounds together see every possible neighbour.
4. A visit is one matrix product of a block and its queries, which finds the
   candidates; their distances are then summed coordinate by coordinate.  The first
   round co-groups a block with its queries.  The second packs up to
   :data:`QUERY_CHUNK` queries into a chunk, and co-groups a chunk with up to about
   :data:`SLICE_BLOCKS` of the blocks that any of them has to visit, so that a
   query moves once per slice and a block once per chunk, never once per pair.

Block bounds go through the driver in pages of at most :data:`PAGE_BYTES`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package

BLOCK_ROWS, QUERY_CHUNK, SLICE_BLOCKS = 512, 4096, 32
MAX_PIVOTS, PAGE_BYTES = 1024, 32 << 20
#: Allowance for rounding in bounds, relative to the lengths involved.
SLACK = 1e-9


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix; a missing coordinate is NaN."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(matrix: np.ndarray):
    import pyarrow as pa

    n, dim = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * dim, dim, dtype=np.int32), pa.array(matrix.ravel()))


def _patterns(matrix: np.ndarray) -> list[str]:
    """Which coordinates each row has, as text of 0 and 1."""
    known = np.where(np.isnan(matrix), ord("0"), ord("1")).astype(np.uint8)
    return [r.tobytes().decode() for r in known]


class Bounds:
    """Lower bounds of the distances from queries to a page of blocks."""

    def __init__(self, rows: list, pivots: np.ndarray, total: float):
        self.ids = np.array([r["block"] for r in rows], np.int64)
        self.groups = np.array([r["grp"] for r in rows], object)
        self.low, self.high = (np.array([r[c] for r in rows], np.float64) for c in ("lo", "hi"))
        self.known = ~np.isnan(self.low)
        self.full = self.known.all(axis=1)
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.inner, self.outer = (np.array([r[c] for r in rows], np.float64) for c in ("inner", "outer"))
        self.pivots, self.total = pivots, total
        self.length = float(np.linalg.norm(pivots, axis=1).max(initial=0.0))

    def of(self, queries: np.ndarray, groups: np.ndarray) -> np.ndarray:
        n = len(queries)
        box, shared = np.zeros((n, len(self.ids))), np.zeros((n, len(self.ids)))
        for j in range(queries.shape[1]):
            q = queries[:, j, None]
            both = ~np.isnan(q) & self.known[None, :, j]
            gap = np.maximum(np.maximum(self.low[None, :, j] - q, q - self.high[None, :, j]), 0.0)
            box += np.where(both, gap * gap, 0.0)
            shared += both
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.where(shared > 0, np.sqrt(self.total / shared * box), np.inf)
        whole = ~np.isnan(queries).any(axis=1)
        if whole.any() and self.full.any():
            to_pivot = np.linalg.norm(queries[whole][:, None, :] - self.pivots[None, :, :], axis=2)[:, self.cell]
            ring = np.maximum(np.maximum(self.inner - to_pivot, to_pivot - self.outer), 0.0)
            ring *= np.sqrt(self.total / queries.shape[1])
            bound[whole] = np.where(self.full, np.maximum(bound[whole], ring), bound[whole])
        slack = SLACK * (np.sqrt(np.nansum(queries * queries, axis=1)) + self.length)
        bound = np.maximum(bound * (1 - SLACK) - slack[:, None], 0.0)
        bound[groups[:, None] != self.groups[None, :]] = np.inf
        return bound


def _assign(donors: DataFrame, pivots: np.ndarray, fill: np.ndarray, dim: int) -> DataFrame:
    """Pattern, nearest pivot and radius of every donor."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                m = _matrix(part.column("vec"), dim)
                whole = np.where(np.isnan(m), fill, m)
                cell = np.empty(len(m), np.int64)
                square = (pivots * pivots).sum(axis=1)
                cell[:] = (square[None, :] - 2.0 * whole @ pivots.T).argmin(axis=1)
                radius = np.sqrt(((whole - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("grp"), part.column("did"), part.column("vec"), pa.array(_patterns(m), pa.string()),
                     pa.array(cell), pa.array(radius)], ["grp", "did", "vec", "pat", "cell", "radius"])

    out = T.StructType(donors.schema.fields + T.StructType.fromDDL("pat string, cell long, radius double").fields)
    return donors.select(*[f.name for f in donors.schema.fields]).mapInArrow(run, out)


def _pack(assigned: DataFrame, dim: int, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` donors of one group, pattern and pivot."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    did = assigned.schema["did"].dataType
    out = T.StructType(T.StructType.fromDDL(
        "block long, grp string, pat string, cell long, inner double, outer double, lo array<double>, hi array<double>"
    ).fields + [T.StructField("ids", T.ArrayType(did)), T.StructField("vecs", T.ArrayType(T.DoubleType()))])
    schema = to_arrow_schema(out)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "pat", "cell"))))
            cuts = [i for i in range(batch.num_rows) if i == 0 or key[i] != key[i - 1]] + [batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                for at in range(begin, end, rows):
                    part = batch.slice(at, min(rows, end - at))
                    m = _matrix(part.column("vec"), dim)
                    radius = part.column("radius").to_numpy()
                    grp, pat, cell = key[at]
                    # a block has one pattern: a coordinate is missing in all its rows or in none
                    yield pa.RecordBatch.from_pylist(
                        [{"block": number, "grp": grp, "pat": pat, "cell": cell, "inner": radius.min(),
                          "outer": radius.max(), "lo": m.min(axis=0), "hi": m.max(axis=0),
                          "ids": part.column("did").to_pylist(), "vecs": m.ravel()}], schema)
                    number += 1

    order = ["grp", "pat", "cell", "radius"]
    return assigned.repartitionByRange(*order).sortWithinPartitions(*order, "did").mapInArrow(run, out)


def _pages(blocks: DataFrame, dim: int):
    """Bounds of the blocks, in lists of at most PAGE_BYTES."""
    rows = blocks.select("block", "grp", "cell", "inner", "outer", "lo", "hi")
    most, page = max(1, PAGE_BYTES // (16 * dim + 64)), []
    for row in rows.collect() if rows.count() <= most else rows.toLocalIterator():
        page.append(row)
        if len(page) == most:
            yield page
            page = []
    if page:
        yield page


def _plan(queries: DataFrame, bounds: Bounds, dim: int) -> DataFrame:
    """(queries' columns, block, bound): the block of the smallest bound."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                groups = np.array(part.column("grp").to_pylist(), object)
                found = bounds.of(_matrix(part.column("vec"), dim), groups)
                best = found.argmin(axis=1)
                rows = np.flatnonzero(np.isfinite(found[np.arange(len(best)), best]))
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(bounds.ids[best[rows]]), pa.array(found[rows, best[rows]])],
                    [*part.schema.names, "block", "bound"])

    out = T.StructType(queries.schema.fields + T.StructType.fromDDL("block long, bound double").fields)
    return queries.mapInArrow(run, out)


def _chunks(rest: DataFrame, n: int, dim: int) -> DataFrame:
    """Queries of one group that began at near blocks, up to :data:`QUERY_CHUNK` a row."""
    import pyarrow as pa

    qid = rest.schema["qid"].dataType
    out = T.StructType([*T.StructType.fromDDL("chunk long, grp string").fields, T.StructField("qids", T.ArrayType(qid)),
                        *T.StructType.fromDDL("vecs array<double>, reach array<double>, seen array<long>").fields])

    def row(number: int, parts: list):
        from pyspark.sql.pandas.types import to_arrow_schema

        t = pa.Table.from_batches(parts).combine_chunks()
        lists = [_one(t.column(c).combine_chunks()) for c in ("qid", "vec", "reach", "seen")]
        lists[1] = _one(pa.array(_matrix(t.column("vec"), dim).ravel()))
        return pa.RecordBatch.from_arrays([pa.array([number]), t.column("grp").combine_chunks().slice(0, 1), *lists],
                                          schema=to_arrow_schema(out))

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            grp = batch.column("grp").to_pylist()
            at = 0
            while at < batch.num_rows:
                if held and (size == QUERY_CHUNK or held[0].column("grp")[0].as_py() != grp[at]):
                    yield row(number, held)
                    number, held, size = number + 1, [], 0
                end = at
                while end < batch.num_rows and grp[end] == grp[at] and end - at < QUERY_CHUNK - size:
                    end += 1
                held.append(batch.slice(at, end - at))
                size, at = size + end - at, end
        if held:
            yield row(number, held)

    order = ["grp", "seen", "qid"]
    ranges = max(1, n // (4 * QUERY_CHUNK))
    return rest.select("grp", "qid", "vec", "reach", "seen").repartitionByRange(ranges, *order) \
        .sortWithinPartitions(*order).mapInArrow(run, out)


def _one(values):
    """A list column of one row."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _reached(bounds: Bounds, q: np.ndarray, grp: str, reach: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which of the blocks each query of a group has to visit in the second round."""
    out = np.zeros((len(q), len(bounds.ids)), bool)
    for at in range(0, len(q), 64):
        part = slice(at, at + 64)
        found = bounds.of(q[part], np.full(len(q[part]), grp, object))
        out[part] = np.isfinite(found) & (found <= reach[part, None]) & (bounds.ids[None, :] != seen[part, None])
    return out


def _wanted(chunks: DataFrame, bounds: Bounds, dim: int) -> DataFrame:
    """(chunk, block, pairs): the blocks that any query of a chunk has to visit."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, grp, q, reach, seen = _queries(batch.slice(i, 1), dim)
                pairs = _reached(bounds, q, grp, reach, seen).sum(axis=0)
                cols = np.flatnonzero(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols), chunk)), pa.array(bounds.ids[cols]),
                                                  pa.array(pairs[cols])], ["chunk", "block", "pairs"])

    return chunks.mapInArrow(run, "chunk long, block long, pairs long")


def _queries(row, dim: int) -> tuple:
    """Chunk, group, vectors, reach and seen block of a chunk's queries."""
    reach, seen = (row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("reach", "seen"))
    return (row.column("chunk")[0].as_py(), row.column("grp")[0].as_py(), _matrix(row.column("vecs"), dim), reach, seen)


def _visit_slices(chunks: DataFrame, wanted: DataFrame, blocks: DataFrame, n_blocks: int, pivots: np.ndarray, k: int,
                  dim: int, total: float) -> DataFrame:
    """The k nearest donors of each query of a chunk in each slice of its blocks: (qid, did, dist)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    slices = -(-n_blocks // SLICE_BLOCKS)
    wanted = wanted.select("chunk", F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice"), "block")
    left = chunks.join(wanted.select("chunk", "slice").distinct(), "chunk")
    right = wanted.join(blocks, "block").withColumnsRenamed({"chunk": "to", "slice": "part"})
    out = T.StructType([T.StructField("qid", chunks.schema["qids"].dataType.elementType),
                        T.StructField("did", blocks.schema["ids"].dataType.elementType), T.StructField("dist", T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(asked, given):
        if not asked.num_rows or not given.num_rows:
            return schema.empty_table()
        asked = asked.combine_chunks().to_batches()[0]
        _, grp, q, reach, seen = _queries(asked, dim)
        rows = given.select(["block", "grp", "cell", "inner", "outer", "lo", "hi"]).to_pylist()
        used, cells = np.unique([r["cell"] for r in rows], return_inverse=True)
        for r, cell in zip(rows, cells):
            r["cell"] = cell
        visits = _reached(Bounds(rows, pivots[used], total), q, grp, reach, seen)
        found, ids = [], []
        for j in range(given.num_rows):
            mine = np.flatnonzero(visits[:, j])
            held = given["ids"][j].values
            at, col, dist = _nearest_rows(q[mine], _matrix(given["vecs"].slice(j, 1), dim), held, k, dim, total)
            found.append((mine[at], dist))
            ids.append(held.take(pa.array(col)))
        at, dist = (np.concatenate(x) for x in zip(*found))
        ids = pa.concat_arrays(ids)
        order = _first(at, dist, ids, k)
        return pa.Table.from_arrays([asked.column("qids").flatten().take(pa.array(at[order])), ids.take(pa.array(order)),
                                     pa.array(dist[order])], schema=schema)

    return left.groupBy("chunk", "slice").cogroup(right.groupBy("to", "part")).applyInArrow(run, out)


def _first(rows: np.ndarray, dist: np.ndarray, ids, k: int) -> np.ndarray:
    """The places of each row's first k entries by distance, equal ones by id."""
    tie = np.argsort(np.array(ids.to_pylist()), kind="stable").argsort(kind="stable") if len(ids) else np.zeros(0, int)
    order = np.lexsort((tie, dist, rows))
    starts = np.searchsorted(rows[order], rows[order], side="left")
    return order[np.arange(len(order)) - starts < k]


def _nearest_rows(q: np.ndarray, d: np.ndarray, ids, k: int, dim: int, total: float) -> tuple:
    """(query rows, donor rows, distances) of the k nearest of every query, in order."""
    if not len(q):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    rows, cols = [], []
    for at in range(0, len(q), 256):
        r, c = _closest(q[at:at + 256], d, k)
        rows.append(r + at)
        cols.append(c)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    square, shared = np.zeros(len(rows)), np.zeros(len(rows))
    for j in range(dim):  # in coordinate order, as a plain sum would
        gap = q[rows, j] - d[cols, j]
        known = ~np.isnan(gap)
        square += np.where(known, gap * gap, 0.0)
        shared += known
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.sqrt(total / shared * square)
    tie = np.argsort(np.array(ids.to_pylist()), kind="stable").argsort(kind="stable")[cols]
    order = np.lexsort((tie, dist, rows))
    order = order[shared[order] > 0]
    starts = np.searchsorted(rows[order], rows[order], side="left")
    order = order[np.arange(len(order)) - starts < k]
    return rows[order], cols[order], dist[order]


def _closest(queries: np.ndarray, donors: np.ndarray, k: int):
    """(query rows, donor rows) that hold the k nearest of every query, by one
    matrix product with room for its rounding."""
    has_q, has_d = ~np.isnan(queries), ~np.isnan(donors)
    q, d = np.where(has_q, queries, 0.0), np.where(has_d, donors, 0.0)
    near = (q * q) @ has_d.T + has_q @ (d * d).T - 2.0 * q @ d.T
    if near.shape[1] > k:
        last = np.partition(near, k - 1, axis=1)[:, k - 1]
    else:
        last = np.full(len(q), np.inf)
    room = SLACK * ((q * q).sum(axis=1) + (d * d).sum(axis=1).max())
    return np.nonzero(near <= (last + room)[:, None])


def _visit(pairs: DataFrame, blocks: DataFrame, k: int, dim: int, total: float) -> DataFrame:
    """The k nearest donors of each (query, block) pair: (qid, did, dist, block)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    pairs = cut_lineage(pairs.select("qid", "vec", "block"))
    load = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_CHUNK)).cast("long").alias("chunks"))
    load = cut_lineage(load)
    left = pairs.join(load, "block").withColumn("chunk", F.pmod(F.xxhash64("qid"), "chunks")).drop("chunks")
    right = blocks.join(load, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"),
                                                                               F.col("chunks") - 1)))
    right = right.select("block", "chunk", "ids", "vecs")
    out = T.StructType([pairs.schema["qid"], T.StructField("did", blocks.schema["ids"].dataType.elementType),
                        T.StructField("dist", T.DoubleType()), T.StructField("block", T.LongType())])
    schema = to_arrow_schema(out)

    def run(queries, block):
        if not queries.num_rows or not block.num_rows:
            return schema.empty_table()
        q = _matrix(queries.column("vec"), dim)
        d = _matrix(block.column("vecs"), dim)
        ids = block.column("ids").combine_chunks().flatten()
        rows, cols, dist = _nearest_rows(q, d, ids, k, dim, total)
        return pa.Table.from_arrays(
            [queries.column("qid").take(pa.array(rows)), ids.take(pa.array(cols)), pa.array(dist),
             pa.array(np.full(len(rows), block.column("block")[0].as_py()))], schema=schema)

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, out)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "did")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def nearest(queries: DataFrame, donors: DataFrame, k: int, dim: int, total: float | None = None,
            same_group: bool = False, other_rows: bool = False, stats: dict | None = None) -> DataFrame:
    """(qid, did, dist, rn): the ``k`` nearest donors of every query, equal
    distances by donor id.

    ``queries`` has qid and vec (``dim`` doubles, null where missing), ``donors``
    did and vec, both a text column grp under ``same_group`` (donors of the
    query's group only).  ``total`` counts the coordinates of the distance's
    scale (default ``dim``); ``other_rows`` leaves out the donor with the query's
    own id.  A query that shares no coordinate with a donor does not see it.
    ``stats`` receives the blocks and the (query, block) pairs visited."""
    spark = queries.sparkSession
    ship_package(spark)
    want, total = k + 1 if other_rows else k, float(total or dim)
    grp = F.col("grp").cast("string") if same_group else F.lit("")
    known = F.exists("vec", lambda x: x.isNotNull())
    donors = donors.select(F.coalesce(grp, F.lit("")).alias("grp"), "did", "vec")
    # written, so that no plan equates a vector with the columns it is made of (its constraints would multiply)
    asked = cut_lineage(queries.select(F.coalesce(grp, F.lit("")).alias("grp"), "qid", "vec"))
    smallest = Window.partitionBy("grp", "vec").orderBy("did")
    donors = cut_lineage(donors.withColumn("rn", F.row_number().over(smallest)).where(F.col("rn") <= want).drop("rn")).where(known)
    reps = cut_lineage(asked.groupBy("grp", "vec").agg(F.min("qid").alias("qid"))).where(known)
    n, n_asked = donors.count(), reps.count()
    n_pivots = min(MAX_PIVOTS, max(1, n // BLOCK_ROWS))
    sample = donors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(n_pivots).collect()  # at most MAX_PIVOTS rows
    pivots = np.array([[np.nan if x is None else x for x in r["vec"]] for r in sample]).reshape(-1, dim)
    counted = np.maximum((~np.isnan(pivots)).sum(axis=0), 1)
    fill = np.nansum(pivots, axis=0) / counted
    pivots = np.where(np.isnan(pivots), fill, pivots)
    blocks = cut_lineage(_pack(_assign(donors, pivots, fill, dim), dim, BLOCK_ROWS)) if n else None
    if blocks is None:
        return queries.select("qid").limit(0).crossJoin(donors.select("did").limit(0)) \
            .withColumn("dist", F.lit(0.0)).withColumn("rn", F.lit(1))
    pages = lambda: (Bounds(p, pivots, total) for p in _pages(blocks, dim))
    plans = [_plan(reps, b, dim) for b in pages()]
    start = _union(plans)
    if len(plans) > 1:
        start = start.groupBy("grp", "vec", "qid").agg(F.min_by("block", "bound").alias("block"))
    start = cut_lineage(start.select("grp", "vec", "qid", "block"))
    near = cut_lineage(_best(_visit(start, blocks, want, dim, total), want))
    reach = near.groupBy("qid").agg(F.count(F.lit(1)).alias("c"), F.max("dist").alias("d"))
    rest = start.join(reach, "qid", "left").select(
        "grp", "vec", "qid", F.col("block").alias("seen"),
        F.when(F.col("c") >= want, F.col("d")).otherwise(F.lit(float("inf"))).alias("reach"))
    rest = cut_lineage(rest)
    chunks = cut_lineage(_chunks(rest, n_asked, dim))
    wanted = cut_lineage(_union([_wanted(chunks, b, dim) for b in pages()]))
    n_blocks = blocks.count()
    if stats is not None:
        stats |= {"queries": n_asked, "blocks": n_blocks, "pairs": start.count() + (wanted.agg(F.sum("pairs")).first()[0] or 0)}
    later = _visit_slices(chunks, wanted, blocks, n_blocks, pivots, want, dim, total)
    found = _best(near.select("qid", "did", "dist").unionByName(later), want)
    of = asked.join(reps.select("grp", "vec", F.col("qid").alias("rep")), ["grp", "vec"]).select("qid", "rep")
    out = of.join(found.select(F.col("qid").alias("rep"), "did", "dist", "rn"), "rep").drop("rep")
    if other_rows:
        out = _best(out.where(F.col("qid") != F.col("did")).drop("rn"), k)
    return out.select("qid", "did", "dist", "rn")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def knn_impute(df: DataFrame, col: str, key: str, features: list[str] | None = None, k: int = 5,
               all_numeric: bool = False) -> tuple[DataFrame, dict]:
    """Fill NULLs of ``col`` with the mean of its k nearest donors under
    the nan-euclidean distance over all numeric ``features`` (k = min(5,
    rows-1)); a row sharing no coordinate with any donor gets the column
    mean.  ``key`` identifies rows (ties broken by donor key).  Any feature may
    have NULLs; a column that is NULL everywhere is left as it is."""
    from .columns import is_measure, num

    feats = features or [c for c in df.columns if is_measure(df.schema[c].dataType)]
    info = {"skipped": False, "filled": 0, "k": k, "n_features": len(feats)}
    if col not in feats or len(feats) < 2:
        info["skipped"] = True
        return df, info
    st = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(num(col).isNull()).alias("m"), F.avg(num(col)).alias("mean")).first()
    if not st["m"] or st["m"] == st["n"]:
        return df, info
    k = max(1, min(k, st["n"] - 1))
    info["k"] = k
    others = [c for c in feats if c != col]  # a query lacks ``col``, so no distance uses it
    base = df.select(F.col(key).alias("id"), num(col).alias("v"), F.array(*[num(c) for c in others]).alias("vec"))
    donors = base.where(F.col("v").isNotNull())
    found = nearest(base.where(F.col("v").isNull()).select(F.col("id").alias("qid"), "vec"),
                    donors.select(F.col("id").alias("did"), "vec"), k, len(others), total=len(feats))
    fill = (found.join(donors.select(F.col("id").alias("did"), "v"), "did")
            .groupBy(F.col("qid").alias(key)).agg(F.avg("v").alias("__fill")))
    out = (df.join(fill, key, "left").withColumn(col, F.coalesce(num(col), F.col("__fill"), F.lit(st["mean"])))
           .drop("__fill").select(*df.columns))
    info["filled"] = st["m"]
    return out, info
