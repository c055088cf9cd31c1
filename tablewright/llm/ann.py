"""Approximate nearest neighbours by a forest of random-projection trees.

A tree halves its points level by level: each level has a random direction,
each node the median projection of its sample points.  A query descends every
tree; one priority queue shared by all trees holds the branches not taken, by
the worst margin on the way, and the nearest branch of the whole forest is
opened next until the budget of leaves is spent.  The points of the opened
leaves are compared exactly; per block (leaf) the best are kept, then per query.

The forest is fit on a bounded sample (:data:`SAMPLE` vectors by hash); every
row is indexed.  Leaves are cut into blocks of bounded size, so no task gathers
an unbounded group.  Equal vectors are indexed once: of each distinct vector
the ``k + 1`` smallest ids are kept, which is all that any answer can name.

``BUDGET`` is the share of all leaves that a query opens.  It decides recall:
the given vectors have hardly any neighbour structure (64 nearly independent
dimensions), so 0.9 recall needs a large share; clustered vectors need far less.

Largest inner product is searched as nearest direction after the usual
extension by ``sqrt(M^2 - |x|^2)``, which changes nothing for vectors of one
length; a query descends the trees at length M.  M is the largest norm but for
the :data:`LONG` longest vectors, which every query is compared with besides:
a few very long ones would leave the extension alone to decide.
Scores are inner products of the original vectors in double precision, summed
from the first component to the last.

Defined cases: vectors that are null, empty, zero, of another length than most
or hold null or non-finite components take no part, as query or candidate; rows
with a null id take no part; a repeated id counts once per distinct vector;
fewer than ``k`` candidates are all returned; ties go to the smaller id; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import ship_package

from .common import materialize, unit_hash

SAMPLE = 50_000
TREES = 4
LEAF = 256
BUDGET = 0.3
#: Vectors and queries compared in one group.
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 4_096
SEED = 11
#: Longest vectors compared with every query.
LONG = 256


class Forest:
    """Trees of one depth: directions per level, thresholds per node (heap order)."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        self.directions = rng.standard_normal((trees, depth, sample.shape[1]))
        self.thresholds = np.zeros((trees, 2 ** depth - 1))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                proj = sample @ self.directions[t, level]
                order = np.lexsort((proj, node))
                cuts = np.searchsorted(node[order], np.arange(2 ** level - 1, 2 ** (level + 1)))
                for i in range(2 ** level):
                    inside = order[cuts[i]:cuts[i + 1]]
                    if len(inside):
                        self.thresholds[t, 2 ** level - 1 + i] = proj[inside[len(inside) // 2]]
                node = 2 * node + 1 + (proj >= self.thresholds[t, node])

    def projections(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("tld,nd->ntl", self.directions, x)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(n, trees): the leaf of each vector in each tree."""
        proj = self.projections(x)
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (proj[:, t, level] >= self.thresholds[t, node])
            out[:, t] = node - (2 ** self.depth - 1)
        return out

    def search(self, proj: np.ndarray, budget: int) -> list[tuple[int, int]]:
        """The ``budget`` leaves (tree, leaf) nearest to one query's projections."""
        first = 2 ** self.depth - 1
        heap = [(0.0, t, 0, 0) for t in range(self.trees)]
        found: list[tuple[int, int]] = []
        thresholds, trees = self.thresholds, proj.tolist()
        while heap and len(found) < budget:
            cost, t, node, level = heapq.heappop(heap)
            while node < first:
                margin = trees[t][level] - thresholds[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if margin >= 0 else (2 * node + 1, 2 * node + 2)
                level += 1
                heapq.heappush(heap, (max(cost, abs(margin)), t, far, level))
                node = near
            found.append((t, node - first))
        return found


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct (vec_id, v array<double>) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")) \
        .where("vec_id is not null and v is not null")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0)).distinct()


def search(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20,
           trees: int = TREES, leaf: int = LEAF, budget: float = BUDGET, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest other rows found for
    every row whose id satisfies ``is_query(column)``."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = materialize(usable(vectors, key, vector), "vectors")
    best_ids = Window.partitionBy("v").orderBy("vec_id")
    reps = rows.withColumn("at", F.row_number().over(best_ids)).where(F.col("at") <= k + 1) \
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    reps = materialize(reps.select(F.col("ids")[0].alias("rep"), "v", "ids"), "distinct-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n = reps.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = reps.select(norm.alias("norm")).orderBy(F.desc("norm")).limit(LONG + 1).toPandas()["norm"].min()
    long = norm > F.lit(float(longest))

    # the sample is bounded by its rate
    drawn = reps.where(unit_hash(F.lit("sample"), "rep") < min(1.0, sample / n)).select("rep", "v").toPandas()
    drawn = drawn.sort_values("rep")
    points = _extended(np.stack(drawn["v"].to_numpy()) if len(drawn) else np.zeros((0, 1)), longest)
    depth = max(0, min(int(np.ceil(np.log2(n / leaf))), int(np.log2(max(1, len(points)) / 16)) if len(points) else 0))
    forest = Forest(points, trees, depth)
    budget_leaves = max(1, int(np.ceil(budget * trees * 2 ** depth)))
    per_leaf = n / 2 ** depth
    wide = 1
    while wide * 2 <= 2 ** depth and wide * 2 * per_leaf <= BLOCK_ROWS:
        wide *= 2
    chunks = max(1, int(np.ceil(per_leaf / BLOCK_ROWS)))

    asked = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v")
    asked = materialize(asked.join(reps.select("v", "rep"), "v").select("query_id", "rep", "v"), "queries")
    wanted = asked.select("rep", "v").distinct()
    parts = max(1, -(-wanted.count() // BLOCK_QUERIES))
    shared = spark.sparkContext.broadcast(forest)

    def index(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            far = pdf[pdf.pop("long")]
            for part in range(parts if len(far) else 0):
                yield far.assign(tree=-1, block=0, chunk=0, part=part, leaf=0)
            leaves = shared.value.leaves(_extended(np.stack(pdf["v"].to_numpy()), longest))
            for t in range(trees):
                for part in range(parts):
                    yield pdf.assign(tree=t, block=leaves[:, t] // wide, chunk=pdf["rep"] % chunks, part=part,
                                     leaf=leaves[:, t] % wide)

    def route(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy())
            proj = shared.value.projections(_asked(x, longest))
            out = []
            for rep, v, p in zip(pdf["rep"], pdf["v"], proj):
                opened: dict = {}
                out.append((-1, 0, 0, rep % parts, rep, v, [0]))
                for t, l in shared.value.search(p, budget_leaves):
                    opened.setdefault((t, l // wide), []).append(l % wide)
                out += [(t, b, c, rep % parts, rep, v, ls) for (t, b), ls in opened.items() for c in range(chunks)]
            yield pd.DataFrame(out, columns=["tree", "block", "chunk", "part", "rep", "v", "open"])

    place = "tree int, block long, chunk long, part long, rep long, v array<double>"
    indexed = reps.select("rep", "v", long.alias("long")).mapInPandas(index, "rep long, v array<double>, tree int, block long, chunk long, "
                                                  "part long, leaf long")
    routed = wanted.mapInPandas(route, place + ", open array<long>")
    group = ["tree", "block", "chunk", "part"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "rep": [], "score": []})
        return _nearest(left, right, wide, k + 1)

    pairs = indexed.groupBy(*group).cogroup(routed.groupBy(*group)) \
        .applyInPandas(compare, "query long, rep long, score double")
    pairs = materialize(pairs.groupBy("query", "rep").agg(F.max("score").alias("score")), "neighbours")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = pairs.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).drop("at")
    found = found.join(reps.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).drop("at")
    found = asked.select("query_id", F.col("rep").alias("query")).join(found, "query") \
        .where(F.col("query_id") != F.col("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _extended(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(1), 0))
    return np.column_stack([x, rest])


def _asked(x: np.ndarray, longest: float) -> np.ndarray:
    """Queries as directions among the extended points: of their length, extended by 0."""
    x = x / np.abs(x).max(1, keepdims=True)
    return np.column_stack([x * (longest / np.sqrt((x ** 2).sum(1)))[:, None], np.zeros(len(x))])


def _nearest(left: pd.DataFrame, right: pd.DataFrame, wide: int, k: int, step: int = 128) -> pd.DataFrame:
    """The ``k`` best of ``left`` in the open leaves of each query of ``right``."""
    x, leaf, rep = np.stack(left["v"].to_numpy()), left["leaf"].to_numpy(np.int64), left["rep"].to_numpy(np.int64)
    q = np.stack(right["v"].to_numpy())
    opened = np.zeros((len(q), wide), bool)
    for i, ls in enumerate(right["open"]):
        opened[i, np.asarray(ls, np.int64)] = True
    out_q, out_r, out_s = [], [], []
    queries = right["rep"].to_numpy(np.int64)
    for a in range(0, len(q), step):
        near = q[a:a + step] @ x.T
        near[~opened[a:a + step][:, leaf]] = -np.inf
        for i, row in enumerate(near):
            least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            # rounding differs between blocks: take what is as good as the k-th and order it exactly
            at = np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least))) & (row > -np.inf)) \
                if np.isfinite(least) else np.flatnonzero(row > -np.inf)
            out_q.append(np.full(len(at), queries[a + i]))
            out_r.append(rep[at])
            out_s.append(np.cumsum(q[a + i] * x[at], axis=1)[:, -1])
    return pd.DataFrame({"query": np.concatenate(out_q), "rep": np.concatenate(out_r),
                         "score": np.concatenate(out_s)})
