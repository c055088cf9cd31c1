"""Shared primitives: exact order statistics, running sums, skew-safe fills,
exact kNN -- each checked against a brute-force local answer."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.cumulative import cumulative
from tablewright.functions import neighbors
from tablewright.functions.neighbors import knn_impute, nearest
from tablewright.functions.selection import column_quantiles, order_statistics
from tablewright.functions.ordered import directional_fill, ranked


def test_quantiles_match_pandas_with_ties_and_tails(spark):
    rng = random.Random(7)
    vals = [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(3000)] + [1e12, -1e9] + [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(v, float(i % 5)) for i, v in enumerate(vals)], "x double, y double")
    q = column_quantiles(df, ["x", "y"], [0.1, 0.25, 0.5, 0.75, 0.99])
    s = pd.Series(vals)
    for p in [0.1, 0.25, 0.5, 0.75, 0.99]:
        assert math.isclose(q["x"][p], s.quantile(p), rel_tol=1e-12, abs_tol=1e-12)


def test_order_statistics_small_exact_limit(spark):
    vals = list(range(1000, 0, -1))
    long = spark.createDataFrame([("k", float(v)) for v in vals], "column_name string, value double")
    out = order_statistics(long, {"k": [0, 499, 999]}, {"k": (1.0, 1000.0, 1000)}, bins=4, exact_limit=10)
    assert out[("k", 0)] == 1.0 and out[("k", 499)] == 500.0 and out[("k", 999)] == 1000.0


def test_cumulative_matches_cumsum(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.randint(0, 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, o double, v long")
    got = {r["id"]: r["cum_v"] for r in cumulative(df, "o", ["v"], buckets=8).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "o", "v"]).sort_values("o")
    pdf["c"] = pdf["v"].cumsum()
    assert all(got[i] == c for i, c in zip(pdf["id"], pdf["c"]))


def _gaps(seed=3, n=3000):
    """A key held by a third of the rows, null keys, ties in the order."""
    rng = random.Random(seed)
    keys = ["hot", "hot", None, "a", "b", "c"]
    return [(i, rng.choice(keys), rng.choice(["m", "n", None, f"t{rng.randint(0, 400):04d}"]),
             None if rng.random() < 0.6 else float(rng.randint(0, 9))) for i in range(n)]


def _filled(rows, keyed, order, direction):
    """Rows of one moment see each other's values, the largest goes on."""
    out, groups = {}, {}
    for r in rows:
        groups.setdefault(r[1] if keyed else 0, []).append(r)
    for group in groups.values():
        moments = {}
        for r in group:
            moments.setdefault(order(r), []).append(r)
        last = None
        for at in sorted(moments, reverse=direction == "backward"):
            have = sorted(r[3] for r in moments[at] if r[3] is not None)
            last = have[-1] if have else last
            for r in moments[at]:
                out[r[0]] = r[3] if r[3] is not None else last
    return out


def test_directional_fill_any_order(spark):
    rows = _gaps()
    df = spark.createDataFrame(rows, "id long, k string, t string, v double").repartition(7)
    text = lambda r: (r[2] is not None, r[2] or "")  # noqa: E731  nulls first
    for direction in ("forward", "backward"):
        for by, key in ((["t", "id"], lambda r: (*text(r), r[0])), (["t"], text)):
            for group in (["k"], None):
                got = {r["id"]: r["v"] for r in directional_fill(df, "v", by, group, direction).collect()}
                assert got == _filled(rows, bool(group), key, direction), (direction, by, group)
    constant = df.withColumn("c", F.lit(1))
    got = {r["id"]: r["v"] for r in directional_fill(constant, "v", ["c"], ["k"]).collect()}
    assert got == _filled(rows, True, lambda r: 0, "forward")
    assert directional_fill(df.limit(0), "v", ["t"], ["k"]).count() == 0


def test_ranked_any_order(spark):
    rows = _gaps(4)
    df = spark.createDataFrame(rows, "id long, k string, t string, v double").repartition(7)
    got = {r["id"]: r["rank"] for r in ranked(df, ["t", "id"], ["k"]).collect()}
    seen = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0])):
        seen[r[1]] = seen.get(r[1], 0) + 1
        assert got[r[0]] == seen[r[1]]
    whole = [r["rank"] for r in ranked(df, [F.col("v").desc()]).orderBy("rank").collect()]
    assert whole == list(range(1, len(rows) + 1))


def _brute(queries, donors, k, total, other_rows):
    """queries, donors: (id, group, values); a missing value is None."""
    out = []
    for qi, qg, q in queries:
        found = []
        for di, dg, d in donors:
            both = [(a, b) for a, b in zip(q, d) if a is not None and b is not None]
            if qg == dg and both and not (other_rows and qi == di):
                square = 0.0
                for a, b in both:
                    square += (a - b) * (a - b)
                found.append((math.sqrt(total / len(both) * square), di))
        out += [(qi, di, dist, i + 1) for i, (dist, di) in enumerate(sorted(found)[:k])]
    return sorted(out)


def _cloud(seed, n, dim, gaps=0.0):
    """Clusters, a value held by a third of the rows, ties on a grid, gaps."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            v = [1.0] * dim
        elif i % 3 == 1:
            v = [float(rng.randint(0, 3)) for _ in range(dim)]
        else:
            v = [rng.choice((0.0, 40.0)) + rng.gauss(0, 1) for _ in range(dim)]
        rows.append((i, rng.choice("ab"), [None if rng.random() < gaps else x for x in v]))
    return rows


@pytest.mark.parametrize("dim,gaps,same_group,other_rows", [(1, 0.0, False, False), (3, 0.0, True, True), (3, 0.3, False, False),
                                                           (6, 0.0, False, True), (4, 0.2, True, False)])
def test_nearest_equals_brute_force(spark, monkeypatch, dim, gaps, same_group, other_rows):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "QUERY_CHUNK", 32)
    monkeypatch.setattr(neighbors, "PAGE_BYTES", 2000)
    donors = _cloud(1, 400, dim, gaps)
    queries = donors if other_rows else _cloud(2, 120, dim, gaps)
    df = lambda rows, name: spark.createDataFrame(
        [(i, g, v) for i, g, v in rows], f"{name} long, grp string, vec array<double>").repartition(3)
    stats = {}
    got = nearest(df(queries, "qid"), df(donors, "did"), 5, dim, total=dim + 1, same_group=same_group, other_rows=other_rows,
                  stats=stats).collect()
    plain = lambda rows: rows if same_group else [(i, "", v) for i, _, v in rows]
    want = _brute(plain(queries), plain(donors), 5, dim + 1, other_rows)
    assert [(r[0], r[1], r[3]) for r in sorted(got)] == [(w[0], w[1], w[3]) for w in want]
    assert all(math.isclose(r[2], w[2], rel_tol=1e-12, abs_tol=1e-12) for r, w in zip(sorted(got), want))
    if gaps == 0.0 and dim < 4:
        assert stats["pairs"] < 0.6 * stats["queries"] * stats["blocks"]


def test_nearest_moves_no_vector_per_pair(spark, monkeypatch):
    """Nothing is pruned here: the rows planned for the second round are chunks by blocks, not queries by blocks."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(400)]
    donors = spark.createDataFrame(rows, "did long, vec array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=24).tolist()) for i in range(200)], "qid long, vec array<double>")
    written, kept = [], neighbors.cut_lineage

    def spy(df):
        out = kept(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(neighbors, "cut_lineage", spy)
    stats = {}
    assert nearest(queries, donors, 3, 24, stats=stats).count() == 600
    assert stats["pairs"] > 0.5 * 200 * stats["blocks"] and max(written) <= 600


def test_nearest_text_ids_and_empty_tables(spark):
    donors = spark.createDataFrame([("b", [0.0]), ("a", [0.0]), ("c", [2.0])], "did string, vec array<double>")
    queries = spark.createDataFrame([("x", [0.5]), ("y", [None])], "qid string, vec array<double>")
    got = [(r["qid"], r["did"], r["rn"]) for r in nearest(queries, donors, 2, 1).collect()]
    assert sorted(got) == [("x", "a", 1), ("x", "b", 2)]
    assert nearest(queries, donors.limit(0), 2, 1).count() == 0
    assert nearest(queries.limit(0), donors, 2, 1).count() == 0


def test_knn_impute_without_a_complete_column(spark):
    """Every numeric column has gaps; a row that shares nothing gets the mean."""
    rows = _cloud(5, 200, 3, 0.25) + [(900, "a", [None, None, None])]
    df = spark.createDataFrame([(i, *v) for i, _, v in rows], "id long, x double, y double, z double")
    out, info = knn_impute(df, "z", "id", ["x", "y", "z"], k=5)
    got = {r["id"]: r["z"] for r in out.collect()}
    have = [(i, "", v[:2]) for i, _, v in rows if v[2] is not None]
    value = {i: v[2] for i, _, v in rows}
    near = _brute([(i, "", v[:2]) for i, _, v in rows if v[2] is None], have, 5, 3, False)
    mean = sum(value[i] for i, *_ in have) / len(have)
    for i, _, v in rows:
        chosen = [value[d] for q, d, *_ in near if q == i]
        want = v[2] if v[2] is not None else sum(chosen) / len(chosen) if chosen else mean
        assert math.isclose(got[i], want, rel_tol=1e-9)
    assert info["filled"] == len(rows) - len(have) and math.isclose(got[900], mean, rel_tol=1e-9)

def test_running_sum_buckets_grow_with_rows():
    from tablewright.functions.cumulative import BUCKET_ROWS, MIN_BUCKETS, bucket_count
    assert bucket_count(0) == bucket_count(10) == MIN_BUCKETS
    assert bucket_count(1000 * BUCKET_ROWS + 1) == 1001


def test_frequent_values_and_cardinalities(spark):
    """Long values that share their head, ties, nulls, an empty text."""
    from tablewright.functions.cardinality import HEAD, beyond, cardinalities, frequent_values

    rng = random.Random(4)
    long_values = ["z" * HEAD + s for s in "dcba"] + ["z" * HEAD]
    rows = [(rng.choice(["", "a", "b", None]), rng.choice(long_values), f"value {i}", 7, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d int, e string").repartition(4)
    cols = df.columns
    counts = {c: pd.Series([r[i] for r in rows]).dropna().astype(str).value_counts() for i, c in enumerate(cols)}
    got = {r["column_name"]: r["cardinality"] for r in cardinalities(df, cols).collect()}
    assert got == {c: len(v) for c, v in counts.items() if len(v)}
    for k in (1, 3):
        want = sorted((c, v, n) for c, s in counts.items() for v, n in sorted(s.items(), key=lambda x: (-x[1], x[0]))[:k])
        assert sorted((r[0], r[1], r[2]) for r in frequent_values(df, cols, k).collect()) == want
    assert beyond(df, cols, 3) == {"b", "c"} and beyond(df, cols, 50) == {"c"}
    assert beyond(df.limit(0), cols, 1) == set()


def test_pair_sums_equal_pandas(spark):
    """Gaps, constants, an infinite value; 200 columns in one plan."""
    from tablewright.operators.profile import correlation_matrix

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 200)) + np.arange(200) * 1e3
    x[:, 1] = 2 * x[:, 0] + rng.normal(size=300) * 0.01
    x[:, 2] = 5.0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 3] = np.nan
    x[0, 4] = np.inf
    cols = [f"c{i}" for i in range(200)]
    pdf = pd.DataFrame(x, columns=cols)
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r[0], r[1]): r[2] for r in correlation_matrix(df, cols).collect()}
    want = pdf.replace([np.inf], np.nan).corr().fillna(0.0).round(6)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            # the infinite value counts in the pairs whose other side is there
            endless = "c4" in (a, b) and not np.isnan(x[0, i]) and not np.isnan(x[0, j])
            expect = 0.0 if endless or {"c2", "c3"} & {a, b} else want.iloc[i, j]
            assert abs(got[a, b] - expect) <= 2e-6, (a, b)
    assert len(got) == 200 * 200


def test_split_brings_no_class_into_one_task(spark, monkeypatch):
    from tablewright.operators import split as SP

    plans = []
    kept = SP.cut_lineage

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df)

    monkeypatch.setattr(SP, "cut_lineage", spy)
    df = spark.range(2000).withColumn("c", F.col("id") % 3)
    train, test = SP.split(df, 0.2, 42, ["id"])
    assert (train.count(), test.count()) == (1600, 400)
    train, test = SP.split(df, 0.2, 42, ["id"], "c")
    assert test.groupBy("c").count().agg(F.max("count"), F.min("count")).first()[:] == (134, 133)
    joins = [line for p in plans for line in p.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and all("strategy=broadcast" in j for j in joins)
