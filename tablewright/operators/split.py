"""Splitting, folds, class weights and minority oversampling (P27-P32, M11,
M15/M16).

Row order comes from ``md5(key:seed)`` (identical in Spark and DuckDB).  The
cut-off hash of every class is found in one distributed scan of (class, hash),
then membership is a plain filter; a dominant class is dealt out over ranges
like any other, and the number of jobs does not depend on the classes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import ranked
from ..session import cut_lineage
from .profile import hash_order

#: Cut-offs are broadcast up to this many classes, else joined by shuffle.
BROADCAST_CLASSES = 1_000_000


def _class_text(group: str | None):
    """A class as text; nulls are a class of their own."""
    return F.coalesce(F.col(group).cast("string"), F.lit("\0")) if group else F.lit("")


def _small(classes: DataFrame) -> DataFrame:
    """One row a class, broadcast if that is bounded: a shuffle would bring all rows of a class into one task."""
    return F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes


def smallest_by_hash(df: DataFrame, key: list[str], seed: int, quotas, group: str | None = None) -> DataFrame:
    """Add boolean ``__sel``: the row is among the smallest hashes of its class,
    as many as its quota.  ``quotas``: a number (no group), {class: number} or a
    frame (__g, quota).  All classes are ranked in one distributed scan of their
    hashes, which gives each class its last hash."""
    spark = df.sparkSession
    if not isinstance(quotas, DataFrame):
        given = quotas if isinstance(quotas, dict) else {"": quotas}
        rows = [("\0" if k is None else str(k), int(q)) for k, q in given.items()]
        quotas = spark.createDataFrame(rows, "__g string, quota long")
    hashes = df.select(_class_text(group).alias("__g"), hash_order(key, seed).alias("__h"))
    last = cut_lineage(ranked(hashes, ["__h"], ["__g"]).join(_small(quotas), "__g").where(F.col("rank") <= F.col("quota"))
                       .groupBy("__g").agg(F.max("__h").alias("__last")))
    w = df.withColumn("__g", _class_text(group)).join(_small(last), "__g", "left")
    return w.withColumn("__sel", F.coalesce(hash_order(key, seed) <= F.col("__last"), F.lit(False))) \
        .select(*df.columns, "__sel")


def test_count(n: int, test_size: float) -> int:
    return int(math.ceil(test_size * n))


def stratified_quotas(counts: DataFrame, n: int, n_test: int) -> DataFrame:
    """(__g, quota) from (__g, c): floor shares, and one more for the largest
    remainders (ties by label)."""
    wide = F.lit(n_test).cast("decimal(19,0)") * F.col("c").cast("decimal(19,0)")
    shares = counts.select("__g", F.floor(wide / F.lit(n)).cast("long").alias("base"), (wide % F.lit(n)).alias("rem"))
    shares = cut_lineage(shares)
    left = n_test - (shares.agg(F.sum("base")).first()[0] or 0)
    order = ranked(shares, [F.col("rem").desc(), F.col("__g").asc()])
    return order.select("__g", (F.col("base") + (F.col("rank") <= left).cast("long")).alias("quota"))


def split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: list[str] | None = None,
          stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact-size random split (n_test = ceil(n*t)),
    optionally stratified by a class column."""
    if not key:
        raise ValueError("split needs unique key columns for a reproducible order")
    if test_size <= 0:
        return df, df.limit(0)
    if stratify:
        counts = cut_lineage(df.groupBy(_class_text(stratify).alias("__g")).agg(F.count(F.lit(1)).alias("c")))
        n = counts.agg(F.sum("c")).first()[0] or 0
        marked = smallest_by_hash(df, key, seed, stratified_quotas(counts, n, test_count(n, test_size)), stratify)
    else:
        marked = smallest_by_hash(df, key, seed, test_count(df.count(), test_size))
    return marked.where(~F.col("__sel")).drop("__sel"), marked.where(F.col("__sel")).drop("__sel")


def split_chronological(df: DataFrame, ts_col: str, test_size: float = 0.2, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sort by parsed time ascending (missing last, then ``key``, of any
    type); the first floor(n*(1-t)) rows train, the rest test.  Texts are parsed
    once: the parsed rows are written and both parts read them."""
    from .clean import datetime_text_expr
    from ..functions.columns import is_text

    if test_size <= 0:
        return df, df.limit(0)
    if is_text(df.schema[ts_col].dataType):
        w = cut_lineage(df.withColumn("__ts", datetime_text_expr(ts_col)))
    else:
        w = df.withColumn("__ts", F.col(ts_col))
    n_train = int(w.count() * (1 - test_size))
    if n_train <= 0:
        return df.limit(0), df
    places = ranked(w.select("__ts", F.col(key).alias("__k")), [F.col("__ts").asc_nulls_last(), F.col("__k").asc()])
    last = places.where(F.col("rank") == n_train).first()
    not_later = F.col(key).isNull() if last["__k"] is None else F.col(key).isNull() | (F.col(key) <= F.lit(last["__k"]))
    if last["__ts"] is None:
        early = F.col("__ts").isNotNull() | not_later
    else:
        at = F.lit(last["__ts"]).cast(w.schema["__ts"].dataType)
        early = F.coalesce(F.col("__ts") < at, F.lit(False)) | (F.col("__ts").eqNullSafe(at) & not_later)
    marked = w.withColumn("__train", early)
    return marked.where("__train").drop("__ts", "__train"), marked.where(~F.col("__train")).drop("__ts", "__train")


def assign_folds(df: DataFrame, k: int, key: list[str], seed: int = 42, stratify: str | None = None) -> DataFrame:
    """``fold`` = (rank in md5(key:seed) order within class) % k.
    Ranks come from one distributed scan, not a per-class window.  A row
    without a key has no place in the order: the plan fails on one."""
    no_key = F.lit(False)
    for c in key:
        no_key = no_key | F.col(c).isNull()
    h = F.when(no_key, F.raise_error(F.lit("a fold needs a key in every row"))).otherwise(hash_order(key, seed))
    placed = ranked(df.withColumn("__h", h), ["__h"], [stratify] if stratify else [], "__place")
    return placed.withColumn("fold", ((F.col("__place") - 1) % k).cast("int")).drop("__h", "__place")


def class_weights(df: DataFrame, y: str, boosted_binary: bool = False) -> DataFrame:
    """Balanced weights n / (k * count); for boosted binary models the
    positive class gets count(neg)/count(pos) and the negative 1."""
    c = df.where(F.col(y).isNotNull()).groupBy(F.col(y).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    rows = c.collect()
    n = sum(r["count"] for r in rows)
    k = len(rows)
    spark = df.sparkSession
    if boosted_binary and k == 2:
        labels = sorted(r["label"] for r in rows)
        cnt = {r["label"]: r["count"] for r in rows}
        data = [(labels[0], 1.0), (labels[1], cnt[labels[0]] / cnt[labels[1]])]
    else:
        data = [(r["label"], n / (k * r["count"])) for r in rows]
    return spark.createDataFrame(data, "label string, weight double").select("label", F.round("weight", 6).alias("weight"))


def smote(df: DataFrame, y: str, features: list[str], key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Raise every class to the majority count with synthetic rows
    x + u * (neighbour - x), the neighbour drawn among the k nearest rows of
    the same class (exact, by the block index).  Synthetic rows
    have ``synthetic`` = true and a repeatable ``key`` of their own, so that folds
    hold them too: a text key is ``id#copy``, a number is negative, from a 63-bit
    hash of id and copy (other key types are refused)."""
    from ..functions.neighbors import nearest

    key_type = df.schema[key].dataType
    if not isinstance(key_type, (T.StringType, T.LongType, T.IntegerType)):
        raise ValueError(f"smote needs a text or whole-number key, not {key_type.simpleString()}")
    counts = {r[0]: r[1] for r in df.groupBy(F.col(y).cast("string")).count().collect()}
    major = max(counts.values())
    need = {c: major - n for c, n in counts.items() if major - n > 0}
    base = df.withColumn("synthetic", F.lit(False))
    if not need:
        return base
    small = [c for c, n in counts.items() if c in need and n <= k]
    if small:
        raise ValueError(f"classes {small} have too few rows for k={k} neighbours")
    rows = df.where(F.col(y).cast("string").isin(list(need))).select(
        F.col(key).alias("__id"), F.col(y).cast("string").alias("__cls"), *[F.col(f).cast("double").alias(f) for f in features])
    points = rows.select("__id", F.col("__cls").alias("grp"), F.array(*features).alias("vec"))
    nn = nearest(points.withColumnRenamed("__id", "qid"), points.withColumnRenamed("__id", "did"), k, len(features),
                 same_group=True, other_rows=True)
    # copies per base row: floor(need/n) for all + 1 for the (need % n) smallest hashes
    marked = smallest_by_hash(rows, ["__id"], seed, {c: need[c] % counts[c] for c in need}, "__cls")
    per = F.create_map(*[x for c in need for x in (F.lit(c), F.lit(need[c] // counts[c]))])
    copies = marked.withColumn("__copies", per[F.col("__cls")] + F.col("__sel").cast("int"))
    gen = copies.where(F.col("__copies") > 0).withColumn("__j", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    hj = F.md5(F.concat_ws(":", F.col("__id").cast("string"), F.col("__j").cast("string"), F.lit(str(seed))))
    gen = (gen.withColumn("__rn", (F.conv(F.substring(hj, 1, 8), 16, 10).cast("long") % k + 1).cast("int"))
              .withColumn("__u", F.conv(F.substring(hj, 9, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))))
    nbr = nn.select(F.col("qid").alias("__id"), F.col("rn").alias("__rn"), F.col("did").alias("__nid"))
    gen = gen.join(nbr, ["__id", "__rn"])
    nvals = rows.select(F.col("__id").alias("__nid"), *[F.col(f).alias(f"n_{f}") for f in features])
    gen = gen.join(nvals, "__nid")
    copy = F.concat(F.col("__id").cast("string"), F.lit("#"), F.col("__j").cast("string"))
    if not isinstance(key_type, T.StringType):
        bits = 0x7FFFFFFFFFFFFFFF if isinstance(key_type, T.LongType) else 0x7FFFFFFF
        copy = (-F.xxhash64(copy).bitwiseAND(F.lit(bits)) - 1).cast(key_type)
    gen = gen.withColumn("__new", copy)
    synth = gen.select(*[(F.col(f) + F.col("__u") * (F.col(f"n_{f}") - F.col(f))).alias(f) for f in features],
                       F.col("__cls").alias("__cls"), F.col("__new").alias("__new"))
    ytype = df.schema[y].dataType
    synth = synth.select("__new", *[F.col(f) for f in features], F.col("__cls").cast(ytype).alias(y))
    others = [c for c in df.columns if c not in features and c != y]
    synth = synth.select(*[(F.col("__new") if c == key else F.lit(None).cast(df.schema[c].dataType)).alias(c)
                           for c in others], *features, y)
    base = base.select(*[F.col(c) for c in others], *[F.col(f).cast("double").alias(f) for f in features], y, "synthetic")
    return base.unionByName(synth.withColumn("synthetic", F.lit(True)))
