"""Preparation: target detection, suggestions, imputation, encoding, scaling
and feature selection (P1-P26).

Fitting is one aggregate job per concern that yields a small decision record;
applying it is one projection (plus a join per map-based encoder, broadcast
only when the fitted map's row count is under ``BROADCAST_ROWS``)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (dtype_of, fold_nan, is_integral, is_measure, is_numeric_like, is_temporal, is_text, num,
                                 text_columns)
from ..functions.selection import column_quantiles
from ..functions.cardinality import distinct_counts
from ..functions.stats import typed_modes

# Fixed values that must equal the reference for identical results.
MAX_CLASSES = 20
ONE_HOT_MAX = 10
TARGET_ENC_MAX = 50
ROBUST_OUTLIER_SHARE = 0.05
DATE_NAME_HINTS = ["date", "timestamp", "datetime", "time_index"]
BROADCAST_ROWS = 1_000_000


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# ---------------------------------------------------------------- P1-P7


def target_profile(df: DataFrame, y: str) -> dict:
    """Distinct count and all-integer flag of the target (one job)."""
    dt = dtype_of(df, y)
    x = F.col(y)
    aggs = [F.count_distinct(x).alias("k")]
    if is_numeric_like(dt) and not is_integral(dt) and not isinstance(dt, T.BooleanType):
        xv = num(y)
        aggs.append(F.coalesce(F.bool_and(F.when(xv.isNotNull(), xv == F.floor(xv))), F.lit(True)).alias("int"))
    else:
        aggs.append(F.lit(is_numeric_like(dt)).alias("int"))
    r = df.agg(*aggs).collect()[0]
    return {"unique": r["k"], "all_integer": bool(r["int"]), "dtype": dt.simpleString(),
            "numeric": is_numeric_like(dt), "text": is_text(dt)}


def problem_type_of(info: dict, max_classes: int = MAX_CLASSES) -> str:
    """Invalid (<2 values) / classification / regression."""
    k = info["unique"]
    if k < 2:
        return "invalid"
    if info["text"]:
        return "classification"
    if info["numeric"]:
        return "classification" if k <= max_classes and info["all_integer"] else "regression"
    return "classification" if k <= max_classes else "regression"


def detect_problem_type(df: DataFrame, y: str) -> str:
    return problem_type_of(target_profile(df, y))


def problem_type_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """P1 for several columns at once as a DataFrame."""
    rows = []
    for c in cols:
        info = target_profile(df, c)
        rows.append((c, info["unique"], info["all_integer"], problem_type_of(info)))
    return df.sparkSession.createDataFrame(rows, "column_name string, unique_count bigint, all_integer boolean, problem_type string")


def class_balance(df: DataFrame, y: str) -> tuple[DataFrame, DataFrame]:
    """(per-class table, summary row).  Shares are over all rows
    (null targets included); ties order by label."""
    n = df.count()
    lab = F.col(y).cast("string")
    per = (df.where(F.col(y).isNotNull()).groupBy(lab.alias("label")).agg(F.count(F.lit(1)).alias("count"))
           .withColumn("percent", F.round(F.col("count") / F.lit(n), 4)))
    key = F.struct((-F.col("count")).alias("c"), F.col("label").alias("l"))
    s = per.agg(F.min_by("label", key).alias("majority_class"), F.max_by("label", key).alias("minority_class"),
                F.max("count").alias("mx"), F.min("count").alias("mn"), F.count(F.lit(1)).alias("class_count"))
    maj, mino = F.col("mx") / F.lit(n), F.col("mn") / F.lit(n)
    ratio = F.when(mino > 0, maj / mino)
    summary = s.select("majority_class", "minority_class", F.round(maj, 4).alias("majority_pct"),
                       F.round(mino, 4).alias("minority_pct"),
                       F.coalesce(F.round(ratio, 4), F.lit(999.0)).alias("imbalance_ratio"),
                       F.coalesce(ratio > 2.0, F.lit(True)).alias("is_imbalanced"),
                       F.col("class_count").cast("bigint").alias("class_count"))
    return per, summary


def datetime_columns(df: DataFrame, key: list[str]) -> DataFrame:
    """timestamp/date columns, text columns all of whose non-null values
    parse as dates (one aggregate over all rows), or whose name hints a date."""
    from .clean import datetime_text_expr

    rows = []
    texts = [c for c in df.columns if is_text(dtype_of(df, c))]
    probe = {}
    if texts:
        r = df.agg(*[a for i, c in enumerate(texts) for a in (
            F.count(c).alias(f"n{i}"), F.count(datetime_text_expr(c)).alias(f"ok{i}"))]).first()
        probe = {c: r[f"n{i}"] > 0 and r[f"n{i}"] == r[f"ok{i}"] for i, c in enumerate(texts)}
    for c in df.columns:
        dt = dtype_of(df, c)
        if is_temporal(dt):
            rows.append((c, "datetime type"))
        elif is_text(dt):
            if probe[c]:
                rows.append((c, "parses as datetime"))
            elif any(h in c.lower() for h in DATE_NAME_HINTS):
                rows.append((c, "name hint"))
    return df.sparkSession.createDataFrame(rows, "column_name string, reason string")


#: Largest cardinality, then the encoding for a binary class, several classes and a number.
ENCODINGS = ((ONE_HOT_MAX, "one_hot", "one_hot", "one_hot"), (TARGET_ENC_MAX, "target", "one_hot", "one_hot"),
             (float("inf"), "target", "target", "frequency"))


def suggest_encoding(cardinality: int, problem_type: str, n_classes: int) -> str:
    """The row of :data:`ENCODINGS` that holds the cardinality."""
    kind = 3 if problem_type != "classification" else 1 if n_classes == 2 else 2
    return next(row[kind] for row in ENCODINGS if cardinality <= row[0])


def suggest_scaling(outliers: DataFrame) -> DataFrame:
    """P5: robust when the outlier share is above 5% (and count > 0), else standard."""
    return outliers.select("column_name", F.when((F.col("count") > 0) & (F.col("percent") > ROBUST_OUTLIER_SHARE),
                                                  "robust").otherwise("standard").alias("suggested_scaling"))


def suggest_pipeline(df: DataFrame) -> DataFrame:
    """Per column dtype, numeric?, cardinality, missing share, role,
    encoding (text, scored as binary classification on the first column)
    and scaling (numeric) suggestions."""
    from . import profile as P

    spark = df.sparkSession
    cols = df.columns
    card = distinct_counts(df, [c for c in cols if not isinstance(dtype_of(df, c), (T.ArrayType, T.MapType, T.StructType))])
    r = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).collect()[0]
    measures = [c for c in cols if is_measure(dtype_of(df, c))]
    ints = {}
    if measures:
        ir = df.agg(*[F.coalesce(F.bool_and(F.when(num(c).isNotNull(), num(c) == F.floor(num(c)))), F.lit(True)).alias(c)
                      for c in measures]).collect()[0]
        ints = {c: ir[c] for c in measures}
    first_k = card.get(cols[0], 0)
    scaling = {row["column_name"]: row["suggested_scaling"] for row in suggest_scaling(P.outliers(df, measures)).collect()} if measures else {}
    rows = []
    for c in cols:
        dt = dtype_of(df, c)
        isnum = is_numeric_like(dt)
        k = card.get(c, 0)
        role = "feature"
        if isnum and k <= MAX_CLASSES and ints.get(c, True):
            role = "target" if k >= 2 else "drop"
        enc = suggest_encoding(k, "classification", first_k) if not isnum else None
        sc = scaling.get(c, "standard") if isnum else None
        rows.append((c, dt.simpleString(), isnum, k, round(r[c] / max(r["__n"], 1), 4), role, enc, sc))
    return spark.createDataFrame(rows, "column_name string, dtype string, is_numeric boolean, cardinality bigint, "
                                       "missing_pct double, suggested_role string, suggested_encoding string, "
                                       "suggested_scaling string")


# ---------------------------------------------------------------- P8-P10 imputation


def fit_imputer(df: DataFrame, strategy: str, scope: str = "all", cols: list[str] | None = None) -> dict:
    """Fill values per column (numeric: mean/median/most_frequent;
    text: mode whatever the strategy)."""
    if strategy in (None, "none"):
        return {}
    df = fold_nan(df)
    cols = cols or df.columns
    numeric = [c for c in cols if is_measure(dtype_of(df, c))] if scope in ("all", "numeric") else []
    texts = [c for c in cols if is_text(dtype_of(df, c))] if scope in ("all", "categorical") else []
    values = {}
    if numeric:
        if strategy == "mean":
            r = df.agg(*[F.avg(num(c)).alias(c) for c in numeric]).collect()[0]
            values.update({c: r[c] for c in numeric})
        elif strategy == "median":
            q = column_quantiles(df, numeric, [0.5])
            values.update({c: q[c][0.5] for c in numeric})
        else:
            values.update(typed_modes(df, numeric))
    if texts:
        values.update(typed_modes(df, texts))
    return {c: v for c, v in values.items() if v is not None}


def apply_imputer(df: DataFrame, values: dict) -> DataFrame:
    """NULL and NaN cells take the fitted values."""
    df = fold_nan(df)
    out = []
    for f in df.schema.fields:
        if f.name in values:
            v = values[f.name]
            if isinstance(v, float) and not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                out.append(F.coalesce(F.col(f.name).cast("double"), F.lit(v)).alias(f.name))
            else:
                out.append(F.coalesce(F.col(f.name), F.lit(v)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def assert_no_missing(df: DataFrame, cols: list[str] | None = None) -> None:
    """P10: refuse feature matrices that still hold missing values (NULL, NaN)."""
    df = fold_nan(df)
    cols = cols or df.columns
    r = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in cols]).collect()[0]
    bad = [c for c in cols if r[c]]
    if bad:
        raise ValueError("Dataset contains missing values but no imputation strategy is configured "
                         f"(columns: {', '.join(bad)}). Enable imputation or clean the dataset first.")


# ---------------------------------------------------------------- P11-P15 encoders


def fit_one_hot(df: DataFrame, cols: list[str]) -> dict:
    """Sorted distinct levels per column (all kept)."""
    from ..functions.stats import value_counts

    if not cols:
        return {}
    levels = {c: [] for c in cols}
    for r in value_counts(df, cols).select("column_name", "value").collect():
        levels[r["column_name"]].append(r["value"])
    return {c: sorted(v) for c, v in levels.items()}


def one_hot_columns(levels: dict) -> list:
    """Projection: ``col_value`` = 1.0 when equal else 0.0 (unknown -> zeros)."""
    out = []
    for c, vals in levels.items():
        for v in vals:
            out.append(F.when(F.col(c).cast("string") == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}"))
    return out


def fit_target_mean(df: DataFrame, col: str, y_value) -> tuple[DataFrame, float, int]:
    """Mean target (label index or numeric y) per category; global
    mean of the fitting rows for unseen / missing categories."""
    m = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("__v"))
         .agg(F.avg(y_value).alias("__enc")))
    g = df.agg(F.avg(y_value)).collect()[0][0]
    m = m.persist()
    return m, g, m.count()


def fit_frequency(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """Raw count per category."""
    m = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("__v"))
         .agg(F.count(F.lit(1)).cast("double").alias("__enc"))).persist()
    return m, m.count()


def apply_map(df: DataFrame, col: str, mapping: DataFrame, rows: int, out: str, default) -> DataFrame:
    j = df.join(_maybe_broadcast(mapping, rows), F.col(col).cast("string") == F.col("__v"), "left")
    return j.withColumn(out, F.coalesce(F.col("__enc"), F.lit(default))).drop("__v", "__enc")


def label_dictionary(df: DataFrame, y: str) -> DataFrame:
    """(label, index) of the distinct non-null labels in their own order,
    numbered by a distributed running count and kept as a table."""
    from ..functions.ordered import ranked
    from ..session import cut_lineage

    labels = df.where(F.col(y).isNotNull()).select(F.col(y).alias("label")).distinct()
    return cut_lineage(ranked(labels, ["label"]).select("label", (F.col("rank") - 1).cast("int").alias("index")))


def encode_label(df: DataFrame, y: str, dictionary: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out`` = the label's index as a double (unknown, null: null)."""
    table = dictionary.select(F.col("label").alias("__label"), F.col("index").cast("double").alias("__code"))
    j = df.join(_maybe_broadcast(table, dictionary.count()), F.col(y) == F.col("__label"), "left")
    return j.withColumn(out, F.col("__code")).drop("__label", "__code")


def label_index(df: DataFrame, y: str) -> DataFrame:
    """P15 as a DataFrame: (label as text, index)."""
    return label_dictionary(df, y).select(F.col("label").cast("string").alias("label"), "index")


# ---------------------------------------------------------------- P16-P19 scalers


def fit_scaler(df: DataFrame, cols: list[str], kind: str) -> dict:
    """(center, scale) per column: P16 standard = mean / population std;
    P17 minmax = min / range; P18 robust = median / IQR (exact interpolated).  A zero
    scale becomes 1."""
    if not cols:
        return {}
    out = {}
    if kind == "robust":
        q = column_quantiles(df, cols, [0.25, 0.5, 0.75])
        for c in cols:
            iqr = q[c][0.75] - q[c][0.25] if q[c][0.5] is not None else 1.0
            out[c] = (q[c][0.5] or 0.0, iqr if iqr else 1.0)
        return out
    if kind == "minmax":
        r = df.agg(*[F.min(num(c)).alias(f"a_{c}") for c in cols], *[F.max(num(c)).alias(f"b_{c}") for c in cols]).collect()[0]
        for c in cols:
            lo, hi = r[f"a_{c}"], r[f"b_{c}"]
            rng = (hi - lo) if lo is not None else 0.0
            out[c] = (lo or 0.0, rng if rng else 1.0)
        return out
    r = df.agg(*[F.avg(num(c)).alias(f"m_{c}") for c in cols], *[F.stddev_pop(num(c)).alias(f"s_{c}") for c in cols]).collect()[0]
    for c in cols:
        s = r[f"s_{c}"]
        out[c] = (r[f"m_{c}"] or 0.0, s if s else 1.0)
    return out


def scaled_columns(params: dict) -> list:
    return [((num(c) - F.lit(a)) / F.lit(b)).alias(c) for c, (a, b) in params.items()]


def auto_scaler(df: DataFrame, cols: list[str], outlier_report: DataFrame | None = None) -> str:
    """Robust if any scaled column has more than 5% outliers."""
    from . import profile as P

    if not cols:
        return "standard"
    rep = outlier_report if outlier_report is not None else P.outliers(df, [c for c in cols if is_measure(dtype_of(df, c))])
    hit = rep.where(F.col("column_name").isin(cols) & (F.col("count") > 0) & (F.col("percent") > ROBUST_OUTLIER_SHARE)).limit(1).count()
    return "robust" if hit else "standard"


def scale(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """Fit + apply a scaler in one call (the query form of P16-P19)."""
    kind = auto_scaler(df, cols) if kind == "auto" else kind
    params = fit_scaler(df, cols, kind)
    keep = [F.col(c) for c in df.columns if c not in params]
    return df.select(*keep, *scaled_columns(params))


# ---------------------------------------------------------------- P22-P25 selection


def low_variance(df: DataFrame, threshold: float = 0.01, cols: list[str] | None = None) -> DataFrame:
    """Numeric columns (>= 2 values) with sample variance < threshold or
    range < 1e-8."""
    cols = cols or [c for c in df.columns if is_measure(dtype_of(df, c))]
    spark = df.sparkSession
    schema = "column_name string, variance double, reason string"
    if not cols:
        return spark.createDataFrame([], schema)
    r = df.agg(*[F.count(num(c)).alias(f"n_{c}") for c in cols], *[F.var_samp(num(c)).alias(f"v_{c}") for c in cols],
               *[(F.max(num(c)) - F.min(num(c))).alias(f"r_{c}") for c in cols]).collect()[0]
    rows = []
    for c in cols:
        if r[f"n_{c}"] < 2:
            continue
        v = r[f"v_{c}"]
        if v < threshold or r[f"r_{c}"] < 1e-8:
            rows.append((c, v, f"variance={v:.6f} below threshold={threshold}"))
    return spark.createDataFrame(rows, schema).select("column_name", F.round("variance", 6).alias("variance"), "reason")


def correlated_drops(df: DataFrame, threshold: float = 0.95, cols: list[str] | None = None) -> DataFrame:
    """For each pair (schema order) with |r| > threshold discard the
    lower-sample-variance column (ties: the first); no re-check after a drop."""
    from .profile import correlation_long

    cols = cols or [c for c in df.columns if is_measure(dtype_of(df, c))]
    spark = df.sparkSession
    schema = "column_name string, reason string"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    pairs = (correlation_long(df, cols).where((F.col("i") < F.col("j")) & (F.abs("r") > threshold))
             .select("col_a", "col_b").collect())
    if not pairs:
        return spark.createDataFrame([], schema)
    v = df.agg(*[F.var_samp(num(c)).alias(c) for c in cols]).collect()[0]
    drop = set()
    for p in pairs:
        a, b = p["col_a"], p["col_b"]
        drop.add(a if (v[a] or 0.0) <= (v[b] or 0.0) else b)
    return spark.createDataFrame([(c, f"high correlation (|r|>{threshold}) with another feature") for c in cols if c in drop], schema)


def variance_threshold(df: DataFrame, cols: list[str], threshold: float) -> list[str]:
    """Columns of the transformed matrix whose population variance is
    <= threshold (dropped)."""
    if not cols:
        return []
    r = df.agg(*[F.var_pop(F.col(c)).alias(c) for c in cols]).collect()[0]
    return [c for c in cols if r[c] is None or r[c] <= threshold]


def select_features(df: DataFrame, threshold_var: float = 0.01, threshold_corr: float = 0.95,
                    near_zero: bool = True, high_corr: bool = True) -> tuple[DataFrame, DataFrame]:
    """P25: combined report (kind, column, reason) and the frame without them."""
    spark = df.sparkSession
    parts = []
    if near_zero:
        parts.append(low_variance(df, threshold_var).select(F.lit("near_zero_variance").alias("kind"), "column_name", "reason"))
    if high_corr:
        parts.append(correlated_drops(df, threshold_corr).select(F.lit("high_correlation").alias("kind"), "column_name", "reason"))
    if not parts:
        rep = spark.createDataFrame([], "kind string, column_name string, reason string")
    else:
        rep = parts[0]
        for p in parts[1:]:
            rep = rep.unionByName(p)
    drop = sorted({r[0] for r in rep.select("column_name").collect()})
    return rep, df.drop(*drop)


def quick_matrix(df: DataFrame, y: str | None = None) -> DataFrame:
    """Target (default last column) + numeric features only; a text
    target becomes alphabetical integer codes (null -> -1)."""
    y = y if y and y in df.columns else df.columns[-1]
    feats = [c for c in df.columns if c != y and is_numeric_like(dtype_of(df, c))]
    if is_text(dtype_of(df, y)):
        df = encode_label(df, y, label_dictionary(df, y), "__y")
        code = F.coalesce(F.col("__y").cast("long"), F.lit(-1).cast("long")).alias(y)
    else:
        code = F.col(y)
    return df.select(*feats, code)


def describe_target(df: DataFrame, y: str, key: list[str]) -> DataFrame:
    """Target check: problem type, distinct count, dtype, imbalance
    (classification only) and the datetime columns; a missing column or a
    target with fewer than two values is an error."""
    if y not in df.columns:
        raise ValueError(f"Target column '{y}' not found")
    info = target_profile(df, y)
    problem = problem_type_of(info)
    if problem == "invalid":
        raise ValueError(f"Target column '{y}' has fewer than 2 unique values")
    ratio, imb = None, None
    if problem == "classification":
        s = class_balance(df, y)[1].collect()[0]
        ratio, imb = s["imbalance_ratio"], s["is_imbalanced"]
    dates = ",".join(r[0] for r in datetime_columns(df, key).collect())
    return df.sparkSession.createDataFrame(
        [(y, problem, info["unique"], info["dtype"], imb, ratio, dates)],
        "target_column string, problem_type string, unique_values bigint, dtype string, is_imbalanced boolean, "
        "imbalance_ratio double, datetime_columns string")
