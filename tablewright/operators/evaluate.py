"""Evaluation metrics over prediction tables.

Inputs are DataFrames of (label, prediction[, score]); everything reduces
through small group-bys (per class, per distinct score) so nothing larger
than the class grid or a bucket total reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cumulative import cumulative

EPS = 2.220446049250313e-16  # float64 machine epsilon (MAPE guard)


def _per_class(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by, label, tp, support, predicted) for every label in y or pred."""
    keys = [*(by or []), "label"]
    yy, pp = F.col(y).cast("string"), F.col(pred).cast("string")
    pairs = df.groupBy(*(by or []), yy.alias("a"), pp.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    zero, hit = F.lit(0).cast("long"), F.when(F.col("a") == F.col("p"), F.col("c")).otherwise(F.lit(0))
    own = pairs.select(*(by or []), F.col("a").alias("label"), F.col("c").alias("support"), zero.alias("predicted"),
                       hit.cast("long").alias("tp"))
    guess = pairs.select(*(by or []), F.col("p").alias("label"), zero.alias("support"), F.col("c").alias("predicted"),
                         zero.alias("tp"))
    return own.unionByName(guess).groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "support", "predicted")])


def _scores(pc: DataFrame) -> DataFrame:
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    s = pc.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return s.withColumn("f1_score", f1)


def classification_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (zero
    division -> 0), 4 dp; ``by`` evaluates every group of rows in one job."""
    s = _scores(_per_class(df, y, pred, by))
    n = F.sum("support")
    return s.groupBy(*(by or [])).agg(
        F.round(F.sum("tp") / n, 4).alias("accuracy"),
        F.round(F.sum(F.col("precision") * F.col("support")) / n, 4).alias("precision"),
        F.round(F.sum(F.col("recall") * F.col("support")) / n, 4).alias("recall"),
        F.round(F.sum(F.col("f1_score") * F.col("support")) / n, 4).alias("f1_score"))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Dense (actual, predicted, count) over the sorted label set."""
    yy, pp = F.col(y).cast("string"), F.col(pred).cast("string")
    pairs = df.groupBy(yy.alias("actual"), pp.alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    labels = pairs.select("actual").union(pairs.select("predicted")).distinct()
    # every label meets every label: the matrix is their square
    grid = labels.select(F.lit(0).alias("one"), "actual").join(
        labels.select(F.lit(0).alias("one"), F.col("actual").alias("predicted")), "one").drop("one")
    return (grid.join(pairs, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per class precision / recall / f1 / support, plus accuracy,
    macro avg and weighted avg rows."""
    s = _scores(_per_class(df, y, pred))
    per = s.select("label", "precision", "recall", "f1_score", F.col("support").cast("bigint").alias("support"))
    tot = s.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                F.sum(F.col("precision") * F.col("support")).alias("wp"),
                F.sum(F.col("recall") * F.col("support")).alias("wr"),
                F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1_score"),
                     F.col("n").cast("bigint").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1_score"), F.col("n").cast("bigint").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"), (F.col("wp") / F.col("n")).alias("precision"),
                          (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1_score"),
                          F.col("n").cast("bigint").alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1_score")], "support")


def _score_table(df: DataFrame, y: str, score: str, positive=1, by: list[str] | None = None) -> DataFrame:
    """Per distinct score: positives and negatives (input to every curve)."""
    keys = list(by or [])
    pos = (F.col(y) == F.lit(positive)).cast("long")
    return (df.where(F.col(score).isNotNull())
            .groupBy(*keys, F.col(score).cast("double").alias("score"))
            .agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", positive=1, by: list[str] | None = None) -> DataFrame:
    """ROC AUC with ties counted half (equals the trapezoid area);
    ``by`` gives one AUC per group (e.g. per class for one-vs-rest)."""
    keys = list(by or [])
    t = cumulative(_score_table(df, y, score, positive, keys), "score", ["neg"], keys)
    per = t.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * 0.5)).alias("u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return per.select(*keys, F.round(F.try_divide(F.col("u"), F.col("P").cast("double") * F.col("N")), 4).alias("roc_auc"))


def one_vs_rest(df: DataFrame, y: str, prob_cols: dict, keep: list[str] | None = None) -> DataFrame:
    """(keep, cls, yb, score): one row per row and class; ``prob_cols`` maps a
    label to its score column."""
    pairs = F.array(*[F.struct(F.lit(str(v)).alias("cls"), (F.col(y).cast("string") == F.lit(str(v))).cast("int").alias("yb"),
                               F.col(c).cast("double").alias("score")) for v, c in prob_cols.items()])
    return df.select(*(keep or []), F.inline(pairs))


def roc_auc_ovr(df: DataFrame, y: str, prob_cols: dict) -> DataFrame:
    """M26 multi-class: one-vs-rest AUC per class weighted by support."""
    aucs = roc_auc(one_vs_rest(df, y, prob_cols), "yb", "score", 1, ["cls"]).withColumnRenamed("roc_auc", "auc")
    sup = df.groupBy(F.col(y).cast("string").alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    return (aucs.join(sup, "cls").agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("a"))
            .select(F.round("a", 4).alias("roc_auc")))


def _curve(df: DataFrame, y: str, score: str, positive, by: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Per distinct score, from the highest: positives and negatives so far
    (cum_), and all of the group (P, N)."""
    keys = list(by or [])
    table = _score_table(df.withColumn("__all", F.lit(0)), y, score, positive, ["__all", *keys])
    totals = table.groupBy("__all", *keys).agg(F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N"))
    t = cumulative(table, "score", ["pos", "neg"], ["__all", *keys], descending=True)
    return t.join(totals, ["__all", *keys]), keys


def _with_end(curve: DataFrame, names: list[str], keys: list[str], ends: DataFrame, at: tuple) -> DataFrame:
    end = ends.select(*keys, F.lit(None).cast("double").alias("threshold"), *[F.lit(v).alias(n) for n, v in zip(names, at)])
    return curve.unionByName(end).select(*keys, "threshold", *[F.round(n, 6).alias(n) for n in names])


def roc_curve(df: DataFrame, y: str = "y", score: str = "score", positive=1, by: list[str] | None = None) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score (descending
    thresholds: rows with score >= threshold are positive) plus the origin;
    ``by`` gives one curve per group (per class after :func:`one_vs_rest`)."""
    t, keys = _curve(df, y, score, positive, by)
    curve = t.select(*keys, F.col("score").alias("threshold"), F.try_divide(F.col("cum_neg").cast("double"), "N").alias("fpr"),
                     F.try_divide(F.col("cum_pos").cast("double"), "P").alias("tpr"))
    return _with_end(curve, ["fpr", "tpr"], keys, _ends(df, keys), (0.0, 0.0))


def pr_curve(df: DataFrame, y: str = "y", score: str = "score", positive=1, by: list[str] | None = None) -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the
    (precision 1, recall 0) end point; ``by`` as in :func:`roc_curve`."""
    t, keys = _curve(df, y, score, positive, by)
    curve = t.select(*keys, F.col("score").alias("threshold"),
                     F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                     F.try_divide(F.col("cum_pos").cast("double"), "P").alias("recall"))
    return _with_end(curve, ["precision", "recall"], keys, _ends(df, keys), (1.0, 0.0))


def _ends(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct() if keys else df.sparkSession.range(1)


def average_precision(df: DataFrame, y: str = "y", score: str = "score", positive=1, by: list[str] | None = None) -> DataFrame:
    """AP = sum over thresholds of (recall step) x precision."""
    t, keys = _curve(df, y, score, positive, by)
    step = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return t.groupBy(*keys).agg(F.round(F.try_divide(F.sum(step), F.sum("pos")), 4).alias("average_precision"))


def is_imbalanced(df: DataFrame, y: str = "y", ratio: float = 2.0) -> DataFrame:
    """majority/minority class count ratio > 2 (needs >= 2 classes)."""
    c = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.count(F.lit(1)).alias("k"), F.max("c").alias("mx"), F.min("c").alias("mn")).select(
        F.round(F.col("mx") / F.col("mn"), 4).alias("ratio"),
        ((F.col("k") >= 2) & (F.col("mx") / F.col("mn") > ratio)).alias("is_imbalanced"))


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, R^2, MAPE (eps-guarded), 4 dp; ``by`` evaluates every
    group of rows in one job."""
    yy, pp = F.col(y).cast("double"), F.col(pred).cast("double")
    e = yy - pp
    a = df.groupBy(*(by or [])).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
               F.sum(e * e).alias("ss_res"), F.var_pop(yy).alias("vp"), F.count(F.lit(1)).alias("n"),
               F.avg(F.abs(e) / F.greatest(F.abs(yy), F.lit(EPS))).alias("mape"))
    ss_tot = F.col("vp") * F.col("n")
    r2 = (F.when(ss_tot > 0, 1 - F.col("ss_res") / ss_tot)
          .otherwise(F.when(F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0))))
    return a.select(*(by or []), F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                    F.round(r2, 4).alias("r2"), F.round("mape", 4).alias("mape"))


def residuals(df: DataFrame, y: str = "y", pred: str = "pred", keys: list[str] | None = None) -> DataFrame:
    """Predicted vs actual and residual per row."""
    return df.select(*(keys or []), F.col(y).cast("double").alias("actual"), F.col(pred).cast("double").alias("predicted"),
                     (F.col(y).cast("double") - F.col(pred).cast("double")).alias("residual"))


def residual_histogram(df: DataFrame, y: str = "y", pred: str = "pred", bins: int = 20) -> DataFrame:
    """Residual histogram with bin centres (equal width, last closed)."""
    r = (F.col(y).cast("double") - F.col(pred).cast("double"))
    st = df.agg(F.min(r).alias("lo"), F.max(r).alias("hi"), F.count(r).alias("n")).collect()[0]
    spark = df.sparkSession
    if not st["n"]:
        return spark.createDataFrame([], "bin int, center double, count bigint")
    lo, hi = float(st["lo"]), float(st["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    w = (hi - lo) / bins
    b = F.least(F.lit(bins - 1), F.floor((r - F.lit(lo)) / F.lit(w)).cast("int"))
    counts = df.where(r.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    upper = F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(w))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", F.round((F.lit(lo) + F.col("bin") * F.lit(w) + upper) / 2.0, 6).alias("center"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))
