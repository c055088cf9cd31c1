"""Diagnostics and explanation."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dtype_of, is_measure, is_text, num
from ..functions.ordered import ranked
from ..functions.selection import column_quantiles, order_statistics
from ..functions.stats import typed_modes
from . import evaluate as EV
from .profile import hash_order


def _final_stage(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def feature_importance(model, names: list[str], top: int = 15, df: DataFrame | None = None,
                       problem: str = "classification", key: list[str] | None = None) -> DataFrame:
    """Tree importances, else mean |coefficient| over classes;
    top ``top`` by importance (ties by name).  A model that has neither for its
    input columns (k-NN, RBF SVM, one-vs-rest) takes the permutation importance
    over ``df`` (M37)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    st = _final_stage(model)
    if type(st).__name__ == "MarginProbability":  # calibrated: the margin's model stands before
        st = model.stages[-2]
    vals = None
    if hasattr(st, "featureImportances"):
        vals = list(st.featureImportances.toArray())
    elif hasattr(st, "coefficientMatrix") and getattr(st, "numClasses", 2) > 2:
        m = st.coefficientMatrix.toArray()
        vals = [float(abs(m[:, j]).mean()) for j in range(m.shape[1])]
    elif hasattr(st, "coefficients"):
        vals = [abs(float(v)) for v in st.coefficients.toArray()]
    if vals is None or len(vals) != len(names):
        if df is None or not key:
            raise ValueError("this model has no importances of its own: give df and key for the permutation importance")
        by = permutation_importance(model, df, names, problem, key)
        return by.orderBy(F.col("importance").desc(), "feature").limit(top)
    rows = sorted(zip(names, vals), key=lambda t: (-t[1], t[0]))[:top]
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "feature string, importance double")


def permutation_importance(model, df: DataFrame, features: list[str], problem: str, key: list[str],
                           repeats: int = 2, seed: int = 42) -> DataFrame:
    """Mean drop of the primary score (accuracy / R2) when one feature
    column is permuted, ``repeats`` times.

    A repeat ranks the rows twice by hashes of their key; joining rank to rank
    is a permutation, which all features share.  The frames of every (repeat,
    feature) are stacked, scored and evaluated in one job."""
    metric = "accuracy" if problem == "classification" else "r2"
    own = ranked(df.select(*key, "label", *features), [hash_order(key, 0)], name="__place")
    sets = [own.select(F.lit(-1).alias("__r"), F.lit(-1).alias("__f"), "label", *features)]
    numbers = F.sequence(F.lit(0), F.lit(len(features) - 1))
    for r in range(repeats):
        other = ranked(df.select(*key, *features), [hash_order(key, seed + 1 + r)], name="__place") \
            .select("__place", *[F.col(f).alias(f"__other_{i}") for i, f in enumerate(features)])
        both = own.join(other, "__place").withColumn("__f", F.explode(numbers))
        sets.append(both.select(F.lit(r).alias("__r"), "__f", "label",
                                *[F.when(F.col("__f") == i, F.col(f"__other_{i}")).otherwise(F.col(f)).alias(f)
                                  for i, f in enumerate(features)]))
    stacked = sets[0]
    for s in sets[1:]:
        stacked = stacked.unionByName(s)
    pred = model.transform(stacked)
    metrics = EV.classification_metrics if problem == "classification" else EV.regression_metrics
    found = metrics(pred, "label", "prediction", ["__r", "__f"]).select("__r", "__f", metric).collect()
    score = {(x["__r"], x["__f"]): x[metric] for x in found}
    base = score.get((-1, -1), 0.0)
    rows = [(f, sum(base - score[r, i] for r in range(repeats)) / repeats if score else 0.0) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def learning_curve(algo: str, df: DataFrame, features: list[str], problem: str, key: list[str],
                   fractions=(0.2, 0.4, 0.6, 0.8, 1.0), folds: int = 2, max_rows: int | None = None,
                   seed: int = 42, parallelism: int = 4) -> DataFrame:
    """Train / validation score (weighted F1 or R2) at growing train
    sizes with ``folds``-fold CV.  ``max_rows`` bounds the rows a classifier is
    fitted on (about that many over all folds; None: all); every held-out row is
    scored whatever it is, and regressions are fitted on all rows.

    One distributed ranking places every row in the hash order of each training
    set; a fraction is a filter on it.  The predictions of all fits are
    evaluated in one job."""
    from .train import _folds, evaluate_all, fit

    folded, sizes, n_classes = _folds(df, problem, folds, key, seed)
    metric = "f1_score" if problem == "classification" else "r2"
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("fold"))
    placed = ranked(folded.withColumn("__out", F.explode(others)), [hash_order(key, seed + 1)], ["__out"], "__place")
    todo = []
    for n_frac, frac in enumerate(fractions):
        for i in range(folds):
            n = sum(c for f, c in sizes.items() if f != i)
            if max_rows is not None and problem == "classification":
                n = min(n, math.ceil(max_rows * (folds - 1) / folds))
            todo.append((n_frac, i, max(1, int(n * frac))))

    def one(task):
        _, i, k = task
        tr = placed.where((F.col("__out") == i) & (F.col("__place") <= k))
        m = fit(algo, tr, features, problem, n_classes=n_classes or None, seed=seed, n_rows=k)
        return m.transform(tr), m.transform(folded.where(F.col("fold") == i))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        preds = list(ex.map(one, todo))
    scores = evaluate_all([(2 * t + part, p) for t, both in enumerate(preds) for part, p in enumerate(both)], problem)
    folded.unpersist()
    rows = []
    for at in range(len(fractions)):
        own = [t for t, x in enumerate(todo) if x[0] == at]
        rows.append((todo[own[-1]][2], sum(scores[2 * t][metric] for t in own) / folds,
                     sum(scores[2 * t + 1][metric] for t in own) / folds))
    return df.sparkSession.createDataFrame(rows, "train_size bigint, train_score double, val_score double")


def baseline_row(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Median of every numeric column, mode of every text column."""
    cols = cols or df.columns
    numeric = [c for c in cols if is_measure(dtype_of(df, c))]
    texts = [c for c in cols if is_text(dtype_of(df, c))]
    q = column_quantiles(df, numeric, [0.5]) if numeric else {}
    modes = typed_modes(df, texts) if texts else {}
    exprs = [F.lit(q[c][0.5]).cast("double").alias(c) for c in numeric] + [F.lit(modes.get(c)).cast("string").alias(c) for c in texts]
    return df.sparkSession.range(1).select(*exprs)


def waterfall(df: DataFrame, features: list[str], baseline: dict, key: list[str], score) -> DataFrame:
    """Start from the baseline row, switch features to the row's own
    values one at a time in column order; each step's contribution is the
    change in score.  ``score`` maps a DataFrame holding the feature columns
    to one with a ``__score`` column (a Spark ML model or an expression).
    Contributions of a row sum to score(row) - score(baseline)."""
    m = len(features)
    ex = df.select(*key, *[F.col(f).cast("double").alias(f) for f in features],
                   F.posexplode(F.sequence(F.lit(0), F.lit(m))).alias("step", "__s")).drop("__s")
    mixed = ex.select(*key, "step", *[F.when(F.col("step") > i, F.col(f)).otherwise(F.lit(baseline[f])).alias(f)
                                      for i, f in enumerate(features)],
                      *[F.col(f).alias(f"__x_{f}") for f in features])
    scored = score(mixed)
    if "__p" in scored.columns:  # the class predicted for the full row, at every step (M41)
        last = F.max_by("prediction", "step").over(Window.partitionBy(*key)).cast("int")
        scored = scored.withColumn("__c", last).withColumn("__score", F.col("__p")[F.col("__c")])
    w = Window.partitionBy(*key).orderBy("step")
    contrib = scored.withColumn("contribution", F.col("__score") - F.lag("__score").over(w)).where(F.col("step") > 0)
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("step"))
    value = F.element_at(F.array(*[F.col(f"__x_{f}") for f in features]), F.col("step"))
    return contrib.select(*key, F.col("step").cast("int").alias("step"), name.alias("feature"), value.alias("value"),
                          "contribution")


def linear_score(weights: dict, intercept: float):
    """Closed-form linear scorer for ``waterfall`` (same operation order as
    written, so results are reproducible in SQL)."""
    def fn(df: DataFrame) -> DataFrame:
        s = F.lit(intercept)
        for f, w in weights.items():
            s = s + F.lit(w) * F.col(f)
        return df.withColumn("__score", s)
    return fn


def model_score(model, problem: str):
    """Score with a fitted model: the regression prediction (``__score``), or
    all class probabilities (``__p``), of which ``waterfall`` takes that of the
    class predicted for the full row (M41)."""
    from pyspark.ml.functions import vector_to_array

    def fn(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        if problem == "classification" and "probability" in out.columns:
            return out.withColumn("__p", vector_to_array("probability"))
        return out.withColumn("__score", F.col("prediction"))
    return fn


def row_at(df: DataFrame, order_col: str, i: int) -> DataFrame:
    """The row at 0-based position ``i`` in ``order_col`` order (unique
    numeric key) with a bounds check; exact order statistic, no global sort."""
    x = F.col(order_col).cast("double")
    st = df.agg(F.count(x).alias("n"), F.min(x).alias("mn"), F.max(x).alias("mx")).collect()[0]
    if not 0 <= i < (st["n"] or 0):
        raise IndexError(f"row {i} out of range (0..{(st['n'] or 0) - 1})")
    long = df.select(F.lit("k").alias("column_name"), x.alias("value")).where(F.col("value").isNotNull())
    v = order_statistics(long, {"k": [i]}, {"k": (st["mn"], st["mx"], st["n"])})[("k", i)]
    # whole numbers above 2^53 share a double: order those few by the key itself
    below = df.where(x < F.lit(v)).count()
    return df.where(x == F.lit(v)).orderBy(order_col).offset(i - below).limit(1)
