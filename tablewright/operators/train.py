"""Training (M1-M18): the reference's model families mapped onto Spark ML,
k-fold cross validation over a materialised fold column, random search and
the multi-model run that produces a runs table."""

from __future__ import annotations

import math
import random
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import evaluate as EV
from .split import assign_folds

CLASSIFIERS = ["logistic_regression", "random_forest", "xgboost", "svm", "knn"]
REGRESSORS = ["linear_regression", "ridge", "lasso", "random_forest_regressor", "xgboost_regressor"]
LOWER_IS_BETTER = ("rmse", "mae", "mape")

# Fixed values that must equal the reference: random-search grids.
PARAM_GRIDS = {
    "logistic_regression": {"C": [0.1, 1.0, 10.0]},
    "random_forest": {"n_estimators": [50, 100], "max_depth": [5, 10, None]},
    "xgboost": {"n_estimators": [50, 100], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5, 7]},
    "svm": {"C": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf"]},
    "knn": {"n_neighbors": [3, 5, 7]},
    "linear_regression": {},
    "ridge": {"alpha": [0.1, 1.0, 10.0]},
    "lasso": {"alpha": [0.01, 0.1, 1.0]},
    "random_forest_regressor": {"n_estimators": [50, 100], "max_depth": [5, 10, None]},
    "xgboost_regressor": {"n_estimators": [50, 100], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5, 7]},
}
SPARK_MAX_DEPTH = 30


class RandomFourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """RBF kernel approximation z(x) = sqrt(2/D) cos(Wx + b), W ~ N(0, 2 gamma):
    a plain projection of the feature columns (JVM expressions, no UDF), drawn
    again from its parameters when it is loaded."""

    features = Param(Params._dummy(), "features", "feature columns")
    gamma = Param(Params._dummy(), "gamma", "kernel width")
    size = Param(Params._dummy(), "size", "number of random features")
    seed = Param(Params._dummy(), "seed", "seed of the draw")

    def __init__(self, features: list[str] | None = None, gamma: float = 1.0, n_components: int = 100, seed: int = 42):
        super().__init__()
        self._set(features=features or [], gamma=float(gamma), size=n_components, seed=seed)

    @property
    def n(self) -> int:
        return self.getOrDefault("size")

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        names, n = self.getOrDefault("features"), self.n
        rng = np.random.default_rng(self.getOrDefault("seed"))
        weights = rng.normal(0.0, math.sqrt(2 * self.getOrDefault("gamma")), size=(n, len(names))).tolist()
        shift = rng.uniform(0, 2 * math.pi, size=n).tolist()
        scale = math.sqrt(2.0 / n)
        cols = []
        for j in range(n):
            lin = F.lit(shift[j])
            for w, f in zip(weights[j], names):
                lin = lin + F.lit(w) * F.col(f)
            cols.append((F.lit(scale) * F.cos(lin)).alias(f"__rff_{j}"))
        return df.select("*", *cols)


class MarginProbability(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Class probabilities from margins: one fitted sigmoid per class (one for
    two classes), normalised to a sum of one."""

    slopes = Param(Params._dummy(), "slopes", "slope per class")
    offsets = Param(Params._dummy(), "offsets", "offset per class")

    def __init__(self, slopes: list[float] | None = None, offsets: list[float] | None = None):
        super().__init__()
        self._set(slopes=slopes or [], offsets=offsets or [])

    def _transform(self, df: DataFrame) -> DataFrame:
        slopes, offsets = self.getOrDefault("slopes"), self.getOrDefault("offsets")
        raw = vector_to_array("rawPrediction")
        first = 1 if len(slopes) == 1 else 0
        ps = [F.lit(1.0) / (1 + F.exp(-(F.lit(a) * raw[first + j] + F.lit(b)))) for j, (a, b) in enumerate(zip(slopes, offsets))]
        if len(ps) == 1:
            return df.withColumn("probability", array_to_vector(F.array(1 - ps[0], ps[0])))
        total = sum(ps[1:], ps[0])
        return df.withColumn("probability", array_to_vector(F.array(*[F.try_divide(p, total) for p in ps])))


#: Parts of the training rows that give the margins a sigmoid is fitted on.
CALIBRATION_FOLDS = 3


def calibrate(stages: list, train: DataFrame, features: list[str], n_classes: int) -> MarginProbability:
    """Sigmoids fitted on out-of-fold margins: rows are dealt to parts by a hash
    of their features (copies stay together), each part is scored by a model of
    the others."""
    part = F.pmod(F.xxhash64(*features), F.lit(CALIBRATION_FOLDS)).alias("__part")
    dealt = cut_lineage(train.select("*", part))
    scored = None
    for i in range(CALIBRATION_FOLDS):
        model = Pipeline(stages=stages).fit(dealt.where(F.col("__part") != i))
        held = model.transform(dealt.where(F.col("__part") == i)).select("label", vector_to_array("rawPrediction").alias("m"))
        scored = held if scored is None else scored.unionByName(held)
    scored = scored.persist(StorageLevel.DISK_ONLY)
    slopes, offsets = [], []
    for j in [1] if n_classes <= 2 else range(n_classes):
        rows = scored.select(array_to_vector(F.array(F.col("m")[j])).alias("features"),
                             (F.col("label") == j).cast("double").alias("label"))
        sigmoid = LogisticRegression(maxIter=100).fit(rows)
        slopes.append(float(sigmoid.coefficients[0]))
        offsets.append(float(sigmoid.intercept))
    scored.unpersist()
    return MarginProbability(slopes, offsets)


class KnnClassifierModel(Model, MLWritable, MLReadable):
    """M5: k-NN vote (uniform, ties -> smallest label) against the training
    rows by the block index; ``probability`` holds the shares of the votes.
    Rows of equal features share their neighbours, so queries need no key."""

    def __init__(self, train: DataFrame, features: list[str], k: int, n_classes: int):
        super().__init__()
        self.train, self.features, self.k, self.n_classes = train, features, k, n_classes

    def _transform(self, df: DataFrame) -> DataFrame:
        from ..functions.neighbors import nearest

        vec = F.array(*[F.col(f).cast("double") for f in self.features])
        told = F.concat_ws(":", F.xxhash64(vec).cast("string"), F.xxhash64(F.lit("second"), vec).cast("string"))
        keyed = df.withColumn("__vec_id", told)
        nn = nearest(keyed.select(F.col("__vec_id").alias("qid"), vec.alias("vec")).dropDuplicates(["qid"]),
                     self.train.select("did", "vec"), self.k, len(self.features))
        votes = nn.join(self.train.select("did", "label"), "did").groupBy("qid").agg(
            *[F.count_if(F.col("label") == j).alias(f"v{j}") for j in range(self.n_classes)])
        counts = F.array(*[F.col(f"v{j}").cast("double") for j in range(self.n_classes)])
        total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
        best = votes.select(F.col("qid").alias("__vec_id"), counts.alias("c")).select(
            "__vec_id", (F.array_position("c", F.array_max("c")) - 1).cast("double").alias("prediction"),
            array_to_vector(F.transform("c", lambda x: F.try_divide(x, total))).alias("probability"))
        return keyed.join(best, "__vec_id", "left").drop("__vec_id")

    def write(self):
        return _KnnWriter(self)

    @classmethod
    def read(cls):
        return _KnnReader()


class _KnnWriter(MLWriter):
    def __init__(self, model: KnnClassifierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession,
                                         {"features": m.features, "k": m.k, "n_classes": m.n_classes})
        m.train.write.parquet(f"{path}/train")


class _KnnReader(MLReader):
    def load(self, path: str) -> KnnClassifierModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = KnnClassifierModel(self.sparkSession.read.parquet(f"{path}/train"), meta["features"], meta["k"],
                                   meta["n_classes"])
        model._resetUid(meta["uid"])
        return model


class KnnClassifier(Estimator):
    """Keeps the training rows (did, label, vec), written once; ``id_col`` orders
    equal distances where the rows have it."""

    def __init__(self, features: list[str], k: int = 5, id_col: str = "__row_id"):
        super().__init__()
        self.features, self.k, self.id_col = features, k, id_col

    def _fit(self, df: DataFrame) -> KnnClassifierModel:
        did = F.col(self.id_col) if self.id_col in df.columns else F.monotonically_increasing_id()
        vec = F.array(*[F.col(f).cast("double") for f in self.features])
        train = cut_lineage(df.select(did.alias("did"), "label", vec.alias("vec")))
        top = train.agg(F.max("label")).first()[0]
        return KnnClassifierModel(train, self.features, self.k, int(top or 0) + 1)


def make_estimator(algo: str, hp: dict, n_rows: int, n_classes: int, features: list[str],
                   weight_col: str | None = None, seed: int = 42):
    """Spark ML estimator with the reference's defaults.

    M1 logistic regression (regParam = 1/(C n)); M2 random forest (sqrt
    features, depth <= 30); M3 boosted trees -> GBTClassifier (one-vs-rest for
    > 2 classes); M4 SVM -> LinearSVC, RBF via random Fourier features; M5 k-NN
    (exact, by the block index); M6 OLS (normal equations); M7 ridge
    (regParam = alpha/n); M8 lasso (L1, regParam = alpha); M9 random forest
    regressor (all features per split); M10 boosted regressor -> GBTRegressor."""
    hp = dict(hp or {})
    kw = {"featuresCol": "features", "labelCol": "label"}
    if weight_col:
        kw_w = {"weightCol": weight_col}
    else:
        kw_w = {}
    depth = hp.get("max_depth")
    if algo == "logistic_regression":
        c = float(hp.get("C", 1.0))
        return LogisticRegression(regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0, standardization=False,
                                  maxIter=int(hp.get("max_iter", 1000)), family="auto", **kw, **kw_w)
    if algo == "random_forest":
        return RandomForestClassifier(numTrees=int(hp.get("n_estimators", 100)),
                                      maxDepth=min(int(depth), SPARK_MAX_DEPTH) if depth else SPARK_MAX_DEPTH,
                                      featureSubsetStrategy="sqrt", seed=seed, **kw, **kw_w)
    if algo == "xgboost":
        gbt = GBTClassifier(maxIter=int(hp.get("n_estimators", 100)), maxDepth=int(hp.get("max_depth", 6) or 6),
                            stepSize=float(hp.get("learning_rate", 0.3)), seed=seed, **kw, **kw_w)
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt, **kw)
    if algo == "svm":
        c = float(hp.get("C", 1.0))
        svc = LinearSVC(regParam=1.0 / (c * max(n_rows, 1)), maxIter=20, tol=1e-3, **kw, **kw_w)
        est = svc if n_classes <= 2 else OneVsRest(classifier=svc, **kw)
        return est
    if algo == "knn":
        return KnnClassifier(features, int(hp.get("n_neighbors", 5)))
    if algo == "linear_regression":
        return LinearRegression(regParam=0.0, solver="normal", **kw, **kw_w)
    if algo == "ridge":
        return LinearRegression(regParam=float(hp.get("alpha", 1.0)) / max(n_rows, 1), elasticNetParam=0.0,
                                standardization=False, solver="normal", **kw, **kw_w)
    if algo == "lasso":
        return LinearRegression(regParam=float(hp.get("alpha", 1.0)), elasticNetParam=1.0, standardization=False,
                                maxIter=1000, **kw, **kw_w)
    if algo == "random_forest_regressor":
        return RandomForestRegressor(numTrees=int(hp.get("n_estimators", 100)),
                                     maxDepth=min(int(depth), SPARK_MAX_DEPTH) if depth else SPARK_MAX_DEPTH,
                                     featureSubsetStrategy="all", seed=seed, **kw, **kw_w)
    if algo == "xgboost_regressor":
        return GBTRegressor(maxIter=int(hp.get("n_estimators", 100)), maxDepth=int(hp.get("max_depth", 6) or 6),
                            stepSize=float(hp.get("learning_rate", 0.3)), seed=seed, **kw, **kw_w)
    raise ValueError(f"Invalid algorithm: {algo}")


def fit(algo: str, train: DataFrame, features: list[str], problem: str, hp: dict | None = None,
        weight_col: str | None = None, n_classes: int | None = None, seed: int = 42,
        n_rows: int | None = None) -> PipelineModel:
    """Assemble features and fit one model; returns a PipelineModel.
    ``n_rows`` and ``n_classes`` spare their count where the caller knows them."""
    n = train.count() if n_rows is None else n_rows
    if problem == "classification" and n_classes is None:
        n_classes = train.select("label").distinct().count()
    hp = dict(hp or {})
    stages = []
    feats = list(features)
    if algo == "svm" and hp.get("kernel", "rbf") == "rbf":
        var = train.agg(F.avg(F.lit(0.0) + sum((F.col(f) * F.col(f) for f in feats), F.lit(0.0)) / len(feats)).alias("m2"),
                        *[F.avg(F.col(f)).alias(f"m_{i}") for i, f in enumerate(feats)]).collect()[0]
        mean_sq = sum(var[f"m_{i}"] ** 2 for i in range(len(feats))) / len(feats)
        x_var = max(var["m2"] - mean_sq, 1e-12)
        rff = RandomFourierFeatures(feats, 1.0 / (len(feats) * x_var), 100, seed)
        stages.append(rff)
        feats = [f"__rff_{j}" for j in range(rff.n)]
    est = make_estimator(algo, hp, n, n_classes or 0, feats, weight_col, seed)
    if algo != "knn":
        stages.append(VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"))
    stages.append(est)
    if algo == "svm":
        stages.append(calibrate(stages, train, features, n_classes or 0))
    return Pipeline(stages=stages).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def evaluate(pred: DataFrame, problem: str) -> dict:
    """Test metrics (4 dp) from a prediction frame (label, prediction[, probability])."""
    if problem == "classification":
        m = EV.classification_metrics(pred, "label", "prediction").collect()[0].asDict()
        if "probability" in pred.columns:
            k = pred.select("label").distinct().count()
            probs = pred.withColumn("__p", vector_to_array("probability"))
            if k == 2:
                auc = EV.roc_auc(probs.withColumn("__s", F.col("__p")[1]), "label", "__s", 1.0).collect()[0][0]
            else:
                n_p = len(probs.select("__p").first()[0])
                cols = {float(i): f"__p{i}" for i in range(n_p)}
                for i in range(n_p):
                    probs = probs.withColumn(f"__p{i}", F.col("__p")[i])
                auc = EV.roc_auc_ovr(probs.withColumn("label", F.col("label").cast("double").cast("string")),
                                     "label", {str(float(i)): f"__p{i}" for i in range(n_p)}).collect()[0][0]
            if auc is not None:
                m["roc_auc"] = auc
        return m
    return EV.regression_metrics(pred, "label", "prediction").collect()[0].asDict()


def _with_row_id(df: DataFrame, key: list[str] | None) -> DataFrame:
    if "__row_id" in df.columns:
        return df
    if key:
        return df.withColumn("__row_id", F.xxhash64(*[F.col(k) for k in key]))
    return df.withColumn("__row_id", F.monotonically_increasing_id())


def evaluate_all(preds: list[tuple], problem: str) -> list[dict]:
    """Metrics (without AUC) of many prediction frames in one grouped job:
    ``preds`` holds (number of the group, frame with label and prediction)."""
    stacked = None
    for g, p in preds:
        part = p.select(F.lit(g).alias("__set"), "label", "prediction")
        stacked = part if stacked is None else stacked.unionByName(part)
    metrics = EV.classification_metrics if problem == "classification" else EV.regression_metrics
    found = {r["__set"]: r.asDict() for r in metrics(stacked, "label", "prediction", ["__set"]).collect()}
    return [found.get(g, {}) for g, _ in preds]


def _folds(train: DataFrame, problem: str, k: int, key: list[str], seed: int) -> tuple[DataFrame, dict, int]:
    """Rows with their fold (written), rows per fold and classes."""
    if not 2 <= k <= 10:
        raise ValueError("cv_folds must be between 2 and 10")
    key = key or ["__row_id"]
    folded = assign_folds(_with_row_id(train, None if key == ["__row_id"] else key), k, key, seed,
                          "label" if problem == "classification" else None).persist(StorageLevel.DISK_ONLY)
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    n_classes = folded.select("label").distinct().count() if problem == "classification" else 0
    return folded, sizes, n_classes


def _fit_folds(algo: str, folded: DataFrame, sizes: dict, n_classes: int, features: list[str], problem: str, draws: list[dict],
               k: int, seed: int, parallelism: int, weight_col: str | None = None) -> list[dict]:
    """One model per draw and fold, fitted side by side; the predictions of all
    are evaluated in one job.  Returns the mean scores of each draw."""
    n = sum(sizes.values())
    todo = [(d, i) for d in range(len(draws)) for i in range(k)]

    def one(task):
        d, i = task
        m = fit(algo, folded.where(F.col("fold") != i), features, problem, draws[d], weight_col, n_classes, seed,
                n - sizes.get(i, 0))
        return m.transform(folded.where(F.col("fold") == i))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        preds = list(ex.map(one, todo))
    scores = evaluate_all(list(enumerate(preds)), problem)
    out = []
    for d in range(len(draws)):
        own = scores[d * k:(d + 1) * k]
        if problem == "classification":
            out.append({"accuracy": sum(s["accuracy"] for s in own) / k, "f1_weighted": sum(s["f1_score"] for s in own) / k})
        else:
            out.append({"r2": sum(s["r2"] for s in own) / k, "rmse": sum(s["rmse"] for s in own) / k})
    return out


def cross_validate(algo: str, train: DataFrame, features: list[str], problem: str, k: int = 5,
                   key: list[str] | None = None, hp: dict | None = None, seed: int = 42,
                   parallelism: int = 4, weight_col: str | None = None) -> dict:
    """Stratified (classification) or plain k-fold with a written
    fold column; returns mean accuracy & f1_weighted, or r2 & rmse."""
    folded, sizes, n_classes = _folds(train, problem, k, key, seed)
    try:
        return _fit_folds(algo, folded, sizes, n_classes, features, problem, [hp or {}], k, seed, parallelism, weight_col)[0]
    finally:
        folded.unpersist()


def sample_params(algo: str, n_iter: int = 5, seed: int = 42) -> list[dict]:
    """Draw up to ``n_iter`` distinct parameter sets from the grid."""
    grid = PARAM_GRIDS.get(algo, {})
    if not grid:
        return []
    keys = sorted(grid)
    combos = [{}]
    for k in keys:
        combos = [dict(c, **{k: v}) for c in combos for v in grid[k]]
    rng = random.Random(seed)
    return rng.sample(combos, min(n_iter, len(combos)))


def tune(algo: str, train: DataFrame, test: DataFrame, features: list[str], problem: str, baseline: dict,
         primary: str, key: list[str] | None = None, seed: int = 42, n_iter: int = 5, folds: int = 3,
         parallelism: int = 4):
    """Random search (<= n_iter draws x folds-fold CV, scoring weighted
    F1 / R2); the best draw replaces the baseline only if its test metric
    improves (lower is better for rmse / mae / mape)."""
    draws = sample_params(algo, n_iter, seed)
    if not draws:
        return None
    score_key = "f1_weighted" if problem == "classification" else "r2"
    folded, sizes, n_classes = _folds(train, problem, folds, key, seed)
    try:
        found = _fit_folds(algo, folded, sizes, n_classes, features, problem, draws, folds, seed, parallelism)
    finally:
        folded.unpersist()
    scored = [(s[score_key], i, hp) for i, (s, hp) in enumerate(zip(found, draws))]
    best_hp = max(scored, key=lambda t: (t[0], -t[1]))[2]
    model = fit(algo, train, features, problem, best_hp, seed=seed)
    metrics = evaluate(model.transform(test), problem)
    lower = primary in LOWER_IS_BETTER
    b, t = baseline.get(primary, 0.0), metrics.get(primary, 0.0)
    improved = (t < b) if lower else (t > b)
    return {"hp": best_hp, "metrics": metrics, "model": model, "improved": improved}


RUN_SCHEMA = ("id int, algorithm string, problem_type string, status string, cv_mean_score double, "
              "accuracy double, precision double, recall double, f1_score double, roc_auc double, "
              "rmse double, mae double, r2 double, mape double, tuned boolean, training_duration_ms bigint, "
              "hyperparameters string, error string")


def train_all(train: DataFrame, test: DataFrame, features: list[str], problem: str, algos: list[str] | None = None,
              cv_folds: int = 5, primary_metric: str | None = None, tuning: bool = True, key: list[str] | None = None,
              hyperparameters: dict | None = None, seed: int = 42, use_class_weight: bool = False):
    """CV -> fit -> evaluate per model (failures isolated), then tune
    the top 3 and flag the winner. Returns (runs DataFrame, {algo: model})."""
    import json

    spark = train.sparkSession
    algos = algos or (CLASSIFIERS if problem == "classification" else REGRESSORS)
    if problem == "classification" and train.select("label").distinct().count() < 2:
        raise ValueError("Target column must have at least 2 classes")
    primary = primary_metric or ("f1_score" if problem == "classification" else "r2")
    train = _with_row_id(train, key).persist()
    test = _with_row_id(test, key)
    weight_col = None
    if use_class_weight and problem == "classification":
        from .split import class_weights
        for name, boosted in (("__w", False), ("__w_boosted", True)):
            w = class_weights(train, "label", boosted).select(F.col("label").alias("__wl"), F.col("weight").alias(name))
            train = train.join(F.broadcast(w), F.col("label").cast("string") == F.col("__wl"), "left").drop("__wl")
        train = train.persist()
        weight_col = {"xgboost": "__w_boosted", "knn": None}
    results, models = {}, {}
    for algo in algos:
        hp = hyperparameters.get(algo) if hyperparameters and isinstance(hyperparameters.get(algo), dict) else \
            {k: v for k, v in (hyperparameters or {}).items() if not isinstance(v, dict)}
        t0 = time.time()
        try:
            cv = cross_validate(algo, train, features, problem, cv_folds, ["__row_id"], hp, seed,
                                weight_col=weight_col and weight_col.get(algo, "__w"))
            model = fit(algo, train, features, problem, hp, weight_col and weight_col.get(algo, "__w"), seed=seed)
            metrics = evaluate(model.transform(test), problem)
            metrics["cv_mean_score"] = cv.get("f1_weighted", cv.get("r2"))
            results[algo] = {"status": "completed", "metrics": metrics, "hp": hp, "tuned": False,
                             "ms": int((time.time() - t0) * 1000)}
            models[algo] = model
        except Exception as e:  # noqa: BLE001 - one model failing must not stop the run
            results[algo] = {"status": "failed", "metrics": {}, "hp": hp, "tuned": False,
                             "ms": int((time.time() - t0) * 1000), "error": repr(e)[:500]}
    done = [a for a in algos if results[a]["status"] == "completed"]
    if not done:
        raise RuntimeError("no models trained successfully")
    if tuning:
        lower = primary in LOWER_IS_BETTER
        ranked = sorted(done, key=lambda a: results[a]["metrics"].get(primary, 0.0), reverse=not lower)
        for algo in ranked[:3]:
            try:
                t = tune(algo, train, test, features, problem, results[algo]["metrics"], primary, ["__row_id"], seed)
            except Exception:  # noqa: BLE001
                t = None
            if t and t["improved"]:
                t["metrics"]["cv_mean_score"] = results[algo]["metrics"].get("cv_mean_score")
                results[algo].update({"metrics": t["metrics"], "hp": t["hp"], "tuned": True})
                models[algo] = t["model"]
    rows = []
    for i, algo in enumerate(algos):
        r = results[algo]
        m = r["metrics"]
        rows.append((i + 1, algo, problem, r["status"], m.get("cv_mean_score"), m.get("accuracy"), m.get("precision"),
                     m.get("recall"), m.get("f1_score"), m.get("roc_auc"), m.get("rmse"), m.get("mae"), m.get("r2"),
                     m.get("mape"), r["tuned"], r["ms"], json.dumps(r["hp"], default=str), r.get("error")))
    runs = spark.createDataFrame(rows, RUN_SCHEMA).withColumn("job_id", F.lit(1))
    from .runs import leaderboard
    return leaderboard(runs, primary), models
