"""Training, explanation and scoring on the reference's tiny training table."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import explain as EX
from tablewright.operators import score as SC
from tablewright.operators import train as TR


@pytest.fixture(scope="module")
def train50(spark):
    rows = [(i, float(i), float(2 * i), 1.0 if i > 25 else 0.0) for i in range(1, 51)]
    return spark.createDataFrame(rows, "id long, feature_a double, feature_b double, label double").coalesce(1)


def test_fit_and_evaluate(train50):
    m = TR.fit("logistic_regression", train50, ["feature_a", "feature_b"], "classification")
    met = TR.evaluate(m.transform(train50), "classification")
    assert met["accuracy"] > 0


def test_train_all_flags_one_best(train50):
    runs, models = TR.train_all(train50, train50, ["feature_a", "feature_b"], "classification",
                                algos=["logistic_regression", "knn"], cv_folds=2, tuning=False, key=["id"])
    rows = runs.collect()
    assert sum(r["is_best"] for r in rows) == 1 and all(r["status"] == "completed" for r in rows)


def test_waterfall_contributions_sum(spark, train50):
    base = {"feature_a": 25.5, "feature_b": 51.0}
    score = EX.linear_score({"feature_a": 0.3, "feature_b": -0.1}, 2.0)
    w = EX.waterfall(train50, ["feature_a", "feature_b"], base, ["id"], score)
    tot = {r["id"]: r["s"] for r in w.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    for r in train50.collect():
        full = 2.0 + 0.3 * r["feature_a"] - 0.1 * r["feature_b"]
        b = 2.0 + 0.3 * 25.5 - 0.1 * 51.0
        assert abs(tot[r["id"]] - (full - b)) < 1e-5


def test_prediction_column_layout(spark):
    df = spark.createDataFrame([(1, 0, 5.0)], "id long, target long, x double")
    out = SC.layout_predictions(df.withColumn("prediction", F.lit(1)), "target")
    assert out.columns == ["id", "target", "target(predicted)", "x"]


def test_feature_check(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    st = {r["column_name"]: r["status"] for r in SC.check_features(df, ["a", "c"]).collect()}
    assert st == {"a": "ok", "b": "extra", "c": "missing"}


def test_stream_scoring_matches_batch(spark, tmp_path):
    from tablewright.config import PipelineConfig
    from tablewright.plans.prepare import prepare
    from tablewright.streaming.scoring import stream_predict

    rows = [(i, float(i % 7), "ab"[i % 2], 1 if i % 3 == 0 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y long")
    p = prepare(df, PipelineConfig(target_column="y", key_columns=("id",)))
    feats = p.model.feature_names()
    m = TR.fit("logistic_regression", p.train, feats, "classification")
    bundle = SC.Bundle(p.model, m, feats, "y")
    src = str(tmp_path / "in")
    df.write.parquet(src)
    q = stream_predict(spark, src, bundle, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    streamed = {r["id"]: r["y(predicted)"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["id"]: r["y(predicted)"] for r in SC.predict(bundle, df).collect()}
    assert streamed == batch and len(batch) == 60


ALGOS = [("logistic_regression", {}), ("random_forest", {"n_estimators": 5, "max_depth": 3}), ("xgboost", {"n_estimators": 3}),
         ("svm", {"kernel": "linear"}), ("svm", {"kernel": "rbf"}), ("knn", {"n_neighbors": 3})]


@pytest.mark.parametrize("algo,hp", ALGOS)
def test_every_classifier_has_probabilities_and_can_be_saved(spark, train50, tmp_path, algo, hp):
    from pyspark.ml import PipelineModel

    feats = ["feature_a", "feature_b"]
    m = TR.fit(algo, train50.withColumnRenamed("id", "__row_id"), feats, "classification", hp)
    m.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    asked = train50.select("id", "label", *feats)
    rows = [{r["id"]: (r["prediction"], tuple(r["probability"])) for r in x.transform(asked).collect()} for x in (m, again)]
    assert rows[0] == rows[1] and len(rows[0]) == 50
    assert all(abs(sum(p) - 1) < 1e-9 for _, p in rows[0].values())
    if algo != "xgboost":
        assert TR.evaluate(m.transform(asked), "classification")["roc_auc"] > 0.95


def test_margins_of_three_classes_become_probabilities(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([([2.0, -1.0, -3.0],), ([-2.0, -2.0, 4.0],)], "m array<double>")
    got = TR.MarginProbability([1.0, 2.0, 0.5], [0.0, 0.1, -0.2]).transform(
        df.select(array_to_vector("m").alias("rawPrediction"))).collect()
    assert [max(range(3), key=lambda j: r["probability"][j]) for r in got] == [0, 2]
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in got)


@pytest.mark.parametrize("algo", ["linear_regression", "ridge", "lasso", "random_forest_regressor", "xgboost_regressor"])
def test_regressors_can_be_saved(spark, train50, tmp_path, algo):
    from pyspark.ml import PipelineModel

    df = train50.withColumn("label", F.col("feature_a") * 3 - 1)
    m = TR.fit(algo, df, ["feature_a"], "regression", {"n_estimators": 3, "max_depth": 3, "alpha": 0.01})
    m.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert [r["prediction"] for r in m.transform(df).orderBy("id").collect()] == \
        [r["prediction"] for r in again.transform(df).orderBy("id").collect()]
