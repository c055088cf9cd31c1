"""Cleaning, preparation and splitting invariants."""

import pytest
from pyspark.sql import functions as F

from tablewright.config import CleaningConfig, MissingStrategy, OutlierStrategy, PipelineConfig, SplitConfig
from tablewright.operators import clean as C
from tablewright.operators import prepare as PR
from tablewright.operators import split as SP
from tablewright.plans.cleaning import clean
from tablewright.plans.fixtures import view
from tablewright.plans.prepare import FittedPreprocessor, prepare


def test_clean_run_order_and_log(spark, sf):
    df = view(spark, sf, "orders_dirty")
    cfg = CleaningConfig(missing_strategies=(MissingStrategy("price", "median"), MissingStrategy("priority", "mode")),
                         outlier_strategies=(OutlierStrategy("price", "winsorize"),))
    res = clean(df, cfg, key="o_orderkey")
    assert res.data.where(F.col("price").isNull() | F.col("priority").isNull()).count() == 0
    steps = [r["step"] for r in res.log.orderBy("seq").collect()]
    assert steps[0] == "remove_duplicates"
    assert res.data.count() == df.distinct().count()


def test_standardize_keeps_nulls(spark):
    df = spark.createDataFrame([(" A ",), ("b",), (None,), ("B",)], "c string")
    out, logs = C.standardize_text(df)
    assert sorted([r[0] for r in out.collect()], key=lambda v: (v is None, v)) == ["a", "b", "b", None]


def test_bad_strategy_rejected():
    with pytest.raises(ValueError):
        MissingStrategy("x", "interpolate")


def test_split_exact_disjoint_complete(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    tr, te = SP.split(orders, 0.2, 42, ["o_orderkey"], "o_orderstatus")
    n = orders.count()
    assert te.count() == -(-n * 2 // 10)
    assert tr.join(te, "o_orderkey").count() == 0 and tr.count() + te.count() == n


def test_chronological_three_rows(spark):
    df = spark.createDataFrame([("2026-07-03", 30, 1), ("2026-07-01", 10, 0), ("2026-07-02", 20, 0)],
                               "date string, feature long, target long")
    tr, te = SP.split_chronological(df, "date", 0.33, "feature")
    assert sorted(r["feature"] for r in tr.collect()) == [10, 20] and [r["feature"] for r in te.collect()] == [30]


def test_folds_balanced(spark, sf):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    f = SP.assign_folds(lab, 5, ["doc_id"], 42, "quality")
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2


def test_prepare_fit_on_train_and_reload(spark, sf, tmp_path):
    df = view(spark, sf, "doc_labels")
    p = prepare(df, PipelineConfig(target_column="quality", key_columns=("doc_id",), scaling="standard"))
    assert p.train.count() + p.test.count() == df.count()
    feats = p.model.feature_names()
    means = p.train.agg(*[F.avg(c).alias(c) for c in feats if c in p.model.scaler]).collect()[0]
    assert all(abs(v) < 1e-9 for v in means)
    p.model.save(str(tmp_path / "prep"))
    again = FittedPreprocessor.load(spark, str(tmp_path / "prep"))
    assert sorted(again.transform(df).columns) == sorted(p.model.transform(df).columns)


def test_smote_counts(spark, sf):
    df = view(spark, sf, "doc_labels")
    out = SP.smote(df, "quality", ["n_chars", "toxic"], "doc_id", k=5)
    counts = [r["count"] for r in out.groupBy("quality").count().collect()]
    assert len(set(counts)) == 1


def test_scalers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = [row.x for row in PR.scale(df, ["x"], "robust").orderBy("x").collect()]
    assert [round(v, 6) for v in r] == [-0.5, -0.166667, 0.166667, 2.5]
    m = [row.x for row in PR.scale(spark.createDataFrame([(5.0,), (5.0,)], "x double"), ["x"], "minmax").collect()]
    assert m == [0.0, 0.0]


def test_dtypes_are_read_only_where_signs_are(spark, monkeypatch):
    from tablewright.operators import clean as C

    read = []
    for name in ("numeric_text_expr", "datetime_text_expr"):
        monkeypatch.setattr(C, name, lambda c, name=name, fn=getattr(C, name): read.append((name[:8], c)) or fn(c))
    df = spark.createDataFrame([("1-URGENT", "$1,000", "2024-01-02", None)] * 3 + [("2-HIGH", "2,500", "2024/01/03", None)],
                               "plain string, money string, day string, empty string")
    out, logs = C.fix_dtypes(df)
    assert set(read) == {("numeric_", "money"), ("datetime", "day")}  # each to count, and to convert
    assert [t for _, t in out.dtypes] == ["string", "double", "timestamp_ntz", "string"]
    assert [(e["columns_affected"], e["details"]) for e in logs] == [
        ("money", "stripped currency symbols; removed thousand separators; to number=4"), ("day", "to timestamp=4")]
