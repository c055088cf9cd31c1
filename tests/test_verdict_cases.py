"""Inputs outside the fixtures: nested duplicates, null timestamps, large counts, late bad dates."""

import datetime as dt

import math

import pytest

from tablewright.operators import clean, evaluate, explain, prepare, profile, runs, split
from tablewright.sources import readers


def test_nested_columns_count_as_values(spark):
    df = spark.createDataFrame([(1, [1, 2], {"a": 1}), (1, [3, 4], {"a": 1}), (2, [0, 0], {}), (2, [0, 0], {})],
                               "k int, v array<int>, m map<string,int>")
    assert profile.duplicates(df).first()["count"] == 1
    out, log = clean.remove_duplicates(df)
    assert out.count() == 3 and out.columns == df.columns and log[0]["rows_affected"] == 1


def test_latest_keeps_records_without_a_time(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None), (2, "c", dt.datetime(2026, 1, 1))],
                               "id int, x string, updated_at timestamp")
    assert {r["id"]: r["x"] for r in runs.latest(df).collect()} == {1: "a", 2: "c"}


def test_auc_of_large_counts(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.6)], "y int, score double")
    assert evaluate.roc_auc(df).first()["roc_auc"] == 0.75


def test_a_date_column_needs_every_value(spark):
    rows = [(i, "2026-01-02", "2026-01-02") for i in range(60)] + [(60, "2026-01-02", "no day")]
    df = spark.createDataFrame(rows, "k int, good string, late string")
    assert {r["column_name"] for r in prepare.datetime_columns(df, ["k"]).collect()} == {"good"}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_duplicate_values_of_many_values(spark):
    words = [f"item number {i}" for i in range(130)] + ["aaaaaaaaaa", "aaaaaaaaa", "abcdef", "abcdeg", "a", "b", "", "é" * 6, "é" * 5 + "e"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "v string")
    want = {(a, b) for a in words for b in words
            if a < b and 1 - _edits(a, b) / max(len(a), len(b)) > 0.8}
    got = {(r["value_a"], r["value_b"]) for r in clean.near_duplicate_values(df, "v").collect()}
    assert got == want and len(want) > 100


def test_row_and_split_by_large_keys(spark):
    base = 2 ** 60
    df = spark.createDataFrame([(base + i, dt.datetime(2026, 1, 1)) for i in range(10)], "k long, t timestamp")
    assert [r["k"] for r in explain.row_at(df, "k", 3).collect()] == [base + 3]
    train, test = split.split_chronological(df, "t", 0.5, "k")
    assert sorted(r["k"] - base for r in train.collect()) == [0, 1, 2, 3, 4] and test.count() == 5


def test_numbers_with_type_suffixes_are_text(spark):
    df = spark.createDataFrame([("10d", "1.5", "7"), ("20f", "-2e3", "8")], "a string, b string, c string")
    assert [t for _, t in readers.infer_types(df).dtypes] == ["string", "double", "bigint"]


def test_infinite_values_have_no_spread(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (math.inf,), (4.0,), (5.0,)], "x double")
    r = profile.numeric_summary(df, ["x"]).first()
    assert r["std"] is None and r["skewness"] is None and r["kurtosis"] is None and r["median"] == 4.0


def test_contributions_sum_to_the_difference_of_one_class(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, i * 0.5 - 2, 1.0 - i * 0.3) for i in range(9)], "k int, a double, b double")

    def score(d):  # two classes; the predicted one changes along the steps
        p = 1 / (1 + F.exp(-(F.col("a") * 2 - F.col("b") * 3)))
        return d.withColumn("__p", F.array(1 - p, p)).withColumn("prediction", (p > 0.5).cast("double"))
    steps = explain.waterfall(df, ["a", "b"], {"a": 0.1, "b": -0.2}, ["k"], score)
    total = {r["k"]: r["s"] for r in steps.groupBy("k").agg(F.sum("contribution").alias("s")).collect()}
    p = lambda a, b: 1 / (1 + math.exp(-(a * 2 - b * 3)))
    for r in df.collect():
        one, base = p(r["a"], r["b"]), p(0.1, -0.2)
        assert total[r["k"]] == pytest.approx(one - base if one > 0.5 else base - one)


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.nan), (3, None), (4, 3.0)], "k int, x double")
    filled, _ = clean.fill_statistic(df, "x", "mean")
    assert sorted(r["x"] for r in filled.collect()) == [1.0, 2.0, 2.0, 3.0]
    assert clean.drop_missing_rows(df, "x")[0].count() == 2
    got = {r["column_name"]: r["missing_count"] for r in clean.cleaning_suggestions(df).collect()}
    assert got["x"] == 2
    assert [r["x"] for r in profile.missingness_matrix(df, ["k"], 4).orderBy("row_idx").collect()] == [0, 1, 1, 0]
    imputed = prepare.apply_imputer(df, prepare.fit_imputer(df, "mean", cols=["x"]))
    assert sorted(r["x"] for r in imputed.collect()) == [1.0, 2.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        prepare.assert_no_missing(df.where("k < 3"))


def test_synthetic_rows_have_keys_and_folds(spark):
    rows = [(i, float(i % 7), float(i % 5), "a" if i < 30 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, x double, z double, y string")
    out = split.smote(df, "y", ["x", "z"], "k", k=3)
    assert out.count() == 60 and out.where("k is null").count() == 0
    assert out.select("k").distinct().count() == 60
    folds = split.assign_folds(out, 4, ["k"], stratify="y")
    assert folds.where("fold between 0 and 3").count() == 60
    text = split.smote(df.withColumn("k", df.k.cast("string")), "y", ["x", "z"], "k", k=3)
    assert text.select("k").distinct().count() == 60
    with pytest.raises(Exception, match="a fold needs a key"):
        split.assign_folds(spark.createDataFrame([(1,), (None,)], "k int"), 2, ["k"]).collect()


def test_csv_rows_wider_than_the_header_fail(spark, tmp_path):
    bad, short = tmp_path / "bad.csv", tmp_path / "short.csv"
    bad.write_text("a,b\n1,2\n3,4,5\n")
    short.write_text('a,b\n1,2\n3\n"x, ""y""\nz",7\n')
    with pytest.raises(Exception, match="more cells than the header"):
        readers.read_table(spark, str(bad)).count()
    with pytest.raises(Exception, match="more cells than the header"):
        readers.read_table(spark, str(bad), infer=False).select("a").collect()
    got = [tuple(r) for r in readers.read_table(spark, str(short)).collect()]
    assert got == [("1", 2), ("3", None), ('x, "y"\nz', 7)]


def test_workbooks_meet_by_column_name(spark, tmp_path):
    from test_sources_entry import _xlsx_bytes
    (tmp_path / "a.xlsx").write_bytes(_xlsx_bytes([["x", "y"], ["1", "a"], ["2", "b", "more"]]))
    (tmp_path / "b.xlsx").write_bytes(_xlsx_bytes([["y", "z", "x"], ["c", "9", "3"]]))
    df = readers.read_table(spark, str(tmp_path), "xlsx")
    got = {(r["x"], r["y"], r["z"], r["column_2"]) for r in df.collect()}
    assert got == {(1, "a", None, None), (2, "b", None, "more"), (3, "c", 9, None)}
    with pytest.raises(ValueError):
        readers.read_table(spark, "/none/old.xls")
