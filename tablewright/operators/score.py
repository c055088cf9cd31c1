"""Scoring (M44-M48): batch prediction with a bundle, schema checks, label
decoding and output layout.  ``predict`` works on streaming DataFrames too
(minus the empty-input check)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Bundle:
    """K9: fitted preprocessor + fitted model = one scoring artifact; ``save``
    persists both (K7 preprocessor, K8 model)."""
    prep: object            # plans.prepare.FittedPreprocessor
    model: PipelineModel
    features: list
    target: str

    def save(self, path: str) -> None:
        self.prep.save(f"{path}/prep")
        self.model.write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(spark, path: str) -> "Bundle":
        from ..plans.prepare import FittedPreprocessor
        prep = FittedPreprocessor.load(spark, f"{path}/prep")
        return Bundle(prep, PipelineModel.load(f"{path}/model"), prep.feature_names(), prep.target)


def check_features(df: DataFrame, expected: list[str]) -> DataFrame:
    """Per column name: ok / missing / extra (full outer join of the
    two name lists)."""
    spark = df.sparkSession
    have = spark.createDataFrame([(c,) for c in df.columns], "column_name string").withColumn("h", F.lit(True))
    want = spark.createDataFrame([(c,) for c in expected], "column_name string").withColumn("w", F.lit(True))
    j = have.join(want, "column_name", "full")
    return j.select("column_name", F.when(F.col("h") & F.col("w"), "ok").when(F.col("w"), "missing")
                    .otherwise("extra").alias("status"))


def assert_features(df: DataFrame, expected: list[str]) -> None:
    missing = [c for c in expected if c not in df.columns]
    extra = [c for c in df.columns if c not in expected]
    if missing:
        raise ValueError(f"Missing columns: {missing}; unexpected columns: {extra}")


def choose_scoring_mode(df: DataFrame, raw_columns: list[str], processed_columns: list[str],
                        flag: str | None = None) -> tuple[str, DataFrame]:
    """M46: 'processed' when the input's column set equals the processed
    feature set (or the flag says so), else 'raw'; reorders columns."""
    cols = set(df.columns)
    if flag in ("raw", "processed"):
        mode = flag
    elif cols == set(processed_columns):
        mode = "processed"
    else:
        mode = "raw"
    order = processed_columns if mode == "processed" else [c for c in raw_columns if c in cols]
    return mode, df.select(*order, *[c for c in df.columns if c not in order])


def predict(bundle: Bundle, df: DataFrame, mode: str = "raw", check_empty: bool = True) -> DataFrame:
    """Reject empty input, drop the target, transform, keep every input
    column, decode labels, lay out the prediction column (M47/M48)."""
    if check_empty and not df.isStreaming and df.isEmpty():
        raise ValueError("input has no rows")
    t = bundle.target
    keep = list(df.columns)
    # carry the input under private names: encoded features may reuse a name
    carried = [F.col(c).alias(f"__in_{i}") for i, c in enumerate(keep)]
    src = df.select(*[F.col(c) for c in keep if c != t], *carried)
    cin = [f"__in_{i}" for i in range(len(keep))]
    feats = bundle.prep.transform(src, keep=cin) if mode == "raw" else src
    feats = feats.select(*cin, *[F.col(f) for f in bundle.features])
    out = bundle.model.transform(feats)
    back = [F.col(f"__in_{i}").alias(c) for i, c in enumerate(keep)]
    out = out.select(*back, F.col("prediction").alias("__pred"))
    if bundle.prep.labels is not None:
        out = decode_labels(out, "__pred", bundle.prep.labels)
    return layout_predictions(out, t, "__pred")


def decode_labels(pred: DataFrame, col: str, labels: DataFrame, index: str = "index", label: str = "label") -> DataFrame:
    """Index -> label through the label table, broadcast while it is small."""
    from .prepare import _maybe_broadcast

    table = labels.select(F.col(index).cast("double").alias("__i"), F.col(label).alias("__l"))
    return (pred.join(_maybe_broadcast(table, labels.count()), F.col(col).cast("double") == F.col("__i"), "left")
            .withColumn(col, F.col("__l")).drop("__i", "__l"))


def layout_predictions(df: DataFrame, target: str | None, pred_col: str = "prediction") -> DataFrame:
    """``target(predicted)`` right after the target column when the
    input has it, else ``prediction`` last."""
    cols = [c for c in df.columns if c != pred_col]
    if target and target in cols:
        i = cols.index(target) + 1
        order = [F.col(c) for c in cols[:i]] + [F.col(pred_col).alias(f"{target}(predicted)")] + [F.col(c) for c in cols[i:]]
        return df.select(*order)
    name = f"{target}(predicted)" if target else "prediction"
    return df.select(*[F.col(c) for c in cols], F.col(pred_col).alias(name))
