"""A run as files: what cleaned, prepared and scored a table,
with digests, replayed by one plan; and the reports of cleaning runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleaningConfig, MissingStrategy, OutlierStrategy
from ..operators import score as SC
from .cleaning import CleaningResult, clean

VERSION = 1


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def cleaning_config(plain: dict) -> CleaningConfig:
    c = dict(plain)
    c["missing_strategies"] = tuple(MissingStrategy(**m) for m in c.get("missing_strategies", ()))
    c["outlier_strategies"] = tuple(OutlierStrategy(**o) for o in c.get("outlier_strategies", ()))
    c["order_by"], c["partition_by"] = tuple(c.get("order_by", ())), tuple(c.get("partition_by", ()))
    return CleaningConfig(**c)


def write_manifest(spark: SparkSession, path: str, cleaning: CleaningConfig, key: str, bundle: SC.Bundle,
                   columns: list[str], model: dict) -> None:
    """The manifest (one JSON text) beside the bundle it names.  ``model`` holds
    algorithm, hyperparameters and metrics; ``columns`` the columns it was made of."""
    bundle.save(f"{path}/bundle")
    body = {"version": VERSION, "cleaning": asdict(cleaning), "key": key, "columns": columns, "features": bundle.features,
            "target": bundle.target, "model": model}
    text = json.dumps(body, sort_keys=True, default=str)
    rows = [(json.dumps({"body": text, "sha256": _digest(text)}),)]
    spark.createDataFrame(rows, "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest's body; one of another version or digest is an error."""
    outer = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if _digest(outer["body"]) != outer["sha256"]:
        raise ValueError("the manifest does not match its digest")
    body = json.loads(outer["body"])
    if body["version"] != VERSION:
        raise ValueError(f"manifest version {body['version']}, expected {VERSION}")
    return body


def replay(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """Clean, prepare and score ``df`` as the manifest says.  A column of the
    manifest that ``df`` lacks (but the target) is an error."""
    body = read_manifest(spark, path)
    SC.assert_features(df, [c for c in body["columns"] if c != body["target"]])
    bundle = SC.Bundle.load(spark, f"{path}/bundle")
    return SC.predict(bundle, clean(df, cleaning_config(body["cleaning"]), key=body["key"]).data)


def write_cleaning_report(result: CleaningResult, path: str, run: int) -> None:
    """Append one run's record: counts before and after, and its steps."""
    steps = result.log.agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "step"))), lambda x: x["step"]).alias("steps"))
    one = F.lit(1).alias("one")
    before, after = (x.select(one, F.struct(F.col("row_count").cast("bigint").alias("row_count")).alias(n))
                     for x, n in ((result.before, "before"), (result.after, "after")))
    row = before.join(after, "one").join(steps.withColumn("one", one), "one")
    row.select(F.lit(run).alias("id"), F.current_timestamp().alias("created_at"), "before", "after", "steps") \
        .write.mode("append").parquet(path)
