"""Writers.  Every writer is a Spark job writing partitioned files
to the given (shared) path; nothing is funnelled through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str) -> None:
    """K1 / K4: table -> CSV with a header; times as ``2026-01-02 03:04:05.000000``,
    quotes inside a cell doubled."""
    df.write.mode("overwrite").options(header=True, escape='"', timestampFormat=TIME, timestampNTZFormat=TIME).csv(path)


export_table = write_csv


def export_splits(spark, path: str, out: str) -> None:
    """K3: processed Parquet splits -> CSV ``train_preprocessed`` / ``test_preprocessed``."""
    for name in ("train", "test"):
        write_csv(spark.read.parquet(f"{path}/{name}"), f"{out}/{name}_preprocessed")


def preview(df: DataFrame, order_by: list, n: int = 100) -> DataFrame:
    """K5: first ``n`` rows in an explicit order."""
    return df.orderBy(*order_by).limit(n)


def write_predictions(df: DataFrame, path: str) -> None:
    """K5: predictions -> CSV."""
    write_csv(df, path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN / +-Inf -> NULL in every floating column (JSON has neither)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            out.append(F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def report_frame(sections: dict) -> DataFrame:
    """K6: union of report sections as (section, json) rows."""
    frames = []
    for name, df in sections.items():
        safe = json_safe(df)
        frames.append(safe.select(F.lit(name).alias("section"), F.to_json(F.struct(*safe.columns)).alias("json")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_report(sections: dict, path: str) -> None:
    """K6: JSON report sink."""
    report_frame(sections).write.mode("overwrite").json(path)


def run_report(sections: dict) -> DataFrame:
    """Run summary (before/after counts, steps, leaderboard, metrics)
    as one (section, json) frame."""
    return report_frame(sections)
