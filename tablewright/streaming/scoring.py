"""Streaming scoring: the batch scoring bundle applied to a Structured
Streaming source (M44 on ``readStream``).  The preprocessor's lookup maps are
static DataFrames, so encoders become stream-static joins; the Spark ML model
transforms micro-batches directly.  Exactly-once via the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.score import Bundle, predict


def scored_stream(bundle: Bundle, stream: DataFrame) -> DataFrame:
    """Lazy streaming DataFrame of predictions (same layout as batch)."""
    return predict(bundle, stream, check_empty=False)


def stream_predict(spark: SparkSession, source_path: str, bundle: Bundle, sink_path: str, checkpoint: str,
                   schema=None, fmt: str = "parquet", available_now: bool = True):
    """Score every file arriving under ``source_path`` into ``sink_path``.

    ``available_now`` processes what is there and stops (batch-like backfill);
    otherwise the query keeps running with the default trigger."""
    schema = schema or spark.read.format(fmt).load(source_path).schema
    stream = spark.readStream.format(fmt).schema(schema).load(source_path)
    writer = (scored_stream(bundle, stream).writeStream.format("parquet").option("path", sink_path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
