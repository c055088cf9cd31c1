"""Helpers shared by the operators of this folder: table reads, written
intermediates in the shared folder and digests."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import checkpoint_dir, ship_package

#: Words as most contracts count them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that removes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder; the file system
    removes it when the application ends."""
    path = f"{checkpoint_dir(spark)}/tw-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


#: The folders made by :func:`materialize`, one list per open :func:`temporary`.
_owned: ContextVar[tuple] = ContextVar("owned", default=())


@contextmanager
def temporary(spark: SparkSession):
    """Folders that :func:`materialize` makes inside go at the end, but those
    made with ``outer``, which belong to the next :func:`temporary` around, or
    stay until the application ends if there is none."""
    made: list[str] = []
    token = _owned.set((*_owned.get(), made))
    try:
        yield
    finally:
        _owned.reset(token)
        for path in made:
            _delete(spark, path)


def materialize(df: DataFrame, name: str, outer: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder (a folder per value of
    ``by``) and read it back: cuts lineage, survives lost executors and is
    column-pruned when read.  The shuffle files of the write go when it is
    done: nothing reads them again.  For ``outer`` see :func:`temporary`."""
    spark = df.sparkSession
    path = scratch(spark, name)
    owners = _owned.get()[:-1] if outer else _owned.get()
    if owners:
        owners[-1].append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a frame made by :func:`materialize` (without ``by``)."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(col) -> F.Column:
    """Number of words (:data:`WORD`); a null text has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols) -> F.Column:
    """Uniform number in [0, 1) from the md5 of the columns' texts (52 bits,
    the same in any SQL engine); nulls hash as the empty text."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c
                              for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows (reads no more than that)."""
    return df.limit(rows + 1).count() <= rows


def map_texts(df: DataFrame, text: str, fields: str, make, carry: list[str] | None = None,
              block: int = 256) -> DataFrame:
    """Append columns computed from a text column, batch by batch in Arrow.

    ``make()`` runs once per task and returns ``fn(texts) -> {name: values}``
    for lists of at most ``block`` texts (a null text arrives as None).  The
    result holds ``row``, a struct of the ``carry`` columns (default: all), and
    the ``fields`` (DDL); nothing in ``row`` can clash with them."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(fields)
    names = schema.names
    kinds = _arrow_types(schema)
    ship_package(df.sparkSession)
    given = df.select(F.struct(*(carry or df.columns)).alias("row"), F.col(text).alias("text"))

    def run(batches):
        fn = make()
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, block):
                got = fn(texts.slice(at, block).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(at, block), *[pa.array(got[n], kinds[n]) for n in names]], ["row", *names])

    out = StructType(given.schema.fields[:1] + schema.fields)
    return given.mapInArrow(run, out)


def arrow_schema(fields: str):
    """Arrow's form of a DDL schema (made on the driver, used in tasks)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields))


def record_batch(schema, rows: list[dict]):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow_types(schema) -> dict:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema.fields}
