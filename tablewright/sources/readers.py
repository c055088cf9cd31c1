"""File readers behind one ``read_table``, type inference over text
columns and ingest validation."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMBER_PATTERN, fold_nan

# Fixed values that must equal the reference: pandas' default missing-value tokens.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl", ".xlsx": "xlsx"}
#: Cells of a CSV row that the header does not name.
CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, path: str, fmt: str | None = None, na_tokens: list[str] | None = None,
               infer: bool = True, multi_line: bool = True) -> DataFrame:
    """S1 CSV (header, NA tokens, inference) / S2 Parquet / S3 JSON (one array
    document; ``jsonl`` for lines) / S4 XLSX: read one table; the format comes
    from the extension unless given, an unknown one is an error.  A CSV row with
    more cells than the header is an error, one with fewer ends in nulls;
    ``multi_line=False`` lets Spark split CSV files that hold no line breaks
    inside quotes."""
    if fmt is None:
        ext = os.path.splitext(path.rstrip("/"))[1].lower()
        if ext not in FORMATS:
            raise ValueError(f"Unsupported format: {ext or path}")
        fmt = FORMATS[ext]
    if fmt == "parquet":
        return fold_nan(spark.read.parquet(path))
    if fmt == "csv":
        df = null_tokens(_read_csv(spark, path, multi_line), na_tokens if na_tokens is not None else NA_TOKENS)
        return infer_types(df) if infer else df
    if fmt == "json":
        return fold_nan(spark.read.option("multiLine", True).json(path))
    if fmt == "jsonl":
        return fold_nan(spark.read.json(path))
    if fmt == "xlsx":
        from .xlsx import read_xlsx
        df = null_tokens(read_xlsx(spark, path), na_tokens if na_tokens is not None else NA_TOKENS)
        return infer_types(df) if infer else df
    raise ValueError(f"Unsupported format: {fmt}")


def _read_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The cells as text.  Rows of another width come with their text in
    ``CORRUPT``; the plan fails where it holds a cell beyond the header."""
    names = spark.read.options(header=True, multiLine=multi_line, escape='"').csv(path).columns
    text = lambda cols: T.StructType([T.StructField(c, T.StringType()) for c in cols])
    raw = spark.read.options(header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE",
                             columnNameOfCorruptRecord=CORRUPT).schema(text([*names, CORRUPT])).csv(path)
    wider = text([f"c{i}" for i in range(len(names) + 1)]).simpleString().removeprefix("struct<").removesuffix(">")
    extra = F.from_csv(F.col(CORRUPT), wider.replace(":", " "), {"escape": '"'})[f"c{len(names)}"]
    bad = F.col(CORRUPT).isNotNull() & extra.isNotNull()
    message = F.concat(F.lit("a CSV row has more cells than the header; it begins with "),
                       F.coalesce(F.col(f"`{names[0]}`"), F.lit("an empty cell")))
    return raw.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True)).drop(CORRUPT)


def null_tokens(df: DataFrame, tokens: list[str]) -> DataFrame:
    """Text cells equal to one of ``tokens`` become NULL (CSV's nullValue
    takes a single token only)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(~F.col(f.name).isin(tokens), F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose every non-null value parses as bigint / double /
    boolean get that type (one aggregate job), the rest stay text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    aggs = []
    for i, c in enumerate(texts):
        x = F.trim(F.col(c))
        aggs += [F.count(F.col(c)).alias(f"n{i}"), F.count(x.try_cast("bigint")).alias(f"i{i}"),
                 F.count(F.when(x.rlike(NUMBER_PATTERN), x.try_cast("double"))).alias(f"d{i}"),
                 F.count_if(F.lower(x).isin("true", "false")).alias(f"b{i}")]
    r = df.agg(*aggs).collect()[0]
    casts = {}
    for i, c in enumerate(texts):
        n = r[f"n{i}"]
        if n == 0:
            continue
        if r[f"i{i}"] == n:
            casts[c] = "bigint"
        elif r[f"d{i}"] == n:
            casts[c] = "double"
        elif r[f"b{i}"] == n:
            casts[c] = "boolean"
    return df.select(*[F.trim(F.col(c)).try_cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


def validate_ingest(df: DataFrame) -> tuple[int, int]:
    """Reject zero columns, zero rows and malformed records; returns
    (rows, columns) from a real count."""
    cols = [c for c in df.columns if c != "_corrupt_record"]
    if not cols:
        raise ValueError("file has no columns")
    if "_corrupt_record" in df.columns:
        bad = df.where(F.col("_corrupt_record").isNotNull()).limit(1).count()
        if bad:
            raise ValueError("file holds malformed records")
    n = df.count()
    if n == 0:
        raise ValueError("file has no rows")
    return n, len(cols)


def ingest_summary(df: DataFrame) -> DataFrame:
    """S7 as a DataFrame: (row_count, column_count)."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len([c for c in df.columns if c != "_corrupt_record"])).cast("bigint").alias("column_count"))
