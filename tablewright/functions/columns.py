"""Column classification and small expression helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MEASURE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_measure(dt: T.DataType) -> bool:
    """Numeric, bool excluded (what numeric summaries and scalers take)."""
    return isinstance(dt, _MEASURE)


def is_numeric_like(dt: T.DataType) -> bool:
    """Numeric including bool (what problem detection treats as numeric)."""
    return isinstance(dt, _MEASURE + (T.BooleanType,))


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, _TEXT)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, _TIME)


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, _NESTED)


def measure_columns(df: DataFrame, cols=None) -> list[str]:
    cols = cols or df.columns
    return [c for c in cols if is_measure(dtype_of(df, c))]


def text_columns(df: DataFrame, cols=None) -> list[str]:
    cols = cols or df.columns
    return [c for c in cols if is_text(dtype_of(df, c))]


def hashable_columns(df: DataFrame, cols=None) -> list[str]:
    """Columns whose values can be grouped / counted distinct."""
    cols = cols or df.columns
    return [c for c in cols if not is_nested(dtype_of(df, c))]


def row_keys(df: DataFrame) -> list[Column]:
    """One grouping key per column, whatever its type; a map counts by its
    sorted entries."""
    return [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name)
            for f in df.schema.fields]


def num(c: str) -> Column:
    """Numeric value as double with float NaN folded to NULL."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def fold_nan(df: DataFrame) -> DataFrame:
    """Float NaN -> NULL on ingest so that every aggregate sees one 'missing'."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def as_text(c: str) -> Column:
    """Canonical text form of a value for value counts across column types."""
    return F.col(c).cast("string")


def long_form(df: DataFrame, cols: list[str], value: str = "value",
              key: str = "column_name", cast: str | None = "double",
              drop_nulls: bool = True) -> DataFrame:
    """Unpivot ``cols`` into (key, value) rows (one Expand, no shuffle)."""
    if cast == "double":
        exprs = [num(c).alias(c) for c in cols]
    elif cast:
        exprs = [F.col(c).cast(cast).alias(c) for c in cols]
    else:
        exprs = [F.col(c) for c in cols]
    out = df.select(*exprs).unpivot([], cols, key, value)
    if drop_nulls:
        out = out.where(F.col(value).isNotNull())
    return out


#: Text that is a number; Spark's cast alone also reads type suffixes such as ``10d``.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"


def spark_type_name(dt: T.DataType) -> str:
    return dt.simpleString()
