"""Type classes the cleaning and profiling jobs branch on (text / number / date-time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_number(dt: T.DataType) -> bool:
    """Numbers for cleaning, statistics and charts; booleans are not numbers here."""
    return isinstance(dt, NUMERIC)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME)


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def text_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def col_of(name: str) -> Column:
    """The column of exactly this name, whatever dots, blanks or backticks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def simple_cols(df: DataFrame) -> list[str]:
    """Columns table jobs handle: everything but arrays, maps and structs."""
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def type_class(dt: T.DataType) -> str:
    """Name of the class a column belongs to, used by type counts and schema profiles."""
    if is_text(dt):
        return "text"
    if is_number(dt):
        return "number"
    if is_datetime(dt):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return "other"
