"""Types: task codes, Arrow ids and SQL names mapped to Spark types; one null policy."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Code(IntEnum):
    """Column types of a task's parameters."""

    STRING = 0
    INTEGER = 1
    DOUBLE = 2
    LONG = 3
    ENUM = 4
    BOOLEAN = 5


class ArithmeticCode(IntEnum):
    INT64 = 0
    FP64 = 1


NUMERIC_CODES = {Code.INTEGER, Code.LONG, Code.DOUBLE}
CODE_TYPES = {
    Code.STRING: T.StringType(),
    Code.INTEGER: T.IntegerType(),
    Code.DOUBLE: T.DoubleType(),
    Code.LONG: T.LongType(),
    Code.ENUM: T.StringType(),
    Code.BOOLEAN: T.BooleanType(),
}

# Arrow's type ids. Spark has no unsigned types, so they widen.
ARROW_TYPES = {
    1: T.BooleanType(), 2: T.ShortType(), 3: T.ByteType(), 4: T.IntegerType(), 5: T.ShortType(), 6: T.LongType(), 7: T.IntegerType(), 8: T.DecimalType(20, 0),
    9: T.LongType(), 10: T.FloatType(), 11: T.FloatType(), 12: T.DoubleType(), 13: T.StringType(), 14: T.BinaryType(), 15: T.BinaryType(), 16: T.DateType(),
    17: T.TimestampType(), 18: T.TimestampType(), 19: T.TimeType(), 20: T.TimeType(), 21: T.YearMonthIntervalType(), 22: T.DayTimeIntervalType(),
}

# Names of column types in databases.
SQL_TYPES = {
    "bigint": T.LongType(), "integer": T.LongType(), "tinyint": T.ShortType(), "int": T.IntegerType(), "mediumint": T.IntegerType(), "smallint": T.IntegerType(),
    "float": T.FloatType(), "double": T.DoubleType(), "real": T.DoubleType(), "varchar": T.StringType(), "char": T.StringType(), "text": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "blob": T.BinaryType(), "datetime": T.TimestampType(), "time": T.TimeType(), "year": T.DateType(),
    "timestamp": T.StringType(),
}


def arrow_type(type_id: int, precision: int = 10, scale: int = 0) -> T.DataType:
    """Spark type of an Arrow type id; decimals keep their precision, unknown ids are strings."""
    if type_id in (23, 24):
        return T.DecimalType(precision, scale)
    return ARROW_TYPES.get(type_id, T.StringType())


def sql_type(name: str) -> T.DataType:
    """Spark type of a database's type name, such as VARCHAR(20); unknown names are strings."""
    return SQL_TYPES.get(name.split("(")[0].strip().lower(), T.StringType())


def declared(fields: list[dict]) -> T.StructType:
    """Schema from [{column: Arrow type id}, ...]."""
    return T.StructType([T.StructField(name, arrow_type(kind)) for f in fields for name, kind in f.items()])


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not is_numeric(f.dataType)]


def present(c: str | Column, kind: T.DataType | None = None) -> Column:
    """The value as double, with NaN turned into NULL: missing values are of one kind from here on."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
