"""Join keys: which types may be keys, what a missing key is, how keys are masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.types import require_columns

KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BinaryType)
PREFIX = "_key"


def check_keys(df: DataFrame, keys: list[str]) -> None:
    """Integers, strings and binary values may be keys; anything else is an error."""
    if not keys:
        raise ValueError("no key columns")
    require_columns(df, keys)
    for k in keys:
        if not isinstance(df.schema[k].dataType, KEY_TYPES):
            raise TypeError(f"{k} is {df.schema[k].dataType.simpleString()}, which cannot be a key")


def key_value(c: str, masked: bool = False) -> Column:
    """A key as text. A missing one is the empty text, and so equal to others; masked: its SHA-256."""
    v = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(v, 256) if masked else v


def with_keys(df: DataFrame, keys: list[str], masked: bool = False) -> tuple[DataFrame, list[str]]:
    """df with text keys in columns of their own; columns stay apart, so no separator can make keys equal."""
    check_keys(df, keys)
    names = [f"{PREFIX}{i}" for i in range(len(keys))]
    return df.withColumns({n: key_value(k, masked) for n, k in zip(names, keys, strict=True)}), names


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def keyed_pair(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], masked: bool = False, keep: bool = False) -> tuple[DataFrame, DataFrame, list[str], Column]:
    """The left frame with key columns, the right one's key columns (with keep: all its columns), their names on the left, and the condition under which keys are equal.

    Integers on both sides are compared as integers (a missing one equals a
    missing one), anything else as text, where a missing key is the empty one.
    """
    check_keys(left, left_keys)
    check_keys(right, right_keys)
    a, b, names, equal = {}, {}, [], F.lit(True)
    for i, (x, y) in enumerate(zip(left_keys, right_keys, strict=True)):
        whole = not masked and isinstance(left.schema[x].dataType, WHOLE) and isinstance(right.schema[y].dataType, WHOLE)
        a[f"{PREFIX}{i}"] = F.col(x).cast("long") if whole else key_value(x, masked)
        b[f"_right{i}"] = F.col(y).cast("long") if whole else key_value(y, masked)
        names.append(f"{PREFIX}{i}")
        same = F.col(f"{PREFIX}{i}").eqNullSafe(F.col(f"_right{i}")) if whole else F.col(f"{PREFIX}{i}") == F.col(f"_right{i}")
        equal = same if i == 0 else equal & same
    return left.withColumns(a), right.withColumns(b) if keep else right.select(*(v.alias(n) for n, v in b.items())), names, equal
