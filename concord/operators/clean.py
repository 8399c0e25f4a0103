"""Missing and abnormal values: strict reading of numbers from text, and what replaces what does not read.

Every repair is one aggregate, whose single row is joined back (it is one row
whatever the input), and one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.types import require_columns

# Texts that stand for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)
INTEGER = r"^\s*[+-]?[0-9]+$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strict(c: str | Column, kind: str) -> Column:
    """A text as bigint or double if all of it is a number; anything else, null tokens too, is NULL.

    Blanks may lead but not follow; hex, inf and nan are not numbers here.
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    if kind not in ("bigint", "double"):
        raise ValueError("a column is bigint or double")
    return F.when(c.rlike(INTEGER if kind == "bigint" else NUMBER), F.trim(c).try_cast(kind))


def is_missing(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).cast("string").isin(*NULL_TOKENS)


def is_abnormal(c: str, kind: str) -> Column:
    """Present, but not a number of the kind."""
    return ~is_missing(c) & strict(c, kind).isNull()


def same_schema(frames: list[DataFrame]) -> None:
    """All parties need the same columns and types."""
    first = [(f.name, f.dataType) for f in frames[0].schema]
    for df in frames[1:]:
        if [(f.name, f.dataType) for f in df.schema] != first:
            raise ValueError("the parties' tables have different columns or types")


def _fill(c: Column, kind: str, how: str) -> Column:
    if how == "MAX":
        return F.max(c)
    if how == "MIN":
        return F.min(c)
    if how == "AVG":
        # Integers are divided as integers, towards zero.
        return F.sum(c) / F.count(c) if kind == "double" else F.when(F.count(c) > 0, F.call_function("div", F.sum(c), F.nullif(F.count(c), F.lit(0))))
    raise ValueError(f"no such replacement: {how}")


def impute(df: DataFrame, columns: dict[str, str], how: str = "MAX", places: int | None = None) -> DataFrame:
    """Replaces what is missing or abnormal in columns (name: bigint or double) by MAX, MIN or AVG of what is neither.

    df is the union of all parties; places rounds doubles.
    """
    require_columns(df, list(columns))
    filled = df.agg(*(_fill(strict(c, k), k, how).alias(f"_fill_{c}") for c, k in columns.items()))
    out = df.crossJoin(F.broadcast(filled))  # one row
    value = {c: F.coalesce(strict(c, k), F.col(f"_fill_{c}")) for c, k in columns.items()}
    if places is not None:
        value = {c: F.round(v, places) if columns[c] == "double" else v for c, v in value.items()}
    return out.withColumns(value).select(df.columns)


def impute_parties(parties: dict[str, DataFrame], columns: dict[str, str], how: str = "MAX", places: int | None = None) -> dict[str, DataFrame]:
    """The same over parties of one schema: the replacement is taken from all, each gets its own rows back."""
    from concord.operators.stats import PARTY, union

    same_schema(list(parties.values()))
    whole = impute(union(parties), columns, how, places)
    return {p: whole.where(F.col(PARTY) == p).drop(PARTY) for p in parties}


def load_texts(spark, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV file with all columns as text; in columns, texts that stand for a missing value are NULL, and empty lines are rows."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.withColumns({c: F.when(~is_missing(c), F.col(c)) for c in columns})


def abnormal_table(df: DataFrame, columns: dict[str, str], places: int = 6) -> DataFrame:
    """A database table's repair: abnormal texts become the mean (integers: rounded down), doubles are rounded, missing values of text columns are the text NA."""
    out = repair_mixed(df, columns)
    texts = [f.name for f in out.schema if f.name not in columns and f.dataType.typeName() == "string"]
    fixed = {c: F.round(c, places) for c, k in columns.items() if k == "double"} | {c: F.when(is_missing(c), "NA").otherwise(F.col(c)) for c in texts}
    return out.withColumns(fixed) if fixed else out


def repair_mixed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Abnormal texts become the column's mean (integers: rounded down); a sum of 0 leaves them missing."""
    filled = df.agg(*(_mean(c, k).alias(f"_fill_{c}") for c, k in columns.items()))
    out = df.crossJoin(F.broadcast(filled))  # one row
    value = {c: F.when(is_abnormal(c, k), F.col(f"_fill_{c}")).otherwise(strict(c, k)) for c, k in columns.items()}
    return out.withColumns(value).select(df.columns)


def _mean(c: str, kind: str) -> Column:
    v = strict(c, kind)
    mean = F.when(F.sum(v) != 0, F.sum(v) / F.count(v))
    return F.floor(mean) if kind == "bigint" else mean
