"""What all modules share: fit(df) gives the module its state, transform(df) is a projection."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.types import present, require_columns

ROLES = {"H": ("client", "server"), "V": ("host", "guest")}
EPS = 10 * 2.220446049250313e-16


def check_role(fl_type: str, role: str) -> None:
    """H is between clients and a server, V between a host and guests."""
    if fl_type not in ROLES:
        raise ValueError(f"the type is H or V, not {fl_type}")
    if role not in ROLES[fl_type]:
        raise ValueError(f"a party of {fl_type} is {' or '.join(ROLES[fl_type])}, not {role}")


class Module:
    """columns: what it works on. State is in ``state``, a small dict that JSON can hold."""

    def __init__(self, columns: list[str], **params: Any):
        self.columns, self.params, self.state = list(columns), params, {}

    def fit(self, df: DataFrame) -> "Module":
        require_columns(df, self.columns)
        self.state = self._fit(df)
        return self

    def _fit(self, df: DataFrame) -> dict:
        return {}

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def to_json(self) -> str:
        return json.dumps({"module": type(self).__name__, "columns": self.columns, "params": self.params, "state": self.state})


def aggregates(df: DataFrame, columns: list[str], of: dict) -> dict[str, dict[str, Any]]:
    """{name: {column: value}} from one aggregate over all columns."""
    row = df.agg(*(f(present(c)).alias(f"{i}_{n}") for i, c in enumerate(columns) for n, f in of.items())).first()
    return {n: {c: row[f"{i}_{n}"] for i, c in enumerate(columns)} for n in of}


def replaced(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """df with columns replaced in place."""
    return df.select([values[c].alias(c) if c in values else F.col(c) for c in df.columns] + [v.alias(c) for c, v in values.items() if c not in df.columns])


def nonzero(x: float | None, tiny: float = 0.0) -> float:
    return 1.0 if x is None or abs(x) <= tiny else float(x)


def category(df: DataFrame, c: str) -> Column:
    """A value as text, as category states keep it; NULL and NaN are missing."""
    if df.schema[c].dataType.typeName() in ("double", "float"):
        return present(c).cast("string")
    return F.col(c).cast("string")


def mapped(value: Column, table: dict[str, float], other: Column) -> Column:
    """table[value], or other where it has none; a literal map, looked up without a join."""
    if not table:
        return other
    pairs = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(F.try_element_at(pairs, value), other)
