"""Arithmetic expressions over columns of several parties, compiled to one Column.

    expression = term {("+" | "-") term}
    term       = factor {("*" | "/") factor}
    factor     = ["-" | "+"] (number | column | "(" expression ")")

A sign may lead an expression or stand before any factor. The whole expression
is computed as double if it divides, has a double column or a literal with a
point; else as bigint.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>[-+*/()]))")
FIXED_POINT = {"D16": 16, "D32": 32}


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Negative:
    of: object


@dataclass(frozen=True)
class Operation:
    mark: str
    left: object
    right: object


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:].strip()[:1]!r} at {at} in {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str] | tuple[None, None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self) -> tuple[str, str]:
        kind, value = self.peek()
        if kind is None:
            raise ValueError("the expression ends too early")
        self.at += 1
        return kind, value

    def parse(self):
        tree = self.chain("+-", lambda: self.chain("*/", self.factor))
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        return tree

    def chain(self, marks: str, part):
        tree = part()
        while (kind_value := self.peek())[0] == "mark" and kind_value[1] in marks:
            tree = Operation(self.take()[1], tree, part())
        return tree

    def factor(self):
        kind, value = self.take()
        if kind == "number":
            return Literal(value)
        if kind == "name":
            return Name(value)
        if value in "+-":
            inner = self.factor()
            return Negative(inner) if value == "-" else inner
        if value == "(":
            tree = self.chain("+-", lambda: self.chain("*/", self.factor))
            if self.take() != ("mark", ")"):
                raise ValueError("a bracket is not closed")
            return tree
        raise ValueError(f"unexpected {value!r}")


def parse(text: str):
    return Parser(text).parse()


def names(tree) -> set[str]:
    if isinstance(tree, Name):
        return {tree.name}
    if isinstance(tree, Negative):
        return names(tree.of)
    return names(tree.left) | names(tree.right) if isinstance(tree, Operation) else set()


def is_double(tree, doubles: set[str]) -> bool:
    if isinstance(tree, Literal):
        return "." in tree.text
    if isinstance(tree, Name):
        return tree.name in doubles
    if isinstance(tree, Negative):
        return is_double(tree.of, doubles)
    return tree.mark == "/" or is_double(tree.left, doubles) or is_double(tree.right, doubles)


def divide(a: Column, b: Column) -> Column:
    """IEEE division of doubles: by zero gives an infinity, or NaN for 0 / 0."""
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b.isNull() | a.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(F.try_divide(a, b))


def compiled(tree, kind: str) -> Column:
    if isinstance(tree, Literal):
        return F.lit(float(tree.text) if kind == "double" else int(tree.text)).cast(kind)
    if isinstance(tree, Name):
        return F.col(tree.name).cast(kind)
    if isinstance(tree, Negative):
        return -compiled(tree.of, kind)
    a, b = compiled(tree.left, kind), compiled(tree.right, kind)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b)}[tree.mark]()


def fixed_point(c: Column, accuracy: str) -> Column:
    """Rounds to the binary places of a fixed-point number."""
    scale = float(1 << FIXED_POINT[accuracy])
    return F.round(c * scale) / scale


def expression(text: str, schema: T.StructType, types: dict[str, str] | None = None, accuracy: str | None = None) -> Column:
    """text as a Column of double; types: declared column types (bigint or double), by default those of the schema."""
    tree = parse(text)
    for n in names(tree):
        if n not in schema.names:
            raise ValueError(f"no such column: {n}")
        if types is not None and n not in types:
            raise ValueError(f"{n} has no declared type")
        if not isinstance(schema[n].dataType, T.NumericType):
            raise TypeError(f"{n} is not a number")
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    doubles = {n for n, k in types.items() if k == "double"} if types is not None else {f.name for f in schema if not isinstance(f.dataType, whole)}
    out = compiled(tree, "double" if is_double(tree, doubles) else "bigint").cast("double")
    return fixed_point(out, accuracy) if accuracy else out


def evaluate(text: str, parties: list[DataFrame], key: str, name: str = "result", accuracy: str | None = None) -> DataFrame:
    """Key and result of an expression over columns of parties that share a unique key."""
    return joined(parties, key).select(key, expression(text, joined_schema(parties, key), accuracy=accuracy).alias(name))


def joined(parties: list[DataFrame], key: str) -> DataFrame:
    """All parties' columns side by side; a column that two parties have is an error."""
    joined_schema(parties, key)
    out = parties[0]
    for p in parties[1:]:
        out = out.join(p, key)
    return out


def joined_schema(parties: list[DataFrame], key: str) -> T.StructType:
    fields = [f for i, p in enumerate(parties) for f in p.schema if i == 0 or f.name != key]
    seen = [f.name for f in fields]
    twice = {n for n in seen if seen.count(n) > 1}
    if twice:
        raise ValueError(f"more than one party has {', '.join(sorted(twice))}")
    return T.StructType(fields)


def compare(low: DataFrame, high: DataFrame, key: str, low_column: str, high_column: str, name: str = "result") -> DataFrame:
    """Whether the value of the party with the lower id is less, row by row on the key; types are widened as needed."""
    both = low.select(key, F.col(low_column).alias("_low")).join(high.select(key, F.col(high_column).alias("_high")), key)
    return both.select(key, (F.col("_low") < F.col("_high")).alias(name))


def same_length(parties: list[DataFrame]) -> None:
    n = [p.count() for p in parties]
    if len(set(n)) > 1:
        raise ValueError(f"the parties have different numbers of rows: {n}")


def value_of(text: str, row: dict[str, float | int]) -> float:
    """The same expression over one row in plain Python; what tests compare with."""
    tree = parse(text)
    double = is_double(tree, {n for n, v in row.items() if isinstance(v, float)})

    def at(t):
        if isinstance(t, Literal):
            return float(t.text) if double else int(t.text)
        if isinstance(t, Name):
            return float(row[t.name]) if double else row[t.name]
        if isinstance(t, Negative):
            return -at(t.of)
        a, b = at(t.left), at(t.right)
        if t.mark == "/":
            return a / b if b else (math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a))
        return a + b if t.mark == "+" else a - b if t.mark == "-" else a * b

    return float(at(tree))
