"""The textual predicate language: ``column op literal`` joined by AND, OR, NOT and parentheses.

``parse`` gives a tree of frozen nodes; ``to_column`` turns it into one Catalyst expression after checking every
literal against the schema, so Spark never casts implicitly and simple comparisons reach the Parquet reader.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE = {"<": operator.lt, "<=": operator.le, "==": operator.eq, ">=": operator.ge, ">": operator.gt}
MOMENT = "%Y-%m-%d-%H:%M:%S"
_MOMENT = re.compile(r"\d{4}-\d{2}-\d{2}-\d{2}:\d{2}:\d{2}")
_FLOAT = re.compile(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?")
_INT = re.compile(r"[+-]?\d+")


class PredicateError(ValueError):
    """The text does not parse, or a literal does not suit its column."""


@dataclass(frozen=True)
class Literal:
    """kind: moment (value in epoch milliseconds), bool, float, int or string."""

    kind: str
    value: int | float | bool | str


@dataclass(frozen=True)
class Cond:
    column: str
    op: str
    literal: Literal


@dataclass(frozen=True)
class And:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not:
    inner: Expr


Expr = Cond | And | Or | Not


def tokenize(text: str) -> list[str]:
    """Parentheses are tokens of their own; only the space separates others, there is no quoting."""
    return [t for t in re.split(r"([()])| ", text) if t]


def literal(token: str, moments: bool = True) -> Literal:
    """The kind is inferred from the token alone: moment (if these are wanted), bool, float (needs a point), 64-bit int, else string."""
    if moments and _MOMENT.fullmatch(token):
        try:
            at = datetime.strptime(token, MOMENT).replace(tzinfo=UTC)
            return Literal("moment", (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1))
        except ValueError:
            pass
    if token in ("true", "false"):
        return Literal("bool", token == "true")
    if _FLOAT.fullmatch(token):
        return Literal("float", float(token))
    if _INT.fullmatch(token) and -(2**63) <= int(token) < 2**63:
        return Literal("int", int(token))
    return Literal("string", token)


class _Parser:
    def __init__(self, text: str, columns: list[str] | None, moments: bool):
        self.tokens, self.at, self.columns, self.moments = tokenize(text), 0, columns, moments

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self, what: str) -> str:
        if self.at >= len(self.tokens):
            raise PredicateError(f"{what} expected at the end")
        self.at += 1
        return self.tokens[self.at - 1]

    def joined(self, word: str, node: type, below) -> Expr:
        out = below()
        while self.peek() == word:
            self.at += 1
            out = node(out, below())
        return out

    def any_of(self) -> Expr:
        return self.joined("OR", Or, self.all_of)

    def all_of(self) -> Expr:
        return self.joined("AND", And, self.negated)

    def negated(self) -> Expr:
        if self.peek() == "NOT":
            self.at += 1
            return Not(self.primary())
        return self.primary()

    def primary(self) -> Expr:
        token = self.next("a condition")
        if token == "(":
            inner = self.any_of()
            if self.next("')'") != ")":
                raise PredicateError("')' expected")
            return inner
        if self.columns is not None:
            if not token.isdigit() or int(token) >= len(self.columns):
                raise PredicateError(f"not a column index: {token}")
            token = self.columns[int(token)]
        op = self.next("an operator")
        if op not in COMPARE:
            raise PredicateError(f"not an operator: {op}")
        return Cond(token, op, literal(self.next("a literal"), self.moments))


def parse(text: str, columns: list[str] | None = None, moments: bool = True) -> Expr:
    """The tree of a predicate. With ``columns``, conditions name columns by their index in that list.

    Without moments a token like 2024-01-02-00:00:00 is a string.
    """
    parser = _Parser(text, columns, moments)
    out = parser.any_of()
    if parser.peek() is not None:
        raise PredicateError(f"unexpected: {parser.peek()}")
    return out


def columns_of(expr: Expr) -> list[str]:
    """Columns in the order in which they are first met."""
    match expr:
        case Cond(column, _, _):
            return [column]
        case Not(inner):
            return columns_of(inner)
        case And(left, right) | Or(left, right):
            return list(dict.fromkeys(columns_of(left) + columns_of(right)))
    raise TypeError(expr)


def field_of(schema: T.StructType, name: str) -> T.StructField:
    """The field of exactly that name; Spark would also take another case."""
    for f in schema.fields:
        if f.name == name:
            return f
    raise PredicateError(f"no column {name}")


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _on_date(col: Column, op: str, value: Literal) -> Column:
    """A date against a day number, or against a moment: a date is its midnight."""
    if value.kind == "int":
        return COMPARE[op](F.unix_date(col), F.lit(value.value))
    days, rest = divmod(value.value, 86_400_000)
    day = F.lit((datetime(1970, 1, 1) + timedelta(days=days)).date())
    if rest == 0:
        return COMPARE[op](col, day)
    if op == "==":
        return F.when(col.isNotNull(), F.lit(False))
    return col <= day if op in ("<", "<=") else col > day


def condition(cond: Cond, schema: T.StructType, nan_safe: bool = False) -> Column:
    kind, value = field_of(schema, cond.column).dataType, cond.literal
    col, compare = F.col(f"`{cond.column}`"), COMPARE[cond.op]
    unsigned = isinstance(kind, T.DecimalType) and kind.scale == 0
    if isinstance(kind, _INTEGERS) and value.kind in ("int", "moment"):
        return compare(col, F.lit(value.value))
    if unsigned and value.kind == "int":
        return compare(col, F.lit(value.value).cast(T.DecimalType(20, 0)))
    if isinstance(kind, T.FloatType | T.DoubleType) and value.kind == "float":
        out = compare(col, F.lit(value.value).cast(kind))
        if nan_safe:  # not pushed down, so file statistics that leave NaN out can't drop it
            out = out | F.isnan(col) if cond.op in (">", ">=") else out & ~F.isnan(col)
        return out
    if isinstance(kind, T.BooleanType) and value.kind == "bool":
        return compare(col, F.lit(value.value))
    if isinstance(kind, T.StringType) and value.kind == "string":
        return compare(col, F.lit(value.value))
    if isinstance(kind, T.DateType) and value.kind in ("int", "moment"):
        return _on_date(col, cond.op, value)
    if isinstance(kind, T.TimestampNTZType) and value.kind == "moment":
        return compare(col, F.lit(datetime(1970, 1, 1) + timedelta(milliseconds=value.value)).cast("timestamp_ntz"))
    if isinstance(kind, T.TimestampType) and value.kind == "moment":
        return compare(col, F.timestamp_millis(F.lit(value.value)))
    raise PredicateError(f"{cond.column} is {kind.simpleString()}; a {value.kind} literal does not suit it")


def to_column(expr: Expr, schema: T.StructType, strict_nulls: bool = False, nan_safe: bool = False) -> Column:
    """One boolean Column. strict_nulls: AND and OR are null whenever a side is, else three-valued logic."""
    down = lambda e: to_column(e, schema, strict_nulls, nan_safe)
    match expr:
        case Cond():
            return condition(expr, schema, nan_safe)
        case Not(inner):
            return ~down(inner)
        case And(left, right) | Or(left, right):
            a, b = down(left), down(right)
            out = a & b if isinstance(expr, And) else a | b
            return F.when(a.isNotNull() & b.isNotNull(), out) if strict_nulls else out
    raise TypeError(expr)
