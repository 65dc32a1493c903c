"""Row-group pruning from footer statistics: which groups can hold a row that satisfies a predicate.

Sound by construction: missing statistics, unsuitable literals and cases where NaN may hide from the statistics keep the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicate import And, Cond, Expr, Literal, Not, Or, columns_of

#: Of each column kind and literal kind: the statistics that suit, and how many of the literal's units are one of theirs (the
#: last for moments, where it is the other way round: theirs are microseconds, the literal's are milliseconds).
_SUITS = {
    ("int", "int"): ("int", 1, 1),
    ("int", "moment"): ("int", 1, 1),
    ("date", "int"): ("int", 1, 1),
    ("date", "moment"): ("int", 86_400_000, 1),  # a date is its midnight
    ("moment", "moment"): ("int", 1, 1000),
    ("float", "float"): ("float", None, None),
    ("string", "string"): ("string", None, None),
    ("bool", "bool"): ("bool", None, None),
}


def may_hold(op: str, negated: bool, low, high, value):
    """Whether some x in [low, high] may satisfy ``x op value`` (or not, if negated); for values or for Columns."""
    match op, negated:
        case ("<", False) | (">=", True):
            return low < value
        case ("<", True) | (">=", False):
            return high >= value
        case ("<=", False) | (">", True):
            return low <= value
        case ("<=", True) | (">", False):
            return high > value
        case ("==", False):
            return (low <= value) & (high >= value)
        case ("==", True):
            return (low != value) | (high != value)
    raise ValueError(op)


def _condition(cond: Cond, negated: bool, at: str) -> Column:
    """Over the columns {at}kind, {at}min_int, ...: true keeps."""
    out = F.lit(True)
    for (kind, literal_kind), (stat, unit, scale) in _SUITS.items():
        if literal_kind != cond.literal.kind:
            continue
        if kind == "float" and (negated or cond.op in (">", ">=")):
            continue  # NaN is above all numbers but not in the statistics
        if kind == "bool" and (negated or cond.op != "=="):
            continue
        low, high, value = F.col(f"{at}min_{stat}"), F.col(f"{at}max_{stat}"), cond.literal.value
        if unit:
            low, high, value = low * unit, high * unit, value * scale
        test = F.coalesce(may_hold(cond.op, negated, low, high, F.lit(value)), F.lit(True))
        out = F.when(F.col(f"{at}kind") == kind, test).otherwise(out)
    return out


def keep_column(expr: Expr, prefixes: dict[str, str], negated: bool = False) -> Column:
    """NOT moves inwards by De Morgan down to the conditions."""
    match expr:
        case Cond(column, _, _):
            return _condition(expr, negated, prefixes[column])
        case Not(inner):
            return keep_column(inner, prefixes, not negated)
        case And(left, right) | Or(left, right):
            a, b = keep_column(left, prefixes, negated), keep_column(right, prefixes, negated)
            return a & b if isinstance(expr, And) != negated else a | b
    raise TypeError(expr)


def prune(stats: DataFrame, expr: Expr | None) -> DataFrame:
    """(file, row_group, keep) of footer statistics. Columns a file lacks keep its groups."""
    if expr is None:
        return stats.select("file", "row_group").distinct().withColumn("keep", F.lit(True))
    needed = ["kind", *(f"{m}_{k}" for k in ("int", "float", "string", "bool") for m in ("min", "max"))]
    prefixes = {c: f"c{i}_" for i, c in enumerate(columns_of(expr))}
    picked = [F.max(F.when(F.col("col_name") == c, F.col(n))).alias(p + n) for c, p in prefixes.items() for n in needed]
    groups = stats.groupBy("file", "row_group").agg(*picked)
    return groups.select("file", "row_group", keep_column(expr, prefixes).alias("keep"))


__all__ = ["Literal", "keep_column", "may_hold", "prune"]
