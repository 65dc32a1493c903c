"""Aggregates ``OP(column)``: SUM, AVG, MIN, MAX and COUNT with fixed result types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicate import field_of

OPS = ("SUM", "AVG", "MIN", "MAX", "COUNT")
_SPEC = re.compile(r"([A-Z]+)\(([^()]+)\)")


@dataclass(frozen=True)
class Aggregate:
    op: str
    column: str

    @property
    def alias(self) -> str:
        return f"{self.op.lower()}_{self.column}"

    def __str__(self) -> str:
        return f"{self.op}({self.column})"


def parse_aggregate(text: str) -> Aggregate:
    m = _SPEC.fullmatch(text.strip())
    if not m or m[1] not in OPS:
        raise ValueError(f"not an aggregate: {text}")
    return Aggregate(m[1], m[2])


def to_column(agg: Aggregate, schema: T.StructType, ignore_nan: bool = False) -> Column:
    """Nulls are skipped. SUM of nothing is 0; AVG, MIN and MAX of nothing are null. Integers widen to bigint, unsigned
    64-bit ones stay decimal(20,0), floats widen to double. ignore_nan leaves NaN out of float aggregates."""
    kind = field_of(schema, agg.column).dataType
    col = F.col(f"`{agg.column}`")
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        wide, zero = "bigint", F.lit(0).cast("bigint")
    elif isinstance(kind, T.DecimalType) and kind.scale == 0:
        wide, zero = "decimal(20,0)", F.lit(0).cast("decimal(20,0)")
    elif isinstance(kind, T.FloatType | T.DoubleType):
        wide, zero = "double", F.lit(0.0)
        col = F.when(~F.isnan(col), col) if ignore_nan else col
    else:
        raise ValueError(f"{agg}: {kind.simpleString()} can't be aggregated")
    out = {
        "SUM": lambda: F.coalesce(F.sum(col.cast(wide)), zero).cast(wide),
        "AVG": lambda: F.avg(col.cast("double")),
        "MIN": lambda: F.min(col).cast(wide),
        "MAX": lambda: F.max(col).cast(wide),
        "COUNT": lambda: F.count(col),
    }[agg.op]()
    return out.alias(agg.alias)
