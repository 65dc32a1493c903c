"""A scan query: projection, predicate and aggregates over one table, as a plain DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregates, predicate


@dataclass(frozen=True)
class ScanQuery:
    """columns: names to return, in the table's order; or first_n: that many leading columns. where: predicate text, with
    columns by index if by_index, and with literals of points in time if moments. aggs: ``OP(column)`` texts. scope: ``dataset`` for one row over everything, or
    ``file`` for one row per input file (column ``file``)."""

    columns: tuple[str, ...] | None = None
    first_n: int | None = None
    where: str | None = None
    by_index: bool = False
    moments: bool = True
    aggs: tuple[str, ...] = field(default=())
    scope: str = "dataset"
    strict_nulls: bool = False
    nan_safe: bool = False
    ignore_nan: bool = False

    def expression(self, df: DataFrame) -> predicate.Expr | None:
        return None if self.where is None else predicate.parse(self.where, df.columns if self.by_index else None, self.moments)

    def filtered(self, df: DataFrame) -> DataFrame:
        expr = self.expression(df)
        return df if expr is None else df.filter(predicate.to_column(expr, df.schema, self.strict_nulls, self.nan_safe))

    def projected(self, df: DataFrame) -> DataFrame:
        if self.first_n is not None:
            if not 0 < self.first_n <= len(df.columns):
                raise ValueError(f"first_n must be from 1 to {len(df.columns)}")
            return df.select(*[f"`{c}`" for c in df.columns[: self.first_n]])
        if self.columns is None:
            return df
        for c in self.columns:
            predicate.field_of(df.schema, c)
        return df.select(*[f"`{c}`" for c in df.columns if c in self.columns])

    def run(self, df: DataFrame) -> DataFrame:
        """The plan over df; with file scope df must come from a file source."""
        rows = self.filtered(df)
        if not self.aggs:
            return self.projected(rows)
        cols = [aggregates.to_column(aggregates.parse_aggregate(a), df.schema, self.ignore_nan) for a in self.aggs]
        if self.scope == "file":
            return rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(*cols)
        if self.scope != "dataset":
            raise ValueError(f"unknown scope: {self.scope}")
        return rows.agg(*cols)
