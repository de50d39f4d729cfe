"""Quality gates: NaN and infinity, next valid row, error budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType


def reason(c: Column) -> Column:
    """'nan', 'inf' or null."""
    return F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), "inf")


def invalid(df: DataFrame) -> Column:
    """True where any floating field, however nested, is NaN or infinite; made from the schema."""

    def walk(c: Column, kind) -> Column | None:
        if isinstance(kind, (FloatType, DoubleType)):
            return F.coalesce(reason(c).isNotNull(), F.lit(False))
        if isinstance(kind, ArrayType):
            if (inner := walk(F.lit(0.0), kind.elementType)) is None:
                return None
            return F.coalesce(F.exists(c, lambda x: walk(x, kind.elementType)), F.lit(False))
        if isinstance(kind, StructType):
            parts = [p for f in kind.fields if (p := walk(c[f.name], f.dataType)) is not None]
            return _any(parts)
        return None

    return _any([p for f in df.schema.fields if (p := walk(F.col(f"`{f.name}`"), f.dataType)) is not None], F.lit(False))


def _any(parts: Sequence[Column], default: Column | None = None) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out | p
    return default if out is None else out


def next_valid(df: DataFrame, part: Sequence[str], pos: str, ok: Column) -> DataFrame:
    """df with next_pos: the first valid position from here on, round the end of each part."""
    w = Window.partitionBy(*part).orderBy(pos)
    here = F.when(ok, F.col(pos))
    ahead = F.min(here).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.min(here).over(Window.partitionBy(*part))
    return df.withColumn("next_pos", F.coalesce(ahead, whole))


def runs(df: DataFrame, part: Sequence[str], pos: str, value: Column) -> DataFrame:
    """(part..., value, first, length) of the runs of equal values along pos."""
    w = Window.partitionBy(*part).orderBy(pos)
    marked = df.withColumn("value", value)
    marked = marked.withColumn("_new", F.when(F.lag("value").over(w).eqNullSafe(F.col("value")) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*part, "value", "_run").agg(F.min(pos).alias("first"), F.count("*").alias("length")).drop("_run")
