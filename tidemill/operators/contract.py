"""Schema contracts of rows: keys, types, ranks, lengths and tags; probes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from .cast import SPARK


class ContractError(ValueError):
    """A table or a row that breaks its contract."""


@dataclass(frozen=True)
class Field:
    """What a column has to be: `dtype` of its leaves (a name of cast.SPARK or None), nested arrays of `dims` (None: any length)."""

    name: str
    dtype: str | None = None
    dims: tuple[int | None, ...] = ()
    required: bool = True

    def __post_init__(self) -> None:
        if self.dtype is not None and self.dtype not in SPARK and self.dtype != "string":
            raise ValueError(f"unknown dtype {self.dtype}")


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    tag: str | None = None  #: the column that says where a row is from
    sources: tuple[str, ...] = ()

    def faults(self, df: DataFrame) -> list[str]:
        """What is wrong with the table's schema, before any row is read: 'key: rule'."""
        out, have = [], {f.name: f.dataType for f in df.schema.fields}
        for f in self.fields:
            if f.name not in have:
                if f.required:
                    out.append(f"{f.name}: missing")
                continue
            leaf, rank = _leaf(have[f.name])
            if rank != len(f.dims):
                out.append(f"{f.name}: rank {rank}, not {len(f.dims)}")
            elif f.dtype is not None and leaf.simpleString() != SPARK.get(f.dtype, f.dtype):
                out.append(f"{f.name}: {leaf.simpleString()}, not {f.dtype}")
        if self.tag and self.tag not in have:
            out.append(f"{self.tag}: missing")
        return out

    def violations(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        """(key, field, rule) of every row that breaks a rule: 'null', 'length' (of some array), or 'source'.  One pass, no shuffle."""
        found = []
        have = {f.name: f.dataType for f in df.schema.fields}
        for f in self.fields:
            if f.name not in have:
                continue
            c = F.col(f"`{f.name}`")
            found.append(F.when(c.isNull() if f.required else F.lit(False), _rule(f.name, "null")).when(F.coalesce(_short(c, f.dims), F.lit(False)), _rule(f.name, "length")))
        if self.tag in have:
            tag = F.col(f"`{self.tag}`")
            if isinstance(have[self.tag], ArrayType):  # a list of tags, all of them known
                known = F.forall(tag, lambda x: x.isin(*self.sources)) & (F.size(tag) > 0)
            else:
                known = tag.isin(*self.sources)
            found.append(F.when(~F.coalesce(known, F.lit(False)), _rule(self.tag, "source")))
        rows = df.select(*key, F.explode(F.array_compact(F.array(*found))).alias("_v"))
        return rows.select(*key, "_v.field", "_v.rule")

    def probe(self, df: DataFrame, n: int = 8) -> None:
        """Raises ContractError if the schema, or one of the first n rows, breaks the contract; reads no more than those."""
        faults = self.faults(df)
        if faults:
            raise ContractError("; ".join(faults))
        bad = self.violations(df.limit(n).withColumn("_row", F.monotonically_increasing_id()), ["_row"]).collect()  # at most n rows, few fields each
        if bad:
            raise ContractError("; ".join(sorted({f"{r.field}: {r.rule}" for r in bad})))

    def checked(self, df: DataFrame, batch: str, every: int | None = None) -> DataFrame:
        """df, whose job fails at a violating row of the first batch, or of every `every`-th one (None: of no other)."""
        due = F.col(batch) == 0
        if every is not None:
            due = due | (F.pmod(F.col(batch) + 1, F.lit(every)) == 0)
        for f in self.fields:
            if f.name in df.columns:
                c = F.col(f"`{f.name}`")
                bad = F.coalesce(_short(c, f.dims), F.lit(False)) | (c.isNull() if f.required else F.lit(False))
                df = df.withColumn(f.name, F.when(due & bad, F.raise_error(F.lit(f"contract: {f.name}")).cast(df.schema[f.name].dataType)).otherwise(c))
        return df


def _leaf(kind: DataType) -> tuple[DataType, int]:
    rank = 0
    while isinstance(kind, ArrayType):
        kind, rank = kind.elementType, rank + 1
    return kind, rank


def _rule(name: str, rule: str) -> Column:
    return F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"))


def _short(c: Column, dims: Sequence[int | None]) -> Column:
    """Whether an array, or one in it, hasn't the length it should have."""
    if not dims:
        return F.lit(False)
    own = F.lit(False) if dims[0] is None else F.size(c) != dims[0]
    return own | F.exists(c, lambda x: F.coalesce(_short(x, dims[1:]), F.lit(True))) if len(dims) > 1 else own
