"""Casts by path, with wrap-around, null or error on overflow; half precision; path rewrites; rules and what they lose."""

from __future__ import annotations

import re
import warnings
from collections import Counter, deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

SPARK = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "float32": "float", "float64": "double", "float16": "float", "bfloat16": "float"}
WIDTH = {"bool": 1, "int8": 1, "int16": 2, "int32": 4, "int64": 8, "uint8": 1, "uint16": 2, "float16": 2, "bfloat16": 2, "float32": 4, "float64": 8}
LOSSY = {("float16", "bfloat16"), ("bfloat16", "float16"), ("float64", "float16"), ("float64", "bfloat16")}
_RANGE = {"int8": (8, True), "int16": (16, True), "int32": (32, True), "uint8": (8, False), "uint16": (16, False)}


def _grid(c: Column, bits: int, low: int, top: float) -> Column:
    """c rounded to `bits` significant bits, ties to even, with exponents from `low`; beyond `top` infinite.  Straight from double, in one step.

    A number next to 1.5 * 2**52 units has no room for less than a unit, so adding and taking away that many rounds as the hardware does.
    """
    x = c.cast("double")
    exponent = F.greatest(F.coalesce(F.floor(F.log2(F.abs(x))), F.lit(low)), F.lit(low))
    magic = F.pow(F.lit(2.0), (exponent - (bits - 1)).cast("double")) * F.lit(1.5 * 2.0**52)
    near = (x + magic) - magic
    inf = F.when(x > 0, float("inf")).otherwise(float("-inf"))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x == 0), x).when(F.abs(near) > top, inf).otherwise(near).cast("float")


def to(c: Column, dtype: str, overflow: str = "wrap") -> Column:
    """c as dtype; integers out of range wrap, become null, or raise; fractions are cut."""
    if dtype not in SPARK:
        raise ValueError(f"unknown dtype {dtype}")
    if dtype == "float16":
        return _grid(c, 11, -14, 65504.0)
    if dtype == "bfloat16":
        return _grid(c, 8, -126, (2 - 2.0**-7) * 2.0**127)
    if dtype not in _RANGE:
        return c.cast(SPARK[dtype])
    bits, signed = _RANGE[dtype]
    half = 1 << (bits - 1) if signed else 0
    low, high = -half, (1 << bits) - 1 - half
    whole = c.cast("bigint")
    if overflow == "wrap":
        return (F.pmod(whole + half, F.lit(1 << bits)) - half).cast(SPARK[dtype])
    if overflow == "null":
        return F.when(whole.between(low, high), whole).cast(SPARK[dtype])
    return F.when(whole.between(low, high) | whole.isNull(), whole).otherwise(F.raise_error(F.lit(f"out of range for {dtype}"))).cast(SPARK[dtype])


def cast_paths(df: DataFrame, rules: dict[str, str], overflow: str = "wrap") -> DataFrame:
    """df with the fields at dotted paths cast; paths that don't exist change nothing.

    An array's items are cast one by one; `path[i]` casts the one item i (from 0), or fields inside it, and as an array has one type
    the item comes back in that: its value is that of the cast.
    """
    bad = [d for d in rules.values() if d not in SPARK]
    if bad:
        raise ValueError(f"unknown dtype {bad[0]}")

    def under(path: str) -> bool:
        return any(p == path or p.startswith((path + ".", path + "[")) for p in rules)

    def walk(c: Column, kind: DataType, path: str) -> Column:
        if isinstance(kind, StructType):
            for f in kind.fields:
                inner = f"{path}.{f.name}"
                if under(inner):
                    c = c.withField(f.name, walk(c[f.name], f.dataType, inner))
            return c
        if isinstance(kind, ArrayType):
            if path in rules:
                return F.transform(c, lambda x: to(x, rules[path], overflow))
            numbers = sorted({int(m[1]) for p in rules if (m := re.match(re.escape(path) + r"\[(\d+)\]", p))})
            if not numbers:
                return c

            def item(x: Column, i: Column) -> Column:
                out = x
                for k in numbers:
                    out = F.when(i == k, walk(x, kind.elementType, f"{path}[{k}]").cast(kind.elementType)).otherwise(out)
                return out

            return F.transform(c, item)
        return to(c, rules[path], overflow) if path in rules else c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


@dataclass
class Rules:
    """Cast rules by path, what they lose, and a short history of failures."""

    by_path: dict[str, str] = field(default_factory=dict)
    overflow: str = "wrap"
    history: deque = field(default_factory=lambda: deque(maxlen=1000))
    failures: Counter = field(default_factory=Counter)

    def add(self, path: str, dtype: str) -> None:
        if dtype not in SPARK:
            raise ValueError(f"unknown dtype {dtype}")
        self.by_path[path] = dtype

    def remove(self, path: str) -> bool:
        """Whether there was such a rule."""
        return self.by_path.pop(path, None) is not None

    def apply(self, df: DataFrame) -> DataFrame:
        return cast_paths(df, self.by_path, self.overflow)

    def failed(self, path: str, why: str) -> None:
        self.history.append((path, why))
        self.failures[path] += 1

    def summary(self) -> dict:
        """Rules by target, in all, and bytes a value of each; the last 10 failures and their number by path."""
        targets = Counter(self.by_path.values())
        return {"rules": len(self.by_path), "by_dtype": dict(targets), "width": {d: WIDTH[d] for d in targets}, "failures": dict(self.failures), "last": list(self.history)[-10:]}


def lossy(wire: str, working: str) -> bool:
    """Whether a value may change on its way from the wire type to the working type, and warns if so."""
    for d in (wire, working):
        if d not in SPARK:
            raise ValueError(f"unknown dtype {d}")
    if (wire, working) in LOSSY:
        warnings.warn(f"{wire} to {working} loses values", stacklevel=2)
        return True
    return False


def prepared(df: DataFrame, paths: dict[str, str], rules: dict[str, str], overflow: str = "wrap", validate: bool = True) -> DataFrame:
    """df with its columns moved, then cast, and (validate) `valid`: no top column that is a number is NaN or infinite."""
    from .quality import invalid

    out = cast_paths(remap(df, paths) if paths else df, rules, overflow)
    if not validate:
        return out
    top = [f.name for f in out.schema.fields if isinstance(f.dataType, (FloatType, DoubleType, ArrayType))]
    return out.withColumn("valid", ~invalid(out.select(*[F.col(f"`{c}`") for c in top]))) if top else out.withColumn("valid", F.lit(True))


def remap(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """df with top columns moved to dotted paths, making structs; others stay."""
    tree: dict = {}
    for name in df.columns:
        node, *rest = paths.get(name, name).split(".")
        if not rest:
            tree[node] = F.col(f"`{name}`")
            continue
        at = tree.setdefault(node, {})
        for key in rest[:-1]:
            at = at.setdefault(key, {})
        at[rest[-1]] = F.col(f"`{name}`")

    def build(x):
        return x if isinstance(x, Column) else F.struct(*[build(v).alias(k) for k, v in x.items()])

    return df.select(*[build(v).alias(k) for k, v in tree.items()])


def work_dtype(wire: str | None, dtype: str | None, working: str) -> str:
    """What a rule ends in: 'match' is float32 for half floats, 'keep' is the wire type."""
    first = wire or dtype
    if first not in SPARK:
        raise ValueError(f"unknown dtype {first}")
    if working == "keep":
        return first
    if working == "match":
        return "float32" if first in ("float16", "bfloat16") else first
    if working not in SPARK:
        raise ValueError(f"unknown dtype {working}")
    return working if isinstance({"float": FloatType(), "double": DoubleType()}.get(SPARK[first]), (FloatType, DoubleType)) else first
