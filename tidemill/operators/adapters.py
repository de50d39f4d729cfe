"""Adapters: rows of different sources brought to one shape of training row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from . import text as X

KEYS = ("input_ids", "labels", "loss_mask", "source_tag")


def drop_extras(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """df with the columns of `keep` that it has, in its own order."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(keep)])


def add_labels(df: DataFrame) -> DataFrame:
    """df with labels equal to its ids, unless it has labels."""
    return df if "labels" in df.columns else df.withColumn("labels", F.col("input_ids"))


def ensure_mask(df: DataFrame, otherwise) -> DataFrame:
    """df with a mask of booleans: its own, of whatever numbers, or that which `otherwise` makes of the ids."""
    if "loss_mask" not in df.columns:
        return df.withColumn("loss_mask", otherwise(F.col("input_ids")))
    kind = df.schema["loss_mask"].dataType
    if not isinstance(kind, ArrayType):
        raise TypeError(f"a mask is an array, not {kind.simpleString()}")
    return df if isinstance(kind.elementType, BooleanType) else df.withColumn("loss_mask", F.transform("loss_mask", lambda x: x.cast("boolean")))


def stamp(df: DataFrame, tag: str | Column) -> DataFrame:
    return df.withColumn("source_tag", F.lit(tag) if isinstance(tag, str) else tag)


#: recipe -> (tag, mask where there is none)
RECIPES = {"pretrain": ("pretrain_pad", X.pad_mask), "chat": ("chat_query", X.full_mask), "val": ("val_full", X.full_mask)}


def adapt(df: DataFrame, recipe: str, keys: Sequence[str] = ()) -> DataFrame:
    """df as rows of KEYS, and of `keys` besides: extras dropped, labels and mask added where absent, tag stamped."""
    if recipe not in RECIPES:
        raise ValueError(f"unknown recipe {recipe}")
    if "input_ids" not in df.columns:
        raise ValueError("rows have no input_ids")
    tag, mask = RECIPES[recipe]
    return stamp(ensure_mask(add_labels(drop_extras(df, [*keys, *KEYS])), mask), tag)
