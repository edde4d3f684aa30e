"""Carries a table's own columns through an operator under one name, so that none can clash with the operator's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "own"


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def pack(df: DataFrame, *apart: str) -> DataFrame:
    """``own``, a struct of all columns but those ``apart``, then these. Names are compared without case, as Spark does."""
    names = {a.lower() for a in apart}
    rest = [c for c in df.columns if c.lower() not in names]
    return df.select((F.struct(*map(quoted, rest)) if rest else F.lit(True)).alias(REST), *apart)


def unpack(df: DataFrame, columns: list[str], *replaced: str, **new: Column) -> DataFrame:
    """The packed ``columns`` in their order; those ``replaced`` are taken as they are now, ``new`` ones take their place or follow."""
    now, made = {a.lower() for a in replaced}, {n.lower(): c for n, c in new.items()}
    kept = [c for c in columns if c.lower() not in made]
    own = [(F.col(c) if c.lower() in now else F.col(REST).getField(c)).alias(c) for c in kept]
    return df.select(*own, *(c.alias(n) for n, c in new.items()))
