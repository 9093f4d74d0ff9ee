"""Columns that an operator doesn't know, out of the way of its own names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hidden(df: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with every column but those in ``own`` under a name that no operator uses, and these names by the old ones."""
    names = {c: c if c in own else f"__extra_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def shown(df: DataFrame, names: dict[str, str], *added: str) -> DataFrame:
    """The columns of before under their own names, and ``added``, which replace columns of the same names."""
    return df.select(*[F.col(now).alias(c) for c, now in names.items() if c not in added], *added)
