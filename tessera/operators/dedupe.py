"""First-wins choice, upserts, and chains of near dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in a total order. min_by keeps the choice in a partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The union by key, new rows before old ones, then the given order."""
    both = new.withColumn("__age", F.lit(0)).unionByName(old.withColumn("__age", F.lit(1)))
    return first_wins(both, keys, [F.col("__age"), *order]).drop("__age")


def merge_maps(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Key by key the new values where given, else the old ones."""
    values = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), key, "full")
    return both.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in values])


def unseen(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the old table lacks."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def replace_listed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old for keys that new does not list, and all rows of new."""
    return unseen(old, new, [key]).unionByName(new)


def chain_near(df: DataFrame, keys: list[str], at: Column, gap: Column, order: list[str]) -> DataFrame:
    """df with `chain`, counting from 0 within a key: a row further than the gap from the one before begins a new chain."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    begins = F.coalesce((at - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__begins", begins).withColumn("chain", F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__begins")
