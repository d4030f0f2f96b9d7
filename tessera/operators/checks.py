"""Data-quality rules as tables of violations, and comparisons of sets and attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _told(df: DataFrame, rule: str, key: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("item"))


def missing_reference(rule: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent."""
    lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return _told(lost, rule, F.col(key)).distinct()


def repeated_key(rule: str, df: DataFrame, key: str) -> DataFrame:
    return _told(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), rule, F.col(key))


def broken_rule(rule: str, df: DataFrame, key: str, ok: Column) -> DataFrame:
    return _told(df.where(~F.coalesce(ok, F.lit(False))), rule, F.col(key))


def count_mismatch(rule: str, stated: DataFrame, key: str, count: str, rows: DataFrame) -> DataFrame:
    """Keys whose stated count is not that of their rows."""
    real = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    both = stated.join(real, key, "left")
    return _told(both.where(F.col(count) != F.coalesce("__n", F.lit(0))), rule, F.col(key))


def not_subset(rule: str, df: DataFrame, key: str, part: str, whole: str) -> DataFrame:
    return _told(df.where(F.size(F.array_except(part, whole)) > 0), rule, F.col(key))


def not_disjoint(rule: str, df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    return _told(df.where(F.arrays_overlap(a, b)), rule, F.col(key))


def differs(rule: str, derived: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows that a re-derivation and the stored table do not share."""
    return _told(derived.exceptAll(stored).unionByName(stored.exceptAll(derived)), rule, F.col(key)).distinct()


def wrong_shard(rule: str, df: DataFrame, key: str, day: str, shard: str) -> DataFrame:
    right = F.coalesce(F.year(day).cast("string"), F.lit("undated"))
    return _told(df.where(F.col(shard) != right), rule, F.col(key))


def violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def first_of_each(found: DataFrame, most: int = 5) -> DataFrame:
    w = Window.partitionBy("rule").orderBy("item")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def rule_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def refuse_if_any(found: DataFrame) -> None:
    """Raise with the first problems of each rule; called before anything is written."""
    problems = [f"{r['rule']}: {r['item']}" for r in first_of_each(found).orderBy("rule", "place").collect()]
    if problems:
        raise ValueError("refused: " + "; ".join(problems))


def volume_guard(new: DataFrame, least_rows: int = 0, previous_rows: int | None = None, least_share: float = 0.5) -> DataFrame:
    """Why a new snapshot must not replace the last one: too few rows, or less than a share of what there was."""
    n = new.agg(F.count(F.lit(1)).alias("n"))
    floor = max(least_rows, int((previous_rows or 0) * least_share))
    return n.where(F.col("n") < floor).select(F.lit("too few rows").alias("rule"), F.col("n").cast("string").alias("item"))


def share_guard(df: DataFrame, failed: Column, most: float = 0.05) -> DataFrame:
    share = df.agg((F.count_if(failed) / F.count(F.lit(1))).alias("s"))
    return share.where(F.col("s") > most).select(F.lit("too many failures").alias("rule"), F.col("s").cast("string").alias("item"))


def unknown_columns(df: DataFrame, allowed: list[str]) -> list[str]:
    return [c for c in df.columns if c not in allowed]


def gated(members: DataFrame, policies: DataFrame, entity: str, allowed: tuple[str, ...] = ("full", "derived-only")) -> DataFrame:
    """Members from sources that may be shown; an entity stays while it has any. Sources without a policy stop the build."""
    lost = members.select("source").distinct().join(policies, "source", "left_anti")
    if not lost.isEmpty():
        raise ValueError("sources without a policy: " + ", ".join(sorted(r["source"] for r in lost.collect())))
    return members.join(policies.where(F.col("policy").isin(*allowed)).select("source"), "source", "left_semi")


def attribute_conflicts(df: DataFrame, entity: str, source: str, value: str) -> DataFrame:
    """Entities for which two sources give values and share none.

    Two sources agree if they have a value in common; an entity conflicts if some pair of its sources does not.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(entity, source).agg(F.array_sort(F.collect_set(value)).alias("v"))
    per = own.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(source).alias("s"), F.col("v")))).alias("all"))
    clash = F.exists("all", lambda x: F.exists("all", lambda y: (x["s"] < y["s"]) & ~F.arrays_overlap(x["v"], y["v"])))
    return per.where(clash).select(entity, F.size("all").alias("n_sources"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda x: x["v"])))), "|").alias("all_values"))


def compare_sets(left: DataFrame, right: DataFrame, entity: str, item: str) -> DataFrame:
    """Per entity the items on both sides, on the left only and on the right only."""
    side = lambda df, n: df.select(entity, item).distinct().withColumn(n, F.lit(1))
    both = side(left, "l").join(side(right, "r"), [entity, item], "full")
    return both.groupBy(entity).agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), F.count_if(F.col("r").isNull()).alias("n_left_only"), F.count_if(F.col("l").isNull()).alias("n_right_only")
    )


def missing_text(rule: str, df: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """Documents that lack one of the phrases they must carry."""
    there = F.lit(True)
    for p in phrases:
        there = there & F.col(text).contains(p)
    return broken_rule(rule, df, key, there)
