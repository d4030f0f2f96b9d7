"""Dictionaries, bit masks, prefixes and ranked names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import mask_positions


def frequency_dictionary(df: DataFrame, col: str, name: str = "value") -> DataFrame:
    """value, n and code: codes count from 0, the most frequent value first, ties by value.

    Distinct values are ranked, not rows; a dictionary is meant for columns with few of them.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("code", F.row_number().over(Window.orderBy(F.desc("n"), name)) - 1)


def encode(df: DataFrame, col: str, dictionary: DataFrame, code: str) -> DataFrame:
    codes = dictionary.select(F.col("value").alias(col), F.col("code").alias(code))
    return df.join(codes, col, "left")


def decode(df: DataFrame, code: str, dictionary: DataFrame, col: str) -> DataFrame:
    return df.join(dictionary.select(F.col("code").alias(code), F.col("value").alias(col)), code, "left")


def source_mask(df: DataFrame, key: str, code: str) -> DataFrame:
    """One bit for each source that a key has rows from."""
    return df.groupBy(key).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(code))).alias("mask"))


def mask_codes(df: DataFrame, mask: str = "mask") -> DataFrame:
    return df.withColumn("codes", mask_positions(F.col(mask)))


def shortest_prefix(df: DataFrame, id_col: str, least: int = 8, longest: int = 64) -> DataFrame:
    """The shortest length, least or more, at which all distinct ids differ.

    Ids are sorted within ranges of their first characters; only neighbours can share the longest prefix.
    """
    ids = df.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct()
    w = Window.partitionBy(F.substring("id", 1, 2)).orderBy("id")
    before = ids.withColumn("b", F.lag("id").over(w)).where(F.col("b").isNotNull())
    same = F.aggregate(F.sequence(F.lit(1), F.lit(longest)), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substr("id", i, F.lit(1)) == F.substr("b", i, F.lit(1))) & (F.length("id") >= i), i).otherwise(acc))
    return before.agg(F.greatest(F.lit(least), F.coalesce(F.max(same), F.lit(0)) + 1).alias("prefix_length"))


def merged_spellings(df: DataFrame, key: Column, spelling: str, count: str) -> DataFrame:
    """Counts added up under a key, shown by the most used spelling, ties by the spelling."""
    per = df.groupBy(key.alias("key"), spelling).agg(F.sum(count).alias("c")).where(F.col("key").isNotNull())
    return per.groupBy("key").agg(F.min_by(spelling, F.struct(-F.col("c"), F.col(spelling))).alias("spelling"), F.sum("c").alias("n"))


def ranked_names(names: DataFrame, entity: str) -> DataFrame:
    """names (entity, record, key, spelling, is_primary) ranked: `rank` 1 is the name to show.

    Keys rank by records that use them as primary name, then by records that carry them, then by key; within a key the
    spelling used most as primary name leads.
    """
    per_key = names.groupBy(entity, "key").agg(F.count_distinct(F.when(F.col("is_primary"), F.col("record"))).alias("k_primary"), F.count_distinct("record").alias("k_carried"))
    per_spelling = names.groupBy(entity, "key", "spelling").agg(F.count_if("is_primary").alias("s_primary"), F.count(F.lit(1)).alias("s_used"))
    w = Window.partitionBy(entity).orderBy(F.desc("k_primary"), F.desc("k_carried"), "key", F.desc("s_primary"), F.desc("s_used"), "spelling")
    return per_spelling.join(per_key, [entity, "key"]).withColumn("rank", F.row_number().over(w))


def display_names(names: DataFrame, entity: str, preferred: Column) -> DataFrame:
    """The first ranked name of each entity, from preferred records where any name comes from one."""
    own = names.withColumn("__pref", preferred)
    best = F.max("__pref").over(Window.partitionBy(entity))
    chosen = own.withColumn("__best", best).where(F.col("__pref") == F.col("__best"))
    return ranked_names(chosen, entity).where("rank = 1").select(entity, F.col("spelling").alias("display_name"))


def alias_rollup(names: DataFrame, entity: str, display: DataFrame) -> DataFrame:
    """Aliases with their sources: the shown name first, then by number of sources, then by spelling."""
    per = names.groupBy(entity, "spelling").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    per = per.join(display, entity)
    w = Window.partitionBy(entity).orderBy((F.col("spelling") != F.col("display_name")).cast("int"), F.desc(F.size("sources")), "spelling")
    return per.withColumn("rank", F.row_number().over(w)).drop("display_name")


def collected(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sorted distinct values of each key."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
