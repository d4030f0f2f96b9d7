"""Choices with caps, variety and even spacing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped(df: DataFrame, group: str, order: list[Column], cap: int, total: int) -> DataFrame:
    """In a global order at most cap rows of a group and total rows in all. A row's place in its group decides, so no scan is needed."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= cap).drop("__rn").orderBy(*order).limit(total)


def diverse_first(df: DataFrame, group: str, variety: str, order: list[Column], n: int = 3) -> DataFrame:
    """The first n of each group: the best of each variety before any second of one."""
    per = Window.partitionBy(group, variety).orderBy(*order)
    out = df.withColumn("__again", (F.row_number().over(per) > 1).cast("int"))
    w = Window.partitionBy(group).orderBy("__again", *order)
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("__again")


def evenly_spaced(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """n rows at even distances of a ranked list, first and last included; places come from counts per range, not one window."""
    total = df.count()
    if total <= n:
        return df.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)
    ranked = ranked_globally(df, order)
    wanted = sorted({i * (total - 1) // (n - 1) for i in range(n)}) if n > 1 else [0]
    return ranked.where(F.col("place").isin(wanted))


def ranked_globally(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `place`, counting from 0 in the global order, by a range sort and the row counts of its parts."""
    from tessera.session import written

    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__off"))  # one row per partition
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__in", inside).join(F.broadcast(offsets), "__part").withColumn("place", F.col("__off") + F.col("__in")).drop("__part", "__off", "__in")


def round_robin(df: DataFrame, stratum: str, publisher: str, order: list[str], per_publisher: int, total: int) -> DataFrame:
    """Rows taken one from each stratum in turn, at most per_publisher of a publisher over all.

    The joint cap makes each choice depend on all earlier ones. Only rows that can matter are replayed: a row with more
    than per_publisher rows of its publisher before it in its stratum, or beyond what total needs, never can.
    """
    own = Window.partitionBy(stratum, publisher).orderBy(*order)
    few = df.withColumn("__p", F.row_number().over(own)).where(F.col("__p") <= per_publisher).drop("__p")
    few = few.withColumn("__s", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("__s") <= total * (per_publisher + 1))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = {k: g.to_dict("records") for k, g in pdf.sort_values([stratum, "__s"]).groupby(stratum, sort=True)}
        used, out = {}, []
        while any(queues.values()) and len(out) < total:
            for q in queues.values():
                while q and used.get(q[0][publisher], 0) >= per_publisher:
                    q.pop(0)
                if q and len(out) < total:
                    row = q.pop(0)
                    used[row[publisher]] = used.get(row[publisher], 0) + 1
                    out.append({**row, "place": len(out)})
        return pd.DataFrame(out, columns=[*pdf.columns, "place"]).drop(columns="__s")

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema]) + ", place int"
    return few.groupBy().applyInPandas(replay, schema)
