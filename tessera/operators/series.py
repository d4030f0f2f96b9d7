"""Activity over time: quarters and months, zero filling, the same period a year before, first sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import month_label, quarter_label, window_start


def month_calendar(df: DataFrame, first: Column, last: Column, name: str = "month") -> DataFrame:
    """One row for each month between the least first and the greatest last; none for an empty table."""
    ends = df.agg(F.min(first).alias("a"), F.max(last).alias("b")).where(F.col("a").isNotNull())
    return ends.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))).alias("__d")).select(month_label(F.col("__d")).alias(name))


def zero_filled(calendar: DataFrame, counted: DataFrame, on: list[str], counts: list[str]) -> DataFrame:
    joined = calendar.join(counted, on, "left")
    return joined.select(*on, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def year_over_year(df: DataFrame, entity: str, day: str, since: Column | None = None) -> DataFrame:
    """entity, quarter, n and n_year_ago. A quarter without rows gets one with n = 0 where the year before had some.

    One aggregation and one more over its own result: each count is sent to its quarter and to the same quarter a year
    on, so no self-join is needed.
    """
    rows = df if since is None else df.where(F.col(day) >= since)
    q = F.year(day) * 4 + F.quarter(day) - 1
    counts = rows.where(F.col(day).isNotNull()).groupBy(entity, q.alias("q")).agg(F.count(F.lit(1)).alias("n"))
    last = rows.agg(F.max(q).alias("last"))
    sent = counts.select(entity, F.explode(F.array(F.struct(F.col("q").alias("q"), F.col("n").alias("n"), F.lit(0).cast("long").alias("ago")), F.struct((F.col("q") + 4).alias("q"), F.lit(0).cast("long").alias("n"), F.col("n").alias("ago")))).alias("s"))
    both = sent.select(entity, "s.*").groupBy(entity, "q").agg(F.sum("n").alias("n"), F.sum("ago").alias("n_year_ago"))
    both = both.join(F.broadcast(last), F.col("q") <= F.col("last"))  # one row: nothing is reported for quarters still to come
    label = F.concat(F.floor(F.col("q") / 4).cast("string"), F.lit("-Q"), (F.col("q") % 4 + 1).cast("string"))
    return both.select(entity, label.alias("quarter"), "n", "n_year_ago")


def flagged_by_month(df: DataFrame, day: str, flag: Column) -> DataFrame:
    """Every month from the first to the last with its rows and its flagged rows."""
    counts = df.where(F.col(day).isNotNull()).groupBy(month_label(F.col(day)).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_flagged"))
    calendar = month_calendar(df, F.col(day), F.col(day))
    out = zero_filled(calendar, counts, ["month"], ["n", "n_flagged"])
    return out.withColumn("n_flagged", F.least("n_flagged", "n"))


def first_sightings(claims: DataFrame, entity: str, day: str, basis: str, since: Column, known: DataFrame | None = None) -> DataFrame:
    """Entities whose earliest claim is in the window, and that were not known before; equal days by basis."""
    first = claims.where(F.col(day).isNotNull()).groupBy(entity).agg(F.min(F.struct(F.col(day).alias("day"), F.col(basis).alias("basis"))).alias("f"))
    out = first.select(entity, F.col("f.day").alias("first_day"), F.col("f.basis").alias("first_basis")).where(F.col("first_day") >= since)
    return out if known is None else out.join(known.select(entity).distinct(), entity, "left_anti")


def top_entities(points: DataFrame, entity: str, n: int, value: str = "n") -> DataFrame:
    return points.groupBy(entity).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), entity).limit(n)


def top_points(points: DataFrame, entity: str, period: str, n: int, periods: DataFrame, value: str = "n") -> DataFrame:
    """The n entities with the largest totals, with a row for each period; n rows are broadcast."""
    top = top_entities(points, entity, n, value).select(entity)
    grid = periods.select(period).join(F.broadcast(top))
    return zero_filled(grid, points.groupBy(entity, period).agg(F.sum(value).alias(value)), [entity, period], [value])


def within_cap(df: DataFrame, group: list[str], member: str, cap: int) -> DataFrame:
    """Rows of groups with fewer distinct members than the cap."""
    small = df.groupBy(*group).agg(F.count_distinct(member).alias("__n")).where(F.col("__n") < cap).select(*group)
    return df.join(small, group, "left_semi")


def window_bounds(df: DataFrame, day: str, months: int = 24) -> DataFrame:
    last = df.agg(F.max(F.to_date(day)).alias("last_day"))
    return last.select("last_day", window_start(F.col("last_day"), months).alias("window_start"), quarter_label(F.col("last_day")).alias("last_quarter"))
