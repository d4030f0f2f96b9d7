"""Activity over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.dates import month_label, quarter_label, window_start
from tessera.operators import series
from tessera.operators.checks import compare_sets
from tessera.plans.registry import query
from tessera.session import load

_YOY = """
WITH o AS (SELECT o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q FROM orders WHERE o_orderdate IS NOT NULL),
c AS (SELECT o_custkey, q, count(*) AS n FROM o GROUP BY 1, 2),
b AS (SELECT coalesce(x.o_custkey, y.o_custkey) AS o_custkey, coalesce(x.q, y.q) AS q, coalesce(x.n, 0) AS n, coalesce(y.n, 0) AS n_year_ago
      FROM c x FULL JOIN (SELECT o_custkey, q + 4 AS q, n FROM c) y ON x.o_custkey = y.o_custkey AND x.q = y.q)
SELECT o_custkey, (q // 4)::VARCHAR || '-Q' || (q % 4 + 1)::VARCHAR AS quarter, n::BIGINT AS n, n_year_ago::BIGINT AS n_year_ago
FROM b WHERE q <= (SELECT max(q) FROM o)"""


@query(_YOY)
def activity_by_quarter_yoy(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    return series.year_over_year(orders.select("o_custkey", "o_orderdate"), "o_custkey", "o_orderdate")


@query("""
WITH w AS (SELECT date_trunc('quarter', max(o_orderdate)::DATE - INTERVAL 24 MONTH)::DATE AS s FROM orders)
SELECT o_custkey, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR AS quarter, count(*) AS n
FROM orders, w WHERE o_orderdate >= s GROUP BY 1, 2""")
def window_filtered_counts(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    start = orders.agg(window_start(F.max(F.to_date("o_orderdate"))).alias("s"))
    kept = orders.join(F.broadcast(start), F.col("o_orderdate") >= F.col("s"))  # one row
    return kept.groupBy("o_custkey", quarter_label(F.col("o_orderdate")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT d AS last_day, date_trunc('quarter', d - INTERVAL 24 MONTH)::DATE AS window_start, year(d)::VARCHAR || '-Q' || quarter(d)::VARCHAR AS last_quarter
FROM (SELECT max(o_orderdate)::DATE AS d FROM orders)""")
def rolling_window_start(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    return series.window_bounds(orders, "o_orderdate")


@query("""
WITH c AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_flagged FROM lineitem GROUP BY 1),
m AS (SELECT strftime(unnest(generate_series(date_trunc('month', (SELECT min(l_shipdate) FROM lineitem)), date_trunc('month', (SELECT max(l_shipdate) FROM lineitem)), INTERVAL 1 MONTH)), '%Y-%m') AS month)
SELECT month, coalesce(n, 0) AS n, least(coalesce(n_flagged, 0), coalesce(n, 0)) AS n_flagged FROM m LEFT JOIN c USING (month)""")
def monthly_flagged_zero_filled(spark, sf_dir):
    (items,) = load(spark, sf_dir, "lineitem")
    return series.flagged_by_month(items.select("l_shipdate", "l_returnflag"), "l_shipdate", F.col("l_returnflag") == "R")


@query("""
WITH c AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
d AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day),
t AS (SELECT DISTINCT event_type FROM events)
SELECT day, event_type, coalesce(n, 0) AS n FROM d CROSS JOIN t LEFT JOIN c USING (day, event_type)""")
def events_daily_calendar(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    day = F.to_date("ts")
    counts = events.groupBy(day.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    # Every type over the whole calendar: the types carry the calendar as an array, one row each.
    types = counts.groupBy("event_type").agg(F.lit(1).alias("one"))
    ends = events.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    grid = types.join(F.broadcast(ends)).select("event_type", F.explode(F.sequence("a", "b")).alias("day"))  # ends: one row
    return series.zero_filled(grid, counts, ["day", "event_type"], ["n"])


@query("""
WITH f AS (SELECT o_custkey, min(o_orderdate) AS first_day FROM orders GROUP BY 1)
SELECT o_custkey, first_day::DATE AS first_day, 'date' AS first_basis FROM f
WHERE first_day::DATE >= (SELECT date_trunc('quarter', max(o_orderdate)::DATE - INTERVAL 60 MONTH)::DATE FROM orders)
AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def first_seen_new_entities(spark, sf_dir):
    orders, customer = load(spark, sf_dir, "orders", "customer")
    start = orders.agg(window_start(F.max(F.to_date("o_orderdate")), 60)).first()[0]
    claims = orders.select("o_custkey", F.to_date("o_orderdate").alias("day"), F.lit("date").alias("basis"))
    known = customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return series.first_sightings(claims, "o_custkey", "day", "basis", F.lit(start), known)


@query("""
WITH t AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 8),
y AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS year FROM orders),
c AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, year, coalesce(n, 0)::BIGINT AS n FROM t CROSS JOIN y LEFT JOIN c USING (o_custkey, year)""")
def top_entities_then_points(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    points = orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return series.top_points(points, "o_custkey", "year", 8, points.select("year").distinct())


@query("""
WITH s AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) < 4)
SELECT l_suppkey, count(*) AS n_lines, count(*) FILTER (l_orderkey NOT IN (SELECT l_orderkey FROM s)) AS n_excluded FROM lineitem GROUP BY 1""")
def fanout_cap_counts(spark, sf_dir):
    (items,) = load(spark, sf_dir, "lineitem")
    small = items.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("k")).where("k < 4").select("l_orderkey", F.lit(True).alias("small"))
    marked = items.select("l_orderkey", "l_suppkey").join(small, "l_orderkey", "left")
    return marked.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("small").isNull()).alias("n_excluded"))


@query("""
SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) < 4) GROUP BY 1""")
def fanout_capped_activity(spark, sf_dir):
    orders, items = load(spark, sf_dir, "orders", "lineitem")
    lines = items.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    kept = series.within_cap(lines, ["o_orderkey"], "l_partkey", 4).select("o_orderkey").distinct()
    return orders.join(kept, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
r AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')
SELECT coalesce(l.k, r.k) AS l_suppkey, count(*) FILTER (l.p IS NOT NULL AND r.p IS NOT NULL) AS n_both, count(*) FILTER (r.p IS NULL) AS n_left_only, count(*) FILTER (l.p IS NULL) AS n_right_only
FROM l FULL JOIN r ON l.k = r.k AND l.p = r.p GROUP BY 1""")
def reported_vs_documented(spark, sf_dir):
    (items,) = load(spark, sf_dir, "lineitem")
    late = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")
    return compare_sets(items.where(late), items.where(~late), "l_suppkey", "l_partkey")


@query("""
SELECT l_suppkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, count(DISTINCT l_partkey) AS n_parts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5) AND o_orderstatus = 'F' GROUP BY 1""")
def catalog_semi_collect(spark, sf_dir):
    items, orders, part = load(spark, sf_dir, "lineitem", "orders", "part")
    listed = part.where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    kept = items.select("l_orderkey", "l_partkey", "l_suppkey").join(listed, "l_partkey", "left_semi")
    both = kept.join(orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.count_distinct("l_partkey").alias("n_parts"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1")
def monthly_orders(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    return orders.groupBy(month_label(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers"))
