"""Record sources and sinks run over small files made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import load, written
from tessera.sources import sinks


@query("SELECT o_orderkey, coalesce(year(o_orderdate)::VARCHAR, 'undated') AS shard FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'undated' FROM orders WHERE o_orderstatus = 'P'")
def year_shards_round_trip(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("day"))
    return sinks.read_shards(spark, sinks.write_shards(rows, "day")).select("o_orderkey", "shard")


@query("""
WITH d AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS code FROM orders GROUP BY 1)
SELECT o_orderkey AS id, o_orderdate::DATE AS day, code::INTEGER AS organisation FROM orders JOIN d ON v = o_orderpriority""")
def columnar_index(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    rows, _ = sinks.coded_index(orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("organisation")), ["organisation"])
    return rows


@query("SELECT o_custkey, count(*) AS n_reports, sha256(array_to_string(list_sort(list(o_orderkey)), ',')) AS digest FROM orders GROUP BY 1")
def entity_documents(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    per = written(orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("reports")))
    return per.select("o_custkey", F.size("reports").cast("long").alias("n_reports"), F.sha2(F.array_join(F.transform("reports", lambda x: x.cast("string")), ","), 256).alias("digest"))
