"""Identities that last from build to build."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import fit_slug, hash_id
from tessera.operators import dedupe, graph
from tessera.plans.registry import query
from tessera.session import load


@query()
def frozen_ids_two_builds(spark, sf_dir):
    """Customers by nation and segment: an earlier build of older orders against one of all orders."""
    orders, customer = load(spark, sf_dir, "orders", "customer")
    active = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderdate", F.col("c_custkey").cast("string").alias("anchor"), "c_nationkey", "c_mktsegment")
    early = active.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).select(F.concat(F.lit("n"), "c_nationkey").alias("slug"), F.col("c_nationkey").alias("rank"), "anchor").distinct()
    late = active.select(F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey") % 10).alias("entity"), "anchor").distinct()
    return graph.carry_identity(early, late)


@query("""
SELECT o_orderkey AS node, goal, false AS in_cycle FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS goal FROM orders) WHERE o_orderkey <> goal""")
def redirect_chains(spark, sf_dir):
    """Each order leads to the same customer's order before it; the chains end at the first orders."""
    (orders,) = load(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    hops = orders.select(F.col("o_orderkey").alias("node"), before.alias("goal")).where("goal IS NOT NULL")
    return graph.redirect_targets(hops, "node", "goal")


@query("""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'brand' ELSE lower(replace(p_brand, '#', '-')) END AS base FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM n),
free AS (SELECT i, row_number() OVER (ORDER BY i) + 1 AS k FROM range(2, 1000000) t(i) WHERE 'brand-' || i NOT IN (SELECT base FROM n))
SELECT p_partkey, CASE WHEN k.k = 1 THEN base WHEN base = 'brand' THEN base || '-' || free.i ELSE base || '-' || k.k END AS slug FROM k LEFT JOIN free ON free.k = k.k""")
def suffixed_slugs(spark, sf_dir):
    """Parts under their brand, a third of them under "brand" alone, whose numbers must pass over the brands' own."""
    (part,) = load(spark, sf_dir, "part")
    own = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    rows = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "brand").otherwise(own).alias("base"))
    return graph.suffixed(rows, "base", ["p_partkey"]).select("p_partkey", "slug")


@query("SELECT p_partkey, left(sha1(p_name), 10) AS hidden_id, regexp_replace(left(lower(replace(p_type, ' ', '-')), 12 - 3), '-+$', '') || '-' || lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0') AS slug FROM part")
def hash_and_fitted_ids(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    return part.select("p_partkey", hash_id(F.col("p_name")).alias("hidden_id"), fit_slug(F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.col("p_partkey") % 90 + 10, 12).alias("slug"))


@query("""
WITH o AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 6000), n AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_acctbal > 1000)
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def merged_state(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    old = customer.where("c_acctbal < 6000").select("c_custkey", "c_acctbal")
    new = customer.where("c_acctbal > 1000").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") + 1).alias("c_acctbal"))
    return dedupe.merge_maps(old, new, "c_custkey")


@query("""
SELECT c.c_custkey, c.c_name, s.c_name AS successor FROM customer c LEFT JOIN customer s ON s.c_custkey = c.c_custkey // 2 AND s.c_acctbal > 0 WHERE c.c_acctbal <= 0""")
def retired_stubs(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    gone = customer.where("c_acctbal <= 0").select("c_custkey", "c_name", F.expr("c_custkey div 2").alias("into"))
    live = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("into"), F.col("c_name").alias("successor"))
    return gone.join(live, "into", "left").select("c_custkey", "c_name", "successor")
