"""Integrity rules, composition counts and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import checks
from tessera.plans.registry import query
from tessera.session import load

_VIOLATIONS = """
WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY'), v AS (
SELECT DISTINCT 'order without customer' AS rule, o_custkey::VARCHAR AS item FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c)
UNION ALL SELECT 'repeated line', l_orderkey || '/' || l_linenumber FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'negative balance', c_custkey::VARCHAR FROM c WHERE NOT coalesce(c_acctbal >= 0, false)
UNION ALL SELECT 'line count', o_orderkey::VARCHAR FROM (SELECT o_orderkey, o_orderkey % 7 AS stated, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) WHERE stated <> n
UNION ALL SELECT 'wrong shard', o_orderkey::VARCHAR FROM orders WHERE year(o_orderdate) <> 1995 + o_orderkey % 7)
"""


def _found(spark, sf_dir):
    orders, items, customer = load(spark, sf_dir, "orders", "lineitem", "customer")
    customer = customer.where("c_mktsegment <> 'MACHINERY'")
    few = orders.select("o_orderkey", (F.col("o_orderkey") % 7).alias("stated"))
    lines = items.select(F.col("l_orderkey").alias("o_orderkey"))
    pairs = items.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("pair"))
    repeated = checks.repeated_key("repeated line", pairs, "pair")
    shards = orders.select("o_orderkey", "o_orderdate", (F.lit(1995) + F.col("o_orderkey") % 7).cast("string").alias("shard"))
    return checks.violations(
        checks.missing_reference("order without customer", orders, "o_custkey", customer, "c_custkey"),
        repeated,
        checks.broken_rule("negative balance", customer, "c_custkey", F.col("c_acctbal") >= 0),
        checks.count_mismatch("line count", few, "o_orderkey", "stated", lines),
        checks.wrong_shard("wrong shard", shards, "o_orderkey", "o_orderdate", "shard"),
    )


@query(_VIOLATIONS + "SELECT rule, item FROM v")
def integrity_violations(spark, sf_dir):
    return _found(spark, sf_dir)


@query(_VIOLATIONS + "SELECT rule, count(*) AS n FROM v GROUP BY 1")
def violation_counts(spark, sf_dir):
    return checks.rule_counts(_found(spark, sf_dir))


@query(_VIOLATIONS + "SELECT rule, item, place::INTEGER AS place FROM (SELECT rule, item, row_number() OVER (PARTITION BY rule ORDER BY item) AS place FROM v) WHERE place <= 5")
def reported_problems(spark, sf_dir):
    return checks.first_of_each(_found(spark, sf_dir))


@query("""
WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f, list(DISTINCT l_linestatus) AS st FROM lineitem GROUP BY 1)
SELECT 'flags beyond R and N' AS rule, l_orderkey::VARCHAR AS item FROM s WHERE NOT list_has_all(['R', 'N'], f) UNION ALL SELECT 'both states', l_orderkey::VARCHAR FROM s WHERE list_has_all(st, ['F', 'O'])""")
def set_rules(spark, sf_dir):
    (items,) = load(spark, sf_dir, "lineitem")
    s = items.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("st"))
    s = s.withColumn("whole", F.array(F.lit("R"), F.lit("N"))).withColumn("open", F.filter("st", lambda x: x == "O")).withColumn("other", F.when(F.array_contains("st", "F"), F.array(F.lit("O"))).otherwise(F.array().cast("array<string>")))
    return checks.violations(checks.not_subset("flags beyond R and N", s, "l_orderkey", "f", "whole"), checks.not_disjoint("both states", s, "l_orderkey", "open", "other"))


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) + (o_custkey % 50 = 0)::INTEGER AS n FROM orders GROUP BY 1)
SELECT DISTINCT 'derived counts' AS rule, o_custkey::VARCHAR AS item FROM ((FROM a EXCEPT ALL FROM b) UNION ALL (FROM b EXCEPT ALL FROM a))""")
def rederived_equality(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    stored = counts.withColumn("n", F.col("n") + (F.col("o_custkey") % 50 == 0).cast("int"))
    return checks.differs("derived counts", counts, stored, "o_custkey")


@query("""
SELECT count(*) AS n_documents, count(*) FILTER (lang = 'en') AS n_english, count(DISTINCT source) AS n_sources, count(quality) AS n_labelled, count(*) FILTER (toxic = 1) AS n_toxic,
count(*) FILTER (quality IS NULL) AS n_unlabelled, count(*) FILTER (n_chars < 100) AS n_short, count(*) FILTER (n_chars >= 5000) AS n_long, sum(n_chars)::BIGINT AS chars, count(*) - count(DISTINCT text) AS n_surplus_copies
FROM documents LEFT JOIN labels USING (doc_id)""")
def composition_report(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents", "labels")
    rows = docs.withColumn("digest", F.sha2("text", 256)).drop("text").join(labels, "doc_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(F.col("lang") == "en").alias("n_english"),
        F.count_distinct("source").alias("n_sources"),
        F.count("quality").alias("n_labelled"),
        F.count_if(F.col("toxic") == 1).alias("n_toxic"),
        F.count_if(F.col("quality").isNull()).alias("n_unlabelled"),
        F.count_if(F.col("n_chars") < 100).alias("n_short"),
        F.count_if(F.col("n_chars") >= 5000).alias("n_long"),
        F.sum("n_chars").alias("chars"),
        (F.count(F.lit(1)) - F.count_distinct("digest")).alias("n_surplus_copies"),
    )


@query("""
SELECT source, count(*) AS n_records, max(n_chars) AS largest, count(*) < 0.9 * (SELECT max(c) FROM (SELECT count(*) AS c FROM documents GROUP BY source)) AS shrunk FROM documents GROUP BY 1""")
def source_status(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.max("n_chars").alias("largest"))
    most = per.agg(F.max("n_records").alias("m"))
    return per.join(F.broadcast(most)).select("source", "n_records", "largest", (F.col("n_records") < F.col("m") * 0.9).alias("shrunk"))  # most: one row


@query("SELECT source, sum(n - 1)::BIGINT AS surplus FROM (SELECT source, text, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def duplicate_surplus(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    groups = docs.groupBy("source", F.sha2("text", 256).alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.groupBy("source").agg(F.sum(F.col("n") - 1).alias("surplus"))


@query("SELECT lower(p_type) AS key, count(DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE p_type END) AS n_spellings FROM part GROUP BY 1 HAVING count(DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE p_type END) > 1")
def spelling_variant_groups(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    spelled = F.when(F.col("p_size") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type"))
    return part.groupBy(F.lower("p_type").alias("key")).agg(F.count_distinct(spelled).alias("n_spellings")).where("n_spellings > 1")
