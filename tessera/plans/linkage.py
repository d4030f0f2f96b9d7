"""Joins, components, clusters and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ascii_tokens, name_key
from tessera.operators import checks, dedupe, graph, guesses, match
from tessera.plans.registry import query
from tessera.session import load

_KEYS = "SELECT doc_id, lower(trim(split_part(text, chr(10), 1))) AS key FROM documents UNION ALL SELECT doc_id, sha1(text) AS key FROM documents"


def _carriers(docs: DataFrame) -> DataFrame:
    """Documents carry their title line and the digest of the whole text as keys."""
    keys = F.array(F.lower(F.trim(F.split("text", "\n")[0])), F.sha1("text"))
    return docs.select("doc_id", F.explode(keys).alias("key"))


@query(f"""
WITH k AS (SELECT DISTINCT doc_id, key FROM ({_KEYS})), h AS (SELECT key, min(doc_id) AS src FROM k GROUP BY 1)
SELECT key, src, doc_id AS dst FROM k JOIN h USING (key) WHERE doc_id <> src""")
def blocking_star_edges(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return graph.star_edges(_carriers(docs), "doc_id", "key")


_CC = f"""
WITH RECURSIVE k AS (SELECT DISTINCT doc_id, key FROM ({_KEYS})), h AS (SELECT key, min(doc_id) AS src FROM k GROUP BY 1),
e AS (SELECT src AS a, doc_id AS b FROM k JOIN h USING (key) WHERE doc_id <> src), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
c AS (SELECT x AS doc_id, min(y) AS component FROM r GROUP BY 1)
"""


@query(_CC + "SELECT doc_id, component FROM c")
def connected_components(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return graph.connected_components(docs, graph.star_edges(_carriers(docs), "doc_id", "key"), "doc_id")


@query(_CC + """
SELECT component, count(*) AS n_copies, arg_min(d.doc_id, (sha1(d.text), d.doc_id)) AS canonical_doc, min(sha1(d.text)) AS canonical_digest,
count(DISTINCT source) AS n_sources, max(n_chars) AS longest FROM documents d JOIN c USING (doc_id) GROUP BY 1""")
def cluster_canonical_row(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    comps = connected_components(spark, sf_dir)
    rows = docs.select("doc_id", F.sha1("text").alias("digest"), "source", "n_chars").join(comps, "doc_id")
    return rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_copies"),
        F.min_by("doc_id", F.struct("digest", "doc_id")).alias("canonical_doc"),
        F.min("digest").alias("canonical_digest"),
        F.count_distinct("source").alias("n_sources"),
        F.max("n_chars").alias("longest"),
    )


def anchored_rows(spark, sf_dir):
    """Suppliers carry keys of their nation and of their balance; those of some balance are anchors."""
    (supplier,) = load(spark, sf_dir, "supplier")
    keys = F.array(F.concat(F.lit("n"), "s_nationkey", F.lit("-"), F.col("s_suppkey") % 7), F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 150)))
    rows = supplier.select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("node"), F.explode(keys).alias("key"), (F.col("s_suppkey") % 9 == 0).alias("is_anchor"), (F.col("s_suppkey") % 4 == 0).alias("is_named"))
    return graph.anchored_components(rows, F.col("is_anchor"), F.col("is_named"))


@query()
def constrained_components(spark, sf_dir):
    return anchored_rows(spark, sf_dir)[0]


@query()
def refused_keys(spark, sf_dir):
    return anchored_rows(spark, sf_dir)[1]


@query("""
WITH v AS (SELECT DISTINCT p_name, p_size % 3 AS source, p_brand FROM part WHERE p_brand IS NOT NULL),
s AS (SELECT p_name, source, list(p_brand) AS b FROM v GROUP BY 1, 2)
SELECT p_name, (SELECT count(*) FROM s z WHERE z.p_name = t.p_name)::INTEGER AS n_sources, (SELECT string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) FROM v WHERE v.p_name = t.p_name) AS all_values
FROM (SELECT DISTINCT x.p_name FROM s x JOIN s y ON x.p_name = y.p_name AND x.source < y.source AND len(list_intersect(x.b, y.b)) = 0) t""")
def attribute_conflicts(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    return checks.attribute_conflicts(part.withColumn("source", F.col("p_size") % 3), "p_name", "source", "p_brand")


@query("""
SELECT c_custkey, n_name, CASE WHEN n_name IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey""")
def left_lookup_unresolved(spark, sf_dir):
    customer, nation = load(spark, sf_dir, "customer", "nation")
    known = nation.where("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = customer.join(known, "c_nationkey", "left")
    return out.select("c_custkey", "n_name", F.when(F.col("n_name").isNull(), "unresolved").otherwise("resolved").alias("status"))


@query("""
SELECT c_nationkey, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS n_unresolved FROM customer
WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1) GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 200""")
def unresolved_names_ranked(spark, sf_dir):
    customer, nation = load(spark, sf_dir, "customer", "nation")
    known = nation.where("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey"))
    lost = customer.join(known, "c_nationkey", "left_anti").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    total = lost.agg(F.sum("n").alias("n_unresolved"))
    return lost.join(F.broadcast(total)).orderBy(F.desc("n"), "c_nationkey").limit(200)  # total: one row


@query("""
SELECT count(*) AS n_records, count(n_nationkey) AS n_resolved, count(n_nationkey) / count(*) AS match_rate
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey""")
def match_rate(spark, sf_dir):
    rows = left_lookup_unresolved(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n_records"), F.count("n_name").alias("n_resolved")).withColumn("match_rate", F.try_divide("n_resolved", "n_records"))


@query("""
SELECT d.doc_id, q.quality, q.toxic FROM documents d LEFT JOIN (SELECT doc_id, arg_min(quality, (quality, toxic)) AS quality, arg_min(toxic, (quality, toxic)) AS toxic FROM labels GROUP BY 1) q USING (doc_id)""")
def enrich_never_adds(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents", "labels")
    one = dedupe.first_wins(labels, ["doc_id"], [F.col("quality"), F.col("toxic")])
    return docs.select("doc_id").join(one, "doc_id", "left")


@query("""
WITH g AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_partkey AS key_a, b.l_partkey AS key_b, count(*) AS n_rows FROM g a JOIN g b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2""")
def cooccurrence_pairs(spark, sf_dir):
    (items,) = load(spark, sf_dir, "lineitem")
    return match.cooccurrence(items.select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", 2)


@query("""
WITH g AS (SELECT DISTINCT l_suppkey AS e, l_orderkey AS a FROM lineitem), f AS (SELECT a FROM g GROUP BY 1 HAVING count(*) BETWEEN 2 AND 3)
SELECT x.e AS entity_a, y.e AS entity_b, count(*) AS n_shared FROM g x JOIN g y ON x.a = y.a AND x.e < y.e WHERE x.a IN (SELECT a FROM f) GROUP BY 1, 2""")
def rare_attribute_links(spark, sf_dir):
    (items,) = load(spark, sf_dir, "lineitem")
    return match.rare_attribute_links(items, "l_linenumber", "l_suppkey", "l_orderkey", 3)


@query("""
SELECT l_partkey, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT o_custkey) AS n_customers, max(p_retailprice) AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 GROUP BY 1""")
def attribute_rollup(spark, sf_dir):
    items, orders, part = load(spark, sf_dir, "lineitem", "orders", "part")
    both = items.select("l_orderkey", "l_partkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    per = both.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"))
    scores = part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("score"))
    return per.join(scores, "l_partkey", "left")


@query("""
SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def relationship_join(spark, sf_dir):
    supplier, nation, region = load(spark, sf_dir, "supplier", "nation", "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""
SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS entity FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') a ON o_custkey = a.c_custkey
LEFT JOIN (SELECT min(c_custkey) AS c_custkey, c_custkey % 1000 AS k FROM customer GROUP BY 2) b ON o_custkey % 1000 = b.k
WHERE coalesce(a.c_custkey, b.c_custkey) IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def reference_by_id_else_key(spark, sf_dir):
    orders, customer = load(spark, sf_dir, "orders", "customer")
    by_id = customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("a"))
    by_key = customer.groupBy((F.col("c_custkey") % 1000).alias("k")).agg(F.min("c_custkey").alias("b"))
    out = orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 1000).alias("k")).join(by_id, "o_custkey", "left").join(by_key, "k", "left")
    shown = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("entity"))
    return out.select("o_orderkey", F.coalesce("a", "b").alias("entity")).join(shown, "entity", "left_semi").select("o_orderkey", "entity")


@query("""
SELECT kind, count(*) AS n FROM (SELECT p_type AS key, arg_min(p_brand, (p_brand <> 'Brand#11', p_brand, p_partkey)) AS kind FROM part
WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1) GROUP BY 1) GROUP BY 1""")
def typed_names(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    named = part.where("p_size = 1").select(F.col("p_name").alias("name")).distinct()
    rows = part.join(named, part["p_name"] == named["name"], "left_anti")
    software = rows.select(F.col("p_type").alias("key"), F.col("p_brand").alias("source"), F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("kind"))
    none = software.select("key").where("false")
    return graph.typed_names(software, none, "Brand#11").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9_]+') AS w FROM part)
SELECT p_partkey, array_to_string(CASE WHEN len(w) > 1 AND w[-1] IN ('group', 'team') THEN w[:-2] ELSE w END, '') AS name_key FROM t""")
def name_keys(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    return part.select("p_partkey", name_key(ascii_tokens(F.col("p_name"))).alias("name_key"))


@query("""
SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA') UNION ALL SELECT 'none', r_name FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE', 'AFRICA')""")
def policy_gate(spark, sf_dir):
    nation, region = load(spark, sf_dir, "nation", "region")
    members = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("source"))
    policies = region.select(F.col("r_name").alias("source"), F.when(F.col("r_name").isin("ASIA", "EUROPE"), "full").when(F.col("r_name") == "AFRICA", "derived-only").otherwise("evidence-only").alias("policy"))
    shown = checks.gated(members, policies, "n_name").select("n_name", F.col("source").alias("r_name"))
    hidden = policies.where("policy = 'evidence-only'").select(F.lit("none").alias("n_name"), F.col("source").alias("r_name"))
    return shown.unionByName(hidden)


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'software' WHEN c_nationkey < 12 THEN 'bridge' ELSE 'new' END AS kind, c_nationkey % 5 <> 0 AND c_nationkey < 12 AS accepted,
CASE WHEN c_nationkey < 12 THEN 'E' || c_nationkey END AS entity FROM customer""")
def stated_pair_decisions(spark, sf_dir):
    """Pairs of a nation's name and a customer's label: every fifth nation's name is one of software, those below 12 are known."""
    customer, nation = load(spark, sf_dir, "customer", "nation")
    who = lambda c: F.concat(F.lit("land"), F.translate(F.col(c).cast("string"), "0123456789", "abcdefghij"))
    pairs = customer.select(F.col("c_custkey").alias("pair"), F.concat(who("c_nationkey"), F.lit(" Panda")).alias("name"), F.concat(F.lit("Storm-"), "c_custkey").alias("alias"))
    key = F.concat(who("n_nationkey"), F.lit("panda"))
    known = nation.where("n_nationkey < 12").select(key.alias("key"), F.concat(F.lit("E"), "n_nationkey").alias("component"))
    software = nation.where("n_nationkey % 5 = 0").select(key.alias("key"), F.lit("malware").alias("kind"))
    out = guesses.pair_decisions(pairs, known, software, known.select("component"))
    return out.select(F.col("pair").alias("c_custkey"), "kind", "accepted", "entity")
