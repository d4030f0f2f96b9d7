"""First-wins choice, caps, variety, dictionaries and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import registrable_domain, url_host
from tessera.operators import dedupe, rollup, topk
from tessera.plans.registry import query
from tessera.session import load


@query("""
SELECT k AS text_key, doc_id, source FROM (SELECT sha1(lower(trim(text))) AS k, doc_id, source, row_number() OVER (PARTITION BY sha1(lower(trim(text))) ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1""")
def first_wins_dedupe(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    keyed = docs.select(F.sha1(F.lower(F.trim("text"))).alias("text_key"), "doc_id", "source")
    return dedupe.first_wins(keyed, ["text_key"], [F.col("source"), F.col("doc_id")])


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d FROM orders),
b AS (SELECT *, coalesce((d - lag(d) OVER w > 14)::INTEGER, 0) AS begins FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey)),
c AS (SELECT *, sum(begins) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS UNBOUNDED PRECEDING) AS chain FROM b)
SELECT o_custkey, chain::BIGINT AS chain, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM c GROUP BY 1, 2""")
def near_date_chain_islands(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    o = orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).alias("at"))
    chained = dedupe.chain_near(o, ["o_custkey"], F.col("at"), F.lit(14), ["o_orderkey"])
    return chained.groupBy("o_custkey", "chain").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


@query("""
WITH r AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY sha1(url), page_id) AS rn FROM r)
SELECT page_id, host FROM (SELECT page_id, host, sha1(url) AS s FROM k WHERE rn <= 3 ORDER BY s, page_id LIMIT 80)""")
def per_host_cap_limit(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    rows = pages.select("page_id", "url", url_host(F.col("url")).alias("host"))
    return topk.capped(rows, "host", [F.sha1("url"), F.col("page_id")], 3, 80).select("page_id", "host")


@query("""
WITH a AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) > 1 AS again FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY again, n_chars DESC, doc_id) AS place FROM a)
SELECT lang, source, doc_id, place::INTEGER AS place FROM b WHERE place <= 3""")
def diversity_top3(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return topk.diverse_first(docs.select("lang", "source", "doc_id", "n_chars"), "lang", "source", [F.desc("n_chars"), F.col("doc_id")]).select("lang", "source", "doc_id", "place")


@query("""
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer)
SELECT c_custkey, place::BIGINT AS place FROM r WHERE place IN (SELECT i * (n - 1) // 11 FROM generate_series(0, 11) t(i))""")
def evenly_spaced_sample(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    return topk.evenly_spaced(customer.select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 12).select("c_custkey", F.col("place").cast("long").alias("place"))


@query("SELECT lang || '/' || source AS value, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, lang || '/' || source) - 1)::INTEGER AS code FROM documents GROUP BY 1")
def frequency_dictionary(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return rollup.frequency_dictionary(docs.select(F.concat_ws("/", "lang", "source").alias("v")), "v")


@query("""
WITH d AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS code FROM orders GROUP BY 1)
SELECT o_orderkey, code::INTEGER AS priority_code FROM orders JOIN d ON v = o_orderpriority""")
def dictionary_encode_rows(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", "o_orderpriority")
    return rollup.encode(rows, "o_orderpriority", rollup.frequency_dictionary(rows, "o_orderpriority"), "priority_code").select("o_orderkey", "priority_code")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def dictionary_round_trip(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", "o_orderpriority")
    d = rollup.frequency_dictionary(rows, "o_orderpriority")
    coded = rollup.encode(rows, "o_orderpriority", d, "c").select("o_orderkey", "c")
    return rollup.decode(coded, "c", d, "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("""
WITH d AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS code FROM events GROUP BY 1)
SELECT user_id, bit_or(1::BIGINT << code::BIGINT) AS mask, count(DISTINCT code)::INTEGER AS n_types FROM events JOIN d USING (event_type) GROUP BY 1""")
def source_bitmask(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    rows = events.select("user_id", "event_type")
    coded = rollup.encode(rows, "event_type", rollup.frequency_dictionary(rows, "event_type"), "code")
    return rollup.mask_codes(rollup.source_mask(coded, "user_id", "code")).select("user_id", "mask", F.size("codes").alias("n_types"))


@query("""
WITH i AS (SELECT DISTINCT sha1(text) AS h FROM documents),
l AS (SELECT n FROM generate_series(1, 40) t(n))
SELECT greatest(8, min(n))::INTEGER AS prefix_length FROM (SELECT n FROM l CROSS JOIN i GROUP BY n HAVING count(DISTINCT left(h, n)) = count(*))""")
def shortest_unique_prefix(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return rollup.shortest_prefix(docs.select(F.sha1("text").alias("h")), "h", 8, 40)


@query("""
WITH t AS (SELECT trim(regexp_replace(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, url FROM pages)
SELECT host, title, count(DISTINCT url) AS n_urls FROM t GROUP BY 1, 2 HAVING count(DISTINCT url) >= 2""")
def site_name_titles(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1), r"\s+", " "))
    return pages.groupBy(url_host(F.col("url")).alias("host"), title.alias("title")).agg(F.count_distinct("url").alias("n_urls")).where("n_urls >= 2")


@query("""
WITH h AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages),
p AS (SELECT string_split(regexp_replace(host, '^www\\.', ''), '.') AS l FROM h)
SELECT array_to_string(l[greatest(1, len(l) - (CASE WHEN len(l) > 2 AND len(l[-1]) = 2 AND l[-2] IN ('ac','co','com','edu','go','gov','ne','net','or','org') THEN 3 ELSE 2 END) + 1):], '.') AS domain, count(*) AS n FROM p GROUP BY 1""")
def publisher_domains(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    return pages.groupBy(registrable_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH n AS (SELECT p_brand AS brand, p_partkey AS rec, lower(replace(p_name, ' ', '')) AS key, p_name AS spelling, p_size <= 10 AS prim FROM part),
k AS (SELECT brand, key, count(DISTINCT rec) FILTER (prim) AS kp, count(DISTINCT rec) AS kc FROM n GROUP BY 1, 2),
s AS (SELECT brand, key, spelling, count(*) FILTER (prim) AS sp, count(*) AS su FROM n GROUP BY 1, 2, 3)
SELECT brand, spelling AS display_name FROM (SELECT brand, spelling, row_number() OVER (PARTITION BY brand ORDER BY kp DESC, kc DESC, key, sp DESC, su DESC, spelling) AS r FROM s JOIN k USING (brand, key)) WHERE r = 1""")
def alias_rollup_ranked(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    names = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("record"), F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("key"), F.col("p_name").alias("spelling"), (F.col("p_size") <= 10).alias("is_primary"))
    return rollup.display_names(names, "brand", F.lit(0))


@query("""
WITH s AS (SELECT p_brand AS brand, p_type AS spelling, array_sort(array_agg(DISTINCT p_size)) AS sz FROM part GROUP BY 1, 2),
d AS (SELECT p_brand AS brand, min(p_type) AS shown FROM part GROUP BY 1)
SELECT brand, spelling, len(sz)::INTEGER AS n_sources, row_number() OVER (PARTITION BY brand ORDER BY (spelling <> shown)::INTEGER, len(sz) DESC, spelling)::INTEGER AS rank FROM s JOIN d USING (brand)""")
def aliases_with_sources(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    names = part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("spelling"), F.col("p_size").alias("source"))
    display = names.groupBy("brand").agg(F.min("spelling").alias("display_name"))
    return rollup.alias_rollup(names, "brand", display).select("brand", "spelling", F.size("sources").alias("n_sources"), "rank")


@query("""
WITH p AS (SELECT upper(p_type) AS key, CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS sp, count(*) AS c FROM part GROUP BY 1, 2)
SELECT key, arg_min(sp, (-c, sp)) AS spelling, sum(c)::BIGINT AS n FROM p GROUP BY 1""")
def merged_unresolved_spellings(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    rows = part.select(F.when(F.col("p_size") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")).alias("spelling"), F.lit(1).cast("long").alias("c"))
    return rollup.merged_spellings(rows, F.upper("spelling"), "spelling", "c")


@query("SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY 1")
def collected_sets(spark, sf_dir):
    (items,) = load(spark, sf_dir, "lineitem")
    sets = rollup.collected(items.select("l_partkey", F.col("l_suppkey").cast("string").alias("s")), "l_partkey", "s", "suppliers")
    return sets.withColumn("suppliers", F.array_join("suppliers", ","))


@query()
def stratified_round_robin(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return topk.round_robin(docs.select("lang", "source", "doc_id"), "lang", "source", ["doc_id"], 4, 60)


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id)::BIGINT - 1 AS place FROM documents")
def global_positions(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return topk.ranked_globally(docs.select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", F.col("place").cast("long").alias("place"))
