"""Publishers, links, countries, mentions, calibration and the batch build over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, match, publishers, shapes, stats
from tessera.plans import build
from tessera.plans.registry import query
from tessera.session import load
from tessera.sources import schemas
from tessera.streaming.windows import sliding_counts


def _hosts(pages):
    """Registrable domains that several pages share, as a table of publishers."""
    domains = pages.select(T.registrable_domain(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return domains.select("host", F.upper(F.split("host", r"\.")[0]).alias("value"))


_HOSTS = """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages),
l AS (SELECT page_id, host, string_split(host, '.') AS l FROM h),
d AS (SELECT array_to_string(l[-2:], '.') AS host FROM l), t AS (SELECT host, upper(split_part(host, '.', 1)) AS value FROM d GROUP BY 1 HAVING count(*) >= 5)
"""


@query(_HOSTS + "SELECT page_id, value AS publisher FROM l LEFT JOIN t ON t.host = array_to_string(l.l[-2:], '.')")
def publisher_by_host(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    return publishers.by_host(pages.select("page_id", "url"), "url", _hosts(pages), "publisher").select("page_id", "publisher")


@query(_HOSTS + "SELECT coalesce(lower(value), 'publisher') AS link_kind, count(*) AS n FROM l LEFT JOIN t ON t.host = array_to_string(l.l[-2:], '.') GROUP BY 1")
def link_kinds(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    kinds = _hosts(pages).withColumn("value", F.lower("value"))
    return publishers.classify_links(pages.select("page_id", "url"), "url", kinds).groupBy("link_kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN 'feed' END, CASE WHEN regexp_matches(p_type, '^PROMO') THEN 'promo' WHEN contains(p_type, 'STEEL') THEN 'steel' END, CASE WHEN p_size % 3 = 0 THEN p_brand END, 'host') AS publisher FROM part""")
def publisher_precedence(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    in_title = publishers.named_in_title(F.col("p_type"), [("^PROMO", "promo"), ("STEEL", "steel")])
    picked = publishers.first_publisher(F.when(F.col("p_size") % 2 == 0, "feed"), in_title, F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.lit("host"))
    return part.select("p_partkey", picked.alias("publisher"))


@query("""
WITH s AS (SELECT lower(replace(p_type, ' ', '')) AS k, min(p_type) AS c FROM part GROUP BY 1)
SELECT p_partkey, c AS publisher FROM part JOIN s ON lower(replace(p_type, ' ', '')) = k""")
def canonical_spellings(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    table = part.groupBy(T.plain_key(F.col("p_type")).alias("alias")).agg(F.min("p_type").alias("canonical"))
    return publishers.canonical(part.select("p_partkey", F.upper("p_type").alias("t")), "t", table, "publisher").select("p_partkey", "publisher")


@query("SELECT n_nationkey, CASE WHEN n_regionkey <> 3 THEN chr((65 + n_nationkey)::INTEGER) || 'X' END AS code FROM nation")
def country_codes(spark, sf_dir):
    (nation,) = load(spark, sf_dir, "nation")
    code = F.concat(F.char(F.lit(65) + F.col("n_nationkey")), F.lit("X"))
    table = nation.where("n_regionkey <> 3").select(code.alias("code"), F.col("n_name").alias("name"))
    seen = nation.select("n_nationkey", F.concat(F.lit("the "), F.initcap("n_name"), F.lit(".")).alias("given"))
    return publishers.country_codes(seen, "given", table, "code").select("n_nationkey", "code")


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS phrase, generate_subscripts(w, 1) - 1 AS pos FROM d),
c AS (SELECT doc_id, phrase, count(*) AS n, min(pos)::INTEGER AS first_at FROM x GROUP BY 1, 2)
SELECT doc_id, phrase, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at, phrase) AS rank FROM c) WHERE rank <= 3""")
def top_mentions(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.posexplode(T.ascii_tokens(F.col("text"))).alias("at", "phrase"))
    counts = words.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    return match.top_mentions(counts, "doc_id", 3).select("doc_id", "phrase", "n", "rank")


@query("""
WITH b AS (SELECT least(floor(value / 200 * 5), 4)::INTEGER AS bin, count(*) AS n, count(*) FILTER (event_type = 'click') AS n_right, avg(value / 200) AS mean_p FROM events GROUP BY 1),
s AS (SELECT bin, n, n_right, (n_right + 4 * mean_p) / (n + 4) AS share FROM b)
SELECT bin, n, n_right, max(share) OVER (ORDER BY bin) AS calibrated FROM s""")
def monotone_calibration(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    bins = stats.calibration_bins(events.withColumn("p", F.col("value") / 200), "p", F.col("event_type") == "click")
    return bins.select("bin", "n", "n_right", "calibrated")


@query("""
SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS window_start, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1""")
def sliding_windows(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    return sliding_counts(events, "ts", "12 hours", "6 hours").select("window_start", "n")


@query("""
SELECT source, count(*) AS n, count(toxic) AS n_known, count(*) FILTER (toxic = 1) AS n_yes, count(*) FILTER (toxic = 0) AS n_no, count(*) - count(toxic) AS n_unknown FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def three_state_counts(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents", "labels")
    flag = F.col("toxic") == 1
    rows = docs.select("doc_id", "source").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(flag).alias("n_known"), F.count_if(flag).alias("n_yes"), F.count_if(~flag).alias("n_no"), F.count_if(flag.isNull()).alias("n_unknown"))


@query(r"""
WITH n AS (SELECT c_custkey, c_nationkey, 'Land' || translate(c_nationkey::VARCHAR, '0123456789', 'abcdefghij') AS who FROM customer),
s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(who) || 'panda' WHEN 1 THEN 'uta' || (200 + c_nationkey) WHEN 2 THEN 'new' || lower(who) ELSE 'zor' || lower(who) END AS key,
CASE c_custkey % 4 WHEN 0 THEN 'suffix' WHEN 1 THEN 'id' WHEN 2 THEN 'malware' ELSE 'camel' END AS shape,
CASE c_custkey % 4 WHEN 0 THEN who || ' Panda' WHEN 1 THEN 'UTA-' || (200 + c_nationkey) WHEN 2 THEN 'New ' || who ELSE 'Zor' || who END AS spelling FROM n),
k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS key FROM benchmark)
SELECT key, count(DISTINCT c_custkey) AS n_titles, max(shape) AS shapes, max(spelling) AS spelling FROM s WHERE key NOT IN (SELECT key FROM k) GROUP BY 1 HAVING count(DISTINCT c_custkey) >= 2""")
def title_name_shapes(spark, sf_dir):
    """Names in titles made of customers' nation numbers: before an animal, as a label, before a kind of malware, in camel case."""
    customer, bench = load(spark, sf_dir, "customer", "benchmark")
    who = F.concat(F.lit("Land"), F.translate(F.col("c_nationkey").cast("string"), "0123456789", "abcdefghij"))
    said = [
        F.concat(F.lit("the return of "), who, F.lit(" Panda")),
        F.concat(F.lit("more on UTA "), (F.col("c_nationkey") + 200).cast("string")),
        F.concat(F.lit("inside New "), who, F.lit(" Stealer today")),
        F.concat(F.lit("what a Zor"), who, F.lit(" does")),
    ]
    titles = customer.select("c_custkey", F.get(F.array(*said), (F.col("c_custkey") % 4).cast("int")).alias("title"))
    known = bench.select(F.explode(T.ascii_tokens(F.col("text"))).alias("key"))
    return shapes.repeated_names(shapes.name_shapes(titles, "c_custkey", "title"), "c_custkey", known, 2).withColumn("shapes", F.array_join("shapes", ","))


def _actor_records(spark, sf_dir):
    """Parts as actor records: their brand is the source, their name and type are names, some stand for anchors."""
    (part,) = load(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    anchor = F.col("p_partkey") % 40 == 0
    rows = part.select(
        F.when(anchor, "attack").otherwise(F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("source"),
        F.when(anchor, F.concat(F.lit("G"), F.lpad(F.col("p_partkey").cast("string"), 4, "0"))).otherwise(F.col("p_partkey").cast("string")).alias("source_id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey") % 37).alias("name"),
        F.array(F.concat_ws(" ", "p_name", F.col("p_partkey") % 11)).alias("aliases"),
        F.array("p_type").alias("origin"), none.alias("sponsor"), none.alias("motivation"), none.alias("targets_countries"), none.alias("targets_sectors"), none.alias("first_seen"), none.alias("malware"), none.alias("techniques"), F.lit("2026-01-01").alias("retrieved_at"),
    )
    return rows.to(spark.createDataFrame([], schemas.ACTORS).schema)


@query()
def resolved_entities(spark, sf_dir):
    r = build.resolve(_actor_records(spark, sf_dir))
    sizes = r.members.groupBy("component").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("source").alias("n_sources"))
    return sizes.join(r.display, "component", "left")


@query("""
WITH RECURSIVE r AS (SELECT doc_id, source || ':' || doc_id AS rid, sha1(text) AS s FROM documents), h AS (SELECT s, min(rid) AS hub FROM r GROUP BY 1)
SELECT rid, hub AS cluster FROM r JOIN h USING (s)""")
def report_clusters(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    rows = docs.select("source", F.col("doc_id").cast("string").alias("source_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("published"), F.lit(None).cast("string").alias("url"), F.sha1("text").alias("sha1"))
    return build.cluster_reports(rows).select("rid", "cluster")


@query("""
WITH k AS (SELECT p_type AS key, p_partkey AS node, p_size = 1 AS anchor FROM part) SELECT key, arg_min(node, node) AS component FROM k WHERE anchor GROUP BY 1 HAVING count(*) = 1""")
def keys_of_one_anchor(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    carriers = part.select(F.col("p_type").alias("key"), F.col("p_partkey").alias("node"), (F.col("p_size") == 1).alias("anchor"))
    comps = carriers.select("node", F.col("node").alias("component"))
    refused = carriers.select("key").distinct()
    return graph.resolve_keys(carriers, comps, refused)
