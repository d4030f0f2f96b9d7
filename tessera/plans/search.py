"""The search surface over documents: one query for each predicate and the combined ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import facets
from tessera.operators.facets import Filters
from tessera.plans.registry import query
from tessera.session import load

_ROWS = """
WITH r AS (SELECT o_orderkey AS id, o_orderdate::DATE AS s, (SELECT max(l_shipdate)::DATE FROM lineitem WHERE l_orderkey = o_orderkey) AS e, o_orderpriority AS org, o_orderstatus AS st,
 (SELECT list(DISTINCT 'P' || l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS parts, (SELECT list(DISTINCT l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS flags,
 ' ' || trim(regexp_replace(lower(o_orderpriority || ' ' || o_orderstatus), '[^a-z0-9]+', ' ', 'g')) AS hay FROM orders)
"""


def index_rows(spark, sf_dir) -> DataFrame:
    """Orders as rows of a searchable index: parts stand for technique-like ids, flags for sources."""
    orders, items = load(spark, sf_dir, "orders", "lineitem")
    per = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("end"), F.collect_set(F.concat(F.lit("P"), "l_partkey")).alias("techniques"), F.collect_set("l_returnflag").alias("sources"))
    rows = orders.join(per, "o_orderkey", "left")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("start"),
        "end",
        F.col("o_orderpriority").alias("organisation"),
        F.array(F.col("o_custkey").cast("string")).alias("actors"),
        "sources",
        "techniques",
        F.array().cast("array<string>").alias("cves"),
        (F.col("o_orderstatus") == "F").alias("kev"),
        facets.haystack(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("haystack"),
    )


def _explore(spark, sf_dir, **asked) -> DataFrame:
    return facets.explore(index_rows(spark, sf_dir), Filters(**asked)).select("id")


@query(_ROWS + "SELECT id FROM r WHERE st <> 'P'")
def explore_dated(spark, sf_dir):
    return _explore(spark, sf_dir)


@query(_ROWS + "SELECT id FROM r WHERE st <> 'P' AND (e IS NULL OR e >= DATE '1997-03-01') AND s <= DATE '1997-05-31'")
def interval_overlap_filter(spark, sf_dir):
    return _explore(spark, sf_dir, since="1997-03-01", until="1997-05-31")


@query(_ROWS + "SELECT id FROM r WHERE st <> 'P' AND list_contains(flags, 'R')")
def explore_source(spark, sf_dir):
    return _explore(spark, sf_dir, source="R")


@query(_ROWS + "SELECT id FROM r WHERE st <> 'P' AND org = '1-URGENT'")
def explore_organisation(spark, sf_dir):
    return _explore(spark, sf_dir, organisation="1-URGENT")


@query(_ROWS + "SELECT id FROM r WHERE st <> 'P' AND len(list_filter(parts, lambda x: starts_with(x, 'P12'))) > 0")
def explore_prefix(spark, sf_dir):
    return _explore(spark, sf_dir, technique="p12")


@query(_ROWS + "SELECT id FROM r WHERE contains(hay, ' urg') AND contains(hay, ' f')")
def explore_words(spark, sf_dir):
    return _explore(spark, sf_dir, words="Urg, F", undated=True)


@query(_ROWS + "SELECT id FROM r WHERE st <> 'P' AND st = 'F' AND list_contains(flags, 'N') AND (e IS NULL OR e >= DATE '1996-01-01') AND contains(hay, ' high')")
def explore_filters(spark, sf_dir):
    return facets.explore(index_rows(spark, sf_dir), Filters.parse("kev=1&source=N&since=1996-01-01&until=bad&words=high")).select("id")


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def facet_counts(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    one = lambda c: facets.facet(docs, c).select(F.lit(c).alias("facet"), "value", "n")
    return one("lang").unionByName(one("source"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, lower(source), doc_id LIMIT 25 OFFSET 50")
def paged_slice(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return facets.page(facets.newest_first(docs.select("doc_id", "n_chars", "source"), "n_chars", "source", "doc_id"), 3, 25).select("doc_id", "n_chars")


@query("SELECT v AS lang, (SELECT count(*) FROM documents WHERE lang = v) AS n FROM (VALUES ('en'), ('de'), ('xx')) t(v)")
def counts_for_keys(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return facets.counts_for(docs, "lang", ["en", "de", "xx"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), 'ed')")
def search_names(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    rows = part.withColumn("aliases", F.array().cast("array<string>"))
    return facets.search_names(rows, "p_name", "aliases", "ED").select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE doc_id IN (7, 3, 11)")
def pick_by_ids(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return facets.pick(docs.select("doc_id"), "doc_id", [7, 3, 11, -1])[0]


@query("SELECT doc_id FROM (SELECT doc_id, sha1(text) AS h FROM documents) WHERE starts_with(h, left((SELECT min(sha1(text)) FROM documents), 12))")
def lookup_by_prefix(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.sha1("text").alias("h"))
    prefix = rows.agg(F.left(F.min("h"), F.lit(12))).first()[0]
    return facets.by_prefix(rows, "h", prefix).select("doc_id")


@query("""
SELECT 'report' AS kind, o_orderkey AS id, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'campaign', c_custkey, NULL FROM customer WHERE c_acctbal < 0""")
def merged_row_list(spark, sf_dir):
    orders, customer = load(spark, sf_dir, "orders", "customer")
    reports = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    campaigns = customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return facets.union_rows(reports, campaigns).select("kind", "id", "day")
