"""URLs, titles, identifiers, phrases and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.arrays import ngrams
from tessera.functions.dates import ranked_date
from tessera.operators import match
from tessera.plans.registry import query
from tessera.session import load


@query("""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\\-]*://', ''), '^www\\.', ''), '/+$', '') AS url_key,
lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages""")
def url_key_host(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    return pages.select("page_id", T.url_key(F.col("url")).alias("url_key"), T.url_host(F.col("url")).alias("host"))


@query()
def url_title_guess(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    return pages.select("page_id", T.title_from_url(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/"), F.regexp_replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), " ", "-"))).alias("title"))


@query("""
WITH t AS (SELECT lower(trim(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '[^a-zA-Z0-9]+', ' ', 'g'), ' +', ' ', 'g'))) AS title_key FROM documents)
SELECT title_key, count(*) AS n FROM t WHERE title_key <> '' GROUP BY 1 HAVING count(*) > 1""")
def title_dedupe_key_groups(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    first = F.split("text", "\n", 2)[0]
    key = F.lower(F.trim(F.regexp_replace(first, "[^a-zA-Z0-9]+", " ")))
    return docs.groupBy(key.alias("title_key")).agg(F.count(F.lit(1)).alias("n")).where("title_key <> '' AND n > 1")


@query()
def clean_titles(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    title = F.split("text", "\n", 2)[0]
    return docs.select("doc_id", T.clean_title(title).alias("title"), T.title_key(title).alias("title_key"), T.is_readable_title(title).alias("readable"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9a-f]{40}'))), ',') AS digests,
array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9]+\\.[a-z.]+[a-z]'))), ',') AS mails,
array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}'))), ',') AS addresses
FROM documents WHERE regexp_matches(text, '[0-9]')""")
def id_extraction(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    found = lambda pattern: F.array_join(T.sorted_unique(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), ",")
    return docs.where(F.col("text").rlike("[0-9]")).select("doc_id", found("[0-9a-f]{40}").alias("digests"), found(r"[a-z0-9.]+@[a-z0-9]+\.[a-z.]+[a-z]").alias("mails"), found(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}").alias("addresses"))


# Texts with identifiers, well formed and not, by document number; Spark's pattern looks around a match, the SQL doubles
# every character between words instead.
_SAID = (
    " See CVE-2021-4{n} and T1059.001.",
    " xCVE-2021-44228, T1059.00 and T1059.0015",
    " cve‑2020‑0601 by way of T1566.",
    " CVE-2021-44228abc T1566abc _T1059 _CVE-2021-44228",
    " CVE-2021-1234 cve-2021-1234 CVE-2019-9999,T1001 T1001.002",
)


@query(rf"""
WITH t AS (SELECT doc_id, regexp_replace(translate(text || CASE doc_id % 6 {' '.join(f"WHEN {i} THEN replace('{x}', '{{n}}', lpad((doc_id % 1000)::VARCHAR, 3, '0'))" for i, x in enumerate(_SAID))} ELSE '' END, '‐‑‒–—−', '------'), '([^A-Za-z0-9_])', '\1\1', 'g') AS x FROM documents),
f AS (SELECT doc_id, regexp_extract_all(upper(x), '(?:^|[^A-Z0-9_])(CVE--[0-9]{{4}}--[0-9]{{4,7}})(?:$|[^A-Z0-9_])', 1) AS c,
regexp_extract_all(x, '(?:^|[^A-Za-z0-9_])(T[0-9]{{4}}(?:\.\.[0-9]{{3}})?)(?:$|[^A-Za-z0-9_.]|\.\.(?:$|[^0-9]))', 1) AS t FROM t),
o AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(c, lambda y: replace(y, '--', '-')))), ',') AS cves,
array_to_string(list_sort(list_distinct(list_transform(t, lambda y: replace(y, '..', '.')))), ',') AS techniques FROM f)
SELECT * FROM o WHERE cves <> '' OR techniques <> ''""")
def standard_ids(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    said = F.lit("")
    for i, x in enumerate(_SAID):
        said = F.when(F.col("doc_id") % 6 == i, F.replace(F.lit(x), F.lit("{n}"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))).otherwise(said)
    text = F.concat("text", said)
    cves, techs = T.find_cves(text), T.find_techniques(text)
    return docs.select("doc_id", F.array_join(cves, ",").alias("cves"), F.array_join(techs, ",").alias("techniques")).where("cves <> '' OR techniques <> ''")


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query(f"""
WITH w AS (SELECT unnest({_WORDS}) AS token FROM documents) SELECT token, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 20""")
def token_ordinary_words(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    return match.token_counts(docs, T.ascii_tokens(F.col("text")), 20)


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
o AS (SELECT w[i] AS token, doc_id, bool_or(coalesce((i > 1 AND w[i - 1] IN ('the', 'of')) OR w[i + 1] IN ('the', 'of'), false)) AS beside FROM x GROUP BY 1, 2)
SELECT token, count(*) AS n_docs, count(*) FILTER (beside) AS n_context FROM o GROUP BY 1 HAVING count(*) >= 5""")
def context_counts(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    words = docs.select("doc_id", T.ascii_tokens(F.col("text")).alias("w"))
    return match.context_counts(words, "doc_id", "w", ["the", "of"]).where("n_docs >= 5")


@query(f"""
WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS term, doc_id, source, n_chars FROM documents WHERE lang = 'de'),
k AS (SELECT DISTINCT unnest({_WORDS}) AS term FROM documents WHERE lang = 'en')
SELECT term, count(DISTINCT doc_id) AS n_docs, count(DISTINCT source) AS n_publishers, min(n_chars) AS first_day, max(n_chars) AS last_day
FROM w WHERE term NOT IN (SELECT term FROM k) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT source) >= 2""")
def term_mining(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "documents")
    words = docs.select("doc_id", "source", "n_chars", "lang", F.explode(F.array_distinct(T.ascii_tokens(F.col("text")))).alias("term"))
    return match.mine_terms(words.where("lang = 'de'"), "term", "doc_id", "source", "n_chars", words.where("lang = 'en'"))


def _item_runs(bench, n: int):
    """(item_id, phrase): every run of n words of the items."""
    runs = bench.select("item_id", F.explode(ngrams(T.ascii_tokens(F.col("text")), n)).alias("r"))
    return runs.where(F.col("r.n") == n).select("item_id", F.col("r.phrase").alias("phrase"))


def _benchmark_phrases(bench):
    """Runs of three words of the items as phrases; those of even items name nothing and only consume their words."""
    rows = _item_runs(bench, 3).groupBy("phrase").agg(F.min("item_id").alias("i"))
    return rows.select("phrase", F.when(F.col("i") % 2 == 1, F.col("i")).alias("entity"))


@query()
def phrase_mentions(spark, sf_dir):
    docs, bench = load(spark, sf_dir, "documents", "benchmark")
    words = docs.select("doc_id", T.ascii_tokens(F.col("text")).alias("w"))
    return match.phrase_mentions(words, "doc_id", "w", _benchmark_phrases(bench))


@query(f"""
WITH i AS (SELECT {_WORDS} AS w FROM benchmark), b AS (SELECT DISTINCT unnest([array_to_string(w[k:k + 3], ' ') FOR k IN generate_series(1, len(w) - 3)]) AS phrase FROM i),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k + 3], ' ') FOR k IN generate_series(1, len(w) - 3)]) AS phrase FROM d WHERE len(w) > 4)
SELECT doc_id, phrase FROM g JOIN b USING (phrase)""")
def containment_match(spark, sf_dir):
    docs, bench = load(spark, sf_dir, "documents", "benchmark")
    words = docs.select("doc_id", T.ascii_tokens(F.col("text")).alias("w"))
    return match.containment_join(words, "doc_id", "w", _item_runs(bench, 4).select("phrase"), 4)


@query(f"""
WITH d AS (SELECT {_WORDS} AS w FROM benchmark), i AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM d)
SELECT n, count(*) AS n_runs, count(DISTINCT array_to_string(w[i:i + n - 1], ' ')) AS n_distinct FROM i, (VALUES (1), (2), (3), (4), (5)) v(n) WHERE i + n - 1 <= len(w) GROUP BY 1""")
def ngram_counts(spark, sf_dir):
    (bench,) = load(spark, sf_dir, "benchmark")
    runs = bench.select(F.explode(ngrams(T.ascii_tokens(F.col("text")), 5)).alias("r"))
    return runs.groupBy("r.n").agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("r.phrase").alias("n_distinct"))


@query("""
WITH k AS (SELECT DISTINCT lower(replace(p_name, ' ', '')) AS key FROM part),
p AS (SELECT a.key AS left_key, b.key AS right_key, levenshtein(a.key, b.key) AS distance FROM k a JOIN k b ON a.key <> b.key AND abs(length(a.key) - length(b.key)) <= 2
      AND regexp_extract_all(a.key, '[0-9]+') = regexp_extract_all(b.key, '[0-9]+') WHERE length(a.key) >= 5 AND length(b.key) >= 5 AND damerau_levenshtein(a.key, b.key) <= 2)
SELECT left_key, right_key, damerau_levenshtein(left_key, right_key)::INTEGER AS distance FROM p WHERE 1 - damerau_levenshtein(left_key, right_key) / greatest(length(left_key), length(right_key)) >= 0.8""")
def fuzzy_names(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    keys = part.select(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("key"))
    return match.fuzzy_join(keys, keys, "key").select("left_key", "right_key", "distance")


@query()
def name_variants(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    reference = part.select(T.name_key(T.fold_tokens("p_name")).alias("key"), F.col("p_name").alias("target")).distinct()
    names = part.select(F.concat(F.lit("apt "), "p_name", F.lit(" group (alias)")).alias("name")).distinct()
    return match.variant_join(names.withColumn("v", T.spelling_variants(F.col("name"))), "name", "v", reference)


@query("""
SELECT o_orderkey, CASE WHEN ship IS NOT NULL AND ship <= day + 60 THEN ship ELSE day END AS day, CASE WHEN ship IS NOT NULL AND ship <= day + 60 THEN 'title-date' ELSE 'ingest' END AS basis
FROM (SELECT o_orderkey, o_orderdate::DATE + 60 AS day60, o_orderdate::DATE AS day, (SELECT min(l_shipdate)::DATE FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS ship FROM orders)""")
def evidence_ranked_date(spark, sf_dir):
    orders, items = load(spark, sf_dir, "orders", "lineitem")
    ship = items.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("ship"))
    rows = orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")).join(ship, "o_orderkey", "left")
    none = F.lit(None).cast("date")
    # Shipping counts as the title's date, bounded by sixty days after the order as the day of ingest.
    found = ranked_date(none, F.col("ship"), none, none, none, F.date_add("day", 60))
    return rows.withColumn("f", found).select("o_orderkey", F.when(F.col("f.basis") == "ingest", F.col("day")).otherwise(F.col("f.day")).alias("day"), F.col("f.basis").alias("basis"))


@query("""
SELECT page_id, lower(regexp_extract(html, 'lang="([a-z]+)"', 1)) AS lang, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS text_chars FROM pages""")
def html_text(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    return pages.select("page_id", F.lower(F.regexp_extract("html", 'lang="([a-z]+)"', 1)).alias("lang"), F.length(T.strip_tags(F.col("html"))).cast("long").alias("text_chars"))


@query()
def name_signals(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    w = T.fold_tokens("name")
    names = part.select(F.col("p_name").alias("name")).distinct().withColumn("w", w)
    return names.select("name", T.slug("name").alias("slug"), T.cluster_kind(F.col("w")).alias("cluster"), T.name_suffix(F.col("w")).alias("suffix"), T.malware_word(F.col("w")).alias("malware"), T.is_campaign_name(F.col("w")).alias("campaign"), T.is_placeholder_name(F.col("w")).alias("placeholder"), T.script_of("name").alias("script"))


@query("""
WITH n AS (SELECT c_custkey, 'Land' || translate(c_nationkey::VARCHAR, '0123456789', 'abcdefghij') AS who FROM customer)
SELECT c_custkey, who || ' Panda' AS name, 'Storm-' || c_custkey AS alias FROM n WHERE c_custkey % 5 IN (0, 1, 2)
UNION ALL SELECT c_custkey, 'Team ' || who, who || ' Bear' FROM n WHERE c_custkey % 5 = 0""")
def stated_alias_pairs(spark, sf_dir):
    """Pairs stated in sentences made of customers' nation numbers; two names that only overlap are no pair, and a pair counts once."""
    (customer,) = load(spark, sf_dir, "customer")
    who, key = F.concat(F.lit("Land"), F.translate(F.col("c_nationkey").cast("string"), "0123456789", "abcdefghij")), F.col("c_custkey").cast("string")
    said = [
        F.concat(F.lit("The "), who, F.lit(" Panda (also known as Storm-"), key, F.lit(") struck. Storm-"), key, F.lit(", formerly "), who, F.lit(" Panda. While Team "), who, F.lit(", aka “"), who, F.lit(" Bear”")),
        F.concat(F.lit("When "), who, F.lit(" Panda, tracked by  Microsoft as Storm-"), key, F.lit(", came")),
        F.concat(who, F.lit(" Panda; which Cisco Talos tracks as Storm-"), key),
        F.concat(who, F.lit(" Panda, which overlaps with Storm-"), key),
        F.concat(who, F.lit(" Panda, aka CVE-2021-"), key),
    ]
    text = F.get(F.array(*said), (F.col("c_custkey") % 5).cast("int"))
    return customer.select("c_custkey", F.explode(T.alias_pairs(text)).alias("p")).select("c_custkey", "p.name", "p.alias")
