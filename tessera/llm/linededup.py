"""Line dedup by site-relative frequency.

A line of a page is boilerplate of its host if the share of the host's pages that contain it exceeds RATIO and at least
MIN_PAGES pages do. A host has at most (mean lines a page) / RATIO such lines, so each host's set is a short array that is
joined to its pages; the counting shuffles only line digests, added up before the shuffle.

Defined results. Null or unreadable URL: no host, nothing is dropped. Null or empty HTML: no lines, empty text. A line that
a page repeats counts once for that page. Repeated rows count as pages of their own. A line at the ratio exactly stays. Empty table: empty result. Pages of any
length are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

RATIO, MIN_PAGES, SALTS = 0.2, 3, 64
# What has no visible text, and tags that end a line.
HIDDEN = (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>")
BREAKS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|main|aside|blockquote|pre)\b[^>]*>"


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(found, F.lit(""))


def visible_lines(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), "<[^>]*>", "")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return F.filter(lines, lambda x: x != "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the text of the lines that stay."""
    # Pages are parsed once; what counts the lines and what drops them read the parsed table.
    rows = materialise(pages.select("page_id", host(F.col("url")).alias("host"), visible_lines(F.col("html")).alias("lines")))
    known = rows.where(F.col("host").isNotNull())
    seen = known.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = known.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # A large host's lines and pages are spread over SALTS parts; what is known of the host is sent to each of them.
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = lambda c: F.pmod(c, F.lit(SALTS)).cast("int").alias("salt")
    common = counts.select("*", salt(F.col("line"))).join(totals.select("host", "pages", parts), ["host", "salt"]).where(F.col("n") > ratio * F.col("pages"))
    sets = common.groupBy("host").agg(F.collect_list("line").alias("common")).select("host", "common", parts)
    out = rows.select("*", salt(F.xxhash64("page_id"))).join(sets, ["host", "salt"], "left")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("common"), F.xxhash64(x)), F.lit(False)))
    out = out.withColumn("kept", kept)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
