"""Publishers, link kinds and countries: look-ups against small tables that callers give as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import country_key, host_suffixes, is_http_url, plain_key, search_key, tidy, title_domain
from tessera.operators.match import longest_first, phrase_candidates


def by_host(df: DataFrame, url: str, hosts: DataFrame, name: str) -> DataFrame:
    """df with the value of the longest suffix of the address's host that the table (host, value) lists."""
    parts = df.select(F.col(url).alias("__u")).distinct().select("__u", F.posexplode(host_suffixes(F.col("__u"))).alias("__depth", "host"))
    best = parts.join(hosts, "host").groupBy("__u").agg(F.min_by("value", "__depth").alias(name))
    return df.join(best, df[url] == best["__u"], "left").drop("__u")


def canonical(df: DataFrame, col: str, table: DataFrame, name: str, known_only: bool = False) -> DataFrame:
    """df with the canonical spelling of a publisher, by its plain key; others tidied, or null where only known ones count."""
    spelled = table.select(plain_key(F.col("alias")).alias("__k"), F.col("canonical").alias("__c")).dropDuplicates(["__k"])
    out = df.withColumn("__k", plain_key(F.col(col))).join(spelled, "__k", "left")
    return out.withColumn(name, F.col("__c") if known_only else F.coalesce("__c", tidy(F.col(col)))).drop("__k", "__c")


def named_in_title(title: Column, patterns: list[tuple[str, str]]) -> Column:
    """The publisher of the first pattern that a title matches."""
    return F.coalesce(*[F.when(title.rlike(p), F.lit(v)) for p, v in patterns], F.lit(None).cast("string"))


def title_site(title: Column) -> Column:
    """The address of the site that a title is filed under, if any."""
    return F.concat(F.lit("https://"), title_domain(title))


def first_publisher(feed: Column, in_title: Column, field: Column, host: Column) -> Column:
    """Feeds know their publisher; then the title, the record's field and the host decide."""
    return F.coalesce(feed, in_title, field, host)


def classify_links(df: DataFrame, url: str, kinds: DataFrame, mirrors: dict[str, str] | None = None) -> DataFrame:
    """df with link_kind: invalid, a listed host's kind, a mirror by host and account, or publisher."""
    account = F.lower(F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)", 1))
    host = F.regexp_replace(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), r"^www\.", "")
    out = by_host(df, url, kinds, "__kind")
    mirrored = reduce(lambda a, b: a | b, [(host == h) & (account == a) for h, a in (mirrors or {}).items()], F.lit(False))
    kind = F.when(~is_http_url(F.col(url)), "invalid").when(mirrored, "mirror").otherwise(F.coalesce("__kind", F.lit("publisher")))
    return out.withColumn("link_kind", kind).drop("__kind")


def by_trust(links: Column, ranks: dict[str, int]) -> Column:
    """Links (struct with ok, kind, url) in the order of trust: reachable first, then by rank of kind, then as given."""
    table = F.create_map(*[F.lit(x) for p in ranks.items() for x in p])
    keyed = F.transform(links, lambda x, i: F.struct((~F.coalesce(x["ok"], F.lit(True))).cast("int").alias("a"), F.coalesce(F.try_element_at(table, x["kind"]), F.lit(99)).alias("b"), i.alias("c"), x.alias("link")))
    return F.transform(F.array_sort(keyed), lambda x: x["link"])


def country_codes(df: DataFrame, col: str, countries: DataFrame, name: str) -> DataFrame:
    """df with the two-letter code of a country given as a code or under any name in the table (code, name)."""
    names = countries.select(country_key("name").alias("__k"), F.col("code").alias("__by_name")).dropDuplicates(["__k"])
    codes = countries.select(F.col("code").alias("__t"), F.col("code").alias("__by_code")).distinct()
    out = df.withColumn("__k", country_key(F.col(col))).withColumn("__t", F.upper(F.trim(col))).join(names, "__k", "left").join(codes, "__t", "left")
    return out.withColumn(name, F.coalesce("__by_code", "__by_name")).drop("__k", "__t", "__by_name", "__by_code")


def grounded(df: DataFrame, id_col: str, text: str, predicted: str, phrases: DataFrame) -> DataFrame:
    """df with the predicted values that the text names, by the table (phrase, entity) of names, aliases and demonyms."""
    words = df.select(id_col, F.split(F.trim(search_key(F.col(text))), " ").alias("w"))
    found = longest_first(phrase_candidates(words, id_col, "w", phrases), id_col)
    named = found.groupBy(id_col).agg(F.collect_set("entity").alias("__named"))
    out = df.join(named, id_col, "left")
    return out.withColumn(predicted, F.array_intersect(predicted, F.coalesce("__named", F.array().cast("array<string>")))).drop("__named")
