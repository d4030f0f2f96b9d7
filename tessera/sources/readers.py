"""Readers of the source formats. Each takes a path (any that Spark reads) and returns DataFrames; rows that a format's
rules refuse are counted by count_refused(), never dropped unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import cell_list, text_or_list
from tessera.functions.dates import mail_date
from tessera.functions.text import alias_pairs, find_cves, find_techniques, is_http_url, strip_tags, tidy, title_clusters, unescape_html, url_key
from tessera.operators.dedupe import first_wins

# --- graph bundles (JSON objects and relationships) --------------------------------------------------------------------

_OBJECT = (
    "id: STRING, type: STRING, name: STRING, revoked: BOOLEAN, x_mitre_deprecated: BOOLEAN, aliases: ARRAY<STRING>, labels: ARRAY<STRING>, first_seen: STRING, last_seen: STRING, "
    "source_ref: STRING, target_ref: STRING, relationship_type: STRING, external_references: ARRAY<STRUCT<source_name: STRING, external_id: STRING, url: STRING>>"
)


def graph_bundle(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Live objects (the first file that has an id wins) and relationships between live objects."""
    schema = f"objects ARRAY<STRUCT<{_OBJECT}>>"
    files = None
    for k, path in enumerate(paths):
        one = spark.read.schema(schema).json(path, multiLine=True).select(F.lit(k).alias("file"), F.explode("objects").alias("o")).select("file", "o.*")
        files = one if files is None else files.unionByName(one)
    merged = first_wins(files, ["id"], [F.col("file"), F.col("name")]).drop("file")
    live = merged.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    objects = live.where("type <> 'relationship'")
    ends = objects.select("id")
    rels = live.where("type = 'relationship'")
    for end in ("source_ref", "target_ref"):
        rels = rels.join(ends.withColumnRenamed("id", end), end, "left_semi")
    return objects, rels.select("id", "relationship_type", "source_ref", "target_ref", "external_references")


def own_id(references: Column, pattern: str) -> Column:
    """The object's own number in its catalogue."""
    return F.get(F.filter(F.transform(references, lambda r: r["external_id"]), lambda x: x.rlike(pattern)), F.lit(0))


def foreign_urls(references: Column, own_source: str) -> Column:
    return F.filter(F.transform(F.filter(references, lambda r: r["source_name"] != own_source), lambda r: r["url"]), lambda u: u.isNotNull())


def graph_actors(objects: DataFrame, rels: DataFrame, own_source: str) -> DataFrame:
    """Groups with what they use: sorted software names and technique numbers, and all cited addresses."""
    groups = objects.where("type = 'intrusion-set'")
    other = objects.select(F.col("id").alias("target_ref"), F.col("type").alias("t"), F.col("name").alias("t_name"), own_id(F.col("external_references"), r"^T\d{4}(\.\d{3})?$").alias("technique"))
    uses = rels.where("relationship_type = 'uses'").join(other, "target_ref")
    gained = uses.groupBy(F.col("source_ref").alias("id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("t").isin("malware", "tool"), F.col("t_name")))).alias("malware"), F.array_sort(F.collect_set(F.when(F.col("t") == "attack-pattern", F.col("technique")))).alias("techniques")
    )
    cited = rels.select(F.explode(F.array("source_ref", "target_ref")).alias("id"), "external_references").unionByName(groups.select("id", "external_references"))
    urls = cited.select("id", F.explode(foreign_urls(F.col("external_references"), own_source)).alias("url")).groupBy("id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    rows = groups.join(gained, "id", "left").join(urls, "id", "left")
    none = F.array().cast("array<string>")
    return rows.select(own_id(F.col("external_references"), r"^G\d{4}$").alias("source_id"), "name", F.array_remove(F.coalesce("aliases", none), F.col("name")).alias("aliases"), F.coalesce("malware", none).alias("malware"), F.coalesce("techniques", none).alias("techniques"), F.coalesce("urls", none).alias("urls"))


def valid_ids(objects: DataFrame, pattern: str) -> DataFrame:
    return objects.select(own_id(F.col("external_references"), pattern).alias("id")).where("id IS NOT NULL").distinct()


# --- JSON clusters, cards and catalogues ------------------------------------------------------------------------------


def name_clusters(spark: SparkSession, path: str, placeholders: tuple[str, ...] = ()) -> DataFrame:
    """Clusters whose meta values may be one text or a list of them."""
    schema = "values ARRAY<STRUCT<uuid: STRING, value: STRING, meta: MAP<STRING, STRING>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("values").alias("v"))
    meta = lambda k: F.filter(F.coalesce(text_or_list(F.col("v.meta")[k]), F.array().cast("array<string>")), lambda x: ~F.lower(x).isin(*(placeholders or ("",))))
    return rows.select(F.col("v.uuid").alias("source_id"), tidy(F.col("v.value")).alias("name"), meta("synonyms").alias("aliases"), meta("country").alias("origin"), meta("cfr-suspected-state-sponsor").alias("sponsor"), meta("cfr-target-category").alias("targets_sectors"))


def name_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards that list names, or give them in one comma-separated field."""
    schema = "values ARRAY<STRUCT<uuid: STRING, actor: STRING, names: ARRAY<STRUCT<name: STRING>>, country: ARRAY<STRING>, motivation: ARRAY<STRING>, `first-seen`: STRING>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("values").alias("v"))
    listed = F.transform("v.names", lambda x: F.trim(x["name"]))
    names = F.when(F.size("v.names") > 0, F.array_distinct(listed)).otherwise(cell_list(F.col("v.actor")))
    return rows.select(F.col("v.uuid").alias("source_id"), F.get(names, F.lit(0)).alias("name"), F.slice(names, 2, 1000).alias("aliases"), F.col("v.country").alias("origin"), F.col("v.motivation").alias("motivation"), F.col("v.first-seen").alias("first_seen"))


def policy_unless(policy: str, licence: Column, expected: str) -> Column:
    """The policy while the stated licence is the expected one, else evidence only."""
    return F.when(licence == expected, policy).otherwise("evidence-only")


def exploited_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Vulnerabilities known to be exploited: valid ids, the first entry of each, the ransomware flag in three states."""
    schema = "vulnerabilities ARRAY<STRUCT<cveID: STRING, vendorProject: STRING, product: STRING, dateAdded: STRING, knownRansomwareCampaignUse: STRING>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("vulnerabilities").alias("at", "v"))
    cve = F.upper(F.trim("v.cveID"))
    flag = F.lower(F.trim("v.knownRansomwareCampaignUse"))
    out = rows.select("at", cve.alias("cve"), F.try_to_date("v.dateAdded").alias("date_added"), F.when(flag == "known", True).when(flag == "unknown", F.lit(None).cast("boolean")).alias("ransomware"), tidy(F.col("v.vendorProject")).alias("vendor"), tidy(F.col("v.product")).alias("product"))
    return first_wins(out.where(F.col("cve").rlike(r"^CVE-\d{4}-\d{4,}$")), ["cve"], [F.col("at")]).drop("at")


def score_file(spark: SparkSession, path: str) -> DataFrame:
    """A (gzipped) CSV of cve, score and percentile below a comment line; rows out of range are refused."""
    rows = spark.read.csv(path, header=True, comment="#", schema="cve STRING, epss STRING, percentile STRING")
    score, share = F.expr("try_cast(epss AS DOUBLE)"), F.expr("try_cast(percentile AS DOUBLE)")
    ok = F.upper(F.trim("cve")).rlike(r"^CVE-\d{4}-\d{4,}$") & score.between(0, 1) & share.between(0, 1)
    return rows.where(ok).select(F.upper(F.trim("cve")).alias("cve"), score.alias("epss"), share.alias("epss_percentile"))


def name_table(spark: SparkSession, path: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """A naming table in JSON with comma-separated cells; entries of the kinds listed are left out."""
    schema = "`Threat actor name` STRING, `Origin/Threat` STRING, `Other names` STRING"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    name = tidy(F.col("Threat actor name"))
    parts = cell_list(F.col("Other names"))
    aliases = F.filter(parts, lambda x: F.lower(x) != F.lower(name))
    return rows.where(name.isNotNull()).select(name.alias("name"), F.filter(cell_list(F.col("Origin/Threat")), lambda x: ~F.lower(x).isin(*(kinds or ("",)))).alias("origin"), aliases.alias("aliases"))


# --- line-oriented text ----------------------------------------------------------------------------------------------------


def refused_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, refused lines) of newline-delimited JSON."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", f"{schema}, __bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    ok = F.col("r").isNotNull() & F.col("r.__bad").isNull()
    return parsed.where(ok).select("r.*").drop("__bad"), parsed.where(~ok).select("value")


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    """(entry, field, value) of BibTeX files with one field per line: entry lines open a group, field lines belong to the last one."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    entry = F.nullif(F.regexp_extract("line", r"^\s*@\w+\s*\{\s*([^,\s]+)\s*,", 1), F.lit(""))
    field = F.lower(F.regexp_extract("line", r"^\s*([A-Za-z]+)\s*=", 1))
    value = F.regexp_replace(F.trim(F.regexp_extract("line", r"^\s*[A-Za-z]+\s*=\s*(.*?)\s*,?\s*$", 1)), r'^[{"]+|[}"]+$', "")
    w = Window.partitionBy("file").orderBy("at")
    named = lines.select("file", "at", F.last(entry, ignorenulls=True).over(w).alias("entry"), field.alias("field"), value.alias("value"))
    return named.where("entry IS NOT NULL AND field <> ''").select("entry", "field", "value")


def library_dates(entries: DataFrame) -> DataFrame:
    """The earliest full date of each address in a bibliography."""
    wide = entries.groupBy("entry").pivot("field", ["url", "date"]).agg(F.first("value"))
    day = F.try_to_date("date", "yyyy-MM-dd")
    return wide.where(F.col("url").isNotNull() & day.isNotNull()).groupBy(url_key(F.col("url")).alias("url_key")).agg(F.min(day).alias("day"))


def linked_names(families: DataFrame, most: int = 3) -> DataFrame:
    """(url_key, names): the actors a page is about, by families (urls, attribution) attributed to few enough actors."""
    few = families.where(F.size("attribution").between(1, most))
    pairs = few.select(F.explode("urls").alias("url"), "attribution").select(url_key(F.col("url")).alias("url_key"), F.explode("attribution").alias("name"))
    return pairs.groupBy("url_key").agg(F.array_sort(F.collect_set("name")).alias("names"))


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link and day; items without title or web address are refused."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title STRING, link STRING, pubDate STRING, description STRING, guid STRING").load(path)
    out = rows.select(tidy(unescape_html(strip_tags(F.coalesce("title", F.lit(""))))).alias("title"), F.trim("link").alias("url"), mail_date(F.col("pubDate")).alias("published"), tidy(unescape_html(strip_tags(F.coalesce("description", F.lit(""))))).alias("body"))
    return out.where(F.col("title").isNotNull() & is_http_url(F.col("url")))


def feed_reports(items: DataFrame, source: str, path_prefix: str = "", issuers: dict[str, str] | None = None) -> DataFrame:
    """Items of a feed as report records with ids taken from their address, the first of each."""
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    found = find_cves(F.concat_ws(" ", "title", "body"))
    rows = items.where(path.startswith(path_prefix)).select(F.lit(source).alias("source"), F.regexp_replace(url_key(F.col("url")), r"[^a-z0-9]+", "-").alias("source_id"), "title", F.col("published"), "url", found.alias("cves"), find_techniques(F.concat_ws(" ", "title", "body")).alias("techniques"), title_clusters(F.col("title"), F.lit(source), issuers or {"NONE": ""}).alias("clusters"), alias_pairs("body").alias("pairs"))
    return first_wins(rows, ["source_id"], [F.coalesce("published", F.lit("9999-12-31").cast("date")), F.col("url")])


def quoted_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV whose quoted cells may span lines; missing columns stop the read."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    lost = [c for c in required if c not in rows.columns]
    if lost:
        raise ValueError("missing columns: " + ", ".join(lost))
    return rows


def markdown_policies(spark: SparkSession, path: str) -> DataFrame:
    """(source, policy) of a Markdown table whose first cell names the source and whose last states the policy."""
    lines = spark.read.text(path).where(F.trim("value").startswith("|"))
    cells = F.transform(F.split("value", r"(?<!\\)\|"), lambda x: F.trim(F.regexp_replace(x, r"[`*]", "")))
    rows = lines.select(F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0))).alias("c")).where(F.size("c") >= 2)
    policy = F.lower(F.element_at("c", -1))
    return rows.where(policy.isin("full", "derived-only", "evidence-only")).select(F.get("c", F.lit(0)).alias("source"), policy.alias("policy"))


def policy_of(catalogue: DataFrame, policies: DataFrame) -> DataFrame:
    """Each source's policy; one without a row may only serve as evidence."""
    return catalogue.join(policies, "source", "left").withColumn("policy", F.coalesce("policy", F.lit("evidence-only")))


def labelled_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="name STRING, label STRING, status STRING, prefill_basis STRING")


def scalar_match(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The first group of a pattern in a whole text file."""
    row = spark.read.text(path, wholetext=True).select(F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).alias("m")).where("m IS NOT NULL").agg(F.min("m")).first()
    return row[0]


def names_not_listed(rows: DataFrame, cell: str, known: DataFrame, name: str) -> DataFrame:
    """Names in a multi-valued cell that the known list lacks, whatever the case, in that order."""
    every = rows.select(F.explode(cell_list(F.col(cell), ";|,")).alias("name")).distinct()
    listed = known.select(F.lower(name).alias("__k")).distinct()
    return every.withColumn("__k", F.lower("name")).join(listed, "__k", "left_anti").orderBy("__k", "name").select("name")


# --- dated snapshots --------------------------------------------------------------------------------------------------------


def latest_snapshots(spark: SparkSession, root: str, source: str) -> DataFrame:
    """(file, day, path, bytes) of the newest copy of each file below <root>/<source>/<day>/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{source}").select("path", "length")
    at = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/([^/]+)$", 1)
    named = files.select("path", F.col("length").alias("bytes"), at.alias("day"), F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/([^/]+)$", 2).alias("file")).where("day <> ''")
    return named.groupBy("file").agg(F.max_by(F.struct("day", "path", "bytes"), "day").alias("l")).select("file", "l.*")


def may_replace(previous_bytes: int | None, new_bytes: int, least_share: float = 0.5) -> bool:
    """Whether a new snapshot is not suspiciously smaller than the last."""
    return previous_bytes is None or new_bytes >= previous_bytes * least_share
