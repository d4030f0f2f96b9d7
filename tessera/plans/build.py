"""The batch build end to end: records of many sources become entities, facts and published tables.

Every step takes and returns DataFrames with the schemas of tessera.sources.schemas; choices follow total orders, so the
same snapshot gives the same tables whatever the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.dates import quarter_label, window_start
from tessera.operators import checks, dedupe, graph, guesses, rollup, series
from tessera.operators import stats as stats_of
from tessera.plans import guessing
from tessera.session import written
from tessera.sources import schemas, sinks

ANCHOR = r"^G\d{4}$"
HISTORICAL = "paper"
MAX_ENTITIES = 15
UNTRUSTED = ("ingest", "capture", "unknown")
CHAIN_DAYS = 14


@dataclass(frozen=True)
class Registry:
    members: DataFrame  # node, component, source, source_id
    keys: DataFrame  # key, component
    refused: DataFrame  # key, candidates
    names: DataFrame  # component, record, key, spelling, is_primary, source
    display: DataFrame  # component, display_name


def node_id(source: Column, source_id: Column, anchor_source: str) -> Column:
    """Records of the anchor source that share a number are one node; all others are nodes of their own."""
    return F.when((source == anchor_source) & source_id.rlike(ANCHOR), source_id).otherwise(F.concat(source, F.lit(":"), source_id))


def record_names(actors: DataFrame, anchor_source: str) -> DataFrame:
    """(node, source, source_id, spelling, key, is_primary): name and aliases, tidied, each once, those without a key left out."""
    values = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), T.tidy))
    rows = actors.select(node_id(F.col("source"), F.col("source_id"), anchor_source).alias("node"), "source", "source_id", T.tidy(F.col("name")).alias("own"), F.explode(F.filter(values, lambda x: x.isNotNull())).alias("spelling"))
    keyed = rows.withColumn("key", T.name_key(T.fold_tokens("spelling"))).where(F.col("key").isNotNull())
    return keyed.select("node", "source", "source_id", "spelling", "key", (F.col("spelling") == F.col("own")).alias("is_primary"))


def resolve(actors: DataFrame, anchor_source: str = "attack") -> Registry:
    names = written(record_names(actors, anchor_source))
    nodes = actors.select(node_id(F.col("source"), F.col("source_id"), anchor_source).alias("node"), "source", "source_id").distinct()
    carriers = names.select("node", "key", "is_primary")
    anchor = F.col("node").rlike(ANCHOR)
    comps, refused = graph.anchored_components(carriers, anchor, F.col("is_primary"))
    comps = written(nodes.select("node").distinct().join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    keys = graph.resolve_keys(carriers.withColumn("anchor", anchor), comps, refused)
    named = names.join(comps, "node").withColumn("record", F.concat_ws(":", "source", "source_id"))
    display = rollup.display_names(named, "component", F.col("node").rlike(ANCHOR).cast("int"))
    return Registry(nodes.join(comps, "node"), keys, refused, named, display)


def resolve_stated(actors: DataFrame, reports: DataFrame, software: DataFrame, pairs: DataFrame | None = None, labels: DataFrame | None = None, issuers: dict[str, str] | None = None) -> tuple[DataFrame, Registry]:
    """Actors and registry with what sources state: pairs of names first, then labels that only their issuer's titles carry.

    Each kind is judged against the registry made without it; its records then merge in a further pass.
    """
    registry = resolve(actors)
    named = written(guessing.software_names(software))
    if pairs is not None:
        k = guessing.known(registry, software, reports, HISTORICAL)
        fitted = guesses.fit(guessing.samples(labels, k, registry.keys)) if labels is not None else None
        predict = (lambda names: guesses.decided(guessing.scored(names, k), fitted[0].weights, fitted[0].kept).select("name", "label")) if fitted else None
        actors, registry = _with(actors, guessing.pair_records(pairs, registry, named, predict), registry)
    if issuers:
        actors, registry = _with(actors, guessing.title_cluster_records(reports, registry, named, issuers), registry)
    return actors, registry


def _with(actors: DataFrame, records: DataFrame, registry: Registry) -> tuple[DataFrame, Registry]:
    found = written(records)
    if found.isEmpty():
        return actors, registry
    empty = {f.name: F.array().cast(f.dataType) for f in found.sparkSession.createDataFrame([], schemas.ACTORS).schema if f.dataType.typeName() == "array"}
    more = found.select("source", "source_id", "name", F.array_compact(F.array("alias")).alias("aliases"), *[c.alias(n) for n, c in empty.items() if n != "aliases"], "retrieved_at")
    both = actors.unionByName(more)
    return both, resolve(both)


def guess_tables(registry: Registry, facts: DataFrame, reports: DataFrame, software: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Guesses at unresolved names and the measurement behind them; nothing where too few names are labelled."""
    k = guessing.known(registry, software, reports, HISTORICAL)
    fitted = guesses.fit(guessing.samples(labels, k, registry.keys))
    if not fitted:
        return {}
    model, predictions = fitted
    unresolved = facts.select(F.explode("unresolved").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    rows = written(guessing.guessed(unresolved, labels, model, k))
    pending = labels.where("status = 'pending'").withColumn("key", guessing.keyed("name"))
    predictions = written(predictions)
    return {"guesses": rows, "guess_bands": guesses.band_report(predictions), "guess_confusion": stats_of.confusion(predictions, "truth", "label"), "guess_agreement": guesses.agreement_with(rows, pending)}


def stats(r: Registry) -> DataFrame:
    counts = r.members.agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("component").alias("n_entities"))
    refused = r.refused.agg(F.count_distinct("key").alias("n_refused"))
    return counts.join(F.broadcast(refused)).withColumn("n_merged", F.col("n_records") - F.col("n_entities"))  # one row each


def cluster_reports(reports: DataFrame) -> DataFrame:
    """(rid, cluster): records joined by id, address or digest, and by equal titles filed within CHAIN_DAYS of each other."""
    rows = reports.withColumn("rid", F.concat_ws(":", "source", "source_id"))
    keys = F.array(F.concat(F.lit("u:"), T.url_key(F.col("url"))), F.concat(F.lit("s:"), F.lower("sha1")), F.concat(F.lit("i:"), "rid"))
    stated = rows.select("rid", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("key"))
    titled = rows.select("rid", T.title_key(F.col("title")).alias("tk"), F.to_date("published").alias("day"), T.url_host(F.col("url")).alias("host"), "url").where("tk IS NOT NULL AND day IS NOT NULL")
    # A title that a site puts on many pages is the site's name, not a report's.
    site_names = titled.groupBy("tk", "host").agg(F.count_distinct("url").alias("n")).where("n >= 4").select("tk", "host")
    own = titled.join(site_names, ["tk", "host"], "left_anti").withColumn("at", F.datediff("day", F.lit("1970-01-01")))
    chained = dedupe.chain_near(own, ["tk"], F.col("at"), F.lit(CHAIN_DAYS), ["rid"])
    by_title = chained.select("rid", F.concat(F.lit("t:"), "tk", F.lit(":"), "chain").alias("key"))
    edges = graph.star_edges(stated.unionByName(by_title), "rid", "key")
    return graph.connected_components(rows, edges, "rid").withColumnRenamed("component", "cluster")


def report_facts(reports: DataFrame, clusters: DataFrame, keys: DataFrame, priorities: dict[str, int], mirrors: tuple[str, ...] = ()) -> DataFrame:
    """One row for each cluster: the best title, date, address and publisher, all ids, and the entities named."""
    order = F.create_map(*[F.lit(x) for p in priorities.items() for x in p]) if priorities else F.create_map(F.lit(""), F.lit(0))
    rows = reports.withColumn("rid", F.concat_ws(":", "source", "source_id")).join(clusters, "rid")
    rows = rows.withColumn("prio", F.coalesce(F.try_element_at(order, F.col("source")), F.lit(99)))
    mirror = F.lit(False)
    for m in mirrors:
        mirror = mirror | T.url_key(F.col("url")).startswith(m)
    day = F.to_date("published")
    facts = rows.groupBy("cluster").agg(
        F.min(F.lower("sha1")).alias("digest"),
        F.min("rid").alias("first_id"),
        F.min_by(T.clean_title(F.col("title")), F.struct(T.clean_title(F.col("title")).isNull(), "prio", "rid")).alias("title"),
        F.min_by(F.struct(day.alias("day"), F.col("date_basis").alias("basis")), F.struct(day.isNull(), F.col("date_basis").isin(*UNTRUSTED), day, "rid")).alias("dated"),
        F.min_by("url", F.struct(F.col("url").isNull(), F.coalesce(mirror, F.lit(True)), "prio", "rid")).alias("url"),
        F.min_by("organisation", F.struct(F.col("organisation").isNull(), "prio", "rid")).alias("organisation"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("rid")).alias("merged_ids"),
        T.sorted_unique(F.flatten(F.collect_set("cves"))).alias("cves"),
        T.sorted_unique(F.flatten(F.collect_set("techniques"))).alias("techniques"),
    )
    named = rows.select("cluster", F.explode("actor_names").alias("name")).withColumn("key", T.name_key(T.fold_tokens("name"))).join(keys, "key", "left")
    linked = named.groupBy("cluster").agg(F.array_sort(F.collect_set("component")).alias("entities"), F.array_sort(F.collect_set(F.when(F.col("component").isNull(), F.col("name")))).alias("unresolved"))
    none = F.array().cast("array<string>")
    out = facts.join(linked, "cluster", "left")
    return out.select(
        F.coalesce("digest", "first_id").alias("id"), "title", F.col("dated.day").alias("published"), F.col("dated.basis").alias("date_basis"), "url", "organisation", "sources", "merged_ids",
        T.possible_cves(F.col("cves"), F.col("dated.day")).alias("cves"), "techniques", F.coalesce("entities", none).alias("entities"), F.coalesce("unresolved", none).alias("unresolved"),
    )


def trend_rows(facts: DataFrame, build_day: str) -> DataFrame:
    """Facts that trends may count: dated on trusted evidence, not from the historical layer alone, and not about too many entities."""
    day = F.lit(build_day).cast("date")
    dated = facts.where(F.col("published").isNotNull() & ~F.col("date_basis").isin(*UNTRUSTED) & (F.col("published") <= day))
    recent = dated.where(F.exists("sources", lambda s: s != HISTORICAL) & (F.size("entities") < MAX_ENTITIES))
    return recent.select("id", F.explode("entities").alias("entity"), "published", "cves", "techniques")


def reporting_activity(facts: DataFrame, build_day: str) -> DataFrame:
    rows = trend_rows(facts, build_day)
    since = F.add_months(window_start(F.lit(build_day).cast("date")), -12)
    out = series.year_over_year(rows, "entity", "published", since)
    return out.where(F.col("quarter") >= quarter_label(window_start(F.lit(build_day).cast("date"))))


def vulnerabilities(listed: DataFrame, scores: DataFrame, facts: DataFrame) -> DataFrame:
    """Listed and cited CVEs with their reports, entities and scores; scores never add a row."""
    cited = facts.select("id", "entities", F.explode("cves").alias("cve")).groupBy("cve").agg(F.count_distinct("id").alias("n_reports"), T.sorted_unique(F.flatten(F.collect_set("entities"))).alias("entities"))
    one = scores.groupBy("cve").agg(F.max(F.struct("epss", "epss_percentile")).alias("s"))
    both = listed.join(cited, "cve", "full").join(one, "cve", "left")
    return both.select("cve", "date_added", "ransomware", "vendor", "product", F.coalesce("n_reports", F.lit(0)).alias("n_reports"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), "s.epss", "s.epss_percentile")


def entity_rows(r: Registry, actors: DataFrame, facts: DataFrame, anchor_source: str = "attack") -> DataFrame:
    """One row for each entity: names with sources, collected attributes, its reports by quarter and techniques."""
    own = actors.withColumn("node", node_id(F.col("source"), F.col("source_id"), anchor_source)).join(r.members.select("node", "component").distinct(), "node")
    gathered = own.groupBy("component").agg(*[T.sorted_unique(F.flatten(F.collect_set(c))).alias(c) for c in ("origin", "sponsor", "motivation", "targets_countries", "targets_sectors", "malware", "techniques")], F.array_sort(F.collect_set("source")).alias("sources"))
    aliases = rollup.alias_rollup(r.names, "component", r.display).groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "spelling", "sources"))), lambda x: F.struct(x["spelling"].alias("name"), x["sources"].alias("sources"))).alias("aliases"))
    per = facts.select(F.explode("entities").alias("component"), "id", "published")
    quarters = per.where("published IS NOT NULL").groupBy("component", quarter_label(F.col("published")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))
    timeline = quarters.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("quarter", "n"))).alias("timeline"))
    counts = per.groupBy("component").agg(F.count_distinct("id").alias("n_reports"), F.max("published").alias("last_day"))
    conflict = checks.attribute_conflicts(own.select("component", "source", F.explode("origin").alias("v")), "component", "source", "v").select("component", F.col("all_values").alias("origin_conflict"))
    out = gathered.join(r.display, "component", "left").join(aliases, "component", "left")
    for extra in (timeline, counts, conflict):
        out = out.join(extra, "component", "left")
    return out.withColumnRenamed("component", "id").withColumn("n_reports", F.coalesce("n_reports", F.lit(0)))


def integrity(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Problems that must be none before anything is published."""
    named = facts.select(F.explode("entities").alias("entity"))
    return checks.violations(
        checks.missing_reference("report names an unknown entity", named, "entity", entities, "id"),
        checks.repeated_key("repeated report id", facts, "id"),
        checks.repeated_key("repeated entity id", entities, "id"),
        checks.broken_rule("date without a basis", facts, "id", F.col("published").isNull() | F.col("date_basis").isNotNull()),
    )


def build(spark: SparkSession, records: dict[str, DataFrame], policies: DataFrame, build_day: str, out: str | None = None, issuers: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Records by kind to the published tables; written below out, if given, once all checks have passed.

    Beside actors, reports and vulnerabilities, records may hold software, stated pairs of names (source, name, alias,
    retrieved_at) and labelled names (name, label, status); issuers gives the source of each prefix of a label.
    """
    reports = checks.gated(records["reports"], policies, "source")
    software = checks.gated(records["software"], policies, "source") if "software" in records else spark.createDataFrame([], schemas.SOFTWARE)
    pairs = checks.gated(records["pairs"], policies, "source") if "pairs" in records else None
    labels = records.get("labels")
    actors, registry = resolve_stated(checks.gated(records["actors"], policies, "source"), reports, software, pairs, labels, issuers)
    order = {s: k for k, s in enumerate(sorted(r["source"] for r in policies.collect()))}
    facts = written(report_facts(reports, cluster_reports(reports), registry.keys, order))
    entities = written(entity_rows(registry, actors, facts))
    tables = {
        "reports": facts,
        "entities": entities,
        "vulnerabilities": vulnerabilities(records["vulnerabilities"].select("cve", "date_added", "ransomware", "vendor", "product"), records["vulnerabilities"].select("cve", "epss", "epss_percentile").where("epss IS NOT NULL"), facts),
        "activity": reporting_activity(facts, build_day),
        "refused_keys": registry.refused,
        "resolution": stats(registry),
    }
    if labels is not None:
        tables |= guess_tables(registry, facts, reports, software, labels)
    if out:
        sinks.publish(spark, tables, out, [integrity(entities, facts)])
    return tables


