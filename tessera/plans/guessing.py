"""From names that no source resolves to guesses at them, and from stated pairs of names to actor records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import guesses, rollup, shapes
from tessera.session import written

GROUND_TRUTH = ("derived", "confirmed")
KINDS = ("actor", "malware", "tool", "not-an-entity")


@dataclass(frozen=True)
class Known:
    """What names are held against."""

    actors: DataFrame  # key, spelling, target
    software: DataFrame  # key, spelling, target
    rows: DataFrame  # row, key, actor: names that one report lists
    cves: DataFrame  # row, cve
    titles: DataFrame  # rid, title
    shown: DataFrame  # component


def keyed(col: str):
    return T.name_key(T.fold_tokens(col))


def software_names(software: DataFrame) -> DataFrame:
    """(key, spelling, target): names and aliases of software with its kind."""
    names = software.select("kind", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("spelling"))
    return names.select(keyed("spelling").alias("key"), "spelling", F.col("kind").alias("target")).where("key IS NOT NULL").distinct()


def software_kinds(names: DataFrame) -> DataFrame:
    """(key, kind), one row for each key."""
    return names.groupBy("key").agg(F.min("target").alias("kind"))


def known(registry, software: DataFrame, reports: DataFrame, evidence_source: str) -> Known:
    """evidence_source is the source whose reports tell which names are listed together."""
    own = reports.withColumn("rid", F.concat_ws(":", "source", "source_id"))
    told = own.where(F.col("source") == evidence_source)
    listed = told.select(F.col("rid").alias("row"), F.explode("actor_names").alias("name")).withColumn("key", keyed("name")).where("key IS NOT NULL")
    rows = listed.join(registry.keys, "key", "left").select("row", "key", F.col("component").alias("actor")).distinct()
    actors = registry.names.select("key", "spelling", F.col("component").alias("target")).distinct()
    return Known(written(actors), written(software_names(software)), written(rows), written(told.select(F.col("rid").alias("row"), F.explode("cves").alias("cve")).distinct()), own.select("rid", "title").where("title IS NOT NULL"), registry.members.select("component").distinct())


def scored(names: DataFrame, k: Known) -> DataFrame:
    """signals() of names (name, key)."""
    return guesses.signals(names.select("name"), k.actors, k.software, k.rows, k.cves, shapes.title_contexts(k.titles, "rid", "title", names.select("key")))


def samples(labels: DataFrame, k: Known, keys: DataFrame) -> DataFrame:
    """Labelled names (name, label, status) scored as if no source listed them; a derived label counts where the sources still say it."""
    rows = labels.where(F.col("status").isin(*GROUND_TRUTH) & F.col("label").isin(*KINDS)).withColumn("key", keyed("name")).where("key IS NOT NULL")
    one = rows.groupBy("key").agg(F.min(F.struct("name", "label", "status")).alias("r")).select("key", "r.*")
    listed = k.software.select("key", F.col("target").alias("label"), F.lit(True).alias("listed")).distinct()
    one = one.join(keys.join(k.shown, "component", "left_semi"), "key", "left").join(listed, ["key", "label"], "left")
    derivable = F.when(F.col("label") == "actor", F.col("component").isNotNull()).otherwise(F.coalesce("listed", F.lit(False)))
    one = written(one.where((F.col("status") == "confirmed") | derivable).select("name", "key", F.col("label").alias("truth"), F.when(F.col("label") == "actor", F.col("component")).alias("truth_actor")))
    other = k.actors.join(one.select(F.col("key").alias("own"), F.col("truth_actor").alias("target")), "target").where("key <> own").select(F.col("own").alias("key"), F.lit(True).alias("matchable")).distinct()
    none = F.lit(False)
    out = scored(one, k).join(one.select("key", "truth", "truth_actor"), "key").join(other, "key", "left")
    return written(out.withColumn("exact_actor", none).withColumn("exact_software", none).withColumn("matchable", F.coalesce("matchable", none)))


def guessed(unresolved: DataFrame, labels: DataFrame, model: guesses.Model, k: Known) -> DataFrame:
    """Guesses at names (name, n): spellings merged, names of software and derived labels left out, confirmed labels as they are."""
    merged = rollup.merged_spellings(unresolved, keyed("name"), "name", "n").select("key", F.col("spelling").alias("name"), "n")
    said = labels.withColumn("key", keyed("name")).groupBy("key").agg(F.min(F.struct("label", "status")).alias("s")).select("key", F.col("s.label").alias("said"), F.col("s.status").alias("status"))
    merged = merged.join(k.software.select("key").distinct(), "key", "left_anti").join(said, "key", "left")
    open_names = written(merged.where("status IS NULL OR status NOT IN ('derived', 'confirmed')").select("key", "name", "n"))
    rows = guesses.guess_rows(open_names, scored(open_names, k), model, k.shown)
    types = dict(rows.dtypes)
    sure = merged.where("status = 'confirmed'").select("name", "key", "n", F.col("said").alias("label"), F.lit(None).cast("double").alias("confidence"), F.lit("confirmed").alias("band"), F.lit(None).cast("string").alias("matched"), F.array().cast(types["evidence"]).alias("evidence"), "status")
    return rows.unionByName(sure)


def pair_records(pairs: DataFrame, registry, software: DataFrame, predict=None) -> DataFrame:
    """(source, source_id, name, alias, retrieved_at): one record for each accepted pair (source, name, alias, retrieved_at).

    A bridge gives its known actor, under the name shown, another alias; a new pair names an actor. predict, if given, takes
    names (name, key) and returns (name, label).
    """
    one = pairs.withColumn("a", keyed("name")).withColumn("b", keyed("alias")).where("a <> b")
    one = written(one.groupBy("source", F.concat_ws(":", F.array_sort(F.array("a", "b"))).alias("pair")).agg(F.min(F.struct("name", "alias")).alias("p"), F.max("retrieved_at").alias("retrieved_at")).select("source", "pair", "p.*", "retrieved_at"))
    sides = one.select(F.explode(F.array("name", "alias")).alias("name")).distinct().withColumn("key", keyed("name"))
    told = written(predict(sides)) if predict else None
    decisions = guesses.pair_decisions(one, registry.keys, software_kinds(software), registry.members.select("component").distinct(), told)
    taken = decisions.where("accepted").join(registry.display.select(F.col("component").alias("entity"), "display_name"), "entity", "left")
    bridge = F.col("kind") == "bridge"
    named = taken.select(F.when(bridge, F.col("display_name")).otherwise(F.col("primary")).alias("shown"), F.when(bridge, F.col("other")).otherwise(F.col("alias")).alias("second"), "source", "pair", "retrieved_at")
    return named.select("source", F.concat(F.lit("pair:"), "pair").alias("source_id"), F.col("shown").alias("name"), F.col("second").alias("alias"), "retrieved_at")


def title_cluster_records(reports: DataFrame, registry, software: DataFrame, issuers: dict[str, str]) -> DataFrame:
    """One record for each label that its issuer's own titles carry and nobody lists, from the first source and report."""
    found = reports.select("source", "source_id", "retrieved_at", F.explode(T.title_clusters(F.col("title"), F.col("source"), issuers)).alias("name")).withColumn("key", keyed("name")).where("key IS NOT NULL")
    new = found.join(registry.keys, "key", "left_anti").join(software.select("key").distinct(), "key", "left_anti")
    first = new.groupBy("key").agg(F.min(F.struct("source", "source_id", "name", "retrieved_at")).alias("r"))
    return first.select("r.source", F.concat(F.lit("cluster:"), "key").alias("source_id"), "r.name", F.lit(None).cast("string").alias("alias"), "r.retrieved_at")
