"""Sources in their fixed order, each with a reader, a publish policy and guards on what may replace its last snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.checks import refuse_if_any, volume_guard
from tessera.sources import readers, schemas


def as_records(df: DataFrame, kind: str, source: str, retrieved_at: str) -> DataFrame:
    """df in the closed schema of a record kind: missing columns are null (arrays empty), unknown ones stop the build."""
    schema = T.StructType.fromDDL(schemas.RECORDS[kind])
    given = df.withColumn("source", F.lit(source)) if "source" not in df.columns and "source" in schema.names else df
    given = given.withColumn("retrieved_at", F.lit(retrieved_at))
    if unknown := sorted(set(given.columns) - set(schema.names)):
        raise ValueError(f"{source}: unknown columns " + ", ".join(unknown))
    empty = lambda f: F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType)
    return given.select(*[F.coalesce(F.col(f.name).cast(f.dataType), empty(f)).alias(f.name) if f.name in given.columns else empty(f).alias(f.name) for f in schema])


@dataclass(frozen=True)
class Connector:
    """A source: how its files become records of each kind."""

    key: str
    read: Callable[[SparkSession, dict[str, str]], dict[str, DataFrame]]
    least_rows: dict[str, int] = field(default_factory=dict)

    def records(self, spark: SparkSession, files: dict[str, str], retrieved_at: str) -> dict[str, DataFrame]:
        out = {}
        for kind, df in self.read(spark, files).items():
            if kind in self.least_rows:
                refuse_if_any(volume_guard(df, self.least_rows[kind]))
            out[kind] = as_records(df, kind, self.key, retrieved_at)
        return out


def _graph(spark, files):
    objects, rels = readers.graph_bundle(spark, [files[k] for k in sorted(files)])
    software = objects.where("type IN ('malware', 'tool')").select(F.col("id").alias("source_id"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.col("type").alias("kind"))
    campaigns = objects.where("type = 'campaign'").select(F.col("id").alias("source_id"), "name", "first_seen", "last_seen")
    return {"actors": readers.graph_actors(objects, rels, "mitre-attack").drop("urls"), "software": software, "campaigns": campaigns}


def _feed(path_prefix: str = "", issuers: dict[str, str] | None = None):
    def read(spark, files):
        rows = readers.feed_reports(readers.feed_items(spark, files["feed"]), "feed", path_prefix, issuers)
        return {"reports": rows.select("source_id", "title", F.col("published").cast("string"), F.lit("feed").alias("date_basis"), "url", "cves", "techniques")}

    return read


CATALOGUE = (
    Connector("graph", _graph, {"actors": 1}),
    Connector("clusters", lambda s, f: {"actors": readers.name_clusters(s, f["clusters"])}, {"actors": 1}),
    Connector("cards", lambda s, f: {"actors": readers.name_cards(s, f["cards"]).withColumn("first_seen", F.array_compact(F.array("first_seen")))}, {"actors": 1}),
    Connector("names", lambda s, f: {"actors": readers.name_table(s, f["names"]).withColumn("source_id", F.col("name"))}, {"actors": 1}),
    Connector("exploited", lambda s, f: {"vulnerabilities": readers.exploited_catalogue(s, f["catalogue"]).withColumn("date_added", F.col("date_added").cast("string"))}, {"vulnerabilities": 1}),
    Connector("scores", lambda s, f: {"vulnerabilities": readers.score_file(s, f["scores"])}, {"vulnerabilities": 100_000}),
    Connector("feed", _feed()),
)


def gather(spark: SparkSession, inputs: dict[str, dict[str, str]], retrieved_at: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All records by kind, and (source, ord, kind, n) of what each source gave; sources without input keep their place."""
    found: dict[str, DataFrame] = {}
    counts = None
    for k, c in enumerate(CATALOGUE):
        for kind, df in (c.records(spark, inputs[c.key], retrieved_at) if c.key in inputs else {}).items():
            found[kind] = found[kind].unionByName(df) if kind in found else df
            one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c.key).alias("source"), F.lit(k).alias("ord"), F.lit(kind).alias("kind"), "n")
            counts = one if counts is None else counts.unionByName(one)
    for kind in schemas.RECORDS:
        found.setdefault(kind, spark.createDataFrame([], schemas.RECORDS[kind]))
    return found, counts if counts is not None else spark.createDataFrame([], "source string, ord int, kind string, n long")
