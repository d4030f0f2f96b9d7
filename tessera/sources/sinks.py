"""Sinks: validated swaps, year shards, coded indexes, manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.checks import refuse_if_any
from tessera.operators.rollup import frequency_dictionary
from tessera.session import written


def _scratch(spark: SparkSession) -> str:
    written(spark.range(0).toDF("x"))  # names the shared folder where none is set
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/tessera/{uuid.uuid4().hex}"


def write_shards(df: DataFrame, day: str, path: str | None = None) -> str:
    """df in one folder for each year and one for rows without a day."""
    path = path or _scratch(df.sparkSession)
    shard = F.coalesce(F.year(day).cast("string"), F.lit("undated"))
    df.withColumn("shard", shard).write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """All shards, or those listed; one that is missing stops the read. The filter reads no other folder."""
    df = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    df = df.withColumn("shard", F.col("shard").cast("string"))
    if shards is None:
        return df
    there = {r["shard"] for r in df.select("shard").distinct().collect()}
    if lost := sorted(set(shards) - there):
        raise ValueError("missing shards: " + ", ".join(lost))
    return df.where(F.col("shard").isin(shards))


def coded_index(df: DataFrame, coded: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """df with the coded columns as positions in dictionaries, the most frequent value first."""
    tables = {}
    for c in coded:
        tables[c] = written(frequency_dictionary(df, c))
        codes = tables[c].select(F.col("value").alias(c), F.col("code").alias(f"__{c}"))
        df = df.join(codes, c, "left").drop(c).withColumnRenamed(f"__{c}", c)
    return df, tables


def index_document(rows: DataFrame, order: list[str], tables: dict[str, DataFrame], version: str, most: int = 1_000_000) -> str:
    """A column-wise JSON document of a published index, for indexes that a browser loads; refused beyond so many rows."""
    n = rows.count() + sum(t.count() for t in tables.values())
    if n > most:
        raise ValueError(f"an index of {n} rows is too large for one document ({most}); publish shards")
    body = {c: [] for c in rows.columns}
    for r in rows.orderBy(*order).toLocalIterator():
        for c in rows.columns:
            body[c].append(str(r[c]) if hasattr(r[c], "isoformat") else r[c])
    names = {k: [r["value"] for r in t.orderBy("code").collect()] for k, t in tables.items()}
    return json.dumps({"version": version, "rows": body, "tables": names}, sort_keys=True, ensure_ascii=False, allow_nan=False)


def documents(df: DataFrame, key: str) -> DataFrame:
    """(key, document): one JSON text for each key, rows in a fixed order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows")).select(key, F.to_json(F.struct("rows")).alias("document"))


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, problems: list[DataFrame]) -> str:
    """Write all tables into a new version below path and point CURRENT at it, after every check has passed.

    Readers follow CURRENT, so they see the last whole version whatever happens here.
    """
    for p in problems:
        refuse_if_any(p)
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/CURRENT")
    return version


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{path}/CURRENT").first()["version"]
    return spark.read.parquet(f"{path}/{version}/{name}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below a path, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", r"^.*/", "")
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(~name.startswith("_") & ~name.startswith(".")).orderBy("file")


def notice(credits: DataFrame, title: str) -> str:
    """The attribution text: a line for each source (ord, source, credit), in the order of the catalogue."""
    lines = [f"{r['source']}: {r['credit']}" for r in credits.orderBy("ord").collect()]  # one row for each source
    return "\n".join([title, "", *lines, ""])
