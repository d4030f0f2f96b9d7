"""Incremental sources: keyed state kept as a table, changed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.dedupe import unseen, upsert


class KeyedTable:
    """A state table in versions <path>/v=<n>; a version becomes current when it is whole, so a failed batch changes nothing."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: Callable[[], list[Column]]):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order

    def version(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={batch}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Write version batch_id from the one before and the batch; done again after a failure, it gives the same table.

        Only the first batch starts from nothing: a version that cannot be read stops the stream.
        """
        old = self.version(batch_id - 1) if batch_id else batch.limit(0)
        upsert(old, batch, self.keys, self.order()).write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def until_known(pages: list[DataFrame], known: DataFrame, keys: list[str]) -> DataFrame | None:
    """New rows of pages given newest first; reading stops at the first page that brings nothing new."""
    out = None
    for page in pages:
        new = unseen(page, known, keys)
        if new.isEmpty():
            break
        out = new if out is None else out.unionByName(new)
    return out


def coverage(new: DataFrame, old: DataFrame, keys: list[str]) -> float:
    """Which share of the old keys a fresh crawl still lists."""
    total = old.select(*keys).distinct().count()
    return 1.0 if not total else old.select(*keys).distinct().join(new.select(*keys).distinct(), keys, "left_semi").count() / total
