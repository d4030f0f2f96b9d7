"""Sharding by minimax contiguous partition (native).

Documents of equal text form an atomic group. Groups stand in the order of their text's digest; the smallest capacity for
which a greedy left-to-right filling needs at most n shards is found by binary search, and the order is cut there. Where
cuts that even out the shards keep to that capacity, they are taken, as greedy filling leaves the last shard short.

The driver sees groups by the first digits of their digest: size and number of groups of each prefix. Two greedy fillings
bound the answer: one that may cut anywhere within a prefix, one that never does. Only prefixes that a cut can fall into are
looked at with two more digits, the largest REFINED of them in a round, until every cut lies between known groups. A round
reads the table of groups once and brings 256 * REFINED rows at most, so the search is the same for every size of table.

Defined results. Null text: no bytes, grouped with empty texts. Empty table: empty result. Null doc_id: a row like any
other, first in its shard. Repeated rows: each takes a slot of its own, in its text's shard. One group larger than the even
share makes a shard as large as that group. Texts of any length count whole. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

DIGITS, MORE_DIGITS = 3, 2  # hex digits of the digest: of the first prefixes, and how many more when looked at closer
REFINED = 256
BIN_ROWS = 50_000  # rows that a bin of slots holds, about


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def group_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """key and bytes of every group of equal texts."""
    rows = docs.select(_digest(F.col(text)).alias("key"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"))
    return materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes")))


class Prefixes:
    """Prefixes of digests in order, with the bytes and number of their groups; those of one group cannot be cut."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.rows = self._read(groups, DIGITS)

    @staticmethod
    def _read(groups: DataFrame, digits: int) -> dict[str, tuple[int, int]]:
        sums = groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        return {r["prefix"]: (r["bytes"], r["n"]) for r in sums.collect()}

    def arrays(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Prefixes, running ends of their bytes from 0 on, and which of them are single groups."""
        names = sorted(self.rows)
        ends = np.concatenate(([0], np.cumsum([self.rows[x][0] for x in names], dtype=np.int64))).astype(np.int64)
        return names, ends, np.array([self.rows[x][1] == 1 for x in names], dtype=bool)

    def refine(self, names: list[str]) -> None:
        names = sorted(names, key=lambda x: (-self.rows[x][0], x))[:REFINED]
        for digits in sorted({len(x) for x in names}):
            own = [x for x in names if len(x) == digits]
            closer = self._read(self.groups.where(F.substring("key", 1, digits).isin(own)), digits + MORE_DIGITS)
            for x in own:
                del self.rows[x]
            self.rows |= closer


def greedy(ends: np.ndarray, single: np.ndarray, capacity: int, shards: int, anywhere: bool) -> list[int]:
    """Ends of shards filled from left to right; with anywhere, prefixes of several groups may be cut at any byte."""
    out, at = [], 0
    for _ in range(shards):
        k = int(np.searchsorted(ends, at + capacity, side="right")) - 1
        at = at + capacity if anywhere and k < len(single) and not single[k] else int(ends[k])
        out.append(at)
    return out


def _least(ends: np.ndarray, single: np.ndarray, shards: int, anywhere: bool, low: int) -> int:
    high = int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(ends, single, middle, shards, anywhere)[-1] >= ends[-1] else (middle + 1, high)
    return low


def evened(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Shard ends at the first prefix end past an even share of what is left, within the capacity."""
    out, at, total = [], 0, int(ends[-1])
    for left in range(shards, 0, -1):
        even = int(np.searchsorted(ends, at + -(-(total - at) // left), side="left"))
        at = int(ends[min(even, int(np.searchsorted(ends, at + capacity, side="right")) - 1)])
        out.append(at)
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str | None]]:
    """The smallest feasible capacity, and for each shard the prefix that the next one begins with (None: no group is left)."""
    total, widest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    if not total:
        return 0, [None] * shards
    known = Prefixes(groups)
    while True:
        names, ends, single = known.arrays()
        least = _least(ends, single, shards, True, max(widest, -(-total // shards)))
        most = _least(ends, single, shards, False, least)
        spans = list(zip(greedy(ends, single, least, shards, False), greedy(ends, single, most, shards, True), strict=True))
        open_ = {k for a, b in spans for k in range(int(np.searchsorted(ends, a, "right")) - 1, min(int(np.searchsorted(ends, b, "left")), len(names))) if not single[k]}
        if not open_:
            break
        known.refine([names[k] for k in open_])
    while True:  # the capacity is known; the evened cuts need the groups around them
        cuts = evened(ends, least, shards)
        starts = [0, *cuts[:-1]]
        marks = [x for at, left in zip(starts, range(shards, 0, -1), strict=True) for x in (at + -(-(total - at) // left), at + least) if at < x <= total]
        open_ = {k for x in marks if (k := int(np.searchsorted(ends, x, side="left")) - 1) < len(names) and k >= 0 and not single[k]}
        if not open_:
            break
        known.refine([names[k] for k in open_])
        names, ends, single = known.arrays()
    if cuts[-1] < total:
        cuts = greedy(ends, single, least, shards, False)
    return least, [names[k] if (k := int(np.searchsorted(ends, c, side="left"))) < len(names) else None for c in cuts]


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row of docs with its size, its shard and a gapless slot in that shard."""
    groups = group_table(docs, text)
    _, cuts = minimax_cuts(groups, shards)
    t = F.coalesce(F.col(text), F.lit(""))
    shard = F.lit(0)
    for first in cuts[:-1]:  # a prefix comes before all digests that begin with it
        if first is not None:
            shard = shard + (F.col("__key") >= first).cast("int")
    bins = 4 ** max(5, math.ceil(math.log(max(1, docs.count()) / shards / BIN_ROWS, 4)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(t).cast("long").alias("__b"), F.crc32(t.cast("binary")).alias("text_crc32"), _digest(F.col(text)).alias("__key"))
    rows = rows.select("doc_id", (F.col("__b") + 1).alias("size"), "text_crc32", "__key", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(bins)).cast("long").alias("__bin"))
    counts = rows.groupBy("shard", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("shard", "__bin", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__bin")) - F.col("__n")).alias("__off"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("shard", "__bin").orderBy("doc_id", "__key")) - 1)
    out = ranked.join(offsets, ["shard", "__bin"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__off") + F.col("__rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
