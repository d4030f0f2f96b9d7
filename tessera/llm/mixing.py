"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order, null last, weigh 3, 1, 2 and so on. They share 150 % of all words by weight; no source gives
more than two passes over its documents, and what that cuts off is shared again by weight (water filling). Each document
copy then gets a virtual finish time: the words its source has handed out up to and with it, in shuffled order, divided by
the source's target. Copies are taken in the order of that time until the budget is reached.

Running sums are made from sums per bin (of the shuffle digest within a source, of the finish time globally) and windows
within a bin, so that neither a hot source nor the global order meets in one task.

Defined results. Null or empty text: size 0, nothing taken. A source without words: target 0. Empty table: empty result.
Ties of finish time are broken by source and digest. Rows that repeat id and source share a bin and are taken in a fixed order of size;
which of several equal rows is taken more often is left open, how often they are taken together is not. Texts of any length
count whole; one that exceeds its source's target is taken if its finish time comes before the cut. Null ids are ids like
any other. Extra columns are ignored by mix_documents() and carried by take_mix().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, packed_rows, unpacked_rows, word_array

WEIGHTS = (3, 1, 2)
SHARE, PASSES = 1.5, 2
BIN_ROWS, LEAST_DIGITS = 50_000, 3  # rows that a bin holds, about; hex digits of the digest that name the fewest bins


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of every source; the sources are few against their documents."""
    own = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = F.lit(WEIGHTS[-1])
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    for i, x in reversed(list(enumerate(WEIGHTS))):
        w = F.when(place == i, x).otherwise(w)
    weighed = own.withColumn("weight", w.cast("double")).withColumn("most", (PASSES * F.col("source_size")).cast("double"))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weighed = weighed.withColumns(
        {
            "full_before": F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_from": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "budget": F.sum("source_size").over(everything) * SHARE,
        }
    )
    level = (F.col("budget") - F.col("full_before")) / F.col("weight_from")
    # The water level: that of the first source, by how soon it is full, that stays below its most; later ones give less.
    weighed = weighed.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("most"), level)).over(everything))
    return weighed.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("most")).alias("target"))


def fair_queue(sizes: DataFrame) -> DataFrame:
    """sizes (doc_id, source, size) with source_size, target and taken, the words that the mix takes of the row."""
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = sizes.withColumn("__src", key).withColumn("__digest", shuffle_key(F.col("doc_id")))
    rows = materialise(rows)
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(1, rows.count()) / BIN_ROWS, 16)))
    bins_wide = 16**digits
    rows = rows.withColumn("__bin", F.substring("__digest", 1, digits))
    goal = targets(rows).withColumn("__src", key)
    bins = rows.groupBy("__src", "__bin").agg(F.sum("size").alias("__n"))
    ahead = bins.select("__src", "__bin", (F.sum("__n").over(Window.partitionBy("__src").orderBy("__bin")) - F.col("__n")).alias("__ahead"))
    facts = ahead.join(goal.drop("source"), "__src")
    inside = F.sum("size").over(Window.partitionBy("__src", "__bin").orderBy("__digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    queued = rows.withColumn("__in", inside).join(facts, ["__src", "__bin"])
    first = F.col("__ahead") + F.col("__in")
    finish = lambda k: F.when(F.col("target") > 0, (first + k * F.col("source_size")) / F.col("target")).otherwise(F.lit(2.0))
    queued = queued.withColumn("__finish", F.array(*[finish(k) for k in range(PASSES)]))
    queued = materialise(queued.drop("__in", "__ahead", "__bin"))
    # Truncate at the budget: sums per bin of finish time, then running sums within the one bin where the budget ends. Late
    # finish times, of documents far larger than their source's target, have bins by their logarithm, so bins stay few.
    copies = queued.where(F.col("size") > 0).select("doc_id", "size", "__src", "__digest", F.explode("__finish").alias("__f"))
    late = 2 * bins_wide + F.floor(F.log2(F.col("__f") / 2) * bins_wide)
    copies = copies.withColumn("__slot", F.when(F.col("__f") <= 2, F.floor(F.col("__f") * bins_wide)).otherwise(late).cast("long"))
    slots = copies.groupBy("__slot").agg(F.sum("size").alias("__n"), F.max("__f").alias("__last"))
    order = Window.orderBy("__slot")
    filled = slots.withColumns({"__to": F.sum("__n").over(order), "__end": F.lag("__last").over(order)})
    budget = (queued.agg(F.sum("size")).first()[0] or 0) * SHARE
    last = filled.where(F.col("__to") > budget).orderBy("__slot").first()
    end = None
    if last:  # always but for tables without words, as two passes exceed the budget
        cut = copies.where(F.col("__slot") == last["__slot"])
        cut = cut.withColumn("__to", F.sum("size").over(Window.orderBy("__f", "__src", "__digest", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) + (last["__to"] - last["__n"]))
        end = cut.where(F.col("__to") <= budget).agg(F.max("__f")).first()[0]
        end = last["__end"] if end is None else end
    limit = -1.0 if end is None else end
    taken = sum((F.when(F.col("__finish")[k] <= limit, F.col("size")).otherwise(0) for k in range(PASSES)), F.lit(0))
    extra = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *extra)


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.size(word_array(F.col(text))).cast("long").alias("size"))
    return fair_queue(sizes)


def take_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them."""
    # Id, source and text tell rows apart; of rows equal in these, the mix says only how often they are taken together.
    told = F.struct(F.col("doc_id"), F.col("source"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    key = F.md5(F.to_json(told).cast("binary"))
    sizes = docs.select("doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"), key.alias("__key"))
    mixed = fair_queue(sizes).where(F.col("taken") > 0)
    mixed = mixed.groupBy("__key").agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("times"))
    rows = packed_rows(docs, __key=key).join(mixed, "__key")
    own = Window.partitionBy("__key").orderBy("__key")
    rows = rows.withColumns({"__nth": F.row_number().over(own) - 1, "__rows": F.count(F.lit(1)).over(Window.partitionBy("__key"))})
    # `times` dealt out to the equal rows as evenly as can be.
    each = F.floor(F.col("times") / F.col("__rows")) + (F.col("__nth") < F.col("times") % F.col("__rows")).cast("long")
    out = rows.withColumn("__each", each.cast("int")).where(F.col("__each") > 0)
    return unpacked_rows(out.select("row", F.explode(F.sequence(F.lit(1), F.col("__each"))).alias("copy")), docs)
