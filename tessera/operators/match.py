"""Text matching: dictionary phrases, containment, near spellings, and counts over tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import TEXTS, osa_distance

MAX_WORDS = 5


def _word_rows(docs: DataFrame, doc: str, tokens: str, before: int, after: int) -> DataFrame:
    """(doc, at, w_0, w_1, …): one row per word with its neighbours, w_m1 being the word before; rows never carry the whole text."""
    t = F.col(tokens)
    offsets = range(-before, after + 1)
    named = lambda k: f"w_{k}" if k >= 0 else f"w_m{-k}"
    spots = F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.struct(i.alias("at"), *[F.get(t, i + k).alias(named(k)) for k in offsets]))
    return docs.select(doc, F.explode(F.when(F.size(t) > 0, spots)).alias("s")).select(doc, "s.*")


def phrase_candidates(docs: DataFrame, doc: str, tokens: str, dictionary: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """(doc, at, n, phrase, …) wherever a run of tokens is a dictionary phrase.

    The dictionary is joined on the phrase, so it may be of any size; Spark broadcasts it where it is small enough.
    Only runs whose first word begins some phrase are built.
    """
    starts = dictionary.select(F.split("phrase", " ")[0].alias("w_0")).distinct()
    near = _word_rows(docs, doc, tokens, 0, most - 1).join(starts, "w_0", "left_semi")
    words = [F.col(f"w_{k}") for k in range(most)]
    runs = F.array(*[F.when(words[n - 1].isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *words[:n]).alias("phrase"))) for n in range(1, most + 1)])
    return near.select(doc, "at", F.explode(F.array_compact(runs)).alias("r")).select(doc, "at", "r.n", "r.phrase").join(dictionary, "phrase")


def longest_first(candidates: DataFrame, doc: str) -> DataFrame:
    """Of overlapping candidates the one that begins first, the longest where several begin together.

    Scanning left to right is a fold over the document's own candidates in order, done inside one expression.
    """
    rest = [c for c in candidates.columns if c not in (doc, "at", "n")]
    item = F.struct(F.col("at"), (-F.col("n")).alias("neg"), *[F.col(c) for c in rest])
    grouped = candidates.groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = grouped.schema["all"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("kept"))
    step = lambda acc, x: F.when(x["at"] >= acc["free"], F.struct((x["at"] - x["neg"]).alias("free"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    kept = grouped.select(doc, F.explode(F.aggregate("all", start, step)["kept"]).alias("k"))
    return kept.select(doc, F.col("k.at").alias("at"), (-F.col("k.neg")).alias("n"), *[F.col(f"k.{c}").alias(c) for c in rest])


def phrase_mentions(docs: DataFrame, doc: str, tokens: str, dictionary: DataFrame, marks: str | None = None) -> DataFrame:
    """Per document and phrase: entity, times and first position, of the phrases that name an entity.

    dictionary (phrase, entity): a null entity consumes its words and reports nothing. With marks (an array of flags beside
    the tokens), a phrase counts only where written as a name: marked throughout, or with a digit.
    """
    found = longest_first(phrase_candidates(docs, doc, tokens, dictionary), doc).where(F.col("entity").isNotNull())
    if marks:
        flags = docs.select(doc, marks)
        named = F.forall(F.slice(F.col(marks), F.col("at") + 1, F.col("n")), lambda x: x) | F.col("phrase").rlike("[0-9]")
        found = found.join(flags, doc).where(named)
    return found.groupBy(doc, "phrase", "entity").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))


def top_mentions(mentions: DataFrame, doc: str, most: int = 25) -> DataFrame:
    w = Window.partitionBy(doc).orderBy(F.desc("n"), "first_at", "phrase")
    return mentions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def containment_join(names: DataFrame, name: str, tokens: str, reference: DataFrame, most: int = 8) -> DataFrame:
    """(name, phrase): names that contain a reference phrase as whole neighbouring words, and more."""
    found = phrase_candidates(names, name, tokens, reference.select("phrase").distinct(), most)
    longer = names.select(name, F.size(tokens).alias("__words"))
    return found.join(longer, name).where(F.col("n") < F.col("__words")).select(name, "phrase").distinct()


@F.pandas_udf(TEXTS)
def _deletions(keys: pd.Series) -> pd.Series:
    """The key and everything it can become by leaving out one or two characters."""

    def one(x):
        if not isinstance(x, str):
            return None
        once = {x[:i] + x[i + 1 :] for i in range(len(x))}
        return sorted({x} | once | {y[:i] + y[i + 1 :] for y in once for i in range(len(y))})

    return keys.map(one)


def fuzzy_join(left: DataFrame, right: DataFrame, key: str, edits: int = 2, similarity: float = 0.8, shortest: int = 5) -> DataFrame:
    """(left key, right key, distance, similarity) of keys a few edits apart that agree in their digits.

    Two keys within two edits (swaps of neighbours included) share a string left after leaving out at most two characters
    of each, so blocking on those strings and on the digits loses nothing; pairs are then verified exactly.
    """
    digits = lambda c: F.array_join(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), ",")
    side = lambda df, name: df.select(F.col(key).alias(name)).where(F.length(key) >= shortest).distinct().select(name, digits(F.col(name)).alias("d"), F.explode(_deletions(F.col(name))).alias("part"))
    pairs = side(left, "a").join(side(right, "b"), ["d", "part"]).where("a <> b").select("a", "b").distinct()
    near = pairs.where(F.abs(F.length("a") - F.length("b")) <= edits).withColumn("distance", osa_distance("a", "b"))
    sim = 1 - F.col("distance") / F.greatest(F.length("a"), F.length("b"))
    return near.where((F.col("distance") <= edits) & (sim >= similarity)).select(F.col("a").alias("left_key"), F.col("b").alias("right_key"), "distance", F.round(sim, 3).alias("similarity"))


def variant_join(names: DataFrame, name: str, variants: str, reference: DataFrame) -> DataFrame:
    """Reference rows (key, …) that carry one of the alternate keys of a name."""
    v = names.select(name, F.explode(variants).alias("v")).select(name, F.col("v.key").alias("key"), F.col("v.how").alias("how"))
    return v.join(reference, "key")


def best_hits(hits: DataFrame, name: str) -> DataFrame:
    """One hit per name: variant before contains before fuzzy, then similarity, then the later target name."""
    rank = F.when(F.col("kind") == "variant", 2).when(F.col("kind") == "contains", 1).otherwise(0)
    return hits.groupBy(name).agg(F.max_by(F.struct("kind", "similarity", "target"), F.struct(rank, "similarity", F.lower("target"))).alias("h")).select(name, "h.*")


def cooccurrence(df: DataFrame, row: str, key: str, least: int = 1) -> DataFrame:
    """Unordered pairs of keys with the number of rows that hold both. Pairs come from each row's own distinct keys."""
    own = df.groupBy(row).agg(F.array_sort(F.collect_set(key)).alias("k"))
    a = own.select(row, "k", F.posexplode("k").alias("i", "key_a"))
    pairs = a.select("key_a", F.explode(F.slice(F.col("k"), F.col("i") + 2, F.size("k"))).alias("key_b"))
    return pairs.groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)


def rare_attribute_links(df: DataFrame, row: str, entity: str, attribute: str, most: int = 3) -> DataFrame:
    """Pairs of entities that share an attribute carried by at most so many entities, with how many such they share."""
    own = df.select(entity, attribute).distinct()
    few = own.groupBy(attribute).agg(F.array_sort(F.collect_set(entity)).alias("e"), F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) & (F.col("c") <= most))
    a = few.select(attribute, "e", F.posexplode("e").alias("i", "entity_a"))
    pairs = a.select("entity_a", F.explode(F.slice(F.col("e"), F.col("i") + 2, most)).alias("entity_b"))
    return pairs.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("n_shared"))


def token_counts(docs: DataFrame, tokens: Column, least: int = 1) -> DataFrame:
    words = docs.select(F.explode(tokens).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def context_counts(docs: DataFrame, doc: str, tokens: str, contexts: list[str]) -> DataFrame:
    """For each token: documents that use it, and documents in which one of the context words stands next to it."""
    words = _word_rows(docs, doc, tokens, 1, 1).withColumnRenamed("w_0", "token")
    beside = F.col("w_m1").isin(contexts) | F.col("w_1").isin(contexts)
    once = words.groupBy("token", doc).agg(F.bool_or(F.coalesce(beside, F.lit(False))).alias("beside"))
    return once.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("beside").alias("n_context"))


def mine_terms(rows: DataFrame, term: str, doc: str, publisher: str, day: str, known: DataFrame, least_docs: int = 3, least_publishers: int = 2) -> DataFrame:
    """Terms unknown so far that enough documents of enough publishers use, with first and last day."""
    new = rows.join(known.select(term).distinct(), term, "left_anti")
    out = new.groupBy(term).agg(F.count_distinct(doc).alias("n_docs"), F.count_distinct(publisher).alias("n_publishers"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return out.where((F.col("n_docs") >= least_docs) & (F.col("n_publishers") >= least_publishers))
