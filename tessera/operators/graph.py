"""Entity resolution: blocking edges, connected components, components with anchors, redirects, identity over time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written


def star_edges(df: DataFrame, node: str, key: str) -> DataFrame:
    """(key, src, dst): every node of a key joined to the key's smallest node. Linear in the rows, whatever a key's size."""
    own = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(node).alias("dst")).distinct()
    hubs = own.groupBy("key").agg(F.min("dst").alias("src"))
    return own.join(hubs, "key").where(F.col("src") != F.col("dst")).select("key", "src", "dst")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    Each round takes the least label of a node and its neighbours and then that label's own label, so paths halve; every
    round is written to the shared folder.
    """
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = written(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("src").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, "src").select("src", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("src").alias("next"), F.col("component").alias("jump"))
        moved = written(step.join(jump, "next").select("src", F.least("next", "jump").alias("component"), (F.least("next", "jump") < F.col("component")).alias("moved")))
        labels = moved.select("src", "component")
        if moved.where("moved").isEmpty():
            break
    found = nodes.select(F.col(node).alias("src")).distinct().join(labels, "src", "left")
    return found.select(F.col("src").alias(node), F.coalesce("component", "src").alias("component"))


def anchored_components(carriers: DataFrame, anchor: Column, named: Column) -> tuple[DataFrame, DataFrame]:
    """Components in which a key never joins two anchors; returns (node, component) and refused keys.

    carriers has one row for each (node, key). Keys apply in the order: carried by an anchor, then by how many nodes use
    them as primary name (two at most count), then by key. A key whose nodes' components already hold more than one
    anchor between them is refused. Unconstrained components with one anchor at most cannot meet a refusal and are final;
    only the others are replayed in order, each on its own.
    """
    rows = carriers.withColumn("anchor", anchor).withColumn("named", named).groupBy("node", "key").agg(F.max("anchor").alias("anchor"), F.max("named").alias("named"))
    rows = written(rows)
    comps = connected_components(rows, star_edges(rows, "node", "key"))
    held = rows.join(comps, "node")
    clashing = held.where("anchor").groupBy("component").agg(F.count_distinct("node").alias("n")).where("n > 1").select("component")
    final = comps.join(clashing, "component", "left_anti")
    contested = held.join(clashing, "component", "left_semi")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = {n: n for n in pdf["node"]}
        anchors = {n: {n} if a else set() for n, a in zip(pdf["node"], pdf["anchor"], strict=True)}

        def root(n):
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        out = []
        shared = [(not g["anchor"].any(), -min(int(g["named"].sum()), 2), k, sorted(g["node"])) for k, g in pdf.groupby("key") if len(g) > 1]
        for _, _, key, members in sorted(shared):
            roots = {root(n) for n in members}
            holds = set().union(*(anchors[r] for r in roots))
            if len(holds) > 1:
                out.append((None, None, key, ",".join(sorted(holds))))
                continue
            first, *others = sorted(roots)
            for r in others:
                parent[r] = first
                anchors[first] |= anchors.pop(r)
        least: dict = {}
        for n in sorted(parent):
            least.setdefault(root(n), n)
        out += [(n, least[root(n)], None, None) for n in sorted(parent)]
        return pd.DataFrame(out, columns=["node", "component", "key", "candidates"])

    replayed = written(contested.groupBy("component").applyInPandas(replay, "node string, component string, key string, candidates string"))
    settled = final.select("node", "component").unionByName(replayed.where("key IS NULL").select("node", "component"))
    return settled, replayed.where("key IS NOT NULL").select("key", "candidates")


def resolve_keys(carriers: DataFrame, comps: DataFrame, refused: DataFrame) -> DataFrame:
    """(key, component): a refused key resolves only where exactly one anchor carries it."""
    held = carriers.join(comps, "node")
    plain = held.join(refused, "key", "left_anti").groupBy("key").agg(F.min("component").alias("component"))
    direct = held.join(refused, "key", "left_semi").where("anchor").groupBy("key").agg(F.count_distinct("node").alias("n"), F.min("component").alias("component"))
    return plain.unionByName(direct.where("n = 1").select("key", "component"))


def redirect_targets(df: DataFrame, node: str, target: str) -> DataFrame:
    """Where each chain of redirects ends, by pointer doubling; `in_cycle` marks nodes that never end."""
    hops = written(df.select(F.col(node).alias("node"), F.col(target).alias("goal")))
    n = hops.count()
    for _ in range(max(1, n.bit_length())):
        nxt = hops.select(F.col("node").alias("goal"), F.col("goal").alias("further"))
        moved = written(hops.join(nxt, "goal", "left").select("node", F.coalesce("further", "goal").alias("goal"), F.col("further").isNotNull().alias("moved")))
        hops = moved.select("node", "goal")
        if moved.where("moved").isEmpty():
            return hops.withColumn("in_cycle", F.lit(False))
    ended = df.select(F.col(node).alias("goal")).distinct().withColumn("on", F.lit(True))
    return hops.join(ended, "goal", "left").select("node", F.when(F.col("on").isNull(), F.col("goal")).alias("goal"), F.col("on").isNotNull().alias("in_cycle"))


def carry_identity(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Which identity of the previous build each present entity carries on.

    previous (slug, rank, anchor) and current (entity, anchor) are matched on anchors. An entity may take the slug with
    which it shares the most anchors, ties by the slug's rank and name; a slug goes to the entity with which it shares the
    most, ties by entity. Status: kept, new (no slug left), or merged for slugs whose entities went to another.
    """
    overlap = previous.join(current, "anchor").groupBy("slug", "rank", "entity").agg(F.count(F.lit(1)).alias("shared"))
    by_entity = Window.partitionBy("entity").orderBy(F.desc("shared"), "rank", "slug")
    by_slug = Window.partitionBy("slug").orderBy(F.desc("shared"), "entity")
    best = overlap.withColumn("e", F.row_number().over(by_entity)).withColumn("s", F.row_number().over(by_slug))
    kept = best.where("e = 1 AND s = 1").select("entity", "slug")
    entities = current.select("entity").distinct().join(kept, "entity", "left").select("entity", "slug", F.when(F.col("slug").isNull(), "new").otherwise("kept").alias("status"))
    lost = overlap.join(kept.select("slug"), "slug", "left_anti").join(kept.withColumnRenamed("slug", "into"), "entity")
    merged = lost.groupBy("slug").agg(F.min_by("into", F.struct(-F.col("shared"), F.col("rank"), F.col("into"))).alias("into"))
    gone = previous.select("slug").distinct().join(kept.select("slug"), "slug", "left_anti").join(merged, "slug", "left")
    return entities.select("entity", "slug", "status", F.lit(None).cast("string").alias("merged_into")).unionByName(
        gone.select(F.lit(None).cast(current.schema["entity"].dataType).alias("entity"), "slug", F.when(F.col("into").isNotNull(), "merged").otherwise("retired").alias("status"), F.col("into").alias("merged_into"))
    )


def suffixed(df: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Names made unique: the first of a base keeps it, the next take -2, -3 and so on, the lowest numbers that no natural name has."""
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(base).orderBy(*order)))
    part = lambda k: F.regexp_extract(base, "^(.*)-([1-9][0-9]{0,8})$", k)
    natural = df.select(part(1).alias(base), F.nullif(part(2), F.lit("")).cast("int").alias("__taken")).where("__taken > 1")
    taken = natural.groupBy(base).agg(F.array_sort(F.collect_set("__taken")).alias("__taken"))
    out = numbered.join(taken, base, "left")
    # The n-th of a base takes the n-th number that is free: one further for each taken number up to it.
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__n"), lambda n, t: n + (t <= n).cast("int"))
    slug = F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), free.cast("string")))
    return out.withColumn("slug", slug).drop("__n", "__taken")


def typed_names(software: DataFrame, entity_keys: DataFrame, preferred: str) -> DataFrame:
    """(key, kind) of software names that no entity carries; the preferred source's kind wins, then source, id and kind."""
    order = F.struct((F.col("source") != preferred).cast("int"), "source", "source_id", "kind")
    return software.join(entity_keys.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min_by("kind", order).alias("kind"))


