"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document's set is that of its distinct k-word shingles. Documents of equal sets are one node from the start, so exact
copies, however many, cost one row. Every node has a signature of 64 MinHash values and stands in TREES sorted orders, each
by the signature turned to start at values of its own. Nodes that share an order's first DEPTH values form a region.

Candidates are neighbours in an order: no node has a longer common prefix with a node than with the one that stands beside
it, so in a crowded region only the nearest are compared (depth 64 where copies are many) and in a thin one any that share
DEPTH values. The first FIRST orders come first; of the others, only neighbours whose groups are still apart are compared.
Then regions that hold several groups are compared in full across the groups, by signatures, in tiles of bounded size, the
likeliest pair of two groups before the others. All candidates are confirmed on the full sets.

What can be missed: a pair that shares no region (0.0002 of pairs at the limit of 0.8, fewer above), and one whose signatures
agree in fewer than LIKELY values (0.00002 of such pairs). Nothing is capped: an order that puts other nodes between two
near ones, or a task's end, only leaves them to the comparison across groups.

Groups are the connected components of confirmed links. Up to LINKS links are joined in one task, where rounds of shuffles
would cost more than the work. More are first reduced to a forest within each task, then labels spread over tables in the
shared folder. Links inside a known group are dropped, and of those between two groups one counts.

Defined results. Null text, or text without words: empty set, linked with nothing. Fewer than k words: the whole sequence is
one shingle. Null doc_id: a document like any other, never the smallest. Repeated rows: one group, each row returned. Empty
table: empty result. Texts of any length are read whole. Extra columns are ignored by near_duplicates() and kept by
keep_one().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, mix64, packed_rows, text_bytes, tokenise, unpacked_rows
from tessera.llm.lm import pack_numbers, unpack_numbers

SHINGLE, PERCENT = 5, 80
VALUES, TREES, DEPTH = 64, 16, 4
FIRST = 4  # orders whose neighbours are joined before the others are looked at
LIKELY = 38  # of 64 equal values: at a similarity of 0.8, 51 are expected, and fewer than 38 come once in about 50,000 pairs
TILE, SKETCH = 512, 4096
LINKS = 1 << 17  # so many links take a task about 50 MB

_R = np.random.default_rng(20240229)
_XOR = _R.integers(1 << 63, size=VALUES, dtype=np.uint64)
_MUL = _R.integers(1 << 63, size=VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and where each text's begin (with the end)."""
    t = tokenise(texts)
    w, sets = t.hashes, []
    for i, j in zip(t.starts, t.starts[1:], strict=False):
        n = min(k, j - i)
        h = np.zeros(j - i - n + 1 if n else 0, dtype=np.uint64)
        for p in range(n):
            h = mix64(h * np.uint64(3) + w[i + p : i + p + len(h)])
        h.sort()
        sets.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The low 16 bits of 64 minima for every non-empty set."""
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(starts) - 1, VALUES), dtype=np.uint16)
    if len(full):
        for i in range(VALUES):
            x = (((values ^ _XOR[i]) * _MUL[i]) >> np.uint64(32)).astype(np.uint32)
            out[full, i] = np.minimum.reduceat(x, starts[:-1][full]) & np.uint32(0xFFFF)
    return out


def digests(values: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """128 bits that stand for a set; None for the empty one."""
    full = np.flatnonzero(np.diff(starts))
    out: list[bytes | None] = [None] * (len(starts) - 1)
    if len(full):
        parts = [np.add.reduceat(mix64(values * m), starts[:-1][full]) for m in (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))]
        for k, raw in zip(full, np.stack(parts, axis=1).astype(">u8"), strict=True):
            out[k] = raw.tobytes()
    return out


def _sliced(texts: list[bytes], most: int = 2 << 20):
    begin, held = 0, 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def row_key() -> Column:
    """What tells rows apart as far as id and text do."""
    return F.concat(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.coalesce(F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.lit("n")))


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """key, doc_id, n_shingles, node (set digest) and signature of every document of a table that has its key."""

    def made(batches):
        import pyarrow as pa

        for b in batches:
            texts = text_bytes(b.column(2))
            for i, j in _sliced(texts):
                values, starts = shingle_sets(texts[i:j], k)
                sig = signatures(values, starts)
                cols = [b.column(0)[i:j], b.column(1)[i:j], pa.array(np.diff(starts), pa.int64()), pa.array(digests(values, starts), pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["__key", "doc_id", "n_shingles", "node", "sig"])

    return docs.select("__key", "doc_id", "text").mapInArrow(made, "__key string, doc_id long, n_shingles long, node binary, sig binary")


def region_members(nodes: DataFrame) -> DataFrame:
    """(node, tree, region, n) for every order in which a node shares its first DEPTH values with others; n nodes do."""
    start = 2 * DEPTH * F.col("tree") + 1
    rows = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("node", "tree", F.xxhash64("tree", F.substring("sig", start, F.lit(2 * DEPTH))).alias("region"))
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return materialise(rows.join(sizes, "region").select("node", "tree", "region", "n"))


def neighbours(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, tree, run): pairs that stand next to each other in an order with a common prefix of DEPTH values or more.

    Pairs of one run follow each other without a gap.

    Every order is sorted by its turned signature and dealt out by range, node and all, so that no region is bound to a
    task. Pairs that sizes or signatures rule out are passed over. Neighbours that the end of a task's range parts are left
    to the comparison across groups.
    """
    start = 2 * DEPTH * F.col("tree") + 1
    turned = F.concat(F.substring("sig", start, F.lit(2 * VALUES)), F.substring("sig", F.lit(1), start - 1))
    rows = members.select("node", "tree").join(nodes.select("node", "n_shingles", "sig"), "node").select("tree", turned.alias("order"), "node", "n_shingles")
    rows = rows.repartitionByRange("tree", "order", "node").sortWithinPartitions("tree", "order", "node")

    def near(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        last, runs, joined = None, TaskContext.get().partitionId() << 32, False  # run numbers differ from task to task
        for b in batches:
            if last is not None:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(b.num_rows, VALUES)
            tree, n = b.column(0).to_numpy(), b.column(3).to_numpy()
            same = sig[1:] == sig[:-1]
            held = (tree[1:] == tree[:-1]) & same[:, :DEPTH].all(1) & (same.sum(1) >= LIKELY)
            held &= 100 * np.minimum(n[1:], n[:-1]) >= percent * np.maximum(n[1:], n[:-1])
            at = np.flatnonzero(held)
            x, y = b.column(2).take(pa.array(at)).to_pylist(), b.column(2).take(pa.array(at + 1)).to_pylist()
            pairs = [(p, q) if p < q else (q, p) for p, q in zip(x, y, strict=True)]
            begins = held & ~np.concatenate(([joined], held[:-1])) if len(held) else held
            run = runs + np.cumsum(begins)
            if len(held):
                runs, joined = int(run[-1]), bool(held[-1])
            cols = [pa.array([p for p, _ in pairs], pa.binary()), pa.array([q for _, q in pairs], pa.binary()), pa.array(tree[at], pa.int32()), pa.array(run[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "tree", "run"])
            last = b.slice(b.num_rows - 1)

    found = rows.mapInArrow(near, "a binary, b binary, tree int, run long")
    return found.groupBy("a", "b").agg(F.min(F.struct("tree", "run")).alias("first")).select("a", "b", "first.tree", "first.run")


def member_sets(docs: DataFrame, nodes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The packed sets of the nodes that share a region with another: only one document of each is read again."""
    keys = members.select("node").distinct().join(nodes.select("node", F.col("first.__key").alias("__key")), "node").select("__key")
    rows = docs.select("__key", "text").join(keys, "__key", "left_semi").dropDuplicates(["__key"]).select("text")

    def made(batches):
        import pyarrow as pa

        for b in batches:
            texts = text_bytes(b.column(0))
            for i, j in _sliced(texts):
                values, starts = shingle_sets(texts[i:j], k)
                packed = [pack_numbers(np.diff(values[p:q], prepend=np.uint64(0))) for p, q in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(digests(values, starts), pa.binary()), pa.array(packed, pa.binary())], ["node", "set"])

    return materialise(rows.mapInArrow(made, "node binary, set binary"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, run) between the groups ca and cb of those pairs (a, b, ca, cb, run) whose full sets overlap as asked, written."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def kept(batches):
        import pyarrow as pa

        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.cumsum(unpack_numbers(z.as_py()), dtype=np.uint64) for z in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4)], ["a", "b", "run"]).filter(pa.array(good, pa.bool_()))

    return materialise(both.select(F.least("ca", "cb"), F.greatest("ca", "cb"), "x", "y", "run").mapInArrow(kept, "a binary, b binary, run long"))


def _stars(links: DataFrame) -> DataFrame:
    """For the links (a, b) of each task, its nodes (src) with the smallest node (dst) that the task's links join them to."""

    def joined(batches):
        import pyarrow as pa

        up: dict[bytes, bytes] = {}

        def root(x):
            top = x
            while (nxt := up.get(top, top)) != top:
                top = nxt
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = [*up, *{root(x) for x in up}]
        for i in range(0, len(nodes), 10_000):
            own = nodes[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([root(x) for x in own], pa.binary())], ["src", "dst"])

    return links.select("a", "b").mapInArrow(joined, "src binary, dst binary")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of a link (a, b, run); comp is the smallest node of the connected component.

    Where links are many, those of each task become stars first, runs whole, as a run's links form a path. Then in each round
    the smallest label among a node's neighbours goes to the node and to the node that it was labelled with; then
    every node takes its label's label. So whole groups are hooked at once, and rounds grow with the logarithm of a path.
    """
    if links.count() <= LINKS:
        return materialise(_stars(links.coalesce(1)).select(F.col("src").alias("node"), F.col("dst").alias("comp")))
    # Of the links between two groups one counts.
    forest = _stars(links.groupBy("a", "b").agg(F.min("run").alias("run")).repartition("run")).where("src != dst")
    edges = materialise(forest.union(forest.select("dst", "src")).distinct())
    labels = materialise(edges.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("comp")).withColumnRenamed("src", "node"))
    while True:
        spread = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("comp").alias("near"))
        told = labels.join(spread.withColumnRenamed("src", "node"), "node")
        hooks = told.select("node", "near").union(told.select("comp", "near")).groupBy("node").agg(F.min("near").alias("near"))
        joined = labels.join(hooks, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        jump = joined.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        nxt = materialise(joined.join(jump, "new").select("node", F.least("new", "jump").alias("comp"), (F.least("new", "jump") != F.col("comp")).alias("changed")))
        labels = nxt.select("node", "comp")
        if nxt.where("changed").isEmpty():
            return labels


def across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs of two groups, with these as ca and cb."""
    side = lambda x: groups.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("ca") != F.col("cb"))


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups after links between them."""
    if links.isEmpty():
        return groups
    names = components(links).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    out = groups.join(names, F.col("comp") == F.col("old"), "left")
    return materialise(out.select("node", F.coalesce("new", "comp").alias("comp")))


def _sketches(sets: DataFrame) -> DataFrame:
    """The sets' rows with a sketch for the set: how many shingles fall into each of SKETCH buckets; null where a bucket's count needs more than a byte.

    What two sets share is at most the sum, over buckets, of the smaller count.
    """

    def made(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for x in b.column(3):
                c = np.bincount((np.cumsum(unpack_numbers(x.as_py()), dtype=np.uint64) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                out.append(pack_numbers(c.astype(np.uint8)) if c.max(initial=0) < 255 else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["node", "n_shingles", "sig", "sketch"])

    return sets.select("node", "n_shingles", "sig", "set").mapInArrow(made, "node binary, n_shingles long, sig binary, sketch binary")


def mixed_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of regions that hold several groups, with their group and their part (tile) of the region."""
    own = members.join(groups, "node")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    held = own.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(tiles).alias("tiles")).where(F.col("lo") != F.col("hi"))
    held = held.select("region", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    own = own.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    return own.join(held, ["region", "tile"], "left_semi").select("node", "tree", "region", "comp", "tile", "tiles")


def tiled(mixed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb, same): pairs across the groups of every mixed region that sizes, signatures and sketches leave possible.

    Regions are compared tile by tile, and a pair is told in its first common region only.
    """
    facts = materialise(_sketches(mixed.select("node").distinct().join(nodes.select("node", "n_shingles", "sig"), "node").join(sets, "node")))
    rows = mixed.join(facts, "node")
    packed = rows.groupBy("region", "tree", "tile", "tiles").agg(F.collect_list(F.struct("node", "comp", "n_shingles", "sketch", "sig")).alias("held"))
    left = packed.select("region", "tree", F.col("held").alias("x"), F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("tile"))
    both = left.join(packed.select("region", "tile", F.col("held").alias("y")), ["region", "tile"]).select("x", "y", "tree")

    def compared(batches):
        import pyarrow as pa

        for b in batches:
            pairs: dict[tuple[bytes, bytes], tuple[bytes, bytes, int]] = {}
            for x, y, tree in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                x, y = x.as_py(), y.as_py()
                sx, sy = (np.frombuffer(b"".join(r["sig"] for r in z), dtype=np.uint16).reshape(len(z), VALUES) for z in (x, y))
                nx, ny = (np.array([r["n_shingles"] for r in z]) for z in (x, y))
                cx, cy = (np.array([r["comp"] for r in z], dtype=object) for z in (x, y))
                near = 100 * np.minimum(nx[:, None], ny[None, :]) >= percent * np.maximum(nx[:, None], ny[None, :])
                near &= cx[:, None] != cy[None, :]
                # Beside a sketch, a row without one bounds nothing; two such rows share as many as the smaller set has at most.
                kx, ky = (np.stack([np.full(SKETCH, 255, np.uint8) if r["sketch"] is None else unpack_numbers(r["sketch"]) for r in z]) for z in (x, y))
                bare_x, bare_y = (np.array([r["sketch"] is None for r in z]) for z in (x, y))
                p, q = np.nonzero(near)
                for s in range(0, len(p), 1 << 14):
                    u, v = p[s : s + (1 << 14)], q[s : s + (1 << 14)]
                    equal = sx[u] == sy[v]
                    same = equal.sum(1)
                    met = equal.reshape(len(u), TREES, DEPTH).all(2)[:, :tree].any(1)
                    ok = (same >= LIKELY) & ~met
                    u, v, same = u[ok], v[ok], same[ok]
                    share = np.minimum(kx[u], ky[v]).sum(1, dtype=np.int64)
                    share = np.where(bare_x[u] & bare_y[v], np.minimum(nx[u], ny[v]), share)
                    ok = 100 * share >= percent * (nx[u] + ny[v] - share)
                    for i, j, c in zip(u[ok].tolist(), v[ok].tolist(), same[ok].tolist(), strict=True):
                        r, o = sorted((x[i], y[j]), key=lambda z: z["node"])
                        pairs[r["node"], o["node"]] = (r["comp"], o["comp"], c)
            cols = [[k[0] for k in pairs], [k[1] for k in pairs], [v[0] for v in pairs.values()], [v[1] for v in pairs.values()], [v[2] for v in pairs.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.binary()] * 4, pa.int32()), strict=True)], ["a", "b", "ca", "cb", "same"])

    return both.mapInArrow(compared, "a binary, b binary, ca binary, cb binary, same int")


def node_groups(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Nodes with comp, their group (themselves where they have no link)."""
    members = region_members(nodes)
    groups = materialise(members.select("node", F.col("node").alias("comp")).distinct())
    sets = member_sets(docs, nodes, groups, k)
    tried = materialise(neighbours(members, nodes, percent))
    # The first orders join most of what belongs together; of the others, only pairs that are still apart are looked at.
    first = tried.where(F.col("tree") < FIRST).select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"), "run")
    groups = merged(groups, confirmed(first, sets, percent))
    later = across(tried.where(F.col("tree") >= FIRST).drop("tree"), groups)
    groups = merged(groups, confirmed(later, sets, percent))
    # What still shares a region but no group: the likeliest pair of two groups first, then what is left apart.
    mixed = materialise(mixed_members(members, groups))
    if not mixed.isEmpty():
        apart = materialise(tiled(mixed, nodes, sets, percent).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        if not apart.isEmpty():
            ca, cb = F.least("ca", "cb"), F.greatest("ca", "cb")
            best = apart.groupBy(ca.alias("ca"), cb.alias("cb")).agg(F.max(F.struct("same", "a", "b")).alias("top")).select("top.a", "top.b", "ca", "cb", F.xxhash64("ca").alias("run"))
            groups = merged(groups, confirmed(best, sets, percent))
            rest = across(apart.select("a", "b").join(best, ["a", "b"], "left_anti"), groups).withColumn("run", F.xxhash64("ca"))
            groups = merged(groups, confirmed(rest, sets, percent))
    return nodes.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _nodes(sets: DataFrame) -> DataFrame:
    """A row for each distinct set that is not empty; `first` has its row of the smallest id, null last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("first")
    return materialise(sets.where(F.col("node").isNotNull()).groupBy("node").agg(first, F.max("n_shingles").alias("n_shingles"), F.min("sig").alias("sig")))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of docs."""
    docs = docs.select("doc_id", "text", row_key().alias("__key"))
    sets = materialise(document_sets(docs, k))
    nodes = _nodes(sets)
    found = node_groups(docs, nodes, k, percent).select("node", F.col("first.doc_id").alias("least"), "comp")
    smallest = found.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = found.select("node", "comp").join(smallest, "comp").select("node", "component_id")
    out = sets.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each near-duplicate group, and all rows without words.

    The row is that of the smallest id, of rows that share it the one with the smaller digest of the text; rows without id
    come last. Every row is judged by its own text, whatever other rows share its id.
    """
    own = docs.select("doc_id", "text", row_key().alias("__key"))
    sets = materialise(document_sets(own, k))
    nodes = _nodes(sets)
    chosen = node_groups(own, nodes, k, percent).groupBy("comp").agg(F.min("first").alias("first")).select(F.col("first.__key").alias("__key"), F.lit(False).alias("empty"))
    kept = chosen.union(sets.where(F.col("node").isNull()).select("__key", F.lit(True)).distinct())
    # Rows that repeat id and text: one of them. Join and window share one exchange.
    rows = packed_rows(docs, __key=row_key())
    held = rows.join(kept, "__key").withColumn("place", F.row_number().over(Window.partitionBy("__key").orderBy("__key")))
    return unpacked_rows(held.where((F.col("place") == 1) | F.col("empty")).select("row"), docs)
