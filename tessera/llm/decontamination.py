"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A document is contaminated by an item if some stretch of its words is within SHARE * n word edits (insert, delete,
substitute) of the item's n words. Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered.

Each repetition draws a CGK random walk: reading a window of the item's size from left to right, step t outputs the word
under the pointer and moves on if a hash bit of (t, word) says so. Windows few edits apart give outputs few positions
apart (Hamming), so tables keyed by a few sampled positions bring them together. The number of tables is set for each item
size by a simulated hit rate at the largest allowed number of edits, to reach RECALL; sizes that would need more than
MAX_TABLES have none, and all their windows are verified. Hits are verified by the exact edit distance.

Windows are placed where they can matter: an item of n words within e edits of a stretch leaves a run of at least
ceil((n - e) / (e + 1)) words intact (pigeonhole), so only windows aligned to such a run shared with some item are
embedded. That loses nothing, and is one hash-table look-up for each word of the corpus.

Items are read in blocks of at most ITEM_BYTES of text, so what is sent to executors is bounded; the corpus is scanned once
for each block. Documents are read whole, in Arrow batches, without a shuffle.

Defined results. Null or empty texts and items without words match nothing. Null ids are ids like any other. Of places with
equally few edits the first is told. Texts of any length are read whole. Items that are equal match the same documents.
Repeated documents each give their own pairs. Empty tables: no pairs. Extra columns are ignored by find_leaks() and kept
by drop_leaked().
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, mix64, packed_rows, text_bytes, tokenise, unpacked_rows

SHARE = 0.2
RECALL = 0.998
SAMPLED = 2  # positions in a table's key
SIMULATED, WALKS = 16, 8  # edited items and walks that a hit rate is simulated with
ITEM_BYTES = 4 << 20
MAX_TABLES = 400  # beyond it, verifying every window costs no more than looking it up
SPLIT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: bytes) -> np.ndarray:
    return tokenise([text.translate(SPLIT)]).hashes


def embed(x: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """CGK outputs of the rows of x (one window each); past its end a window outputs 0."""
    n, width = x.shape
    padded = np.concatenate([x, np.zeros((n, 1), dtype=np.uint64)], axis=1)
    at, rows, out = np.zeros(n, dtype=np.int64), np.arange(n), np.empty((n, steps), dtype=np.uint64)
    for t in range(steps):
        word = padded[rows, at]
        out[:, t] = word
        bit = mix64(word ^ np.uint64((seed << 32) + t + 1)) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), width)
    return out


def distance(item: np.ndarray, stretch: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edits between the item and any part of the stretch (most + 1 if above), and that part's bounds."""
    m = len(stretch)
    row = np.zeros(m + 1, dtype=np.int64)
    start = np.arange(m + 1)
    for w in item:
        diagonal, above = row[:-1] + (stretch != w), row[1:] + 1
        best = np.minimum(diagonal, above)
        new, begin = np.empty(m + 1, dtype=np.int64), np.empty(m + 1, dtype=np.int64)
        new[0], begin[0] = row[0] + 1, 0
        took = np.where(diagonal <= above, start[:-1], start[1:])
        # Deletions from the stretch: a running minimum of (value - position).
        keyed = np.concatenate(([new[0]], best - np.arange(1, m + 1)))
        run = np.minimum.accumulate(keyed)
        source = np.maximum.accumulate(np.where(keyed <= run, np.arange(m + 1), 0))
        new[1:] = run[1:] + np.arange(1, m + 1)
        begin[1:] = np.concatenate(([0], took))[source[1:]]
        row, start = new, begin
    end = int(row.argmin())
    return (int(row[end]) if row[end] <= most else most + 1), int(start[end]), end


class Index:
    """LSH tables over a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], share: float = SHARE, recall: float = RECALL, seed: int = 17):
        held = [(i, w) for i, t in items if len(w := item_words(t))]
        self.ids, self.words = [i for i, _ in held], [w for _, w in held]
        self.edits = [int(share * len(w)) for w in self.words]
        self.recall, self.seed, self.share = recall, seed, share
        self.tables = {size: self._tables([w for w in self.words if len(w) == size]) for size in sorted({len(w) for w in self.words})}
        grams: dict[int, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.words):
            e = self.edits[k]
            grams.setdefault(-(-(len(w) - e) // (e + 1)), []).append((k, len(w), e))
        # For each run length: sorted run hashes with their item and place.
        self.runs = {}
        for q, members in grams.items():
            rows = [(h, k, p) for k, _, _ in members for p, h in enumerate(run_hashes(self.words[k], q))]
            h = np.array([r[0] for r in rows], dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 22, dtype=bool)
            bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.runs[q] = (h[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order], bits)
        self.keys = self._keys()

    def _tables(self, items: list[np.ndarray]) -> int:
        """How many tables reach the recall for items of one size, by the hit rate of one at the most edits they may have."""
        r, size = np.random.default_rng((self.seed, len(items[0]))), len(items[0])
        wide = np.zeros((2 * SIMULATED, size), dtype=np.uint64)
        for k in range(SIMULATED):
            x = list(items[int(r.integers(len(items)))])
            wide[2 * k] = x
            for _ in range(int(self.share * size)):
                p, what = int(r.integers(len(x))) if x else 0, int(r.integers(3))
                x[p : p + (what != 0)] = [np.uint64(r.integers(1 << 62))] if what != 1 else []
            wide[2 * k + 1, : min(len(x), size)] = x[:size]
        hits = 0.0
        for walk in range(WALKS):
            out = embed(wide, self.seed + walk, 3 * size)
            hits += float(((out[::2] == out[1::2]).mean(axis=1) ** SAMPLED).mean()) / WALKS
        if hits >= 0.999:
            return 4
        return max(4, math.ceil(math.log(1 - self.recall) / math.log(1 - hits))) if hits > 0 else MAX_TABLES + 1

    def _sampled(self, x: np.ndarray, table: int) -> np.ndarray:
        steps = 3 * x.shape[1]
        spots = np.random.default_rng((self.seed, table, steps)).integers(steps, size=SAMPLED)
        out = embed(x, self.seed * 1000 + table, int(spots.max()) + 1)
        key = np.full(len(x), table + 1, dtype=np.uint64) * _ODD
        for s in spots:
            key = mix64(key ^ out[:, s])
        return key

    def _keys(self) -> dict[int, list[dict[int, list[int]]]]:
        """For each item size, table by table, the items under each key; no tables where every window is verified."""
        out = {}
        for size, tables in self.tables.items():
            items = [k for k, w in enumerate(self.words) if len(w) == size]
            own = np.stack([self.words[k] for k in items])
            out[size] = []
            for table in range(tables if tables <= MAX_TABLES else 0):
                by: dict[int, list[int]] = {}
                for k, key in zip(items, self._sampled(own, table).tolist(), strict=True):
                    by.setdefault(key, []).append(k)
                out[size].append(by)
        return out

    def windows(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (document, size, start) of the windows that share an intact run with an item, starts relative to the corpus batch."""
        found = []
        for q, (h, item, place, bits) in self.runs.items():
            if len(hashes) < q:
                continue
            runs = run_hashes(hashes, q)
            near = np.flatnonzero(bits[(runs & np.uint64((1 << 22) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(h, runs[near], "left"), np.searchsorted(h, runs[near], "right")
            n = hi - lo
            near, lo, n = near[n > 0], lo[n > 0], n[n > 0]
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            word = np.repeat(near, n)
            doc = np.searchsorted(starts, word, side="right") - 1
            inside = word + q <= starts[doc + 1]  # a run does not cross into the next text
            word, at, doc = word[inside], at[inside], doc[inside]
            size = np.array([len(w) for w in self.words], dtype=np.int64)[item[at]]
            found.append(np.stack([doc, size, np.maximum(word - place[at], starts[doc])], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, edits, item words, first word of the stretch), the best stretch of each pair."""
        t = tokenise([x.translate(SPLIT) for x in texts])
        places = self.windows(t.hashes, t.starts)
        hits: set[tuple[int, int, int]] = set()
        for size in np.unique(places[:, 1]):
            own = places[places[:, 1] == size]
            ends = t.starts[own[:, 0] + 1]
            spots = own[:, 2, None] + np.arange(size)
            x = np.where(spots < ends[:, None], t.hashes[np.minimum(spots, len(t.hashes) - 1)], np.uint64(0))
            x, back = np.unique(x, axis=0, return_inverse=True)  # copies of a window are embedded once
            back = back.ravel()
            order = np.argsort(back, kind="stable")
            first = np.searchsorted(back[order], np.arange(len(x) + 1))
            if self.tables[int(size)] > MAX_TABLES:
                items = [k for k, w in enumerate(self.words) if len(w) == size]
                hits.update((int(doc), item, int(at)) for doc, _, at in own for item in items)
            for table, known in enumerate(self.keys[int(size)]):
                for k, key in enumerate(self._sampled(x, table).tolist()):
                    for item in known.get(key, ()):
                        hits.update((int(own[j, 0]), item, int(own[j, 2])) for j in order[first[k] : first[k + 1]])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, item, at in sorted(hits):
            if best.get((doc, item), (1,))[0] == 0:
                continue
            e, n = self.edits[item], len(self.words[item])
            low, high = max(int(t.starts[doc]), at - e), min(int(t.starts[doc + 1]), at + n + 2 * e)
            edits, begin, _ = distance(self.words[item], t.hashes[low:high], e)
            if edits <= e:
                best[doc, item] = min(best.get((doc, item), (edits, low + begin - int(t.starts[doc]))), (edits, low + begin - int(t.starts[doc])))
        return [(doc, self.ids[item], edits, len(self.words[item]), at) for (doc, item), (edits, at) in sorted(best.items())]


def run_hashes(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q words."""
    n = len(words) - q + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(q):
        out = (out ^ words[k : n + k]) * _ODD
        out ^= out >> np.uint64(29)
    return out


def item_blocks(benchmark: DataFrame):
    """Items in blocks of at most ITEM_BYTES of text (a longer item is a block of its own)."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        raw = r["text"].encode("utf-8", "surrogatepass")
        if block and held + len(raw) > ITEM_BYTES:
            yield block
            block, held = [], 0
        block.append((r["item_id"], raw))
        held += len(raw)
    yield block


LEAKS = "doc_id long, item_id long, edits long, item_words long, at_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """One row for each document and item that it contains within the allowed edits, with the fewest edits found."""
    out = None
    for block in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(Index(block, share, recall))

        def scan(batches, held=held):
            import pyarrow as pa

            index = held.value
            for b in batches:
                ids, texts = b.column(0).to_pylist(), text_bytes(b.column(1))
                rows = []
                for at in _chunks(texts):
                    rows += [(ids[at.start + k], i, e, n, w) for k, i, e, n, w in index.leaks(texts[at])]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "edits", "item_words", "at_word"])

        part = docs.select("doc_id", "text").mapInArrow(scan, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out


def _chunks(texts: list[bytes], most: int = 4 << 20):
    """Slices of about 4 MB of whole texts."""
    begin, held = 0, 0
    for k, x in enumerate(texts):
        held += len(x)
        if held >= most:
            yield slice(begin, k + 1)
            begin, held = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """The rows of docs that hold no item, with their own columns."""
    rows = packed_rows(docs, text=F.col("text"))
    for n, block in enumerate(item_blocks(benchmark)):
        rows = materialise(rows) if n else rows  # what the block before has left, so that executors hold one block at a time
        held = docs.sparkSession.sparkContext.broadcast(Index(block, share, recall))

        def clean(batches, held=held):
            import pyarrow as pa

            for b in batches:
                texts = text_bytes(b.column(0))
                keep = np.ones(b.num_rows, dtype=bool)
                for s in _chunks(texts):
                    for row in held.value.leaks(texts[s]):
                        keep[s.start + row[0]] = False
                yield b.filter(pa.array(keep))

        rows = rows.mapInArrow(clean, rows.schema)
    return unpacked_rows(rows, docs)
