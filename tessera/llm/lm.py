"""Language-model scoring by a weighted backoff automaton.

The model is a trigram model over words with Dirichlet smoothing: p(w | g h) = (c(g h w) + M3 p(w | h)) / (c(g h) + M3),
p(w | h) = (c(h w) + M2 p(w)) / (c(h) + M2), and p(w) adds one half to every count. As an automaton it has a root, a state
for every training word and one for every training pair. From a state, a seen n-gram has an arc of its smoothed weight; any
other word takes the failure arc, of weight M / (c + M), to the state of the history without its first word, and so on down
to the root, which has an arc for every word. The next state is the longest of pair and word that training holds. A text
starts in the root and ends with an end token.

Texts are traversed from left to right, many at once: each lane carries its state from token to token. A long text is cut
into lanes of LANE tokens; as two tokens determine the state, a lane first walks the two before it.

No task and no broadcast holds the whole model. Documents are packed into blocks of bounded size. A block asks for the
words and n-grams that it holds, with its own training counts, in sorted runs by the first bits of their hash. Runs are added
up in groups of at most about FAN blocks, the sums as larger blocks in longer ranges again, and so on until FAN are left;
totals go back down the same way, so every group holds about FAN runs whatever the size of the corpus, and a word that every
document holds occurs once for each run. Each block ends with the part of the automaton that its texts can reach.

Words are told apart by 64-bit hashes, n-grams by as many bits that one in 2 ** SPARE_BITS shares its hash. Defined results.
Null and empty text: the end token alone. Null doc_id: the fold of the empty text. Empty table: empty result. No training
document: all scores 0. Repeated rows are scored and counted each; ties do not arise. A text longer than a block is a block
of its own. Extra columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, materialise, mix64, text_bytes, tokenise

MASS = (1000.0, 10.0)  # M2 and M3: how many observations the lower order counts for; chosen by the likelihood of held-out texts
BLOCK_BYTES = 4 << 20
LANE = 1024
FAN_BITS = 8  # FAN = 2 ** FAN_BITS
SPARE_BITS = 16
END = np.uint64(0x51ED270B7A5C9E13)
PAIR, TRIPLE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)), (np.uint64(0x9FB21C651E98DF25), np.uint64(0xE7037ED1A0B428DB))
WORDS, GRAMS = 0, 1  # the two kinds of runs


def _pack(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers with their bytes put in planes, which compress apart."""
    return struct.pack("<QB", len(x), x.dtype.itemsize) + _pack(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def unpack_numbers(raw: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", raw)
    planes = np.frombuffer(_unpack(raw[9:]), dtype=np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[width]).ravel()


def narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def block_table(docs: DataFrame) -> DataFrame:
    """Documents packed into blocks of about BLOCK_BYTES of whole texts, written once, so that a block stays what it is."""

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, train, texts, held = [], [], [], 0

        def block():
            size = np.array([len(x) for x in texts], dtype=np.uint32)
            null = np.array([x is None for x in ids], dtype=np.uint8)
            head = [np.array([x or 0 for x in ids], dtype=np.int64).tobytes(), null.tobytes(), np.array(train, dtype=np.uint8).tobytes(), size.tobytes()]
            blob = _pack(struct.pack("<Q", len(ids)) + b"".join(head) + b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], ["block", "n_bytes", "blob"])

        for b in batches:
            for i, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), strict=True):
                if held and held + len(x) > BLOCK_BYTES:
                    yield block()
                    seq, ids, train, texts, held = seq + 1, [], [], [], 0
                ids.append(i)
                train.append(t)
                texts.append(x)
                held += len(x) + 1
        if ids:
            yield block()

    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) != 1).alias("train"), "text")
    return materialise(rows.mapInArrow(packed, "block long, n_bytes long, blob binary"))


class Block:
    """The documents of a block, their tokens, and the distinct words and n-grams in order of their hashes."""

    def __init__(self, blob: bytes, shift: int):
        raw = _unpack(blob)
        (n,) = struct.unpack_from("<Q", raw)
        at = 8
        self.ids, at = np.frombuffer(raw, np.int64, n, at), at + 8 * n
        self.null, at = np.frombuffer(raw, np.uint8, n, at).astype(bool), at + n
        self.train, at = np.frombuffer(raw, np.uint8, n, at).astype(bool), at + n
        size, at = np.frombuffer(raw, np.uint32, n, at).astype(np.int64), at + 4 * n
        ends = at + np.cumsum(size)
        t = tokenise([raw[e - s : e] for s, e in zip(size, ends, strict=True)])
        self.counts = t.counts + 1
        self.ends = np.cumsum(self.counts)
        token = np.full(int(self.counts.sum()), END, dtype=np.uint64)
        inner = np.ones(len(token), dtype=bool)
        inner[self.ends - 1] = False
        token[inner] = t.hashes
        place = np.arange(len(token)) - np.repeat(self.ends - self.counts, self.counts)
        self.second, self.third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        trained = np.repeat(self.train, self.counts)
        pair = mix64(token[:-1] * PAIR[0] + (token[1:] ^ PAIR[1]))
        triple = mix64(pair[:-1] * TRIPLE[0] + (token[2:] ^ TRIPLE[1]))
        grams = np.concatenate((pair[self.second - 1], triple[self.third - 2])) >> np.uint64(shift)
        self.words, self.word_at, self.word_counts = _distinct(token, trained)
        self.grams, self.gram_at, self.gram_counts = _distinct(grams, np.concatenate((trained[self.second], trained[self.third])))


def _distinct(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    return own, at, np.bincount(at[trained], minlength=len(own))


RUNS = "kind int, range long, block long, keys binary, counts binary"


def _runs(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, shift: int, bits: int) -> list[tuple]:
    """Rows of RUNS: sorted keys and their counts, cut where the first bits of the hash change."""
    top = (keys << np.uint64(shift)) >> np.uint64(64 - bits)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(top)) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    return [(kind, int(top[i]), block, pack_numbers(np.diff(keys[i:j], prepend=np.uint64(0))), pack_numbers(narrow(counts[i:j]))) for i, j in zip(edge, edge[1:], strict=False)]


def _run_table(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["kind", "range", "block", "keys", "counts"])


def _joint(t) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each run of a table, all keys in order, and where each run's keys stand among them, one after the other."""
    keys = [np.cumsum(unpack_numbers(x), dtype=np.uint64) for x in t.column("keys").to_pylist()]
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, own, at


def _told(keys: list[np.ndarray], totals: np.ndarray, at: np.ndarray):
    import pyarrow as pa

    ends = np.cumsum([len(x) for x in keys])
    return pa.array([pack_numbers(narrow(totals[at[e - len(k) : e]])) for k, e in zip(keys, ends, strict=True)], pa.binary())


def run_totals(runs: DataFrame, blocks: int, shift: int, fan_bits: int = FAN_BITS, level: int = 0) -> tuple[DataFrame, int, int]:
    """(kind, range, block, totals), the totals in the order of the run's keys, and how many training tokens and words there are."""
    import pyarrow as pa

    if blocks <= 1 << fan_bits:

        def answer(t):
            keys, own, at = _joint(t)
            counts = np.concatenate([unpack_numbers(x) for x in t.column("counts").to_pylist()])
            total = np.bincount(at, counts, len(own)).astype(np.int64)
            once = lambda x: [int(x) if t.column("kind")[0].as_py() == WORDS else 0] + [0] * (t.num_rows - 1)
            facts = {"totals": _told(keys, total, at), "n": pa.array(once(total.sum()), pa.int64()), "v": pa.array(once((total > 0).sum()), pa.int64())}
            return pa.table({c: t.column(c) for c in ("kind", "range", "block")} | facts)

        out = materialise(runs.groupBy("kind", "range").applyInArrow(answer, "kind int, range long, block long, totals binary, n long, v long"))
        n_train, n_distinct = (x or 0 for x in out.agg(F.sum("n"), F.sum("v")).first())
        return out.select("kind", "range", "block", "totals"), n_train, n_distinct
    above = -(-blocks >> fan_bits)
    grouped = runs.withColumn("group", F.pmod(F.xxhash64("block", F.lit(level)), F.lit(above)))

    def added(key, t):
        kind, _, group = (x.as_py() for x in key)
        _, own, at = _joint(t)
        counts = np.concatenate([unpack_numbers(x) for x in t.column("counts").to_pylist()])
        total = np.bincount(at, counts, len(own)).astype(np.int64)
        return _run_table(_runs(kind, group, own, total, shift if kind == GRAMS else 0, fan_bits * (level + 2)))

    sums = materialise(grouped.groupBy("kind", "range", "group").applyInArrow(added, RUNS))
    told, n_train, n_distinct = run_totals(sums, above, shift, fan_bits, level + 1)
    told = told.select("kind", F.col("range").alias("part"), F.expr(f"shiftright(range, {fan_bits})").alias("range"), F.col("block").alias("group"), "totals")

    def handed(left, right):
        keys, _, at = _joint(left)
        order = np.argsort(right.column("part").to_numpy(), kind="stable")
        totals = right.column("totals").to_pylist()
        total = np.concatenate([unpack_numbers(totals[k]).astype(np.int64) for k in order])
        return pa.table({c: left.column(c) for c in ("kind", "range", "block")} | {"totals": _told(keys, total, at)})

    by = ("kind", "range", "group")
    back = grouped.select(*by, "block", "keys").groupBy(*by).cogroup(told.groupBy(*by)).applyInArrow(handed, "kind int, range long, block long, totals binary")
    return materialise(back), n_train, n_distinct


def score_blocks(blocks: DataFrame, mass: tuple[float, float] = MASS, fan_bits: int = FAN_BITS) -> DataFrame:
    n_blocks, n_bytes = blocks.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    # A word and what parts it from the next take two bytes and make two n-grams.
    shift = max(0, 64 - SPARE_BITS - int(n_bytes or 0).bit_length())

    def ask(batches):
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = Block(blob, shift)
                rows = _runs(WORDS, block, own.words, own.word_counts, 0, fan_bits) + _runs(GRAMS, block, own.grams, own.gram_counts, shift, fan_bits)
                yield from _run_table(rows).to_batches()

    runs = blocks.select("block", "blob").mapInArrow(ask, RUNS)
    if n_blocks > 1 << fan_bits:  # read more than once
        runs = materialise(runs)
    answers, n_train, n_distinct = run_totals(runs, n_blocks, shift, fan_bits)

    def traverse(left, right):
        import pyarrow as pa

        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        out = []
        kind, ranges, totals = right.column("kind").to_numpy(), right.column("range").to_numpy(), right.column("totals").to_pylist()
        told = []
        for k in (WORDS, GRAMS):
            own = [unpack_numbers(totals[i]).astype(np.int64) for i in np.lexsort((ranges, kind)) if kind[i] == k]
            told.append(np.concatenate(own) if own else np.zeros(0, dtype=np.int64))
        for blob in left.column("blob").to_pylist():
            own = Block(blob, shift)
            known, base, score = walk(own, *told, n_train, n_distinct, mass)
            cols = [
                pa.array(own.ids, pa.int64(), mask=own.null),
                pa.array(~own.train),
                pa.array(own.counts, pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(np.full(len(own.ids), n_train), pa.int64()),
                pa.array(base),
                pa.array(score),
            ]
            out.append(pa.table(cols, names=names))
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select("block", "blob").groupBy("block").cogroup(answers.select("block", "kind", "range", "totals").groupBy("block")).applyInArrow(traverse, schema)


def walk(own: Block, word_totals: np.ndarray, gram_totals: np.ndarray, n_train: int, n_distinct: int, mass: tuple[float, float], lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document the known tokens, the base score and the automaton's."""
    one = word_totals[own.word_at]
    two, three = np.zeros(len(one), dtype=np.int64), np.zeros(len(one), dtype=np.int64)
    two[own.second], three[own.third] = gram_totals[own.gram_at[: len(own.second)]], gram_totals[own.gram_at[len(own.second) :]]
    root = (one + 0.5) / (n_train + 0.5 * (n_distinct + 1))
    begin = own.ends - own.counts
    # Lanes: at most `lane` tokens of one text each, entered up to two tokens before, the longest first.
    pieces = -(-own.counts // lane)
    doc = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[doc] + nth * lane
    ahead = np.minimum(2, nth * lane)
    steps = np.minimum(lane, own.ends[doc] - start) + ahead
    order = np.argsort(-steps, kind="stable")
    start, ahead, steps = (start - ahead)[order], ahead[order], steps[order]
    state, pairs, words = np.zeros(len(start), dtype=np.int64), np.zeros(len(start)), np.zeros(len(start))  # length of the history, its count, that of its last word
    weight = np.zeros(len(one))
    for t in range(int(steps[0]) if len(steps) else 0):
        k = int(np.searchsorted(-steps, -t, side="left"))  # lanes that are not at their end
        at, level, h2, h1 = start[:k] + t, state[:k].copy(), pairs[:k], words[:k]
        c1, c2, c3, w = one[at], two[at], three[at], np.zeros(k)
        # Failure arcs until a state has an arc for the word; the root has one for every word.
        for length, seen, held, m in ((2, c3, h2, mass[1]), (1, c2, h1, mass[0])):
            fails = (level == length) & (seen == 0)
            w[fails] += np.log10(m / (held[fails] + m))
            level[fails] = length - 1
        arc = root[at]
        arc = np.where(level >= 1, (c2 + mass[0] * arc) / (h1 + mass[0]), arc)
        arc = np.where(level == 2, (c3 + mass[1] * arc) / (h2 + mass[1]), arc)
        held = t >= ahead[:k]
        weight[at[held]] = (w + np.log10(arc))[held]
        state[:k] = np.where((state[:k] >= 1) & (c2 > 0), 2, c1 > 0)
        pairs[:k], words[:k] = c2, c1
    return np.add.reduceat(one > 0, begin, dtype=np.int64), np.add.reduceat(np.log10(root), begin), np.add.reduceat(weight, begin)


def score_documents(docs: DataFrame, mass: tuple[float, float] = MASS) -> DataFrame:
    return score_blocks(block_table(docs), mass)
