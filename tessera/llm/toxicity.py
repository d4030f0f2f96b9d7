"""Toxicity by a factorization machine over hashed terms.

A document's terms (runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered) are hashed into 2 ** 18
buckets. Training reads a bounded sample of labelled rows (MAX_LABELLED, taken in the order of a digest of their id), keeps
the buckets that tell the classes apart, alone or as one of a pair whose effect is not the sum of its parts' (looked for
among the POOL most frequent), and fits bias, weights and pairwise factors by AdaGrad with a last calibration on rows left
aside. Scores of all documents come from one pass in Arrow batches; nothing is shuffled but the labelled sample.

Defined results. Null and empty text: the score of the bias alone. No labelled rows, or one class only: every score is the
smoothed share of label 1 (0.5 without rows), 0.49 at most where that share is not above one half. Labelled rows with a
null label are left out; a document labelled twice counts twice, and so do rows that repeat a labelled id, within the bound.
Repeated rows get equal scores. Ties in choosing terms go to the lower bucket. Texts of any length are read whole. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, text_bytes, tokenise

BITS = 18
MAX_LABELLED = 20_000
MAX_TERMS, MIN_SEEN = 4096, 4
MIN_Z = 3.7  # of a term alone: two of 10,000 pass by chance
POOL, MIN_PAIR, PAIR_Z = 1024, 8, 6.0  # of half a million pairs, one in a thousand pools has one that passes by chance
FACTORS, EPOCHS, STEPS, BATCH, RATE = 4, 30, 1500, 256, 0.3
SPLIT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, bucket) of every term of the texts, repeated terms included."""
    t = tokenise([x.translate(SPLIT) for x in texts])
    return np.repeat(np.arange(len(texts)), t.counts), (t.hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)


class FactorMachine:
    """p(toxic) from the distinct terms of a document."""

    def __init__(self, chosen: np.ndarray, factors: int = FACTORS, seed: int = 7):
        self.index = np.full(1 << BITS, -1, dtype=np.int32)
        self.index[chosen] = np.arange(len(chosen))
        self.bias, self.w = 0.0, np.zeros(len(chosen))
        self.v = np.random.default_rng(seed).normal(0, 0.1, (len(chosen), factors))
        self.scale, self.shift = 1.0, 0.0

    def terms(self, doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, chosen term) pairs in order."""
        at = self.index[bucket]
        held = at >= 0
        pair = np.unique(doc[held].astype(np.int64) << 20 | at[held])
        return pair >> 20, pair & ((1 << 20) - 1)

    def raw(self, n: int, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([np.bincount(doc, self.v[term, f], n) for f in range(self.v.shape[1])], axis=1)
        squares = np.bincount(doc, (self.v[term] ** 2).sum(1), n)
        return self.bias + np.bincount(doc, self.w[term], n) + 0.5 * ((sums**2).sum(1) - squares), sums

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z, _ = self.raw(len(texts), *self.terms(*buckets(texts)))
        return _sigmoid(self.scale * z + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _spread(seen: np.ndarray, pos: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Root of the likelihood ratio statistic of every bucket against a label that does not depend on it."""
    told = np.zeros(len(seen))
    for have, of, rows in ((pos, n1, seen), (seen - pos, n - n1, seen), (n1 - pos, n1, n - seen), ((n - n1) - (seen - pos), n - n1, n - seen)):
        told += np.where(have > 0, have * np.log(np.maximum(have, 1) * n / np.maximum(rows * of, 1)), 0)
    return np.sqrt(np.maximum(2 * told, 0))


def choose(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Buckets seen often enough that stand out from chance among the documents `rows`, alone or in pairs, the clearest first.

    (doc, bucket) holds no pair twice.
    """
    used = np.zeros(len(y), dtype=bool)
    used[rows] = True
    doc, bucket = doc[used[doc]], bucket[used[doc]]
    seen, pos = np.bincount(bucket, minlength=1 << BITS), np.bincount(bucket, y[doc], 1 << BITS).astype(np.int64)
    n, n1 = len(rows), int(y[rows].sum())
    z = _spread(seen, pos, n, n1)
    z[(seen < MIN_SEEN) | (z < MIN_Z)] = 0
    often = np.flatnonzero(seen >= MIN_PAIR)
    often = np.sort(often[np.lexsort((often, -seen[often]))][:POOL])
    z[often] = np.maximum(z[often], _in_pairs(doc, bucket, y, often))
    kept = np.flatnonzero(z)
    return kept[np.lexsort((kept, -z[kept]))][:MAX_TERMS]


def _in_pairs(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, often: np.ndarray) -> np.ndarray:
    """For each of the buckets, how clearly its odds beside another one differ from the product of both; 0 where not above PAIR_Z."""
    place = np.full(1 << BITS, -1, dtype=np.int64)
    place[often] = np.arange(len(often))
    held = place[bucket] >= 0
    doc, at = doc[held], place[bucket[held]]
    order = np.argsort(doc, kind="stable")
    doc, at = doc[order], at[order]
    both = np.zeros((2, len(often), len(often)), dtype=np.float32)
    for label in (0, 1):
        own = np.unique(doc[y[doc] == label])
        for k in range(0, len(own), 1000):
            i, j = np.searchsorted(doc, own[k]), np.searchsorted(doc, own[min(k + 1000, len(own)) - 1], side="right")
            x = np.zeros((min(1000, len(own) - k), len(often)), dtype=np.float32)
            inside = y[doc[i:j]] == label
            x[np.searchsorted(own[k : k + 1000], doc[i:j][inside]), at[i:j][inside]] = 1
            both[label] += x.T @ x
    neg, pos = both[0], both[1]
    alone = np.stack([np.diagonal(neg), np.diagonal(pos)]).astype(np.float64)
    # The four cells of a pair: with both terms, with one, and with the other alone; the odds ratio of the odds of the label.
    logit = lambda p, q: np.log(p + 0.5) - np.log(q + 0.5)
    cells = [(pos, neg), (alone[1][:, None] - pos, alone[0][:, None] - neg), (alone[1][None, :] - pos, alone[0][None, :] - neg)]
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    rest = (np.maximum(n1 - alone[1][:, None] - alone[1][None, :] + pos, 0), np.maximum(n0 - alone[0][:, None] - alone[0][None, :] + neg, 0))
    effect = logit(*cells[0]) - logit(*cells[1]) - logit(*cells[2]) + logit(*rest)
    error = np.sqrt(sum(1 / (p + 0.5) + 1 / (q + 0.5) for p, q in (*cells, rest)))
    z = np.where(pos + neg >= MIN_PAIR, np.abs(effect) / error, 0)
    np.fill_diagonal(z, 0)
    best = z.max(axis=1, initial=0)
    return np.where(best >= PAIR_Z, best, 0)


def fit(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, seed: int = 7) -> FactorMachine:
    """A machine fitted to documents 0 to len(y) - 1; every fifth of them only calibrates it."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        m = FactorMachine(np.zeros(0, dtype=np.int64))
        share = (y.sum() + 0.5) / (len(y) + 1)
        m.bias = float(np.log(share / (1 - share))) if share > 0.5 or not len(y) else min(float(np.log(share / (1 - share))), -0.04)
        return m
    aside = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or y[aside].min() == y[aside].max():
        aside[:] = False
    train = ~aside
    m = FactorMachine(choose(doc, bucket, y, np.flatnonzero(train)), seed=seed)
    d, t = m.terms(doc, bucket)
    begin, end = np.searchsorted(d, np.arange(len(y))), np.searchsorted(d, np.arange(len(y)), side="right")
    m.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    rng, rate, decay = np.random.default_rng(seed), RATE, 1e-4
    gw, gv, gb = np.full_like(m.w, 1e-2), np.full_like(m.v, 1e-2), 1e-2
    rows = np.flatnonzero(train)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(rows))))):
        rng.shuffle(rows)
        for k in range(0, len(rows), BATCH):
            own = rows[k : k + BATCH]
            size = end[own] - begin[own]
            term = t[np.repeat(begin[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
            at = np.repeat(np.arange(len(own)), size)
            z, sums = m.raw(len(own), at, term)
            e = (_sigmoid(z) - y[own]) / len(own)
            g = np.bincount(term, e[at], len(m.w)) + decay * m.w
            gw += g * g
            m.w -= rate * g / np.sqrt(gw)
            h = np.stack([np.bincount(term, e[at] * (sums[at, f] - m.v[term, f]), len(m.w)) for f in range(m.v.shape[1])], axis=1) + decay * m.v
            gv += h * h
            m.v -= rate * h / np.sqrt(gv)
            gb += e.sum() ** 2
            m.bias -= rate * e.sum() / np.sqrt(gb)
    if aside.any():
        z, _ = m.raw(len(y), d, t)
        m.scale, m.shift = calibrate(z[aside], y[aside])
    return m


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logit by Newton steps, with a light pull towards 1 and 0."""
    p, x = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):
        q = _sigmoid(x @ p)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), x.T @ (q - y) + (p - [1.0, 0.0]))
        p = p - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(p[0], 0.05)), float(p[1])


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """Hashed terms and label of at most max_rows labelled documents outside the held-out fold."""
    own = labels.where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)  # at most max_rows rows of two numbers: broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")

    def hashed(batches):
        import pyarrow as pa

        for b in batches:
            doc, bucket = buckets(text_bytes(b.column(1)))
            pair = np.unique(doc.astype(np.int64) << 20 | bucket)
            d, x = pair >> 20, (pair & ((1 << 20) - 1)).astype(np.int32)
            ends = np.searchsorted(d, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())], ["doc_id", "toxic", "terms"])

    # A labelled id may stand in several rows: the bound holds for what is learnt from, too.
    return rows.mapInArrow(hashed, "doc_id long, toxic int, terms binary").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "terms").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> FactorMachine:
    rows = labelled(docs, labels, max_rows).toArrow().combine_chunks()
    ids, y, raw = rows.column("doc_id").to_pylist(), rows.column("toxic").to_pylist(), rows.column("terms").to_pylist()
    del rows
    order = sorted(range(len(ids)), key=lambda k: ((ids[k] * 0x9E3779B97F4A7C15) % (1 << 64), y[k], raw[k]))
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(raw[k]) // 4 for k in order])
    bucket = np.frombuffer(b"".join(raw[k] for k in order), dtype=np.int32)
    del raw
    return fit(doc, bucket, np.array([y[k] for k in order]))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    machine = train(docs, labels, max_rows)

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            p = machine.scores(text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
