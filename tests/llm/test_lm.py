import math
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import lm
from tessera.llm.lm import MASS, score_documents

ROWS = [
    (1, "The cat sat on the mat"),
    (2, "the cat sat\ton the  hat\n"),
    (3, None),
    (4, ""),
    (5, "unseen words only here"),
    (6, "the cat sat on the mat"),
    (6, "the cat sat on the mat"),
    (7, "Ünïcode \xa0 stays one word"),
    (8, "a " * 3000),
    (None, "the hat"),
    *[(k, f"the cat {k % 3} mat") for k in range(10, 40)],
]


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter()
    for i, t in rows:
        if not held(i):
            x = tokens(t)
            count.update(tuple(x[j : j + k]) for k in (1, 2, 3) for j in range(len(x) - k + 1))
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)
    root = lambda w: (count[w,] + 0.5) / (n + 0.5 * (v + 1))

    def smoothed(history, w):
        """The probability that the model gives to a word after a history, by its formula and without an automaton."""
        if not history:
            return root(w)
        m = MASS[len(history) - 1]
        return (count[(*history, w)] + m * smoothed(history[1:], w)) / (count[history] + m)

    out = []
    for i, t in rows:
        x = tokens(t)
        base = sum(math.log10(root(w)) for w in x)
        score = sum(math.log10(smoothed(tuple(x[max(0, j - 2) : j]), w)) for j, w in enumerate(x))
        out.append((-1 if i is None else i, held(i), len(x), sum(count[w,] > 0 for w in x), n, pytest.approx(base), pytest.approx(score)))
    return sorted(out, key=lambda r: (r[0], r[2]))


def scored(df, out=None):
    cols = "doc_id held_out n_tokens n_known train_tokens base_score score".split()
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"], *[r[c] for c in cols[1:]]) for r in (out or score_documents(df)).collect()), key=lambda r: (r[0], r[2]))


def test_against_scalar_traversal(make_docs):
    assert scored(make_docs(ROWS)) == brute(ROWS)


@pytest.mark.parametrize("fan_bits", [1, 2, 8])
def test_blocks_and_levels_do_not_change_scores(make_docs, monkeypatch, fan_bits):
    """Blocks of a few words, added up over several levels where the fan is small."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 60)
    blocks = lm.block_table(make_docs(ROWS).repartition(3))
    assert blocks.count() > 8
    assert scored(None, lm.score_blocks(blocks, fan_bits=fan_bits)) == brute(ROWS)


def test_lanes_carry_the_state(make_docs):
    docs = lm.block_table(make_docs([(0, " ".join(f"w{k * k % 17}" for k in range(500))), (2, "w1 w2"), (3, None)]).coalesce(1)).collect()
    own = lm.Block(docs[0]["blob"], 8)
    facts = own, own.word_counts.astype("int64"), own.gram_counts.astype("int64"), int(own.word_counts.sum()), len(own.words), MASS
    whole = lm.walk(*facts)[2]
    assert all(lm.walk(*facts, lane=k)[2] == pytest.approx(whole) for k in (1, 2, 3, 7, 100))


def test_text_beyond_a_block(make_docs):
    rows = [(0, " ".join(f"w{k % 1013}" for k in range(900_000))), (2, "w1 w2 w3"), (3, "w1 w2 w3")]
    assert scored(make_docs(rows)) == brute(rows)


def test_twice_seen_texts_score_higher(make_docs):
    import random

    r = random.Random(5)
    text = lambda: " ".join(f"w{int(3000 ** r.random())}" for _ in range(120))
    once = [(k, text()) for k in range(200)]
    twice = [(1000 + k, text()) for k in range(40)]
    rows = {r[0]: (r[6] - r[5]) / r[2] for r in scored(make_docs(once + twice + [(2000 + k, t) for k, (_, t) in enumerate(twice)])) if not r[1]}
    seen = [v for k, v in rows.items() if k < 1000]
    pairs = [v for k, v in rows.items() if 1000 <= k < 2000 and k + 1000 in rows]
    assert len(pairs) > 9 and sum(pairs) / len(pairs) > sum(seen) / len(seen) + 0.15


def test_no_documents(make_docs, spark):
    assert scored(make_docs(ROWS).limit(0)) == []
