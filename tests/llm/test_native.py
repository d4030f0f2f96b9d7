import random
import re
import zlib

import pytest

from tessera.llm.mixing import mix_documents, take_mix
from tessera.llm.quality import filter_quality, fit, posterior_bad, quality_rules
from tessera.llm.queries import oracle_sql
from tessera.llm.sharding import shard_documents

# --- quality -------------------------------------------------------------------------------------------------------------


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    spots = {}
    for i in range(len(w) - 7):
        spots.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for at in spots.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


CLEAN = [" ".join(f"{random.Random(i * 97 + j).choice(['the', 'of', 'and', 'to'])} thing{i * 7 + j}" for j in range(30)) for i in range(40)]
JUNK = [" ".join(f"word{i}x{j}***" for j in range(60)) for i in range(8)] + [" ".join(f"WORD{i}X{j}!!" for j in range(60)) for i in range(8)]
ODD = [None, "", " \n ", "short text", "a b c d e f g h " * 6, "line one is here\n" * 9, "é" * 500 + " ü# | <b> x", "w " * 9000, "1 2 3 4 5 6 7 8 x 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 y z q r s t u v w k j h"]


def test_base_counts(make_docs):
    rows = list(enumerate(ODD + CLEAN + JUNK))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality_rules(make_docs(rows)).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_verdicts_keep_clean_and_reject_junk(make_docs):
    rows = list(enumerate(CLEAN + JUNK))
    got = {r["doc_id"]: r["kept"] for r in quality_rules(make_docs(rows)).collect()}
    assert [got[i] for i in range(len(CLEAN))] == [True] * len(CLEAN)
    assert not any(got[i] for i in range(len(CLEAN), len(rows)))
    df = make_docs(rows + rows[:2])
    out = filter_quality(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == sorted([*range(len(CLEAN)), 0, 1])


def test_quality_of_no_rows(make_docs):
    none = make_docs([(1, "x")]).limit(0)
    assert quality_rules(none).count() == 0 and filter_quality(none).count() == 0


def test_em_recovers_accuracies():
    r = random.Random(4)
    truth = [r.random() < 0.2 for _ in range(4000)]
    rates = [(0.02, 0.8), (0.05, 0.6), (0.01, 0.7)]
    votes = {}
    for y in truth:
        v = tuple(int(r.random() < p[y]) for p in rates)
        votes[v] = votes.get(v, 0) + 1
    prior, found = fit(sorted(votes.items()))
    assert prior == pytest.approx(0.2, abs=0.03)
    assert all(a == pytest.approx(b, abs=0.06) for x, y in zip(found, rates, strict=True) for a, b in zip(x, y, strict=True))
    assert posterior_bad(prior, found, (1, 1, 0)) > 0.9 > 0.1 > posterior_bad(prior, found, (0, 0, 0))


# --- sharding --------------------------------------------------------------------------------------------------------------


def least_capacity(sizes, shards):
    def needs(c):
        n, held = 1, 0
        for s in sizes:
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needs(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize(("seed", "digits", "refined"), [(0, 3, 256), (1, 1, 1), (2, 1, 3)])
def test_shards_are_the_minimax_partition(make_docs, monkeypatch, seed, digits, refined):
    import hashlib

    monkeypatch.setattr("tessera.llm.sharding.DIGITS", digits)
    monkeypatch.setattr("tessera.llm.sharding.REFINED", refined)
    r = random.Random(seed)
    texts = ["é" * r.randint(0, 40) + str(r.randrange(60)) for _ in range(200)] + [None, "", "long " * 300]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = shard_documents(make_docs(rows), 5).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    assert {x["doc_id"]: (x["size"], x["text_crc32"]) for x in got} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t in rows}
    groups = {}
    for i, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + size[i]
    order = sorted(groups, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    shard = {(t or ""): None for _, t in rows}
    for x in got:
        t = texts[x["doc_id"]] or ""
        assert shard[t] in (None, x["shard"])
        shard[t] = x["shard"]
    assert [shard[t] for t in order] == sorted(shard[t] for t in order)
    load = {}
    for t in order:
        load[shard[t]] = load.get(shard[t], 0) + groups[t]
    assert max(load.values()) == least_capacity([groups[t] for t in order], 5)
    for s in load:
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))


def test_shards_are_evened_within_the_capacity():
    import numpy as np

    from tessera.llm.sharding import evened, greedy

    r = random.Random(9)
    for _ in range(50):
        ends = np.concatenate(([0], np.cumsum([r.randint(1, 9) for _ in range(200)])))
        capacity = least_capacity(list(np.diff(ends)), 6)
        cuts = evened(ends, capacity, 6)
        sizes = np.diff([0, *cuts])
        assert sizes.max() <= capacity and set(cuts) <= set(ends.tolist())
        if cuts[-1] == ends[-1]:
            assert sizes.min() >= np.diff([0, *greedy(ends, np.ones(200, bool), capacity, 6, False)]).min()


def test_shards_of_few_rows(make_docs):
    assert shard_documents(make_docs([(1, "x")]).limit(0), 4).count() == 0
    got = shard_documents(make_docs([(1, "x"), (1, "x"), (None, "x"), (2, "y")]), 4).collect()
    assert len(got) == 4 and len({x["shard"] for x in got if x["size"] and x["text_crc32"] == zlib.crc32(b"x")}) == 1


# --- mixing ----------------------------------------------------------------------------------------------------------------


def filled(sizes):
    """Targets by handing out the budget again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), {s for s in order if sizes[s]}
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + share * weight[s] >= 2 * sizes[s]}
        for s in open_:
            give = min(share * weight[s], 2 * sizes[s] - target[s])
            target[s] += give
            left -= give
        if not full:
            break
        open_ -= full
    return target


def test_mix_meets_its_targets(make_docs):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["a", "b", "b", "c", "c", "c", "c", "d", None])) for i in range(400)] + [(900, None, "z"), (901, "", "z")]
    got = mix_documents(make_docs(rows)).collect()
    sizes, taken, target = {}, {}, {}
    for x in got:
        s = x["source"]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + x["size"], taken.get(s, 0) + x["taken"], x["target"]
        assert x["taken"] in (0, x["size"], 2 * x["size"])
    assert all(x["source_size"] == sizes[x["source"]] for x in got)
    want = filled(sizes)
    assert all(target[s] == pytest.approx(want[s]) for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 31 for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mix_documents(make_docs(rows).repartition(5)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in again) == sorted((x["doc_id"], x["taken"]) for x in got)


@pytest.mark.parametrize("rows", [
    [(i, "w " * 10, "a") for i in range(50)] + [(100, "w " * 900, "b")] + [(200 + i, "w " * 10, "c") for i in range(20)],
    [(1, "w " * 100, "a"), (2, "w " * 100, "b")],
    [(1, "w " * 7, "a")],
    [(i, "w", "a") for i in range(9)] + [(20, "w " * 5000, "b"), (21, "w " * 3, "c"), (22, "w " * 4000, None)],
])
def test_mix_of_single_large_documents_equals_sql(make_docs, rows):
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = con.execute(f"select doc_id, size, taken from ({oracle_sql()['op4_mixing']})").fetchall()
    got = [(x["doc_id"], x["size"], x["taken"]) for x in mix_documents(make_docs(rows)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[2] for x in got) <= 1.5 * sum(x[1] for x in got)


def test_take_mix_repeats_rows(make_docs):
    rows = [(i, f"one two three {i}", "a" if i % 3 else "b") for i in range(40)]
    df = make_docs(rows)
    taken = {x["doc_id"]: x["taken"] // x["size"] for x in mix_documents(df).collect()}
    out = take_mix(df)
    assert out.columns == df.columns
    ids = [x["doc_id"] for x in out.collect()]
    assert {i: ids.count(i) for i in taken} == taken


def test_take_mix_tells_rows_of_one_id_apart(make_docs):
    """Ids that repeat across sources, null ids and rows that repeat as a whole: every row as often as the mix takes it."""
    r = random.Random(3)
    rows = [(r.choice([1, 2, 3, None]), "w " * r.randint(1, 30) + str(i // 2 * 2), r.choice(["a", "b", "c", None])) for i in range(120)]
    rows += [(7, "same words", "a")] * 9 + [(None, "same words", None)] * 5
    df = make_docs(rows)
    out = take_mix(df).collect()
    words, kept = {}, {}
    for x in mix_documents(df).collect():
        words[x["doc_id"], x["source"], x["size"]] = words.get((x["doc_id"], x["source"], x["size"]), 0) + x["taken"]
    for x in out:
        k = x["doc_id"], x["source"], len(x["text"].split())
        kept[k] = kept.get(k, 0) + k[2]
    assert kept == {k: v for k, v in words.items() if v}
    times = [sum(1 for y in out if tuple(y) == tuple(x)) for x in out if x["text"] == "same words" and x["doc_id"] == 7]
    assert not times or times[0] <= 18


def test_mix_of_no_rows(make_docs):
    assert mix_documents(make_docs([(1, "x")]).limit(0)).count() == 0
    assert [x["taken"] for x in mix_documents(make_docs([(1, None), (2, "")])).collect()] == [0, 0]
