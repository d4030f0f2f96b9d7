import random
import re

import pytest

from tessera.llm import neardup
from tessera.llm.neardup import keep_one, near_duplicates


def word_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows, k):
    sets = [word_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d if d is not None else -1, len(sets[i]), least.get(root(i), -1)) for i, (d, _) in enumerate(rows))


def found(df, k):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in near_duplicates(df, k).collect())


def cloud(n, words, most, seed):
    """A text and n copies of it with up to a share of most words changed: many pairs lie close to the limit."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        x = list(base)
        for _ in range(r.randint(0, int(words * most))):
            x[r.randrange(words)] = f"v{r.randrange(10**6)}"
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_cloud_of_near_copies(make_docs, k):
    texts = cloud(150, 100, 0.25, 1) + cloud(40, 30, 0.2, 2) + [f"only {i} here {i * i} once" for i in range(40)]
    random.Random(3).shuffle(texts)
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    assert found(make_docs(rows).repartition(3), k) == brute(rows, k)


def test_defined_results(make_docs):
    rows = [(5, None), (6, ""), (7, " \n\t"), (1, "Same text here"), (2, "same TEXT  here"), (2, "same text here"), (9, "word"), (8, "Word"), (None, "same text here"), (3, "x " * 5000), (4, "y")]
    assert found(make_docs(rows), 2) == brute(rows, 2)
    kept = {r["doc_id"]: r["kept"] for r in near_duplicates(make_docs(rows), 2).collect() if r["doc_id"] is not None}
    assert kept[5] and kept[6] and kept[7] and kept[1] and not kept[2] and kept[8] and not kept[9]


def test_no_rows_and_no_pairs(make_docs):
    assert found(make_docs([(1, "a b c")]).limit(0), 2) == []
    assert found(make_docs([(1, "a b c"), (2, "d e f")]), 2) == [(1, 2, 1), (2, 2, 2)]


def test_keep_one_keeps_columns_and_one_row(make_docs):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words stand here now and then"), (4, ""), (5, None)]
    df = make_docs(rows)
    out = keep_one(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4, 5]


@pytest.mark.parametrize("words", [100, 600])
def test_tiles_compare_rows_without_sketch(spark, make_docs, monkeypatch, words):
    """One bucket holds no more than 254 shingles here: longer texts have no sketch, as very long ones have none otherwise."""
    monkeypatch.setattr(neardup, "SKETCH", 1)
    text = " ".join(f"w{i}" for i in range(words))
    docs = make_docs([(1, text), (2, text + " more"), (3, " ".join(f"v{i}" for i in range(words)))])
    docs = docs.select("doc_id", "text", neardup.row_key().alias("__key"))
    sets = neardup.document_sets(docs, 2)
    nodes = neardup._nodes(sets)
    members = nodes.selectExpr("node", "0 AS tree", "0L AS region", "3L AS n")
    mixed = neardup.mixed_members(members, nodes.selectExpr("node", "node AS comp"))
    found = neardup.tiled(mixed, nodes, neardup.member_sets(docs, nodes, members, 2), 80)
    ids = {bytes(r["node"]): r["doc_id"] for r in sets.collect()}
    assert [{ids[bytes(r["a"])], ids[bytes(r["b"])]} for r in found.collect()] == [{1, 2}]


def test_keep_one_judges_each_row(make_docs):
    same, near = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41))
    clean, other = " ".join(f"c{i}" for i in range(40)), " ".join(f"o{i}" for i in range(40))
    rows = [(1, same), (2, near), (2, clean), (3, other), (3, clean + " end"), (None, other), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "i j k l m n o"), (4, ""), (4, "")]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in keep_one(make_docs(rows)).collect())
    assert got == sorted([(1, same), (2, clean), (3, other), (0, "a b c d e f g h"), (0, "i j k l m n o"), (4, ""), (4, "")])


def test_long_paths_need_few_rounds(spark, monkeypatch):
    r = random.Random(2)
    names = [bytes(f"{k:05}", "ascii") for k in r.sample(range(10**5), 1200)]
    links = [(*sorted(p), k) for k, p in enumerate(zip(names[:1000], names[1:1000], strict=False))] + [(*sorted(p), -1) for p in zip(names[1000:], names[1001:], strict=False)]
    tables, written = [], neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df: tables.append(1) or written(df))
    got = {bytes(x["node"]): bytes(x["comp"]) for x in neardup.components(spark.createDataFrame(links, "a binary, b binary, run long").repartition(4)).collect()}
    assert got == {n: min(own) for own in (names[:1000], names[1000:]) for n in own}
    assert len(tables) <= 10


@pytest.mark.parametrize("most", [0, neardup.LINKS])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, most):
    """Few links are joined in one task with one table, however many partitions shuffles have; both ways agree."""
    r = random.Random(4)
    names = [bytes(f"{k:05}", "ascii") for k in r.sample(range(10**5), 700)]
    links = [(*sorted(p), k) for k, p in enumerate(zip(names[:500], names[1:500], strict=False))]
    links += [(*sorted((names[500], x)), -1) for x in names[501:700]] + links[:20] + [(*sorted((names[0], names[250])), -2)]
    tables, written = [], neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df: tables.append(1) or written(df))
    monkeypatch.setattr(neardup, "LINKS", most)
    got = neardup.components(spark.createDataFrame(links, "a binary, b binary, run long").repartition(7)).collect()
    assert len(got) == 700
    assert {bytes(x["node"]): bytes(x["comp"]) for x in got} == {n: min(own) for own in (names[:500], names[500:]) for n in own}
    assert not most or len(tables) == 1


def test_cloud_by_rounds(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "LINKS", 0)
    rows = list(enumerate(cloud(80, 100, 0.25, 1) + cloud(30, 30, 0.2, 2)))
    assert found(make_docs(rows).repartition(3), 2) == brute(rows, 2)


def test_few_stages_on_a_large_group_of_near_copies(spark, make_docs):
    """A stage costs as many tasks as shuffles have partitions. Rounds of labels made it 182 stages here; 101 are left."""
    rows = list(enumerate(cloud(150, 100, 0.25, 1)))
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextStageId()
    assert found(make_docs(rows), 2) == brute(rows, 2)
    assert scheduler.nextStageId() - before <= 140
