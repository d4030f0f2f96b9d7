import random

import pytest

import corpus_pipeline
from tessera.llm.queries import oracle_sql, queries

from .test_native import base
from .test_neardup import brute
from .test_scans import edits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(r, n):
    return " ".join(r.choice(["the", "of", "and", "to", "in"]) if r.random() < 0.4 else f"word{r.randrange(4000)}" for _ in range(n))


def corpus(seed=1):
    r = random.Random(seed)
    bench = [(k, prose(r, 30)) for k in range(5)]
    rows = [(i, prose(r, r.randint(30, 120)), f"s{i % 4}") for i in range(160)]
    rows += [(200 + i, " ".join(f"junk{r.randrange(999)}***" for _ in range(60)), "s1") for i in range(20)]
    rows += [(300 + i, rows[i][1], "s2") for i in range(10)]
    rows += [(320 + i, rows[20 + i][1] + " one more", "s3") for i in range(10)]
    rows += [(400 + i, f"{prose(r, 40)} {bench[i][1]} {prose(r, 40)}", "s0") for i in range(5)]
    rows += [(500, None, "s0"), (501, "", None), (502, "too short", "s1")]
    return rows, bench


@pytest.fixture(scope="module")
def stages(spark, make_docs, tmp_path_factory):
    rows, bench = corpus()
    path = str(tmp_path_factory.mktemp("sf"))
    make_docs(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/out{k}")
        docs = spark.read.parquet(f"{path}/out{k}")
        seen.append((name, docs.columns, docs.collect()))
    return path, rows, bench, seen


def test_stages_keep_the_columns(stages):
    *_, seen = stages
    assert [s[0] for s in seen] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    assert all(cols == COLUMNS for _, cols, _ in seen[:-1])


def test_each_stage_decides_on_its_input(stages):
    _, rows, bench, seen = stages
    kept = [[(r["doc_id"], r["text"]) for r in out] for *_, out in seen[:4]]
    clean = {i for i, t, _ in rows if not base(t)[-1] and "***" not in t}
    assert {i for i, _ in kept[0]} == clean
    groups = {}
    for d, _, c in brute(kept[0], 5):
        groups.setdefault(c, []).append(d)
    assert sorted(i for i, _ in kept[1]) == sorted(min(g) for g in groups.values())
    leaked = {i for i, t in kept[1] for _, x in bench if edits(x.split(), t.lower().split()) <= int(0.2 * len(x.split()))}
    assert leaked and {i for i, _ in kept[2]} == {i for i, _ in kept[1]} - leaked
    times = {}
    for i, _ in kept[3]:
        times[i] = times.get(i, 0) + 1
    assert set(times) <= {i for i, _ in kept[2]} and set(times.values()) <= {1, 2}
    words = lambda ids: sum(len(t.split()) for i, t in ids)
    assert 1.4 * words(kept[2]) <= words(kept[3]) <= 1.5 * words(kept[2])
    slots = {}
    for r in seen[4][2]:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, slots.values())) == len(kept[3]) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_gives_the_last_stage(spark, stages):
    path, *_, seen = stages
    got = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, seen[4][2]), key=str)


def test_every_operator_is_registered():
    names = list(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    import math

    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    plain = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v):.6g}" if isinstance(v, int | float) else str(v)
    got = queries()[name](spark, sf)
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted(tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in got.collect()) == want
