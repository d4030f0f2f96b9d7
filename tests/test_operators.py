import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import ascii_tokens
from tessera.operators import checks, dedupe, facets, graph, match, rollup, series, stats, topk


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_first_wins_and_upsert(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, n int, v string")
    assert rows(dedupe.first_wins(df, ["k"], [F.col("n")])) == [("a", 1, "y"), ("b", 3, None)]
    new = spark.createDataFrame([("a", 9, "new"), ("c", 1, "z")], "k string, n int, v string")
    assert rows(dedupe.upsert(df, new, ["k"], [F.col("n")])) == [("a", 9, "new"), ("b", 3, None), ("c", 1, "z")]


def test_silence_and_future_rows(spark):
    df = spark.createDataFrame([("a", "2020-02-01"), ("a", "2021-05-01"), ("b", "2021-02-01"), ("b", None)], "e string, d string").withColumn("d", F.col("d").cast("date"))
    got = rows(series.year_over_year(df, "e", "d"))
    assert ("a", "2021-Q1", 0, 1) in got and ("b", "2021-Q1", 1, 0) in got and not any(q > "2021-Q2" for _, q, *_ in got)


@pytest.mark.parametrize("seed", range(3))
def test_components_any_order(spark, seed):
    r = random.Random(seed)
    n, pairs = 60, [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    edges = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "src long, dst long")
    got = rows(graph.connected_components(spark.range(n).toDF("node"), edges))
    assert got == [(i, root(i)) for i in range(n)]


def brute_anchored(carriers):
    nodes = sorted({c[0] for c in carriers})
    comp = {n: {n} for n in nodes}
    anchors = {c[0] for c in carriers if c[2]}
    keys, refused = {}, []
    for n, k, _, named in carriers:
        keys.setdefault(k, {}).setdefault(n, False)
        keys[k][n] |= named
    order = sorted((not any(n in anchors for n in ns), -min(sum(ns.values()), 2), k) for k, ns in keys.items() if len(ns) > 1)
    for *_, k in order:
        whole = set().union(*(comp[n] for n in keys[k]))
        if len(whole & anchors) > 1:
            refused.append(k)
            continue
        for n in whole:
            comp[n] = whole
    return sorted((n, min(comp[n])) for n in nodes), sorted(refused)


@pytest.mark.parametrize("seed", range(4))
def test_anchored_components(spark, seed):
    r = random.Random(seed)
    flags = {f"n{i:02}": r.random() < 0.2 for i in range(30)}
    carriers = [(n, f"k{r.randrange(25)}", flags[n], r.random() < 0.4) for n in flags for _ in range(3)]
    df = spark.createDataFrame(carriers, "node string, key string, a boolean, m boolean")
    comps, refused = graph.anchored_components(df, F.col("a"), F.col("m"))
    want, lost = brute_anchored(carriers)
    assert rows(comps, "node", "component") == want
    assert sorted(r["key"] for r in refused.collect()) == lost


def test_redirects(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c")], "s string, t string")
    assert rows(graph.redirect_targets(df, "s", "t")) == [("a", "c", False), ("b", "c", False), ("d", "c", False)]
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y")], "s string, t string")
    assert rows(graph.redirect_targets(loop, "s", "t"), "node", "in_cycle") == [("a", True), ("b", True), ("x", False)]


def test_identity_carries_over(spark):
    old = spark.createDataFrame([("fox", 1, "r1"), ("fox", 1, "r2"), ("owl", 2, "r3"), ("bat", 3, "r9")], "slug string, rank int, anchor string")
    new = spark.createDataFrame([("e1", "r1"), ("e1", "r2"), ("e1", "r3"), ("e2", "r4")], "entity string, anchor string")
    got = {(r["entity"], r["slug"], r["status"], r["merged_into"]) for r in graph.carry_identity(old, new).collect()}
    assert got == {("e1", "fox", "kept", None), ("e2", None, "new", None), (None, "owl", "merged", "fox"), (None, "bat", "retired", None)}


def test_longest_phrase_first_and_consumed_words(spark):
    docs = spark.createDataFrame([(1, "the red fox team met red fox and fox loader"), (2, "fox")], "d int, t string").withColumn("w", ascii_tokens(F.col("t")))
    words = spark.createDataFrame([("red fox", "E1"), ("red fox team", "E2"), ("fox", "E3"), ("fox loader", None)], "phrase string, entity string")
    got = rows(match.phrase_mentions(docs, "d", "w", words), "d", "phrase", "entity", "n", "first_at")
    assert got == [(1, "red fox", "E1", 1, 5), (1, "red fox team", "E2", 1, 1), (2, "fox", "E3", 1, 0)]


def test_fuzzy_join_against_all_pairs(spark):
    from tessera.functions.text import alignment_distance

    r = random.Random(5)
    keys = sorted({"".join(r.choice("abc1") for _ in range(r.randint(5, 9))) for _ in range(150)})
    digits = lambda x: "".join(c if c.isdigit() else " " for c in x).split()
    want = [(a, b) for a in keys for b in keys if a != b and digits(a) == digits(b) and (d := alignment_distance(a, b, 2)) <= 2 and 1 - d / max(len(a), len(b)) >= 0.8]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert rows(match.fuzzy_join(df, df, "key"), "left_key", "right_key") == want


def test_filters_round_trip_and_truth_table(spark):
    f = facets.Filters.parse("words=red+fox&since=2020-01-01&until=nonsense&kev=1&page=3")
    assert f == facets.Filters(words="red fox", since="2020-01-01", kev=True) and facets.Filters.parse(f.query()) == f
    df = spark.createDataFrame([(1, "2020-01-01", "2020-06-01"), (2, "2020-01-01", None), (3, None, None), (4, "2021-01-01", "2021-01-01")], "id int, s string, e string")
    df = df.select("id", F.col("s").cast("date").alias("start"), F.col("e").cast("date").alias("end"))
    ids = lambda **k: [r["id"] for r in facets.explore(df, facets.Filters(**k)).orderBy("id").collect()]
    assert ids() == [1, 2, 4]
    assert ids(since="2020-07-01", until="2020-12-31") == [2]
    assert ids(since="2020-07-01", until="2020-12-31", undated=True) == [2, 3]
    p = facets.Page(99, 10, 41)
    assert (p.pages, p.current, p.around()) == (5, 5, [3, 4, 5])


def test_capped_equals_greedy(spark):
    r = random.Random(2)
    data = [(i, f"h{r.randrange(4)}", r.random()) for i in range(60)]
    got = [x["i"] for x in topk.capped(spark.createDataFrame(data, "i int, h string, v double"), "h", [F.col("v")], 5, 17).collect()]
    used, want = {}, []
    for i, h, _ in sorted(data, key=lambda x: x[2]):
        if used.get(h, 0) < 5 and len(want) < 17:
            used[h] = used.get(h, 0) + 1
            want.append(i)
    assert got == want


def test_round_robin_joint_cap(spark):
    data = [(s, p, i) for i, (s, p) in enumerate([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "y"), ("c", "x")])]
    got = topk.round_robin(spark.createDataFrame(data, "s string, p string, i int"), "s", "p", ["i"], 2, 10).orderBy("place").collect()
    assert [(r["s"], r["p"]) for r in got] == [("a", "x"), ("b", "x"), ("a", "y"), ("b", "y")]


def test_conflicts(spark):
    data = [("e", "s1", "RU"), ("e", "s2", "RU"), ("e", "s2", "CN"), ("f", "s1", "RU"), ("f", "s2", "CN"), ("g", "s1", "RU")]
    df = spark.createDataFrame(data, "e string, s string, v string")
    assert rows(checks.attribute_conflicts(df, "e", "s", "v")) == [("f", 2, "CN|RU")]


def test_refusal_names_the_rule(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="twice: 1"):
        checks.refuse_if_any(checks.repeated_key("twice", df, "k"))


def test_prefix_length(spark):
    df = spark.createDataFrame([("abcd0123456",), ("abcd0123457",), ("abcd0123457",), ("zz",)], "i string")
    assert rollup.shortest_prefix(df, "i", 4).first()[0] == 11


def test_leave_one_out_matches_direct_fits(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(30, 2))
    y = (x[:, 0] + r.normal(size=30) > 0).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(30)], "i int, y double, a double, b double")
    got = {k["i"]: k["p"] for k in stats.leave_one_out(df, "i", "y", ["a", "b"], folds_per_task=7).collect()}
    for k in range(30):
        w = stats.newton_fit(np.delete(x, k, 0), np.delete(y, k))
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(w[0] + x[k] @ w[1:]))))


def test_calibration_rises(spark):
    df = spark.createDataFrame([(p / 10, bool(p % 3)) for p in range(10)] * 4, "p double, ok boolean")
    c = [r["calibrated"] for r in stats.calibration_bins(df, "p", F.col("ok")).orderBy("bin").collect()]
    assert c == sorted(c)
