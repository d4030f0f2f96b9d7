import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import guesses as G
from tessera.operators import publishers as P
from tessera.operators import shapes as S
from tessera.operators import stats
from tessera.sources import connectors


def test_signals_and_labels(spark):
    names = spark.createDataFrame([(n,) for n in ("apt sidewinder", "Hafnuim", "Quasarrat", "UNC1234", "unknown", "Operation X", "Red Fox Squad", "Loadr")], "name string")
    actors = spark.createDataFrame([("sidewinder", "SideWinder", "A1"), ("hafnium", "HAFNIUM", "A2"), ("redfox", "Red Fox", "A3")], "key string, spelling string, target string")
    software = spark.createDataFrame([("loader", "Loader", "tool")], "key string, spelling string, target string")
    rows = spark.createDataFrame([(1, "quasarrat", None), (1, "redfox", "A3"), (2, "unc1234", None), (3, "redfox", "A3")], "row int, key string, actor string")
    cves = spark.createDataFrame([(2, "CVE-1"), (3, "CVE-1")], "row int, cve string")
    contexts = spark.createDataFrame([("quasarrat", 3, 0)], "key string, malware_titles int, actor_titles int")
    got = {r["name"]: r for r in G.signals(names, actors, software, rows, cves, contexts).collect()}
    assert got["apt sidewinder"]["like_actor"] == "A1" and got["apt sidewinder"]["actor_resemblance"] == 1.0
    assert got["Hafnuim"]["like_actor"] == "A2" and got["Red Fox Squad"]["actor_resemblance"] == 0.9
    assert got["Loadr"]["like_software"] == "tool" and got["UNC1234"]["cluster_id"] == 1.0
    assert got["Quasarrat"]["cooc_actor"] == 1.0 and got["UNC1234"]["cve_actor"] == 1.0 and got["Quasarrat"]["title_malware_ctx"] == 1.0
    scored = spark.createDataFrame(list(got.values()))
    out = {r["name"]: (r["label"], r["rule"]) for r in G.decided(scored, [-2.0, 5.0, 5.0], ["malware_word", "software_resemblance"]).collect()}
    assert out["unknown"] == ("not-an-entity", "placeholder_word") and out["Operation X"] == ("not-an-entity", "campaign_word")
    assert out["Quasarrat"] == ("malware", None) and out["Loadr"] == ("tool", None) and out["UNC1234"] == ("actor", None)


def test_pair_decisions(spark):
    pairs = spark.createDataFrame([("Storm-1", "Red Fox"), ("Bite", "Red Fox"), ("Red Fox", "Vixen"), ("Red Fox", "Blue Owl"), ("Storm-22", "Nobody"), ("Some", "Body")], "name string, alias string")
    keys = spark.createDataFrame([("redfox", "E1"), ("vixen", "E1"), ("blueowl", "E2")], "key string, component string")
    software = spark.createDataFrame([("bite", "malware")], "key string, kind string")
    shown = spark.createDataFrame([("E1",), ("E2",)], "component string")
    guessed = spark.createDataFrame([("Storm-22", "actor"), ("Nobody", "actor"), ("Some", "actor"), ("Body", "actor")], "name string, label string")
    got = {(r["primary"], r["alias"]): (r["kind"], r["accepted"]) for r in G.pair_decisions(pairs, keys, software, shown, guessed).collect()}
    assert got == {("Red Fox", "Storm-1"): ("bridge", True), ("Bite", "Red Fox"): ("software", False), ("Red Fox", "Vixen"): ("known-same", False), ("Red Fox", "Blue Owl"): ("known-different", False), ("Nobody", "Storm-22"): ("new", True), ("Some", "Body"): ("new", False)}


@pytest.mark.parametrize(("title", "want"), [
    ("New Ironbite Stealer sold", [("ironbite", "malware", "Ironbite")]),
    ("Tracking Storm 0558 and APT C 36", [("storm0558", "id", "Storm-0558"), ("aptc36", "id", "APT-C-36")]),
    ("Mustang Panda returns", [("mustangpanda", "suffix", "Mustang Panda")]),
    ("the WhisperGate files", [("whispergate", "camel", "WhisperGate")]),
    ("Velora threat actor seen", [("velora", "context", "Velora")]),
    ("quiet words only", []),
])
def test_shapes(title, want):
    assert [(r["key"], r["shape"], r["spelling"]) for r in S.shapes_of(title, frozenset({"new", "tracking"}))] == want


def test_repeated_names(spark):
    titles = spark.createDataFrame([(i, f"Ironbite stealer part {i}") for i in range(3)] + [(9, "Known stealer")], "i int, t string")
    got = S.repeated_names(S.name_shapes(titles, "i", "t"), "i", spark.createDataFrame([("known",)], "key string")).collect()
    assert [(r["key"], r["n_titles"]) for r in got] == [("ironbite", 3)]
    assert {r["w"] for r in S.ordinary_words(titles, "t", 3).collect()} == {"stealer", "part"}


def test_publishers_links_countries(spark):
    df = spark.createDataFrame([(1, "https://blog.lab.com/x"), (2, "https://other.org"), (3, "ftp://x"), (4, "https://github.com/Mirror/y")], "i int, u string")
    hosts = spark.createDataFrame([("lab.com", "Lab"), ("com", "Any")], "host string, value string")
    assert {r["i"]: r["p"] for r in P.by_host(df, "u", hosts, "p").collect()} == {1: "Lab", 2: None, 3: None, 4: "Any"}
    kinds = {r["i"]: r["link_kind"] for r in P.classify_links(df, "u", hosts.where("value = 'Lab'").withColumn("value", F.lit("vendor")), {"github.com": "mirror"}).collect()}
    assert kinds == {1: "vendor", 2: "publisher", 3: "invalid", 4: "mirror"}
    table = spark.createDataFrame([("GB", "United Kingdom"), ("GB", "UK"), ("CI", "Côte d'Ivoire"), ("NL", "Netherlands")], "code string, name string")
    seen = spark.createDataFrame([("uk",), ("gb",), ("cote d'ivoire",), ("The Netherlands",), ("Worldwide",)], "c string")
    assert {r["c"]: r["k"] for r in P.country_codes(seen, "c", table, "k").collect()} == {"uk": "GB", "gb": "GB", "cote d'ivoire": "CI", "The Netherlands": "NL", "Worldwide": None}
    said = spark.createDataFrame([(1, "Attacks on British firms", ["GB", "FR"])], "i int, t string, p array<string>")
    words = spark.createDataFrame([("british", "GB"), ("france", "FR")], "phrase string, entity string")
    assert P.grounded(said, "i", "t", "p", words).first()["p"] == ["GB"]


def test_connectors_gather(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"Threat actor name": "Fox", "Origin/Threat": "Russia", "Other names": "Vixen"}]))
    records, counts = connectors.gather(spark, {"names": {"names": str(tmp_path / "t.json")}}, "2026-01-01")
    r = records["actors"].first()
    assert (r["source"], r["name"], r["aliases"], r["techniques"]) == ("names", "Fox", ["Vixen"], []) and records["reports"].count() == 0
    assert [tuple(x) for x in counts.collect()] == [("names", 3, "actors", 1)]
    with pytest.raises(ValueError, match="unknown columns extra"):
        connectors.as_records(spark.createDataFrame([("x", 1)], "name string, extra int"), "actors", "s", "d")


def test_confidences_without_the_row_itself():
    rng = np.random.default_rng(5)
    raw, fired = rng.uniform(0.5, 1, 60), rng.random(60) < 0.8
    ok = rng.random(60) < raw
    got, shares, silent = G.held_out(raw, ok, fired)
    for i in range(60):
        rest = np.arange(60) != i
        _, some, quiet = G.held_out(raw[rest], ok[rest], fired[rest])
        assert got[i] == (some[int(raw[i] >= 0.7) + int(raw[i] >= 0.85)] if fired[i] else quiet)
    assert shares == sorted(shares) and 0 < silent < 1


@pytest.mark.parametrize(("high", "medium", "want"), [((20, 20), (20, 15), ["high", "medium"]), ((19, 19), (1, 0), ["medium"]), ((20, 16), (0, 0), ["medium"]), ((20, 20), (19, 19), ["high"]), ((0, 0), (0, 0), [])])
def test_bands_need_names_and_precision(high, medium, want):
    conf = np.array([0.9] * high[0] + [0.75] * medium[0])
    ok = np.array([i < high[1] for i in range(high[0])] + [i < medium[1] for i in range(medium[0])], bool)
    assert G.granted_bands(conf, ok, np.ones(len(ok), bool)) == want


def test_title_contexts(spark):
    titles = spark.createDataFrame([(1, "Red Fox stealer and Red-Fox Stealers"), (2, "malware Redfox"), (3, "Red Fox threat actor"), (4, "actors Red Fox"), (5, None), (6, "")], "i int, t string")
    keys = spark.createDataFrame([("redfox",), ("none",)], "key string")
    assert [tuple(r) for r in S.title_contexts(titles, "i", "t", keys).collect()] == [("redfox", 2, 2)]


def test_fold_probabilities(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] + rng.normal(size=120) > 0).astype(float)
    rows = [(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(120)] + [(200, None, 1.0, 1.0), (201, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "i long, y double, a double, b double")
    got = {r["i"]: r["p"] for r in stats.fold_probabilities(df, "i", "y", ["a", "b"], folds=3).collect()}
    fold = {r["i"]: r["f"] for r in df.selectExpr("i", "pmod(xxhash64(i), 3) AS f").collect()}
    for f in range(3):
        rest = np.array([fold[i] != f for i in range(120)])
        w = stats.newton_fit(x[rest], y[rest])
        for i in np.flatnonzero(~rest):
            assert abs(got[i] - 1 / (1 + np.exp(-(w[0] + x[i] @ w[1:])))) < 1e-9
    assert set(got) == set(range(120))
