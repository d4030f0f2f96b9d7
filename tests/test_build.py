import random

from pyspark.sql import functions as F

from tessera.plans import build as B
from tessera.sources import schemas, sinks


def actor(source, sid, name, aliases=(), origin=()):
    return (source, sid, name, list(aliases), list(origin), [], [], [], [], [], [], [], "2026-01-01")


def report(source, sid, title, day, url=None, sha1=None, names=(), cves=(), basis="url-date"):
    return (source, sid, title, day, basis, "Lab", url, None, sha1, list(names), [], list(cves), [], "2026-01-01")


ACTORS = [
    actor("attack", "G0001", "Red Fox", ["Vixen"], ["RU"]),
    actor("attack", "G0002", "Blue Owl", ["Night Bird"]),
    actor("alpha", "a1", "red-fox group", ["Swift"], ["CN"]),
    actor("beta", "b1", "Bridge", ["Vixen", "Night Bird"]),
    actor("beta", "b2", "SWIFT"),
    actor("gamma", "g1", "Alone"),
]
REPORTS = [
    report("alpha", "r1", "Fox strikes again", "2025-05-01", "https://www.a.com/x/", None, ["Red Fox", "Nobody"], ["CVE-2025-0001", "CVE-2029-0001"]),
    report("beta", "r2", "Fox strikes again.pdf", "2025-05-10", "https://b.com/y", "AB" * 20, ["Swift"]),
    report("beta", "r3", "Fox strikes again", "2025-07-30", "https://b.com/z"),
    report("alpha", "r4", None, None, "http://a.com/x", None, [], [], "unknown"),
    report("gamma", "r5", "Owl", "2024-05-01", "https://c.com/1", None, ["Blue Owl"]),
]


def made(spark, actors, reports):
    vulns = spark.createDataFrame([("CVE-2025-0001", "2025-06-01", True, "V", "P", None, None, "x"), ("CVE-2000-0001", "2025-06-01", None, None, None, None, None, "x")], schemas.VULNERABILITIES)
    policies = spark.createDataFrame([("attack", "full"), ("alpha", "full"), ("beta", "derived-only"), ("gamma", "full")], "source string, policy string")
    records = {"actors": spark.createDataFrame(actors, schemas.ACTORS), "reports": spark.createDataFrame(reports, schemas.REPORTS), "vulnerabilities": vulns}
    return records, policies


def test_build_end_to_end(spark, tmp_path):
    records, policies = made(spark, ACTORS, REPORTS)
    t = B.build(spark, records, policies, "2026-01-15", str(tmp_path / "out"))
    entities = {r["id"]: r for r in t["entities"].collect()}
    assert set(entities) == {"G0001", "G0002", "gamma:g1"}  # the bridge joins one anchor, by the first of two equal keys
    fox = entities["G0001"]
    assert fox["display_name"] == "Red Fox" and fox["sources"] == ["alpha", "attack", "beta"] and fox["origin_conflict"] == "CN|RU"
    assert [r["key"] for r in t["refused_keys"].collect()] == ["vixen"]
    facts = {r["id"]: r for r in t["reports"].collect()}
    merged = facts["ab" * 20]
    assert merged["merged_ids"] == ["alpha:r1", "alpha:r4", "beta:r2"] and merged["cves"] == ["CVE-2025-0001"]
    assert merged["entities"] == ["G0001"] and merged["unresolved"] == ["Nobody"] and str(merged["published"]) == "2025-05-01"
    assert len(facts) == 3
    v = {r["cve"]: r["n_reports"] for r in t["vulnerabilities"].collect()}
    assert v == {"CVE-2025-0001": 1, "CVE-2000-0001": 0}
    activity = {(r["entity"], r["quarter"]): (r["n"], r["n_year_ago"]) for r in t["activity"].collect()}
    assert activity[("G0001", "2025-Q2")] == (1, 0) and activity[("G0002", "2025-Q2")] == (0, 1)
    assert sinks.published(spark, str(tmp_path / "out"), "reports").count() == 3


def test_any_order_gives_the_same_tables(spark):
    a, r = list(ACTORS), list(REPORTS)
    first = None
    for seed in (1, 2):
        random.Random(seed).shuffle(a)
        random.Random(seed).shuffle(r)
        t = B.build(spark, *made(spark, a, r), "2026-01-15")
        got = {k: sorted(str(x) for x in t[k].collect()) for k in ("reports", "entities", "activity", "resolution")}
        assert first is None or got == first
        first = got


def test_site_names_do_not_merge(spark):
    rows = [report("alpha", f"s{i}", "My Blog", "2025-01-01", f"https://a.com/{i}") for i in range(4)]
    records, _ = made(spark, ACTORS, rows)
    assert B.cluster_reports(records["reports"]).select("cluster").distinct().count() == 4
    assert B.cluster_reports(records["reports"].where(F.col("source_id") < "s2")).select("cluster").distinct().count() == 1


def test_stated_names_and_guesses(spark):
    animals = [f"{a}{b}o" for a in "BDGKLM" for b in ("al", "er", "im")]
    actors = [actor("alpha", f"p{i}", f"{a}ta Panda", [f"UNC{2000 + i}"]) for i, a in enumerate(animals)] + ACTORS
    malware = [("alpha", f"s{i}", f"{a}mo Stealer", [], "malware", [], "x") for i, a in enumerate(animals)]
    reports = [*REPORTS, report("paper", "q1", "x", "2025-01-01", None, None, ["Vulpine Panda", "Balota Panda"]), report("alpha", "t1", "Meet Storm-4455 now", "2025-01-02", "https://p.com/2")]
    records, _ = made(spark, actors, reports)
    records["software"] = spark.createDataFrame(malware, schemas.SOFTWARE)
    records["pairs"] = spark.createDataFrame([("alpha", "Balota Panda", "Storm-7777", "d"), ("alpha", "Storm-7777", "Balota Panda", "e"), ("alpha", "Red Fox", "Blue Owl", "d"), ("alpha", "Storm-8888", "Lone Panda", "d"), ("alpha", "Balomo Stealer", "Storm-9999", "d")], "source string, name string, alias string, retrieved_at string")
    truth = [(n, "actor", "derived") for a in actors[: len(animals)] for n in (a[2], a[3][0])] + [(f"{a}mo Stealer", "malware", "derived") for a in animals] + [("Gone Panda", "actor", "derived"), ("Sure Thing", "malware", "confirmed"), ("Rogue Stealer", "malware", "pending"), ("Vulpine Panda", "malware", "pending")]
    records["labels"] = spark.createDataFrame(truth, "name string, label string, status string")
    _, registry = B.resolve_stated(records["actors"], records["reports"], records["software"], records["pairs"], records["labels"], {"Storm": "alpha"})
    names = {r["spelling"]: r["component"] for r in registry.names.collect()}
    assert names["Storm-7777"] == names["Balota Panda"]  # a bridge, stated twice
    assert names["Storm-8888"] == names["Lone Panda"]  # both sides are guessed to be an actor
    assert names["Storm-4455"] == "alpha:cluster:storm4455" and names["Red Fox"] != names["Blue Owl"] and "Storm-9999" not in names
    facts = spark.createDataFrame([(["Vulpine Panda", "Vulpine Panda group", "Rogue Stealer"],), (["Rogue Stealer", "Operation Fog", "Sure Thing", "Vulpine Panda"],)], "unresolved array<string>")
    t = B.guess_tables(registry, facts, records["reports"], records["software"], records["labels"])
    got = {r["name"]: r for r in t["guesses"].collect()}
    assert got["Vulpine Panda"]["n"] == 3 and got["Rogue Stealer"]["n"] == 2 and len(got) == 4
    assert (got["Vulpine Panda"]["label"], got["Rogue Stealer"]["label"], got["Operation Fog"]["label"]) == ("actor", "malware", "not-an-entity")
    assert got["Operation Fog"]["band"] == "unvalidated" and got["Operation Fog"]["confidence"] is None
    assert got["Sure Thing"]["band"] == "confirmed" and "Gone Panda" not in got
    weights = {e["signal"]: e["weight"] for e in got["Rogue Stealer"]["evidence"]}
    floor = {"high": 0.85, "medium": 0.7, "low": 0.0}
    assert weights["malware_word"] > 0 and all(r["confidence"] >= floor[r["band"]] for r in got.values() if r["band"] in floor)
    seen = t["guess_agreement"].first()
    assert (seen["compared"], seen["agree"], seen["rate"]) == (2, 1, 0.5)
    assert sum(r["n"] for r in t["guess_confusion"].collect()) == 3 * len(animals) + 1
