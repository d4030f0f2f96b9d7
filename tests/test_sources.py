import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, sinks


def test_graph_bundle(spark, tmp_path):
    ref = lambda n, u=None: {"source_name": "catalogue" if u is None else "other", "external_id": n, "url": u}
    objects = [
        {"id": "g1", "type": "intrusion-set", "name": "Fox", "aliases": ["Fox", "Red Fox"], "external_references": [ref("G0001"), ref(None, "https://a.com")]},
        {"id": "g2", "type": "intrusion-set", "name": "Gone", "revoked": True},
        {"id": "m1", "type": "malware", "name": "Bite"},
        {"id": "t1", "type": "attack-pattern", "name": "Phish", "external_references": [ref("T1566")]},
        {"id": "r1", "type": "relationship", "relationship_type": "uses", "source_ref": "g1", "target_ref": "m1", "external_references": [ref(None, "https://b.com")]},
        {"id": "r2", "type": "relationship", "relationship_type": "uses", "source_ref": "g1", "target_ref": "t1"},
        {"id": "r3", "type": "relationship", "relationship_type": "uses", "source_ref": "g2", "target_ref": "m1"},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"objects": objects}))
    (tmp_path / "b.json").write_text(json.dumps({"objects": [{"id": "m1", "type": "malware", "name": "Other"}]}))
    live, rels = readers.graph_bundle(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert {r["id"] for r in rels.collect()} == {"r1", "r2"}
    (actor,) = readers.graph_actors(live, rels, "catalogue").collect()
    assert (actor["source_id"], actor["aliases"], actor["malware"], actor["techniques"], actor["urls"]) == ("G0001", ["Red Fox"], ["Bite"], ["T1566"], ["https://a.com", "https://b.com"])
    assert [r["id"] for r in readers.valid_ids(live, r"^T\d{4}$").collect()] == ["T1566"]


def test_clusters_cards_tables(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"values": [{"uuid": "u", "value": " Red  Fox ", "meta": {"synonyms": ["A", "A", "B"], "country": "RU"}}]}))
    (r,) = readers.name_clusters(spark, str(tmp_path / "c.json")).collect()
    assert (r["name"], r["aliases"], r["origin"]) == ("Red Fox", ["A", "B"], ["RU"])
    (tmp_path / "d.json").write_text(json.dumps({"values": [{"uuid": "1", "actor": "X, Y ,Z"}, {"uuid": "2", "names": [{"name": "P"}, {"name": "Q"}]}]}))
    assert sorted((r["name"], tuple(r["aliases"])) for r in readers.name_cards(spark, str(tmp_path / "d.json")).collect()) == [("P", ("Q",)), ("X", ("Y", "Z"))]
    (tmp_path / "t.json").write_text(json.dumps([{"Threat actor name": "Fox", "Origin/Threat": "Russia, Group in development", "Other names": "fox, Vixen"}]))
    (r,) = readers.name_table(spark, str(tmp_path / "t.json"), ("group in development",)).collect()
    assert (r["origin"], r["aliases"]) == (["Russia"], ["Vixen"])


def test_catalogue_and_scores(spark, tmp_path):
    v = [{"cveID": "cve-2021-0001", "knownRansomwareCampaignUse": "Known", "dateAdded": "2021-02-03"}, {"cveID": "CVE-2021-0001"}, {"cveID": "bad"}, {"cveID": "CVE-2021-0002", "knownRansomwareCampaignUse": "Unknown"}]
    (tmp_path / "k.json").write_text(json.dumps({"vulnerabilities": v}))
    got = {r["cve"]: (str(r["date_added"]), r["ransomware"]) for r in readers.exploited_catalogue(spark, str(tmp_path / "k.json")).collect()}
    assert got == {"CVE-2021-0001": ("2021-02-03", True), "CVE-2021-0002": ("None", None)}
    with gzip.open(tmp_path / "s.csv.gz", "wt") as f:
        f.write("#model:v1\ncve,epss,percentile\nCVE-2021-0001,0.5,0.9\nCVE-2021-0002,1.5,0.9\nx,0.1,0.1\n")
    assert [tuple(r) for r in readers.score_file(spark, str(tmp_path / "s.csv.gz")).collect()] == [("CVE-2021-0001", 0.5, 0.9)]


def test_lines(spark, tmp_path):
    (tmp_path / "l.ndjson").write_text('{"a": 1, "b": "x"}\nnot json\n\n{"a": 2}\n')
    good, bad = readers.refused_json_lines(spark, str(tmp_path / "l.ndjson"), "a INT, b STRING")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1
    (tmp_path / "b.bib").write_text("@online{one,\n  title = {{A Title}},\n  url = {https://WWW.a.com/x/},\n  urldate = {2022-01-01},\n  date = {2020-01-02},\n}\n@online{two,\n  url = {http://a.com/x},\n  date = {2019-05-06},\n}\n")
    entries = readers.bibliography(spark, str(tmp_path / "b.bib"))
    assert {(r["entry"], r["field"]): r["value"] for r in entries.collect()}[("one", "title")] == "A Title"
    assert [(r["url_key"], str(r["day"])) for r in readers.library_dates(entries).collect()] == [("a.com/x", "2019-05-06")]
    (tmp_path / "p.md").write_text("intro\n| source | quote | publish |\n|---|---|---|\n| `alpha` | a \\| b | full |\n| beta | x | Evidence-only |\n")
    assert sorted(tuple(r) for r in readers.markdown_policies(spark, str(tmp_path / "p.md")).collect()) == [("alpha", "full"), ("beta", "evidence-only")]


def test_feed(spark, tmp_path):
    item = "<item><title>UAT-11587 &amp;amp; friends</title><link>{}</link><pubDate>Tue, 05 Mar 2024 23:30:00 -0800</pubDate><description>Silent Fox (also known as UAT-11587) used CVE-2024-12345</description></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + item.format("https://b.com/blog/a/") + item.format("ftp://no") + "</channel></rss>")
    items = readers.feed_items(spark, str(tmp_path / "f.xml"))
    (r,) = readers.feed_reports(items, "talos", "/blog", {"UAT": "talos"}).collect()
    assert (r["source_id"], str(r["published"]), r["cves"], r["clusters"], r["pairs"][0]["alias"]) == ("b-com-blog-a", "2024-03-05", ["CVE-2024-12345"], ["UAT-11587"], "UAT-11587")


def test_quoted_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Name,Cell\nx,"two\nlines, one ""cell"""\n')
    assert readers.quoted_csv(spark, str(tmp_path / "q.csv"), ["Name"]).first()["Cell"] == 'two\nlines, one "cell"'
    with pytest.raises(ValueError, match="missing columns: Other"):
        readers.quoted_csv(spark, str(tmp_path / "q.csv"), ["Other"])


def test_snapshots(spark, tmp_path):
    for day, size in (("2024-01-01", 10), ("2024-02-01", 4)):
        (tmp_path / "src" / day).mkdir(parents=True)
        (tmp_path / "src" / day / "a.json").write_text("x" * size)
    (tmp_path / "src" / "2024-01-01" / "b.json").write_text("y")
    got = {r["file"]: (r["day"], r["bytes"]) for r in readers.latest_snapshots(spark, str(tmp_path), "src").collect()}
    assert got == {"a.json": ("2024-02-01", 4), "b.json": ("2024-01-01", 1)}
    assert not readers.may_replace(10, 4) and readers.may_replace(None, 0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020-01-01", "x"), (2, None, "y"), (3, "2021-01-01", "x")], "id int, d string, o string").withColumn("d", F.col("d").cast("date"))
    path = sinks.write_shards(df, "d", str(tmp_path / "shards"))
    assert [r["id"] for r in sinks.read_shards(spark, path, ["undated"]).collect()] == [2]
    with pytest.raises(ValueError, match="missing shards: 1999"):
        sinks.read_shards(spark, path, ["1999"])
    coded, tables = sinks.coded_index(df, ["o"])
    doc = json.loads(sinks.index_document(coded, ["id"], tables, "v1"))
    assert doc["rows"]["o"] == [0, 1, 0] and doc["tables"]["o"] == ["x", "y"]
    sinks.publish(spark, {"t": df}, str(tmp_path / "out"), [])
    bad = spark.createDataFrame([("rule", "item")], "rule string, item string")
    with pytest.raises(ValueError):
        sinks.publish(spark, {"t": df.limit(0)}, str(tmp_path / "out"), [bad])
    assert sinks.published(spark, str(tmp_path / "out"), "t").count() == 3
    assert sinks.manifest(spark, str(tmp_path / "shards")).count() == 3


def test_notice_carries_its_credits(spark):
    from tessera.operators.checks import missing_text

    credits = spark.createDataFrame([(2, "beta", "by B"), (1, "alpha", "by A")], "ord int, source string, credit string")
    text = sinks.notice(credits, "Credits")
    assert text == "Credits\n\nalpha: by A\nbeta: by B\n"
    df = spark.createDataFrame([("NOTICE", text)], "f string, t string")
    assert missing_text("credit", df, "f", "t", ["by A", "by B"]).count() == 0
    assert [r["item"] for r in missing_text("credit", df, "f", "t", ["by C"]).collect()] == ["NOTICE"]
