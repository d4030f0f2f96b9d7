import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import dates as D
from tessera.functions import text as T


def values(spark, expr, rows, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r["v"] for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_name_keys(spark):
    key = lambda c: T.name_key(T.fold_tokens(c))
    assert values(spark, key, ["Lazarus Group", "ＬＡＺＡＲＵＳ", "APT-28", "apt 2", "Team", "???", None, "Straße"]) == ["lazarus", "lazarus", "apt28", "apt2", "team", None, None, "strasse"]


def test_slugs(spark):
    assert values(spark, lambda c: T.slug(c), ["Café Łódź", "Группа", "A--b  C!"]) == ["cafe-lodz", "", "a-b-c"]
    assert values(spark, lambda c: T.fit_slug(c, F.lit(12), 8), ["abcd-efgh"]) == ["abcd-12"]


def test_url_keys_and_hosts(spark):
    assert values(spark, T.url_key, [" https://www.Example.com/a/ ", "http://example.com/a", None]) == ["example.com/a", "example.com/a", None]
    assert values(spark, T.registrable_domain, ["https://a.b.example.co.uk/x", "http://www.example.com", "nonsense"]) == ["example.co.uk", "example.com", None]
    assert values(spark, T.host_suffixes, ["https://a.b.com/"], "string") == [["a.b.com", "b.com", "com"]]


def test_titles(spark):
    cases = {
        "Microsoft Word - TR62.doc": "TR62",
        "PowerPoint Presentation": None,
        "404: This page could not be found.": None,
        "404 Keylogger Campaigns": "404 Keylogger Campaigns",
        "Anunak_APT_financial": "Anunak_APT_financial",
        "Anunak_APT_against_financial_institutions": "Anunak APT against financial institutions",
        "BKDR_SARHUST.A": "BKDR_SARHUST.A",
        "a%20b%20c.pdf": "a b c",
        "lab.example.com-The Story": "The Story",
        "  ": None,
    }
    assert values(spark, T.clean_title, list(cases)) == list(cases.values())


def test_titles_from_urls(spark):
    cases = {"https://x.com/en/2019/07/threat-spotlight-sodin": "Threat spotlight sodin", "https://x.com/a/12345": None, "https://x.com/some-long-name-34055a017e56": "Some long name", "https://x.com/showcard.cgi": None}
    assert values(spark, T.title_from_url, list(cases)) == list(cases.values())


def test_ids(spark):
    assert values(spark, T.find_cves, ["see cve-2021-44228, CVE‑2020‑0601 and XCVE-2020-0001", None]) == [["CVE-2020-0601", "CVE-2021-44228"], []]
    assert values(spark, T.find_techniques, ["T1059.001 T1059 AT1000"]) == [["T1059", "T1059.001"]]
    assert values(spark, T.find_techniques, ["T1059.00", "T1059.0015", "T1566abc", "_T1059", "T1566."]) == [[], [], [], [], ["T1566"]]
    assert values(spark, T.find_cves, ["CVE-2021-44228abc", "_CVE-2021-44228", "CVE-2021-44228."]) == [[], [], ["CVE-2021-44228"]]
    df = spark.createDataFrame([(["CVE-2021-0001", "CVE-2024-0001"], dt.date(2021, 5, 1)), (["CVE-2024-0001"], None)], "c array<string>, d date")
    assert [r[0] for r in df.select(T.possible_cves(F.col("c"), F.col("d"))).collect()] == [["CVE-2021-0001"], ["CVE-2024-0001"]]


@pytest.mark.parametrize(("a", "b", "d"), [("hafnuim", "hafnium", 1), ("abc", "abc", 0), ("ca", "abc", 3), ("abcd", "wxyz", 4), ("a", "abcdef", 4)])
def test_alignment_distance(a, b, d):
    assert T.alignment_distance(a, b, 3) == d


def test_variants_and_kinds(spark):
    v = values(spark, lambda c: T.spelling_variants(c), ["apt sidewinder", "Keyboys", "Foo (Bar Team)"])
    assert [{x["key"] for x in r} for r in v] == [{"sidewinder"}, {"keyboy"}, {"foo", "barteam", "bar"}]
    kind = lambda c: T.cluster_kind(T.fold_tokens(c))
    assert values(spark, kind, ["APT-C-15", "UNC 1234", "FIN7", "panda"]) == ["APT-C-NN", "UNC<number>", "FIN<number>", None]
    assert values(spark, lambda c: T.name_suffix(T.fold_tokens(c)), ["Fancy Bear", "Water Gamayun", "Bear", "ordinary"]) == ["bear", "water", "bear", None]
    assert values(spark, lambda c: T.malware_word(T.fold_tokens(c)), ["quasarrat", "Quasar RAT", "brat"]) == ["rat", "rat", None]
    assert values(spark, lambda c: T.script_of(c), ["abc", "Группа"]) == ["latin", "cyrillic"]


def test_alias_pairs(spark):
    got = values(spark, lambda c: T.alias_pairs(c), ["The Storm-3168 (also known as Silent Fox) struck. Silent Fox, aka Storm-3168, again.", "no names"])
    assert [[(p["name"], p["alias"]) for p in r] for r in got] == [[("Storm-3168", "Silent Fox")], []]
    got = values(spark, lambda c: T.alias_pairs(c, frozenset({"windows"})), ["Red Fox, aka Windows Fox", "Red Fox, aka Blue Fox"])
    assert [[(p["name"], p["alias"]) for p in r] for r in got] == [[], [("Red Fox", "Blue Fox")]]


def test_dates(spark):
    d = dt.date
    cases = {"2024-02-29": d(2024, 2, 29), "2024-02-30": None, "0001-01-01": None, "2021-05": d(2021, 5, 1), "1989-01-01": None, "x": None}
    assert values(spark, D.parse_date, list(cases)) == list(cases.values())
    got = values(spark, D.split_title_date, ["2020-01-02 - 2019-03-04 - Name", "2020-13-01 - Name", "Name - 2020-01-01"])
    assert [(r["title"], r["day"]) for r in got] == [("Name", d(2020, 1, 2)), ("Name", None), ("Name - 2020-01-01", None)]
    cases = {"https://a.com/2021/05/31/x": d(2021, 5, 31), "https://a.com/2021/05/x": d(2021, 5, 1), "https://a.com/wp-content/uploads/2021/05/x.pdf": None, "https://web.archive.org/web/20200101000000/https://a.com/2019/02/03/": d(2019, 2, 3)}
    assert values(spark, D.url_date, list(cases)) == list(cases.values())
    assert values(spark, D.capture_date, ["https://web.archive.org/web/20200102030405/https://a.com"]) == [d(2020, 1, 2)]
    assert values(spark, D.mail_date, ["Tue, 05 Mar 2024 23:30:00 -0800"]) == [d(2024, 3, 5)]
    assert [(r["day"], r["basis"]) for r in values(spark, D.claim_date, ["2019", "2019-04-05", "1889", "x"])] == [(d(2019, 1, 1), "year"), (d(2019, 4, 5), "date"), (None, None), (None, None)]


def test_ranked_dates(spark):
    d = dt.date
    rows = [
        (d(2020, 1, 1), None, None, None, None, d(2021, 1, 1), d(2020, 1, 1), "library"),
        (d(2018, 1, 1), None, d(2020, 1, 1), None, None, None, d(2020, 1, 1), "url-date"),
        (None, d(2022, 1, 1), None, d(2019, 1, 1), None, d(2021, 1, 1), d(2019, 1, 1), "file-metadata"),
        (None, None, None, None, d(2020, 5, 5), d(2021, 1, 1), d(2020, 5, 5), "capture"),
        (None, None, None, None, None, d(2021, 1, 1), d(2021, 1, 1), "ingest"),
        (None, None, None, None, None, None, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "a date, b date, c date, d date, e date, f date, day date, basis string")
    got = df.select(D.ranked_date(*[F.col(x) for x in "abcdef"]).alias("r"), "day", "basis").collect()
    assert all(g["r"]["day"] == g["day"] and g["r"]["basis"] == g["basis"] for g in got)


@pytest.mark.parametrize(("day", "start"), [("2026-07-01", "2024-07-01"), ("2026-08-15", "2024-07-01"), ("2024-02-29", "2022-01-01"), ("2025-12-31", "2023-10-01"), ("2025-01-01", "2023-01-01")])
def test_window_start(spark, day, start):
    assert str(values(spark, lambda c: D.window_start(c.cast("date")), [day])[0]) == start


def test_arrays(spark):
    assert [x["phrase"] for x in values(spark, lambda c: A.ngrams(F.split(c, " "), 2), ["a b c"])[0]] == ["a", "b", "c", "a b", "b c"]
    assert values(spark, lambda c: A.contains_run(F.split(c, " "), F.array(F.lit("b"), F.lit("c"))), ["a b c", "ab c", "b x c"]) == [True, False, False]
    assert values(spark, A.mask_positions, [5, 0, 2**40], "long") == [[0, 2], [], [40]]
    assert values(spark, A.text_or_list, ['["a", " b ", "a"]', '"one"', None]) == [["a", "b"], ["one"], None]
    assert values(spark, lambda c: A.ratio(c, F.lit(0)), [1.0], "double") == [None]
