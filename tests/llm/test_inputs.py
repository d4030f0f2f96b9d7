"""Extra columns, clashing names, nulls and empty tables for every operator."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, licenses, linededup, lm, mixing, neardup, quality, secretscan, sharding, toxicity

CLASHING = ("row", "node", "sig", "size", "taken", "kept", "score", "__id", "__place", "__q_words", "words", "tree", "key", "n", "copy", "a.b", "id", "times", "empty", "digest", "shard", "target")


@pytest.fixture(scope="module")
def wide(make_docs):
    text = "the cat and the dog of the house went to see the river in the sun and it was good for them all day long"
    rows = [(1, text), (1, text), (2, text + " indeed"), (3, None), (4, ""), (None, "some text"), (5, "x " * 3000), (6, "licensed under CC BY 4.0.")]
    df = make_docs(rows)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def net():
    return secretscan.trained(600)


def row_operators(spark, net):
    bench = spark.createDataFrame([(1, "went to see the river in the sun"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    return {
        "lm": lm.score_documents,
        "neardup": neardup.near_duplicates,
        "mixing": mixing.mix_documents,
        "toxicity": lambda d: toxicity.score_toxicity(d, labels.withColumn("node", F.lit(1))),
        "sharding": sharding.shard_documents,
        "quality": quality.quality_rules,
        "secrets": lambda d: secretscan.scan_secrets(d, net),
        "licenses": licenses.scan_licenses,
        "leaks": lambda d: decontamination.find_leaks(d, bench),
    }


@pytest.mark.parametrize("name", ["lm", "neardup", "mixing", "toxicity", "sharding", "quality", "secrets", "licenses"])
def test_one_row_per_row(spark, wide, net, name):
    op = row_operators(spark, net)[name]
    assert op(wide).count() == 8
    assert op(wide.limit(0)).count() == 0


def test_leaks_of_wide_rows(spark, wide, net):
    assert sorted(r["doc_id"] for r in row_operators(spark, net)["leaks"](wide).collect()) == [1, 1, 2]


@pytest.mark.parametrize("stage", [quality.filter_quality, neardup.keep_one, mixing.take_mix, lambda d: decontamination.drop_leaked(d, d.sparkSession.createDataFrame([(1, "no such words here")], "item_id long, text string"))])
def test_filters_keep_all_columns(wide, stage):
    out = stage(wide)
    assert out.columns == wide.columns and {r["row"] for r in out.collect()} <= {"clash"}
    assert stage(wide.limit(0)).count() == 0


def test_pages_with_extra_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com", "<p>x</p>", 1, 2), (None, None, None, None, None)], "page_id long, url string, html string, host int, lines int")
    assert sorted((r["n_lines"], r["n_dropped"]) for r in linededup.drop_boilerplate(df).collect()) == [(0, 0), (1, 0)]
