"""Scores against labels, calibration and small models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import guesses, stats
from tessera.plans.registry import query
from tessera.session import load

_PRED = "(length(text) >= 200 AND NOT contains(text, '!!') AND NOT contains(text, ' | '))::INTEGER"


def _predicted(spark, sf_dir) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents", "labels")
    good = (F.length("text") >= 200) & ~F.col("text").contains("!!") & ~F.col("text").contains(" | ")
    return docs.select("doc_id", "source", good.cast("int").alias("predicted")).join(labels, "doc_id")


@query(f"SELECT quality AS truth, {_PRED} AS predicted, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return stats.confusion(_predicted(spark, sf_dir), "quality", "predicted")


@query(f"""
WITH m AS (SELECT quality AS t, {_PRED} AS p FROM documents JOIN labels USING (doc_id)), l AS (SELECT DISTINCT t AS label FROM m UNION SELECT DISTINCT p FROM m)
SELECT label, (SELECT count(*) FROM m WHERE t = label) AS n_true, (SELECT count(*) FROM m WHERE p = label) AS n_predicted, (SELECT count(*) FROM m WHERE t = label AND p = label) AS n_right,
(SELECT count(*) FROM m WHERE t = label AND p = label) / (SELECT count(*) FROM m WHERE p = label) AS precision, (SELECT count(*) FROM m WHERE t = label AND p = label) / (SELECT count(*) FROM m WHERE t = label) AS recall FROM l""")
def per_label_scores(spark, sf_dir):
    return stats.per_label(confusion_matrix(spark, sf_dir))


@query("""
WITH o AS (SELECT o_orderkey, list(DISTINCT l_returnflag) FILTER (l_linenumber <= 3) AS p, list(DISTINCT l_returnflag) AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
s AS (SELECT sum(len(list_intersect(t, coalesce(p, []))))::BIGINT AS tp, sum(len(coalesce(p, [])) - len(list_intersect(t, coalesce(p, []))))::BIGINT AS fp, sum(len(t) - len(list_intersect(t, coalesce(p, []))))::BIGINT AS fn FROM o)
SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM s""")
def micro_prf(spark, sf_dir):
    (items,) = load(spark, sf_dir, "lineitem")
    sets = items.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_returnflag"))).alias("p"), F.collect_set("l_returnflag").alias("t"))
    return stats.micro_prf(sets, "t", "p")


@query("""
WITH v AS (SELECT l_partkey AS item, l_returnflag AS value, count(DISTINCT l_suppkey) AS v FROM lineitem GROUP BY 1, 2)
SELECT item, sum(v)::BIGINT AS n_votes, max(v) AS n_leading, arg_min(value, (-v, value)) AS leading, sum(v) = max(v) AS unanimous FROM v GROUP BY 1""")
def label_agreement(spark, sf_dir):
    (items,) = load(spark, sf_dir, "lineitem")
    votes = items.select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("value"), F.col("l_suppkey").alias("voter"))
    return stats.agreement(votes, "item", "value", "voter")


def _samples(spark, sf_dir) -> DataFrame:
    """Every labelled document: whether it is labelled good, and two numbers of its text."""
    docs, labels = load(spark, sf_dir, "documents", "labels")
    marks = F.length("text") - F.length(F.translate("text", "!*#$%&|", ""))
    return docs.select("doc_id", F.log1p(marks).alias("marks"), F.log1p(F.length("text")).alias("size")).join(labels.select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")


@query()
def logistic_folds(spark, sf_dir):
    return stats.fold_probabilities(_samples(spark, sf_dir), "doc_id", "y", ["marks", "size"])


@query()
def calibrated_bands(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    scored = stats.fold_probabilities(samples, "doc_id", "y", ["marks", "size"]).join(samples.select("doc_id", "y"), "doc_id")
    return stats.calibration_bins(scored, "p", F.col("y") == 1)


@query("""
WITH b AS (SELECT event_id, least(floor(value / 1000 * 5), 4)::INTEGER AS bin, (event_type = 'click') AS ok FROM events)
SELECT event_id, bin, count(*) OVER w - 1 AS n_others, (sum(ok::INTEGER) OVER w - ok::INTEGER)::BIGINT AS n_right_others FROM b WINDOW w AS (PARTITION BY bin)""")
def held_out_bins(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    rows = events.select("event_id", (F.col("value") / 1000).alias("p"), (F.col("event_type") == "click").alias("ok"))
    return stats.held_out_bins(rows, "p", "ok").select("event_id", "bin", "n_others", "n_right_others")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) % 2)::INTEGER AS half FROM labels")
def odd_even_split(spark, sf_dir):
    from tessera.operators.topk import ranked_globally

    (labels,) = load(spark, sf_dir, "labels")
    return ranked_globally(labels, [F.col("doc_id"), F.col("quality"), F.col("toxic")]).select("doc_id", ((F.col("place") + 1) % 2).cast("int").alias("half"))


@query("""
WITH p AS (SELECT CASE WHEN p_type LIKE 'A%' OR p_type LIKE 'B%' THEN 'metal' ELSE p_type END AS label FROM part) SELECT label, count(*) AS n FROM p GROUP BY 1""")
def rolled_up_labels(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    parents = {r["p_type"]: "metal" for r in part.where("p_type LIKE 'A%' OR p_type LIKE 'B%'").select("p_type").distinct().collect()} or {"": ""}
    rolled = part.select(F.explode(stats.rolled_up(F.array("p_type"), parents)).alias("label"))
    return rolled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, (CASE WHEN event_type = 'view' THEN 0.5 WHEN r < 0.7 THEN 0.6 WHEN r < 0.85 THEN 0.69 ELSE 0.9 END)::DOUBLE AS confidence,
CASE WHEN event_type <> 'view' AND r >= 0.85 THEN 'high' ELSE 'low' END AS band FROM (SELECT *, 0.5::DOUBLE + value::DOUBLE / 200 AS r FROM events)""")
def graded_bands(spark, sf_dir):
    """Confidence and band of raw scores where the medium band was refused."""
    (events,) = load(spark, sf_dir, "events")
    model = guesses.Model([], [0.0], [0.6, 0.8, 0.9], 0.5, ["high"], [], [], "actor")
    grade = guesses.graded(model, F.lit(0.5) + F.col("value").cast("double") / 200, F.col("event_type") != "view")
    return events.select("event_id", grade.alias("g")).select("event_id", "g.confidence", "g.band")
