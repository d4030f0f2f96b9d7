"""Scoring against labels, small logistic models with leave-one-out, calibration and bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import ratio, smoothed_share


MAX_SAMPLES = 20_000  # of a labelled set that is broadcast


def micro_prf(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 over all items of two array columns."""
    hit = F.size(F.array_intersect(truth, predicted))
    s = df.agg(F.sum(hit).alias("tp"), F.sum(F.size(F.array_except(predicted, truth))).alias("fp"), F.sum(F.size(F.array_except(truth, predicted))).alias("fn"))
    return s.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_label(matrix: DataFrame) -> DataFrame:
    """Precision and recall of each label from a confusion table."""
    by_p = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("n_right"))
    by_t = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("n_true"))
    both = by_t.join(by_p, "label", "full").fillna(0, ["n_predicted", "n_right", "n_true"])
    return both.select("label", "n_true", "n_predicted", "n_right", ratio(F.col("n_right"), F.col("n_predicted")).alias("precision"), ratio(F.col("n_right"), F.col("n_true")).alias("recall"))


def agreement(votes: DataFrame, item: str, value: str, voter: str) -> DataFrame:
    """Per item the voters, the votes for the leading value, and whether all agree."""
    per = votes.groupBy(item, value).agg(F.count_distinct(voter).alias("v"))
    out = per.groupBy(item).agg(F.sum("v").alias("n_votes"), F.max("v").alias("n_leading"), F.min_by(value, F.struct(-F.col("v"), F.col(value))).alias("leading"))
    return out.withColumn("unanimous", F.col("n_votes") == F.col("n_leading"))


def rolled_up(values: Column, parents: dict[str, str]) -> Column:
    """Labels mapped to their parents, each once."""
    table = F.create_map(*[F.lit(x) for pair in parents.items() for x in pair])
    return F.array_distinct(F.transform(values, lambda x: F.coalesce(F.try_element_at(table, x), x)))


def newton_fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """Weights (intercept first, not penalised) of an L2 logistic regression."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.0] + [penalty] * x.shape[1])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.lstsq((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w, rcond=None)[0]
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    return w


def leave_one_out(samples: DataFrame, item: str, label: str, features: list[str], penalty: float = 1.0, folds_per_task: int = 64) -> DataFrame:
    """(item, p): each sample's probability from a model that has not seen it.

    The samples are a small labelled set (thousands at most) and are broadcast; the fits, one for each sample, are what
    is spread over the cluster.
    """
    held = samples.select(item, label, *features).orderBy(item).limit(MAX_SAMPLES + 1).toPandas()
    if len(held) > MAX_SAMPLES:
        raise ValueError(f"leave-one-out is for at most {MAX_SAMPLES} samples")
    x, y, ids = held[features].to_numpy(float), held[label].to_numpy(float), held[item].tolist()
    spark = samples.sparkSession
    shared = spark.sparkContext.broadcast((x, y, ids))
    n_tasks = max(1, -(-len(ids) // folds_per_task))
    kind = samples.schema[item].dataType.simpleString()

    def fits(batches):
        x, y, ids = shared.value
        for pdf in batches:
            out = []
            for k in pdf["fold"]:
                rest = np.arange(len(y)) != k
                w = newton_fit(x[rest], y[rest], penalty)
                out.append((ids[k], float(1 / (1 + np.exp(-np.clip(w[0] + x[k] @ w[1:], -35, 35))))))
            yield pd.DataFrame(out, columns=[item, "p"])

    return spark.range(len(ids), numPartitions=n_tasks).withColumnRenamed("id", "fold").mapInPandas(fits, f"{item} {kind}, p double")


def cv_loss(scored: DataFrame, p: str, label: str) -> DataFrame:
    from tessera.functions.arrays import log_loss

    return scored.agg(F.avg(log_loss(F.col(p), F.col(label))).alias("loss"))


def ablation(samples: DataFrame, item: str, label: str, features: list[str], least_fires: int = 3) -> list[str]:
    """The signals without which the others predict held-out samples worse; those that fire on too few are not tried."""
    fired = samples.agg(*[F.count_if(F.col(f) != 0).alias(f) for f in features]).first()
    tried = [f for f in features if fired[f] >= least_fires]
    loss = lambda use: cv_loss(leave_one_out(samples, item, label, use).join(samples.select(item, label), item), "p", label).first()[0]
    whole = loss(tried)
    return [f for f in tried if loss([g for g in tried if g != f]) > whole]


def fold_probabilities(rows: DataFrame, item: str, label: str, features: list[str], folds: int = 10, penalty: float = 1.0, rounds: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """(item, p): each row's probability from a logistic model of the other folds; rows of one item share a fold.

    For labelled sets of any size: a Newton step of all models is one aggregation over the rows, and only its sums reach
    the driver. A row without a label or with a missing feature is left out.
    """
    from tessera.functions.arrays import sigmoid
    from tessera.session import written

    d = len(features) + 1
    data = rows.select(F.col(item), F.col(label).cast("double").alias("__y"), *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features, 1)], F.pmod(F.xxhash64(item), F.lit(folds)).alias("__fold"))
    data = written(data.dropna(subset=[c for c in data.columns if c != item]))
    others = data.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("__k <> __fold")
    x = [F.lit(1.0), *[F.col(f"__x{i}") for i in range(1, d)]]
    ridge = np.diag([0.0] + [penalty] * (d - 1))
    w = np.zeros((folds, d))

    def predicted(model: str) -> Column:
        of_model = F.get(F.array(*[F.array(*[F.lit(float(c)) for c in v]) for v in w]), F.col(model).cast("int"))
        return F.aggregate(F.zip_with(of_model, F.array(*x), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v, sigmoid)

    p = F.col("__p")
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum((p - F.col("__y")) * x[i]) for i in range(d)] + [F.sum(p * (1 - p) * x[i] * x[j]) for i, j in upper]
    for _ in range(rounds):
        most = 0.0
        for k, *got in others.withColumn("__p", predicted("__k")).groupBy("__k").agg(*sums).collect():
            h = ridge.copy()
            for (i, j), v in zip(upper, got[d:], strict=True):
                h[i, j] += v
                h[j, i] = h[i, j]
            step = np.linalg.lstsq(h, np.array(got[:d]) + ridge @ w[k], rcond=None)[0]
            w[k] -= step
            most = max(most, float(np.abs(step).max()))
        if most < tolerance:
            break
    return data.select(item, predicted("__fold").alias("p"))


def calibration_bins(scored: DataFrame, p: str, right: Column, bins: int = 5) -> DataFrame:
    """Smoothed share of right answers by bin of the raw score, made to rise with the score by a running maximum."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    per = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right"), F.avg(p).alias("mean_p"))
    share = per.withColumn("share", smoothed_share(F.col("n_right"), F.col("n"), F.col("mean_p")))
    return share.withColumn("calibrated", F.max("share").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))  # a handful of bins


def held_out_bins(scored: DataFrame, p: str, right: str, bins: int = 5) -> DataFrame:
    """Each row with its bin's counts without itself."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    w = Window.partitionBy("bin")
    out = scored.withColumn("bin", b)
    return out.withColumn("n_others", F.count(F.lit(1)).over(w) - 1).withColumn("n_right_others", F.sum(F.col(right).cast("long")).over(w) - F.col(right).cast("long"))
