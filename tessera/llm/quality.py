"""Quality rules under weak supervision (native).

Every rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote patterns (at most
3 ** rules, whatever the corpus size) estimates how often each rule votes bad on good and on bad documents; the posterior
probability of being good then decides, in place of all-must-pass filtering.

Defined results. Null text: counts 0, base_failed. Empty table: empty result. Repeated rows and ties: each row is judged by
its own text alone. Texts of any length are read whole. Extra columns are carried by filter_quality() and not looked at;
scratch columns carry a prefix of their own.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, lower_ascii, materialise, packed_rows, unpacked_rows, word_array

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

# Frequent function words of the languages served.
FUNCTION_WORDS = (
    "the of and to in is that for it with as on by this was at be are an or from "
    "le la les de des du et un une en que qui est pour dans par sur au aux avec "
    "der die das und ist von den mit zu ein eine nicht auf für im dem des sich "
    "el los las que y es se por con una para del al no lo su"
).split()
P = "__q_"


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and what the rules need."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(f"{P}words", word_array(F.col(text)))
    df = df.withColumn(f"{P}lines", F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != ""))
    hashes = F.transform(F.col(f"{P}words"), lambda x: F.xxhash64(x))
    df = df.withColumn(f"{P}hash", hashes)
    # Hashes of 2, 4 and then 8 words on from each word: every step joins two of the step before.
    h, step = F.col(f"{P}hash"), 1
    while step < WINDOW:
        later = F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0)))
        df = df.withColumn(f"{P}by{2 * step}", F.zip_with(F.slice(h, 1, F.size(later)), later, lambda x, y: F.xxhash64(x, y)))
        h, step = F.col(f"{P}by{2 * step}"), 2 * step
    df = df.withColumn(f"{P}win", h)
    w = F.col(f"{P}win")
    ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(f"{P}ranked", F.when(F.size(F.array_distinct(w)) < F.size(w), ranked))
    r = F.col(f"{P}ranked")
    twice = F.filter(r, lambda x, j: F.coalesce(x["h"] == F.get(r, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(r, j + 1)["h"], F.lit(False)))
    df = df.withColumn(f"{P}at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col(f"{P}at")
    steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda a, b: F.least(F.lit(WINDOW), a - b))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x)
    lines, words, longest = F.col(f"{P}lines"), F.col(f"{P}words"), max(map(len, FUNCTION_WORDS))
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(F.when(F.size(at) > 0, covered), F.lit(0)).cast("long"),
            f"{P}n_lines": F.size(lines),
            f"{P}upper": F.length(t) - F.length(F.translate(t, string.ascii_uppercase, "")),
            f"{P}stop": F.size(F.filter(words, lambda x: (F.length(x) <= longest) & lower_ascii(x).isin(FUNCTION_WORDS))),
        }
    )
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def rules() -> dict[str, tuple[Column, Column]]:
    """Each rule's conditions to vote bad and to vote good; neither: it abstains."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    lines, repeat = share(F.col("n_dup_lines"), F.col(f"{P}n_lines")), share(F.col("n_repeat_words"), n)
    symbols, upper, stop, mean = F.col("n_symbols") / chars, F.col(f"{P}upper") / chars, share(F.col(f"{P}stop"), n), share(F.col("word_chars"), n)
    return {
        "length": (n < MIN_WORDS, n >= 40),
        "repeats": (repeat > 0.3, repeat <= 0.1),
        "lines": ((lines > 0.5) & (F.col(f"{P}n_lines") >= 4), lines <= 0.2),
        "symbols": (symbols > 0.08, symbols < 0.02),
        "capitals": ((upper > 0.4) & (n >= 5), upper < 0.2),
        "function_words": ((stop < 0.02) & (n >= MIN_WORDS), stop >= 0.08),
        "word_length": ((mean < 2) | (mean > 14), (mean >= 3) & (mean <= 10)),
    }


def vote_columns(df: DataFrame) -> DataFrame:
    """One int column per rule: 1 bad, 0 good, -1 abstains."""
    return df.withColumns({f"{P}v_{k}": F.when(bad, 1).when(good, 0).otherwise(-1) for k, (bad, good) in rules().items()})


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[tuple[float, float]]]:
    """Prior of bad, and for each rule the chance of a bad vote given a good and a bad document, by EM over pattern counts.

    The start takes any bad vote for a sign of a bad document. Estimates are smoothed by one bad vote of 20 on good documents
    and one of two on bad ones.
    """
    if not patterns:
        return 0.5, []
    k, total = len(patterns[0][0]), sum(c for _, c in patterns)
    bad = [0.8 if 1 in v else 0.05 for v, _ in patterns]
    prior, rates = 0.5, [(0.5, 0.5)] * k
    for _ in range(rounds):
        prior = (sum(c * q for (_, c), q in zip(patterns, bad, strict=True)) + 1) / (total + 2)
        rates = []
        for j in range(k):
            sums = [[1.0, 20.0], [1.0, 2.0]]  # by class: bad votes, votes
            for (v, c), q in zip(patterns, bad, strict=True):
                if v[j] >= 0:
                    for y, p in ((0, 1 - q), (1, q)):
                        sums[y][0] += c * p * v[j]
                        sums[y][1] += c * p
            rates.append((sums[0][0] / sums[0][1], sums[1][0] / sums[1][1]))
        bad = [posterior_bad(prior, rates, v) for v, _ in patterns]
    return prior, rates


def posterior_bad(prior: float, rates: list[tuple[float, float]], votes: tuple[int, ...]) -> float:
    z = math.log(prior) - math.log1p(-prior)
    for (g, b), v in zip(rates, votes, strict=True):
        if v >= 0:
            z += math.log(b / g) if v else math.log((1 - b) / (1 - g))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _posterior_good(prior: float, rates: list[tuple[float, float]]) -> Column:
    z = F.lit(math.log(prior) - math.log1p(-prior))
    for k, (g, b) in zip(rules(), rates, strict=False):
        z = z + F.when(F.col(f"{P}v_{k}") == 1, math.log(b / g)).when(F.col(f"{P}v_{k}") == 0, math.log((1 - b) / (1 - g))).otherwise(0.0)
    return 1 / (1 + F.exp(z))


def _fitted(voted: DataFrame) -> tuple[float, list[tuple[float, float]]]:
    votes = [f"{P}v_{k}" for k in rules()]
    return fit(sorted((tuple(r[:-1]), r[-1]) for r in voted.groupBy(*votes).count().collect()))


def quality_rules(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, the base counts, p_good and the verdict kept, one row per row of docs."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    voted = vote_columns(base_columns(docs.select(*keys, text), text)).select(*keys, *names, *[f"{P}v_{k}" for k in rules()])
    voted = materialise(voted)
    good = _posterior_good(*_fitted(voted))
    return voted.withColumn("p_good", good).select(*keys, *names, "p_good", (~F.col("base_failed") & (F.col("p_good") >= 0.5)).alias("kept"))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose verdict is kept, with their own columns."""
    votes = [f"{P}v_{k}" for k in rules()]
    voted = vote_columns(base_columns(packed_rows(docs, text=F.col(text)).withColumnRenamed("row", f"{P}row")))
    voted = materialise(voted.select(F.col(f"{P}row").alias("row"), "base_failed", *votes))  # counted once; the votes stand beside the row
    return unpacked_rows(voted.where(~F.col("base_failed") & (_posterior_good(*_fitted(voted)) >= 0.5)).select("row"), docs)
