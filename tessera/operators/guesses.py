"""Measured guesses at what an unknown name is: ten signals per name, a small model, calibrated confidence, evidence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.arrays import ratio, sigmoid
from tessera.operators import match, stats
from tessera.session import written

SIGNALS = ("cluster_id", "vendor_suffix", "malware_word", "actor_resemblance", "software_resemblance", "cooc_actor", "cve_actor", "non_latin", "title_malware_ctx", "title_actor_ctx")
MIN_TITLES, MAX_CVE_ACTORS = 2, 3

# Fixed values of the measurement.
NAME_ONLY = ("cluster_id", "vendor_suffix", "malware_word", "non_latin")
MIN_TRUTH = 20  # labelled names for a fit
MIN_SUPPORT = 10  # labelled names for a validated label
MIN_BAND = 20  # labelled names for a band
MIN_MATCH = 0.5  # share right of a kind of resemblance
EDGES = (0.5, 0.7, 0.85)  # lower ends of the bins of the raw score
SMOOTHING = 4
BANDS, LOWEST, MARGIN = {"high": 0.85, "medium": 0.7}, "low", 0.01


def resemblance(names: DataFrame, reference: DataFrame, containment: bool) -> DataFrame:
    """(name, kind, similarity, target) of the closest reference entry (key, spelling, target); a name's own key never counts."""
    own = names.select("name", F.col("key").alias("own_key"), "w")
    ref = reference.select("key", "spelling", "target").distinct()
    by_variant = match.variant_join(own.withColumn("v", T.spelling_variants(F.col("name"))), "name", "v", ref).join(own.select("name", "own_key"), "name")
    hits = by_variant.where(F.col("key") != F.col("own_key")).select("name", F.lit("variant").alias("kind"), F.lit(1.0).alias("similarity"), "target")
    near = match.fuzzy_join(own.select(F.col("own_key").alias("key")), ref, "key")
    fuzzy = near.join(own, F.col("left_key") == F.col("own_key")).join(ref, F.col("right_key") == ref["key"])
    hits = hits.unionByName(fuzzy.select("name", F.lit("fuzzy").alias("kind"), "similarity", "target"))
    if containment:
        words = T.fold_tokens("spelling")
        core = F.filter(F.col("rw"), lambda x: ~x.isin(*T.DESCRIBING_WORDS))
        phrases = ref.withColumn("rw", words).withColumn("core", F.when(F.size(core) > 0, core).otherwise(F.col("rw")))
        phrases = phrases.where((F.size("core") > 1) | (F.length(F.get("core", F.lit(0))) > 5)).select(F.array_join("core", " ").alias("phrase"), "key", "target")
        inside = match.containment_join(own, "name", "w", phrases).join(phrases, "phrase").join(own.select("name", "own_key"), "name").where(F.col("key") != F.col("own_key"))
        hits = hits.unionByName(inside.select("name", F.lit("contains").alias("kind"), F.lit(0.9).alias("similarity"), "target"))
    return match.best_hits(hits, "name")


def company(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, cooc_actor): whether some row (row, key, actor) lists the name beside a known actor."""
    own = rows.join(names.select("name", F.col("key").alias("k")), F.col("key") == F.col("k")).select("name", "row", F.col("key").alias("own"))
    beside = own.join(rows.where("actor IS NOT NULL"), "row").where(F.col("key") != F.col("own"))
    return beside.groupBy("name").agg(F.lit(1.0).alias("cooc_actor"))


def shared_cves(names: DataFrame, rows: DataFrame, cves: DataFrame) -> DataFrame:
    """(name, cve_actor): whether a row of the name cites a CVE that few actors' other rows cite."""
    own = rows.join(names.select("name", F.col("key").alias("k")), F.col("key") == F.col("k")).select("name", "row").distinct()
    mine = own.join(cves, "row").select("name", "cve").distinct()
    others = mine.join(cves, "cve").join(own.withColumn("mine", F.lit(True)), ["name", "row"], "left").where("mine IS NULL")
    tied = others.join(rows.where("actor IS NOT NULL").select("row", "actor"), "row").groupBy("name", "cve").agg(F.count_distinct("actor").alias("n"))
    return tied.where(F.col("n") <= MAX_CVE_ACTORS).groupBy("name").agg(F.lit(1.0).alias("cve_actor"))


def signals(names: DataFrame, actors: DataFrame, software: DataFrame, rows: DataFrame, cves: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row per name with the ten signals; contexts is (key, malware_titles, actor_titles)."""
    w = T.fold_tokens("name")
    own = written(names.select("name").distinct().withColumn("w", w).withColumn("key", T.name_key(F.col("w"))).where("key IS NOT NULL"))
    hit = lambda df, c, target, *more: df.select("name", F.col("similarity").alias(c), F.col("target").alias(target), *more)
    like_actor = hit(written(resemblance(own, actors, True)), "actor_resemblance", "like_actor", F.col("kind").alias("like_kind"))
    like_software = hit(written(resemblance(own, software, False)), "software_resemblance", "like_software")
    out = own.join(like_actor, "name", "left").join(like_software, "name", "left").join(company(own, rows), "name", "left").join(shared_cves(own, rows, cves), "name", "left").join(contexts, "key", "left")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    exact = actors.select("key", F.lit(True).alias("exact_actor")).distinct()
    listed = software.select("key", F.lit(True).alias("exact_software")).distinct()
    out = out.join(exact, "key", "left").join(listed, "key", "left")
    return out.select(
        "name", "key", "like_actor", "like_kind", "like_software", F.coalesce("exact_actor", F.lit(False)).alias("exact_actor"), F.coalesce("exact_software", F.lit(False)).alias("exact_software"),
        yes(T.cluster_kind(F.col("w")).isNotNull()).alias("cluster_id"), yes(T.name_suffix(F.col("w")).isNotNull()).alias("vendor_suffix"), yes(T.malware_word(F.col("w")).isNotNull()).alias("malware_word"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("actor_resemblance", "software_resemblance", "cooc_actor", "cve_actor")],
        yes(T.script_of("name") != "latin").alias("non_latin"), yes(F.col("malware_titles") >= MIN_TITLES).alias("title_malware_ctx"), yes(F.col("actor_titles") >= MIN_TITLES).alias("title_actor_ctx"),
        T.is_placeholder_name(F.col("w")).alias("placeholder"), T.is_campaign_name(F.col("w")).alias("campaign"),
    )


def probability(weights: list[float], kept: list[str]) -> Column:
    """The model's p(malware): weights are the intercept and one for each kept signal."""
    z = F.lit(float(weights[0]))
    for w, s in zip(weights[1:], kept, strict=True):
        z = z + float(w) * F.col(s)
    return sigmoid(z)


def ruled(scored: DataFrame, p: Column) -> DataFrame:
    """scored with label, raw score and rule of each name, from the model's p(malware); a rule's label has no score."""
    rule = F.when(F.col("placeholder"), "placeholder_word").when(F.col("campaign"), "campaign_word").when(F.col("exact_actor") & ~F.col("exact_software"), "exact_actor_name")
    label = F.when(rule.isin("placeholder_word", "campaign_word"), "not-an-entity").when(rule.isNotNull() | (p < 0.5), "actor").otherwise(F.when(F.col("like_software") == "tool", "tool").otherwise("malware"))
    return scored.select("*", label.alias("label"), F.when(rule.isNull(), F.greatest(p, 1 - p)).alias("raw"), rule.alias("rule"))


def decided(scored: DataFrame, weights: list[float], kept: list[str]) -> DataFrame:
    """Label, raw score and rule of each name by a model's weights, and the signals that fired."""
    fired = F.array_compact(F.array(*[F.when(F.col(s) != 0, F.lit(s)) for s in SIGNALS]))
    return ruled(scored, probability(weights, kept)).select("name", "key", "label", "raw", "rule", fired.alias("evidence"), "like_actor", "like_software")


@dataclass(frozen=True)
class Model:
    kept: list[str]  # signals
    weights: list[float]  # the intercept and one for each kept signal
    shares: list[float]  # confidence by bin of the raw score, rising
    silent: float  # confidence where no kept signal fired
    granted: list[str]  # bands that the labelled names bear out
    validated: list[str]  # labels that enough labelled names carry
    kinds: list[str]  # kinds of resemblance right often enough to name the actor
    commoner: str  # the label to expect where nothing is known


def bin_shares(n: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share right of each bin, pulled to the bin's middle and made to rise; the last axis counts the bins."""
    low, high = np.array(EDGES), np.array([*EDGES[1:], 1.0])
    return np.maximum.accumulate((right + SMOOTHING * (low + high) / 2) / (n + SMOOTHING), axis=-1).round(3)


def held_out(raw: np.ndarray, ok: np.ndarray, fired: np.ndarray) -> tuple[np.ndarray, list[float], float]:
    """Each row's confidence from bins that lack it; then the shares of all rows and that of rows without a signal."""
    at = np.searchsorted(EDGES, raw, side="right") - 1
    own = np.eye(len(EDGES))[at] * fired[:, None]
    n, right = own.sum(0), (own * ok[:, None]).sum(0)
    rest = bin_shares(n - own, right - own * ok[:, None])[np.arange(len(raw)), at]
    quiet, quiet_ok = (~fired).sum(), (ok & ~fired).sum()
    alone = np.round((quiet_ok - ok + SMOOTHING / 2) / (quiet - 1 + SMOOTHING), 3)
    return np.where(fired, rest, alone), bin_shares(n, right).tolist(), float(np.round((quiet_ok + SMOOTHING / 2) / (quiet + SMOOTHING), 3))


def granted_bands(confidence: np.ndarray, ok: np.ndarray, fired: np.ndarray) -> list[str]:
    """The bands that enough rows reach with the precision they claim; a refused band's rows count for the next one."""
    out, waiting, top = [], np.zeros(len(ok), bool), np.inf
    for band, floor in BANDS.items():
        pool = (fired & (confidence >= floor) & (confidence < top)) | waiting
        fine = pool.sum() >= MIN_BAND and ok[pool].mean() >= floor
        out += [band] * bool(fine)
        waiting, top = pool & (not fine), floor
    return out


def graded(model: Model, raw: Column, fired: Column) -> Column:
    """struct(confidence, band): the calibrated confidence, held below the floor of a band that was refused."""
    value = F.when(~fired, model.silent)
    for share, edge in zip(model.shares, EDGES[1:]):
        value = value.when(raw < edge, share)
    value = value.otherwise(model.shares[-1])
    band, cap, top = F.when(~fired, LOWEST), F.when(~fired, min(BANDS.values()) - MARGIN), 1.0
    for name, floor in BANDS.items():
        if name in model.granted:
            band, cap = band.when(value >= floor, name), cap.when(value >= floor, top)
        top = floor - MARGIN
    return F.struct(F.least(value, cap.otherwise(top)).alias("confidence"), band.otherwise(LOWEST).alias("band"))


def fired_any(kept: list[str]) -> Column:
    """Whether any kept signal fired."""
    return F.greatest(F.lit(0.0), *[F.abs(F.col(s)) for s in kept], F.lit(0.0)) > 0


def fit(samples: DataFrame) -> tuple[Model, DataFrame] | None:
    """The model that labelled names bear out, and what it says of each of them without having seen it.

    samples are signals() rows with `truth` and, for actors, `truth_actor` and whether a source knows that actor by another
    key (`matchable`); they are a small labelled set, at most stats.MAX_SAMPLES. None where there are too few.
    """
    support = {r["truth"]: r["n"] for r in samples.groupBy("truth").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(support.values()) < MIN_TRUTH or not {"actor", "malware"} <= support.keys():
        return None
    if sum(support.values()) > stats.MAX_SAMPLES:
        raise ValueError(f"a model is fitted to at most {stats.MAX_SAMPLES} names")
    two = samples.where(F.col("truth").isin("actor", "malware")).withColumn("y", (F.col("truth") == "malware").cast("double"))
    kept = stats.ablation(two, "name", "y", list(SIGNALS))
    own = two.select("y", *kept).toPandas().to_numpy(float)
    weights = stats.newton_fit(own[:, 1:], own[:, 0]).tolist()
    seen = samples.join(stats.leave_one_out(two, "name", "y", kept), "name", "left")
    rows = ruled(seen, F.coalesce("p", probability(weights, kept))).withColumn("fired", fired_any(kept))
    found = rows.select("name", "truth", "label", "raw", "fired", "like_kind", (F.col("matchable") & (F.col("like_actor") == F.col("truth_actor"))).alias("same")).toPandas()
    # Only the two labels that the model weighs say how far its score can be trusted.
    judged = found["truth"].isin(["actor", "malware"]) & found["raw"].notna()
    raw, ok, fired = found.loc[judged, "raw"].to_numpy(float), (found["truth"] == found["label"])[judged].to_numpy(), found.loc[judged, "fired"].to_numpy(bool)
    alone, shares, silent = held_out(raw, ok, fired)
    named = found[(found["truth"] == "actor") & (found["label"] == "actor") & found["like_kind"].notna()]
    share = named["same"].eq(True).groupby(named["like_kind"]).mean()
    validated = sorted(x for x, n in support.items() if n >= MIN_SUPPORT)
    model = Model(kept, weights, shares, silent, granted_bands(alone, ok, fired), validated, sorted(share[share >= MIN_MATCH].index), max(("actor", "malware"), key=support.get))
    grade = graded(model, F.col("raw"), F.col("fired"))
    said = F.when(F.col("label").isin(validated) & F.col("raw").isNotNull(), grade)
    return model, rows.select("name", "truth", "label", "raw", "rule", "like_kind", said["confidence"].alias("confidence"), F.coalesce(said["band"], F.lit("unvalidated")).alias("band"))


def guess_rows(names: DataFrame, scored: DataFrame, model: Model, shown: DataFrame) -> DataFrame:
    """One row for each name (key, name, n) with its guess; scored are its signals(), shown the actors (component) to name."""
    p, fired = probability(model.weights, model.kept), fired_any(model.kept)
    rows = ruled(scored, p).withColumn("fired", fired).join(names.select("key", "n"), "key")
    toward = F.when(F.col("label") == "malware", 1.0).when(F.col("label") == "actor", -1.0)
    note = lambda signal, weight=None: F.struct(F.lit(signal).alias("signal"), F.lit(weight).cast("double").alias("weight") if weight is None else weight.alias("weight"))
    weighed = [F.when(F.col(s) != 0, note(s, F.round(toward * w * F.col(s), 3))) for s, w in zip(model.kept, model.weights[1:], strict=True)]
    context = [F.when(F.col(s) != 0, note(s)) for s in SIGNALS if s not in (*NAME_ONLY, *model.kept)]
    first = [F.when(F.col("rule").isNotNull(), F.struct(F.col("rule").alias("signal"), F.lit(None).cast("double").alias("weight"))), F.when(F.col("rule").isNull() & ~F.col("fired"), note("base_rate"))]
    exact = [F.when(F.col("exact_actor") & (F.coalesce("rule", F.lit("")) != "exact_actor_name"), note("exact_actor_name")), F.when(F.col("exact_software"), note("exact_software_name"))]
    said = F.when(F.col("label").isin(model.validated) & F.col("raw").isNotNull(), graded(model, F.col("raw"), F.col("fired")))
    rows = rows.join(shown.select(F.col("component").alias("like_actor"), F.lit(True).alias("is_shown")).distinct(), "like_actor", "left")
    matched = F.when((F.col("label") == "actor") & F.col("like_kind").isin(model.kinds) & F.col("is_shown"), F.col("like_actor"))
    return rows.select("name", "key", "n", "label", F.bround(said["confidence"], 2).alias("confidence"), F.coalesce(said["band"], F.lit("unvalidated")).alias("band"), matched.alias("matched"), F.array_compact(F.array(*first, *weighed, *context, *exact)).alias("evidence"), F.lit("pending confirmation").alias("status"))


def band_report(predictions: DataFrame) -> DataFrame:
    """Names and right ones by band."""
    return predictions.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("label")).alias("n_right"))


def agreement_with(guesses: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: how many unconfirmed labels (key, label) a guess meets, and how many it repeats. They are never scored against."""
    both = guesses.select("key", F.col("label").alias("guess")).join(labels.select("key", "label"), "key")
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("guess") == F.col("label")).alias("agree"), ratio(F.count_if(F.col("guess") == F.col("label")), F.count(F.lit(1)), 3).alias("rate"))


def pair_decisions(pairs: DataFrame, keys: DataFrame, software: DataFrame, published: DataFrame, guesses: DataFrame | None = None) -> DataFrame:
    """What a stated pair (name, alias) may add: accepted, kind and primary name.

    Names of software refuse a pair; two known entities are already one or stay apart; one known entity is a bridge; two
    unknown names need a vendor's cluster label and, for each, a guess that it is an actor.
    """
    side = lambda c, n: pairs.select(c).distinct().withColumn("key", T.name_key(T.fold_tokens(c))).join(software.select("key", F.col("kind").alias(f"s_{n}")), "key", "left").join(keys.join(published, "component", "left_semi").select("key", F.col("component").alias(f"e_{n}")), "key", "left").select(c, f"s_{n}", f"e_{n}")
    out = pairs.join(side("name", "a"), "name").join(side("alias", "b"), "alias")
    if guesses is not None:
        actor = guesses.where("label = 'actor'").select("name").distinct()
        for c, n in (("name", "a"), ("alias", "b")):
            out = out.join(actor.select(F.col("name").alias(c), F.lit(True).alias(f"g_{n}")), c, "left")
    else:
        out = out.withColumn("g_a", F.lit(False)).withColumn("g_b", F.lit(False))
    labelled = T.is_cluster_label(F.col("name")) | T.is_cluster_label(F.col("alias"))
    known = F.col("e_a").isNotNull(), F.col("e_b").isNotNull()
    kind = F.when(F.col("s_a").isNotNull() | F.col("s_b").isNotNull(), "software").when(known[0] & known[1], F.when(F.col("e_a") == F.col("e_b"), "known-same").otherwise("known-different")).when(known[0] | known[1], "bridge").otherwise("new")
    fine = (kind == "bridge") | ((kind == "new") & labelled & F.coalesce("g_a", F.lit(False)) & F.coalesce("g_b", F.lit(False)))
    swap = T.is_cluster_label(F.col("name")) & ~T.is_cluster_label(F.col("alias"))
    given = [c for c in ("source", "pair", "retrieved_at") if c in pairs.columns]
    return out.select(*given, F.when(swap, F.col("alias")).otherwise(F.col("name")).alias("primary"), F.when(swap, F.col("name")).otherwise(F.col("alias")).alias("alias"), kind.alias("kind"), fine.alias("accepted"), F.coalesce("e_a", "e_b").alias("entity"), F.when(known[0], F.col("alias")).otherwise(F.col("name")).alias("other"))
