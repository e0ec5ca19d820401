"""Mixing sources to target weights, in DataFrame functions only.

A naive Bayes classifier over the presence of words, fitted to a bounded sample of the labelled table, gives each
document a posterior over domains. Evidence for a domain are the features that go with it strongly enough; how
strongly is chosen by the log loss on the half of the sample that the weights weren't fitted to. Document rates
then minimise the squared gaps between the domains' expected token totals and their targets, by projected
gradient steps on the documents until the totals settle: each step is one aggregate of as many numbers as there
are domains, and each document's rate follows from the numbers of the steps so far. Rates are projected onto
[0, max_rate].

Words never leave their row: the classifier is a literal of the plan, looked up by the hashes of words (64 bits;
features are told apart by them alone). The sample's vocabulary bounds it. Posteriors and token counts are written
once to the shared folder; the steps read only these few columns.

Defined results: null and empty texts have no tokens, the prior as posterior and no pull on the totals;
repeated rows each get a rate; without labels all documents are of the first domain; a domain that no
document belongs to is left out of the sum; targets must not be negative.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, materialise, settled, sized, table

#: Labelled documents that the classifier is fitted to at most: those of the smallest hashes of their ids.
SAMPLE = 20_000
#: Domains by labels, and the share of all tokens that each should have.
DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}
#: The fit ends when no domain's total changes by more than this part in a step; not to get there in so many steps is an error.
SETTLED, STEPS = 1e-5, 1_000
#: A feature's rates must differ by this many standard errors to count as evidence, and its correlation with the
#: domain reach one of these limits, chosen for each domain on held-out documents (without any: the default).
LEAST_Z, CORRELATIONS, CORRELATION = 4.0, (0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4), 0.2
#: Weights are held in whole millionths, so that sums don't depend on an order.
UNIT = 1_000_000


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").otherwise("clean")


def _words(text: Column) -> Column:
    """Lower-case words without the marks that end them; these are the tokens that count here."""
    return F.array_remove(F.split(F.lower(text), rf"[.,!?;:|]*(?:[{SEPARATORS}]+|\z)"), "")


def _features(words: Column, text: Column) -> Column:
    """Hashes of the words and of three features of the text's form, whose names begin with a blank as no word does; each once."""

    def of(seen: Column) -> Column:
        kinds = F.floor(10 * F.size(seen) / n)
        form = [F.xxhash64(F.concat(F.lit(f" {name}:"), c.cast("int").cast("string"))) for name, c in (("kinds", kinds), ("marks", marks), ("length", F.floor(F.log2(n))))]
        return F.concat(seen, F.array(*form))

    n = F.greatest(F.size(words), F.lit(1))
    marks = F.least(F.lit(9), F.floor(20 * F.regexp_count(text, F.lit("[#*$%&|<>!]")) / F.greatest(F.char_length(text), F.lit(1))))
    return F.get(F.transform(F.array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))), of), F.lit(0))


def _weights(counts: DataFrame, n: dict[str, int], of: str) -> DataFrame:
    """f, and for each domain but the first r_<domain> (correlation; null unless significant and positive) and w_<domain> (log ratio of rates to the first domain's).

    Rates are shrunk to the feature's overall rate by one observation, so that one that a domain lacks by chance says little.
    """
    first, total = DOMAINS[0], sum(n.values())
    c = {d: F.col(f"{of}_{d}") for d in DOMAINS}
    overall = (sum(c.values(), F.lit(0)) + 0.5) / (total + 1)
    rate = {d: (c[d] + overall) / (n[d] + 1) for d in DOMAINS}
    out = []
    for d in DOMAINS[1:]:
        if n[d] and n[first]:
            both = (c[d] + c[first] + 0.5) / (n[d] + n[first] + 1)
            z = (c[d] / n[d] - c[first] / n[first]) / F.sqrt(both * (1 - both) * (1 / n[d] + 1 / n[first]))
            out += [F.when(z >= LEAST_Z, z / math.sqrt(n[d] + n[first])).alias(f"r_{d}"), F.ln(rate[d] / rate[first]).alias(f"w_{d}")]
        else:
            out += [F.lit(None).cast("double").alias(f"r_{d}"), F.lit(0.0).alias(f"w_{d}")]
    return counts.select("f", *out)


def _prior(n: dict[str, int]) -> dict[str, float]:
    return {d: math.log((n[d] + 1) / (sum(n.values()) + len(DOMAINS))) for d in DOMAINS}


def _scores(seen: DataFrame, weights: DataFrame, limits: dict[str, list[float]]) -> DataFrame:
    """__d, __half for each document of the sample, and for each domain and each of its limits s_<domain>_<k>, the summed weights, and h_<domain>_<k>, the features summed."""
    told = weights.filter(F.coalesce(*[F.col(f"r_{d}") for d in limits]).isNotNull())
    counts = lambda d, at: F.coalesce(F.col(f"r_{d}") >= at, F.lit(False))
    sums = [F.sum(F.when(counts(d, at), F.col(f"w_{d}")).otherwise(0.0)).alias(f"s_{d}_{k}") for d in limits for k, at in enumerate(limits[d])]
    hits = [F.count_if(counts(d, at)).alias(f"h_{d}_{k}") for d in limits for k, at in enumerate(limits[d])]
    own = seen.select("__row", "__d", "__half", F.explode("__f").alias("f"))
    return own.join(sized(materialise(told)), "f", "left").groupBy("__row", "__d", "__half").agg(*sums, *hits)


def _no_evidence(scores: DataFrame, n: dict[str, int], limits: dict[str, list[float]]) -> dict[tuple[str, int], float]:
    """For each domain and limit the log ratio of the domain's share of documents without any of its features to that of the first domain."""
    total = sum(n.values())
    lack = [F.count_if((F.col("__d") == x) & (F.col(f"h_{d}_{k}") == 0)).alias(f"n_{d}_{k}_{x}") for d in limits for k in range(len(limits[d])) for x in DOMAINS]
    got = scores.agg(*lack).first()

    def share(d: str, k: int, x: str) -> float:
        overall = (sum(got[f"n_{d}_{k}_{y}"] for y in DOMAINS) + 0.5) / (total + 1)
        return (got[f"n_{d}_{k}_{x}"] + overall) / (n[x] + 1)

    return {(d, k): math.log(share(d, k, d) / share(d, k, DOMAINS[0])) for d in limits for k in range(len(limits[d]))}


def _limits(seen: DataFrame, weights: DataFrame, n: dict[str, int]) -> dict[str, list[float]]:
    """For each domain but the first the one of CORRELATIONS of the least log loss on the held-out half, over documents of it and of the first domain; the largest of equals."""
    grid = {d: list(CORRELATIONS) for d in DOMAINS[1:]}
    scores, prior, first = materialise(_scores(seen, weights, grid)), _prior(n), DOMAINS[0]
    none = _no_evidence(scores.filter("__half = 0"), n, grid)

    def loss(d: str, k: int) -> Column:
        told = F.when(F.col(f"h_{d}_{k}") > 0, F.col(f"s_{d}_{k}")).otherwise(none[d, k])
        odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), told + prior[d] - prior[first]))
        return F.avg(F.when(F.col("__d") == d, F.log1p(F.exp(-odds))).when(F.col("__d") == first, F.log1p(F.exp(odds)))).alias(f"l_{d}_{k}")

    both = [F.count_if(F.col("__d") == d).alias(f"n_{d}") for d in DOMAINS]
    got = scores.filter("__half = 1").agg(*[loss(d, k) for d in grid for k in range(len(grid[d]))], *both).first()
    best = lambda d: min(range(len(grid[d])), key=lambda k: (round(got[f"l_{d}_{k}"], 9), -k))
    return {d: [grid[d][best(d)] if got[f"n_{d}"] and got[f"n_{first}"] else CORRELATION] for d in grid}


class Model(NamedTuple):
    """Log priors by domain; for each domain but the first the log ratio of a document without any of its features, and the features (hashes) with the log ratio for each such domain."""

    prior: dict[str, float]
    none: dict[str, float]
    ratios: list[tuple[int, dict[str, float]]]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from the labelled documents, at most sample of them."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("__id"), domain_of(F.col("quality"), F.coalesce("toxic", F.lit(0))).alias("__d"))
    known = known.orderBy(F.xxhash64("__id"), "__id", "__d").limit(sample)
    t = F.coalesce(F.col(text), F.lit(""))
    seen = docs.join(F.broadcast(known), F.col(key) == F.col("__id")).select("__d", F.pmod(F.xxhash64("__id", F.lit("half")), F.lit(2)).cast("int").alias("__half"), t.alias("__t"), _words(t).alias("__w"))
    seen = materialise(seen.select(F.monotonically_increasing_id().alias("__row"), "__d", "__half", _features(F.col("__w"), F.col("__t")).alias("__f")))
    sizes = {(r["__d"], r["__half"]): r["count"] for r in seen.groupBy("__d", "__half").count().collect()}
    n = {d: sizes.get((d, 0), 0) + sizes.get((d, 1), 0) for d in DOMAINS}
    prior = _prior(n)
    if not n[DOMAINS[0]] or not any(n[d] for d in DOMAINS[1:]):
        return Model(prior, dict.fromkeys(DOMAINS[1:], 0.0), [])
    own = seen.select("__d", "__half", F.explode("__f").alias("f"))
    fitted = [F.count_if((F.col("__d") == d) & (F.col("__half") == 0)).alias(f"half_{d}") for d in DOMAINS]
    counts = materialise(own.groupBy("f").agg(*fitted, *[F.count_if(F.col("__d") == d).alias(f"all_{d}") for d in DOMAINS]))
    half = {d: sizes.get((d, 0), 0) for d in DOMAINS}
    limits = _limits(seen, _weights(counts, half, "half"), half)
    weights = _weights(counts, n, "all")
    none = _no_evidence(_scores(seen, weights, limits), n, limits)
    kept = {d: F.col(f"r_{d}") >= limits[d][0] for d in limits}
    told = weights.select("f", *[F.when(kept[d], F.round(f"w_{d}", 6)).otherwise(0.0).alias(d) for d in limits])
    told = told.filter(" or ".join(f"{d} <> 0" for d in limits)).orderBy("f").collect()
    return Model(prior, {d: none[d, 0] for d in limits}, [(r.f, {d: r[d] for d in limits}) for r in told])


def _evidence(features: Column, ratios: list[tuple[int, dict[str, float]]]) -> Column:
    """struct of the summed weights by domain, in units, for an array of features; null for a domain without any.

    A hashed set lets the features of the classifier through; their weights lie in a literal table of buckets by
    hash, about one feature in each, so that a feature costs the same whatever the classifier's size.
    """
    names = DOMAINS[1:]
    nothing = F.struct(*[F.lit(None).cast("long").alias(d) for d in names])
    if not ratios:
        return nothing
    buckets: list[list[str]] = [[] for _ in ratios]
    for f, w in ratios:
        buckets[f % len(ratios)].append(f"struct({f}L as f, {', '.join(f'{round(w[d] * UNIT)}L as {d}' for d in names)})")
    kind = f"array<struct<f:bigint,{','.join(f'{d}:bigint' for d in names)}>>"
    # one text for the parser: thousands of literals one by one would take long to send to the JVM
    found = F.expr("array(" + ", ".join(f"cast(array({', '.join(b)}) as {kind})" for b in buckets) + ")")
    hits = F.filter(features, lambda x: x.isin([f for f, _ in ratios]))
    entries = F.flatten(F.transform(hits, lambda x: F.filter(F.get(found, F.pmod(x, F.lit(len(ratios))).cast("int")), lambda e: e["f"] == x)))
    return F.aggregate(entries, nothing, lambda a, e: F.struct(*[F.when(e[d] == 0, a[d]).otherwise(F.coalesce(a[d], F.lit(0)) + e[d]).alias(d) for d in names]))


def posteriors(docs: DataFrame, model: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """keep, n_tokens and p_<domain> for each row. Log odds are held within 30 either way."""
    prior, first = model.prior, DOMAINS[0]
    found = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    names = [c for c in found.columns if c != "__t"]
    found = found.select(*names, "__t", _words(F.col("__t")).alias("__w"))
    found = found.select(*names, F.size("__w").cast("long").alias("n_tokens"), _evidence(_features(F.col("__w"), F.col("__t")), model.ratios).alias("__e"))
    odds = {first: F.lit(1.0)}
    for d in DOMAINS[1:]:
        told = F.when(F.col("n_tokens") > 0, F.coalesce(F.col("__e")[d] / UNIT, F.lit(model.none[d]))).otherwise(0.0)
        odds[d] = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), told + prior[d] - prior[first])))
    total = sum(odds.values(), F.lit(0.0))
    return found.select(*names, "n_tokens", *[F.round(odds[d] / total, 6).alias(f"p_{d}") for d in DOMAINS])


def rates(scored: DataFrame, weights: dict[str, float], max_rate: float | None = None, budget: float | None = None) -> DataFrame:
    """Adds rate, at least 0. Target of a domain: its weight times budget; without a budget, the first domain keeps its tokens.

    Minimises the sum over domains of (total - target)^2 / tokens at hand, from rate 1. A document's step is
    its gradient over its tokens, so that long and short documents of one posterior keep one rate; as
    posteriors sum to 1, no step length above 1 has to be ruled out: the curvature's largest eigenvalue is 1.
    Steps go on until the totals settle, at the targets or, where max_rate or the mixed posteriors rule these out,
    as near as rates get; a fit that doesn't settle is an error. A rate follows from the posterior alone, so steps run over the
    distinct posteriors with their tokens, and rates are joined back to the documents once.
    """
    everyone, own = materialise(scored), [f"p_{d}" for d in DOMAINS]
    scored = materialise(everyone.groupBy(*own).agg(F.sum("n_tokens").alias("n_tokens")))
    tokens = {d: F.col("n_tokens") * F.col(f"p_{d}") for d in DOMAINS}
    total = lambda rate: {d: v or 0.0 for d, v in scored.agg(*[F.sum(tokens[d] * rate).alias(d) for d in DOMAINS]).first().asDict().items()}
    rate: Column = F.lit(1.0)
    have = got = total(rate)
    share = sum(weights.values()) or 1.0
    first = DOMAINS[0]
    budget = budget if budget is not None else have[first] / (weights[first] / share) if weights[first] else sum(have.values())
    target = {d: budget * weights[d] / share for d in DOMAINS}
    steps = 0
    while True:
        pull = {d: round((got[d] - target[d]) / have[d], 9) if have[d] else 0.0 for d in DOMAINS}
        if not any(pull.values()):
            break
        rate = F.greatest(rate - sum((F.lit(pull[d]) * F.col(f"p_{d}") for d in DOMAINS), F.lit(0.0)), F.lit(0.0))
        rate = F.least(rate, F.lit(float(max_rate))) if max_rate is not None else rate
        last, got, steps = got, total(rate), steps + 1
        if all(abs(got[d] - last[d]) <= SETTLED * have[d] for d in DOMAINS):
            break
        if steps == STEPS:
            raise RuntimeError(f"rates did not settle in {STEPS} steps: {got} for {target}")
        if steps % 20 == 0:  # keeps the expression short
            scored, rate = materialise(scored.withColumn("__rate", rate)), F.col("__rate")
    settled_rates = materialise(scored.select(*[F.col(c).alias(f"__{c}") for c in own], rate.alias("rate")))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in own])
    return everyone.join(sized(settled_rates), same).drop(*[f"__{c}" for c in own])


def copies(key: Column, rate: Column) -> Column:
    """How often a document of this rate is taken: its whole part, and once more for a share of documents that is the rest, chosen by hash."""
    chance = F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1_000_000)) / 1_000_000
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", text: str = "text", max_rate: float | None = None) -> DataFrame:
    """key, n_tokens, p_<domain>, rate, copies for each row of docs."""

    def made() -> DataFrame:
        scored = posteriors(docs, fit(docs, labels, key, text), [F.col(key).alias(key)], text)
        return rates(scored, weights or WEIGHTS, max_rate).withColumn("copies", copies(F.col(key), F.col("rate")))

    return settled(made)


def apply_mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", text: str = "text", max_rate: float | None = 1.0) -> DataFrame:
    """The rows of docs, each as often as its copies say. Rows that share a key share its rate (the largest).

    Texts aren't shuffled when the keys that leave or repeat are few enough to broadcast.
    """
    mixed = mix(docs, labels, weights, key, text, max_rate).filter(F.col(key).isNotNull())
    odd = materialise(mixed.groupBy(F.col(key).alias("__key")).agg(F.max("copies").alias("__copies")).filter("__copies <> 1"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    joined = docs.select(row, F.col(key).alias("__id")).join(sized(odd), F.col("__id") == F.col("__key"), "left")
    times = F.coalesce(F.col("__copies"), F.lit(1)).cast("int")
    if max_rate is not None and max_rate <= 1:
        return joined.filter(times > 0).select("__row.*")
    return joined.filter(times > 0).select("__row", F.explode(F.sequence(F.lit(1), times))).select("__row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "n_tokens", *[F.round(f"p_{d}", 3).alias(f"p_{d}") for d in DOMAINS], F.round("rate", 3).alias("rate"), "copies")
