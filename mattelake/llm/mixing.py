"""Mixing to target weights by soft membership (operator 8), native expressions only.

A naive Bayes classifier over hashed words gives each document a posterior over the domains. It is
learned from a bounded sample of labelled rows: one half gives the domains' word shares, the other half
the sharpness, by which the mean log share of a text's words counts, so that posteriors are calibrated
and stay soft. Document rates are then fitted by projected gradients: the squared error of the expected
token totals of the domains, each divided by the domain's natural total, falls in steps of size one,
which its curvature bounds. Each round is one aggregation over a narrow table; a rate is a fold over the
rounds' residuals, so nothing is rewritten.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mattelake.llm.common import materialise, renamed, restored

#: Buckets that words are hashed into, and the bound of the classifier's sample in expected rows.
BUCKETS, SAMPLE_DOCS = 2048, 4_000
#: Weight of the pooled word shares, in words, in each domain's own.
PRIOR_WORDS = 2000.0
#: Candidates for the sharpness; the one with the least log loss on the sample's other half is taken.
SHARPNESS = tuple(2.0**k for k in range(-1, 11))
#: Powers of the natural weights that make the default targets.
FLATTEN = 0.7
#: Tokens are estimated at this many bytes each.
BYTES_PER_TOKEN = 4
ROUNDS = 40
TOLERANCE = 1e-4


@dataclass(frozen=True)
class Classifier:
    """Domains in order, log priors, log word shares by domain and bucket, and the sharpness."""

    names: list[str]
    priors: list[float]
    shares: list[list[float]]
    sharpness: float


@dataclass(frozen=True)
class Fit:
    """Column of the rates, natural totals, totals aimed at, totals reached, rounds taken, whether all are within ``TOLERANCE``."""

    rate: Column
    natural: list[float]
    aim: list[float]
    reached: list[float]
    rounds: int
    converged: bool


def _array(values) -> Column:
    """A constant array; as text it is one literal to plan, whatever its length."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _words(text: Column) -> Column:
    """Letter runs of the whole text in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def learn(docs: DataFrame, label: str, sample_docs: int = SAMPLE_DOCS, buckets: int = BUCKETS) -> Classifier:
    """The classifier of ``label``, from about ``sample_docs`` labelled rows taken whole by a hash of their ids.

    The driver holds a number for each domain and bucket. Without labelled rows there are no domains.
    """
    known = docs.select(F.col("doc_id").cast("string").alias("id"), F.col(label).cast("string").alias("label"), F.coalesce("text", F.lit("")).alias("text")).where("label is not null")
    sizes = sorted(tuple(r) for r in known.groupBy("label").count().collect())
    total = sum(n for _, n in sizes)
    names, priors = [n for n, _ in sizes], [math.log(n / total) for _, n in sizes]
    if not names:
        return Classifier([], [], [], 1.0)
    draw = F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1 << 40))
    taken = known.where(draw < int(min(1.0, sample_docs / total) * (1 << 40))).select("label", (draw % 2 == 0).alias("first"), _words(F.col("text")).alias("words"))
    # A sample of one row or two may leave a half empty; then both steps use all of it.
    sample = materialise(taken)
    halves = {r["first"] for r in sample.select("first").distinct().collect()}
    side = lambda first: sample.where(F.col("first") == first) if len(halves) == 2 else sample
    counts = side(True).select("label", F.explode("words").alias("w")).groupBy("label", _bucket(F.col("w"), buckets).alias("b")).count().collect()
    own = {n: [0.0] * buckets for n in names}
    pooled = [1.0] * buckets
    for name, b, n in counts:
        own[name][b] = float(n)
        pooled[b] += n
    mass = sum(pooled)
    shares = []
    for n in names:
        mixed = [c + PRIOR_WORDS * p / mass for c, p in zip(own[n], pooled)]
        whole = sum(mixed)
        shares.append([math.log(m / whole) for m in mixed])
    scored = _evidence(side(False), shares, buckets).withColumn("at", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label")).cast("int"))

    def loss(sharpness: float) -> Column:
        logits = F.transform(F.arrays_zip("evidence", F.array(*[F.lit(p) for p in priors]).alias("prior")), lambda x: x["prior"] + sharpness * x["evidence"])
        top = F.array_max(logits)
        return F.avg(F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top - F.element_at(logits, F.col("at")))

    losses = scored.agg(*[F.round(loss(t), 9) for t in SHARPNESS]).first()
    best = min(range(len(SHARPNESS)), key=lambda i: (losses[i] if losses[i] is not None else math.inf, i))
    return Classifier(names, priors, shares, SHARPNESS[best])


def _evidence(rows: DataFrame, shares: list[list[float]], buckets: int) -> DataFrame:
    """rows (words) with ``evidence``: for each domain the mean log share of the words above the domains' own mean."""
    level = [sum(s[b] for s in shares) / len(shares) for b in range(buckets)]
    at = F.transform("words", lambda w: _bucket(w, buckets))
    n = F.greatest(F.size("words"), F.lit(1))
    out = rows.withColumn("_at", at)
    tables = [_array([x - m for x, m in zip(s, level)]) for s in shares]

    def summed(table: Column) -> Column:
        return F.aggregate("_at", F.lit(0.0), lambda t, b: t + F.get(table, b)) / n

    sums = [summed(t) for t in tables]
    return out.withColumn("evidence", F.array(*sums)).drop("_at")


def posteriors(rows: DataFrame, model: Classifier, buckets: int = BUCKETS) -> DataFrame:
    """rows (words) with ``posterior``, an array in the order of the domains; without words it is the priors."""
    out = _evidence(rows, model.shares, buckets)
    logits = F.zip_with(_array(model.priors), "evidence", lambda p, e: p + model.sharpness * e)
    out = out.withColumn("_odds", logits).withColumn("_odds", F.transform("_odds", lambda x: F.exp(x - F.array_max("_odds"))))
    whole = F.aggregate("_odds", F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("_whole", whole).withColumn("posterior", F.transform("_odds", lambda x: x / F.col("_whole"))).drop("_odds", "_whole", "evidence")


def _rate(steps: list[list[float]], least: float) -> Column:
    """Rate after the given rounds: each moves it by the posterior's share of the residuals, not under ``least``."""
    if not steps:
        return F.lit(max(1.0, least))
    history = F.array(*[_array(s) for s in steps])
    return F.aggregate(history, F.lit(max(1.0, least)), lambda r, s: F.greatest(F.lit(least), r - _dot(F.col("posterior"), s)))


def fit_rates(rows: DataFrame, names: list[str], targets: dict[str, float] | None = None, least: float = 0.0, rounds: int = ROUNDS) -> Fit:
    """Rates at which the domains' expected totals meet the targets.

    Without targets the weights are the natural ones to the power ``FLATTEN``. The totals aimed at sum to
    the natural sum, or with ``least`` = 1 to the smallest sum at which no domain has to shrink. Targets
    that no rates reach, or that ``rounds`` rounds do not, are reported by a warning and in the result.
    """

    def totals(rate: Column) -> list[float]:
        got = rows.agg(*[F.sum(F.col("n_tokens") * rate * F.col("posterior")[d]).alias(f"s{d}") for d in range(len(names))]).first()
        return [float(x or 0.0) for x in got]

    natural = totals(F.lit(1.0))
    raw = [targets.get(n, 0.0) if targets else c**FLATTEN for n, c in zip(names, natural)]
    weights = [x / (sum(raw) or 1.0) for x in raw]
    budget = sum(natural)
    if least >= 1:
        budget = max([least * c / w for c, w in zip(natural, weights) if w > 0], default=0.0)
    aim = [budget * w for w in weights]
    met = lambda now: all(abs(s - t) <= TOLERANCE * max(budget, 1.0) for s, t in zip(now, aim))
    steps: list[list[float]] = []
    now = natural if least <= 1 else totals(_rate(steps, least))
    while not met(now) and len(steps) < rounds:
        steps.append([(s - t) / c if c > 0 else 0.0 for s, t, c in zip(now, aim, natural)])
        now = totals(_rate(steps, least))
    if not met(now):
        warnings.warn(f"mixing stopped after {len(steps)} rounds, {max(abs(s - t) for s, t in zip(now, aim)) / max(budget, 1.0):.2e} of all tokens off its targets", RuntimeWarning, stacklevel=2)
    return Fit(_rate(steps, least), natural, aim, now, len(steps), met(now))


def mix(docs: DataFrame, label: str = "lang", targets: dict[str, float] | None = None, least: float = 0.0) -> DataFrame:
    """One row per document: doc_id, domain, posterior, n_tokens, rate (6 decimals), copies.

    copies is the whole part of the rate, and one more with the probability of the rest, drawn by a hash
    of id and text. A null or empty text has no tokens and the priors as posterior; a text of any length
    is read whole. Ties between domains go to the first in order. Without any labelled row there is no
    domain: domain is null, the rate 1. Repeated rows are treated alike; other columns are ignored.
    """
    return rated(docs, label, targets, least).drop("draw")


def rated(docs: DataFrame, label: str, targets: dict[str, float] | None, least: float) -> DataFrame:
    """``mix`` with ``draw``, the hash by which a row can be found again."""
    model = learn(docs, label)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("draw"), F.ceil(F.octet_length(text) / F.lit(BYTES_PER_TOKEN)).cast("double").alias("n_tokens"), _words(text).alias("words"))
    if not model.names:
        empty = F.array().cast("array<double>")
        return rows.select("doc_id", "draw", F.lit(None).cast("string").alias("domain"), empty.alias("posterior"), F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    soft = materialise(posteriors(rows, model).drop("words"))
    rate = fit_rates(soft, model.names, targets, least).rate
    best = F.get(F.array(*[F.lit(n) for n in model.names]), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    share = F.pmod("draw", F.lit(1_000_003)) / F.lit(1_000_003.0)
    done = soft.withColumn("rate", F.round(rate, 6))
    copies = (F.floor("rate") + F.when(share < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return done.select("doc_id", "draw", best.alias("domain"), F.transform("posterior", lambda x: F.round(x, 6)).alias("posterior"), F.col("n_tokens").cast("long").alias("n_tokens"), "rate", copies.alias("copies"))


def resample(docs: DataFrame, label: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """The pipeline stage: each row of docs as often as its copies say, at least once, so no document goes.

    All columns pass through under their own names, whatever these are.
    """
    more = rated(docs, label, targets, least=1.0).groupBy("draw").agg(F.max("copies").alias("copies")).where("copies > 1")
    safe, new = renamed(docs)
    joined = safe.withColumn("draw", F.xxhash64(new["doc_id"], new["text"])).join(more, "draw", "left")
    return joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))).select(*restored(new))
