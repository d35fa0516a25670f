"""Mixing sources to target weights by soft membership.

A classifier learnt from the labelled table gives every document posterior probabilities of the
domains; the document's rate (how many times it is to be drawn, on average) is fitted so that the
expected tokens of each domain meet the targets:

    minimise |A r - T|^2 over r >= 0,   A[d, i] = posterior[i, d] * tokens[i]

by scaled projected gradient steps r <- max(0, r - W A' M (A r - T)), with W = diag(1 / tokens) and M the
inverse of A W A' over the documents that the step leaves above zero (two-metric projection): where none
is held at zero, one step is exact, and otherwise the last steps converge as Newton's do. A step that doesn't lessen the
residual is halved. A step needs a few sums of the size of the domains only, combined before the shuffle;
rates are functions of the posteriors and of the steps so far, so nothing is gathered and no document is
dropped: a rate may be 0, but its row stays. The fit ends when every domain's expected tokens are within `tolerance`
of all tokens wanted; where the targets can't be met that closely (a domain that no document
may be in, say) it ends when no step helps, and says so in a warning with the totals reached.

The classifier is naive Bayes over hashed tokens: lower-cased words and the shapes of
white-space-separated tokens (runs of lower-case letters, capitals and digits each as one sign), once
per document and bucket. It is summed over all labelled documents.

Everything runs in DataFrame expressions. Defined results: null and empty texts have no tokens and the
class priors as posteriors; labels with a null are left out; an id with several labels teaches each;
without labels all domains are equally likely; a domain without a target has target 0; domains of no
mass are ignored by the fit; repeated rows count each; rows without an id are scored and not learnt
from. Extra columns stay unless named as the result's.
"""

from __future__ import annotations

import json
import math
import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, free, table

BUCKETS = 1 << 14
#: Domains are the labelled pairs; shares of all tokens that each is to have.
TARGETS = {"good": 0.80, "good_toxic": 0.04, "poor": 0.15, "poor_toxic": 0.01}


def domain_of(quality: Column, toxic: Column) -> Column:
    name = F.when(quality == 1, F.when(toxic == 1, "good_toxic").when(toxic == 0, "good"))
    return name.when(quality == 0, F.when(toxic == 1, "poor_toxic").when(toxic == 0, "poor"))


def token_features(docs: DataFrame, *, keep: list[str], text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """keep, tokens (white-space-separated, long) and grams: the distinct hash buckets of words and shapes."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("__t", r"[a-z\x{80}-\x{10FFFF}]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    rows = rows.select(*keep, F.filter(F.split(F.lower("__t"), r"[\s\p{Punct}]+"), lambda w: w != "").alias("__w"), F.filter(F.split(shape, r"\s+"), lambda w: w != "").alias("__s"))

    def bucket(w: Column, seed: str) -> Column:
        return F.pmod(F.hash(w, F.lit(seed)), F.lit(buckets)).cast("smallint")

    grams = F.array_distinct(F.concat(F.transform("__w", lambda w: bucket(w, "word")), F.transform("__s", lambda w: bucket(w, "shape"))))
    return rows.select(*keep, F.size("__s").cast("long").alias("tokens"), grams.alias("grams"))


class DomainModel:
    def __init__(self, domains: list[str], prior: list[float], likelihood: np.ndarray):
        self.domains, self.prior, self.likelihood = domains, prior, likelihood

    def with_posterior(self, rows: DataFrame) -> DataFrame:
        """rows (with grams) and posterior, array<double> in the order of domains.

        Each step is a column of its own: inside a lambda, what it is built from would be computed again for
        every element.
        """
        if not self.domains:
            return rows.withColumn("posterior", F.array().cast("array<double>"))
        logs = []
        for p, row in zip(self.prior, self.likelihood, strict=True):
            weights = F.from_json(F.lit(json.dumps([round(float(x), 5) for x in row])), "array<double>")
            logs.append(_sum_of(F.col("grams"), weights, math.log(p)))
        rows = rows.withColumn("__logs", F.array(*logs))
        rows = rows.withColumn("__parts", F.transform("__logs", lambda x: F.exp(F.greatest(x - F.array_max("__logs"), F.lit(-60.0)))))
        return rows.withColumn("posterior", _normalised(F.col("__parts"))).drop("__logs", "__parts")


def _sum_of(grams: Column, weights: Column, start: float) -> Column:
    return F.aggregate(grams, F.lit(float(start)), lambda a, g: a + F.get(weights, g.cast("int")))


def _normalised(parts: Column) -> Column:
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def train(features: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", domain: Column | None = None, smoothing: float = 5000.0, buckets: int = BUCKETS) -> DomainModel:
    """features: token_features with the id; labels: the labelled table, domain an expression over it;
    smoothing: how many grams of the whole labelled corpus's mixture each domain is given beforehand."""
    domain = domain_of(F.col("quality"), F.col("toxic")) if domain is None else domain
    known = labels.select(F.col(id_col).alias("__id"), domain.alias("domain")).where("__id is not null and domain is not null").distinct()
    rows = features.join(known, F.col(id_col) == F.col("__id")).select("domain", "grams")
    # a gram of -1 counts the documents; buckets by domains, whatever the corpus
    counts = rows.select("domain", F.explode(F.concat(F.array(F.lit(-1).cast("smallint")), "grams")).alias("g")).groupBy("domain", "g").agg(F.count("*").alias("n")).collect()
    domains = sorted({r.domain for r in counts})
    if not domains:
        return DomainModel([], [], np.zeros((0, buckets)))
    table_ = np.zeros((len(domains), buckets + 1))
    for r in counts:
        table_[domains.index(r.domain), r.g] = r.n
    n, seen = table_[:, -1], table_[:, :-1]
    everywhere = (seen.sum(axis=0) + 1) / (seen.sum() + buckets)
    rate = (seen + smoothing * everywhere) / (seen.sum(axis=1, keepdims=True) + smoothing)
    return DomainModel(domains, list(n / n.sum()), np.log(rate) - np.log(everywhere))


class Fit(NamedTuple):
    """steps: the vectors y; the rate starts at 1 and goes to max(0, rate - posterior . y) for each of them.
    wanted and reached: tokens by domain. met: whether they agree within the tolerance."""

    steps: list[list[float]]
    wanted: list[float]
    reached: list[float]
    met: bool


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], *, tolerance: float = 1e-9, most: int = 200) -> Fit:
    """rows: posterior array<double> and tokens, cut. targets: tokens wanted of each domain. most: evaluations
    (a job each) after which a fit that still improves is given up, with a warning; a dozen are usual."""
    k = len(domains)
    p = [F.get("posterior", F.lit(d)) for d in range(k)]
    wanted = np.array([float(targets.get(d, 0.0)) for d in domains])
    scale = max(1.0, float(np.abs(wanted).sum()))

    def evaluate(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """The expected tokens of the domains after steps, and A W A' over the documents of a rate above 0."""
        now = rows.select("tokens", "posterior", rate_of(steps, k).alias("rate"))
        free = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0)
        sums = [F.sum(F.col("rate") * F.col("tokens") * p[d]).alias(f"t{d}") for d in range(k)]
        sums += [F.sum(free * p[d] * p[e]).alias(f"g{d}_{e}") for d in range(k) for e in range(d, k)]
        got = now.agg(*sums).first()
        return np.array([got[f"t{d}"] or 0.0 for d in range(k)]), np.array([[got[f"g{min(d, e)}_{max(d, e)}"] or 0.0 for e in range(k)] for d in range(k)])

    steps: list[list[float]] = []
    reached, gram = evaluate(steps)
    first, done = gram, 1
    while np.abs(reached - wanted).max() > tolerance * scale and done < most:
        off = reached - wanted
        better = False
        for g in (gram, first):  # over the free documents; should that not help, over all
            y = np.linalg.pinv(g, rcond=1e-12, hermitian=True) @ off
            for _ in range(30):
                if done >= most or np.abs(y).max() < 1e-15:
                    break
                now, free = evaluate([*steps, y.tolist()])
                done += 1
                if np.linalg.norm(now - wanted) < np.linalg.norm(off) * (1 - 1e-6):
                    better = True
                    break
                y = y / 2
            if better:
                break
        if not better:
            break
        steps.append(y.tolist())
        reached, gram = now, free
    met = bool(np.abs(reached - wanted).max() <= tolerance * scale)
    if not met:
        warnings.warn(f"mixing: targets {dict(zip(domains, wanted.tolist(), strict=True))} not met: {dict(zip(domains, reached.tolist(), strict=True))} after {done} evaluations", stacklevel=2)
    return Fit(steps, wanted.tolist(), reached.tolist(), met)


def rate_of(ys: list[list[float]], k: int) -> Column:
    """The rate after the steps ys, from the column posterior."""
    if not ys:
        return F.lit(1.0)
    steps = F.from_json(F.lit(json.dumps(ys)), "array<array<double>>")

    def step(r: Column, y: Column) -> Column:
        dot = sum((F.get("posterior", F.lit(d)) * F.get(y, F.lit(d)) for d in range(1, k)), F.get("posterior", F.lit(0)) * F.get(y, F.lit(0)))
        return F.greatest(F.lit(0.0), r - dot)

    return F.aggregate(steps, F.lit(1.0), step)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, *, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, keep: list[str] | None = None, smoothing: float = 5000.0) -> DataFrame:
    """The kept columns (all by default), tokens, posterior (array<double> by sorted domain), rate and copies.

    targets: shares of all tokens by domain. copies: the rate rounded up or down by a hash of the row, so
    that sampled copies have the rates on average.
    """
    ours = ("tokens", "posterior", "rate", "copies")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ours]
    targets = TARGETS if targets is None else targets
    row, same = free("row", docs.columns), free("same", docs.columns)
    here = docs.withColumn(row, F.xxhash64(*docs.columns))
    rows = cut(token_features(here, keep=[id_col, row], text_col=text_col))
    model = train(rows, labels, id_col=id_col, domain=domain, smoothing=smoothing)
    scored = cut(model.with_posterior(rows).select(id_col, row, "tokens", "posterior"))
    total = scored.agg(F.sum("tokens")).first()[0] or 0
    ys = fit_rates(scored, model.domains, {d: s * total for d, s in targets.items()}).steps if model.domains else []
    rated = scored.withColumn("rate", rate_of(ys, len(model.domains)))
    unit = F.shiftrightunsigned(F.xxhash64(row, F.lit("copies")), 11) / F.lit(float(1 << 53))
    rated = rated.withColumn("copies", (F.floor("rate") + F.when(unit < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
    if keep == [id_col]:
        return rated.select(id_col, *ours)
    # rows alike in all columns have the same figures
    rated = rated.select(F.col(row).alias(same), *ours).dropDuplicates([same])
    return here.select(*keep, row).join(rated, F.col(row) == F.col(same), "left").select(*keep, *ours)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
