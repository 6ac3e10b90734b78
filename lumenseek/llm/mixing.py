"""Mixing sources to target weights with soft domain membership; DataFrame functions only.

1. A table of labelled documents trains a naive Bayes classifier on the presence
   of the ``VOCABULARY`` words that tell most about the domain.
2. Every document gets posterior probabilities of the domains, to two decimals.
   Documents with equal posteriors are one group with the sum of their tokens.
3. Projected gradient least squares finds document rates r >= ``least`` for which
   the expected token totals of the domains, sum of r * tokens * posterior, are
   closest to the targets. A step needs sums over the groups only; the driver sees
   a number per pair of domains, and the rate of a document is the same short
   formula of its posterior everywhere, so nothing is joined back.

With ``least`` = 1 the targets are scaled so that no domain has to shrink, and
documents are repeated but never dropped; with 0 the total of tokens is kept.
Null, empty and letterless texts have no tokens and the prior as posterior.
Repeated rows are repeated documents. Without labelled rows there is one domain,
``none``, and all rates are 1.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lumenseek.llm.common import bind, staged

#: Most labelled rows the classifier is fitted on; they are chosen by hash of the id.
MAX_SAMPLE = 20_000
VOCABULARY, LEAST_DOCS = 128, 5
STEPS, CLOSE = 100, 1e-3
#: Target weights without other wishes: shares of tokens to this power, which favours small domains.
FLATTEN = 0.7


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))),
                                  r"[^\p{L}]+"), "")


@dataclass(frozen=True)
class Domains:
    names: list[str]
    vocabulary: list[str]
    weights: list[list[float]]
    prior: list[float]

    def members(self, text: str) -> Column:
        """Struct of n_tokens and posterior, with every step evaluated once per row."""
        known = F.array(*[F.lit(w) for w in self.vocabulary]) if self.vocabulary else F.expr("cast(array() as array<string>)")
        start = F.array(*[F.lit(float(x)) for x in self.prior])
        table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in self.weights or [self.prior]])

        def logits(w: Column) -> Column:
            return F.aggregate(F.array_intersect(w, known), start, lambda acc, x: F.zip_with(
                acc, F.get(table, F.array_position(known, x).cast("int") - 1), lambda a, b: a + b))

        def shares(e: Column) -> Column:
            return bind(F.aggregate(e, F.lit(0.0), lambda a, x: a + x),
                         lambda total: F.transform(e, lambda x: F.round(x / total, 2)))

        def posterior(values: Column) -> Column:
            return bind(F.array_max(values), lambda top: bind(F.transform(values, lambda x: F.exp(x - top)), shares))

        return bind(words(text), lambda w: F.struct(F.size(w).alias("n_tokens"), bind(logits(w), posterior).alias("posterior")))


def fit_domains(labelled: DataFrame, most: int = MAX_SAMPLE) -> Domains:
    """Classifier of ``labelled(doc_id, text, domain)``; rows with a null domain are left out."""
    rows = labelled.where("domain is not null and text is not null")
    chosen = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if chosen is None:
        return Domains(["none"], [], [], [0.0])
    sample = rows.where(F.xxhash64("doc_id") <= chosen).select("domain", F.array_distinct(words("text")).alias("w"))
    sample = staged(sample, "mixing-sample")
    size = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    names, total = sorted(size), sum(size.values())
    counts = (sample.select("domain", F.explode("w").alias("word")).groupBy("word")
              .agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(names)])
              .withColumn("n", sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))).where(F.col("n") >= LEAST_DOCS))
    told = F.lit(0.0)  # mutual information of word and domain, but for a constant factor
    for i, d in enumerate(names):
        for seen, out_of in ((F.col(f"n{i}"), F.col("n")), (size[d] - F.col(f"n{i}"), total - F.col("n"))):
            told = told + F.when(seen > 0, seen * F.log(seen * total / (out_of * F.lit(size[d])))).otherwise(0.0)
    best = counts.withColumn("told", told).orderBy(F.desc("told"), "word").limit(VOCABULARY).collect()
    share = [[(r[f"n{i}"] + 0.5) / (size[d] + 1) for i, d in enumerate(names)] for r in best]
    # Absent words are in the prior, so that only present ones need a lookup.
    prior = [log(size[d] / total) + sum(log(1 - row[i]) for row in share) for i, d in enumerate(names)]
    return Domains(names, [r.word for r in best], [[log(x / (1 - x)) for x in row] for row in share], prior)


def _rate(posterior: Column, steps: list[list[float]], least: float) -> Column:
    """Rate of a document after the gradient steps so far, each projected to at least ``least``."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    return bind(posterior, lambda q: F.aggregate(history, F.lit(1.0), lambda r, g: F.greatest(
        F.lit(float(least)), r - F.aggregate(F.zip_with(q, g, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))))


def fit_rates(members: DataFrame, domains: Domains, weights: dict[str, float] | None = None,
              least: float = 0.0) -> tuple[list[list[float]], dict[str, float]]:
    """(gradient steps, target tokens) for ``members(posterior, n_tokens)``.

    Weights of domains that the data lack are left out and the rest scaled.
    """
    many = range(len(domains.names))
    groups = staged(members.groupBy("posterior").agg(F.sum("n_tokens").cast("double").alias("n")), "mixing-groups")
    p = [F.col("posterior")[c] for c in many]
    first = groups.agg(*[F.sum(F.col("n") * p[a]).alias(f"s{a}") for a in many],
                       *[F.sum(F.col("n") * p[a] * p[b]).alias(f"m{a}_{b}") for a in many for b in many]).first()
    now = [first[f"s{c}"] or 0.0 for c in many]
    total = sum(now)
    if total <= 0:
        return [], dict.fromkeys(domains.names, 0.0)
    wish = {d: (weights.get(d, 0.0) if weights else (now[c] / total) ** FLATTEN) if now[c] > 0 else 0.0
            for c, d in enumerate(domains.names)}
    share = [wish[d] / (sum(wish.values()) or 1.0) for d in domains.names]
    goal = total if least < 1 else max(total, max(s / w for s, w in zip(now, share) if w > 0))
    target = [goal * w for w in share]
    steps: list[list[float]] = []
    gap = [x - t for x, t in zip(now, target)]
    scaled = True
    while len(steps) < STEPS and max(map(abs, gap)) > CLOSE * goal * min(w for w in share if w > 0):
        rate = _rate(F.col("posterior"), steps, least)
        moves = (rate > least) | (_dot(F.col("posterior"), gap) < 0)  # the others stay at the bound
        m = groups.where(moves).agg(*[F.sum(F.col("n") * p[a] * p[b]) for a in many for b in many]).first()
        m = np.array([x or 0.0 for x in m]).reshape(len(many), len(many))
        if not m.any():
            break
        # Scaled by the second moments of the documents that can move; plain where that step did not help.
        step = np.linalg.pinv(m) @ gap if scaled else np.array(gap) / m.sum(axis=1).max()
        tried = [*steps, step.tolist()]
        sums = groups.withColumn("r", _rate(F.col("posterior"), tried, least) * F.col("n")).agg(*[F.sum(F.col("r") * p[c]) for c in many]).first()
        after = [x - t for x, t in zip(sums, target)]
        better = sum(x * x for x in after) < (1 - 1e-6) * sum(x * x for x in gap)
        if better:
            steps, gap = tried, after
        elif not scaled:  # least squares reached: the targets lie beyond the bound
            break
        scaled = better
    return steps, dict(zip(domains.names, target))


def _dot(posterior: Column, values: list[float]) -> Column:
    return sum((posterior[c] * F.lit(float(v)) for c, v in enumerate(values)), F.lit(0.0))


def _copies(rate: Column, key: Column) -> Column:
    """The rate rounded up or down by a hash of the key, so that the expected number of copies is the rate."""
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1 << 20)) / F.lit(float(1 << 20))).cast("int")


def fitted(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, least: float = 0.0):
    """(members, domains, steps, targets): staged ``doc_id``, ``n_tokens``, ``posterior`` of all documents, and the fit."""
    domains = fit_domains(labelled)
    members = staged(docs.select("doc_id", domains.members("text").alias("m")).select("doc_id", "m.*"), "mixing-members")
    steps, targets = fit_rates(members, domains, weights, least)
    return members, domains, steps, targets


def op1_mixing(docs: DataFrame, weights: dict[str, float] | None = None, least: float = 1.0) -> DataFrame:
    """Rate and copies of every document for the target weights of the languages, the labelled domains."""
    labelled = docs.select("doc_id", "text", F.col("lang").alias("domain"))
    members, domains, steps, _ = fitted(docs, labelled, weights, least)
    names = F.array(*[F.lit(d) for d in domains.names])
    out = members.withColumn("rate", _rate(F.col("posterior"), steps, least))
    return out.select("doc_id", "n_tokens", F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
                      .alias("domain"), "posterior", "rate", _copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def repeated(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, least: float = 1.0) -> DataFrame:
    """Rows of ``docs``, each as often as its rate says; columns of any name are kept as they are."""
    _, domains, steps, _ = fitted(docs, labelled, weights, least)
    rate = _rate(domains.members("text")["posterior"], steps, least)
    times, copy = (f"{name}_{uuid.uuid4().hex}" for name in ("times", "copy"))
    copies = F.sequence(F.lit(1), _copies(rate, F.col("doc_id")))
    kept = docs.withColumn(times, F.when(_copies(rate, F.col("doc_id")) > 0, copies) if least < 1 else copies)
    return kept.select(*docs.columns, F.explode(times).alias(copy)).drop(copy)
