"""Operator 8: mixing sources to target weights by soft membership, in DataFrame functions only.

A classifier learnt from a labelled table gives every document a probability for each domain. The
documents' rates are the nonnegative numbers nearest to 1 whose expected tokens per domain meet the
targets: least squares by projected gradient, one distributed sum over the documents per step. The
rate of a document after any number of steps follows from its own probabilities and the steps'
residuals, one small vector each, so no step needs to write the rates.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.shared import filled, stored

FEATURES = 1 << 12
#: Labelled rows the classifier is fitted on, at most.
SAMPLE_ROWS = 4_000
STEPS = 100
TOLERANCE = 1e-4


def token_estimate(text: Column) -> Column:
    """Tokens of a text by its length in bytes, four to a token, and one for its end."""
    return F.floor(F.octet_length(text) / 4).cast("double") + 1


def posteriors(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with the array ``__p`` of domain probabilities and ``__t`` tokens, and the domains in the array's order.

    ``labelled``: (doc_id, domain). At most ``sample`` labelled rows, drawn by a hash of the id, fit a logistic
    regression on hashed word counts. With labels of fewer than two domains every document is of the one, or of "all".
    """
    known = labelled.filter("domain is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("domain").alias("__domain"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    text = filled(text_col)
    fit = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).join(F.broadcast(chosen), "__id").groupBy("__id", "__domain").agg(F.min("__text").alias("__text"))
    fit = stored(fit, "labelled")
    domains = sorted(r[0] for r in fit.select("__domain").distinct().collect())  # the domains of a label set
    rows = docs.withColumns({"__text": text, "__t": token_estimate(text)})
    if len(domains) < 2:
        return rows.drop("__text").withColumn("__p", F.array(F.lit(1.0))), domains or ["all"]
    words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"\s+", minTokenLength=1)
    counts = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=FEATURES, binary=True)
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("__domain")).cast("double") - 1
    model = LogisticRegression(featuresCol="__counts", labelCol="__y", regParam=0.01, maxIter=30, family="multinomial", probabilityCol="__probability", predictionCol="__prediction", rawPredictionCol="__raw")
    model = model.fit(counts.transform(words.transform(fit.withColumn("__y", place))))
    scored = model.transform(counts.transform(words.transform(rows)))
    scored = scored.withColumn("__p", vector_to_array("__probability"))
    return scored.drop("__text", "__words", "__counts", "__raw", "__probability", "__prediction"), domains


def rate(p: Column, steps: list[list[float]], least: float = 0.0) -> Column:
    """Rate of a document after projected gradient steps, each one vector over the domains: rate <- max(least, rate - p . step), from 1."""
    if not steps:
        return F.lit(1.0)
    per_step = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    push = lambda s: F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda at, x: at + x)
    return F.aggregate(per_step, F.lit(1.0), lambda r, s: F.greatest(F.lit(least), r - push(s)))


def least_rate(total: float | str) -> float:
    """Below which no rate falls: "enough" thins no document."""
    return 1.0 if total == "enough" else 0.0


def step_to_any_total(light: DataFrame, have: np.ndarray, weights: np.ndarray) -> list[float] | None:
    """The step that leads to the rates of 1 or more nearest to 1 whose tokens have the wanted shares, whatever their total.

    These are max(1, 1 + p . m) with weights . m = 0; Newton steps on the dual find m, with one distributed sum each.
    None where no such rates are found: the shares are not among what the documents' probabilities have between them.
    """
    k = range(len(have))
    free = np.linalg.svd(weights[None, :])[2][1:]  # directions in which tokens miss the shares
    part = lambda i: F.col("__t") * F.col("__p")[i]

    def at(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        up = F.lit(0.0)
        for i in k:
            up = up + F.col("__p")[i] * F.lit(float(m[i]))
        rows = light.filter(up > 0)
        sums = rows.agg(F.sum(F.col("__t") * up * up), *(F.sum(part(i) * up) for i in k), *(F.sum(part(i) * F.col("__p")[j]) for i in k for j in k)).first()
        sums = np.asarray([float(x or 0.0) for x in sums])
        return sums[0] / 2 + m @ have, free @ (sums[1 : 1 + len(k)] + have), free @ sums[1 + len(k) :].reshape(len(k), len(k)) @ free.T

    best = -free @ have / have.sum()
    value, miss, curve = at(free.T @ best)
    for _ in range(STEPS):
        if np.abs(miss).max() <= TOLERANCE * have.sum():
            return [float(-x) for x in free.T @ best]
        move = -np.linalg.pinv(curve, hermitian=True) @ miss
        size = 1.0
        while size > 1e-6:
            after = at(free.T @ (best + size * move))
            if after[0] < value:
                break
            size /= 2
        else:
            return None
        best, (value, miss, curve) = best + size * move, after
    return None


def fitted_steps(light: DataFrame, domains: list[str], targets: Mapping[str, float], total: float | str) -> list[list[float]]:
    """The steps that bring the expected tokens per domain to the targets, from rows (__t, __p).

    With A the tokens of each document in each domain, a step moves the rates against the gradient of
    |A rate - wanted| squared, measured so that the curvature is 1: the whole gap is made up at once unless rates
    stop at the least. Documents of equal probabilities get equal rates, whatever their length.
    """
    k = range(len(domains))
    part = lambda i: F.col("__t") * F.col("__p")[i]
    sums = light.agg(*(F.sum(part(i)) for i in k), *(F.sum(part(i) * F.col("__p")[j]) for i in k for j in k)).first()
    have = np.asarray([float(x or 0.0) for x in sums[: len(domains)]])
    if not have.sum():
        return []
    weights = np.asarray([max(0.0, float(targets.get(d, 0.0))) for d in domains])
    weights = weights / weights.sum() if weights.sum() else have / have.sum()
    inverse = np.linalg.pinv(np.asarray([float(x) for x in sums[len(domains) :]]).reshape(len(domains), len(domains)))
    least = least_rate(total)
    if total == "same":
        total = have.sum()
    elif total == "enough":
        # from rates of 1, one step makes them total * p . gain; none is below 1 if no part of the gain is below 1 / total
        gain = inverse @ weights
        if not (gain > 0).all() and (step := step_to_any_total(light, have, weights)) is not None:
            return [step]
        total = (1 / gain).max() if (gain > 0).all() else (have[weights > 0] / weights[weights > 0]).max()
    wanted = weights * float(total)
    steps: list[list[float]] = []
    reached = have
    while np.abs(reached - wanted).max() > TOLERANCE * wanted.sum() and len(steps) < STEPS:
        steps.append([float(x) for x in inverse @ (reached - wanted)])
        taken = light.select(rate(F.col("__p"), steps, least).alias("__r"), "__t", "__p")
        before, reached = reached, np.asarray([float(x or 0.0) for x in taken.agg(*(F.sum(F.col("__r") * part(i)) for i in k)).first()])
        if np.abs(reached - before).max() <= TOLERANCE * 1e-3 * wanted.sum():  # the targets are out of reach: this is the nearest
            break
    return steps


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], total: float | str = "same", sample: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens, rate (how often to take the document), posteriors (by domain).

    ``targets`` are the wanted shares of tokens by domain. Domains without labelled rows cannot be told apart and are left
    out; what is left is scaled to 1. ``total`` is the number of tokens wanted, "same" for as many as there are, or "enough"
    for one that thins no document: rates are then 1 or more, else nonnegative. They are as near to 1 as the targets allow;
    where they cannot be met, they are met as nearly as possible. With "enough" that is so only for shares beyond what the
    documents' probabilities have between them; the total is then what the most plentiful domain has by its share. Null and empty texts have one token; repeated rows each have a rate; other columns are
    ignored; an empty table gives an empty table.
    """
    rows, domains = posteriors(docs, labelled, sample, id_col, text_col)
    light = stored(rows.select(F.col(id_col).alias("doc_id"), "__t", "__p"), "posteriors")
    steps = fitted_steps(light, domains, targets, total)
    named = F.map_from_arrays(F.array(*map(F.lit, domains)), F.col("__p"))
    return light.select("doc_id", F.col("__t").cast("long").alias("tokens"), rate(F.col("__p"), steps, least_rate(total)).alias("rate"), named.alias("posteriors"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], total: float | str = "enough", sample: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row repeated as often as its rate says, columns and order of columns kept.

    A rate's fraction is decided by a hash of id and text, so that it is met on average and every run decides alike.
    """
    rows, domains = posteriors(docs, labelled, sample, id_col, text_col)
    steps = fitted_steps(stored(rows.select("__t", "__p"), "posteriors"), domains, targets, total)
    lot = F.pmod(F.xxhash64(F.col(id_col), filled(text_col), F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(rate(F.col("__p"), steps, least_rate(total)) + lot).cast("int")
    return rows.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of labels: toxic, good or poor; rows without the labels it takes have none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))
