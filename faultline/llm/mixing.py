"""Mixing sources to target weights by soft membership (operator 1), in DataFrame operations only.

1. Classifier. A labelled table (doc_id, domain) is joined with the documents; a multinomial
   naive Bayes over the VOCABULARY most frequent words of at most `max_train` labelled rows (those
   of smallest doc_id hash) gives each domain's log probability of a word. Model: VOCABULARY x
   domains numbers at most, so it is broadcast.
2. Posteriors. Every text's words meet the model; sums of log probabilities, tempered by the
   square root of the number of known words (words of a text are not independent evidence),
   give p(domain | text).
3. Rates. Document d has n_d tokens (words). Find rates r_d >= min_rate with
   sum_d r_d n_d p_dk = T_k for each domain k, T_k = budget x weight_k, by projected gradient on
   sum_k (S_k - T_k)^2 / C_k, C_k being the tokens expected at rate 1. The gradient lies in the
   span of the posteriors, so a step is K numbers v, r_d falls by sum_k p_dk v_k and is cut to the
   bound; v solves the damped K x K curvature of the documents that are free to move. A pass over
   the documents sums K or K x K numbers; a document's rate follows from its posteriors and the
   short list of past steps, so no state is kept and a lost executor costs nothing.

Results: (doc_id, text_hash, n_rows, n_tokens, p_<domain>..., rate), one row for each distinct
(doc_id, text); n_rows tells how many rows share it and all of them have that rate.

Defined results: null and empty texts have no tokens, the prior as posterior and a rate like any
other; rows that share doc_id and text are one row of n_rows; a null doc_id is kept; labels that
are null, of unknown documents or of domains without a target are ignored; a target domain that
no text can supply keeps its residual; without labelled words posteriors are the targets; a
weight of null or below 0 counts as 0; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import saved, whole_row

VOCABULARY = 4096
MAX_TRAIN = 4_000


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _words(text: Column) -> Column:
    return F.split(F.lower(text), "[\\s\\p{Punct}]+")


def train_words(docs: DataFrame, labelled: DataFrame, domains: list[str], max_train: int = MAX_TRAIN, vocabulary: int = VOCABULARY, smoothing: float = 0.5) -> DataFrame:
    """(word, l_0, l_1, ...): log probabilities of the vocabulary's words for each domain."""
    marked = (
        labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
        .where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    counts = (
        _keyed(docs)
        .join(F.broadcast(marked), "doc_id")
        .select("domain", F.explode(_words(F.col("text"))).alias("word"))
        .where("word != ''")
        .groupBy("word")
        .agg(*[F.count_if(F.col("domain") == d).alias(f"c_{k}") for k, d in enumerate(domains)], F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(vocabulary)
        .drop("n")
    )
    kept = saved(counts, "mixing-words")  # vocabulary rows at most
    totals = kept.agg(F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(f"c_{k}"), F.lit(0)).alias(f"t_{k}") for k in range(len(domains))]).first()
    prob = lambda k: F.log((F.col(f"c_{k}") + smoothing) / (totals[f"t_{k}"] + smoothing * max(totals["v"], 1)))
    return kept.select("word", *[prob(k).alias(f"l_{k}") for k in range(len(domains))])


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str], prior: list[float]) -> DataFrame:
    """(doc_id, text_hash, n_rows, n_tokens, p array<double>): one pass, one shuffle of a row for each text."""
    k_all = range(len(domains))
    tokens = _keyed(docs).select("doc_id", "text_hash", F.posexplode(_words(F.col("text"))).alias("pos", "word"))
    met = (
        tokens.join(F.broadcast(model), "word", "left")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count_if(F.col("pos") == 0).alias("n_rows"),
            F.count_if(F.col("word") != "").alias("words"),
            F.count("l_0").alias("known"),
            *[F.sum(f"l_{k}").alias(f"s_{k}") for k in k_all],
        )
    )
    scale = F.sqrt(F.greatest(F.col("known"), F.col("n_rows")).cast("double") * F.col("n_rows"))
    logit = [F.round(F.coalesce(F.col(f"s_{k}") / scale, F.lit(0.0)) + (math.log(prior[k]) if prior[k] > 0 else -700.0), 9) for k in k_all]
    raw = met.select("doc_id", "text_hash", "n_rows", (F.col("words") / F.col("n_rows")).cast("long").alias("n_tokens"), F.array(*logit).alias("g"))
    top = raw.withColumn("top", F.array_max("g")).withColumn("e", F.transform("g", lambda x: F.exp(x - F.col("top"))))
    total = reduce(lambda a, b: a + b, [F.get("e", F.lit(k)) for k in k_all])
    return top.select("doc_id", "text_hash", "n_rows", "n_tokens", F.array(*[F.get("e", F.lit(k)) / total for k in k_all]).alias("p"))


def _dot(p: Column, values: Column, n: int, first: int = 0) -> Column:
    return reduce(lambda a, b: a + b, [F.get(p, F.lit(k)) * F.get(values, F.lit(first + k)) for k in range(n)])


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _rate(past: list[list[float]], n: int, min_rate: float, max_rate: float | None) -> Column:
    """A document's rate after the steps in past, each the gradient by domain and then the step by domain: free documents (above the bound, or pulled up) move and are cut to the bounds."""
    start = F.lit(max(1.0, min_rate))
    if not past:
        return start

    def step(rate: Column, g: Column) -> Column:
        moved = F.greatest(F.lit(min_rate), rate - _dot(F.col("p"), g, n, n))
        moved = F.least(F.lit(max_rate), moved) if max_rate is not None else moved
        return F.when((rate > min_rate) | (_dot(F.col("p"), g, n) < 0), moved).otherwise(rate)

    return F.aggregate(F.array(*[_numbers(g) for g in past]), start, step)


def fit_rates(members: DataFrame, weights: list[float], budget: float | None = None, min_rate: float = 0.0, max_rate: float | None = None, max_steps: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """members with a `rate`. budget: tokens in all; by default what they have, or, with min_rate > 0, the least at which no domain must be thinned below min_rate.

    Steps end when every domain is within the tolerance of its target or the misfit no longer falls
    (targets may be out of reach); a fit that is still moving after max_steps gives a warning.
    """
    n = len(weights)
    k_all = range(n)
    share = [F.get("p", F.lit(k)) for k in k_all]
    tokens = F.col("n_tokens") * F.col("n_rows")
    sums = lambda df, cols: [float(x or 0.0) for x in df.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()]
    have = sums(members, [tokens * x for x in share])
    total = sum(have)
    if budget is None:
        budget = max([total * min_rate, *(min_rate * h / w for h, w in zip(have, weights, strict=True) if w > 0)]) if min_rate > 0 else total
    # a domain that nothing supplies cannot be filled; its residual would only push the others
    reachable = [h > 1e-6 * max(total, 1.0) for h in have]
    scale = np.array([h if ok else max(total, 1.0) for h, ok in zip(have, reachable, strict=True)])
    past: list[list[float]] = []
    misfits, damping = [], 1e-3
    for _ in range(max_steps):
        at = members.withColumn("rate", _rate(past, n, min_rate, max_rate))
        now = sums(at, [tokens * F.col("rate") * x for x in share])
        gap = np.array([s - budget * w if ok else 0.0 for s, w, ok in zip(now, weights, reachable, strict=True)])
        misfits.append(float(np.sum(gap * gap / scale)))
        if np.max(np.abs(gap) / scale, initial=0.0) <= tolerance or (len(misfits) > 5 and max(misfits[-5:]) - min(misfits[-5:]) <= 1e-3 * misfits[-1]):
            break
        if len(misfits) > 1:
            damping = min(damping * 8, 1.0) if misfits[-1] > misfits[-2] else max(damping / 2, 1e-3)
        gradient = [float(x) for x in gap / scale]
        free = F.when((F.col("rate") > min_rate) | (_dot(F.col("p"), _numbers(gradient), n) < 0), tokens).otherwise(0)
        curve = np.array(sums(at, [free * share[i] * share[j] for i in k_all for j in k_all])).reshape(n, n)
        past.append([*gradient, *np.linalg.solve(curve + damping * np.diag(scale), gap).tolist()])
    else:
        warnings.warn(f"mixing rates still move after {max_steps} steps; misfit {misfits[-1]:.6g}", stacklevel=2)
    return members.withColumn("rate", F.round(_rate(past, n, min_rate, max_rate), 9))


def soft_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], min_rate: float = 0.0, max_rate: float | None = None, budget: float | None = None, max_train: int = MAX_TRAIN, vocabulary: int = VOCABULARY) -> DataFrame:
    """labelled: (doc_id, domain). targets: domain -> weight; weights are scaled to the sum 1."""
    domains = sorted(targets)
    weights = [max(float(targets[d] or 0.0), 0.0) for d in domains]
    weights = [w / (sum(weights) or 1.0) for w in weights]
    model = train_words(docs, labelled, domains, max_train, vocabulary)
    members = saved(posteriors(docs, model, domains, weights), "mixing-members")
    fitted = fit_rates(members, weights, budget, min_rate, max_rate)
    named = [F.get("p", F.lit(k)).alias("p_" + re.sub("[^A-Za-z0-9]", "_", d)) for k, d in enumerate(domains)]
    return fitted.select("doc_id", "text_hash", "n_rows", "n_tokens", *named, "rate")


def apply_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """docs with every row as often as its rate says: the whole part, and once more if a hash of doc_id and text falls below the rest. Columns stay."""
    own = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    rate = rates.select(F.col("doc_id").alias("rate_id"), F.col("text_hash").alias("rate_hash"), "rate")
    met = own.join(rate, F.col("id").eqNullSafe(F.col("rate_id")) & (F.col("hash") == F.col("rate_hash")))
    chance = F.pmod(F.xxhash64("id", "hash", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return met.withColumn("n", copies.cast("int")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
