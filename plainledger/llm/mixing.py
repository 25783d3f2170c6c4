"""Mixing to target weights with soft domain membership.

Domains are those of the labelled table: `toxic`, `poor` (quality 0) and `good`. A
naive Bayes classifier over hashed words (presence per document) and over the text's
shape (length, share of signs, share of distinct words, in steps) gives every document
posterior domain probabilities. It is fitted on at most `FIT_ROWS` labelled rows, taken
by a hash of their id; a word bucket counts only where its rate in a domain differs
from the others' by more than `SIGNIFICANCE` standard errors. Posteriors are rounded
to `GRID` steps, so documents fall into profiles and the fit below sees one row per
profile.

Rates r >= 0 (and <= max_rate) minimise the sum over domains of
(expected tokens - target)^2 / supply, expected tokens being the sum of rate x tokens
x posterior and supply the same sum at rate 1. Rates depend on posteriors only, so the
documents' part of every gradient is one distributed sum per profile; projected
gradient steps then run on the bounded profile table until no rate moves. The step
length is one over the largest eigenvalue of the weighted moment matrix.

Defined results: null and empty texts have no tokens, no evidence and the domains'
prior as posterior; without labels all domains are equally likely; a domain that no
document can supply stays below target; repeated rows are weighed each; an empty
table gives an empty table; extra columns are kept by `mix`, those named like a
result are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainledger.llm.common import BLANKS, carry, constant
from plainledger.session import cut

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.96, "poor": 0.03, "toxic": 0.01}
FIT_ROWS = 20_000
BUCKETS = 1 << 16
SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
SIGN_RUN = "[" + "".join("\\" + c for c in SIGNS) + "]+"
MARK = "#"
SIGNIFICANCE = 5.0
SMOOTH = 0.5
GRID = 50
STEPS = 100_000  # at most; TOLERANCE ends them
TOLERANCE = 1e-12


def domain(quality: Column, toxic: Column) -> Column:
    """Number of the domain in DOMAINS."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).otherwise(0)


def with_buckets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, n_tokens and the distinct buckets of each text's words, signs and case aside, and of its shape.

    One step per column: each is used more than once by the next and computed once.
    """
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    # Blanks become single spaces and runs of signs one mark, so the words split at a plain character.
    marked = F.regexp_replace(F.regexp_replace(lower, r"[\x09-\x0D]", " "), SIGN_RUN, MARK)
    bare = lambda column: F.replace(column, F.lit(MARK), F.lit(""))
    lines = docs.select(*keep, F.length("text").alias("_length"), marked.alias("_marked"))
    split = lines.select(*keep, "_length", F.length(bare(F.col("_marked"))).alias("_left"),
                         F.array_remove(F.split("_marked", " "), "").alias("_words"))
    hashed = split.select(*keep, F.size("_words").cast("long").alias("n_tokens"), "_length", "_left", F.array_remove(F.array_distinct(
        F.transform("_words", lambda w: F.xxhash64(bare(w)))), F.xxhash64(F.lit(""))).alias("_distinct"))
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    marks = 1 - F.col("_left") / F.greatest("_length", F.lit(1))
    shape = [
        ("length", F.floor(F.log2(n))), ("signs", F.floor(F.coalesce(marks, F.lit(0.0)) * 40)),
        ("distinct", F.floor(F.size("_distinct") / n * 20)),
    ]
    seen = F.concat("_distinct", F.array(*[F.xxhash64(F.lit(name), step) for name, step in shape]))
    return hashed.select(*keep, "n_tokens", F.transform(seen, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")).alias("buckets"))


def fit_sample(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(of, domain) of at most about `rows` labelled ids, chosen by hash."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return cut(chosen.groupBy(F.col("doc_id").alias("of")).agg(F.max(domain(F.col("quality"), F.col("toxic"))).alias("domain")))


def classifier(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Log prior per domain, and of the telling buckets the log odds per domain."""
    sample = fit_sample(labels, rows)
    # A text copied many times is one observation.
    texts = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("of")).groupBy(
        F.xxhash64("text").alias("same"), "domain").agg(F.any_value("text").alias("text"))
    texts = cut(with_buckets(texts, ["domain"]).select("domain", F.array_distinct("buckets").alias("buckets")))
    sizes = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sizes.get(k, 0) for k in range(len(DOMAINS))]
    total = sum(n)
    prior = [float(np.log((x + 1) / (total + len(n)))) for x in n]
    counts = texts.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        *[F.count_if(F.col("domain") == k).alias(f"n{k}") for k in range(len(n))])
    every = sum((F.col(f"n{k}") for k in range(1, len(n))), F.col("n0"))
    odds, telling = [], F.lit(False)
    for k, size in enumerate(n):
        own, rest = F.col(f"n{k}"), every - F.col(f"n{k}")
        p, q = (own + SMOOTH) / (size + 2 * SMOOTH), (rest + SMOOTH) / (total - size + 2 * SMOOTH)
        error = F.sqrt((1 - p) / (own + SMOOTH) + (1 - q) / (rest + SMOOTH))
        telling = telling | (F.abs(F.log(p / q)) > SIGNIFICANCE * error)
        odds.append(F.log(p).alias(f"w{k}"))
    # At most BUCKETS rows.
    kept = counts.filter(telling).select("bucket", *odds).orderBy("bucket").collect()
    mean = [[row[f"w{k}"] for k in range(len(n))] for row in kept]
    return {"prior": prior, "buckets": [row["bucket"] for row in kept], "weights": [[x - max(m) for x in m] for m in mean]}


def with_posterior(rows: DataFrame, model: dict) -> DataFrame:
    """`rows` with `posterior`, the domain probabilities in steps of 1 / GRID, for `buckets`."""
    rest = [c for c in rows.columns if c != "buckets"]
    logs = [F.lit(p) for p in model["prior"]]
    if model["buckets"]:
        # Place of each of the BUCKETS in the weights, or -1: a look-up by position, however many are telling.
        places = [-1] * BUCKETS
        for place, bucket in enumerate(model["buckets"]):
            places[bucket] = place
        places = constant(places).cast("array<int>")
        found = F.filter(F.transform("buckets", lambda b: F.get(places, b)), lambda i: i >= 0)
        rows = rows.select(*rest, F.array_distinct(found).alias("_hits"))
        weights = [constant([float(x) for x in column]) for column in zip(*model["weights"])]
        adding = lambda w: lambda acc, i: acc + F.get(w, i)
        logs = [F.aggregate("_hits", log, adding(w)) for log, w in zip(logs, weights)]
    top = F.array_max("_logs")
    parts = rows.select(*rest, F.array(*logs).alias("_logs")).select(
        *rest, F.transform("_logs", lambda x: F.exp(x - top)).alias("_parts"))
    whole = F.aggregate("_parts", F.lit(0.0), lambda s, x: s + x)
    steps = parts.select(*rest, F.transform("_parts", lambda x: F.round(x / whole * GRID) / GRID).alias("_steps"))
    others = [F.get("_steps", k) for k in range(1, len(DOMAINS))]
    return steps.select(*rest, F.array(F.greatest(1 - sum(others[1:], others[0]), F.lit(0.0)), *others).alias("posterior"))


def solve_rates(p: np.ndarray, tokens: np.ndarray, targets: np.ndarray, max_rate: float | None,
                steps: int = STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Rates of the profiles at the least squares, by projected gradient steps from rate 1.

    Ends when no rate moves by more than `tolerance`. Plain steps, as the optimum is not
    unique in the rates: they end near rate 1.
    """
    matrix = (p * tokens[:, None]).T @ p
    weight = 1.0 / np.maximum(matrix.sum(axis=1), 1.0)
    scaled = np.sqrt(weight)[:, None] * matrix * np.sqrt(weight)[None, :]
    length = 1.0 / max(float(np.linalg.eigvalsh(scaled)[-1]), 1e-12)
    top = np.inf if max_rate is None else float(max_rate)
    rate = np.full(len(tokens), min(1.0, top))
    slope = lambda r: p @ (weight * ((r * tokens) @ p - targets))
    for _ in range(steps):
        new = np.clip(rate - length * slope(rate), 0, top)
        moved = np.max(np.abs(new - rate), initial=0.0)
        rate = new
        if moved <= tolerance:
            break
    return rate


def fit_rates(profiles: DataFrame, targets: list[float], max_rate: float | None) -> DataFrame:
    """(p, rate) of every profile (p, tokens), at the least squares.

    Rounded posteriors have at most binomial(GRID + domains - 1, domains - 1) profiles,
    so the driver solves them whatever the data size.
    """
    rows = sorted((list(r["p"]), float(r["tokens"] or 0.0)) for r in profiles.collect())
    p = np.array([x for x, _ in rows], dtype=float).reshape(len(rows), len(targets))
    rates = solve_rates(p, np.array([n for _, n in rows]), np.array(targets, dtype=float), max_rate)
    return profiles.sparkSession.createDataFrame(
        [(x, float(r)) for (x, _), r in zip(rows, rates)], "p array<double>, rate double")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_rate: float | None = None,
        seed: int = 11, rows: int = FIT_ROWS) -> DataFrame:
    """`docs` with n_tokens, posterior, domain, rate and copies (the rate drawn to a whole number)."""
    wanted = targets or TARGETS
    names = ("n_tokens", "posterior", "domain", "rate", "copies")
    docs, restore = carry(docs, ("doc_id", "text"))
    kept = docs.columns
    model = classifier(docs, labels, rows)
    # Written once: the profiles and the result both need every text's posterior.
    known = cut(with_posterior(with_buckets(docs.select(*kept), kept), model))
    profiles = cut(known.groupBy(F.col("posterior").alias("p")).agg(F.sum("n_tokens").cast("double").alias("tokens")).coalesce(1))
    total = profiles.agg(F.sum("tokens")).first()[0] or 0.0
    share = sum(wanted.values())
    goal = [total * wanted[name] / share for name in DOMAINS]
    rates = cut(fit_rates(profiles, goal, max_rate))
    best = F.array_position("posterior", F.array_max("posterior"))
    drawn = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # At most one row per profile, written, so the planner knows how small it is.
    rated = known.withColumn("drawn", drawn).join(rates.withColumnRenamed("rate", "_rate"), F.col("posterior") == F.col("p"))
    return restore(rated.withColumn("domain", F.element_at(F.array(*map(F.lit, DOMAINS)), best.cast("int"))).withColumn(
        "rate", F.col("_rate")).withColumn(
        "copies", (F.floor("rate") + (F.col("drawn") < F.col("rate") - F.floor("rate")).cast("int")).cast("int")), *names)


def draw(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Each document as often as its drawn rate says; the columns of `docs`."""
    docs, restore = carry(docs, ("doc_id", "text"))
    mixed = mix(docs, labels, **settings).filter(F.col("copies") > 0)
    return restore(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
