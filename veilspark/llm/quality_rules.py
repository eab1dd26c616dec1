"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The votes of
all documents are counted by pattern (3 ** rules patterns at most, whatever the
corpus). Expectation-maximisation over those counts estimates the share of good
documents and, for either kind of document, how often a rule that votes objects;
that tells a rule whose good votes say little from one whose objections say much.
An abstention says nothing. A document's posterior probability of being good,
written back as a column expression, decides. The base check (too short, or too
much repeated text) rejects before that, and only documents that pass it, all of
them, are counted: the verdict is about those. The start makes "good" the kind
that rules seldom object to.

The features of a document are computed inside its own row: no shuffle, and no
word leaves its text.

Edge cases: a null or empty text has no words and fails the base check; equal
rows get equal results; an empty table keeps the starting rates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SEPARATORS = " \t\n\x0b\f\r"
ROUNDS = 100
#: Starting values: the share of good documents, and how often a voting rule
#: objects to a good and to a bad one (a bad one is usually bad in one way
#: only); no estimate gets closer to 0 or 1 than LEAST.
START_GOOD = 0.85
START_OBJECTIONS = (0.003, 0.15)
LEAST = 1e-4


def features(docs: DataFrame) -> DataFrame:
    """One row per document with the base columns and what the rules need."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("t"),
        F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("w"),
    )

    # hashes of the 5-word windows; a repeated one shows as a smaller distinct set
    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get("w", i + k) for k in range(5)])

    n = F.size("w")
    hashed = split.withColumn("h", F.when(n >= 5, F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))

    # only where hashes repeat: sort (hash, position), keep positions next to an
    # equal hash, and add up the words that the windows at those positions cover
    lines = F.split("t", "\n")
    real = F.filter(lines, lambda x: F.translate(x, SEPARATORS, "") != "")
    flat = hashed.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("t", SEPARATORS, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclaim"),
        F.regexp_count("t", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.size(real).cast("long").alias("n_lines"),
        (F.size(real) - F.size(F.array_distinct(real))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.coalesce(F.array_max(F.transform("w", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"),
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).alias("s"),
    )
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))))
    after = F.concat(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    same = F.filter(
        F.zip_with(F.arrays_zip(F.col("s").alias("x"), before.alias("b")), after, lambda p, a: F.when((p.x.h == p.b.h) | (p.x.h == a.h), p.x.i)),
        lambda i: i.isNotNull(),
    )
    at = flat.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(same)))
    gaps = F.zip_with(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(5)))
    covered = F.when(F.col("p").isNotNull() & (F.size("p") > 0), F.aggregate(gaps, F.lit(5), lambda acc, g: acc + g)).otherwise(0)
    return at.withColumn("n_repeat_words", covered.cast("long")).drop("s", "p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Votes by name: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    mean, symbols, shouts = F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_exclaim") / n
    upper, lines = F.col("n_upper") / F.greatest("word_chars", F.lit(1)), F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    repeats, distinct = F.col("n_repeat_words") / n, F.col("n_distinct") / n
    return {
        "word_length": vote(mean, mean.between(3.0, 10.0), (mean < 2.0) | (mean > 14.0)),
        "symbols": vote(symbols, symbols <= 0.05, symbols > 0.25),
        "shouting": vote(shouts, shouts <= 0.05, shouts > 0.3),
        "capitals": vote(upper, upper <= 0.1, upper > 0.3),
        "lines": vote(lines, lines <= 0.1, lines > 0.5),
        "repeats": vote(repeats, repeats <= 0.1, repeats > 0.2),
        "variety": vote(distinct, distinct >= 0.2, distinct < 0.05),
        "longest": vote(F.col("longest"), F.col("longest") <= 40, F.col("longest") > 200),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], k: int) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes of k rules, count): the share of good documents, and per
    rule the rates of objection to good and to bad documents where it votes."""
    good, rates = START_GOOD, [START_OBJECTIONS] * k
    inside = lambda x: min(max(x, LEAST), 1 - LEAST)
    for _ in range(ROUNDS if patterns else 0):
        mass, voted, against = [0.0, 0.0], [[0.0, 0.0] for _ in range(k)], [[0.0, 0.0] for _ in range(k)]
        for votes, n in patterns:
            p = posterior(votes, good, rates)
            for kind, weight in enumerate((n * p, n * (1 - p))):
                mass[kind] += weight
                for j, v in enumerate(votes):
                    voted[j][kind] += weight * abs(v)
                    against[j][kind] += weight * (v < 0)
        good = inside(mass[0] / sum(mass))
        rates = [tuple(inside(a / n) if n else r for a, n, r in zip(against[j], voted[j], rates[j], strict=True)) for j in range(k)]
    return good, rates


def accuracies(good: float, rates: list[tuple[float, float]]) -> list[float]:
    """How often each rule is right where it votes."""
    return [good * (1 - on_good) + (1 - good) * on_bad for on_good, on_bad in rates]


def evidence(rates: list[tuple[float, float]], j: int, vote: int) -> float:
    """Log odds that a vote of rule j adds for "good"."""
    on_good, on_bad = rates[j]
    return math.log(on_good / on_bad) if vote < 0 else math.log((1 - on_good) / (1 - on_bad)) if vote > 0 else 0.0


def posterior(votes: tuple[int, ...], good: float, rates: list[tuple[float, float]]) -> float:
    logit = math.log(good / (1 - good)) + sum(evidence(rates, j, v) for j, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and quality_probability."""
    found = materialize(features(docs), "quality")
    names = list(rules())
    voted = found.select("*", *[v.alias(f"v_{r}") for r, v in rules().items()])
    counts = voted.where(~base_failed()).groupBy(*[f"v_{r}" for r in names]).count().collect()  # 3 ** rules rows at most
    patterns = sorted((tuple(c[f"v_{r}"] for r in names), c["count"]) for c in counts)
    good, rates = estimate(patterns, len(names))
    logit = F.lit(math.log(good / (1 - good)))
    for j, r in enumerate(names):
        v = F.col(f"v_{r}")
        logit = logit + F.when(v > 0, evidence(rates, j, 1)).when(v < 0, evidence(rates, j, -1)).otherwise(0.0)
    scored = voted.withColumn("quality_probability", 1 / (1 + F.exp(-logit))).withColumn("base_failed", base_failed())
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality_probability") >= 0.5)).alias("kept"), "quality_probability",
    )
