"""Mixing documents to target weights of domains that each belongs to in part.

A naive Bayes classifier, fitted to labelled rows, gives every document a
posterior per domain. Document d has rate r[d] >= 0 (its expected copies), and
domain j then expects sum(r[d] * tokens[d] * p[d, j]) tokens. The rates minimise
the squared distance of these totals from the targets and, of all that do, lie
next to 1 (a small weight on their token-weighted distance from 1 decides).

The gradient of a document's rate is a combination of its posteriors with one
number per domain, so wherever a projected gradient leads, rates have the form
max(0, 1 - p[d] . u), and only u is fitted. A step follows the gradient, scaled by
the curvature over the documents whose rates are not cut off at zero, and is
halved while it overshoots. Each pass is one aggregation over the documents; the
driver sees a few numbers per domain.
"""

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.session import write_and_reread

from .text import bounded_sample, let, unused, words_of

#: Shares of tokens that the mixture should have.
TARGETS = {"high": 0.91, "low": 0.085, "toxic": 0.005}
#: Labelled rows that the classifier is fitted to, and buckets that features are hashed into.
LABELLED_ROWS = 20_000
BUCKETS = 1 << 14
#: Weight of the overall frequency of a feature beside its frequency in a domain.
PRIOR = 2000.0
#: Passes over the documents at most; what is not reached by then is said in a warning.
PASSES = 60
#: Greatest share of the budget by which the fitted optimum may be missed.
TOLERANCE = 1e-7
#: Weight of the rates' distance from 1 beside the squared distance of the totals, as shares of all tokens.
NEARNESS = 1e-6


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels (doc_id, quality, toxic); rows without both are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low")
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    # One row per document, whatever repeats the labels have.
    return usable.groupBy("doc_id").agg(F.min(domain).alias("domain"))


def _features(text: Column) -> Column:
    """(tokens, buckets): the number of words, and the distinct features of a text as buckets.

    Features are words, the runs of signs between them, and how much the words repeat.
    """
    signs = F.array_distinct(F.split(F.coalesce(text, F.lit("")), r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))

    def bucket(kind, feature):
        return F.pmod(F.xxhash64(F.lit(kind), feature), F.lit(BUCKETS)).cast("int")

    def of(words):
        return let(F.array_distinct(words), lambda distinct: F.struct(
            F.size(words).cast("long").alias("tokens"),
            F.array_distinct(F.concat(
                F.transform(distinct, lambda w: bucket("word", w)),
                F.transform(signs, lambda s: bucket("signs", F.trim(s))),
                F.array(bucket("repeats", F.floor(8 * F.size(distinct) / F.greatest(F.size(words), F.lit(1))).cast("string"))),
            )).alias("buckets"),
        ))

    return let(words_of(text), of)


def _featured(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), _features(text).alias("f")).select(
        "doc_id", "text_hash", "f.tokens", "f.buckets"
    )


def fit_weights(docs: DataFrame, domains: DataFrame, names: list[str], rows: int = LABELLED_ROWS) -> DataFrame:
    """(bucket, w_0, w_1, ...): log ratio of a feature's frequency in a domain to its overall frequency.

    Fitted to at most ``rows`` labelled documents drawn by a hash of their ids. The
    result has at most one row per bucket; bucket -1 holds the log shares of the
    domains.
    """
    sample = bounded_sample(domains.where(F.col("domain").isin(names)), rows, 0, "doc_id", "domain")
    sample = sample.withColumnRenamed("doc_id", "_id")
    own = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).drop("_id")
    text = F.col("text").cast("string")
    featured = own.select("domain", F.explode(F.concat(F.array(F.lit(-1)), _features(text)["buckets"])).alias("bucket"))
    each = [F.sum((F.col("domain") == name).cast("long")).alias(f"n_{i}") for i, name in enumerate(names)]
    counts = write_and_reread(featured.groupBy("bucket").agg(*each), "feature-counts")
    in_domain = [F.sum(F.when(F.col("bucket") >= 0, F.col(f"n_{i}"))).alias(f"all_{i}") for i in range(len(names))]
    totals = counts.agg(*in_domain).first()
    sizes = [float(totals[i] or 0) for i in range(len(names))]
    documents = counts.where("bucket = -1").first()
    documents = [float(documents[f"n_{i}"]) if documents else 0.0 for i in range(len(names))]
    overall = sum(F.col(f"n_{i}") for i in range(len(names))) / max(1.0, sum(sizes))
    weights = []
    for i in range(len(names)):
        shown = F.log((F.col(f"n_{i}") + PRIOR * overall) / (sizes[i] + PRIOR) / overall)
        share = F.lit((documents[i] + 1) / (sum(documents) + len(names)))
        weights.append(F.when(F.col("bucket") == -1, F.log(share)).otherwise(shown).alias(f"w_{i}"))
    return counts.select("bucket", *weights)


def posteriors(docs: DataFrame, weights: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, text_hash, times, tokens, p_0, p_1, ...): one row per different row of ``docs``.

    ``times`` counts equal rows. A text without known features has the shares of
    the domains as its posterior.
    """
    exploded = _featured(docs).select(
        "doc_id", "text_hash", "tokens", F.explode(F.concat(F.array(F.lit(-1)), "buckets")).alias("bucket")
    )
    # At most BUCKETS + 1 rows of weights.
    joined = exploded.join(F.broadcast(weights), "bucket", "left")
    summed = joined.groupBy("doc_id", "text_hash").agg(
        F.sum((F.col("bucket") == -1).cast("long")).alias("times"), F.max("tokens").alias("tokens"),
        *[F.sum(f"w_{i}").alias(f"s_{i}") for i in range(len(names))],
    )
    scores = [F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) / F.col("times") for i in range(len(names))]
    shifted = summed.select("*", *[s.alias(f"l_{i}") for i, s in enumerate(scores)]).withColumn("most", F.greatest(*[f"l_{i}" for i in range(len(names))]))
    parts = [F.exp(F.col(f"l_{i}") - F.col("most")) for i in range(len(names))]
    return shifted.select(
        "doc_id", "text_hash", "times", "tokens", *[(part / reduce(lambda a, b: a + b, parts)).alias(f"p_{i}") for i, part in enumerate(parts)]
    )


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small linear system by elimination."""
    rows = [[*row, value] for row, value in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = max(range(i, len(rows)), key=lambda r: abs(rows[r][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for r in range(len(rows)):
            if r != i and rows[i][i]:
                factor = rows[r][i] / rows[i][i]
                rows[r] = [a - factor * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [row[-1] / row[i] if row[i] else 0.0 for i, row in enumerate(rows)]


def fit_rates(members: DataFrame, targets: list[float], budget: float | None = None, passes: int = PASSES) -> DataFrame:
    """Adds ``rate`` to ``members`` (times, tokens, p_0, p_1, ...).

    ``targets`` are shares of ``budget`` tokens, by default as many as there are.
    Targets that no rates reach are approached as far as can be.
    """
    n = len(targets)
    mass = F.col("times") * F.col("tokens").cast("double")
    everything = float(members.agg(F.sum(mass)).first()[0] or 0.0)
    if not everything:
        return members.withColumn("rate", F.lit(1.0))
    wanted = [(budget or everything) / everything * share / sum(targets) for share in targets]

    def rate(at):
        return F.greatest(F.lit(0.0), F.lit(1.0) - reduce(lambda a, b: a + b, [F.col(f"p_{i}") * F.lit(at[i]) for i in range(n)]))

    def look(at):
        """Value, gradient and curvature at a point: one pass."""
        share, own = mass / everything, rate(at)
        found = members.agg(
            F.sum(share * own * own / 2).alias("v"), *[F.sum(share * own * F.col(f"p_{i}")).alias(f"t_{i}") for i in range(n)],
            *[F.sum(F.when(own > 0, share * F.col(f"p_{i}") * F.col(f"p_{j}")).otherwise(0.0)).alias(f"h_{i}_{j}") for i in range(n) for j in range(n)],
        ).first()
        value = found["v"] + sum(wanted[i] * at[i] + NEARNESS * at[i] ** 2 / 2 for i in range(n))
        gradient = [wanted[i] - found[f"t_{i}"] + NEARNESS * at[i] for i in range(n)]
        curvature = [[found[f"h_{i}_{j}"] + (NEARNESS if i == j else 0.0) for j in range(n)] for i in range(n)]
        return value, gradient, curvature

    at, looked = [0.0] * n, 1
    value, gradient, curvature = look(at)
    while sum(map(abs, gradient)) > TOLERANCE and looked < passes:
        move, size = _solve(curvature, gradient), 1.0
        slope = sum(g * m for g, m in zip(gradient, move, strict=True))
        while looked < passes:
            new = [a - size * m for a, m in zip(at, move, strict=True)]
            found, looked = look(new), looked + 1
            if found[0] <= value - 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        at, (value, gradient, curvature) = new, found
    missed = sum(map(abs, gradient))
    if missed > TOLERANCE:
        warnings.warn(f"rates are {missed:.2e} of the tokens from the optimum after {looked} passes", stacklevel=2)
    return members.withColumn("rate", rate(at))


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """(doc_id, text_hash, times, tokens, p_<domain>..., domain, rate) for every different row of ``docs``.

    Rows equal in doc_id and text are one entry that counts ``times``. Null texts
    have no tokens and cannot change a total. With no labels every posterior is
    even. An empty table gives an empty result.
    """
    names = sorted(targets)
    weights = write_and_reread(fit_weights(docs, label_domains(labels), names), "weights")
    members = write_and_reread(posteriors(docs, weights, names), "members")
    rated = fit_rates(members, [targets[name] for name in names], budget)
    most = F.greatest(*[f"p_{i}" for i in range(len(names))])
    domain = F.coalesce(*[F.when(F.col(f"p_{i}") == most, F.lit(name)) for i, name in enumerate(names)])
    return rated.select(
        "doc_id", "text_hash", "times", "tokens", *[F.col(f"p_{i}").alias(f"p_{name}") for i, name in enumerate(names)], domain.alias("domain"), "rate"
    )


def copies(rate: Column, *keys: Column) -> Column:
    """Whole copies for a rate: its whole part, and one more with the probability of the rest, by a hash of the keys."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says, with all its columns."""
    own_id, own_hash, times, nth = unused(docs, "_id", "_hash", "_copies", "_copy")
    found = mixture(docs.select("doc_id", "text"), labels, targets, budget)
    plan = found.select(
        F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), copies(F.col("rate"), F.col("doc_id"), F.col("text_hash")).alias(times)
    ).where(F.col(times) > 0)
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own_hash))
    repeated = docs.join(plan, same).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
