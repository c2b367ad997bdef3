"""Mixing to target weights with soft membership, in DataFrame operations only.

A naive Bayes classifier over hashed words, fitted on a labelled table, gives each document its posteriors over the
domains. Projected-gradient least squares then fits a nonnegative rate for every document, so that the expected tokens
of the domains stand in the target proportions. A step needs one sum per domain over all documents; the rates follow
from the sums of all steps, so no rate is ever stored or gathered.
"""

from __future__ import annotations

import warnings
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import SPACES, discard, full_text, stored, table

#: Labelled rows that the classifier is fitted on (about, by hash of the id), and buckets that words are hashed to.
FIT_ROWS, BUCKETS = 6000, 8192
#: Steps at most, and the largest miss, as a share of all tokens wanted, at which they end.
STEPS, TOLERANCE = 40, 1e-6
TARGETS = {"good": 0.97, "low": 0.03}


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled rows: good, or low where quality is bad or the text toxic. Rows with a null label are left out."""
    return labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").otherwise("low").alias("domain")
    )


def words(text: str | Column) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(F.lower(full_text(text)), SPACES), lambda w: w != "")


def bucket(word: Column) -> Column:
    """The bucket of a word; one that ends in a sign counts by its last two characters, as its ending says more of it."""
    sign = F.ascii(F.right(word, F.lit(1))) < 65
    return F.pmod(F.xxhash64(F.when(sign, F.concat(F.lit("~"), F.right(word, F.lit(2)))).otherwise(word)), F.lit(BUCKETS)).cast("int")


def numbers(values: list[float]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def fit_classifier(
    docs: DataFrame, domains: DataFrame, names: list[str], id_col: str, text_col: str, rows: int = FIT_ROWS
) -> tuple[list[float], list[float]] | None:
    """Log priors of the domains, and log likelihoods by bucket * len(names) + domain; None if nothing is labelled.

    An id with several labels counts with the first in alphabetical order.
    """
    marked = domains.where(F.col("domain").isin(names)).groupBy(F.col(id_col).alias("id")).agg(F.min("domain").alias("domain"))
    total = marked.count()
    chance = F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1 << 30)) / (1 << 30)
    # `rows` pairs of a number and a name at most, but for chance
    chosen = marked.where(chance < rows / max(total, 1))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    counted = stored(
        sample.select("domain", F.explode(F.concat(F.array(F.lit(-1)), F.transform(words("text"), bucket))).alias("bucket"))
        .groupBy("domain", "bucket")
        .agg(F.count(F.lit(1)).alias("n")),
        "mixing-counts",
    )
    found = counted.collect()  # domains x (buckets + 1) numbers
    discard(counted)
    seen = {(r["domain"], r["bucket"]): r["n"] for r in found}
    texts = sum(seen.get((d, -1), 0) for d in names)
    if not texts:
        return None
    priors = [log((seen.get((d, -1), 0) + 0.5) / (texts + 0.5 * len(names))) for d in names]
    size = {d: sum(n for (e, b), n in seen.items() if e == d and b >= 0) for d in names}
    likely = [log((seen.get((d, b), 0) + 0.5) / (size[d] + 0.5 * BUCKETS)) for b in range(BUCKETS) for d in names]
    return priors, likely


def with_posteriors(docs: DataFrame, domains: DataFrame, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """docs with _n (words) and _p (posteriors, in the order of names).

    The evidence of the words is divided by the root of their number, which keeps memberships soft. Each step is a
    column of its own: an expression that is used twice would run twice.
    """
    model = fit_classifier(docs, domains, names, id_col, text_col)
    k = len(names)
    rows = docs.withColumn("_b", F.transform(words(text_col), bucket)).withColumn("_n", F.size("_b").cast("double"))
    if model is None:
        return rows.withColumn("_p", numbers([1 / k] * k)).drop("_b")
    priors, likely = model
    by_domain = [numbers(likely[i::k]) for i in range(k)]
    added = F.aggregate(
        "_b",
        F.struct(*(F.lit(0.0).alias(f"s{i}") for i in range(k))),
        lambda acc, b: F.struct(*((acc[f"s{i}"] + F.get(by_domain[i], b)).alias(f"s{i}") for i in range(k))),
    )
    logs = F.array(*(F.col("_s")[f"s{i}"] / F.sqrt(F.greatest("_n", F.lit(1.0))) + priors[i] for i in range(k)))
    return (
        rows.withColumn("_s", added)
        .withColumn("_l", logs)
        .withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
        .withColumn("_p", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y)))
        .drop("_b", "_s", "_l", "_e")
    )


def fit_rates(known: DataFrame, targets: list[float], total: float | None = None) -> Column:
    """The rate of a row of known (columns _n and _p) as an expression, fitted by projected gradient.

    Minimises the squared misses (expected tokens - target) over rates of zero or more, from a start of one. The misses are
    weighted by the inverse of the moment matrix of the rows whose rate is above zero; that makes the gradient's
    Lipschitz constant one over those rows, however soft the posteriors are. `total` is the number of tokens wanted; None
    keeps the tokens of the domain of the largest weight as they are. Domains without tokens are out of reach, and the others
    share their weight. A miss that remains, because no rates meet the targets or the steps ran out, is a warning that states it.
    """
    k = len(targets)
    p = [F.col("_p")[i] for i in range(k)]
    moments = known.agg(
        *(F.sum(F.col("_n") * p[i]) for i in range(k)), *(F.sum(F.col("_n") * p[i] * p[j]) for i in range(k) for j in range(k))
    ).first()
    present = [x or 0.0 for x in moments[:k]]
    whole = sum(present)
    weight = [w if m > 0 else 0.0 for w, m in zip(targets, present, strict=True)]
    if whole <= 0 or sum(weight) <= 0:
        return F.lit(1.0)
    weight = [w / sum(weight) for w in weight]
    if total is None:
        main = weight.index(max(weight))
        total = present[main] / weight[main]
    wanted = [total * w for w in weight]
    squares = np.reshape(moments[k:], (k, k))
    rate = F.lit(1.0)
    reached, moved = present, None
    for _ in range(STEPS):
        miss = np.subtract(reached, wanted)
        if np.abs(miss).max() < TOLERANCE * total or (moved is not None and moved < TOLERANCE * total):
            break
        step = np.linalg.pinv(squares.astype(float), rcond=1e-9) @ miss
        rate = F.greatest(F.lit(0.0), rate - sum((q * float(x) for q, x in zip(p, step, strict=True)), F.lit(0.0)))
        live = F.when(rate > 0, F.col("_n")).otherwise(0.0)
        sums = known.agg(*(F.sum(F.col("_n") * q * rate) for q in p), *(F.sum(live * q * r) for q in p for r in p)).first()
        moved = np.abs(np.subtract(sums[:k], reached)).max()
        reached, squares = sums[:k], np.reshape(sums[k:], (k, k))
    worst = np.abs(np.subtract(reached, wanted)).max() / total
    if worst >= TOLERANCE:
        still = "and still move" if moved >= TOLERANCE * total else "as near as rates of zero or more come"
        warnings.warn(f"the rates miss a target by {worst:.3g} of the tokens wanted, {still}", stacklevel=2)
    return rate


def copies(rate: Column, id_col: str) -> Column:
    """How often a document is taken: the rate's whole part, and once more with the probability of the rest, by a hash of the id."""
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    return F.floor(rate + chance).cast("int")


def mixture(
    docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, total: float | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, p_<domain> of each target, rate, copies.

    Null and empty texts have the prior as posterior. Without labels the posteriors are even; without tokens all rates
    are one. Rows that repeat are all returned, and count as often in sums and among the labelled (whose counts alone leave
    the executors). A text of any length counts whole. An empty table gives an empty result; further columns are ignored.
    """
    targets = targets or TARGETS
    names = sorted(targets)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    mine = domains.select(F.col(id_col).alias("_id"), "domain")
    known = stored(with_posteriors(rows, mine, names, "_id", "_text").drop("_text"), "mixing")
    rate = fit_rates(known, [targets[d] for d in names], total)
    return known.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("bigint").alias("n_tokens"),
        *(F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(names)),
        rate.alias("rate"),
        copies(rate, "_id").alias("copies"),
    )


def mixed(
    docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, total: float | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """docs in the mixture: each row as often as its copies say; its columns stay as they are."""
    targets = targets or TARGETS
    names = sorted(targets)
    kept = F.struct(*docs.columns).alias("_row")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), kept)
    mine = domains.select(F.col(id_col).alias("_id"), "domain")
    known = stored(with_posteriors(rows, mine, names, "_id", "_text").drop("_text"), "mixing")
    taken = copies(fit_rates(known.select("_n", "_p"), [targets[d] for d in names], total), "_id")
    return known.where(taken > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), taken))).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), quality_domains(table(spark, sf_dir, "labels")))


SQL: dict[str, str] = {}
