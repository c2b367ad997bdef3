import math
import warnings
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapledger.llm import lm_scoring as lm
from snapledger.llm import mixing

TEXTS = [
    (1, "the cat sat on the mat"), (2, "the cat ran"), (3, None), (4, ""), (5, "The CAT sat on a hat the cat"), (5, "the cat sat"),
    (6, "zzz"), (7, " ".join(["the cat"] * 700)),
]


def brute(order):
    docs = [(i, (t or "").encode().lower().split()) for i, t in TEXTS]
    grams = [[Counter(tuple(w[i - k + 1 : i + 1]) for i in range(k - 1, len(w))) for k in range(1, order + 1)] for _, w in docs]
    n = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    total = sum(len(w) for _, w in docs)
    out = []
    for (i, w), own in zip(docs, grams, strict=True):
        s = 0.0
        for at in range(len(w)):
            weight = 1.0
            for k in range(min(order, at + 1), 1, -1):
                gram = tuple(w[at - k + 1 : at + 1])
                if n[k - 1][gram] > own[k - 1][gram]:
                    s += math.log(weight * (n[k - 1][gram] - own[k - 1][gram]) / (n[k - 2][gram[:-1]] - own[k - 2][gram[:-1]]))
                    break
                weight *= 0.4
            else:
                s += math.log(weight * max(n[0][(w[at],)] - own[0][(w[at],)], 1) / max(total - len(w), 1))
        out.append((i, len(w), round(s, 6)))
    return sorted(out)


@pytest.mark.parametrize(("order", "block"), [(2, 1 << 20), (3, 1 << 20), (3, 60)])
def test_scores_equal_brute_force(spark, order, block):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = lm.lm_scores(docs, order=order, block_bytes=block).collect()
    assert sorted((r["doc_id"], r["n_tokens"], round(r["log_score"], 6)) for r in got) == brute(order)
    assert all((r["mean_log_score"] is None) == (r["n_tokens"] == 0) for r in got)


def test_the_query_sees_more_than_adjacent_pairs(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op10_lm_scoring(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], round(r["log_score"], 6)) for r in got) == brute(3) != brute(2)


@pytest.mark.parametrize("values", [[], [0], [1, 1, 300, 2**63 + 5], [2**64 - 1] * 3])
def test_packed_numbers_come_back(values):
    values = np.array(values, np.uint64)
    assert (lm.unpacked(lm.packed(values)) == values).all()
    assert (np.cumsum(lm.unpacked(lm.packed(lm._deltas(np.sort(values)))), dtype=np.uint64) == np.sort(values)).all()


def test_rows_of_one_id_stand_in_many_blocks(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(200)], "_id long, text string")
    assert docs.select(lm.block_of(8).alias("b")).distinct().count() == 8


def test_scores_of_nothing(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def corpus(spark):
    rows = [(i, "good prose here" if i % 4 else "bad### junk###") for i in range(400)] + [(400, None), (401, "")]
    labels = [(i, 1 if i % 4 else 0, 0) for i in range(0, 400, 3)] + [(2, None, 0)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_mixture_meets_targets(spark):
    docs, labels = corpus(spark)
    got = mixing.mixture(docs, mixing.quality_domains(labels), {"good": 0.9, "low": 0.1}).toPandas()
    assert len(got) == 402 and (got["rate"] >= 0).all() and got["rate"].max() < 1.2
    tokens = {d: (got["n_tokens"] * got[f"p_{d}"] * got["rate"]).sum() for d in ("good", "low")}
    assert tokens["good"] / sum(tokens.values()) == pytest.approx(0.9, abs=1e-4)
    known = got[got["n_tokens"] > 0]
    assert ((known["p_good"] > 0.5) == (known["doc_id"] % 4 > 0)).all()


def plain_gradient(n, p, wanted, steps=200_000):
    """The least sum of squared misses over rates of zero or more, by small plain gradient steps."""
    a = n[:, None] * p
    r, size = np.ones(len(n)), 1 / np.linalg.norm(a.T @ a, 2)
    for _ in range(steps):
        r = np.maximum(0, r - size * (a @ (a.T @ r - wanted)))
    return ((a.T @ r - wanted) ** 2).sum()


@pytest.mark.parametrize(("kind", "targets"), [("soft", [0.7, 0.2, 0.1]), ("soft", [0.05, 0.05, 0.9]), ("even", [0.97, 0.03]), ("narrow", [0.1, 0.9])])
def test_rates_are_the_least_squares_solution(spark, kind, targets):
    rng = np.random.default_rng(3)
    k = len(targets)
    p = rng.dirichlet([0.6] * k, 40) if kind == "soft" else np.full((40, k), 1 / k)
    if kind == "narrow":
        p[:, 1] = rng.uniform(0.1, 0.3, 40)
        p[:, 0] = 1 - p[:, 1]
    n = rng.integers(1, 90, 40).astype(float)
    df = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "_n double, _p array<double>")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        rate = mixing.fit_rates(df, targets, total=1000.0)
    got = df.select("_n", "_p", rate.alias("r")).toPandas()
    assert (got["r"] >= 0).all()
    mix = (got["_n"].values[:, None] * np.stack(got["_p"]) * got["r"].values[:, None]).sum(0)
    missed = ((mix - 1000 * np.array(targets)) ** 2).sum()
    assert missed <= plain_gradient(n, p, 1000 * np.array(targets)) * 1.001 + 1e-2
    assert any("miss a target" in str(w.message) for w in said) == (missed > 1)


def test_mixed_keeps_columns_and_takes_copies(spark):
    docs, labels = corpus(spark)
    docs = docs.withColumn("lang", F.lit("en")).withColumn("_p2", F.lit(1))
    out = mixing.mixed(docs, mixing.quality_domains(labels), {"good": 0.9, "low": 0.1})
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert len([i for i in kept if i % 4]) > len([i for i in kept if i % 4 == 0])


def test_mixture_without_labels_or_rows(spark):
    docs, labels = corpus(spark)
    none = mixing.quality_domains(labels.limit(0))
    assert {r["rate"] for r in mixing.mixture(docs, none, {"good": 0.5, "low": 0.5}).collect()} == {1.0}
    assert mixing.mixture(docs.limit(0), none).collect() == []


def test_long_texts_and_repeated_ids_are_mixed(spark):
    docs, labels = corpus(spark)
    more = spark.createDataFrame([(7, "good prose " * 150_000)] + [(4, "bad### junk###")] * 30, "doc_id long, text string")
    got = mixing.mixture(docs.unionByName(more), mixing.quality_domains(labels), {"good": 0.9, "low": 0.1}).collect()
    assert len(got) == 402 + 31 and max(r["n_tokens"] for r in got) == 300_000
    assert len({(r["doc_id"], r["copies"]) for r in got if r["doc_id"] == 4}) == 1


def test_no_python_on_the_main_path(spark):
    docs, labels = corpus(spark)
    plan = mixing.mixture(docs, mixing.quality_domains(labels))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
