"""Mixing: targets met, against a brute-force projected gradient, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.mixing import MAX_STEPS, TARGETS, TOLERANCE, MixingWarning, fit_rates, label_domains, mix

SF = "/root/testdata/sf0.01"


def brute_rates(p, tokens, targets, max_rate):
    rate, have = np.ones(len(p)), (tokens[:, None] * p).sum(axis=0)
    wanted, gram = have.sum() * targets, p.T @ (tokens[:, None] * p)
    for _ in range(MAX_STEPS):
        reached = (rate[:, None] * tokens[:, None] * p).sum(axis=0)
        if abs(reached - wanted).max() <= TOLERANCE * have.sum():
            break
        rate = np.clip(rate - p @ np.linalg.solve(gram, reached - wanted), 0, max_rate)
    return rate


@pytest.fixture(scope="module")
def mixed(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return mix(docs, label_domains(labels), carry=["lang"]).collect()


def test_targets_and_brute_force(mixed):
    domains = sorted(TARGETS)
    p, tokens = np.array([[r.posterior[d] for d in domains] for r in mixed]), np.array([r.tokens for r in mixed], float)
    assert np.allclose(p.sum(axis=1), 1)
    rate, targets = np.array([r.rate for r in mixed]), np.array([TARGETS[d] for d in domains])
    assert np.allclose(rate, brute_rates(p, tokens, targets, 8.0), atol=1e-6)
    totals = (rate[:, None] * tokens[:, None] * p).sum(axis=0)
    assert np.allclose(totals / tokens.sum(), targets, atol=2e-3)
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in mixed)


def nearest_rates(p, tokens, wanted, max_rate):
    """Dual ascent of fixed steps, until it stands still."""
    x, inverse = np.zeros(p.shape[1]), np.linalg.inv(p.T @ (tokens[:, None] * p))
    for _ in range(100_000):
        rate = np.clip(1 - p @ x, 0, max_rate)
        off = (rate * tokens) @ p - wanted
        if abs(off).max() <= 1e-10 * wanted.sum():
            break
        x = x + inverse @ off
    return rate


def soft_rows(spark, poor, n=2000):
    rng = np.random.default_rng(3)
    kind, scores = rng.choice(3, n, p=[(1 - poor) * 0.9, poor, (1 - poor) * 0.1]), rng.normal(0, 1.5, (n, 3))
    scores[np.arange(n), kind] += 3
    p, tokens = np.exp(scores), rng.integers(20, 500, n).astype(float)
    p /= p.sum(axis=1, keepdims=True)
    return p, tokens, spark.createDataFrame(np.column_stack([p, tokens]).tolist(), "a double, b double, c double, t double")


def test_many_clipped_rates_meet_targets_that_are_feasible(spark):
    p, tokens, docs = soft_rows(spark, 0.68)
    rate, reached, wanted = fit_rates(docs, [F.col(c) for c in "abc"], list(TARGETS.values()), F.lit(0.0), 8.0, F.col("t"))
    rates = np.array([r[0] for r in docs.select(rate).collect()])
    assert (rates == 0).mean() > 0.2
    assert np.allclose(np.array(reached) / wanted, 1, atol=1e-5)
    assert np.allclose(rates, nearest_rates(p, tokens, np.array(wanted), 8.0), atol=1e-4)


def test_targets_out_of_reach_are_reported(spark):
    p, tokens, docs = soft_rows(spark, 0.95)
    with pytest.warns(MixingWarning, match="no rates within the bounds"):
        rate, reached, wanted = fit_rates(docs, [F.col(c) for c in "abc"], list(TARGETS.values()), F.lit(0.0), 8.0, F.col("t"))
    # No rate can fall or rise within its bounds without a worse fit.
    slope = p @ np.linalg.solve(p.T @ (tokens[:, None] * p), np.array(reached) - wanted)
    rates = np.array([r[0] for r in docs.select(rate).collect()])
    assert np.allclose(np.where(rates == 0, np.minimum(slope, 0), np.where(rates == 8, np.maximum(slope, 0), slope)), 0, atol=1e-5)


def test_targets_within_the_tolerance(mixed):
    p, tokens = np.array([[r.posterior[d] for d in sorted(TARGETS)] for r in mixed]), np.array([r.tokens for r in mixed], float)
    totals = (np.array([r.rate for r in mixed])[:, None] * tokens[:, None] * p).sum(axis=0)
    assert np.allclose(totals / tokens.sum(), [TARGETS[d] for d in sorted(TARGETS)], atol=2e-4)


def test_classifier_on_labelled_documents(spark, mixed):
    truth = {r.doc_id: r.domain for r in label_domains(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    right = [max(r.posterior, key=r.posterior.get) == truth[r.doc_id] for r in mixed if r.doc_id in truth]
    assert sum(right) / len(right) > 0.9


def test_edge_cases(spark):
    rows = [(1, "good words here now", "x"), (2, "bad stuff!! BAD", "x"), (2, "bad stuff!! BAD", "x"), (None, None, "x"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(1, "good"), (2, "poor"), (None, "poor"), (3, None)], "doc_id long, domain string")
    out = mix(docs, labels, max_rate=1.0, keep="good", anchor="good").collect()
    assert len(out) == 5 and all(0 <= r.rate <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].rate == 1 and by[1].copies == 1 and by[2].rate < 0.5 and by[3].tokens == 0
    twins = [r for r in out if r.doc_id == 2]
    assert twins[0] == twins[1]
    assert all(r.rate == 1 and r.copies == 1 for r in mix(docs, labels.limit(0)).collect())
    assert mix(docs.limit(0), labels).count() == 0
    null = label_domains(spark.createDataFrame([(1, None, None), (2, None, 1), (3, 0, None)], "doc_id long, quality int, toxic int"))
    assert [r.domain for r in null.orderBy("doc_id").collect()] == [None, "toxic", "poor"]
