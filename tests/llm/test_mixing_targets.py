"""Rates meet their targets where posteriors are soft."""

import warnings

import numpy as np
import pytest

from brindle.llm import mixing


def members(spark, rng, n, domains, sharp):
    logs = rng.normal(0, sharp, (n, domains))
    p = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
    words = rng.integers(50, 400, n).astype(float)
    q = np.round(p * 512) / 512
    rows = [(q[i].tolist(), *(words[i] * p[i]).tolist()) for i in range(n)]
    schema = "q array<double>, " + ", ".join(f"w{k} double" for k in range(domains))
    return spark.createDataFrame(rows, schema).coalesce(4), q, words[:, None] * p


@pytest.mark.parametrize("targets, least, sharp", [([0.1, 0.9], 1.0, 1.5), ([0.1, 0.9], 1.0, 4.0), ([0.15, 0.8, 0.01, 0.04], 0.0, 2.0), ([0.5, 0.5], 0.0, 1.0)])
def test_solver_converges(spark, targets, least, sharp):
    table, q, words = members(spark, np.random.default_rng(4), 3000, len(targets), sharp)
    found = mixing.solve(table.cache(), targets, least=least)
    rate = np.maximum(max(1.0, least) + found.shift - q @ np.array(found.slopes), least)
    reached = rate @ words
    assert np.allclose(reached, found.reached) and rate.min() >= least
    assert np.abs(reached / reached.sum() - np.array(targets)).max() < 2e-3


def test_unreachable_targets_are_reported(spark):
    table = spark.createDataFrame([([0.5, 0.5], 50.0, 50.0), ([0.25, 0.75], 25.0, 75.0)], "q array<double>, w0 double, w1 double")
    with pytest.warns(UserWarning, match="targets missed"):
        found = mixing.solve(table, [0.1, 0.9], least=1.0)
    assert min(found.reached) > 0
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert mixing.solve(table.limit(0), [0.1, 0.9]).slopes == [0.0, 0.0]
