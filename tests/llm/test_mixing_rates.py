"""Mixing rates at the optimum of their least squares."""

import numpy as np
import pytest

from plainledger.llm import mixing


@pytest.mark.parametrize("max_rate", [None, 1.0])
def test_rates_meet_the_conditions_of_the_optimum(spark, max_rate):
    draw = np.random.default_rng(4)
    p = np.unique(np.floor(draw.dirichlet([2, 0.3, 0.2], size=200) * mixing.GRID) / mixing.GRID, axis=0)
    p[:, 0] = 1 - p[:, 1] - p[:, 2]
    tokens = draw.integers(10, 100_000, size=len(p)).astype(float)
    goal = tokens.sum() * np.array([0.96, 0.03, 0.01])
    table = spark.createDataFrame([(x.tolist(), float(n)) for x, n in zip(p, tokens)], "p array<double>, tokens double")
    found = {tuple(r["p"]): r["rate"] for r in mixing.fit_rates(table, goal.tolist(), max_rate).collect()}
    rate = np.array([found[tuple(x)] for x in p])
    weight = 1 / np.maximum((tokens[:, None] * p).sum(axis=0), 1)
    slope = p @ (weight * ((rate * tokens) @ p - goal))
    inner = (rate > 1e-6) & (rate < (np.inf if max_rate is None else max_rate - 1e-6))
    assert np.abs(slope[inner]).max(initial=0) < 1e-7
    assert slope[rate <= 1e-6].min(initial=0) > -1e-7
    assert max_rate is None or slope[rate >= max_rate - 1e-6].max(initial=0) < 1e-7
