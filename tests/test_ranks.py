"""Signed ranks over distributed places against ranks of whole arrays."""

import numpy as np
import pytest

from lodestar.operators import ranking


@pytest.mark.parametrize("n", [1, 7, 50, 51, 400])
def test_ranks_equal_those_of_an_array(spark, n):
    rng = np.random.default_rng(n)
    groups = {g: rng.integers(-6, 9, n).astype(float) for g in ("a", "b", None)}
    rows = [(g, float(d), 0.0) for g, x in groups.items() for d in x] + [("a", None, 1.0), ("a", float("nan"), 1.0)]
    got = {r.g: tuple(r)[1:] for r in ranking.signed_rank(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y").collect()}
    for g, d in groups.items():
        assert got[g] == pytest.approx((n, d.mean(), *ranking.signed_rank_p(d)), rel=1e-9)
