"""Robust estimates against a numpy search over many starts."""

import numpy as np
import pytest

from dendrium.llm import quality_rules as Q

FLOOR = np.diag(np.square(Q.FLOORS))


def steps(x, subset):
    """Concentration steps from a subset until it stays; its log-determinant, and squared distances of all rows."""
    while True:
        m, c = x[subset].mean(0), np.cov(x[subset].T, bias=True) + FLOOR
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        new = np.argsort(d, kind="stable")[: int(np.ceil(Q.KEPT_SHARE * len(x)))]
        if set(new) == set(subset):
            return np.linalg.slogdet(c)[1], d
        subset = new


@pytest.mark.parametrize("odd", [0, 30, 45])
def test_least_determinant(spark, odd):
    rng = np.random.default_rng(odd)
    x = rng.standard_normal((200, 5)) @ rng.standard_normal((5, 5)) * 0.3
    x[:odd] = 4 + 0.2 * rng.standard_normal((odd, 5))
    narrow = spark.createDataFrame([("en", "a", *map(float, r), True) for r in x], f"lang string, source string, {', '.join(z + ' double' for z in Q.Z)}, usable boolean")
    (row,) = Q.estimate(narrow).collect()
    low = np.zeros((5, 5))
    low[np.tril_indices(5)] = row.l
    found = 2 * np.log(np.diag(low)).sum()
    best, d = min((steps(x, rng.choice(200, 8, replace=False)) for _ in range(60)), key=lambda t: t[0])
    assert found <= best + 0.1
    y = np.linalg.solve(low, (x - np.array(row.m)).T)
    mine = (y * y).sum(0) / row.c
    assert (mine[:odd] > Q.CUT).all() and (mine[odd:] <= Q.CUT).all()
