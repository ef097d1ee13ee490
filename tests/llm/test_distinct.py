"""Distinct numbers and draws of tables, which op3 makes for every pair of words."""

from __future__ import annotations

import numpy as np
import pytest

from folio.llm import language_model


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 40, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_distinct(most, n):
    x = np.random.default_rng(n).integers(0, most, n, np.uint64, endpoint=True)
    for x in [x, x.astype(np.int64)] if most < 1 << 63 else [x]:
        values, inverse = language_model.distinct(x)
        want = np.unique(x, return_inverse=True)
        assert values.dtype == x.dtype and np.array_equal(values, want[0]) and np.array_equal(inverse, want[1])


def test_dishes_of_one_customer_cost_nothing(monkeypatch):
    """Only dishes of several customers are sorted and looked at further; each has its draws, in order."""
    sizes, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **b: sizes.append(len(x)) or argsort(x, *a, **b))
    c = np.ones(10_000, np.int64)
    c[[7, 70, 700, 7000]] = 2, 30, 31, 4000
    t = language_model.sample_tables(c, np.full(len(c), 0.5), 0.5, language_model.log_stirling(0.5), np.random.default_rng(0))
    assert max(sizes) <= 4 and (t[c == 1] == 1).all() and (t >= 1).all() and (t <= c).all()


@pytest.mark.parametrize(("c", "a", "d"), [(31, 2.0, 0.5), (700, 0.3, 0.87), (3000, 20.0, 0.7), (3000, 4000.0, 0.87)])
def test_tables_of_many_customers(c, a, d):
    """Batches have the mean and the spread of seating customer by customer, in far fewer draws."""

    class Counted:
        def __init__(self):
            self.rng, self.calls = np.random.default_rng(1), 0

        def random(self, n):
            return self.rng.random(n)

        def binomial(self, n, p):
            self.calls += 1
            return self.rng.binomial(n, p)

    n, rng, first = 20_000, Counted(), np.full(20_000, language_model.EXACT)
    got = language_model.sample_tables(np.full(n, c), np.full(n, a), d, language_model.log_stirling(d), rng)
    want, one = language_model.sample_tables(first, np.full(n, a), d, language_model.log_stirling(d), np.random.default_rng(2)), np.random.default_rng(3)
    for seated in range(language_model.EXACT, c):
        want += one.random(n) < a / (seated - d * want + a)
    error = want.std() * (2 / n) ** 0.5
    assert abs(got.mean() - want.mean()) < 4 * error and abs(got.std() / want.std() - 1) < 0.05 and rng.calls <= 100
