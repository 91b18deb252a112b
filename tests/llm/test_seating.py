"""Operator 2: table counts after one sweep against their conditional distribution."""

import numpy as np
import pytest

from seine.llm import op02_lm as lm


def logs(d, c):
    """log S(c, 0..c) by the recurrence."""
    row = np.array([0.0])
    for n in range(1, c + 1):
        t = np.arange(n + 1)
        old = np.append(row, -np.inf)
        with np.errstate(divide="ignore"):
            row = np.logaddexp(np.append(-np.inf, row), np.log(np.maximum(n - 1 - d * t, 0)) + old)
    return row


@pytest.mark.parametrize("d", [0.1, 0.5, 0.95])
def test_large_counts(d):
    for c in (600, 1500):
        t = np.array([1, 2, 3, 10, 60, 300, 590])
        assert np.allclose(lm.large(np.full(len(t), float(c)), t.astype(float), d), logs(d, c)[t], atol=2e-3, rtol=0)


@pytest.mark.parametrize("c, above", [(10, 0.5), (400, 0.3), (400, 0.001), (2000, 0.3), (2000, 0.0005)])
def test_one_sweep_reaches_the_conditional(c, above):
    d, base, n, rng = 0.7, 20 / 0.7 + 30, 4000, np.random.default_rng(1)
    t = np.arange(1, c + 1)
    p = logs(d, c)[1:] + np.cumsum(np.log(above * d * (base + t - 1)))
    p = np.exp(p - p.max())
    p /= p.sum()
    mean = p @ t
    sd = (p @ (t - mean) ** 2) ** 0.5
    got = lm.seated(np.full(n, c), np.full(n, base), np.full(n, above), d, rng)
    assert abs(got.mean() - mean) < 4 * sd / n**0.5 and abs(got.std() / sd - 1) < 0.1


def test_a_cell_leaves_its_first_table():
    """Twenty words with 10,000 customers each: sweeps take them past the 12 tables that 12 moves could open."""
    words = np.arange(1, 21, dtype=np.uint64)
    b = lm.Bucket(words, (np.arange(20) << 32) | 0x6162, np.full(20, 10_000))
    tables = b.spread([0.3, 0.5, 0.7])
    for s in range(3):
        totals = lm.Totals([0.3, 0.5, 0.7], 20)
        for level, (c, t, at) in enumerate(zip(b.customers(tables), tables, b.places())):
            np.add.at(totals.customers[level], at, c)
            np.add.at(totals.tables[level], at, t)
        tables = b.sweep(tables, totals, np.random.default_rng(s))
    assert tables[2].min() > 13


def test_parameters_follow_the_seating():
    """Counts of customers and tables drawn from known discounts and strengths: what is drawn for them lies near."""
    rng = np.random.default_rng(4)
    for d, s in ((0.3, 30.0), (0.8, 3.0)):
        totals = lm.Totals([0.5, 0.5, 0.5], 10)
        fits = np.zeros((3, len(lm.DISCOUNTS)))
        for r in range(400):  # restaurants, each with its own dishes: a dish for each table
            sizes = []
            for _ in range(150):
                p = np.array([*(x - d for x in sizes), s + d * len(sizes)])
                k = rng.choice(len(p), p=p / p.sum())
                if k == len(sizes):
                    sizes.append(1)
                else:
                    sizes[k] += 1
            totals.customers[2][r], totals.tables[2][r] = 150, len(sizes)
            c = np.array(sizes)
            fits[2] += lm.stirling_sums(c, np.ones_like(c))
        totals.drawn(fits, rng)
        assert abs(totals.discount[2] - d) <= 0.1 and s / 4 <= totals.strength[2] <= 4 * s


def test_stirling_sums():
    c, t = np.array([3, 3, 600, 600, 700]), np.array([2, 2, 1, 600, 40])
    want = [sum(logs(d, int(a))[int(b)] for a, b in zip(c, t)) for d in lm.DISCOUNTS]
    assert lm.stirling_sums(c, t) == pytest.approx(want, abs=0.02)
