"""Operator 4: domains with small shares of the tokens."""

import numpy as np
import pytest

from seine.llm import op04_mixing as mix
from seine.llm.common import Workspace


def fitted(spark, shares, targets, floor, most=None):
    rows = spark.createDataFrame([(i, int(s * 1_000_000), [float(i == j) for j in range(len(shares))]) for i, s in enumerate(shares)], "doc_id long, n_tokens long, p array<double>")
    plan = mix.fit_rates(rows, targets, floor, most)
    got = mix.rated(rows, plan).collect()
    tokens = sum(x["n_tokens"] * x["rate"] * np.array(x["p"]) for x in got)
    return plan, tokens / tokens.sum()


@pytest.mark.parametrize("shares", [(0.3, 0.69, 0.009, 0.001), (0.3, 0.698, 0.0019, 0.0001), (0.88, 0.04, 0.04, 0.04)])
@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_skewed_shares_meet_targets(spark, shares, floor):
    plan, got = fitted(spark, shares, mix.TARGETS, floor)
    assert np.abs(got - [0.2, 0.4, 0.2, 0.2]).max() < 2e-5 and np.abs(plan.missed).max() <= mix.CLOSE


def test_missed_targets_are_reported(spark):
    with pytest.warns(UserWarning, match="targets missed"):
        plan, _ = fitted(spark, (0.5, 0.4, 0.1, 0.0), mix.TARGETS, 0.0)
    assert plan.missed == pytest.approx([0, 0, 0, -0.2], abs=1e-4)
    with pytest.warns(UserWarning, match="targets missed"):
        plan, _ = fitted(spark, (0.3, 0.699, 0.0009, 0.0001), mix.TARGETS, 0.0, most=5.0)
    assert plan.missed[3] == pytest.approx(5e-4 - 0.2, abs=1e-4)


def test_floor_of_one(spark, big, labels):
    """In the pipeline no document goes: the rest are repeated until the targets are met."""
    work = Workspace(spark, "t")
    model = mix.fit_membership(big, mix.labelled_languages(big, labels), mix.TARGETS)
    rows = work.write(mix.posteriors(big, model), "p")
    plan = mix.fit_rates(rows, mix.TARGETS, 1.0, mix.MOST)
    got = mix.rated(rows, plan).collect()
    n, p, r = np.array([x["n_tokens"] for x in got]), np.array([x["p"] for x in got]), np.array([x["rate"] for x in got])
    assert r.min() >= 1 and r.max() <= mix.MOST and r.max() > 1.2
    share = (n * r) @ p
    assert np.abs(share / share.sum() - [0.2, 0.4, 0.2, 0.2]).max() < 1e-3
