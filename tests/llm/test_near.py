"""Operators 5 and 7 and connected components against brute force."""

import random

import numpy as np
import pytest

from seine.llm import op05_jaccard as j
from seine.llm import op07_embedding as v
from seine.llm.common import Workspace
from seine.llm.components import components


def groups(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)]
    rng.shuffle(chain)
    some = [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)]
    links = chain + some + [(200, i) for i in range(201, 220)] + [(7, 7), (0, 1)]
    got = {r["node"]: r["label"] for r in components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == groups(nodes, [x for x in links if x[0] != x[1]])
    assert components(Workspace(spark, "t"), spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = groups(range(len(rows)), links)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[label[i]] = min(least.get(label[i], doc_id), doc_id)
    return sorted((d, len(s), least[label[i]]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k, percent, frequent", [(3, 90, 64), (5, 80, 64), (2, 60, 2)])
def test_jaccard(spark, k, percent, frequent):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    passage = [rng.choice(words) for _ in range(12)]
    rows = [(0, ""), (1, None), (2, "W1 w2"), (3, "w1  W2"), (4, "w2 w1")]
    for i in range(5, 120):
        if i % 3 and i > 10:  # a copy of an earlier text with some words changed
            w = list(rows[rng.randrange(5, i)][1].split())
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.randrange(8, 60))] + passage * (i % 2)
        rows.append((i * 7 % 1000, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, j.near_duplicates(docs, Workspace(spark, "t"), k, percent, frequent).collect()))
    assert got == brute(rows, k, percent)


def test_jaccard_odd(spark, odd):
    got = j.near_duplicates(odd, Workspace(spark, "t")).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == odd.count() and by[1] == by[2] == 1 and by[6] == by[7] == 6 and by[3] == 3 and by[4] == 4 and by[5] == 5 and by[9] == by[8] == 8 and by[None] is None
    assert j.near_duplicates(odd.limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("block", [2048, 5])
def test_embedding(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    vec = [base[i % 30] + 0.12 * rng.standard_normal(16) * (i >= 30) for i in range(150)]
    vec += [vec[3]] * 4 + [2 * vec[3]]
    rows = [(i, [float(x) for x in e], i % 30 % 3) for i, e in enumerate(vec)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] * 8, 1), (904, [float("nan")] * 16, 1), (905, rows[3][1], None), (906, [float("inf")] + [1.0] * 15, 1), (907, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as cid", "1 as m", "2 as unit", "3 as bucket")
    unit = np.array(vec) / np.linalg.norm(vec, axis=1)[:, None]
    links = [(a, b) for a in range(len(vec)) for b in range(a) if rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93]
    label = groups(range(len(vec)), links)
    n = [sum(i in x for x in links) for i in range(len(vec))]
    want = [(i, n[i], label[i], i == label[i]) for i in range(len(vec))] + [(i, 0, i, True) for i in range(900, 908)]
    assert sum(n) > 100
    assert sorted(map(tuple, v.near_vectors(df, Workspace(spark, "t"), block=block).collect())) == want
    assert v.near_vectors(df.limit(0), Workspace(spark, "t")).count() == 0


def test_plan():
    for n in (0, 1, 100, 10**4, 10**8):
        planes, tables = v.plan(n)
        assert 1 - (1 - (1 - np.arccos(0.93) / np.pi) ** planes) ** tables >= v.RECALL


def test_recall_of_planted_pairs(spark):
    """20,000 vectors in one label, so 10 planes a table; 400 pairs planted at cosines from 0.93 to 0.95."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(400):
        c = 0.931 + 0.019 * i / 400
        side = rng.standard_normal(32)
        side -= (side @ x[i]) * x[i]
        x[10_000 + i] = c * x[i] + (1 - c * c) ** 0.5 * side / np.linalg.norm(side)
    x = x.astype(np.float32)
    assert v.plan(len(x))[0] >= 10
    docs = spark.createDataFrame([(i, r, 1) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in v.near_vectors(docs, Workspace(spark, "t")).where("n_links > 0").collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = set()
    for a in range(0, len(u), 1000):
        p, q = np.nonzero(u[a : a + 1000] @ u.T >= v.COSINE)
        links |= {(i + a, j) for i, j in zip(p.tolist(), q.tolist()) if i + a < j}
    assert len(links) >= 400
    n = {i: sum(i in e for e in links) for i in {i for e in links for i in e}}
    found = sum(min(got[i]["n_links"], k) for i, k in n.items() if i in got)
    assert found >= 0.99 * sum(n.values()) and all(got[i]["n_links"] <= n.get(i, 0) for i in got)
