"""One row of each group stays; long texts of common shingles; rows without an id."""

import random

from seine.llm import op05_jaccard as j
from seine.llm.common import Workspace


def test_no_text_is_lost(spark):
    a, b = "one two three four five six seven eight", " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a), (2, b), (None, a), (5, b + " z"), (7, a), (7, a)]
    got = j.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t"))
    assert sorted(got.collect()) == [(1, a), (2, b)]


def test_repeats_and_rows_without_an_id(spark):
    a, c = "one two three four five six seven eight", "other words that nothing else has at all"
    rows = [(None, c), (None, c), (9, a), (9, a), (3, None), (3, None), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = j.one_of_each(docs, Workspace(spark, "t"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(None, c), (9, a), (3, None), (3, None), (4, " ")]))
    assert {(r["doc_id"], r["component_id"]) for r in j.near_duplicates(docs, Workspace(spark, "t")).collect()} == {(None, None), (9, 9), (3, 3), (4, 4)}


def test_odd(spark, odd):
    rows = odd.selectExpr("*", *(f"1 as {c}" for c in ("copy_", "cid2", "seine_class", "seine_at", "seine_turn", "seine_view", "tokens", "m")))
    got = j.one_of_each(rows, Workspace(spark, "t"))
    assert got.columns == rows.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in got.collect())
    assert ids == [-1, 1, 3, 4, 5, 6, 8, 10, 13]  # 11 and 12 are near 10
    assert j.one_of_each(rows.limit(0), Workspace(spark, "t")).count() == 0


def test_long_texts_of_common_shingles(spark):
    """Texts of 20,000 words of which all others have parts, so that every token of their prefixes is common."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(50_000)}" for _ in range(20_000)]
    near = words[:]
    for i in range(0, 20_000, 1000):
        near[i] = "changed"
    other = words[:10_000] + [f"x{i}" for i in range(10_000)]
    rows = [(0, " ".join(words)), (1, " ".join(near)), (2, " ".join(other))]
    rows += [(10 + i, " ".join(words[50 * i : 50 * i + 100])) for i in range(390)]
    got = j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), Workspace(spark, "t"), frequent=1)
    label = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert label == {d: 0 if d < 2 else d for d, _ in rows}
