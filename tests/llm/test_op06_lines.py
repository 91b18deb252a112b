"""Line dedup against a whole suffix array with its longest common prefixes, and on odd rows."""

import random

from seine.llm import op06_lines as op
from seine.llm.common import Workspace


def by_suffix_array(texts, least):
    """Texts in order -> texts left. Sorts all suffixes, takes the longest common prefix of every pair of neighbours, and of
    each suffix the longest earlier match, which is the least prefix on the way to the nearest suffix that starts earlier."""
    seq, where = [], []
    for d, text in enumerate(texts):
        for l, raw in enumerate(text.split("\n")):
            if line := raw.strip(" \t\n\x0b\x0c\r"):
                seq.append(line)
                where.append((d, l))
        seq.append((d,))  # ends a text; equal to nothing else
        where.append(None)
    key = lambda i: [(str(x), isinstance(x, tuple)) for x in seq[i : i + 200]]
    order = sorted(range(len(seq)), key=key)

    def common(i, j):
        n = 0
        while i + n < len(seq) and j + n < len(seq) and seq[i + n] == seq[j + n]:
            n += 1
        return n

    lcp = [common(i, j) for i, j in zip(order, order[1:])]
    longest = [0] * len(seq)
    for step in (1, -1):
        for at, i in enumerate(order):
            n, k = 10**9, at
            while 0 <= k - step < len(order) and n:
                n = min(n, lcp[min(k, k - step)])
                k -= step
                if order[k] < i:
                    longest[i] = max(longest[i], n)
                    break
    gone = set()
    for i, n in enumerate(longest):
        if n and sum(len(x.split()) for x in seq[i : i + n]) >= least:
            gone |= {where[j] for j in range(i, i + n)}
    return ["\n".join(r for l, r in enumerate(t.split("\n")) if (d, l) not in gone) for d, t in enumerate(texts)]


def test_suffix_array(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(9)]
    lines = ["", " "] + [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(12)]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 14))) for _ in range(120)]
    passage = "\n\n".join(f"verse {i} of a long song with words" for i in range(25))
    texts += [f"head {i}\n{passage}\ntail {i}" for i in range(3)] + texts[:10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(op.without_copies(docs, Workspace(spark, "t"), 10, drop_empty=False).select("doc_id", "text").collect())
    assert [got[i] for i in range(len(texts))] == by_suffix_array(texts, 10)
    assert sum(len(t) for t in got.values()) < sum(map(len, texts))


def test_blank_lines_do_not_part_a_run(spark):
    verse = "\n\n".join(f"eight words are in line number {i} here" for i in range(8))
    rows = op.without_copies(spark.createDataFrame([(1, verse), (2, f"own words\n{verse}")], "doc_id long, text string"), Workspace(spark, "t"))
    assert {r["doc_id"]: r["text"].split() for r in rows.collect()} == {1: verse.split(), 2: ["own", "words"]}


def test_odd_rows_and_clashing_names(spark, odd):
    rows = odd.selectExpr("*", *(f"1 as {c}" for c in ("r_", "gone_", "lines_", "text_", "seine_row", "seine_gone", "seine_lines", "seine_left", "h1", "d", "e")))
    got = op.without_copies(rows, Workspace(spark, "t"))
    assert got.columns == rows.columns
    left = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert (3, None) in left and (4, "") in left and (5, " \n\t ") in left
    assert (2, "the quick brown fox jumps over the lazy dog and runs away") not in left
    assert {x for x in left if x[0] in (10, 11, 12)} == {(10, "first\nthis line has more than ten words and it is repeated in other texts\nlast"), (11, "\nother")}
    assert got.where("doc_id = 8").count() == 2
    assert op.without_copies(rows.limit(0), Workspace(spark, "t")).count() == 0
