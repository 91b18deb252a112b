"""Line dedup over a suffix array of line ids, in DataFrame functions alone.

All lines of all texts that are not blank form one sequence of line ids, in the order of (doc_id, text hash, line).
Prefix doubling gives each position a class for each power of two: positions have the same class at level k if the next
2**k lines are the same. A class is named by its first position, so a class also tells where its run occurs first. Level
k + 1 comes from the pairs (class of the position, class of the position 2**k further); a position whose class has no
second member leaves, as nothing longer repeats there. The levels sort the suffixes, and two suffixes have a common
prefix of n lines or more exactly if they share the classes of the two overlapping runs of 2**k <= n lines that cover
it: such a class is an interval of the suffix array whose longest common prefix has n lines or more.

A run of lines is deleted where it has occurred before, if it has at least `min_words` words. A maximal repeated run is
the union of its shortest windows with that many words, seen from each of its lines on and back; a window is a later
copy if its interval has an earlier position. A line has a word at least, so windows have at most `min_words` lines, and
what the suffix array would tell beyond that many lines decides nothing: doubling stops at the level that covers them
(the tests hold the result against a whole suffix array with its longest common prefixes, and the SQL finds maximal
repeated runs by extending matches).

Common lines are no hot groups: counts and minima have partial sums, and the joins back are between written tables,
which adaptive execution may split. Only positions of lines that repeat take part after the first count. The texts meet
their deletions in one plan at every size: an exchange, which no threshold turns into a broadcast.

Defined results: lines end at line feeds and are compared without white space at their ends; blank lines are no part of
runs, which go on across them, and are never deleted; a null text stays null and has no lines; a text that lost a line
and has nothing but blank lines left is dropped (drop_empty) or comes back with those; rows with a null doc_id come
first in order; rows with equal doc_id come in the order of a hash of their texts, and rows equal in both share one
fate; extra columns are kept whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seine.llm.common import Workspace, free_names, table

MIN_WORDS = 10
SPACE = r"\x20\x09-\x0D"
#: The same for btrim.
ENDS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), l (number of the line among those that are not blank), h1, h2 (the line), w (its words)."""
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    full = F.expr(f"filter(transform(split(text, '\\n'), x -> btrim(x, {ENDS})), x -> x <> '')")
    rows = text.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(full).alias("l", "line"))
    return rows.select("doc_id", "t", "l", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.size(F.split("line", f"[{SPACE}]+")).alias("w"))


def repeated_positions(docs: DataFrame, work: Workspace) -> DataFrame:
    """pos (ascending in order), r (row), l, w, c (level 0 class): positions whose line occurs elsewhere too."""
    lines = lines_of(docs)
    often = work.write(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "often")
    found = lines.join(often, ["h1", "h2"]).withColumn("r", F.xxhash64("doc_id", "t"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("t").asc(), F.col("l").asc()]
    dealt = found.dropDuplicates(["r", "l"]).repartitionByRange(*order).sortWithinPartitions(*order)
    # the partition is in the upper bits, so the ids ascend in this order
    placed = work.write(dealt.select(F.monotonically_increasing_id().alias("pos"), "r", "l", "w", "h1", "h2"), "positions")
    first = work.write(placed.groupBy("h1", "h2").agg(F.min("pos").alias("c"), F.count("*").alias("n")).where("n > 1").drop("n"), "level0")
    return work.write(placed.join(first, ["h1", "h2"]).select("pos", "r", "l", "w", "c"), "classes0")


def doubled(level: DataFrame, k: int, work: Workspace) -> DataFrame:
    """Classes of 2**(k + 1) lines from those of 2**k."""
    step = 1 << k
    w = Window.partitionBy("r").orderBy("l").rangeBetween(step, step)
    pairs = work.write(level.withColumn("d", F.max("c").over(w)).where("d is not null"), "pairs")
    first = work.write(pairs.groupBy("c", "d").agg(F.min("pos").alias("e"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    return work.write(pairs.join(first, ["c", "d"]).select("pos", "r", "l", F.col("e").alias("c")), f"classes{k + 1}")


def copies(docs: DataFrame, work: Workspace, min_words: int = MIN_WORDS) -> DataFrame:
    """r, gone: the line numbers of each row that belong to later copies."""
    base = repeated_positions(docs, work)
    levels, k = [base.select("pos", "r", "l", "c")], 0
    while 2 << k <= min_words:
        levels.append(doubled(levels[-1], k, work))
        k += 1
    island = base.withColumn("run", F.col("l") - F.row_number().over(Window.partitionBy("r").orderBy("l")))
    near = Window.partitionBy("r", "run").orderBy("l")
    count = f"aggregate({{}}, named_struct('s', 0, 'n', 0), (a, x) -> if(a.s >= {min_words}, a, named_struct('s', a.s + x, 'n', a.n + 1)), a -> if(a.s >= {min_words}, a.n, null))"
    island = island.withColumn("on", F.collect_list("w").over(near.rowsBetween(0, min_words - 1))).withColumn("back", F.reverse(F.collect_list("w").over(near.rowsBetween(1 - min_words, 0))))
    sized = island.select("r", "l", F.expr(count.format("`on`")).alias("on"), F.expr(count.format("back")).alias("back"))
    spans = sized.where("`on` is not null").select("r", "l", F.col("on").alias("n")).union(sized.where("back is not null").select("r", F.expr("l - back + 1"), "back"))
    spans = work.write(spans.distinct(), "windows")  # r, l (first line), n (lines)
    later = []
    for k, level in enumerate(levels):
        here = spans.where(F.col("n").between(1 << k, (2 << k) - 1))
        start = here.join(level.select("r", "l", "pos", F.col("c").alias("a")), ["r", "l"])
        later.append(start.where(f"n = {1 << k} and a < pos").select("r", "l", "n"))
        if k:
            rest = start.where(f"n > {1 << k}").withColumn("m", F.expr(f"l + n - {1 << k}"))
            both = work.write(rest.join(level.select("r", F.col("l").alias("m"), F.col("c").alias("b")), ["r", "m"]).select("r", "l", "n", "pos", "a", "b"), "spans")
            first = work.write(both.groupBy("n", "a", "b").agg(F.min("pos").alias("e")), "intervals")
            later.append(both.join(first, ["n", "a", "b"]).where("e < pos").select("r", "l", "n"))
    out = later[0]
    for x in later[1:]:
        out = out.union(x)
    hit = out.select("r", F.explode(F.expr("sequence(l, l + n - 1)")).alias("l"))
    return work.write(hit.groupBy("r").agg(F.collect_set("l").alias("gone")), "gone")


def marked(docs: DataFrame, work: Workspace, min_words: int = MIN_WORDS) -> tuple[DataFrame, list[str]]:
    """docs with three more columns and their names: all lines, the numbers of deleted lines (null if none) and what is
    left of the text."""
    key, lines, gone, text = free_names(docs, "row", "lines", "gone", "left")
    found = copies(docs, work, min_words).select(F.col("r").alias(key), F.col("gone").alias(gone))
    rows = docs.withColumn(key, F.xxhash64(docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))))
    rows = rows.join(found.hint("merge"), key, "left").drop(key).withColumn(lines, F.split(F.col("text").cast("string"), "\n"))
    full = f"filter(transform(`{lines}`, (x, i) -> if(btrim(x, {ENDS}) <> '', i, -1)), i -> i >= 0)"
    rows = rows.withColumn(gone, F.expr(f"if(`{gone}` is null, null, filter({full}, (i, m) -> array_contains(`{gone}`, m)))"))
    left = F.expr(f"array_join(transform(array_except(sequence(0, size(`{lines}`) - 1), `{gone}`), i -> element_at(`{lines}`, i + 1)), '\n')")
    return rows.withColumn(text, F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)), [lines, gone, text]


def without_copies(docs: DataFrame, work: Workspace, min_words: int = MIN_WORDS, drop_empty: bool = True) -> DataFrame:
    """The documents without later copies of runs of lines; the same columns, in the same order."""
    rows, (_, gone, text) = marked(docs, work, min_words)
    if drop_empty:
        rows = rows.where(F.col(gone).isNull() | F.col(text).rlike(f"[^{SPACE}]"))
    return rows.select(*(F.col(text).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, (lines, gone, text) = marked(docs, Workspace(spark, "op6"))
    left = F.coalesce(text, F.lit(""))
    return rows.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_deleted"),
        F.octet_length(left).cast("long").alias("bytes_left"), F.sha2(F.encode(left, "utf-8"), 256).alias("left_sha256"),
    )


#: Every pair of equal lines extended to its maximal run: pairs of two texts at one distance that follow each other.
_SQL = rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, l, line, row_number() OVER (PARTITION BY doc_id ORDER BY l) AS m, len(string_split_regex(line, '[\x20\x09-\x0D]+')) AS w
          FROM (SELECT doc_id, l, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM lines) WHERE line <> ''),
pairs AS (SELECT a.doc_id AS d, b.doc_id, b.l, b.m, b.w, b.m - a.m AS apart FROM words a JOIN words b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.m < b.m))),
runs AS (SELECT *, m - row_number() OVER (PARTITION BY d, doc_id, apart ORDER BY m) AS run FROM pairs),
sized AS (SELECT doc_id, l, sum(w) OVER (PARTITION BY d, doc_id, apart, run) AS s FROM runs),
gone AS (SELECT DISTINCT doc_id, l FROM sized WHERE s >= {MIN_WORDS}),
kept AS (SELECT doc_id, count(*) AS n_lines, count(gone.l) AS n_deleted, coalesce(string_agg(raw, chr(10) ORDER BY lines.l) FILTER (WHERE gone.l IS NULL), '') AS left_text
         FROM lines LEFT JOIN gone USING (doc_id, l) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, strlen(coalesce(left_text, '')) AS bytes_left, sha256(coalesce(left_text, '')) AS left_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


QUERIES = {"op6_lines": op6_lines}
SQL = {"op6_lines": _SQL}
