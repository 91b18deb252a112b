"""N-gram Jaccard join with token-combination prefixes.

Links are pairs of texts whose sets of word shingles have 100 * |intersection| >= percent * |union|.

1. Common shingles: all shingles of all texts are counted, as sorted runs of short hashes per bucket. The most common (a
   list of bounded size) get levels by their counts and come last in the order of tokens, by level; any order gives the
   same links, this one makes prefixes rare.
2. Texts with equal sets form a class; from here on a class is one member (`cid` names it).
3. Prefix: with n tokens and n - ceil(t n) + 1 of them, two linked sets share a token; with one more they share two
   (k = 2). A token that few prefixes hold (rare) is indexed alone. Common ones are indexed in pairs.
   If two linked sets share a rare token, they meet there; if all they share are common, they share two of them.
4. The index first has the rare tokens and those pairs of common tokens that are neighbours in a prefix, so it is no
   larger than the prefixes. Each member of a list is compared with one member alone, that with the fewest tokens of its
   own, so the middle of a group of near copies. What links this finds joins large groups, whose members need no further
   comparison with each other: components of links are the result, and a link inside a component adds nothing to it.
5. Then members of different components that still meet, under a rare token or any pair of common ones, are compared
   if their sizes allow a link without the tokens that no other prefix holds: where the other's prefix reaches beyond
   the tokens without a level, it lacks all such tokens of this one. Nor can it have the tokens before the meeting: two
   linked sets meet at their first shared rare token, before which they share common ones alone, or else at their first
   two shared tokens, before which they share none. What is left behind the meeting must be enough for a link. No list
   is gathered in one place; joins stream and adaptive execution splits them.
6. A pair is dropped early only if its prefixes prove that it cannot link: up to the smaller of their last tokens both
   sets are known, and what is left of the smaller set bounds what else they can share. All other pairs are compared
   on whole sets of 64-bit shingle hashes, made again from the whole texts. A bitmap (16 bits a wanted text, at most
   MOST_BITS) tells most texts that no pair needs before any text is shuffled; a join tells the rest.

Defined results: a null or blank text has no shingles and links with nothing; a row with a null doc_id belongs to its
class like any other but gives no component its id, so a component of such rows alone has a null component_id; a doc_id
that repeats joins nothing by itself, and its rows each get the smallest id of what they link with; extra columns are
left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.llm.common import Workspace, claim, free_names, input_bytes, parted, table
from seine.llm.components import components
from seine.llm.shingles import Shingler, class_id

#: A shingle counts as common from so many texts on; so many are kept at most, the most common ones.
SEEN, COMMON = 6, 1 << 19
#: Bits of a hash that are compared within a bucket of counts; a chance match only changes the order of tokens.
SHORT = 32
#: A token in more prefixes than this is indexed in combinations.
FREQUENT = 64


#: Stands for a null doc_id, after all others.
NO_ID = (1 << 63) - 1
_ONE, _SIX, _LEVEL = np.uint64(1), np.uint64(6), np.uint64(58)
#: Bits of the bitmap that spares texts a shuffle, for a wanted text and at most; and bits in a word of it.
BITS_EACH, MOST_BITS, WORD = 16, 1 << 27, 64


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def common_shingles(docs: DataFrame, k: int, run_of: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, int]:
    """Short hashes of the most common shingles, ascending, their levels (1 to 63), and by how many bits a hash is cut.
    At most COMMON of them reach the driver."""
    bits = max(8, (input_bytes(docs, "text") >> 22).bit_length())
    cut = 64 - bits - SHORT

    def runs(batches) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        sh, held, n = Shingler(k), [], 0

        def counted():
            v = np.sort(np.concatenate(held)) >> np.uint64(cut)
            stops = np.searchsorted(v, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(SHORT))
            parts = np.split(v.astype(np.uint32), stops)
            some = [i for i, x in enumerate(parts) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["bucket", "data"])

        for batch in batches:
            for text in batch.column(0):
                held.append(sh.set(text.as_py()))
                n += len(held[-1])
                if n >= run_of:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    def totals(batches) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def counted():
            v, n = np.unique(np.frombuffer(b"".join(held), np.uint32), return_counts=True)
            keep = n >= SEEN
            return pa.RecordBatch.from_arrays([pa.array((now << SHORT) + v[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and bucket != now:
                    yield counted()
                    held = []
                now = bucket
                held.append(data)
        if held:
            yield counted()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("text").mapInArrow(runs, "bucket int, data binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    top = dealt.mapInArrow(totals, "token long, n long").orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    token, n = top.column(0).to_numpy().astype(np.uint64), top.column(1).to_numpy()
    by = np.argsort(token)
    return token[by], np.minimum(2 * np.log2(np.maximum(n[by], 1)), 63).astype(np.uint64), cut


def prefixes(docs: DataFrame, k: int, percent: int, common: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """doc_id, n_shingles, cid (null without shingles), prefix, plain (its tokens without a level), deep (whether it has
    tokens with one). Tokens are unsigned in order: six bits of the level, then 58
    bits of the hash; columns hold them as signed longs."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        sh, (late, level, cut) = Shingler(k), shared.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for text in part.column(1):
                    s = sh.set(text.as_py())
                    n = len(s)
                    order = s >> _SIX
                    if n and len(late):
                        short = s >> np.uint64(cut)
                        where = np.minimum(np.searchsorted(late, short), len(late) - 1)
                        order |= np.where(late[where] == short, level[where], 0).astype(np.uint64) << _LEVEL
                        order.sort()
                    most = n - (percent * n + 99) // 100 + 2
                    order = order[:most]
                    plain = int(np.searchsorted(order, _ONE << _LEVEL))
                    rows.append((n, class_id(s) if n else None, order.view(np.int64), plain, plain < len(order)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, kind) for c, kind in zip(cols, kinds[1:]))], ["doc_id", "n_shingles", "cid", "prefix", "plain", "deep"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cid long, prefix array<long>, plain long, deep boolean")


def sets_of(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """cid and whole set (ascending hashes as bytes) of the rows whose doc_id is in the bitmap of `wanted` (doc_id)."""
    size = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    words = wanted.select(F.floor(bit / WORD).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {WORD}) as int))").alias("v"))
    rows = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # at most MOST_BITS / WORD rows
    bitmap = np.zeros(size // WORD, np.uint64)
    bitmap[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        sh, bits = Shingler(k), shared.value
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            there = (bits[at // np.uint64(WORD)] >> (at % np.uint64(WORD))) & _ONE
            batch = batch.filter(pa.array(there.astype(bool)))
            for at in range(0, batch.num_rows, 500):
                sets = [s for t in batch.column(0).slice(at, 500) if len(s := sh.set(t.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "tokens"])

    return docs.select("text", bit.alias("bit")).mapInArrow(run, "cid long, tokens binary")


def hopeful(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that their prefixes do not rule out."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sizes, rows = [batch.column(i).to_pylist() for i in (2, 3)], [batch.column(i) for i in (4, 5)]
            for n, m, x, y in zip(*sizes, *rows):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                last = min(x[-1], y[-1])
                i, j = (int(np.searchsorted(v, last, "right")) for v in (x, y))
                both = len(np.intersect1d(x[:i], y[:j], assume_unique=True)) + min(n - i, m - j)
                keep.append(100 * both >= percent * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(f"p{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (sets.select(F.col("cid").alias(c), F.col("tokens").alias(f"s{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame, work: Workspace, k: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """Written rows (doc_id, n_shingles, cid) and classes (cid, first_id: its smallest doc_id or null, label: the class
    that names the component)."""
    rows = work.write(prefixes(docs, k, percent, common_shingles(docs, k)), "prefixes")
    one = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in ("prefix", "plain", "deep")))
    classes = work.write(one, "classes")
    member = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    lists = work.write(member.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "lists")
    met = work.write(member.join(lists, "token").select("token", "m", "cid", "n", "pos"), "met")
    # how many of a class's tokens without a level no other prefix holds
    held = met.where("shiftrightunsigned(token, 58) = 0").groupBy("cid").agg(F.count("*").alias("held"))
    own = work.write(classes.select("cid", "plain", "deep").join(held, "cid", "left").select("cid", (F.col("plain") - F.coalesce("held", F.lit(0))).alias("alone"), "deep"), "own")
    before = Window.partitionBy("cid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    shared = F.coalesce(F.count(F.when(F.col("m") > frequent, 1)).over(before), F.lit(0))
    known = work.write(met.join(own, "cid").withColumn("spent", F.col("pos") - shared), "known")
    work.drop(met, lists, own)

    def may(x: str, y: str, *more: str):
        most = f"least({', '.join([f'{x}.n - if({y}.deep, {x}.alone, 0)', f'{y}.n - if({x}.deep, {y}.alone, 0)', *more])})"
        return F.expr(f"100 * {most} >= {percent} * ({x}.n + {y}.n - {most})")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = work.write(hopeful(pairs, classes, percent), "hopeful")
        sides = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        want = work.write(classes.select("cid", F.col("first_id").alias("doc_id")).join(sides, "cid", "left_semi"), "want")
        sets = work.write(sets_of(docs, k, want).join(want, "cid", "left_semi").dropDuplicates(["cid"]), "sets")
        found = work.write(verified(pairs, sets, percent), "found")
        work.drop(want, sets)
        return found

    # 4. the index, and each list's member with the fewest tokens of its own against the others
    next_ = F.lead("token").over(Window.partitionBy("cid").orderBy("token"))
    of = ["cid", "n", "alone", "deep"]
    alone = known.where(F.col("m") <= frequent).select(F.col("token").alias("t1"), F.col("token").alias("t2"), *of)
    paired = known.where(F.col("m") > frequent).select(F.col("token").alias("t1"), next_.alias("t2"), *of).where("t2 is not null")
    index = work.write(alone.union(paired), "index")
    heads = work.write(index.groupBy("t1", "t2").agg(F.min(F.struct("alone", "cid", "n", "deep")).alias("y"), F.count("*").alias("size")).where("size > 1").drop("size"), "heads")
    stars = index.alias("x").join(heads, ["t1", "t2"]).where("x.cid <> y.cid").where(may("x", "y"))
    pairs = work.write(stars.select(F.col("y.cid").alias("a"), F.col("x.cid").alias("b")).distinct(), "stars")
    links = linked(pairs)
    labels = components(work, links)
    work.drop(index, heads)

    # 5. members of different components that meet
    named = work.write(known.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")), "named")
    work.drop(known)
    # sizes of linked sets lie in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100.01 / percent))
    banded = named.select("*", band.alias("home"), F.explode(F.array(band, band + 1)).alias("band"))
    mixed = work.write(banded.groupBy("token", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token", "band"), "mixed")
    left = work.write(banded.join(mixed, ["token", "band"]), "left")
    work.drop(named, mixed)

    def meetings(index: DataFrame, keys: list[str]) -> DataFrame:
        x, y = index.alias("x"), index.hint("merge").alias("y")
        same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in keys]
        once = F.col("x.band") == F.greatest("x.home", "y.home")  # of the bands that both are in, one
        enough = may("x", "y", "x.n - x.spent", "y.n - y.spent")
        return x.join(y, [*same, F.col("x.cid") < F.col("y.cid"), F.col("x.label") != F.col("y.label"), once, enough]).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))

    rare = meetings(left.where(F.col("m") <= frequent), ["token", "band"])
    of = ["cid", "n", "label", "alone", "deep", "home", "band"]
    common = left.where(F.col("m") > frequent).groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t")).where("size(t) > 1")
    first = common.select(*of, "t", F.posexplode("t").alias("i", "a"))
    both = first.select(*of, "a", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("b"))  # t itself stays behind
    combined = both.select(*of, F.col("a.token").alias("t1"), F.col("b.token").alias("t2"), (F.col("b.pos") - 1).alias("spent"))
    # lists that lie in one component alone make no meeting
    kept = work.write(combined.groupBy("t1", "t2", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("t1", "t2", "band"), "kept")
    more = rare.union(meetings(work.write(combined.join(kept.hint("merge"), ["t1", "t2", "band"]), "combined"), ["t1", "t2", "band"])).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = work.write(more.join(done, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        labels = components(work, links.union(linked(rest)))
    out = classes.select("cid", "first_id").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "first_id", F.coalesce("label", "cid").alias("label"))
    return rows.select("doc_id", "n_shingles", "cid"), work.write(out, "leads")


def near_duplicates(docs: DataFrame, work: Workspace, k: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    rows, leads = _classes(_ids(docs), work, k, percent, frequent)
    least = work.write(leads.groupBy("label").agg(F.min("first_id").alias("component_id")), "least")
    of = work.write(leads.join(least, "label").select("cid", "component_id"), "component_of")
    return parted(rows, of, "cid").select("doc_id", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, work: Workspace, k: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """The rows of docs without near copies: of each component one row stays, that with the smallest doc_id (nulls last);
    if several rows have it, one whose set has the smallest class id, and of rows equal in id and text one. Rows without
    shingles link with nothing and all stay. The columns of docs, whatever their names."""
    text = _ids(docs)
    _, leads = _classes(text, work, k, percent, frequent)
    first = F.struct(F.coalesce("first_id", F.lit(NO_ID)).alias("at"), "first_id", "cid")
    lead = leads.groupBy("label").agg(F.min(first).alias("x")).select("x.cid", F.col("x.first_id").alias("first_id"))
    lead = work.write(lead, "kept_classes")
    # the set's class is worked out again beside the row, so rows meet what stays by class and id: no copies meet in a task
    cid, at, turn = free_names(docs, "class", "at", "turn")
    rows = with_class(docs, cid, k)
    none, some = rows.where(F.col(cid).isNull()), rows.where(F.col(cid).isNotNull())
    some = some.withColumn(at, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    kept = some.join(lead.select(F.col("cid").alias(cid), F.coalesce("first_id", F.lit(NO_ID)).alias(at)).hint("merge"), [cid, at])
    order = Window.partitionBy(cid, at).orderBy(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns)))
    kept = kept.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*cols).union(none.select(*cols))


def with_class(docs: DataFrame, name: str, k: int) -> DataFrame:
    """docs with one more column: the id of the text's set of shingles, null without shingles."""
    n = len(docs.columns)
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        sh = Shingler(k)
        for batch in batches:
            ids = [class_id(s) if len(s := sh.set(t.as_py())) else None for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(ids, pa.int64())], out.names)

    (view,) = free_names(docs, "view")
    return docs.select("*", docs["text"].cast("string").alias(view)).mapInArrow(run, out)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op5"), k=3, percent=90)


QUERIES = {"op5_jaccard": op5_jaccard}
SQL: dict[str, str] = {}
