"""Tiered retrieval: exact term or bigrams, then cosine with proximity, then authority."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seine.config import MIN_IDF, PROXIMITY_WEIGHT, RANK_WEIGHT, RELEVANCE_WEIGHT, RETURN_SIZE
from seine.functions.text import query_tokens


@dataclass
class Index:
    """postings: doc_id, term, log_tf (stored), positions; terms: term, df, idf; norms: doc_id, norm; ranks: doc_id, rank."""

    postings: DataFrame
    terms: DataFrame
    norms: DataFrame
    ranks: DataFrame | None = None


@dataclass
class Query:
    counts: dict[str, int]
    idf: dict[str, float]

    @property
    def unigrams(self) -> list[str]:
        return [t for t in self.counts if " " not in t]

    @property
    def weights(self) -> dict[str, float]:
        """Terms that are known and not too common."""
        return {t: (1 + math.log10(c)) * self.idf[t] for t, c in self.counts.items() if t in self.idf and self.idf[t] >= MIN_IDF}

    @property
    def bigrams(self) -> list[str]:
        """Known bigrams of which both parts are known and not too common."""
        return [t for t in self.counts if " " in t and t in self.idf and all(self.idf.get(p, 0) >= MIN_IDF for p in t.split(" "))]


def query_terms(text: str, stemmed: bool = False) -> dict[str, int]:
    """Counts of the query's terms and bigrams."""
    words = query_tokens(text, stemmed)
    counts: dict[str, int] = {}
    for t in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        counts[t] = counts.get(t, 0) + 1
    return counts


def parse(text: str, terms: DataFrame, stemmed: bool = False) -> Query:
    """Counts of the query's terms and bigrams; their idf is looked up (a row per term of the query)."""
    counts = query_terms(text, stemmed)
    idf = {r["term"]: r["idf"] for r in terms.where(F.col("term").isin(list(counts))).select("term", "idf").collect()} if counts else {}
    return Query(counts, idf)


def lookup(index: Index, terms: list[str]) -> DataFrame:
    """Postings of the terms, with norms; the filter reaches the scan of a stored index."""
    found = index.postings.where(F.col("term").isin(terms)) if terms else index.postings.limit(0)
    return found.join(index.norms, "doc_id", "left").withColumn("norm", F.coalesce("norm", F.lit(1.0)))


def exact_search(index: Index, terms: list[str]) -> DataFrame:
    """doc_id, score: the best log_tf / norm of the terms (one term, or the bigrams of a query)."""
    return lookup(index, terms).groupBy("doc_id").agg(F.max(F.col("log_tf") / F.col("norm")).alias("score"))


def min_span(found: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, span: the least number of positions that holds every present term once."""
    at = found.select("doc_id", "term", F.explode("positions.pos").alias("pos"))
    w = Window.partitionBy("doc_id").orderBy("pos", "term").rowsBetween(Window.unboundedPreceding, 0)
    lasts = [F.max(F.when(F.col("term") == t, F.col("pos"))).over(w) for t in terms]
    seen = at.select("doc_id", "pos", F.array(*lasts).alias("last")).select("doc_id", "pos", F.expr("filter(last, x -> x is not null)").alias("last"))
    ends = seen.groupBy("doc_id", F.size("last").alias("n")).agg(F.min(F.col("pos") - F.array_min("last") + 1).alias("span"))
    return ends.groupBy("doc_id").agg(F.max_by("span", "n").alias("span"))


def vector_search(index: Index, query: Query) -> DataFrame:
    """doc_id, n_match, score of all documents with a unigram of the query that counts."""
    weights = query.weights
    terms = sorted(weights)
    norm = math.sqrt(sum(w * w for w in weights.values()))
    found = lookup(index, terms)
    weight = F.create_map(*(F.lit(x) for t in terms for x in (t, weights[t]))) if terms else F.lit(None)
    plain = found.withColumn("w", weight[F.col("term")]) if terms else found.withColumn("w", F.lit(0.0))
    sums = plain.groupBy("doc_id").agg(F.sum(F.col("log_tf") * F.col("w")).alias("dot"), F.first("norm").alias("norm"), F.count("*").alias("present"), F.sum(F.when(~F.col("term").contains(" "), 1).otherwise(0)).alias("n_match"))
    if len(terms) > 1:
        sums = sums.join(min_span(found, terms), "doc_id", "left")
    else:
        sums = sums.withColumn("span", F.lit(None).cast("int"))
    coverage = F.col("present") / F.lit(float(max(1, len(terms))))
    near = F.when(F.col("present") <= 1, coverage).otherwise(coverage / F.col("span"))
    scale = F.lit(norm) * F.col("norm")
    score = F.col("dot") / F.when(scale == 0, 1.0).otherwise(scale) * (1 + PROXIMITY_WEIGHT * near)
    return sums.where("n_match > 0").select("doc_id", "n_match", "present", near.alias("proximity"), score.alias("score"))


def top(results: DataFrame, k: int = RETURN_SIZE) -> DataFrame:
    """Ties (to nine places) go to the smaller doc_id."""
    return results.orderBy(F.round("score", 9).desc(), F.col("doc_id").asc()).limit(k)


def tiered_search(index: Index, text: str, stemmed: bool = False, k: int = RETURN_SIZE) -> DataFrame:
    """doc_id, score of the k best."""
    query = parse(text, index.terms, stemmed)
    unigrams = query.unigrams
    results = exact_search(index, unigrams if len(unigrams) == 1 else query.bigrams)
    if not query.weights:
        more = None
    else:
        # the level of relaxation is found from counts: a row per number of matched words
        scored = vector_search(index, query)
        q = sum(1 for t in query.weights if " " not in t)
        marked = scored.select("doc_id", "n_match").join(results.select("doc_id", F.lit(1).alias("hit")), "doc_id", "full")
        levels = {(r["n_match"] or 0, r["hit"]): r["n"] for r in marked.groupBy("n_match", "hit").agg(F.count("*").alias("n")).collect()}
        first = sum(n for (_, hit), n in levels.items() if hit)
        more = None
        if first < k and q:
            union = lambda i: first + sum(n for (m, hit), n in levels.items() if not hit and m >= i)
            level = next((i for i in range(max(1, q - 1), 0, -1) if union(i) >= k), 1)
            more = scored.where(F.col("n_match") >= level).select("doc_id", "score")
    if more is not None:
        results = results.union(more).groupBy("doc_id").agg(F.max("score").alias("score"))
    return top(blended(results, index.ranks) if index.ranks is not None else results, k)


def blended(results: DataFrame, ranks: DataFrame) -> DataFrame:
    """Relevance and rank (as a share of the highest rank). Without any rank relevance stays as it is."""
    best = ranks.agg(F.max("rank")).first()[0]
    if best is None:
        return results
    score = RELEVANCE_WEIGHT * F.col("score") + RANK_WEIGHT * F.coalesce("rank", F.lit(0.0)) / F.lit(best)
    return results.join(ranks, "doc_id", "left").select("doc_id", score.alias("score"))
