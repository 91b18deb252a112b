"""Tokens, stems, bigrams and the SimHash of term bags as column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.functions.porter import stem

TOKENS = r"filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+', 0), x -> x rlike '^[a-z0-9]+$')"


def tokens(column: str) -> Column:
    """Runs of letters, digits and underscores, of which those in ASCII letters and digits alone are kept."""
    return F.coalesce(F.expr(TOKENS.format(column)), F.array().cast("array<string>"))


def query_tokens(text: str, stemmed: bool = False) -> list[str]:
    """The same for one query string, on the driver."""
    kept = [t for t in re.findall(r"\w+", text.lower()) if t.isalnum() and t.isascii()]
    return [stem(t) for t in kept] if stemmed else kept


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(rows: pa.Array) -> pa.Array:
    """Porter stems of arrays of tokens; a batch's words are stemmed once each, and each worker remembers words."""
    words = rows.flatten().dictionary_encode()
    found = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.list_value_length(rows), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, found)


def token_arrays(docs: DataFrame, text: str = "text", stemmed: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, t (kept tokens in order). The explode of one array keeps the regular expression from being run again by every use of t."""
    t = tokens(text)
    return docs.select("doc_id", *keep, F.explode(F.array(stems(t) if stemmed else t)).alias("t"))


BIGRAMS = "zip_with(slice(t, 1, greatest(size(t) - 1, 0)), slice(t, 2, greatest(size(t) - 1, 0)), (a, b) -> concat(a, ' ', b))"


def unigram_rows(arrays: DataFrame) -> DataFrame:
    return arrays.select("doc_id", F.posexplode("t").alias("pos", "term"))


def bigram_rows(arrays: DataFrame) -> DataFrame:
    """Adjacent kept tokens, at the position of the first."""
    return arrays.where("size(t) > 1").select("doc_id", F.posexplode(F.expr(BIGRAMS)).alias("pos", "term"))


def term_rows(arrays: DataFrame) -> DataFrame:
    """Tokens and bigrams with positions in one pass."""
    both = F.expr(f"concat(transform(t, (x, i) -> struct(i as pos, x as term)), transform({BIGRAMS}, (x, i) -> struct(i as pos, x as term)))")
    return arrays.select("doc_id", F.inline(both).alias("pos", "term"))


def hash64(term: str) -> Column:
    """First eight bytes of SHA-256 as a signed long."""
    return F.expr(f"cast(conv(substr(sha2({term}, 256), 1, 16), 16, -10) as bigint)")


def simhash(arrays: DataFrame) -> DataFrame:
    """doc_id, fp. Bit i is set if more term occurrences have bit i of their hash set than not. Two counters share a long,
    so 32 sums do; a document's rows lie in one task, so the shuffle gets a row per document and task. Without terms 0."""
    rows = term_rows(arrays).select("doc_id", hash64("term").alias("h"))
    lanes = [F.sum(F.expr(f"(shiftrightunsigned(h, {i}) & 1) + shiftleft(shiftrightunsigned(h, {i + 1}) & 1, 32)")).alias(f"s{i}") for i in range(0, 64, 2)]
    sums = rows.groupBy("doc_id").agg(F.count("*").alias("n"), *lanes)
    bits = [f"if(2 * (s{i} & 4294967295L) > n, shiftleft(1L, {i}), 0L) | if(2 * shiftrightunsigned(s{i}, 32) > n, shiftleft(1L, {i + 1}), 0L)" for i in range(0, 64, 2)]
    found = sums.select("doc_id", F.expr(" | ".join(bits)).alias("fp"))
    return arrays.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("fp", F.lit(0)).alias("fp"))
