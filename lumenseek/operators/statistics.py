"""Postings and term, unit and corpus statistics of an inverted index.

A unit is what is ranked: a file, a chunk or a row of a table, named by key columns. Inputs have the key columns and
`tokens` (array of strings). Inverse document frequencies are computed from counts when they are used, so they are never
stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseek.functions.tokenize import idf_smoothed
from lumenseek.operators.common import with_counts
from lumenseek.operators.inverted import forward_rows, postings_of
from lumenseek.sources.store import scratch


def postings(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, raw_freq long, doc_len long: one row per unit and distinct term. Units without tokens have none. A unit
    is one row, so its terms are counted where it lies and nothing is shuffled."""
    return postings_of(forward_rows(units, keys), keys)


def term_frequencies(units: DataFrame, keys: list[str]) -> DataFrame:
    return _with_tf(postings(units, keys))


def _with_tf(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.withColumn("tf", F.col("raw_freq") / F.col("doc_len").cast("double"))


def document_frequencies(posting_rows: DataFrame) -> DataFrame:
    """term, df: postings are unique per unit and term, so a count is enough."""
    return posting_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def frequencies(units: DataFrame) -> DataFrame:
    """document_frequencies() of units themselves: each counts a term once, and counts are added up before they move."""
    return units.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_statistics(units: DataFrame) -> DataFrame:
    """n (all units, those without tokens too) and avgdl, in one row."""
    return units.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("tokens").cast("double")), F.lit(0.0)).alias("avgdl"))


def tfidf(units: DataFrame, keys: list[str]) -> DataFrame:
    """term_frequencies() with df, idf and tfidf. Units are tokenised once, by a job that runs at once: their terms and
    the terms' counts are written to a scratch folder and read from there."""
    forward = scratch(forward_rows(units, keys), "forward")
    counts = scratch(document_frequencies(forward.select(F.explode("terms.term").alias("term"))), "terms")
    rows = with_counts(_with_tf(postings_of(forward, keys)), counts)
    return rows.withColumn("idf", idf_smoothed(F.lit(forward.count()), F.col("df"))).withColumn("tfidf", F.col("tf") * F.col("idf"))


def magnitudes(units: DataFrame, weighted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, magnitude for every unit: the length of its tf-idf vector, 0 where it has no terms."""
    sums = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("magnitude"))
    return units.select(*keys).join(sums, keys, "left").withColumn("magnitude", F.coalesce("magnitude", F.lit(0.0)))


def document_vectors(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, terms map (term to tf-idf) and raw_terms map (term to count): the edge of the API, not a way to store."""
    entries = F.sort_array(F.collect_list(F.struct("term", "tfidf", "raw_freq")))
    rows = weighted.groupBy(*keys).agg(entries.alias("e"))
    return rows.select(
        *keys,
        F.map_from_entries(F.transform("e", lambda x: F.struct(x.term, x.tfidf))).alias("terms"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x.term, x.raw_freq))).alias("raw_terms"),
    )
