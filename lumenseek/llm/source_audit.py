"""How the sources of a language diverge in their words: total differences of smoothed shares, and the terms behind them.

Plain relational: terms are exploded and counted by language, source and term before anything is shuffled; groups are
joined with the kept vocabulary of their language, so that a term a source never uses has a count of 0; that table joined
with itself on language and term gives the differences of all pairs of sources, added up where they arise; windows rank.

A language may hold most rows, so joins on it alone carry a salt of the term beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenseek.llm.scratch import stored

#: What stands between terms, which are the longest runs of letters A-Z and of everything beyond ASCII. Splitting there
#: gives the matches of such runs in time that grows with the text; the built-in that extracts all matches copies the text
#: for each of them.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are whole parts of SCALE = STEP * STEP2; counts are smoothed by ADD.
STEP, STEP2, ADD = 100_000, 10_000, 5
SALTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows of docs that have the term)."""
    found = F.sort_array(F.split(F.translate(text, _UPPER, _LOWER), BETWEEN))
    listed = docs.select("lang", "source", found.alias("terms"))
    # beside each term the one before it, so that the first of equal terms counts its row
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("terms"))
    each = listed.select("lang", "source", F.inline(F.arrays_zip(F.col("terms").alias("term"), before.alias("before"))).alias("term", "before"))
    first = (~F.col("term").eqNullSafe(F.col("before"))).cast("long")
    return each.where("term <> ''").groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADD) / (total + ADD * terms)) in whole numbers, divided in two steps so that a long is
    wide enough for totals up to 9 * 10**13."""
    whole = (total + ADD * terms).cast("long")
    high = (count + ADD).cast("long") * F.lit(STEP)
    return F.call_function("div", high, whole) * F.lit(STEP2) + F.call_function("div", (high % whole) * F.lit(STEP2), whole) + F.lit(1)


def divergence_audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item string, value long, rank int.

    Part `pair`: item is each other source of the language, value the sum over its kept terms (those in at least min_docs
    rows of it) of the absolute differences of both sources' shares. Part `term`: the `top` kept terms that the source
    uses by more than the language as a whole, value by how much. Ranks start at 1 per language, source and part; higher
    values first, equal ones by item as UTF-8.

    Null texts, languages and sources count as ''. A source without any term still has its pairs, with value 0 where its
    language keeps no term. Repeated rows count as often as they occur. Other columns of docs, an id included, are not
    read. An empty table gives an empty table.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    groups = stored(rows.select("lang", "source").distinct(), "audit-groups")
    counts = stored(term_counts(rows), "audit-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    vocabulary = stored(vocabulary.select("lang", "term", "lang_n"), "audit-vocabulary")
    kept = stored(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "audit-kept")
    of_lang = vocabulary.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(of_lang, "lang").join(of_group, ["lang", "source"], "left").na.fill(0, ["total"])
    return _pairs(groups, totals, vocabulary, kept).unionByName(_terms(totals, kept, top))


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _to_all_salts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _pairs(groups: DataFrame, totals: DataFrame, vocabulary: DataFrame, kept: DataFrame) -> DataFrame:
    every = _to_all_salts(totals).join(_salted(vocabulary.select("lang", "term"), "term"), ["lang", "salt"])
    dense = every.join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    p = share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("terms"))
    dense = stored(dense.select("lang", "term", "source", p.alias("p")), "audit-shares")
    one, other = (dense.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("a", "p"), ("b", "q")))
    apart = one.join(other, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    one = _salted(groups.withColumnRenamed("source", "a"), "a")
    both = one.join(_to_all_salts(groups.withColumnRenamed("source", "b")), ["lang", "salt"]).where("a < b").drop("salt")
    both = both.join(apart, ["lang", "a", "b"], "left").na.fill(0, ["value"])
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    listed = both.select("lang", F.inline(ways), "value")
    return listed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", _rank().alias("rank"))


def _terms(totals: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    more = kept.join(totals, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    ranked = more.withColumn("rank", _rank()).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _rank() -> Column:
    return F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
