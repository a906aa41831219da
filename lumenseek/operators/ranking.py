"""BM25 and cosine ranking of units for one query or many.

All rankers share one plan: the query terms probe the postings by an equi-join on the term, scores are sums per query
and unit, and a total order (score, then keys) makes ranks reproducible.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lumenseek.functions.tokenize import identifier_tokens, idf_probabilistic, idf_smoothed, plain_tokens
from lumenseek.operators.common import B, K1, SMALL_ROWS, broadcast_if_small
from lumenseek.operators.inverted import counted, forward_rows, postings_of
from lumenseek.sources.store import scratch

#: Query terms up to which tokens are compared with all of them in place.
FEW_TERMS = 64
#: Pairs of a unit and a query, or a query's term, that are scored at once.
PAIRS = 2_000_000


@dataclass(frozen=True)
class Dialect:
    """Tokenizer, inverse document frequency, whether a repeated query term counts once, and the least average length."""

    name: str
    tokens: Callable[[Column], Column]
    idf: Callable[[Column, Column], Column]
    distinct_terms: bool
    least_avgdl: float


SYMBOL = Dialect("symbol", plain_tokens, idf_probabilistic, False, 1.0)
CHUNK = Dialect("chunk", identifier_tokens, idf_smoothed, True, 0.0)
FILE = Dialect("file", identifier_tokens, idf_smoothed, True, 0.0)
DIALECTS = {d.name: d for d in (SYMBOL, CHUNK, FILE)}


def with_tokens(units: DataFrame, dialect: Dialect, text: Column | str = "text") -> DataFrame:
    return units.withColumn("tokens", dialect.tokens(F.col(text) if isinstance(text, str) else text))


def query_rows(spark: SparkSession, queries: dict[str, str] | DataFrame, dialect: Dialect) -> DataFrame:
    """query_id, pos, term. queries: texts by id, or a DataFrame of query_id and text."""
    if isinstance(queries, dict):
        queries = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    terms = dialect.tokens(F.col("text"))
    terms = F.array_distinct(terms) if dialect.distinct_terms else terms
    return queries.select("query_id", F.posexplode(terms).alias("pos", "term"))


def scored_terms(units: DataFrame, keys: list[str], queries: DataFrame, dialect: Dialect) -> DataFrame:
    """query_id, pos, term, keys, tf (count), doc_len, df, idf, bm25: one row per query term that a unit has.

    Units are tokenised where they lie, by a job that runs at once; of up to FEW_TERMS terms it writes only their hits."""
    few = [r.term for r in queries.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:
        asked = F.array(*map(F.lit, few)).cast("array<string>")
        narrow = units.select(*keys, F.size("tokens").cast("long").alias("doc_len"), F.filter("tokens", lambda t: F.array_contains(asked, t)).alias("found"))
        times = lambda t: F.size(F.filter("found", lambda x: x == t)).cast("long")
        narrow = narrow.select(*keys, "doc_len", F.transform(F.array_distinct("found"), lambda t: F.struct(t.alias("term"), times(t).alias("raw_freq"))).alias("terms"))
    else:
        narrow = forward_rows(units, keys)
    # texts are tokenised once: a plan of lengths, frequencies and hits would tokenise them for each of these, and again in
    # filters that are pushed below the exchange that deals texts over all cores
    narrow = scratch(narrow, "hits")
    totals = narrow.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
    hits = postings_of(narrow, keys)
    if len(few) > FEW_TERMS:
        hits = hits.join(_sender(queries)(queries.select("term").distinct()), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return scored_postings(hits, df, totals, queries, dialect)


def _sender(queries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Terms and weights have no more rows than the queries, so one look at these bounds what is broadcast."""
    return F.broadcast if queries.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else lambda df: df


def scored_postings(hits: DataFrame, df: DataFrame, totals: DataFrame, queries: DataFrame, dialect: Dialect) -> DataFrame:
    """scored_terms() of postings (keys, term, raw_freq, doc_len), counts (term, df), and one row with the number of units
    and of their tokens (n, total_len), which an index has stored."""
    mean = F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(F.lit(0.0))
    mean = F.greatest(mean, F.lit(dialect.least_avgdl))
    totals = totals.select("n", F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias("avgdl"))
    weights = queries.join(df, "term").join(F.broadcast(totals)).withColumn("idf", dialect.idf(F.col("n"), F.col("df"))).drop("n")
    tf, dl = F.col("tf").cast("double"), F.col("doc_len").cast("double")
    part = F.col("idf") * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.col("avgdl")))
    return hits.withColumnRenamed("raw_freq", "tf").join(_sender(queries)(weights), "term").withColumn("bm25", part).drop("avgdl")


def rank(scored: DataFrame, keys: list[str], *, limit: int | None = 10, min_score: float | None = None, components: bool = False) -> DataFrame:
    """query_id, keys, score, matched_terms (in query order) and, with a limit, rank; with components, score_components per term."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "term", "tf", "df", "idf", "bm25")))
    # sums run over the sorted list, so they do not depend on the order of arrival
    out = scored.groupBy("query_id", *keys).agg(listed.alias("parts"))
    out = out.withColumn("score", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x.bm25))
    out = out.withColumn("matched_terms", F.array_distinct(F.transform("parts", lambda x: x.term)))
    if components:
        out = out.withColumn("score_components", F.transform("parts", lambda x: F.struct(x.term.alias("term"), x.tf.cast("double").alias("term_frequency"), x.df.cast("double").alias("document_frequency"), x.idf.alias("idf"), x.bm25.alias("bm25"))))
    out = out.where(F.col("score") > 0) if min_score is None else out.where(F.col("score") >= min_score)
    if limit is None:
        return out.drop("parts")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), *keys)
    return out.withColumn("rank", F.row_number().over(order)).drop("parts").where(F.col("rank") <= limit)


def search(units: DataFrame, keys: list[str], queries: dict[str, str] | DataFrame, dialect: Dialect = SYMBOL, **options) -> DataFrame:
    """Ranked units; units need `tokens` of the same dialect. Filter units by path before: the limit comes after."""
    rows = query_rows(units.sparkSession, queries, dialect)
    return rank(scored_terms(units, keys, rows, dialect), keys, **options)


def search_batch(units: DataFrame, keys: list[str], queries: DataFrame, dialect: Dialect = SYMBOL, limit: int = 10) -> DataFrame:
    """query_id, keys, score, rank of the best units of many queries (query_id, pos, term); scores that agree in nine
    places are ties, which go by keys.

    A unit is scored against all queries where it lies, and a task passes on only its best of each query. So what is
    shuffled grows with queries and tasks, not with pairs of units and queries, and no pair is left out. All queries are
    in every task; more than SMALL_ROWS terms of queries are ranked as rows of pairs."""
    if queries.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        return _nine(scored_pairs(scored_terms(units, keys, queries, dialect), keys), keys, limit)
    # one pass for statistics: beside its terms each unit counts once under null
    given = F.coalesce("tokens", F.array().cast("array<string>"))
    terms = F.explode(F.concat(F.array_distinct(given), F.array(F.lit(None).cast("string")))).alias("term")
    asked = queries.select("term", F.lit(True).alias("asked")).distinct()
    known = units.select(F.size(given).cast("long").alias("len"), terms).join(F.broadcast(asked), "term", "left")
    known = known.where("asked OR term IS NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("len"))
    known = known.collect()
    n, total = next(((r.df, r.len) for r in known if r.term is None), (0, 0))
    mean = max(total / n if n else 0.0, dialect.least_avgdl) or 1.0
    df = units.sparkSession.createDataFrame([(r.term, r.df) for r in known if r.term is not None], "term string, df long")
    weights = queries.join(F.broadcast(df), "term").select("query_id", "pos", "term", dialect.idf(F.lit(n), F.col("df")).alias("idf")).toArrow().combine_chunks()
    kept = units.select(*keys, "tokens")
    place = StructType([StructField("query", IntegerType()), *(f for f in kept.schema if f.name in keys), StructField("score", DoubleType())])
    best = kept.mapInArrow(lambda batches: _best_in_task(batches, weights, mean, limit), place)
    ids = weights.column("query_id").unique()
    named = StructType([StructField("query", IntegerType()), queries.schema["query_id"]])
    names = units.sparkSession.createDataFrame(list(enumerate(ids.to_pylist())), named)
    return _nine(best.join(F.broadcast(names), "query").select("query_id", *keys, "score"), keys, limit)


def scored_pairs(scored: DataFrame, keys: list[str]) -> DataFrame:
    """query_id, keys, score of scored_terms()."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "bm25")))
    return scored.groupBy("query_id", *keys).agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x.bm25).alias("score"))


def _nine(scored: DataFrame, keys: list[str], limit: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), *keys)
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _best_in_task(batches: Iterator[pa.RecordBatch], weights: pa.Table, mean: float, limit: int) -> Iterator[pa.RecordBatch]:
    """query (number of an id in weights), keys, score: the best of a task's units (keys, tokens). weights: query_id, pos,
    term, idf."""
    if not weights.num_rows:
        return
    rows = weights.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    n_queries = len(rows.dictionary)
    coded = weights.column("term").combine_chunks().dictionary_encode()
    term, pos = coded.indices.to_numpy(), weights.column("pos").to_numpy()
    order = np.lexsort((pos, term))
    query, pos, idf = rows.indices.to_numpy()[order].astype(np.int64), pos[order], weights.column("idf").to_numpy()[order]
    begin = np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1))
    step = max(1, PAIRS // max(n_queries, weights.num_rows))
    best, beat = None, np.zeros(n_queries)
    for whole in counted(batches):
        for at in range(0, len(whole), step):
            batch = whole.slice(at, step)
            *keys, lengths, terms = batch.columns
            flat = terms.flatten()
            unit = np.repeat(np.arange(len(batch)), pc.list_value_length(terms).to_numpy())
            found = pc.index_in(flat.field("term"), value_set=coded.dictionary)
            hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
            unit, found, tf = unit[hit], found.drop_null().to_numpy(), flat.field("raw_freq").to_numpy()[hit].astype(np.float64)
            # a row per term of a unit and query that asks for it, in the order of queries' terms: so sums repeat
            times = begin[found + 1] - begin[found]
            which = np.repeat(begin[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
            unit, tf = np.repeat(unit, times), np.repeat(tf, times)
            length = lengths.to_numpy()[unit]
            part = idf[which] * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / mean))
            by = np.argsort(pos[which], kind="stable")
            score = np.bincount((unit * n_queries + query[which])[by], weights=part[by], minlength=len(batch) * n_queries).reshape(len(batch), n_queries)
            place = np.round(score, 9)
            i, j = np.nonzero((score > 0) & (place >= beat[None]))
            if not len(i):
                continue
            names = [str(k) for k in range(len(keys))]
            new = pa.table([pa.array(j.astype(np.int32)), *(c.take(pa.array(i)) for c in keys), pa.array(score[i, j]), pa.array(place[i, j])], ["query", *names, "score", "place"])
            best = pa.concat_tables([best, new]) if best is not None else new
            best = best.take(pc.sort_indices(best, [("query", "ascending"), ("place", "descending"), *((k, "ascending") for k in names)], null_placement="at_start")).combine_chunks()
            of = best.column("query").to_numpy()
            nth = np.arange(len(of)) - np.searchsorted(of, of)
            beat[of[nth == limit - 1]] = best.column("place").to_numpy()[nth == limit - 1]
            best = best.filter(pa.array(nth < limit)).combine_chunks()
    if best is not None:
        out = best.drop_columns(["place"]).rename_columns(["query", *whole.schema.names[:-2], "score"])
        yield from out.to_batches()


def candidates_of(posting_rows: DataFrame, keys: list[str], terms: list[str], limit: int = 100) -> DataFrame:
    """candidates() from postings, with the terms that matched, in the order of terms."""
    place = F.array_position(F.array(*map(F.lit, terms)), F.col("term"))
    hits = posting_rows.where(F.col("term").isin(terms)).groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(place.alias("at"), "term"))).alias("m"))
    hits = hits.select(*keys, F.size("m").cast("long").alias("matches"), F.transform("m", lambda x: x.term).alias("matched_terms"))
    return hits.orderBy(F.col("matches").desc(), *keys).limit(limit)


def rank_candidates(found: DataFrame, keys: list[str], terms: list[str], idf: DataFrame, *, limit: int = 10, min_score: float = 0.0, avgdl: float | None = None) -> DataFrame:
    """keys, score, matched_terms, rank of candidates (keys, token_count, weights: array of term, raw_freq and more) by
    BM25, from what stands beside them and idf (term, idf) alone: a term without one counts 0, a missing or zero length
    counts 1, and without avgdl the mean length of the candidates stands in."""
    place = F.array_position(F.array(*map(F.lit, dict.fromkeys(terms))), F.col("term"))
    mean = found.agg(F.greatest(F.coalesce(F.avg(F.coalesce("token_count", F.lit(0)).cast("double")), F.lit(1.0)), F.lit(1.0)).alias("_mean"))
    mean = found.sparkSession.range(1).select(F.lit(max(float(avgdl), 1.0)).alias("_mean")) if avgdl else mean
    rows = found.select(*keys, F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(1).alias("_dl"), F.inline("weights")).where(F.col("term").isin(terms))
    rows = rows.join(broadcast_if_small(idf.select("term", "idf")), "term", "left").join(F.broadcast(mean))
    tf, dl = F.col("raw_freq").cast("double"), F.col("_dl").cast("double")
    part = F.coalesce("idf", F.lit(0.0)) * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.col("_mean")))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(place.alias("pos"), part.alias("part"), "term"))).alias("_parts"))
    scored = listed.select(*keys, F.aggregate("_parts", F.lit(0.0), lambda x, y: x + y.part).alias("score"), F.transform("_parts", lambda x: x.term).alias("matched_terms")).where(F.col("score") >= min_score)
    best = scored.orderBy(F.desc("score"), *keys).limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), *keys)))


def candidates(units: DataFrame, keys: list[str], terms: list[str], limit: int = 100) -> DataFrame:
    """Units with most distinct query terms: keys, matches. A lossy preselection, for callers that ask for it."""
    hits = units.select(*keys, F.size(F.array_intersect("tokens", F.array(*map(F.lit, terms)))).cast("long").alias("matches")).where("matches > 0")
    return hits.orderBy(F.col("matches").desc(), *keys).limit(limit)


def sparse_cosine(weighted: DataFrame, keys: list[str], query: str, dialect: Dialect = FILE) -> DataFrame:
    """keys, score: cosine of the query's idf vector and units' tf-idf vectors (rows of statistics.tfidf())."""
    spark = weighted.sparkSession
    terms = query_rows(spark, {"q": query}, dialect).select("term").distinct()
    known = {r.term: r.idf for r in weighted.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.first("idf").alias("idf")).where("idf > 0").collect()}
    length = math.sqrt(sum(x * x for x in known.values()))
    asked = spark.createDataFrame(list(known.items()), "term string, _asked double")
    # lengths and products are sums of one pass over the weights
    rows = weighted.join(F.broadcast(asked), "term", "left").groupBy(*keys)
    sums = rows.agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("m"), F.sum(F.col("tfidf") * F.col("_asked")).alias("d"))
    return sums.where("m > 0 AND d IS NOT NULL").select(*keys, (F.col("d") / (F.col("m") * F.lit(length))).alias("score"))
