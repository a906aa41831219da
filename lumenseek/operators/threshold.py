"""Exact best units of a query from blocks of postings, leaving out blocks that cannot hold one.

Scores are sums over terms, and a block says how much at most any of its postings adds. The first blocks of each term hold
its best postings; the limit-th best of the sums found there is a score to beat. A block is left out if even with the
most that all other terms can add its units stay below. Terms that together stay below it are optional: units are found
by the other terms, and only for those still in reach what they say of optional terms is read from their own rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.operators.common import K1
from lumenseek.operators.inverted import BLOCK, impact, postings_of
from lumenseek.operators.ranking import Dialect

if TYPE_CHECKING:
    from lumenseek.sources.store import Store

KEYS = ["path", "start_line", "end_line"]
#: Units up to which optional terms are looked up in rows of their own; for more their blocks are read.
LOOKED_UP = 500
#: Sums of the same parts in another order may differ by this.
ROUNDING = 1e-9


class Query:
    """Terms of a text in a dialect, in order."""

    def __init__(self, spark: SparkSession, text: str, dialect: Dialect):
        # an expression over one literal row is evaluated while it is planned: no job runs
        terms = spark.sql("VALUES (0)").select(dialect.tokens(F.lit(text))).first()[0]
        self.spark, self.dialect = spark, dialect
        self.terms: list[str] = list(dict.fromkeys(terms)) if dialect.distinct_terms else terms
        self.times = Counter(self.terms)


def _idfs(n: int, df: dict[str, int], query: Query) -> dict[str, float]:
    values = [query.dialect.idf(F.lit(n), F.lit(x)).alias(f"t{i}") for i, x in enumerate(df.values())]
    return dict(zip(df, map(float, query.spark.sql("VALUES (0)").select(*values).first()), strict=True))


def _by_term(values: dict[str, float]) -> Column:
    """The value of column term."""
    out = F.lit(None).cast("double")
    for term, x in values.items():
        out = F.when(F.col("term") == term, F.lit(x)).otherwise(out)
    return out


def best_units(store: Store, query: Query, limit: int, min_score: float | None, where: Column | None, state: dict, seen: dict | None = None) -> list[dict]:
    """path, start_line, end_line, score, matched_terms, score_components, rank of the best `limit` units (score, then
    place) among those with where (a condition on path) and at least min_score, by default above 0."""
    n, total = state["metadata"].get("n_chunks", 0), state["metadata"].get("total_len", 0)
    asked = list(query.times)
    if not asked or not n or limit < 1:
        return []
    mean = max(total / n, query.dialect.least_avgdl) or 1.0
    # the bound of a block holds at the mean length of its index; at a greater one impacts grow by no more than this
    grown = max(1.0, mean / state["metadata"].get("mean_len", mean))
    df, tops = _known(store, asked, state)
    asked = [t for t in asked if df.get(t)]
    if not asked:
        return []
    idf = _idfs(n, {t: df[t] for t in asked}, query)
    weight = {t: query.times[t] * idf[t] * (K1 + 1) for t in asked}
    most = {t: weight[t] * min(1.0, grown * tops.get(t, 1.0)) for t in asked}
    part = _by_term(weight) * impact(F.col("raw_freq"), F.col("doc_len"), F.lit(mean))

    def sums(postings: DataFrame) -> DataFrame:
        return postings.groupBy(*KEYS).agg(F.sum(part).alias("part"))

    first = F.col("term").isin(asked) & (F.col("block") < math.ceil(limit / BLOCK))
    best = sums(store.postings(first, state, where)).orderBy(F.desc("part")).limit(limit).agg(F.count(F.lit(1)), F.min("part")).first()
    beat = max(best[1] if best[0] == limit else 0.0, min_score or 0.0) - ROUNDING
    order = sorted(asked, key=lambda t: most[t])
    optional, held = [], 0.0
    for t in order[:-1]:
        if held + most[t] >= beat:
            break
        optional.append(t)
        held += most[t]
    needed = [t for t in order if t not in optional]
    every = sum(most.values())
    reach = F.lit(False)
    for t in needed:
        least = (beat - (every - most[t])) / (weight[t] * grown)
        reach = reach | ((F.col("term") == t) & (F.col("bound") >= least) if least > 0 else F.col("term") == t)
    if seen is not None:
        seen |= _counted(store, asked, reach, state)
    hits = store.postings(reach, state, where)
    if optional:
        some = sums(hits).where(F.col("part") >= beat - held).select(*KEYS)
        found = some.limit(LOOKED_UP + 1).collect()
        if len(found) <= LOOKED_UP:
            paths = sorted({r.path for r in found})
            rows = store.read("forward", F.col("path").isin(paths) if paths else F.lit(False), state)
            only = query.spark.createDataFrame(found, some.schema)
            hits = postings_of(rows.join(F.broadcast(only), KEYS, "left_semi"), KEYS).where(F.col("term").isin(asked))
        else:
            hits = store.postings(F.col("term").isin(asked), state, where).join(some, KEYS, "left_semi")
    return _scored(hits, [t for t in query.terms if t in idf], idf, df, mean, limit, min_score)


def _scored(hits: DataFrame, terms: list[str], idf: dict[str, float], df: dict[str, int], mean: float, limit: int, min_score: float | None) -> list[dict]:
    """The best units of hits. A unit's row has a column per distinct term; parts are added in the order of the query, so
    scores do not depend on the order of arrival."""
    name = {t: f"tf{i}" for i, t in enumerate(dict.fromkeys(terms))}
    rows = hits.groupBy(*KEYS).agg(F.max("doc_len").alias("doc_len"), *(F.max(F.when(F.col("term") == t, F.col("raw_freq"))).alias(c) for t, c in name.items()))
    part = {t: F.coalesce(F.lit(idf[t]) * F.lit(K1 + 1) * impact(F.col(c), F.col("doc_len"), F.lit(mean)), F.lit(0.0)) for t, c in name.items()}
    rows = rows.withColumns({f"p{i}": x for i, x in enumerate(part.values())})
    at = {t: f"p{i}" for i, t in enumerate(part)}
    rows = rows.withColumn("score", reduce(lambda x, y: x + y, (F.col(at[t]) for t in terms)))
    rows = rows.where(F.col("score") > 0) if min_score is None else rows.where(F.col("score") >= min_score)
    out = []
    for i, r in enumerate(rows.orderBy(F.desc("score"), *KEYS).limit(limit).collect()):
        found = [t for t in terms if r[name[t]]]
        parts = [{"term": t, "term_frequency": float(r[name[t]]), "document_frequency": float(df[t]), "idf": idf[t], "bm25": r[at[t]]} for t in found]
        out.append({**{c: r[c] for c in KEYS}, "score": r.score, "matched_terms": list(dict.fromkeys(found)), "score_components": parts, "rank": i + 1})
    return out


def _known(store: Store, terms: list[str], state: dict) -> tuple[dict[str, int], dict[str, float]]:
    """Document frequencies of terms, and the greatest bound of their blocks, in one job."""
    df = store.terms(terms, state).select("term", "df", F.lit(0.0).alias("bound"))
    bounds = store.read("blocks", F.col("term").isin(terms) & (F.col("block") == 0), state).select("term", F.lit(0).cast("long").alias("df"), "bound")
    rows = df.unionByName(bounds).groupBy("term").agg(F.sum("df").alias("df"), F.max("bound").alias("bound")).collect()
    return {r.term: r.df for r in rows}, {r.term: r.bound for r in rows}


def _counted(store: Store, terms: list[str], reach: Column, state: dict) -> dict:
    row = store.read("blocks", F.col("term").isin(terms), state).agg(F.count(F.lit(1)).alias("blocks"), F.count_if(reach).alias("read"), F.sum("n").alias("postings"), F.sum(F.when(reach, F.col("n")).otherwise(0)).alias("postings_read")).first()
    return row.asDict()
