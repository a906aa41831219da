"""Blending of lexical and vector results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenseek.functions.paths import result_key

#: Below this a maximum does not scale scores.
LEAST_MAX = 0.01


def merge_hybrid(vector: DataFrame, lexical: DataFrame, weight: float = 0.7, *, key: str = "key", by: list[str] | None = None, min_score: float = 0.0, limit: int | None = None) -> DataFrame:
    """key, score, vector_score, lexical_score, method: full outer join of two result lists (key, score), each scaled by
    its maximum, weighted and added. by: columns of the query, if the lists hold several."""
    by = by or []
    scaled = []
    for name, df in (("vector_score", vector), ("lexical_score", lexical)):
        # one row per query beside the list, not a window over the whole list
        most = df.groupBy(*by).agg(F.greatest(F.max("score"), F.lit(LEAST_MAX)).alias("_most"))
        joined = df.join(most, by) if by else df.join(F.broadcast(most))
        scaled.append(joined.select(*by, key, (F.col("score") / F.col("_most")).alias(name)))
    both = scaled[0].join(scaled[1], [*by, key], "full_outer")
    v, x = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("lexical_score", F.lit(0.0))
    method = F.when(F.col("vector_score").isNull(), "lexical").when(F.col("lexical_score").isNull(), "vector").otherwise("hybrid")
    out = both.select(*by, key, (v * F.lit(weight) + x * F.lit(1.0 - weight)).alias("score"), v.alias("vector_score"), x.alias("lexical_score"), method.alias("method")).where(F.col("score") >= min_score)
    if limit is None:
        return out
    return out.orderBy(F.col("score").desc(), key).limit(limit) if not by else out.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc(), key))).where(F.col("_r") <= limit).drop("_r")


def merge_coordinated(lexical: DataFrame, semantic: DataFrame, limit: int | None = 10) -> DataFrame:
    """path, start_line, end_line, score, matched_terms: both lists joined on path and lines; 0.7 of the semantic and 0.3
    of the lexical score where both have a result, 0.85 of a semantic and 0.35 of a lexical one alone; semantic terms
    come first."""
    columns = ["path", "start_line", "end_line", "score", "matched_terms"]
    key = result_key(F.col("path"), F.col("start_line"), F.col("end_line"))
    s, x = (df.select(key.alias("_key"), *(F.col(c).alias(f"{p}_{c}") for c in columns)) for p, df in (("s", semantic), ("x", lexical)))
    both = s.join(x, "_key", "full_outer")
    score = F.when(F.col("s_score").isNotNull() & F.col("x_score").isNotNull(), 0.7 * F.col("s_score") + 0.3 * F.col("x_score")).otherwise(F.coalesce(0.85 * F.col("s_score"), 0.35 * F.col("x_score")))
    empty = F.array().cast("array<string>")
    terms = F.array_union(F.coalesce("s_matched_terms", empty), F.coalesce("x_matched_terms", empty))
    out = both.select(*(F.coalesce(f"s_{c}", f"x_{c}").alias(c) for c in columns[:3]), score.alias("score"), terms.alias("matched_terms"))
    return out if limit is None else out.orderBy(F.col("score").desc(), "path", "start_line").limit(limit)
