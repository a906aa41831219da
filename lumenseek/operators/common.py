"""Small helpers of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Saturation of term frequencies and share of length normalisation in BM25.
K1, B = 1.2, 0.75
#: Rows up to which a side is broadcast.
SMALL_ROWS = 100_000
#: Terms at most that are sent to every task, the most frequent ones.
FREQUENT = 250_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; otherwise df, to be joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def most_frequent(counts: DataFrame, by: str = "df") -> tuple[DataFrame | None, DataFrame | None]:
    """counts (term, numbers) in two parts: the terms with the greatest `by`, FREQUENT at most, and the others; None for
    a part that has none. counts are read several times."""
    levels = counts.groupBy(F.floor(F.log2(F.greatest(F.col(by), F.lit(1)).cast("double"))).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = None, 0
    for level, n in sorted(((r.level, r.n) for r in levels), reverse=True):
        if held + n > FREQUENT:
            break
        least, held = level, held + n
    if held == sum(r.n for r in levels):
        return counts, None
    if least is None:
        return None, counts
    frequent = F.col(by) >= F.lit(2**least)
    return counts.where(frequent), counts.where(~frequent)


def with_counts(rows: DataFrame, counts: DataFrame, by: str = "df") -> DataFrame:
    """rows joined with counts (term, numbers) on term; counts are read several times. Most rows have a frequent term, so
    the terms with the greatest `by`, FREQUENT at most, are sent to every task, and only rows of the others are dealt by
    term: what is shuffled has no frequent terms, and those of a unit stay together."""
    frequent, others = most_frequent(counts, by)
    if others is None:
        return rows.join(F.broadcast(counts), "term")
    if frequent is None:
        return rows.join(counts, "term")
    rest = rows.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(others, "term")
    return rows.join(F.broadcast(frequent), "term").unionByName(rest)
