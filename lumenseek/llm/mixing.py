"""Mixing sources to temperature weights, in DataFrame functions only.

A source with share p of all tokens gets weight p**t / sum(p**t): t = 1 leaves the shares as they are, t = 0 makes all
sources equal. t is found by bisection (each round tries a grid of exponents in one aggregation) to meet a target
entropy or a limit on repetition. Weights times the token budget say how often each source is read: whole epochs, and a
last one cut off at the budget. An epoch reads a source's blocks (4096 by hash) in an order that is permuted anew; the
cut falls inside one block, and only that block's rows are ever ordered among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenseek.llm.scratch import stored

#: Exponents tried at once, and rounds; each round divides the interval by POINTS.
POINTS, ROUNDS = 32, 5
#: Decimal places that the exponent is rounded to.
PLACES = 6
#: More sources than this are joined without broadcasting their plan.
BROADCAST_SOURCES = 100_000


def count_words(text: Column) -> Column:
    """Words of a text between spaces and ASCII control white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _exponent(sources: DataFrame, low: float, high: float, flat_enough: Column) -> float:
    """The largest exponent in [low, high] at which flat_enough (over aggregates h, spread, s, top) is true, which must
    hold below some exponent and fail above it; low if it never holds."""
    total = F.lit(float(sources.agg(F.sum("tokens")).first()[0]))
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
        tried = sources.select((F.col("tokens") / total).alias("p"), F.explode(F.array(*map(F.lit, grid))).alias("t"))
        tried = tried.groupBy("t").agg(F.sum(F.pow("p", "t")).alias("z"), F.sum(F.pow("p", "t") * F.log("p")).alias("zl"), F.max("p").alias("most"), F.min("p").alias("least"), F.count(F.lit(1)).alias("s"))
        tried = tried.withColumns({"h": F.log("z") - F.col("t") * F.col("zl") / F.col("z"), "spread": F.pow(F.col("most") / F.col("least"), 1 - F.col("t")), "top": F.pow(F.col("least"), F.col("t") - 1) / F.col("z")})
        rows = sorted((r.t, r.ok) for r in tried.select("t", flat_enough.alias("ok")).collect())  # POINTS + 1 rows
        good = [t for t, ok in rows if ok]
        if not good:
            return low
        low, high = max(good), min([t for t, ok in rows if t > max(good)], default=high)
    return low


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    tokens: Column | None = None,
    text_col: str = "text",
    entropy_share: float | None = None,
    max_repeats: float | None = None,
    budget: int | None = None,
    keep_all: bool = False,
    seed: str = "0",
) -> DataFrame:
    """docs as struct `row`, as often as the mixture reads them, with n_tokens long, epoch int (from 0), block string,
    block_order string (blocks of an epoch are read in its order) and place string (order within a block).

    Give one target. entropy_share: the largest exponent at which the weights' entropy is at least this part of
    log(number of sources). max_repeats: the smallest exponent at which no source is read more often than this (with
    keep_all: than this many times the least read). budget: tokens of the mixture, by default those of docs; with
    keep_all it is instead the least at which every document is read at least once.

    Sources without any token get the documents' single reading. A null source is a source; null ids and repeated rows
    are rows like others (rows with equal ids share their place). A null text has no tokens. Columns of any names may
    be there, for they stay inside `row`. An empty table gives an empty table.
    """
    if (entropy_share is None) == (max_repeats is None):
        raise ValueError("give entropy_share or max_repeats")
    tokens = count_words(F.col(text_col)) if tokens is None else tokens
    seed_col = F.lit(seed)
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(F.struct("*").alias("row"), source.alias("_source"), tokens.cast("long").alias("n_tokens"), F.md5(F.concat_ws("|", seed_col, F.col(id_col).cast("string"))).alias("place"))
    rows = rows.withColumn("block", F.substring("place", 1, 3))
    blocks = stored(rows.groupBy("_source", "block").agg(F.sum("n_tokens").alias("tokens")), "mixing-blocks")
    sources = blocks.groupBy("_source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    sources = stored(sources, "mixing-sources")
    if entropy_share is not None:
        t = _exponent(sources, 0.0, 1.0, F.col("h") >= F.lit(entropy_share) * F.log(F.col("s")) - 1e-12) if sources.head() else 1.0
    elif sources.head():
        # the other way round: what holds at large exponents is turned into what holds at small ones
        total = sources.agg(F.sum("tokens")).first()[0]
        factor = F.lit((budget or total) / total)
        limit = F.lit(float(max_repeats)) * (1 + 1e-12)
        over = F.col("spread") > limit if keep_all else F.col("top") * factor > limit
        t = _exponent(sources, 0.0, 1.0, over)
        t += 10.0**-PLACES if t else 0.0
    else:
        t = 1.0
    t = min(1.0, round(t, PLACES))

    total = F.lit(float(sources.agg(F.sum("tokens")).first()[0] or 0))
    plan = sources.withColumn("raw", F.pow(F.col("tokens") / total, F.lit(t)))
    norm = plan.agg(F.sum("raw").alias("z"), F.max(F.col("tokens") / F.col("raw")).alias("least_budget")).first()
    z, least_budget = (F.lit(float(x or 0)) for x in norm)
    reads = F.col("raw") * least_budget / F.col("tokens") if keep_all else F.col("raw") / z * (total if budget is None else F.lit(budget)) / F.col("tokens")
    plan = plan.select("_source", "tokens", (F.col("raw") / z).alias("weight"), F.greatest(reads, F.lit(1.0) if keep_all else F.lit(0.0)).alias("reads"))
    plan = plan.withColumn("epochs", F.floor(F.col("reads") + 1e-9).cast("int")).withColumn("rest", F.greatest(F.floor((F.col("reads") - F.col("epochs")) * F.col("tokens")), F.lit(0)).cast("long"))
    plan = stored(plan, "mixing-plan")

    # where the last epoch of each source is cut off: a block in permuted order, then a place in it
    order = F.md5(F.concat_ws("|", seed_col, F.col("epochs").cast("string"), F.col("_source"), F.col("block")))
    upto = F.sum("tokens").over(W.partitionBy("_source").orderBy("block_order", "block").rowsBetween(W.unboundedPreceding, 0))
    cut = blocks.join(plan.select("_source", "epochs", "rest"), "_source").withColumn("block_order", order).withColumn("upto", upto)
    cut = cut.where("upto > rest").groupBy("_source").agg(F.min(F.struct("block_order", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("cut")).select("_source", "cut.*")
    inside = rows.select("_source", "block", "place", "n_tokens").join(F.broadcast(cut) if _few(cut) else cut, ["_source", "block"])
    inside = inside.groupBy("_source", "place", "left").agg(F.sum("n_tokens").alias("n_tokens"))
    inside = inside.withColumn("upto", F.sum("n_tokens").over(W.partitionBy("_source").orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    places = inside.where("upto <= left").groupBy("_source").agg(F.max("place").alias("last_place"))
    cut = cut.select("_source", F.col("block_order").alias("last_order")).join(places, "_source", "left")
    plan = stored(plan.select("_source", "epochs").join(cut, "_source", "left"), "mixing-cuts")

    out = rows.join(F.broadcast(plan) if _few(plan) else plan, "_source", "left")
    epochs = F.coalesce("epochs", F.lit(1))
    last = F.md5(F.concat_ws("|", seed_col, epochs.cast("string"), F.col("_source"), F.col("block")))
    partial = (last < F.col("last_order")) | ((last == F.col("last_order")) & (F.col("place") <= F.col("last_place")))
    n = epochs + F.when(F.col("epochs").isNull(), 0).otherwise(F.coalesce(partial, F.lit(False)).cast("int"))
    out = out.withColumn("_n", n).where("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    order = F.md5(F.concat_ws("|", seed_col, F.col("epoch").cast("string"), F.col("_source"), F.col("block")))
    return out.select("row", "n_tokens", F.col("epoch").cast("int"), "block", order.alias("block_order"), "place")


def _few(sources: DataFrame) -> bool:
    return sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
