"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a share of a document (symbols, repeated lines, repeated words, capitals, exclamation marks) and rejects a
document whose share lies above a cutoff. Cutoffs are not set by hand: labelled documents of good quality are the
holdout, and within each stratum (language) a cutoff is admitted only if an exact binomial test rejects, at level
DELTA / (strata * rules), that it rejects more than ALPHA of the good documents. A rule's grid is tried from the most
lenient cutoff on and stops at the first that fails (a fixed sequence, which needs no further correction); Bonferroni
covers rules and strata. So with probability 1 - DELTA, no stratum loses more than RISK of its good documents to all rules
together, of which each may take its share ALPHA. Trials have to be independent, so labelled documents that agree in all
counts, as copies do, count as one. Where labels are too few for any bound, no cutoff is set and the rule rejects nothing
there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseek.llm.scratch import stored

#: The part of a stratum's good documents that all rules together may reject, and the error level of all bounds.
RISK, DELTA = 0.05, 0.05
#: Cutoffs of each rule, most lenient first.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.3, 0.2, 0.1, 0.05, 0.03),
    "dup_line_share": (0.9, 0.7, 0.5, 0.3, 0.2),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.2),
    "capital_share": (0.9, 0.8, 0.6, 0.4),
    "bang_share": (0.3, 0.2, 0.1, 0.05),
}
#: What one rule may reject of them: the rules' shares add up to RISK.
ALPHA = RISK / len(GRID)
#: More strata than this are joined without broadcasting their cutoffs.
BROADCAST_STRATA = 10_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SPACE = r"[\x20\x09-\x0D]"


def _repeat_words(words: str, keyed: str) -> list[tuple[str, str]]:
    """Steps (name, SQL) from columns `words` and sorted `keyed` to n_repeat_words. keyed holds, for each 3-word window,
    its hash moved up by _bits with its place in the low bits; windows whose hash parts agree are compared exactly."""
    same = "shiftright({0}, _bits) = shiftright({1}, _bits)"
    near = f"(k > 0 AND {same.format('x', f'{keyed}[k - 1]')}) OR (k + 1 < size({keyed}) AND {same.format('x', f'{keyed}[k + 1]')})"
    equal = "(x.a = _near[{0}].a AND x.b = _near[{0}].b AND x.c = _near[{0}].c)"
    return [
        ("_at", f"transform(filter({keyed}, (x, k) -> {near}), x -> CAST(x & (shiftleft(1L, _bits) - 1) AS INT))"),
        ("_near", f"sort_array(transform(_at, i -> named_struct('a', {words}[i], 'b', {words}[i + 1], 'c', {words}[i + 2], 'i', i)))"),
        ("_at", f"sort_array(transform(filter(_near, (x, k) -> (k > 0 AND {equal.format('k - 1')}) OR (k + 1 < size(_near) AND {equal.format('k + 1')})), x -> x.i))"),
        ("n_repeat_words", "CAST(aggregate(_at, named_struct('last', -3, 'n', 0L), (s, i) -> named_struct('last', i, 'n', s.n + least(3, i - s.last)), s -> s.n) AS BIGINT)"),
    ]


def with_text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs as one struct column `row`, beside n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_capitals and n_bangs (long) of the whole text; a null text has none of any."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"), text.alias("_text"))
    df = df.select("row", "_text", F.array_remove(F.split("_text", _SPACE + "+"), "").alias("_words"), F.expr(rf"filter(split(_text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')").alias("_lines"))
    df = df.select(
        "row",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_bangs"),
        F.expr("length(bin(size(_words)))").alias("_bits"),
    )
    df = df.withColumn(
        "_keyed",
        F.expr("CASE WHEN n_words < 3 THEN array() ELSE sort_array(transform(sequence(0, size(_words) - 3), i -> shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits) | CAST(i AS BIGINT))) END"),
    )
    for name, sql in _repeat_words("_words", "_keyed"):
        df = df.withColumn(name, F.expr(sql))
    return df.drop("_words", "_keyed", "_bits", "_at", "_near")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _shares() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "bang_share": share("n_bangs", "word_chars"),
    }


def _tail(n: str, k: str, alpha: float) -> str:
    """P(X <= k) for X binomial with n trials of alpha, term after term in logarithms; 1 where k is above the mean."""
    odds = alpha / (1 - alpha)
    step = f"s.lp + CASE WHEN j = 0 THEN 0D ELSE ln(({n} - j + 1) / CAST(j AS DOUBLE)) + ln({odds!r}D) END"
    return f"CASE WHEN {k} >= {alpha!r}D * {n} THEN 1D ELSE aggregate(sequence(0L, {k}), named_struct('lp', {n} * ln({1 - alpha!r}D), 'p', 0D), (s, j) -> named_struct('lp', {step}, 'p', s.p + exp({step})), s -> s.p) END"


def calibrate(stats: DataFrame, *, stratum: str, good: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cutoffs from labelled documents: stratum, and for each rule of GRID a double, null where no cutoff is safe.

    stats: the columns of with_text_stats(), a stratum column and a boolean column good; rows that fail the base rules
    must be left out. Rows of a null stratum form a stratum of their own."""
    shares = _shares()
    steps = [(r, i, c) for r, grid in GRID.items() for i, c in enumerate(grid)]
    counts = stored(stats.where(F.col(good)).groupBy(F.col(stratum).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum((shares[r] > F.lit(c)).cast("long")).alias(f"{r}_{i}") for r, i, c in steps),
    ), "holdout-counts")
    cells = ", ".join(f"named_struct('rule', '{r}', 'step', {i}, 'cutoff', {c!r}D, 'k', {r}_{i})" for r, i, c in steps)
    tested = counts.select("stratum", "n", F.expr(f"inline(array({cells}))"))
    level = delta / (len(GRID) * max(1, counts.count()))
    tested = tested.withColumn("safe", F.expr(f"{_tail('n', 'k', alpha)} <= {level!r}D"))
    # the lowest cutoff before the first step that fails
    first_bad = tested.groupBy("stratum", "rule").agg(
        F.coalesce(F.min(F.when(~F.col("safe"), F.col("step"))), F.lit(1 << 30)).alias("bad"),
        F.collect_list(F.struct("step", "cutoff")).alias("grid"),
    )
    best = F.expr("array_min(transform(filter(grid, x -> x.step < bad), x -> x.cutoff))")
    return first_bad.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, best)).alias(r) for r in GRID))


def with_verdict(stats: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """stats with base_failed and kept (boolean)."""
    cutoffs = cutoffs.select(F.col("stratum").alias("_stratum"), *(F.col(r).alias(f"_{r}") for r in GRID))
    cutoffs = stored(cutoffs, "cutoffs")
    small = cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    joined = stats.join(F.broadcast(cutoffs) if small else cutoffs, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    fired = F.lit(False)
    for rule, share in _shares().items():
        fired = fired | F.coalesce(share > F.col(f"_{rule}"), F.lit(False))
    joined = joined.withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & ~fired).drop("_stratum", *(f"_{r}" for r in GRID))


def judge_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", stats: DataFrame | None = None) -> DataFrame:
    """Every row of docs as struct `row`, with the columns of with_text_stats(), base_failed and kept.

    labels (id_col, label_col: 1 good) may miss documents, repeat them or hold nulls; a document with any label 1 and
    none of 0 is good. Nulls: a null text has no words, so it fails the base rules; a null stratum is a stratum; a null
    id is never labelled. Other columns, whatever their names, stay inside `row`. Empty tables give empty tables.
    stats: with_text_stats(docs) if it has been stored already.
    """
    # written, so that filters on the counts are not pushed into the long expressions that make them
    known = stored(with_text_stats(docs, text_col), "text-stats") if stats is None else stats
    good = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg((F.min(label_col) == 1).alias("_good")).where("_good")
    narrow = known.select(F.col(f"row.{id_col}").alias("_id"), F.col(f"row.{stratum_col}").cast("string").alias("_of"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_bangs")
    labelled = narrow.where(~base_failed()).join(good, F.col("_id") == F.col("_label_id")).withColumn("_good", F.lit(True))
    labelled = labelled.dropDuplicates([c for c in narrow.columns if c != "_id"])
    cutoffs = calibrate(labelled, stratum="_of", good="_good")
    return with_verdict(known.withColumn("_of", F.col(f"row.{stratum_col}").cast("string")), cutoffs, "_of").drop("_of")
