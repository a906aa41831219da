"""Snippets: the lines of a unit around the terms that matched. All of it is one expression per row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCKS = "array<struct<first: int, last: int, n_terms: int>>"
_WORDS = "array<string>"


def _with(value: Column, use) -> Column:
    """use(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def line_blocks(lines: Column, terms: Column, context: int = 3) -> Column:
    """array<struct<first, last, n_terms>> (lines from 1, in text order): runs of lines within context of a line that holds
    a term in any case; runs that overlap or touch are one. n_terms counts the distinct terms of a run."""
    found = F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.filter(terms, lambda t: F.contains(F.lower(line), F.lower(t))).alias("found")))
    hits = F.filter(found, lambda x: F.size(x.found) > 0)
    last_line = F.size(lines) - 1

    def closed(s: Column) -> Column:
        run = F.struct((F.greatest(s.a - context, F.lit(0)) + 1).alias("first"), (F.least(s.b + context, last_line) + 1).alias("last"), F.size(s.t).alias("n_terms"))
        return F.when(s.a >= 0, F.array_append(s.done, run)).otherwise(s.done)

    def state(done: Column, a: Column, b: Column, t: Column) -> Column:
        return F.struct(done.alias("done"), a.alias("a"), b.alias("b"), t.alias("t"))

    def step(s: Column, x: Column) -> Column:
        joins = (s.a >= 0) & (x.at - s.b <= 2 * context + 1)
        return F.when(joins, state(s.done, s.a, x.at, F.array_union(s.t, x.found))).otherwise(state(closed(s), x.at, x.at, F.array_distinct(x.found)))

    nothing = state(F.array().cast(_BLOCKS), F.lit(-1), F.lit(-1), F.array().cast(_WORDS))
    return F.aggregate(hits, nothing, step, closed)


def snippet_blocks(units: DataFrame, keys: list[str], *, text_col: str = "content", terms_col: str = "matched_terms", context: int = 3) -> DataFrame:
    """keys, block (number in the text), first and last (lines from 1), n_terms, density."""
    blocks = _with(F.split(text_col, "\n"), lambda lines: line_blocks(lines, F.col(terms_col), context))
    rows = units.select(*keys, F.posexplode(blocks).alias("block", "b")).select(*keys, "block", "b.*")
    return rows.withColumn("density", F.col("n_terms") / (F.col("last") - F.col("first") + 1).cast("double"))


def snippet(text: Column, terms: Column, *, context: int = 3, max_chars: int = 2000, max_blocks: int = 4) -> Column:
    """The blocks with most terms (then density, then the first), numbered, in text order, as many as fit into max_chars
    (the first always). Without a match: the first five lines as they are."""

    def body(lines: Column, b: Column) -> Column:
        return F.array_join(F.transform(F.slice(lines, b.first, b.last - b.first + 1), lambda x, i: F.concat((b.first + i).cast("string"), F.lit(": "), x)), "\n")

    def of(lines: Column) -> Column:
        ranked = F.transform(line_blocks(lines, terms, context), lambda b: F.struct((-b.n_terms).alias("n"), (-b.n_terms / (b.last - b.first + 1).cast("double")).alias("d"), b.first.alias("first"), b.last.alias("last")))
        best = F.slice(F.array_sort(ranked), 1, max_blocks)
        bodies = F.transform(F.array_sort(F.transform(best, lambda b: F.struct(b.first.alias("first"), b.last.alias("last")))), lambda b: body(lines, b))
        # a block that does not fit ends the snippet, also for shorter blocks after it: running totals only grow
        fits = F.aggregate(
            bodies,
            F.struct(F.array().cast(_WORDS).alias("out"), F.lit(0).alias("n"), F.lit(0).alias("at")),
            lambda s, x: F.struct(F.when((s.at == 0) | (s.n + F.length(x) <= max_chars), F.array_append(s.out, x)).otherwise(s.out).alias("out"), (s.n + F.length(x)).alias("n"), (s.at + 1).alias("at")),
            lambda s: s.out,
        )
        return _with(fits, lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, "\n...\n")).otherwise(F.array_join(F.slice(lines, 1, 5), "\n")))

    return _with(F.split(text, "\n"), of)


def snippets(units: DataFrame, keys: list[str], *, text_col: str = "content", terms_col: str = "matched_terms", context: int = 3, max_chars: int = 2000, max_blocks: int = 4) -> DataFrame:
    """keys, snippet of each unit; null where the text is."""
    return units.select(*keys, snippet(F.col(text_col), F.col(terms_col), context=context, max_chars=max_chars, max_blocks=max_blocks).alias("snippet"))
