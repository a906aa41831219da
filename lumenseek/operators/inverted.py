"""An index in two layouts, and the weights it implies.

The forward index has a row per unit with its terms and their counts, in the order of units: what a changed unit said is
read from its own row. The inverted index has the same counts by term, in blocks of at most BLOCK postings. A build packs
the postings of PACK units after PACK units where these lie, so no posting is shuffled or sorted on disk; in a pack, a
term's postings lie in blocks by falling impact, so a block's first posting bounds what any of it can add to a score, and
a search that knows a score to beat leaves out whole blocks. Compaction merges the packs of a term.

Weights depend on the number of units and on document frequencies, which change with every update. So the index keeps what
does not: with l = ln(df + 1) of each term, a weight is tf * (L - l) for L = ln(n + 1) + 1, and a unit's squared length is
L * L * s0 - 2 * L * s1 + s2 with s0, s1 and s2 the sums of tf * tf times 1, l and l * l. An update adds differences for
the units that hold a term whose df has changed, and all lengths are those of a full build.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenseek.operators.common import B, K1, most_frequent, with_counts

#: Postings of a block.
BLOCK = 128
#: Postings of a pack.
PACK = 1_000_000
#: Tokens that are counted at once.
SLICE = 250_000


def impact(raw_freq: Column, doc_len: Column, mean: Column | float) -> Column:
    """What a posting adds to a BM25 score, but for its term's weight: between 0 and 1, less for longer units."""
    tf, length = raw_freq.cast("double"), doc_len.cast("double")
    return tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / mean))


def forward_rows(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, doc_len long, terms array<struct<term string, raw_freq long>> in the order of terms, for units with `tokens`.
    Rows stay in their order and partition. Null tokens are none."""
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.select(*keys).schema)
    return units.select(*keys, "tokens").mapInArrow(counted, f"{given}, doc_len long, terms array<struct<term: string, raw_freq: bigint>>")


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is a list in slices of at most `size` of its items or one row, so that what is held at
    once stays small however many rows a batch has."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.columns[-1]), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """forward_rows() of batches (keys, tokens) within a task."""
    for batch in _slices(batches, SLICE):
        *keys, tokens = batch.columns
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = max(1, len(order))
        pairs = np.repeat(np.arange(len(batch)), sizes) * width + place[coded.indices.to_numpy()]
        pairs, counts = np.unique(pairs, return_counts=True)
        terms = coded.dictionary.take(pa.array(order)).take(pa.array(pairs % width))
        listed = pa.StructArray.from_arrays([terms.cast(pa.string()), pa.array(counts.astype(np.int64))], ["term", "raw_freq"])
        bounds = np.searchsorted(pairs // width, np.arange(len(batch) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds), listed)], [*batch.schema.names[:-1], "doc_len", "terms"])


def postings_of(forward: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, raw_freq, doc_len of forward_rows()."""
    return forward.select(*keys, "doc_len", F.inline("terms"))


def blocks_of(postings: DataFrame, keys: list[str], mean: float) -> DataFrame:
    """term, block int, n int, bound double, docs array<struct<keys, raw_freq, doc_len>>, by term and falling impact at
    that mean length. Blocks are numbered from 0 per term and partition; a range of terms and impacts is a partition, so a
    frequent term spreads over several."""
    by = ["term", F.desc("impact"), *keys]
    rows = postings.withColumn("impact", impact(F.col("raw_freq"), F.col("doc_len"), F.lit(mean))).repartitionByRange(*by).sortWithinPartitions(*by)
    given = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in postings.select(*keys).schema)
    size = BLOCK
    schema = f"term string, block int, n int, bound double, docs array<struct<{given}, raw_freq: bigint, doc_len: bigint>>"
    return rows.select("term", "impact", *keys, "raw_freq", "doc_len").mapInArrow(lambda batches: _packed(batches, size), schema)


def packs_of(forward: DataFrame, keys: list[str], mean: float) -> DataFrame:
    """blocks_of() of forward_rows(), for each pack of units by itself: blocks are numbered from 0 per term and pack."""
    given = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in forward.select(*keys).schema)
    size, pack = BLOCK, PACK
    schema = f"term string, block int, n int, bound double, docs array<struct<{given}, raw_freq: bigint, doc_len: bigint>>"
    return forward.select(*keys, "doc_len", "terms").mapInArrow(lambda batches: _packs(batches, size, pack, mean), schema)


def _packs(batches: Iterator[pa.RecordBatch], size: int, pack: int, mean: float) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, pack):
        *keys, lengths, terms = batch.columns
        flat = terms.flatten()
        unit = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
        coded = flat.field("term").dictionary_encode()
        by_term = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(by_term), np.int64)
        place[by_term] = np.arange(len(by_term))
        tf, length = flat.field("raw_freq").to_numpy(), lengths.to_numpy()[unit]
        impacts = tf.astype(np.float64) / (tf + K1 * ((1 - B) + B * length / mean))
        # equal impacts stay in the order of units, which is that of keys
        order = np.lexsort((-impacts, place[coded.indices.to_numpy()]))
        at = pa.array(unit[order])
        posted = [flat.field("term").take(pa.array(order)), pa.array(impacts[order]), *(k.take(at) for k in keys), pa.array(tf[order]), lengths.take(at)]
        yield from _packed(iter([pa.RecordBatch.from_arrays(posted, ["term", "impact", *batch.schema.names[:-2], "raw_freq", "doc_len"])]), size)


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    last, at = None, 0  # the term of the posting before, and its number among that term's blocks
    for batch in batches:
        if not len(batch):
            continue
        terms = batch.column(0)
        code = terms.dictionary_encode().indices.to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        run = np.diff(np.append(begin, len(batch)))
        place = np.arange(len(batch)) - np.repeat(begin, run)
        first = np.flatnonzero(place % size == 0)
        number = place[first] // size
        if terms[0].as_py() == last:
            number[: -(-int(run[0]) // size)] += at
        last, at = terms[-1].as_py(), int(number[-1]) + 1
        bounds = np.append(first, len(batch)).astype(np.int32)
        docs = pa.StructArray.from_arrays(batch.columns[2:], batch.schema.names[2:])
        yield pa.RecordBatch.from_arrays(
            [terms.take(pa.array(first)), pa.array(number.astype(np.int32)), pa.array(np.diff(bounds)), batch.column(1).take(pa.array(first)), pa.ListArray.from_arrays(pa.array(bounds), docs)],
            ["term", "block", "n", "bound", "docs"],
        )


def frequencies(blocks: DataFrame) -> DataFrame:
    """term, df."""
    return blocks.groupBy("term").agg(F.sum("n").cast("long").alias("df"))


def _log(df: Column) -> Column:
    return F.log1p(df.cast("double"))


def _tf() -> Column:
    return F.col("raw_freq") / F.col("doc_len").cast("double")


def norm_rows(forward: DataFrame, df: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keys, s0, s1, s2 of units with a term of df (term, df). forward: forward_rows(); keep writes rows and reads them
    back. df is read several times."""
    log = _log(F.col("df"))
    return _unit_sums(forward, df.select("term", "df", F.lit(1.0).alias("l0"), log.alias("l1"), (log * log).alias("l2")), keys, keep)


def norm_changes(forward: DataFrame, moved: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keys, s0, s1, s2 to add for units that hold a term of moved (term, df, df_new), as norm_rows()."""
    return _unit_sums(forward, _moves(moved), keys, keep)


def posting_changes(postings: DataFrame, moved: DataFrame, keys: list[str]) -> DataFrame:
    """norm_changes() of postings."""
    rows = with_counts(postings.withColumn("square", _tf() * _tf()), _moves(moved))
    return rows.groupBy(*keys).agg(*(F.sum(x).alias(f"s{i}") for i, x in enumerate(_products())))


def _moves(moved: DataFrame) -> DataFrame:
    old, new = _log(F.col("df")), _log(F.col("df_new"))
    return moved.select("term", "df", F.lit(0.0).alias("l0"), (new - old).alias("l1"), (new * new - old * old).alias("l2"))


def _products() -> list[Column]:
    return [(F.col("square") * F.col(f"l{i}")).alias(f"s{i}") for i in range(3)]


def _unit_sums(forward: DataFrame, factors: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keys, s0, s1, s2: sums of tf * tf times l0, l1 and l2 of factors (term, df, l0, l1, l2), a row per unit.

    A unit's terms lie in its row, so the factors of the most frequent terms, FREQUENT at most, are sent to every task and
    their part is added up there. Only postings of other terms become rows, which are dealt by term."""
    frequent, rest = most_frequent(factors)
    sent = (factors.limit(0) if frequent is None else frequent).select("term", "l0", "l1", "l2").toArrow().combine_chunks()
    sent = forward.sparkSession.sparkContext.broadcast(sent)
    kept = forward.select(*keys, "doc_len", "terms")
    schema = StructType([*kept.select(*keys).schema, *StructType.fromDDL("s0 double, s1 double, s2 double")])
    if rest is None:
        return kept.mapInArrow(lambda batches: _sums_of(batches, sent.value, False), schema)
    # one pass: rows without a term are sums of a unit, the others are postings that are still to get their factors
    told = keep(kept.mapInArrow(lambda batches: _sums_of(batches, sent.value, True), StructType([*schema, StructField("term", StringType())])))
    others = told.where("term IS NOT NULL").select(*keys, "term", F.col("s0").alias("square")).join(rest, "term").select(*keys, *_products())
    both = told.where("term IS NULL").drop("term").unionByName(others)
    return both.groupBy(*keys).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(3)))


def _sums_of(batches: Iterator[pa.RecordBatch], factors: pa.Table, others: bool) -> Iterator[pa.RecordBatch]:
    """keys, s0, s1, s2 of units (keys, doc_len, terms) with a term of factors (term, l0, l1, l2). others: and term, null
    for these; then come rows of terms without factors, whose s0 is the square of the term's share of its unit."""
    value_set = factors.column("term").combine_chunks() if factors.num_rows else pa.array([], pa.string())
    by = [factors.column(f"l{i}").to_numpy() for i in range(3)]
    for batch in _slices(batches, PACK):
        *keys, lengths, terms = batch.columns
        flat = terms.flatten()
        unit = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
        tf = flat.field("raw_freq").to_numpy() / lengths.to_numpy()[unit].astype(np.float64)
        square = tf * tf
        found = pc.index_in(flat.field("term"), value_set=value_set)
        hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
        at, of = found.drop_null().to_numpy(), unit[hit]
        held = np.flatnonzero(np.bincount(of, minlength=len(batch)))
        # of no rows at all numpy makes integers
        sums = [np.bincount(of, weights=square[hit] * x[at], minlength=len(batch))[held].astype(np.float64) for x in by]
        names = [*batch.schema.names[:-2], "s0", "s1", "s2"]
        columns = [*(k.take(pa.array(held)) for k in keys), *map(pa.array, sums)]
        if not others:
            yield pa.RecordBatch.from_arrays(columns, names)
            continue
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(held), pa.string())], [*names, "term"])
        rare = np.flatnonzero(~hit)
        none = pa.nulls(len(rare), pa.float64())
        yield pa.RecordBatch.from_arrays([*(k.take(pa.array(unit[rare])) for k in keys), pa.array(square[rare]), none, none, flat.field("term").take(pa.array(rare))], [*names, "term"])


def level(n: int) -> Column:
    return F.log(F.lit(n + 1.0)) + F.lit(1.0)


def magnitude(n: int) -> Column:
    """Of a unit, from its sums; 0 where rounding leaves less than nothing."""
    up = level(n)
    return F.sqrt(F.greatest(up * up * F.col("s0") - F.lit(2.0) * up * F.col("s1") + F.col("s2"), F.lit(0.0)))


def weighted(postings: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """postings with tf and tfidf (smoothed inverse document frequency)."""
    return with_counts(postings, df).withColumn("tf", _tf()).withColumn("tfidf", F.col("tf") * (level(n) - _log(F.col("df")))).drop("df")
