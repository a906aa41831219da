"""Blocks of whole documents, and questions about hashes that blocks ask of each other.

A block is one row with some documents, compressed. A block asks about a sorted list of keys; the list is cut by the
keys' leading bits into buckets, a bucket's lists from all blocks meet in one task, and what goes back is one small
answer per key, in the order of the question. So a key counts once per block however often it occurs there, no row
crosses the network per window, and an answer costs a byte.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseek.llm.hashing import ragged
from lumenseek.llm.scratch import stored

#: Bytes of text after which a block is closed.
BLOCK_BYTES = 2 << 20
#: Stands for a null id: it comes after all others.
NO_ID = np.iinfo(np.int64).max


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings one after another, and their bounds; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class Block:
    """ids: int64, NO_ID for null; data and bounds as texts_of() gives them."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, bounds: np.ndarray):
        self.ids, self.data, self.bounds = ids, data, bounds

    def dump(self) -> bytes:
        import zstandard

        head = np.array([len(self.ids)], np.int64)
        return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in (head, self.ids, self.bounds, self.data)))

    @classmethod
    def load(cls, blob: bytes) -> Block:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        body = np.frombuffer(raw, np.int64, 2 * n + 1, 8)
        return cls(body[:n], np.frombuffer(raw, np.uint8, -1, 8 * (2 * n + 2)), body[n:])

    def take(self, rows: np.ndarray) -> Block:
        """A block of some of the documents."""
        size = np.diff(self.bounds)[rows]
        return Block(self.ids[rows], self.data[ragged(self.bounds[rows], size)], np.concatenate([[0], np.cumsum(size)]))

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NO_ID)


def packed(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block long, blob binary: docs in blocks, written to the shared folder so that blocks never change."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        data: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            blob = Block(np.concatenate(ids), np.concatenate(data), bounds).dump()
            for x in (ids, data, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

        for batch in batches:
            own = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            text, bounds = texts_of(batch.column(1))
            a = 0
            while a < len(own):
                b = int(np.searchsorted(bounds, bounds[a] + block_bytes - held, "left"))
                b = min(max(b, a + 1), len(own))
                ids.append(own[a:b])
                data.append(text[bounds[a] : bounds[b]])
                sizes.append(np.diff(bounds[a : b + 1]))
                held += int(bounds[b] - bounds[a])
                a = b
                if held >= block_bytes:
                    yield close()
                    held = 0
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(pack, "blob binary")
    return stored(rows.select(F.monotonically_increasing_id().alias("block"), "blob"), "blocks")


def bucket_count(docs: DataFrame, text_col: str, keys_per_byte: float, keys_per_bucket: int = 1 << 19) -> int:
    """Buckets so that each holds about keys_per_bucket keys; 128 at least."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(128, math.ceil(size * keys_per_byte / keys_per_bucket))


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """buckets + 1 bounds into sorted keys: bucket b holds the keys of the b-th equal share of all uint64."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def questions(block: int, buckets: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, block, payload) for sorted keys and columns beside them; empty buckets get none."""
    bounds = cut(keys, buckets)
    for b in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[b], bounds[b + 1])
        yield int(b), block, b"".join([np.array([bounds[b + 1] - bounds[b]], np.int64).tobytes(), *(np.ascontiguousarray(c[part]).tobytes() for c in (keys, *columns))])


QUESTION = "bucket int, block long, payload binary"
ANSWER = "block long, bucket int, answer binary"


def question_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, block, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())], ["bucket", "block", "payload"])


def ask(packed_blocks: DataFrame, question: Callable[[int, Block], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield question_batch(list(question(block, Block.load(blob.as_buffer()))))

    return packed_blocks.select("block", "blob").mapInArrow(run, QUESTION)


def answered(asked: DataFrame, kinds: list[str], answer: Callable[..., np.ndarray]) -> DataFrame:
    """answer gets, for one bucket, an array per kind (numpy type names, keys first) with all blocks' rows one after
    another, and the number of each row's block; it returns a uint8 for each row."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts: list[list[np.ndarray]] = [[] for _ in kinds]
        sizes = []
        for payload in table.column("payload"):
            raw = payload.as_buffer()
            n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
            sizes.append(n)
            for into, kind in zip(parts, kinds, strict=True):
                into.append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
        of = np.repeat(np.arange(len(sizes)), sizes)
        out = answer(*(np.concatenate(x) for x in parts), of).astype(np.uint8)
        cuts = np.cumsum(sizes)[:-1]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "answer": pa.array([x.tobytes() for x in np.split(out, cuts)], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def with_answers(packed_blocks: DataFrame, answers: list[DataFrame], schema: str, use: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """use(block, Block, *answers): for each round of questions one uint8 array, in the order asked."""
    every = None
    for k, x in enumerate(answers):
        x = x.select("block", F.lit(k).alias("round"), "bucket", "answer")
        every = x if every is None else every.unionByName(x)
    rounds = len(answers)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        right = right.sort_by([("round", "ascending"), ("bucket", "ascending")])
        kinds = right.column("round").to_numpy()
        given = right.column("answer").to_pylist()
        for k in range(rounds):
            found.append(np.frombuffer(b"".join(given[i] for i in np.flatnonzero(kinds == k)), np.uint8))
        parts = []
        for block, blob in zip(left.column("block").to_pylist(), left.column("blob"), strict=True):
            parts += list(use(block, Block.load(blob.as_buffer()), *found))
        return pa.Table.from_batches(parts, schema=None if parts else empty)

    empty = _arrow_schema(packed_blocks.sparkSession, schema)
    return packed_blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(run, schema)


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def first_of_runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return new
