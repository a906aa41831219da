"""Removal of repeated word sequences by difference-cover anchors.

Two equal windows of `window` words in different documents start at word i of one and j of the other. For a difference
cover D modulo v there is a shift s < v with i + s and j + s both in D modulo v; so the run of window - v + 1 words at
that shift, an anchor, is hashed in both documents. Anchors are only taken at cover positions (3 of 7). Steps:

1. blocks of documents ask which of their anchors occur in another document;
2. windows that hold such an anchor, and no others, are hashed whole (128 bits) and their smallest document is found;
3. each block marks the words under windows that a smaller document has, and joins the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseek.llm.blocks import Block, answered, ask, bucket_count, first_of_runs, packed, question_batch, questions, with_answers, QUESTION
from lumenseek.llm.hashing import BASES, Runs, Words
from lumenseek.llm.scratch import stored

#: Period to cover: every residue is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def period_for(window: int) -> int:
    """The largest period that leaves an anchor of about half the window."""
    return max([v for v in COVERS if v <= (window + 1) // 2], default=0)


class _Windows:
    """Anchors and windows of a block's documents."""

    def __init__(self, block: Block, window: int):
        self.block, self.window, v = block, window, period_for(window)
        self.words = w = Words(block.data, block.bounds)
        self.hash = Runs(w.hashes()), Runs(w.hashes(seed=BASES[0]), BASES[1])
        left = np.repeat(w.first[1:], w.count) - np.arange(len(w))  # words from here to the document's end
        self.starts = np.flatnonzero(left >= window)
        length = window - v + 1 if v else window
        at = np.arange(len(w)) - np.repeat(w.first[:-1], w.count)
        cover = np.isin(np.arange(v or 1), COVERS.get(v, (0,)))
        self.anchors = np.flatnonzero(cover[at % (v or 1)] & (left >= length))
        hashed = self.hash[0].hash(self.anchors, self.anchors + length)
        self.keys, self.key_of = np.unique(hashed, return_inverse=True)
        self.shifts = v or 1

    def several(self) -> np.ndarray:
        """For each key, whether two documents of this block have it."""
        doc = self.words.doc[self.anchors]
        order = np.lexsort((doc, self.key_of))
        new = first_of_runs(self.key_of[order], doc[order])
        return np.bincount(self.key_of[order][new], minlength=len(self.keys)) > 1

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts of the windows over a shared anchor, by hash and then document: start, new hash here, hash columns."""
        hot = np.zeros(len(self.words) + 1, np.int64)
        hot[self.anchors[shared[self.key_of]] + 1] = 1
        before = np.cumsum(hot)
        last = np.minimum(self.starts + self.shifts, len(self.words))
        s = self.starts[before[last] > before[self.starts]]
        one, two = (h.hash(s, s + self.window) for h in self.hash)
        ids = self.block.ids[self.words.doc[s]]
        order = np.lexsort((ids, two, one))
        s, one, two, ids = s[order], one[order], two[order], ids[order]
        return s, first_of_runs(one, two), one, two, ids


def _other_blocks(key: np.ndarray, several: np.ndarray, of: np.ndarray) -> np.ndarray:
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return (count[inverse] > 1) | (several > 0)


def _smaller_elsewhere(one: np.ndarray, two: np.ndarray, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    order = np.lexsort((ids, two, one))
    new = first_of_runs(one[order], two[order])
    least = ids[order][new][np.cumsum(new) - 1]
    out = np.empty(len(one), bool)
    out[order] = ids[order] > least
    return out


def remove_repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Documents without the words that stand in a `window`-word sequence which a document of a smaller id also has.

    Returns one row per row of docs: id_col, n_words long, n_removed long, kept string (kept words joined by one space).
    Other columns of docs are not read. Judged on the input, not on what is left. Null and empty texts have no words.
    Rows with equal ids do not remove each other's words. A null id comes after all others, and null ids do not remove
    each other's words. An empty table gives an empty table.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = packed(rows, "id", "text")
    buckets = bucket_count(rows, "text", 3 / 7 / 7)

    def anchors(block: int, own: Block) -> Iterator[tuple[int, int, bytes]]:
        w = _Windows(own, window)
        yield from questions(block, buckets, w.keys, w.several().astype(np.uint8))

    shared = stored(answered(ask(blocks, anchors), ["uint64", "uint8"], _other_blocks), "shared-anchors")

    def windows(block: int, own: Block, hits: np.ndarray) -> Iterator[pa.RecordBatch]:
        s, new, one, two, ids = _Windows(own, window).candidates(hits > 0)
        yield question_batch(list(questions(block, buckets, one[new], two[new], ids[new])))

    asked = with_answers(blocks, [shared], QUESTION, windows)
    later = answered(asked, ["uint64", "uint64", "int64"], _smaller_elsewhere)

    def finish(block: int, own: Block, hits: np.ndarray, repeated: np.ndarray) -> Iterator[pa.RecordBatch]:
        w = _Windows(own, window)
        s, new, _, _, ids = w.candidates(hits > 0)
        group = np.cumsum(new) - 1
        gone = (repeated[group] > 0) | (ids > ids[new][group]) if len(s) else np.empty(0, bool)
        depth = np.zeros(len(w.words) + 1, np.int64)
        np.add.at(depth, s[gone], 1)
        np.add.at(depth, s[gone] + window, -1)
        removed = np.cumsum(depth[:-1]) > 0
        yield kept_words(own, w.words, removed)

    return with_answers(blocks, [shared, later], "id long, n_words long, n_removed long, kept string", finish).withColumnRenamed("id", id_col)


def kept_words(own: Block, words: Words, removed: np.ndarray) -> pa.RecordBatch:
    """id, n_words, n_removed and kept of a block's documents: words not removed, joined by one space."""
    stay = np.flatnonzero(~removed)
    # a kept word takes the byte after it as its space, save the last of a document
    last = np.ones(len(stay), bool)
    last[:-1] = words.doc[stay[1:]] != words.doc[stay[:-1]]
    edge = np.zeros(len(own.data) + 2, np.int8)
    np.add.at(edge, words.start[stay], 1)
    stop = words.end[stay] + ~last
    np.add.at(edge, stop, -1)
    take = np.cumsum(edge[: len(own.data)], dtype=np.int8) > 0
    data = own.data.copy()
    data[words.end[stay[~last]]] = 0x20
    size = np.bincount(words.doc[stay], weights=stop - words.start[stay], minlength=len(own.ids)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(own.ids), [None, pa.py_buffer(bounds), pa.py_buffer(data[take])])
    n_removed = np.bincount(words.doc[removed], minlength=len(own.ids))
    return pa.RecordBatch.from_arrays([own.id_column(), pa.array(words.count.astype(np.int64)), pa.array(n_removed.astype(np.int64)), text.cast(pa.string())], ["id", "n_words", "n_removed", "kept"])
