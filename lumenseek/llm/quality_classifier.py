"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its words, pairs of neighbouring words, and the same with words replaced by their shape (kinds of
the first and last characters, length class, whether the word repeats the one before), each hashed to BITS bits. A
document's vector is the count of each feature over the square root of its number of words, so a score is one sparse dot
product. Training reads a bounded sample of labelled documents in one task, in the order of a hash of their ids; scoring
ships the weights (4 bytes for each of 2**BITS) with the tasks and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseek.llm.blocks import texts_of
from lumenseek.llm.hashing import BASES, Words, mix

BITS = 18
#: Labelled documents that training reads at most (about: those whose hash falls below the share that this is of all).
TRAIN_DOCS = 12_000
EPOCHS = 3
#: Of the updates: step size and its offset, and the absolute and squared penalties.
STEP, OFFSET, L1, L2 = 0.3, 1.0, 0.002, 0.5

_KIND = np.full(256, 5, np.uint64)  # bytes of other characters
for _k, _range in enumerate((range(97, 123), range(65, 91), range(48, 58))):
    _KIND[list(_range)] = _k
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum():
        _KIND[_c] = 6 + _c
_LENGTHS = np.array([1, 2, 4, 8, 16, 64])


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several documents: feature numbers, document of each, and words per document."""
    w = Words(data, bounds)
    n = len(w)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), w.count
    word = w.hashes()
    again = np.zeros(n, bool)
    again[1:] = (word[1:] == word[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape = _KIND[data[w.start]] * np.uint64(1 << 20) + _KIND[data[w.end - 1]] * np.uint64(1 << 8)
    shape = mix(shape + np.searchsorted(_LENGTHS, w.end - w.start).astype(np.uint64) * np.uint64(2) + again.astype(np.uint64) + np.uint64(1 << 40))
    pair = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    pairs = [mix(x[pair] * np.uint64(BASES[0]) + x[pair + 1]) for x in (word, shape)]
    hashed = np.concatenate([word, shape, *pairs])
    of = np.concatenate([w.doc, w.doc, w.doc[pair], w.doc[pair]])
    return (hashed >> np.uint64(64 - BITS)).astype(np.int64), of, w.count


def train(examples: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Weights of 2**BITS features and, last, the constant. examples: label, number of words, feature numbers."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    prepared = []
    for label, words, at in examples:
        at, count = np.unique(at, return_counts=True)
        prepared.append((label, np.append(at, size - 1), np.append(count / np.sqrt(max(words, 1)), 1.0)))
    for _ in range(EPOCHS):
        for label, at, x in prepared:
            za, na = z[at], n[at]
            wa = np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((OFFSET + np.sqrt(na)) / STEP + L2))
            p = 1 / (1 + np.exp(-np.clip(wa @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / STEP
            z[at] = za + g - sigma * wa
            n[at] = na + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((OFFSET + np.sqrt(n)) / STEP + L2))
    return w.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Weights learnt from documents with a label of 0 or 1 for which learn (over id_col) is true.

    Ids with several different labels, null ids and null labels are left out; a null text counts as empty. Without any
    labelled document all weights are 0, which scores 0.5."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other").select("id", "label", F.xxhash64("id").alias("h"))
    share = min(1.0, train_docs / max(1, known.count()))
    known = known.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(known, F.col("doc") == F.col("id")).select("label", "h", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                at, of, words = features(*texts_of(part.column(2)))
                order = np.argsort(of, kind="stable")
                rows = np.split(at[order].astype(np.int32), np.cumsum(np.bincount(of, minlength=part.num_rows))[:-1]) if part.num_rows else []
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), part.column(1), pa.array(words.astype(np.int64)), pa.array([x.tobytes() for x in rows], pa.binary())], ["label", "h", "words", "at"])

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for b in batches:
            examples += [(label, words, np.frombuffer(at, np.int32)) for label, words, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([train(examples).tobytes()], pa.binary())], ["weights"])

    counted = chosen.mapInArrow(count, "label int, h long, words long, at binary")
    row = counted.repartition(1).sortWithinPartitions("h", "words", "at").mapInArrow(learn_all, "weights binary").first()
    return np.frombuffer(row[0], np.float32) if row else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score double (0 to 1, higher: label 1 likelier) for every row of docs, from its whole text alone. Null
    and empty texts are scored by the constant; repeated rows are scored each; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.astype(np.float64)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                at, of, words = features(*texts_of(part.column(1)))
                total = np.bincount(of, weights=w[at], minlength=part.num_rows) / np.sqrt(np.maximum(words, 1)) + w[-1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
