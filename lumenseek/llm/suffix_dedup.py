"""Removal of repeated byte strings by longest-previous-factor arrays over the parts of a corpus that can repeat.

A string of `length` bytes is repeated if it also starts earlier (in a document of a smaller id, or before in the same).
Sorting all suffixes of a corpus would cost its size many times over, so suffixes are sorted only where they can match:

1. Anchors. In each string of `length` bytes the leftmost smallest hash of its runs of length / 4 bytes is an anchor, so
   equal strings have equal anchors at equal places, and an anchor owns the strings that it was chosen for: its context.
   Blocks send hashes of anchors and contexts. Hashes only route: they tell which contexts have to meet, and which occur so
   often that the text of their first two occurrences in different blocks stands for all.
2. Suffixes. The contexts that agree around an anchor meet in one task, in order of document and place; of a context that
   occurs in several blocks the first two do, which are compared byte by byte. Suffixes are sorted, those of a second
   occurrence that equals the first but once; the previous and the next smaller position in suffix order give each string's
   longest previous factor, and where that reaches `length`, the string is repeated. If all strings of a second occurrence
   are, the later ones are repeated too. Occurrences in one block are compared there.
3. Blocks remove every byte that a repeated string covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseek.llm.blocks import QUESTION, Block, answered, ask, bucket_count, cut, first_of_runs, packed, question_batch, questions, with_answers
from lumenseek.llm.hashing import BASES, Runs, mix, ragged
from lumenseek.llm.scratch import stored

#: Codes of a context: it occurs earlier in another block; its text is sent; it is the second, which speaks for later ones.
LATER, CONTENDER, SECOND = 1, 2, 4


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours, by the first."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).reshape(-1)
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def context_hashes(runs: Runs, low: np.ndarray, end: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Of contexts, from their bytes and from where their anchors lie."""
    return mix(runs.hash(low, end) + mix(shape))


class Anchors:
    """Of a block: at (place of the anchor), low and high (first and last string that it owns), doc; and hashes."""

    def __init__(self, block: Block, length: int):
        self.block, self.length = block, length
        data, bounds = block.data, block.bounds
        k = max(1, length // 4)
        runs = Runs(data.astype(np.uint64) + np.uint64(1))
        grams = runs.windows(k)
        bits = np.uint64(max(1, int(len(data)).bit_length()))
        ordered = (mix(grams) >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        chosen = (sliding_min(ordered, length - k + 1) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        n_starts = np.maximum(np.diff(bounds) - length + 1, 0)
        doc = np.repeat(np.arange(len(n_starts)), n_starts)
        starts = bounds[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
        owner = chosen[starts]
        new = first_of_runs(owner)
        self.at, self.low, self.doc = owner[new], starts[new], doc[new]
        last = np.append(np.flatnonzero(new)[1:], len(owner)) - 1 if len(owner) else np.empty(0, np.int64)
        self.high = starts[last]
        self.id, self.place = block.ids[self.doc], self.low - bounds[self.doc]
        self.key = grams[self.at] if len(grams) else np.empty(0, np.uint64)
        size = self.high - self.low
        self.context = context_hashes(runs, self.low, self.high + length, ((self.at - self.low) * (1 << 20) + size).astype(np.uint64))
        # two strings that agree do so over at least half of the rest on one side of the anchor
        side = -(-(length - k) // 2)
        left = np.maximum(self.at - side, 0)
        right = np.minimum(self.at + k + side, len(data))
        self.left = np.where(self.low <= self.at - side, runs.hash(left, self.at + k) | np.uint64(1), np.uint64(0)).astype(np.uint32)
        self.right = np.where(self.high + length >= self.at + k + side, runs.hash(self.at, right) | np.uint64(1), np.uint64(0)).astype(np.uint32)
        self.order = np.lexsort((self.place, self.id, self.context, self.key))
        self.new = first_of_runs(self.key[self.order], self.context[self.order])
        #: the first occurrence here of each pair of key and context, sorted by key
        self.firsts = self.order[self.new]

    def columns(self) -> tuple[np.ndarray, ...]:
        f = self.firsts
        return self.key[f], self.context[f], self.id[f], self.place[f].astype(np.int64), self.left[f], self.right[f]

    def copies(self) -> np.ndarray:
        """Occurrences of a context after its first here, byte for byte."""
        group = np.cumsum(self.new) - 1
        later, first = self.order[~self.new], self.firsts[group[~self.new]]
        size = self.high[later] - self.low[later] + self.length
        same = (size == self.high[first] - self.low[first] + self.length) & (self.at[later] - self.low[later] == self.at[first] - self.low[first])
        later, first, size = later[same], first[same], size[same]
        keep = []
        upto = np.concatenate([[0], np.cumsum(size)])
        for a, z in _chunks(upto, 1 << 24):
            differs = self.block.data[ragged(self.low[later[a:z]], size[a:z])] != self.block.data[ragged(self.low[first[a:z]], size[a:z])]
            bad = np.concatenate([[0], np.cumsum(differs)])
            keep.append(bad[upto[a + 1 : z + 1] - upto[a]] == bad[upto[a:z] - upto[a]])
        return later[np.concatenate(keep)] if keep else later


def _chunks(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items, whose sizes end at upto, of about `most` together."""
    a = 0
    while a < len(upto) - 1:
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1)
        yield a, z
        a = z


def _codes(key, context, ids, place, left, right, of) -> np.ndarray:
    order = np.lexsort((place, ids, context, key))
    new = first_of_runs(key[order], context[order])
    out = np.full(len(key), LATER, np.uint8)
    first = order[new]
    group = np.cumsum(new) - 1
    copied = np.bincount(group) > 1
    second = order[np.flatnonzero(new)[copied] + 1]
    rival = np.zeros(len(first), bool)
    for side in (left, right):
        both = mix(key[first] + side[first].astype(np.uint64) * np.uint64(BASES[1]))
        _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        rival |= (count[inverse] > 1) & (side[first] > 0)
    out[first] = np.where(copied | rival, CONTENDER, 0)
    out[second] = LATER + CONTENDER + SECOND
    return out


def suffix_order(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For strings from starts up to ends (length bytes at least): their ranks as suffixes, and the number of the run of
    suffixes that agree in the first length bytes; both grow in suffix order. With depth, suffixes that agree in so many
    bytes count as equal.

    Eight bytes at a time are compared, from the left, and only among suffixes that have agreed so far."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    eights = np.ndarray((len(text) + 8,), ">u8", padded, 0, (1,))
    rank = np.zeros(len(starts), np.int64)
    runs = rank
    open_ = np.arange(len(starts))
    at = 0
    longest = int((ends - starts).max(initial=0))
    longest = longest if depth is None else min(longest, depth)
    while at < longest:
        step = min(8, length - at) if at < length else 8
        if len(open_):
            left = np.minimum(ends[open_] - starts[open_] - at, step)
            word = eights[np.minimum(starts[open_] + at, len(text))].astype(np.uint64)
            word = np.where(left > 0, word >> (np.uint64(64) - np.uint64(8) * np.maximum(left, 1).astype(np.uint64)) << np.uint64(8) * (np.uint64(8) - np.maximum(left, 1).astype(np.uint64)), np.uint64(0))
            order = np.lexsort((word, rank[open_])) if at else np.argsort(word, kind="stable")
            by_rank, by_word = rank[open_][order], word[order]
            new = first_of_runs(by_rank, by_word)
            # a group's members keep its rank, plus how many of the group come before
            head = np.flatnonzero(new)
            base = np.flatnonzero(first_of_runs(by_rank))
            of_group = np.repeat(base, np.diff(np.append(base, len(order))))
            size = np.diff(np.append(head, len(order)))
            fresh = np.repeat(head, size) - of_group + by_rank
            rank = rank.copy()
            rank[open_[order]] = fresh
            open_ = open_[order][np.repeat(size > 1, size)]
        at += step
        if at == length:
            runs = rank
        if at >= length and not len(open_):
            break
    return rank, runs


def nearest_smaller(place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row, the nearest row before it of its group (rows of a group are neighbours) with a smaller place; -1 if
    there is none. Rows jump over what lies between a larger neighbour and the nearest smaller one of that."""
    out = np.arange(len(place)) - 1
    open_ = np.arange(len(place))
    while len(open_):
        other = out[open_]
        inside = (other >= 0) & (group[np.maximum(other, 0)] == group[open_])
        out[open_[~inside]] = -1
        open_, other = open_[inside], other[inside]
        larger = place[other] > place[open_]
        open_, other = open_[larger], other[larger]
        out[open_] = out[other]
    return out


def longest_previous(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, string: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor of each occurrence (number of a string from starts up to ends, and a place), the
    larger of its common prefixes with the previous and the next smaller place in suffix order, reaches length. A smaller
    place is an earlier occurrence; a string that occurs again is sorted once."""
    # what follows the first length bytes would order a run, of which only the smallest place matters
    rank, runs = (x[string] for x in suffix_order(text, starts, ends, length, depth=length))
    order = np.argsort(rank, kind="stable")
    by_place, run = place[order], runs[order]
    previous = nearest_smaller(by_place, run)
    following = nearest_smaller(by_place[::-1], run[::-1])[::-1]
    out = np.empty(len(string), bool)
    out[order] = (previous >= 0) | (following >= 0)
    return out


def _equal_to_first(context: np.ndarray, sizes: np.ndarray, second: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which contexts are second occurrences that equal the first one of their hash byte for byte."""
    out = np.zeros(len(sizes), bool)
    firsts, seconds = np.flatnonzero(~second), np.flatnonzero(second)
    firsts = firsts[np.argsort(context[firsts], kind="stable")]
    if not len(firsts) or not len(seconds):
        return out
    at = np.minimum(np.searchsorted(context[firsts], context[seconds]), len(firsts) - 1)
    first = firsts[at]
    same = (context[first] == context[seconds]) & (sizes[first] == sizes[seconds])
    first, seconds = first[same], seconds[same]
    begin = np.cumsum(sizes) - sizes
    upto = np.concatenate([[0], np.cumsum(sizes[seconds])])
    for a, z in _chunks(upto, 1 << 24):
        differs = text[ragged(begin[seconds[a:z]], sizes[seconds[a:z]])] != text[ragged(begin[first[a:z]], sizes[seconds[a:z]])]
        bad = np.concatenate([[0], np.cumsum(differs)])
        out[seconds[a:z]] = bad[upto[a + 1 : z + 1] - upto[a]] == bad[upto[a:z] - upto[a]]
    return out


def _repeated_in(ids: np.ndarray, places: np.ndarray, sizes: np.ndarray, second: np.ndarray, context: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (one after another in text, with their hashes): a flag per string, and per context whether it is a
    second occurrence and all its strings are repeated. A second one that equals the first is repeated as it stands; only
    the others' suffixes are sorted."""
    begin = np.cumsum(sizes) - sizes
    own = sizes - length + 1
    equal = _equal_to_first(context, sizes, second, text)
    sorted_ = np.flatnonzero(~equal)
    of = np.repeat(np.arange(len(sizes)), own)
    number = np.repeat(sorted_, own[sorted_])
    starts = ragged(begin[sorted_], own[sorted_])
    # places in order of document and place
    turn = np.empty(len(sizes), np.int64)
    by_place = np.lexsort((places, ids))
    turn[by_place] = np.cumsum(own[by_place]) - own[by_place]
    place = turn[number] + starts - begin[number]
    flags = np.ones(int(own.sum()), bool)
    flags[~equal[of]] = longest_previous(text, starts, (begin + sizes)[number], np.arange(len(starts)), place, length)
    missing = np.bincount(of, weights=~flags, minlength=len(sizes))
    return flags, second & (missing == 0)


def _parts(code: np.ndarray, anchors: Anchors, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block asks in the second round, in the order asked: numbers of contexts, their buckets, whether they send
    their text, and bytes of their answers: a flag per string sent, or one for all."""
    asked = np.flatnonzero(code > 0)
    f = anchors.firsts[asked]
    bucket = np.repeat(np.arange(buckets), np.diff(cut(anchors.key[f], buckets)))
    sends = (code[asked] & CONTENDER) > 0
    order = np.lexsort((~sends, bucket))
    size = np.where(sends, anchors.high[f] - anchors.low[f] + 1, 1)
    return asked[order], bucket[order], sends[order], size[order]


def remove_repeated_strings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Documents without the bytes that lie in a string of `length` bytes which also starts earlier.

    Returns one row per row of docs: id_col, n_bytes long, n_removed long, n_spans long (maximal removed runs) and kept
    binary (the other bytes). Earlier means a smaller id, or the same and a smaller start; overlaps count; strings never
    cross documents and are judged on the input. Null and empty texts have no bytes. Rows that share an id are ordered by
    start as if they were one document; a null id comes after all others. Other columns are not read. An empty table
    gives an empty table.
    """
    if length < 8:
        raise ValueError("length must be at least 8")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = packed(rows, "id", "text")
    buckets = bucket_count(rows, "text", 2.0 / (length - length // 4 + 2), 1 << 18)

    def question(block: int, own: Block) -> Iterator[tuple[int, int, bytes]]:
        key, *rest = Anchors(own, length).columns()
        yield from questions(block, buckets, key, *rest)

    kinds = ["uint64", "uint64", "int64", "int64", "uint32", "uint32"]
    codes = stored(answered(ask(blocks, question), kinds, _codes), "context-codes")

    def contend(block: int, own: Block, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(own, length)
        asked, bucket, sends, _ = _parts(code, anchors, buckets)
        out = []
        for b in np.unique(bucket).tolist():
            a, z = np.searchsorted(bucket, [b, b + 1])
            part, full = asked[a:z], sends[a:z]
            f = anchors.firsts[part[full]]
            low, high = anchors.low[f], anchors.high[f] + length
            head = np.array([len(f), int((~full).sum())], np.int64)
            columns = (anchors.id[f], anchors.place[f].astype(np.int64), (high - low).astype(np.int64), ((code[part[full]] & SECOND) > 0).astype(np.int64), anchors.context[anchors.firsts[part]].view(np.int64))
            out.append((b, block, b"".join(x.tobytes() for x in (head, *columns)) + own.data[ragged(low, high - low)].tobytes()))
        yield question_batch(out)

    def compare(table: pa.Table) -> pa.Table:
        sent: list[list[np.ndarray]] = [[] for _ in range(6)]
        waiting = []
        for payload in table.column("payload"):
            raw = payload.as_buffer()
            n, m = np.frombuffer(raw, np.int64, 2).tolist()
            for into, x in zip(sent, np.frombuffer(raw, np.int64, 5 * n, 16).reshape(5, n), strict=False):
                into.append(x)
            sent[5].append(np.frombuffer(raw, np.uint8, -1, 16 + 40 * n + 8 * m))
            waiting.append(np.frombuffer(raw, np.int64, m, 16 + 40 * n))
        counts = [len(x) for x in sent[0]]
        ids, places, sizes, second, context, text = (np.concatenate(x) for x in sent)
        flags, again = _repeated_in(ids, places, sizes, second > 0, context, text, length)
        # a context that occurs earlier hears of its second occurrence
        known = np.flatnonzero(second)
        known = known[np.argsort(context[known])]
        own = sizes - length + 1
        flag_at, answers, a = np.concatenate([[0], np.cumsum(own)]), [], 0
        for n, w in zip(counts, waiting, strict=True):
            mine = flags[flag_at[a] : flag_at[a + n]]
            told = again[known[np.searchsorted(context[known], w)]] if len(w) else np.empty(0, bool)
            answers.append(mine.astype(np.uint8).tobytes() + told.astype(np.uint8).tobytes())
            a += n
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "answer": pa.array(answers, pa.binary())})

    compared = with_answers(blocks, [codes], QUESTION, contend).groupBy("bucket").applyInArrow(compare, "block long, bucket int, answer binary")

    def finish(block: int, own: Block, code: np.ndarray, answer: np.ndarray) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(own, length)
        n = len(own.data)
        asked, _, sends, size = _parts(code, anchors, buckets)
        at = np.cumsum(size) - size
        # contexts that are repeated as a whole, and copies of one that lies in this block too
        whole = np.zeros(len(code), bool)
        whole[asked[~sends]] = answer[at[~sends]] > 0
        gone = np.zeros(n + 1, np.int64)
        occurrence = np.concatenate([anchors.firsts[whole], anchors.copies()])
        np.add.at(gone, anchors.low[occurrence], 1)
        np.add.at(gone, anchors.high[occurrence] + 1, -1)
        start = np.cumsum(gone[:-1]) > 0
        f = anchors.firsts[asked[sends]]
        strings = anchors.high[f] - anchors.low[f] + 1
        start[ragged(anchors.low[f], strings)[answer[ragged(at[sends], strings)] > 0]] = True
        cover = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(start)
        cover[at] += 1
        np.add.at(cover, at + length, -1)
        removed = np.cumsum(cover[:-1]) > 0
        edge = removed.copy()
        edge[1:] &= ~removed[:-1]
        inner = own.bounds[:-1][own.bounds[:-1] < n]
        edge[inner] = removed[inner]  # a run ends with its document
        upto = np.concatenate([[0], np.cumsum(removed)])
        spans = np.concatenate([[0], np.cumsum(edge)])
        n_removed = upto[own.bounds[1:]] - upto[own.bounds[:-1]]
        size = np.diff(own.bounds)
        bounds = np.concatenate([[0], np.cumsum(size - n_removed)]).astype(np.int64)
        kept = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(own.data[~removed])])
        yield pa.RecordBatch.from_arrays(
            [own.id_column(), pa.array(size.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array((spans[own.bounds[1:]] - spans[own.bounds[:-1]]).astype(np.int64)), kept.cast(pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    return with_answers(blocks, [codes, compared], "id long, n_bytes long, n_removed long, n_spans long, kept binary", finish).withColumnRenamed("id", id_col)
