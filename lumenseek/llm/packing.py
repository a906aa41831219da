"""Packing of tokenised documents into fixed-length sequences by hierarchical residual best fit.

Every task packs its own pieces by best fit, longest first. Its nearly full bins are sequences; what is in underfull bins
goes on to the node of a tree that stands for FAN tasks, where it is packed again in the same way, and so on up the tree
until no more than FAN nodes are left, whose underfull bins meet at the root. Underfull bins are opened on the way, since two pieces that only shared a bin for want of better
ones would keep out a piece that fits. At the root, items of equal size are interchangeable, so best fit is planned on
their counts per size (capacity of them at most) and each finds its sequence by its size and number: no task holds or
closes them all, and no bin is given up for want of room. Only lengths and keys move, never tokens.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenseek.llm.blocks import first_of_runs
from lumenseek.llm.hashing import ragged
from lumenseek.llm.scratch import stored

#: Bytes of text tokenised at once, and words whose ids a task remembers.
TEXT_CHUNK = 2 << 20
REMEMBERED = 400_000
#: Tasks whose underfull bins meet in a node; a bin is nearly full that lacks no more than this part of the capacity.
FAN, LACKS = 8, 1 / 256


class Merges:
    """Byte-pair merges of many short strings at once: in each round every string makes its best merge."""

    NONE = np.int32((1 << 31) - 1)

    def __init__(self, tokenizer) -> None:
        model = json.loads(tokenizer.to_str())["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        byte_char = self._byte_characters()
        self.first = np.array([vocab.get(c, -1) for c in byte_char], np.int32)
        self.last = np.array([vocab.get(c + end, -1) for c in byte_char], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[x] << 24 | vocab[y] for x, y in pairs], np.uint64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.bits = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.bits))) - 1
        self.keys = np.full(self.mask + 1, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(self.mask + 1, self.NONE, np.int32)
        for rank, (key, at) in enumerate(zip(keys, self._slot(keys), strict=True)):
            while self.ranks[at] != self.NONE:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at] = key, rank

    @staticmethod
    def _byte_characters() -> list[str]:
        """Byte-level alphabets show printable Latin-1 bytes as themselves and the others from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = iter(range(256))
        return [chr(b) if b in shown else chr(256 + next(other)) for b in range(256)]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out, found = self.ranks[at], self.keys[at]
        todo = np.flatnonzero((found != keys) & (out != self.NONE))
        out[found != keys] = self.NONE
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            here, held = self.keys[at[todo]], self.ranks[at[todo]]
            out[todo] = np.where(here == keys[todo], held, self.NONE)
            todo = todo[(here != keys[todo]) & (held != self.NONE)]
        return out

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of not empty strings, one after another, and how many of each."""
        raw = [x.encode() for x in strings]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.first[data]
        sym[np.cumsum(size) - 1] = self.last[data[np.cumsum(size) - 1]]
        word = np.arange(len(raw))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            begin = np.cumsum(size) - size
            rank = np.full(len(sym), self.NONE, np.int32)
            inner = np.ones(len(sym), bool)
            inner[begin + size - 1] = False
            left = np.flatnonzero(inner)
            rank[left] = self.rank((sym[left].astype(np.uint64) << np.uint64(24)) | sym[left + 1].astype(np.uint64))
            best = np.minimum.reduceat(rank, begin)
            over = best == self.NONE
            if over.any():
                done.append((word[over], size[over], sym[ragged(begin[over], size[over])]))
                keep = ~over
                stay = np.repeat(keep, size)
                sym, rank, word, size, best = sym[stay], rank[stay], word[keep], size[keep], best[keep]
                begin = np.cumsum(size) - size
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            of = np.searchsorted(begin, at, "right") - 1
            first = np.ones(len(at), bool)
            first[1:] = of[1:] != of[:-1]
            at = at[first]
            sym[at] = self.made[best]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, size = sym[stay], size - 1
        sizes = np.zeros(len(raw), np.int64)
        for w, n, _ in done:
            sizes[w] = n
        start = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        for w, n, ids in done:
            out[ragged(start[w], n)] = ids
        return out, sizes


class WordIds:
    """Ids of words, kept for later words of the same worker. A tokenizer that trials show to join across white space, or
    to give it ids, encodes whole texts instead.

    A word of Latin letters and then punctuation without apostrophes is taken apart there, where such tokenizers also
    divide it and treat letters as in lower case, and its parts are merged by Merges, many at once. All other words, and
    all words of tokenizers for which trials disagree with that, are encoded by the tokenizer itself."""

    _parts = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]{1,48})([!-&(-/:-@\[-`{-~]{0,48})")

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.splits = self._splits()
        try:
            self.merges = Merges(self.tokenizer)
            self.apart = self._divides()
        except (KeyError, ValueError):  # not a byte-pair model
            self.apart = False
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)  # of the n-th known word; it starts where the one before ends

    def _splits(self) -> bool:
        trial = ["The first  word,\tand\n\n(the) second\r\nline ", " a\x0bb\x0cc", "don't  I'm x_y 12 345\té ß", "\n", "a. B! \"c\" --"]
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        return all(ids(x) == [i for w in re.split(r"[ \t\n\x0b\x0c\r]+", x) if w for i in ids(w)] for x in trial)

    def _divides(self) -> bool:
        trial = [a + b for a in ("The", "ÉÀü", "xXy", "straße", "unquestionably", "aaaaaaa", "qzxv") for b in ("", ".", "***", "&&&!", "(;", '"', "!!!!!!")]
        ids, sizes = self._divided(list(map(self._parts.fullmatch, trial)))
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [self.tokenizer.encode(w, add_special_tokens=False).ids for w in trial]

    def _divided(self, matches: list[re.Match]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        parts = [(m[1].lower(), m[2]) for m in matches]
        of = np.array([number.setdefault(p, len(number)) for ab in parts for p in ab], np.int64)
        strings = list(number)
        empty = number.get("")
        ids, sizes = self.merges.encode([x or "a" for x in strings])
        start = np.cumsum(sizes) - sizes
        if empty is not None:
            sizes[empty] = 0
        return ids[ragged(start[of], sizes[of])], sizes[of].reshape(-1, 2).sum(axis=1)

    def _learn(self, fresh: list[str]) -> None:
        matches = list(map(self._parts.fullmatch, fresh)) if self.apart else [None] * len(fresh)
        plain = [w for w, m in zip(fresh, matches, strict=True) if m]
        other = [w for w, m in zip(fresh, matches, strict=True) if not m]
        ids, sizes = self._divided([m for m in matches if m]) if plain else (np.empty(0, np.uint32), np.empty(0, np.int64))
        found = [np.array(e.ids, np.uint32) for k in range(0, len(other), 4096) for e in self.tokenizer.encode_batch_fast(other[k : k + 4096], add_special_tokens=False)]
        ids = np.concatenate([ids, *found])
        sizes = np.concatenate([sizes, np.fromiter(map(len, found), np.int64, len(found))])
        n = len(self.known)
        stop = int(self.ends[n - 1]) if n else 0
        if n + len(sizes) > len(self.ends):
            self.ends = np.resize(self.ends, 2 * (n + len(sizes)))
        self.ends[n : n + len(sizes)] = stop + np.cumsum(sizes)
        if stop + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (stop + len(ids)))
        self.flat[stop : stop + len(ids)] = ids
        self.known.update(zip([*plain, *other], range(n, n + len(sizes)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """From texts to their ids, one after another, and bounds."""
        if not self.splits:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        counts = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        strings = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.clear()
        known = self.known
        if fresh := [w for w in strings if w not in known]:
            self._learn(fresh)
        at = np.array([known[w] for w in strings], np.int64)
        stop = self.ends[at]
        start = np.where(at > 0, self.ends[at - 1], 0)
        code = coded.indices.to_numpy()
        size = (stop - start)[code]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.flat[ragged(start[code], size)], upto[np.concatenate([[0], np.cumsum(counts)])]


def word_ids(tokenizer_path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """WordIds.encode of this process, which keeps what earlier tasks have learnt."""
    kept = sys.modules.setdefault("lumenseek_word_ids", types.ModuleType("lumenseek_word_ids"))
    by_path = kept.__dict__.setdefault("by_path", {})
    if tokenizer_path not in by_path:
        by_path[tokenizer_path] = WordIds(tokenizer_path)
    return by_path[tokenizer_path].encode


def token_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int | None = 1) -> DataFrame:
    """id_col, piece int, start long, length long, ids binary (little-endian unsigned 32-bit): each document's ids, then
    end_id, cut into pieces of capacity ids where it is longer. A null text counts as empty; without end_id an empty
    document has one piece of length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            upto = np.cumsum(pc.binary_length(texts).to_numpy())
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + TEXT_CHUNK, "right")))
                yield _cut(batch.column(0)[a:b], *encode(texts[a:b]), capacity, end_id)
                a = b

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def _cut(id_column: pa.Array, ids: np.ndarray, bounds: np.ndarray, capacity: int, end_id: int | None) -> pa.RecordBatch:
    n = len(id_column)
    if end_id is not None:
        ids = np.insert(ids, bounds[1:], end_id)
        bounds = bounds + np.arange(n + 1)
    size = np.diff(bounds)
    pieces = np.maximum(1, -(-size // capacity))
    of = np.repeat(np.arange(n), pieces)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    length = np.minimum(size[of] - start, capacity)
    begin = (bounds[of] + start) * 4
    body = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(np.append(begin, len(ids) * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
    columns = [id_column.take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), body.cast(pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids"])


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items from the longest on, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            k = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            with_room[left].append(k)
            mask |= 1 << left
    return bins


def plan_bins(counts: dict[int, int], capacity: int) -> np.ndarray:
    """best_fit of so many items per length, on counts: rows length, first, each, bin, sorted. Item first + i of a length
    (i below the next row's first) goes to bin + i // each. Items of length 0 get bins of their own."""
    done: list[tuple[int, list]] = []  # so many bins, which hold `each` items of a length from number `first` on
    with_room: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin has r left

    def put(room: int, times: int, parts: list) -> None:
        nonlocal mask
        if times and not room:
            done.append((times, parts))
        elif times:
            with_room[room].append((times, parts))
            mask |= 1 << room

    for size in sorted(counts, reverse=True):
        first, left = 0, counts[size]
        while left:
            if size and (fits := mask >> size):
                room = size + (fits & -fits).bit_length() - 1
                times, parts = with_room[room].pop()
                if not with_room[room]:
                    mask &= ~(1 << room)
            else:
                room, times, parts = capacity, left, []
            each = room // size if size else capacity
            # bins that take as many as have room, then one bin that takes what is left
            for take, bins in ((each, min(times, left // each)), (left % each, 1)):
                if take and bins and times and left >= take and (take == each or left < each):
                    put(room - take * size, bins, [*parts, (size, first, take)])
                    parts = [(s, f + bins * n, n) for s, f, n in parts]
                    times, first, left = times - bins, first + bins * take, left - bins * take
            if parts:
                put(room, times, parts)
    rows, at = [], 0
    for times, parts in [*done, *(g for held in with_room for g in held)]:
        rows += [(*part, at) for part in parts]
        at += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def planned(sizes: np.ndarray, nth: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """The bins of items by their sizes and numbers among the items of their size."""
    start = plan[:, 0] << 44 | plan[:, 1]
    _, first, each, at = plan[np.searchsorted(start, sizes << 44 | nth, "right") - 1].T
    return at + (nth - first) // each


def pack_items(keys: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first, of unique keys: for each item the smallest key in its bin, its offset and the bin's fill."""
    order = np.lexsort((keys, sizes))
    values, first, counts = np.unique(sizes[order], return_index=True, return_counts=True)
    nth = np.empty(len(sizes), np.int64)
    nth[order] = np.arange(len(sizes)) - np.repeat(first, counts)
    bins = planned(sizes, nth, plan_bins(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity)) if len(sizes) else nth
    order = np.lexsort((keys, -sizes, bins))
    number = np.cumsum(first_of_runs(bins[order])) - 1
    begin = np.flatnonzero(first_of_runs(bins[order]))
    upto = np.cumsum(sizes[order]) - sizes[order]
    least, fill, offset = (np.empty(len(sizes), np.int64) for _ in range(3))
    if len(sizes):
        offset[order] = upto - upto[begin][number]
        fill[order] = np.add.reduceat(sizes[order], begin)[number]
        least[order] = np.minimum.reduceat(keys[order], begin)[number]
    return least, offset, fill


PLACED = "key long, size long, bin long, offset long, fill long, node int"


def assign_sequences(pieces: DataFrame, capacity: int) -> DataFrame:
    """key long, sequence_id long, offset long for pieces (key long, unique and not null; length long, capacity at
    most). A sequence's id is the smallest key in it; a piece of full length is a sequence of its own."""
    whole = pieces.where(F.col("length") >= capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def rows(keys: np.ndarray, sizes: np.ndarray, node: int) -> pa.Table:
        least, offset, fill = pack_items(keys, sizes, capacity)
        return pa.table({"key": pa.array(keys), "size": pa.array(sizes), "bin": pa.array(least), "offset": pa.array(offset), "fill": pa.array(fill), "node": pa.array(np.full(len(keys), node, np.int32))})

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            keys, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from rows(keys, sizes, TaskContext.get().partitionId()).to_batches(1 << 16)

    def node(table: pa.Table) -> pa.Table:
        return rows(table.column("key").to_numpy(), table.column("size").to_numpy(), table.column("parent")[0].as_py())

    full = F.col("fill") >= capacity * (1 - LACKS)
    sequences = lambda placed: placed.where(full).select("key", F.col("bin").alias("sequence_id"), "offset")
    left = lambda placed: placed.where(~full).select("key", "size", (F.col("node") / FAN).cast("int").alias("parent"))
    leaves = stored(pieces.where(F.col("length") < capacity).select("key", "length").mapInArrow(leaf, PLACED), "leaf-bins")
    out, level = whole.unionByName(sequences(leaves)), leaves
    n = (leaves.agg(F.max("node")).first()[0] or 0) + 1
    while level is leaves or n > FAN:
        level = stored(left(level).groupBy("parent").applyInArrow(node, PLACED), "node-bins")
        out, n = out.unionByName(sequences(level)), -(-n // FAN)
    return out.unionByName(_root_bins(left(level), capacity))


def _root_bins(items: DataFrame, capacity: int) -> DataFrame:
    """key, sequence_id, offset of items (key, size) packed by a plan on their counts per size."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            size = b.column(1).to_numpy()
            order = np.argsort(size, kind="stable")
            values, first, counts = np.unique(size[order], return_index=True, return_counts=True)
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) + np.repeat(seen[values] - first, counts)
            seen[values] += counts
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), task, np.int32)), pa.array(nth)], ["key", "size", "task", "nth"])

    parts = stored(items.select("key", "size").mapInArrow(number, "key long, size long, task int, nth long"), "numbered-bins")
    counts = parts.groupBy("size", "task").agg(F.count(F.lit(1)).alias("n"))
    plan = plan_bins({r.size: r.n for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity)
    # an item's number among all of its size: its number in its task after those of the tasks before
    before = counts.select("size", "task", (F.sum("n").over(W.partitionBy("size").orderBy("task")) - F.col("n")).alias("before"))
    numbered = parts.join(before, ["size", "task"]).select("key", "size", (F.col("before") + F.col("nth")).alias("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = planned(b.column(1).to_numpy(), b.column(2).to_numpy(), plan)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(bins)], ["key", "size", "bin"])

    inside = W.partitionBy("bin")
    offset = F.sum("size").over(inside.orderBy(F.desc("size"), "key").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    return numbered.mapInArrow(place, "key long, size long, bin long").select("key", F.min("key").over(inside).alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int | None = 1, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per piece of each document: id_col, piece, start, length, the columns of carry (expressions over a
    piece's `ids`, for example {"ids": F.col("ids")}), sequence_id and offset.

    Null and empty texts give one piece with end_id alone. Repeated rows and ids are packed as often as they occur; a
    null id stays null. Other columns of docs are not read. An empty table gives an empty table.
    """
    carry = carry or {}
    cut = token_pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)
    pieces = cut.select(F.monotonically_increasing_id().alias("key"), id_col, "piece", "start", "length", *(c.alias(n) for n, c in carry.items()))
    pieces = stored(pieces, "pieces")
    return pieces.join(assign_sequences(pieces, capacity), "key").drop("key")
