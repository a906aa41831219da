"""Cost-balanced packing of tokenised documents into sequences without padding.

A piece of n tokens costs linear * n + quadratic * n * n: the layers' work per token and attention inside the piece. The
pieces of a group of documents go, longest first, each to the sequence of the lowest cost so far that has room for it. A
piece that no sequence has room for is cut at the sequence with the most room and its rest waits its turn. A group has as
many sequences as its tokens fill, so all get full; what is left over joins the task's next group, and at a task's end it
fills sequences whose lengths are powers of two, which need no padding either.

Groups hold a bounded number of tokens and lie inside one task, so nothing is shuffled, tokens never move, memory does not
grow with the input and a task that is lost is simply run again.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a group, and characters of a text encoded at once.
GROUP_TOKENS, SEGMENT = 1 << 22, 1 << 20
#: Runs without a place to cut that are longer go to the tokenizer itself.
LONG_RUN = 1 << 14
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. The ratio is that of a model 1024 wide, whose layers
#: spend about 12 * width * width multiplications on a token and 2 * width on each pair inside a piece.
LINEAR, QUADRATIC = 1.0, 1 / (6 * 1024)

#: Code points that have the property White_Space, and the pattern that byte-level pre-tokenizers divide by.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextIds:
    """Ids of whole texts, equal to those of the tokenizer in a file.

    A byte-level tokenizer whose merges come in the order of their ids gives the ids that merging by rank gives, so such a
    file is read as ranks and merged by tiktoken, which is several times faster. Long texts are encoded in segments: the
    pattern never joins a character with white space that follows it, so a text may be cut where white space begins.
    Segments with very long runs, and files of any other kind, are left to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.ranked = self._ranked(json.load(file))
        self._start = re.compile(f"(?<=[^{SPACES}])[{SPACES}]")
        self._runs = re.compile(f"[{SPACES}]{{{LONG_RUN}}}|[^{SPACES}]{{{LONG_RUN}}}")

    @staticmethod
    def _ranked(told: dict):
        """A merger by ranks with the ids of a tokenizer file, or None where the file does not say that both are equal."""
        before, model, added = told.get("pre_tokenizer") or {}, told["model"], told.get("added_tokens") or []
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        divided = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told.get("normalizer")
        special = {t["content"]: t["id"] for t in added}
        bare = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] or re.search(f"[{SPACES}]", t["content"]) for t in added)
        if not (plain and divided and bare):
            return None
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        # every token is a byte or one merge's product, and products come in the order of merges
        if made != sorted(set(made)) or sorted([*made, *(i for t, i in vocab.items() if len(t) == 1)]) != sorted(vocab.values()):
            return None
        import tiktoken

        byte = {c: b for b, c in enumerate(byte_characters())}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens=special)

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = self._start.search(text, at + SEGMENT) if at + SEGMENT < len(text) else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def _encoded(self, segment: str) -> np.ndarray:
        if self.ranked and not (len(segment) >= LONG_RUN and self._runs.search(segment)):
            return self.ranked.encode_to_numpy(segment, allowed_special="all")
        return np.array(self.tokenizer.encode(segment, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if not self.ranked:
            return self._encoded(text)
        parts = [self._encoded(x) for x in self._segments(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint32), *parts])


def byte_characters() -> list[str]:
    """Byte-level alphabets show printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(other)) for b in range(256)]


def text_ids(path: str) -> TextIds:
    """The TextIds of this worker, made once for all its tasks."""
    kept = sys.modules.setdefault("lumenseek_text_ids", types.ModuleType("lumenseek_text_ids")).__dict__
    if path not in kept:
        kept[path] = TextIds(path)
    return kept[path]


Placed = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


def balance(items: list[tuple[int, int, int]], capacities: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[Placed], list[tuple[int, int, int]]]:
    """Items (length, document, start) into sequences of such capacities, and the items left when all are full.

    Longest item first (ties: document, start), each to the sequence of the lowest cost (ties: the first) with room for
    all of it; where none has, as much as fits goes to the sequence with the most room and the rest is an item again."""
    queue = [(-n, doc, start) for n, doc, start in items]
    heapq.heapify(queue)
    room, cost = list(capacities), [0.0] * len(capacities)
    cheap = [(0.0, k) for k in range(len(room))]  # by cost; those too full for the present item wait, by room
    waiting: list[tuple[int, int]] = []
    out: list[Placed] = []

    def put(n: int, doc: int, start: int, k: int) -> None:
        out.append((doc, start, n, k, capacities[k] - room[k]))
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n
        if room[k]:
            heapq.heappush(cheap, (cost[k], k))

    while queue:
        n, doc, start = queue[0][0] * -1, queue[0][1], queue[0][2]
        while waiting and -waiting[0][0] >= n:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(cheap, (cost[k], k))
        while cheap and room[cheap[0][1]] < n:
            k = heapq.heappop(cheap)[1]
            heapq.heappush(waiting, (-room[k], k))
        if cheap:
            heapq.heappop(queue)
            put(n, doc, start, heapq.heappop(cheap)[1])
        elif waiting:
            k = heapq.heappop(waiting)[1]
            fits = room[k]
            heapq.heapreplace(queue, (fits - n, doc, start + fits))
            put(fits, doc, start, k)
        else:
            break
    return out, [(-n, doc, start) for n, doc, start in sorted(queue)]


class Packer:
    """The groups of one task: add() documents one after another, take rows from flush()."""

    def __init__(self, capacity: int, linear: float, quadratic: float, first_sequence: int):
        self.capacity, self.rates, self.next = capacity, (linear, quadratic), first_sequence
        self.docs: list[tuple[object, np.ndarray]] = []
        self.items: list[tuple[int, int, int]] = []
        self.rows: list[Placed] = []
        self.tokens = 0

    def add(self, key: object, ids: np.ndarray) -> None:
        """Whole sequences are taken from the start of a document that is longer; its rest is an item."""
        doc, n, start = len(self.docs), len(ids), 0
        self.docs.append((key, ids))
        while n - start >= self.capacity:
            self.rows.append((doc, start, self.capacity, self.next, 0))
            self.next += 1
            start += self.capacity
        if start < n:
            self.items.append((n - start, doc, start))
        self.tokens += n

    def flush(self, last: bool) -> list[tuple[object, int, np.ndarray, int, int, int]]:
        """(key, start, ids, tokens of the document, sequence, offset) of all that is placed now."""
        total = sum(n for n, _, _ in self.items)
        capacities = [self.capacity] * (total // self.capacity)
        if last:
            rest = total % self.capacity
            capacities += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        placed, left = balance(self.items, capacities, *self.rates)
        self.rows += [(doc, start, n, self.next + k, offset) for doc, start, n, k, offset in placed]
        self.next += len(capacities)
        out = [(self.docs[d][0], start, self.docs[d][1][start : start + n], len(self.docs[d][1]), k, offset) for d, start, n, k, offset in self.rows]
        number = {d: i for i, d in enumerate(sorted({d for _, d, _ in left}))}
        self.docs = [self.docs[d] for d in number]
        self.items = [(n, number[d], start) for n, d, start in left]
        self.rows, self.tokens = [], sum(n for n, _, _ in left)
        return out


SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _batch(rows: list) -> pa.RecordBatch:
    key, start, ids, size, sequence, offset = zip(*rows, strict=True)
    long = lambda x: pa.array(x, pa.int64())
    body = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
    return pa.RecordBatch.from_arrays([long(key), long(start), long([len(x) for x in ids]), body, long(size), long(sequence), long(offset)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack_balanced(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int | None = 1,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: id_col, start long (ids of its document before it), length long, ids binary (little-endian
    unsigned 32-bit), doc_tokens long, sequence_id long, offset long. capacity is a power of two; every sequence is full
    or, for the last of a partition of docs, of a length that is a smaller power of two.

    Null and empty texts have end_id alone, and no row where end_id is None. Repeated rows and ids are packed as often as
    they occur; a null id stays null. Equal lengths go in the order of the rows. Other columns of docs are not read. An
    empty table gives an empty table.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(tokenizer_path).encode
        packer = Packer(capacity, linear, quadratic, TaskContext.get().partitionId() << 36)
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            rows = packer.flush(last)
            for k in range(0, len(rows), 4096):
                yield _batch(rows[k : k + 4096])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(key, np.concatenate([encode(text.as_py() or ""), end]))
                if packer.tokens >= group_tokens:
                    yield from out(False)
        yield from out(True)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
