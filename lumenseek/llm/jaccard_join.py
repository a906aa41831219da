"""Exact Jaccard join of shingle sets in their metric space, up to connected components.

The distance 1 - J is a metric: pivots cut it into Voronoi regions, and the triangle inequality says which documents
near a border must also be copied into another region. Unrelated documents are at distance exactly 1 from all pivots,
so a document is measured only against pivots that it shares a rare shingle with:

1. Documents of equal sets are one. Blocks of documents learn in how many sets each shingle is. A set's elements are
   ordered from the rarest on; linked sets share one of the first n - ceil(n * percent / 100) + 1 of them, so a set
   without such a shingle in common with any other is done.
2. Of all sets that share such a shingle, the one of the smallest signature is its pivot; a set goes to the region of
   each pivot that it has this way, so linked sets meet in a region. Nothing is closed transitively before it is verified.
3. A region of more than REGION elements is cut at up to FAN pivots of its own, in proportion to its size: a set goes to
   its nearest pivot and to those at most twice the radius farther. A set within the radius of its pivot is linked with
   it; it is not copied to pivots that are connected with its own. Cells too large are cut again, and a region whose cells
   are hardly smaller (all sets are near each other, but few linked) is tiled: each two of its chunks meet in one task.
4. In a region's task, sets not yet covered become pivots one after another, every set belongs to the nearest, and sets
   of two cells are compared only where their distances to both pivots allow a link, and not if connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseek.llm.blocks import ANSWER, QUESTION, Block, bucket_count, cut, first_of_runs, packed, question_batch
from lumenseek.llm.components import components
from lumenseek.llm.hashing import BASES, Runs, Words, mix, ragged
from lumenseek.llm.scratch import discard, stored

#: Elements of a region that one task joins; a set counts as LEAST at least, which bounds the sets of a region as well.
REGION, LEAST = 1 << 17, 64
#: Pivots that a region is cut at, at most; larger regions are cut again.
FAN = 64
#: Elements of the regions that are joined by one call, and sets of a region that are measured by one call.
CALL, CHUNK = 1 << 19, 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Sets:
    """Distinct shingle hashes of a block's documents: of document d, item[first[d]:first[d + 1]], in hash order."""

    def __init__(self, block: Block, shingle: int):
        w = Words(_LOWER[block.data], block.bounds)
        runs = Runs(w.hashes())
        left = np.repeat(w.first[1:], w.count) - np.arange(len(w))
        full = np.flatnonzero(left >= shingle)
        short = np.flatnonzero((w.count > 0) & (w.count < shingle))
        hashed = np.concatenate([runs.hash(full, full + shingle), runs.hash(w.first[:-1][short], w.first[1:][short])])
        doc = np.concatenate([w.doc[full], short])
        n = len(block.ids)
        bits = np.uint64(max(1, int(n).bit_length()))
        order = np.argsort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (hashed >> bits), kind="stable")
        hashed, doc = hashed[order], doc[order]
        new = first_of_runs(hashed, doc)
        self.item, self.doc = hashed[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        self.size = np.diff(self.first)

    def signatures(self) -> np.ndarray:
        """Two int64 per document that agree where sets are equal."""
        sums = [np.zeros(len(self.size), np.uint64) for _ in BASES]
        for s, base in zip(sums, BASES, strict=True):
            np.add.at(s, self.doc, mix(self.item + np.uint64(base)))
        return np.stack(sums).view(np.int64)


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps, byte plane by byte plane (the high ones are mostly zero), and their counts, compressed."""
    import zstandard

    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    body = np.ascontiguousarray(gaps).tobytes() + np.minimum(counts, 65535).astype(np.uint16).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack_keys(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    n = len(raw) // 10
    gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64), raw[8 * n :].view(np.uint16)


def rarity(count: np.ndarray) -> np.ndarray:
    """A uint8 that grows with count: counts up to 32 themselves, above 16 steps per doubling."""
    return np.where(count <= 32, count, np.minimum(255, 32 + np.floor(16 * np.log2(np.maximum(count, 32) / 32)))).astype(np.uint8)


def prefix_size(size: np.ndarray, percent: int) -> np.ndarray:
    """Of how many elements, in any order common to all sets, linked sets share one."""
    return size - -(-size * percent // 100) + 1


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


class Region:
    """Sets with identifiers, of `size` elements each, `held` of which lie in flat: the others are in no other set.

    join() gives edges that connect what links connect."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, flat: np.ndarray, held: np.ndarray, percent: int):
        self.ids, self.percent, self.radius = ids, percent, 1 - percent / 100 + 1e-9
        self.size = size
        order = np.argsort(flat, kind="stable")
        new = first_of_runs(flat[order])
        number = np.empty(len(flat), np.int32)
        number[order] = np.cumsum(new, dtype=np.int32) - 1
        shared = np.bincount(number) > 1
        place = np.cumsum(shared, dtype=np.int32) - 1
        keep = shared[number]
        owner = np.repeat(np.arange(len(size), dtype=np.int32), held)
        self.held = np.bincount(owner[keep], minlength=len(size))
        self.bounds = np.concatenate([[0], np.cumsum(self.held)])
        #: elements of each set, and the sets of each element
        self.element = place[number[keep]]
        self.owner = owner[order][keep[order]]
        self.having = np.bincount(self.element, minlength=int(shared.sum()))
        self.from_ = np.cumsum(self.having) - self.having
        self.mark = np.zeros(len(self.having), bool)
        self.parent = np.arange(len(ids))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return int(x)

    def met(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets at a distance below 1 from set x, itself included, and their distances."""
        own = self.element[self.bounds[x] : self.bounds[x + 1]]
        both = np.bincount(self.owner[ragged(self.from_[own], self.having[own])], minlength=len(self.ids))
        both[x] = self.size[x]
        others = np.flatnonzero(both)
        both = both[others]
        return others, 1 - both / (self.size[x] + self.size[others] - both)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set x with others."""
        own = self.element[self.bounds[x] : self.bounds[x + 1]]
        self.mark[own] = True
        hits = np.concatenate([[0], np.cumsum(self.mark[self.element[ragged(self.bounds[others], self.held[others])]])])
        self.mark[own] = False
        return np.diff(hits[np.concatenate([[0], np.cumsum(self.held[others])])])

    def join(self) -> list[tuple[int, int]]:
        n = len(self.ids)
        edges: list[tuple[int, int]] = []

        def link(x: int, y: int) -> None:
            a, b = self.find(x), self.find(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                edges.append((int(self.ids[x]), int(self.ids[y])))

        # pivots until every set is within the radius of one; a set's cell is that of the nearest
        cell, nearest = np.full(n, -1), np.full(n, np.inf)
        pivots: list[int] = []
        met: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for p in range(n):
            if cell[p] >= 0:
                continue
            others, gaps = self.met(p)
            both = np.rint((1 - gaps) * (self.size[p] + self.size[others]) / (2 - gaps)).astype(np.int64)
            inside = linked(both, self.size[p], self.size[others], self.percent)
            near = others[inside]
            for y in near.tolist():
                link(p, y)
            closer = gaps[inside] < nearest[near]
            cell[near[closer]], nearest[near[closer]] = len(pivots), gaps[inside][closer]
            met[len(pivots)] = others, gaps
            pivots.append(p)
        members = np.bincount(cell, minlength=len(pivots))
        # a pivot alone in its cell has been compared with all
        met = {a: x for a, x in met.items() if members[a] > 1}

        def distance(a: int, sets: np.ndarray) -> np.ndarray:
            if a not in met:
                return np.ones(len(sets))
            others, gaps = met[a]
            at = np.minimum(np.searchsorted(others, sets), len(others) - 1)
            return np.where(others[at] == sets, gaps[at], 1.0)

        is_pivot = np.zeros(n, bool)
        is_pivot[pivots] = True
        for a, (others, gaps) in met.items():
            home = others[(cell[others] == a) & ~is_pivot[others]]
            if not len(home):
                continue
            inside = distance(a, home)
            # what lies outside the cell within reach of its farthest member
            window = others[(gaps <= inside.max() + self.radius) & (cell[others] > a) & ~is_pivot[others]]
            for y in window.tolist():
                if self.find(y) == self.find(pivots[a]):
                    continue
                own = distance(a, np.array([y])), distance(cell[y], np.array([y]))
                close = home[(np.abs(inside - own[0]) <= self.radius) & (np.abs(distance(cell[y], home) - own[1]) <= self.radius)]
                if not len(close):
                    continue
                hits = close[linked(self.common(y, close), self.size[y], self.size[close], self.percent)]
                if len(hits):
                    link(int(hits[0]), y)
        return edges


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of sets one after another, without a copy, and how many each set has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint64)[bounds[0] // 8 : bounds[-1] // 8], np.diff(bounds).astype(np.int64) // 8


CELL = "region string, id long, cell string, open boolean, a long, b long"


def measure(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Rows of CELL for sets of one region (left: region, id, n, items) and its pivots (right: pivot, size, elements).

    A row with a cell places a set there; open says that it may link with something there that it is not known to be
    connected with. A row with a and b is a link, or a connection of two pivots over a set linked with both."""
    radius = 1 - percent / 100 + 1e-9
    empty = pa.table({"region": pa.array([], pa.string()), "id": pa.array([], pa.int64()), "cell": pa.array([], pa.string()), "open": pa.array([], pa.bool_()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not left.num_rows or not right.num_rows:
        return empty
    right = right.sort_by("pivot")
    pivots = right.column("pivot").to_numpy()
    flat, held = _flat(left.column("items"))
    size, ids = left.column("n").to_numpy(), left.column("id").to_numpy()
    ends = np.concatenate([[0], np.cumsum(held)])
    gaps = np.empty((len(pivots), len(size)))
    near = np.empty((len(pivots), len(size)), bool)
    for j, (pivot, n, raw) in enumerate(zip(pivots, right.column("size").to_pylist(), right.column("elements").to_pylist(), strict=True)):
        other = np.frombuffer(raw, np.uint64)  # in order
        at = np.minimum(np.searchsorted(other, flat), max(len(other) - 1, 0))
        hits = np.concatenate([[0], np.cumsum(other[at] == flat)]) if len(other) else np.zeros(len(flat) + 1, np.int64)
        both = hits[ends[1:]] - hits[ends[:-1]]
        both[ids == pivot] = n
        gaps[j] = 1 - both / (size + n - both)
        near[j] = linked(both, size, n, percent)
    home = gaps.argmin(axis=0)
    core = near[home, np.arange(len(size))]
    # pivots connected over sets of this call
    group = np.arange(len(pivots))
    ties = []
    for j in range(len(pivots)):
        for k in np.unique(home[near[j] & core]).tolist():
            if group[k] != group[j]:
                ties.append((pivots[j], pivots[k]))
                group[group == group[k]] = group[j]
    window = gaps <= gaps[home, np.arange(len(size))] + 2 * radius
    known = core & (group[:, None] == group[home][None, :])
    copied = window & ~known
    copied[home, np.arange(len(size))] = True
    to, row = np.nonzero(copied)
    region = left.column("region").to_pylist()
    links = [*ties, *((int(ids[x]), int(pivots[home[x]])) for x in np.flatnonzero(core).tolist() if ids[x] != pivots[home[x]])]
    is_open = ~(core[row] & (home[row] == to))
    placed = pa.table({
        "region": pa.array([region[x] for x in row.tolist()], pa.string()), "id": pa.array(ids[row]), "cell": pa.array([f"{region[x]}.{j}" for x, j in zip(row.tolist(), to.tolist(), strict=True)], pa.string()),
        "open": pa.array(is_open), "a": pa.nulls(len(row), pa.int64()), "b": pa.nulls(len(row), pa.int64()),
    })
    n = len(links)
    found = pa.table({
        "region": pa.array(region[:1] * n, pa.string()), "id": pa.nulls(n, pa.int64()), "cell": pa.nulls(n, pa.string()), "open": pa.nulls(n, pa.bool_()),
        "a": pa.array([int(x) for x, _ in links], pa.int64()), "b": pa.array([int(y) for _, y in links], pa.int64()),
    })
    return pa.concat_tables([placed, found])


def cut_regions(sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Regions (region, id, n, items, weight) none of which weighs more than REGION, and edges found on the way."""
    small: list[DataFrame] = []
    edges: list[DataFrame] = []
    while True:
        total = stored(sets.groupBy("region").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("m"), F.min("id").alias("root")), "region-sizes")
        if not total.where(F.col("total") > REGION).head(1):
            small.append(sets)
            break
        large = total.where(F.col("total") > REGION).withColumn("pivots", F.least(F.lit(FAN), F.ceil(4 * F.col("total") / REGION))).withColumn("chunks", F.ceil(F.col("m") / CHUNK)).withColumn("tiles", F.ceil(2 * F.col("total") / REGION))
        small.append(sets.join(large.select("region"), "region", "left_anti"))
        inside = sets.join(large, "region")
        # pivots: the first of the region, and a sample by hash
        sampled = F.pmod(F.xxhash64("id", "region"), F.col("m")) < F.col("pivots")
        pivots = inside.where(sampled | (F.col("id") == F.col("root"))).select(F.col("region").alias("of"), F.col("id").alias("pivot"), F.col("n").alias("size"), F.col("items").alias("elements"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part"))
        dealt = inside.select("region", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), "id", "n", "items")
        met = dealt.groupBy("region", "chunk").cogroup(pivots.groupBy("of", "part"))
        placed = stored(met.applyInArrow(lambda left, right: measure(left, right, percent), CELL), "region-cells")
        edges.append(placed.where("a IS NOT NULL").select("a", "b"))
        # a cut counts if its cells are smaller by half, and hold no more than two copies of a set on average
        weighed = placed.where("cell IS NOT NULL").join(sets.select("region", "id", "weight"), ["region", "id"])
        cells = stored(weighed.groupBy("region", "cell").agg(F.sum("weight").alias("total"), F.max("open").alias("open")), "cell-sizes")
        good = cells.groupBy("region").agg(F.max("total").alias("most"), F.sum("total").alias("all")).join(large, "region")
        good = stored(good.where((2 * F.col("most") <= F.col("total")) & (F.col("all") <= 2 * F.col("total"))).select("region"), "good-cuts")
        moved = placed.where("cell IS NOT NULL").select("region", "id", "cell").join(good, "region").join(cells.where("open").select("region", "cell"), ["region", "cell"])
        again = moved.join(sets, ["region", "id"]).select(F.col("cell").alias("region"), "id", "n", "items", "weight")
        number = F.pmod(F.xxhash64("id", F.lit(7)), F.col("tiles"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
        tiled = inside.join(good, "region", "left_anti").select("region", "id", "n", "items", "weight", number.alias("i"), other.alias("j"))
        tiled = tiled.select(F.concat_ws("/", "region", F.least("i", "j"), F.greatest("i", "j")).alias("region"), "id", "n", "items", "weight")
        small.append(stored(tiled, "region-tiles"))
        sets = stored(again, "region-sets")
    out = small[0]
    for x in small[1:]:
        out = out.unionByName(x)
    return out, edges


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles long and component_id long (the smallest id reachable by links, itself included) for every row.

    A set holds the distinct runs of `shingle` words (A-Z in lower case) of the whole text; with fewer words, all of them
    as one. Two documents link when 100 * intersection >= percent * union. Null and empty texts, and texts of white space
    only, have no shingles and link with nothing. Rows of equal sets link whatever their ids; a null id never is a
    component's, and its row comes out with a null component unless it is linked with a row that has one. Rows that share
    an id are documents of their own. Other columns are not read. An empty table gives an empty table.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = packed(rows, "id", "text")
    buckets = bucket_count(rows, "text", 1 / 6)
    # keys have some 8 bits more than are needed to number all shingles: one in 256 seems shared that is not
    shift = np.uint64(64 - min(64, (buckets << 19).bit_length() + 8))

    # classes of equal sets
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Block.load(blob.as_buffer())
                sets = _Sets(own, shingle)
                node, more = sets.signatures()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.ids), number)), pa.array(np.arange(len(own.ids))), own.id_column(), pa.array(sets.size.astype(np.int64)), pa.array(node), pa.array(more)], ["block", "row", "id", "n", "node", "more"])

    every = stored(blocks.select("block", "blob").mapInArrow(describe, "block long, row long, id long, n long, node long, more long"), "sets")
    classes = every.where("n > 0").groupBy("node", "more", "n").agg(F.min(F.struct("block", "row")).alias("at"), F.min("id").alias("rep"))
    classes = stored(classes.select("node", "more", "n", "rep", "at.block", "at.row"), "set-classes")
    # a set can link with a different one only if one element more leaves it similar enough
    able = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    chosen = able.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "node"))).alias("rows"))
    chosen = blocks.join(chosen, "block").select("block", "blob", F.col("rows.row").alias("rows"), F.col("rows.node").alias("nodes"))

    def sets_of(blob: pa.Scalar, rows: pa.Scalar) -> tuple[_Sets, np.ndarray, np.ndarray, np.ndarray]:
        """The sets of chosen rows, and the distinct keys of their elements in order, their places and counts."""
        sets = _Sets(Block.load(blob.as_buffer()).take(np.asarray(rows.values)), shingle)
        keys, place, counts = np.unique(sets.item >> shift, return_inverse=True, return_counts=True)
        return sets, keys, place, counts

    def question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                _, keys, _, counts = sets_of(blob, rows)
                bounds = cut(keys << shift, buckets)
                yield question_batch([(int(b), number, pack_keys(keys[bounds[b] : bounds[b + 1]], counts[bounds[b] : bounds[b + 1]])) for b in np.flatnonzero(np.diff(bounds))])

    def counted(table: pa.Table) -> pa.Table:
        parts = [unpack_keys(x.as_buffer()) for x in table.column("payload")]
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        new = first_of_runs(keys[order])
        group = np.cumsum(new) - 1
        sums = np.bincount(group, weights=np.concatenate([c for _, c in parts])[order])
        out = np.empty(len(keys), np.uint8)
        out[order] = rarity(sums)[group]
        given = np.split(out, np.cumsum([len(k) for k, _ in parts])[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "answer": pa.array([x.tobytes() for x in given], pa.binary())})

    answers = chosen.select("block", "blob", "rows").mapInArrow(question, QUESTION).groupBy("bucket").applyInArrow(counted, ANSWER)
    answers = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))

    # sets that share a rare shingle: their shared elements, and the rare ones among them
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, rows, nodes, given in zip(*batch.columns, strict=True):
                sets, keys, place, _ = sets_of(blob, rows)
                rare = np.frombuffer(b"".join(x["answer"] for x in given.as_py()), np.uint8)[place]
                assert len(rare) == len(sets.item)
                order = np.lexsort((sets.item, rare, sets.doc))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - sets.first[sets.doc]
                shared = rare > 1
                key = shared & (rank < prefix_size(sets.size, percent)[sets.doc])
                node = np.asarray(nodes.values)
                active = np.unique(sets.doc[key])
                rows_of = lambda which, d: sets.item[sets.first[d] : sets.first[d + 1]][which[sets.first[d] : sets.first[d + 1]]].tobytes()
                for k in range(0, len(active), CHUNK):
                    part = active[k : k + CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(sets.size[part].astype(np.int64)), pa.array([rows_of(shared, d) for d in part], pa.binary()), pa.array([rows_of(key, d) for d in part], pa.binary())], ["id", "n", "items", "keys"])

    active = chosen.join(answers, "block").select("blob", "rows", "nodes", "answers").mapInArrow(share, "id long, n long, items binary, keys binary")
    active = stored(active, "active-sets")
    discard(blocks)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, count = _flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), count))], ["key", "id"])

    keyed = active.select("id", "keys").mapInArrow(keys_of, "key long, id long")
    pivots = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "pivot")
    regions = keyed.join(pivots, "key").select("pivot", "id").distinct()
    sets = regions.join(active.select("id", "n", "items"), "id").select(F.col("pivot").cast("string").alias("region"), "id", "n", "items")
    sets = stored(sets.withColumn("weight", F.greatest(F.octet_length("items") / 8, F.lit(LEAST)).cast("long")), "region-sets")
    discard(active)
    sets, edges = cut_regions(sets, percent)

    def join(table: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        table = table.sort_by("region")
        new = first_of_runs(np.asarray(table.column("region").to_pylist(), object))
        bounds = [*np.flatnonzero(new).tolist(), table.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            part = table.slice(a, b - a)
            found += Region(part.column("id").to_numpy(), part.column("n").to_numpy(), *_flat(part.column("items")), percent).join()
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    calls = max(1, (sets.agg(F.sum("weight")).first()[0] or 0) // CALL)
    edges.append(sets.withColumn("call", F.pmod(F.xxhash64("region"), F.lit(calls))).groupBy("call").applyInArrow(join, "a long, b long"))
    links = edges[0]
    for x in edges[1:]:
        links = links.unionByName(x)
    reached = components(links)
    least = classes.join(reached, "node")
    least = stored(least.join(least.groupBy("component").agg(F.min("rep").alias("least")), "component").select("node", "more", "n", "least"), "components")
    found = classes.join(least, ["node", "more", "n"], "left").select("node", "more", "n", F.coalesce("least", "rep").alias("component_id"))
    out = every.join(found, ["node", "more", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
