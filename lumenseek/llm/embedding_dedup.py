"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c or more lie within a squared distance of 2 - 2c. After a fixed random rotation the coordinates
are split into blocks; of a pair within that budget, at least one block is within the part of the budget that is
proportional to the block's dimensions. So each block is range-joined alone: its coordinates are cut into cells wider
than the radius, as many coordinates as it takes for the vectors of a label to make small cells; a vector goes to its own
cell and, if within the radius of a border, to the smaller neighbours over it; a pair meets in exactly one cell of each
block. Only a block's coordinates are sent there. Vectors that have a candidate in a cell are then sent to it in full, and
what passes the block's budget is verified exactly on the original vectors in double precision, and counted only in the
first block whose budget it passes. A cell that is still large is tiled: each two of its chunks meet in one task.

Equal vectors are joined once, with their number. Cells emit, per vector, its count and its tree in the cell, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseek.llm.components import components
from lumenseek.llm.scratch import stored

#: Dimensions of a block, and a cell's width in radii.
BLOCK_DIMS, CELL_WIDTH = 8, 3.0
#: Vectors that a cell should hold, and about which part of a label's vectors stay together when one more coordinate is
#: cut; a cell of more than LARGE_CELL vectors is tiled.
CELL_ROWS, CELL_SHARE, LARGE_CELL = 4096, 0.68, 8192
#: Added to squared budgets against rounding; a candidate more costs one verification.
SLACK, FLOAT_SLACK = 1e-7, 1e-6
#: Rows compared at once with all others of a cell.
TILE = 512


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(20240501).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _blocks(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def _budgets(dims: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * (b.stop - b.start) / dims + SLACK for b in _blocks(dims)]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _expanded(lead: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their cells, and whether these are their own: each row's own cell and the smaller ones within the radius."""
    width = CELL_WIDTH * radius
    own = np.floor(lead / width).astype(np.int64)
    low, high = lead - own * width <= radius, (own + 1) * width - lead <= radius
    at, step = np.arange(len(lead)), np.zeros((len(lead), 0), np.int64)
    for d in range(lead.shape[1]):
        # a step up is only open to what has gone down in a coordinate before
        down, up = low[at, d], high[at, d] & (step < 0).any(axis=1)
        k = np.concatenate([np.arange(len(at)), np.flatnonzero(down), np.flatnonzero(up)])
        s = np.concatenate([np.zeros(len(at), np.int64), np.full(int(down.sum()), -1), np.full(int(up.sum()), 1)])
        at, step = at[k], np.column_stack([step[k], s])
    return at, own[at] + step, ~step.any(axis=1)


CELL = "label string, dims int, block int, cell string, home boolean, rep long, copies long, lead binary"


def _to_cells(cosine: float):
    """(rep, label, vector, copies, cuts) to rows of CELL: home says whether it is the own cell, lead has the block's
    coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            cuts = batch.column(4).to_numpy()
            for dims, cut in np.unique(np.stack([sizes, cuts]), axis=1).T.tolist():
                part = batch.take(pa.array(np.flatnonzero((sizes == dims) & (cuts == cut))))
                turned = _units(_matrix(part.column(2))) @ rotation(dims)
                for k, (block, budget) in enumerate(zip(_blocks(dims), _budgets(dims, cosine), strict=True)):
                    at, cells, home = _expanded(turned[:, block][:, :cut], np.sqrt(budget))
                    sent = part.take(pa.array(at))
                    lead = turned[:, block].astype(np.float32)[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            sent.column(1), pa.array(np.full(len(at), dims, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array([",".join(map(str, c)) for c in cells.tolist()], pa.string()),
                            pa.array(home), sent.column(0), sent.column(3), pa.array([x.tobytes() for x in lead], pa.binary()),
                        ],
                        ["label", "dims", "block", "cell", "home", "rep", "copies", "lead"],
                    )

    return run


def _pairs(own: np.ndarray, home: np.ndarray, chunk: np.ndarray, tile: str, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within the budget, of which one at least is at home; of both chunks in a tile of two."""
    squares = (own * own).sum(axis=1)
    two = len(set(tile.split("/"))) > 1
    for a in range(0, len(own), TILE):
        b = min(a + TILE, len(own))
        distance = squares[a:b, None] + squares[None, a:] - 2 * own[a:b] @ own[a:].T
        i, j = np.nonzero(distance <= budget)
        i, j = i + a, j + a
        ok = (j > i) & (home[i] | home[j])
        if two:
            ok &= chunk[i] != chunk[j]
        yield i[ok], j[ok]


def _with_candidate(cosine: float):
    """One cell or tile: the rows that have a candidate there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dims, k = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
        own = np.frombuffer(b"".join(table.column("lead").to_pylist()), np.float32).reshape(table.num_rows, -1).astype(np.float64)
        hit = np.zeros(table.num_rows, bool)
        for i, j in _pairs(own, table.column("home").to_numpy(zero_copy_only=False), table.column("chunk").to_numpy(), table.column("tile")[0].as_py(), _budgets(dims, cosine)[k] + FLOAT_SLACK):
            hit[i] = hit[j] = True
        return table.drop_columns(["lead"]).filter(pa.array(hit))

    return run


def _unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the trees of x[0] and y[0], x[1] and y[1] and so on; root has each place's root, its tree's first place."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]


def _join_cell(cosine: float):
    """One cell: for each linked vector the number of vectors it links with here, copies counted, and the one that stands
    for all that links connect with it here."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        home, chunk = table.column("home").to_numpy(zero_copy_only=False), table.column("chunk").to_numpy()
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        dims, k = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
        vectors = _matrix(table.column("vector").chunk(0) if isinstance(table.column("vector"), pa.ChunkedArray) else table.column("vector"))
        units = _units(vectors)
        turned = units @ rotation(dims)
        blocks, budgets = _blocks(dims), _budgets(dims, cosine)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, j in _pairs(turned[:, blocks[k]], home, chunk, table.column("tile")[0].as_py(), budgets[k] + SLACK):
            for c in range(0, len(i), 1 << 18):
                x, y = i[c : c + (1 << 18)], j[c : c + (1 << 18)]
                gap = turned[x] - turned[y]
                gap *= gap
                passes = [gap[:, s].sum(axis=1) <= t for s, t in zip(blocks, budgets, strict=True)]
                first = np.argmax(np.stack(passes), axis=0)
                here = (first == k) & passes[k]
                here &= (units[x] * units[y]).sum(axis=1) >= cosine
                x, y = x[here], y[here]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                _unite(root, x, y)
        found = np.flatnonzero(links)
        return pa.table({"rep": pa.array(rep[found]), "links": pa.array(links[found]), "joined": pa.array(rep[root[found]])})

    return run


def embedding_classes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """For every row of vectors: id_col, n_links long (other rows linked directly), component_id long (smallest id
    reachable by links, itself included), kept boolean (its id is its component's).

    Rows link if their labels are equal and not null and their cosine is at least `cosine`. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, and vectors of different lengths do not link. Ids must
    be unique and not null to be meaningful: rows with a null id come out with themselves alone, and rows that share an
    id share its links. Other columns are not read. An empty table gives an empty table.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    # floats are doubles, and half as long to send
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.expr("size(vector) > 0 AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(vector, x -> x <> 0)")
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    classes = stored(usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    # as many coordinates are cut as a label's vectors need
    cuts = F.ceil(F.log(F.count(F.lit(1)) / F.lit(float(CELL_ROWS))) / F.lit(-math.log(CELL_SHARE))).cast("int")
    cuts = classes.groupBy("label").agg(F.greatest(F.lit(1), F.least(F.lit(BLOCK_DIMS), cuts)).alias("cuts"))
    sent = classes.join(cuts, "label").select("rep", "label", "vector", "copies", "cuts").mapInArrow(_to_cells(cosine), CELL)
    sent = stored(sent, "vector-cells")
    cell = ["label", "dims", "block", "cell"]
    large = sent.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_CELL).select(*cell, F.ceil(2 * F.col("n") / LARGE_CELL).cast("int").alias("tiles"))
    tiled = sent.join(large, cell, "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("tiles")), F.lit(0)).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))).withColumn("tile", F.concat_ws("/", F.least("chunk", "other"), F.greatest("chunk", "other")))
    tiled = tiled.select(*cell, "tile", "chunk", "home", "rep", "copies", "lead")
    near = tiled.groupBy(*cell, "tile").applyInArrow(_with_candidate(cosine), tiled.drop("lead").schema)
    near = near.join(classes.select("rep", F.col("vector").cast(f"array<{kind}>").alias("vector")), "rep").select(*cell, "tile", "chunk", "home", "rep", "copies", "vector")
    found = near.groupBy(*cell, "tile").applyInArrow(_join_cell(cosine), "rep long, links long, joined long")
    found = stored(found.groupBy("rep").agg(F.sum("links").alias("links"), F.collect_set("joined").alias("joined")), "vector-links")
    linked = components(found.select(F.col("rep").alias("a"), F.explode("joined").alias("b")))
    per_class = classes.select("rep", "copies").join(found.select("rep", "links"), "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    members = usable.select("id", "label", "vector").join(classes.select("label", "vector", "rep"), ["label", "vector"]).select("id", "rep").distinct()
    members = members.join(per_class, "rep").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").join(members, "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
