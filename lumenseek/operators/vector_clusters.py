"""Exact nearest neighbours that leave vectors out: clusters with a centre and a radius.

Every vector lies with its nearest centre; a cluster's radius is its farthest member. A query at distance d from a centre
is at least d - radius from every member, so it visits clusters from the nearest bound on and needs none whose bound lies
beyond its k-th distance. First it visits the cluster of the least bound, which gives it a k-th distance, then all others
that this leaves. Centres and radii, some CENTRES rows whatever the number of vectors, are sent to every task; vectors and
queries are not: a query goes as a row to each cluster that it visits.

Vectors that are null or have components that are null or not finite, and those of another length than the centres, are
near nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lumenseek.functions.numeric import l2

#: Centres at most, vectors that they are drawn from, and rounds in which they move to the mean of what is near them.
CENTRES, SAMPLE, ROUNDS = 256, 20_000, 6
#: Queries of which a task writes out at once which clusters they visit.
QUERIES = 64
#: Members of a cluster that one task compares with its queries at once.
TILE = 4096
#: Distances in another order of summation may differ by this part.
ROUNDING = 1e-9


def centres(vectors: DataFrame, vector_col: str, count: int = CENTRES, sample: int = SAMPLE) -> np.ndarray:
    """Means of a sample (the `sample` vectors of the smallest hash), by Lloyd's rounds from the first of them. The sample
    only says where clusters lie: answers do not depend on it."""
    rows = _plain(vectors, vector_col).orderBy(F.xxhash64("_v"), "_v").limit(sample).collect()
    if not rows:
        return np.empty((0, 0))
    sizes = [len(r[0]) for r in rows]
    dims = max(set(sizes), key=sizes.count)
    held = np.array([r[0] for r in rows if len(r[0]) == dims], np.float64)
    out = np.unique(held, axis=0)[:: max(1, len(held) // max(1, min(count, len(held) // 8)))][:count].copy()
    for _ in range(ROUNDS):
        near = np.argmin(((held * held).sum(1)[:, None] - 2 * held @ out.T + (out * out).sum(1)[None]), axis=1)
        size = np.bincount(near, minlength=len(out))
        total = np.zeros_like(out)
        np.add.at(total, near, held)
        out = total[size > 0] / size[size > 0, None]
    return out


def _plain(vectors: DataFrame, vector_col: str, *keep: str) -> DataFrame:
    """keep, _v: vectors as doubles, without those that are near nothing."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & F.coalesce(fine, F.lit(False))).select(*keep, v.alias("_v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _cut(batches: Iterator[pa.RecordBatch], rows: int = QUERIES) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _near(rows: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Distances of rows to each centre."""
    square = (rows * rows).sum(1)[:, None] - 2 * rows @ middle.T + (middle * middle).sum(1)[None]
    return np.sqrt(np.maximum(square, 0))


def clustered(vectors: DataFrame, middle: np.ndarray, *, id_col: str = "id", vector_col: str = "vector", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, keep, cluster int, at double (distance from its centre), _v."""
    dims = middle.shape[1] if middle.ndim == 2 else 0
    plain = _plain(vectors, vector_col, id_col, *keep).where(F.size("_v") == dims)
    schema = StructType([*(f for f in plain.schema if f.name != "_v"), StructField("cluster", IntegerType()), StructField("at", DoubleType()), plain.schema["_v"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, 1024):
            rows = _matrix(batch.columns[-1], dims)
            near = _near(rows, middle).argmin(axis=1)
            at = np.sqrt(((rows - middle[near]) ** 2).sum(axis=1)) if len(rows) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(near.astype(np.int32)), pa.array(at), batch.columns[-1]], [*batch.schema.names[:-1], "cluster", "at", "_v"])

    return plain.mapInArrow(run, schema)


def nearest_in_clusters(members: DataFrame, middle: np.ndarray, queries: DataFrame, k: int = 10, *, id_col: str = "id", radii: list[tuple[int, float]] | None = None) -> DataFrame:
    """query_id, id, distance, rank of the k nearest members (of clustered()) of each query (query_id, query_vector); ties
    by id. radii: (cluster, radius) of clusters that have members, else they are looked up."""
    dims = middle.shape[1] if middle.ndim == 2 else 0
    if radii is None:
        radii = [tuple(r) for r in members.groupBy("cluster").agg(F.max("at")).collect()]
    reach = np.full(len(middle), -np.inf)
    for cluster, radius in radii:
        reach[cluster] = radius
    asked = _plain(queries.select("query_id", "query_vector"), "query_vector", "query_id").where(F.size("_v") == dims).withColumnRenamed("_v", "q")
    visit = StructType([asked.schema["query_id"], asked.schema["q"], StructField("cluster", IntegerType())])
    have = np.flatnonzero(reach >= 0)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(have[_least(batch, middle, reach, have).argmin(axis=1)].astype(np.int32))], visit.names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _others(batches, middle, reach, have, visit.names)

    if not len(have):
        best = more = _compared(asked.select("query_id", "q", F.lit(0).alias("cluster")).limit(0), members, k, id_col, dims)
    else:
        best = _compared(asked.mapInArrow(first, visit), members, k, id_col, dims)
        beat = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("beat"))
        more = _compared(asked.join(beat, "query_id", "left").select("query_id", "q", "beat").mapInArrow(others, visit), members, k, id_col, dims)
    ranked = W.partitionBy("query_id").orderBy("distance", id_col)
    return best.unionByName(more).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _least(batch: pa.RecordBatch, middle: np.ndarray, reach: np.ndarray, have: np.ndarray) -> np.ndarray:
    """What at least lies between each query (query_id, q) and the members of each cluster."""
    near = _near(_matrix(batch.column(1), middle.shape[1]), middle[have])
    return np.maximum(near * (1 - ROUNDING) - reach[have] - ROUNDING, 0)


def _others(batches: Iterator[pa.RecordBatch], middle: np.ndarray, reach: np.ndarray, have: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """query_id, q, cluster: all visits but the first of queries (query_id, q, beat). A query may visit every cluster, and
    has a copy of its vector for each, so only a few queries are written out at once."""
    for batch in _cut(batches):
        bound = _least(batch, middle, reach, have)
        # a query with fewer than k so far visits all clusters
        beat = batch.column(2).fill_null(np.inf).to_numpy()
        todo = bound <= beat[:, None]
        todo[np.arange(len(batch)), bound.argmin(axis=1)] = False
        i, j = np.nonzero(todo)
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in batch.columns[:2]), pa.array(have[j].astype(np.int32))], names)


def _compared(visits: DataFrame, members: DataFrame, k: int, id_col: str, dims: int) -> DataFrame:
    """query_id, id, distance: the k nearest per visit and tile of a cluster, of visits (query_id, q, cluster)."""
    schema = StructType([visits.schema["query_id"], members.schema[id_col], StructField("distance", DoubleType())])
    # a large cluster is dealt into tiles by hash, and visits go to each of them
    tiles = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64(id_col), F.col("tiles")).cast("int").alias("tile")
    here = members.join(F.broadcast(tiles), "cluster").select("cluster", tile, id_col, "_v")
    sent = visits.join(F.broadcast(tiles), "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "query_id", "q")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": left.column("query_id").slice(0, 0), id_col: right.column(id_col).slice(0, 0), "distance": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        rows = right.sort_by(id_col)
        there = _matrix(rows.column("_v").combine_chunks(), dims)
        asked = _matrix(left.column("q").combine_chunks(), there.shape[1])
        square = (there * there).sum(1)
        out = [empty]
        for a in range(0, len(asked), 256):
            some = asked[a : a + 256]
            rough = square[None] - 2 * some @ there.T + (some * some).sum(1)[:, None]
            least = np.partition(rough, min(k, len(there)) - 1, axis=1)[:, min(k, len(there)) - 1]
            slack = ROUNDING * (1 + square.max() + (some * some).sum(1))
            i, j = np.nonzero(rough <= (least + slack)[:, None])
            gap = there[j] - some[i]
            distance = np.sqrt((gap * gap).sum(axis=1))
            order = np.lexsort((j, distance, i))
            i, j, distance = i[order], j[order], distance[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pa.table({"query_id": left.column("query_id").take(pa.array(i[keep] + a)), id_col: rows.column(id_col).take(pa.array(j[keep])), "distance": pa.array(distance[keep])}))
        return pa.concat_tables(out)

    return sent.groupBy("cluster", "tile").cogroup(here.groupBy("cluster", "tile")).applyInArrow(run, schema)


class VectorIndex:
    """Clustered vectors in a folder of any file system of Spark, in the order of clusters, so that a search reads little
    more than the clusters it visits. Columns of keep lie beside the vectors and may be asked for in conditions."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "id"):
        self.spark, self.folder, self.id_col = spark, folder, id_col

    def build(self, vectors: DataFrame, *, vector_col: str = "vector", keep: tuple[str, ...] = (), count: int = CENTRES) -> None:
        middle = centres(vectors, vector_col, count)
        rows = clustered(vectors, middle, id_col=self.id_col, vector_col=vector_col, keep=keep)
        rows.repartitionByRange("cluster", self.id_col).sortWithinPartitions("cluster").write.option("parquet.block.size", 8 << 20).parquet(f"{self.folder}/members")
        members = self.members().groupBy("cluster").agg(F.max("at").alias("radius"), F.count(F.lit(1)).alias("n"))
        self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(middle)], "cluster int, centre array<double>").join(members, "cluster", "left").coalesce(1).write.parquet(f"{self.folder}/centres")

    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/members")

    def _centres(self) -> list:
        return self.spark.read.parquet(f"{self.folder}/centres").orderBy("cluster").collect()

    def search(self, query: list[float], k: int = 10, where: Column | None = None, seen: dict | None = None) -> DataFrame:
        """id, distance of the k nearest with where; ties by id. seen is told how many vectors there are, and how many lie
        in clusters that were visited."""
        known = [c for c in self._centres() if c.n]
        asked = np.array(query, np.float64)
        bound = {c.cluster: max(float(np.sqrt(((np.array(c.centre) - asked) ** 2).sum())) * (1 - ROUNDING) - c.radius - ROUNDING, 0.0) for c in known if len(c.centre) == len(asked)}
        size = {c.cluster: c.n for c in known}
        order = sorted(bound, key=lambda c: (bound[c], c))
        at = l2(F.col("_v"), F.array(*map(F.lit, asked.tolist())))

        def best(clusters: list[int]) -> DataFrame:
            rows = self.members().where(F.col("cluster").isin(clusters) if clusters else F.lit(False))
            rows = rows if where is None else rows.where(where)
            return rows.select(self.id_col, at.alias("distance")).orderBy("distance", self.id_col).limit(k)

        # clusters from the nearest on until they hold k members, then all within the k-th distance found there
        first, held = [], 0
        while len(first) < len(order) and held < k:
            first.append(order[len(first)])
            held += size[first[-1]]
        found = best(first).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).first()
        visited = [c for c in order if found.n < k or bound[c] <= found.d]
        if seen is not None:
            seen |= {"vectors": sum(size.values()), "visited": sum(size[c] for c in {*first, *visited})}
        return best(visited)

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """nearest_in_clusters() of queries (query_id, query_vector)."""
        known = self._centres()
        middle = np.array([c.centre for c in known])
        return nearest_in_clusters(self.members(), middle, queries, k, id_col=self.id_col, radii=[(c.cluster, c.radius) for c in known if c.n])
