"""Nearest neighbours among dense vectors, exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type as pa_type
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenseek.functions.numeric import l2, similarity
from lumenseek.operators.common import SMALL_ROWS

#: Query vectors that one block may hold; they are sent to every task.
MAX_QUERIES = 10_000
#: Queries that a batch is compared with at once.
TILE = 256


def nearest(vectors: DataFrame, query: list[float], k: int = 10, *, id_col: str = "id", vector_col: str = "vector", where: Column | None = None, min_score: float = 0.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, distance, score and the columns of carry of the k nearest by L2 among rows for which where holds, which is tested before the limit."""
    rows = vectors if where is None else vectors.where(where)
    distance = l2(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query)))
    rows = rows.where(F.size(vector_col) == len(query)).select(id_col, *carry, distance.alias("distance")).withColumn("score", similarity(F.col("distance")))
    return rows.where(F.col("score") >= min_score).orderBy("distance", id_col).limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """query_id, id, distance, rank for queries (query_id, query_vector): a stated query set against all rows. The set is
    dealt into blocks of about MAX_QUERIES, each sent whole to each task; a batch of rows hands on its best k per query.
    Null vectors, and those of other lengths than a query, are not near it."""
    # twice as many blocks as a full deal needs, since a hash deals unevenly
    count = queries.count()
    blocks = 1 if count <= MAX_QUERIES else -(-2 * count // MAX_QUERIES)
    number = F.pmod(F.xxhash64("query_id", "query_vector"), F.lit(blocks))
    out = [_nearest_block(vectors, queries.where(number == i) if blocks > 1 else queries, k, id_col, vector_col) for i in range(blocks)]
    return reduce(DataFrame.unionByName, out)


def _nearest_block(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    rows = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).where("query_vector IS NOT NULL").collect()
    asked: dict[int, tuple[list, list]] = {}
    for r in rows:
        ids, matrix = asked.setdefault(len(r.query_vector), ([], []))
        ids.append(r.query_id)
        matrix.append(r.query_vector)
    kind = pa_type(queries.schema["query_id"].dataType)
    sent = vectors.sparkSession.sparkContext.broadcast({dims: (pa.array(ids, kind), np.array(matrix, np.float64).reshape(len(ids), dims)) for dims, (ids, matrix) in asked.items()})
    given = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("_vector")).where("_vector IS NOT NULL")
    schema = StructType([queries.schema["query_id"], vectors.schema[id_col], StructField("distance", DoubleType())])
    best = given.mapInArrow(lambda batches: _local_best(batches, sent.value, k), schema)
    order = W.partitionBy("query_id").orderBy("distance", id_col)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _local_best(batches: Iterator[pa.RecordBatch], asked: dict[int, tuple[pa.Array, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Of each batch the k nearest per query, by matrix products and then exact distances of what is near enough."""
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        for dims, (query_ids, queries) in asked.items():
            part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
            n = part.num_rows
            if not n or not k:
                continue
            rows = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
            by_id = np.empty(n, np.int64)
            by_id[pc.sort_indices(part.column(0)).to_numpy()] = np.arange(n)
            squares, asked_squares = (rows * rows).sum(axis=1), (queries * queries).sum(axis=1)
            for a in range(0, len(queries), TILE):
                some = queries[a : a + TILE]
                near = squares[:, None] + asked_squares[None, a : a + TILE] - 2 * rows @ some.T
                least = np.partition(near, min(k, n) - 1, axis=0)[min(k, n) - 1]
                i, j = np.nonzero(near <= least + 1e-9 * (1 + asked_squares[a : a + TILE] + squares.max()))
                gap = rows[i] - some[j]
                distance = np.sqrt((gap * gap).sum(axis=1))
                order = np.lexsort((by_id[i], distance, j))
                i, j, distance = i[order], j[order], distance[order]
                first = np.searchsorted(j, j)
                keep = np.arange(len(j)) - first < k
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(j[keep] + a)), part.column(0).take(pa.array(i[keep])), pa.array(distance[keep])], ["query_id", part.schema.names[0], "distance"])


assert MAX_QUERIES <= SMALL_ROWS
