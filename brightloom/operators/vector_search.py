"""Exact nearest vectors for many queries in one pass over the vectors.

Vectors are packed where they are read into splits, queries into blocks, and each split meets each
block of the same length of vectors once, as a matrix product. Small sets of queries are sent to
the vectors; larger ones meet them on lanes, each of which holds all blocks and its share of the splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import cut_lineage

QUERIES_PER_BLOCK = 512
# Bytes of one split's vectors, and of all queries that may be sent to every executor.
SPLIT_BYTES = 2 << 20
SENT_BYTES = 8 << 20
# Vectors of a split that are scored against a block at once.
SLICE = 4096
SCORE_DIGITS = 9
BEST_TYPE = "query_id string, vector_id string, score double"
PACK_TYPE = "dims int, ids array<string>, spaces array<string>, matrix binary"


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms != 0)


def _packed(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows `(id, embedding, namespace)` of one task as packs of vectors of equal length, scaled to length one.

    Rows without a vector, or with a null in it, are in no pack.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, list, list]]] = {}
        count: dict[int, int] = {}

        def out(dims: int) -> pa.RecordBatch:
            matrices, ids, spaces = zip(*held.pop(dims))
            count.pop(dims)
            matrix = _unit_rows(np.concatenate(matrices))
            row = {"dims": [dims], "ids": [sum(ids, [])], "spaces": [sum(spaces, [])], "matrix": [matrix.tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in batches:
            ids, vectors, spaces = batch.columns
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths[lengths > 0]).astype(int):
                at = pa.array(np.flatnonzero(lengths == dims))
                some = vectors.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                whole = ~np.isnan(some).any(axis=1)  # Arrow hands out nulls as NaN
                some, at = some[whole], at.filter(pa.array(whole))
                names, places = ids.take(at).to_pylist(), spaces.take(at).to_pylist()
                room = max(1, min(most_rows, most_bytes // (8 * dims)))
                start = 0
                while start < len(some):
                    stop = min(len(some), start + room - count.get(dims, 0))
                    held.setdefault(dims, []).append((some[start:stop], names[start:stop], places[start:stop]))
                    count[dims] = count.get(dims, 0) + stop - start
                    start = stop
                    if count[dims] == room:
                        yield out(dims)
        for dims in list(held):
            yield out(dims)

    schema = pa.schema([("dims", pa.int32()), ("ids", pa.list_(pa.string())), ("spaces", pa.list_(pa.string())), ("matrix", pa.binary())])
    return rows.select(F.col("id").cast("string"), "embedding", F.col("namespace").cast("string")).mapInArrow(pack, PACK_TYPE)


def _best(scores: np.ndarray, names: np.ndarray, admitted: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of the `k` best of each column of `scores`; `names` are in the order of ties."""
    if admitted is not None:
        scores = np.where(admitted, scores, -np.inf)
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.full(scores.shape[1], -np.inf)
    query, vector = np.nonzero((scores >= least).T & np.isfinite(scores).T)
    order = np.lexsort((names[vector], -scores[vector, query], query))
    query, vector = query[order], vector[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], vector[place < k]


def _scored(k: int):
    """Best `k` of one split for each query of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dims, ids, spaces, matrix, asked, wanted, questions = (column[r].as_py() for column in batch.columns)
                vectors = np.frombuffer(matrix).reshape(-1, dims)
                questions = np.frombuffer(questions).reshape(-1, dims)
                place = np.empty(len(ids), np.int64)
                place[sorted(range(len(ids)), key=lambda i: ids[i].encode())] = np.arange(len(ids))
                confined = np.array([space is not None for space in wanted])
                spaces, wanted = np.array(spaces, object), np.array(wanted, object)
                found = []
                for start in range(0, len(vectors), SLICE):
                    # Rounded, so that equal vectors score alike wherever they stand in a split.
                    scores = np.round(vectors[start : start + SLICE] @ questions.T, SCORE_DIGITS)
                    admitted = None
                    if confined.any():
                        admitted = (spaces[start : start + SLICE, None] == wanted[None, :]) | ~confined
                    query, vector = _best(scores, place[start : start + SLICE], admitted, k)
                    found.append((query, vector + start, scores[vector, query]))
                query, vector, score = (np.concatenate(x) for x in zip(*found))
                if len(query):
                    names = pa.array(ids, pa.string()).take(pa.array(vector))
                    yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()).take(pa.array(query)), names, pa.array(score)], ["query_id", "vector_id", "score"])

    return run


def nearest_vectors(
    queries: DataFrame, vectors: DataFrame, k: int, queries_per_block: int = QUERIES_PER_BLOCK, sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """The `k` vectors closest by cosine to each query, ties by vector id, with their rank.

    `queries` has `query_id, embedding` and optionally `namespace`, which confines a query to
    one namespace. Filter `vectors` beforehand: the filter then reaches the files. Vectors are read
    once, whatever the number of queries, and are shuffled only if the queries take more than
    `sent_bytes`, as measured on their written table. Vectors of another length than the query's, and
    rows without a vector or with a null in it, are not found; no queries or no vectors give no rows.
    """
    spark = queries.sparkSession
    if "namespace" not in queries.columns:
        queries = queries.withColumn("namespace", F.lit(None).cast("string"))
    asked = cut_lineage(queries.select(F.col("query_id").cast("string").alias("id"), "embedding", F.col("namespace").cast("string").alias("namespace")))
    count, values = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()
    dealt = asked.repartition(max(1, -(-count // queries_per_block)))
    blocks = _packed(dealt, queries_per_block, 4 * SPLIT_BYTES).toDF("dims", "asked", "wanted", "questions")
    splits = _packed(vectors.select(F.col("vector_id").alias("id"), "embedding", "namespace"), 8 * SLICE, SPLIT_BYTES)
    if 8 * values <= sent_bytes:
        met = splits.join(F.broadcast(blocks), "dims")
    else:
        lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
        lane = F.pmod(F.xxhash64("matrix"), F.lit(lanes)).alias("lane")
        everywhere = cut_lineage(blocks).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
        met = splits.select("*", lane).join(everywhere, ["lane", "dims"])
    columns = ["dims", "ids", "spaces", "matrix", "asked", "wanted", "questions"]
    best = met.select(*columns).mapInArrow(_scored(k), BEST_TYPE)
    closest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")
    return best.withColumn("rank", F.row_number().over(closest)).filter(F.col("rank") <= k)


def vectors_by_id(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("vector_id"), "vector_id", "left_semi")
