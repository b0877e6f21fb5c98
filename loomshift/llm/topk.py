"""Exact top-k search by an impact-ordered, score-at-a-time index.

Vectors become whole numbers, `floor(scale * x)`. Each task indexes a few thousand of them: per dimension the
postings (vector, component) lie by descending absolute component, quantised to levels. A query takes
segments of all dimensions by descending impact (|query component| * level) and adds quantised products to
accumulators. What the open segments and the quantisation can still add bounds every score, so
after each round the vectors whose upper bound reaches the k-th best lower bound are the
possible members. Processing stops only when these are few, or nothing is open; they are scored exactly.

Queries are dealt into blocks of a fixed size that are broadcast one after the other, against all vectors.

Defined cases: null ids and null vectors, or vectors with a null or non-finite component, take no part;
vectors of unequal length are compared over the common dimensions; of query rows that share an id the smallest vector
is asked; candidate rows that repeat are all ranked; ties go to the smaller id; an empty table or no query gives an
empty result. Products must fit 63 bits together.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomshift.llm.common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 8192          # vectors indexed together in a task
LEVEL_BITS = 4        # components are quantised to steps of 16
ROUNDS = (0.5, 0.25, 0.125, 0.0625, 0.03, 0.0)  # impact thresholds, as parts of the largest impact
QUERY_BLOCK = 16_384  # queries broadcast at a time


def matrix(column) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(lengths.max(initial=0))
    if (lengths == wide).all():
        return values.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide), np.int64)
    out[np.arange(wide) < lengths[:, None]] = values
    return out


class Index:
    """Impact-ordered postings of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(-np.abs(vectors), axis=0, kind="stable").T.copy()
        at = np.take_along_axis(vectors.T, self.order, axis=1)
        levels = np.abs(at) >> LEVEL_BITS
        # middle of the level, with the sign of the component
        self.impact = np.where(at < 0, -1, 1) * ((levels << LEVEL_BITS) + (1 << LEVEL_BITS >> 1))
        self.bound = -((levels + 1) << LEVEL_BITS)  # ascending, for binary search

    def search(self, own: int, query: np.ndarray, k: int, known: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of vectors that may be among the k best; `known` is a lower bound of the k-th best."""
        n, dims = self.vectors.shape
        dims = min(dims, len(query))
        query = query[:dims]
        weight = np.abs(query)
        acc = np.zeros(n, np.int64)
        done = np.zeros(dims, np.int64)
        top = -self.bound[:dims, 0]
        first = int((weight * top).max(initial=0))
        error = int((weight << LEVEL_BITS).sum())
        members = np.arange(n)
        own_at = np.flatnonzero(self.ids == own)
        by_weight = np.argsort(-weight)
        for part in ROUNDS:
            least = first * part
            for d in by_weight:
                w = int(weight[d])
                if not w or done[d] == n:
                    continue
                to = n if part == 0 else int(np.searchsorted(self.bound[d], -least / w, "right"))
                if to > done[d]:
                    at = slice(done[d], to)
                    acc[self.order[d, at]] += query[d] * self.impact[d, at]
                    done[d] = to
            open_ = [int(weight[d]) * int(-self.bound[d, done[d]]) for d in range(dims) if done[d] < n]
            slack = error + sum(open_)
            rest = acc.copy()
            rest[own_at] = np.iinfo(np.int64).min // 2
            lower = int(np.partition(rest, n - k)[n - k]) - slack if n > k else None
            if known is not None:
                lower = known if lower is None else max(lower, known)
            members = np.flatnonzero(rest + slack >= lower) if lower is not None else np.arange(n)
            if len(members) <= max(4 * k, n // 64):
                break
        members = members[self.ids[members] != own]
        return self.ids[members], self.vectors[members, :dims] @ query


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def searcher(queries, k: int):
    def search(batches):
        query_ids, query_vectors = queries.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query_ids)

        def take(ids, vectors):
            index = Index(ids, vectors)
            for i, own in enumerate(query_ids):
                have = found[i]
                known = int(have[1][-1]) if len(have[1]) == k else None
                more = index.search(own, query_vectors[i], k, known)
                found[i] = best(np.concatenate([have[0], more[0]]), np.concatenate([have[1], more[1]]), k)

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                take(piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(piece.column(1)))
        sizes = [len(ids) for ids, _ in found]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(query_ids, sizes)),
                pa.array(np.concatenate([ids for ids, _ in found])),
                pa.array(np.concatenate([scores for _, scores in found])),
            ], names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """For every query row the k other vectors of highest inner product: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    table = scratch.store(
        vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
        .select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")))
    asked = table.filter("asked").groupBy("vec_id").agg(F.min("v").alias("v"))
    n = asked.count()
    blocks = -(-n // QUERY_BLOCK)
    best_of = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    results = []
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        if not part.num_rows:
            continue
        queries = spark.sparkContext.broadcast((part.column(0).to_numpy(), matrix(part.column(1))))
        found = table.select("vec_id", "v").mapInArrow(searcher(queries, k), "query_id long, vec_id long, score long")
        results.append(scratch.store(found.withColumn("rank", F.row_number().over(best_of)).filter(F.col("rank") <= k)))
        queries.destroy()
    out = results[0] if results else spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    for part in results[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")
