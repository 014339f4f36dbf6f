"""Exact top-k search by distributed histogram selection.

Vectors are turned into integers, floor(scale * x), and scored by inner
product. The queries go block by block (``block_bytes`` of query matrix, which
is what is broadcast); the candidates stay where they are. For a block:

1. Every candidate is scored against every query; each task counts its scores
   in equal bins a query, and the counts are summed over all tasks. The bin
   with the k-th score is the next range; this repeats until bins are one wide,
   which gives each query's exact k-th score and how many of its equals are due.
2. Candidates above the k-th score pass, and those equal to it with the
   smallest ids: of ties, each task passes only as many as are due, which
   cannot lose one of the smallest.

Nothing is approximate, and a group of equal scores, however large, costs each
task at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import store, workers_ready

#: Scores held at once by a task (8 bytes each at most, in a few copies).
_TILE = 1 << 21


def _integers(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors of the rows with an id whose vector has ``dim`` finite components."""
    ids, vectors = batch.column(0), batch.column(1)
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero((lengths == dim) & ids.is_valid().to_numpy(zero_copy_only=False))
    rows = vectors.take(pa.array(keep)).flatten()
    x = rows.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(keep), dim)
    finite = np.isfinite(x).all(axis=1)
    return ids.take(pa.array(keep[finite])).to_numpy(zero_copy_only=False).astype(np.int64), np.floor(scale * x[finite])


def _tiles(batches: Iterator[pa.RecordBatch], block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores, own) a tile: scores[query, candidate] as integers; own marks a query's own id."""
    kind = np.float32 if block["most"] < 1 << 24 else np.float64
    queries, order = block["vectors"].astype(kind), np.argsort(block["ids"])
    step = max(1, _TILE // max(1, len(queries)))
    for batch in batches:
        ids, vectors = _integers(batch, block["vectors"].shape[1], block["scale"])
        for at in range(0, len(ids), step):
            some = ids[at:at + step]
            scores = (queries @ vectors[at:at + step].astype(kind).T).astype(np.int64)
            spot = np.minimum(np.searchsorted(block["ids"], some, sorter=order), len(order) - 1)
            same = np.flatnonzero(block["ids"][order[spot]] == some)
            own = np.zeros(scores.shape, bool)
            own[order[spot[same]], same] = True
            yield some, scores, own


def _count(shared):
    """Counts the scores of each query's present range, in bins of the present width."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        low, width, bins = block["low"][:, None], block["width"], block["bins"]
        n = len(block["ids"])
        total = np.zeros(n * (bins + 1), np.int64)
        base = np.arange(n)[:, None] * (bins + 1)
        for _, scores, own in _tiles(batches, block):
            over = scores - low
            at = over // width
            at[(over < 0) | (over >= block["span"]) | own] = bins
            total += np.bincount((at + base).ravel(), minlength=len(total))
        total = total.reshape(n, bins + 1)[:, :bins]
        q, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(total[q, b])], names=["q", "bin", "n"])
    return run


def _smallest(q: np.ndarray, ids: np.ndarray, due: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the (query, id) pairs, each query's ``due`` smallest ids."""
    order = np.lexsort((ids, q))
    q, ids = q[order], ids[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < due[q]
    return q[keep], ids[keep]


def _select(shared):
    """Passes the candidates above each query's k-th score, and the ties that are due."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        kth, due = block["low"][:, None], block["due"]
        tie_q, tie_ids = np.empty(0, np.int64), np.empty(0, np.int64)
        for ids, scores, own in _tiles(batches, block):
            q, c = np.nonzero((scores > kth) & ~own)
            yield pa.RecordBatch.from_arrays([pa.array(block["ids"][q]), pa.array(ids[c]), pa.array(scores[q, c])],
                                             names=["query_id", "vec_id", "score"])
            q, c = np.nonzero((scores == kth) & ~own)
            tie_q, tie_ids = _smallest(np.append(tie_q, q), np.append(tie_ids, ids[c]), due)
        yield pa.RecordBatch.from_arrays([pa.array(block["ids"][tie_q]), pa.array(tie_ids), pa.array(kth[tie_q, 0])],
                                         names=["query_id", "vec_id", "score"])
    return run


def _largest(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            _, x = _integers(batch, dim, scale)
            most = max(most, float(np.sqrt((x * x).sum(axis=1).max(initial=0))))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["norm"])
    return run


def _search(spark, block: dict, rows: DataFrame, k: int, bins: int) -> DataFrame:
    n = len(block["ids"])
    block |= {"low": np.full(n, -block["most"], np.int64), "due": np.full(n, k, np.int64), "bins": bins}
    span = 2 * block["most"] + 1
    while True:
        block |= {"span": span, "width": -(-span // bins)}
        shared = spark.sparkContext.broadcast(block)
        counts = (rows.mapInArrow(_count(shared), "q long, bin long, n long")
                  .groupBy("q", "bin").agg(F.sum("n").alias("n")).toPandas())  # bounded: queries of a block x bins
        shared.unpersist()
        table = np.zeros((n, bins), np.int64)
        table[counts["q"], counts["bin"]] = counts["n"]
        above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]  # at or above each bin
        enough = above >= block["due"][:, None]
        at = np.where(enough.any(axis=1), bins - 1 - np.argmax(enough[:, ::-1], axis=1), 0)
        higher = np.where(at + 1 < bins, np.take_along_axis(np.pad(above, ((0, 0), (0, 1))), at[:, None] + 1, 1)[:, 0], 0)
        block["low"] = block["low"] + at * block["width"]
        block["due"] = block["due"] - higher
        span = block["width"]
        if span == 1:
            break
    shared = spark.sparkContext.broadcast(block)
    hits = store(rows.mapInArrow(_select(shared), "query_id long, vec_id long, score long"), "hits")
    shared.unpersist()
    return hits


def exact_topk(queries: DataFrame, candidates: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
               k: int = 20, scale: int = 64, block_bytes: int = 8 << 20, bins: int = 128) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` largest inner
    products of floor(scale * x), fewer if there are fewer; ties to smaller ids.

    Ids are integers. A row with a null id, a null vector or a null or
    non-finite component takes no part; a query meets candidates of its own
    dimension, save those with its own id. A query id that repeats counts once,
    by its smallest vector; a candidate row that repeats counts each time. No
    queries or no candidates: an empty result. Other columns are not read. A
    ValueError says if the vectors are too long for exact scores (2**53).
    """
    spark = queries.sparkSession
    workers_ready(spark)
    asked = (queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
             .where("id is not null and v is not null")
             .where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))))
             .groupBy("id").agg(F.min("v").alias("v")))
    asked = store(asked, "queries")
    rows = candidates.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    parts = []
    for dim, n in asked.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():  # one row a dimension
        blocks = max(1, -(-n * max(1, dim) * 8 // block_bytes))
        norm = rows.mapInArrow(_largest(dim, scale), "norm double").agg(F.max("norm")).first()[0] or 0.0
        for b in range(blocks):
            own = asked.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toArrow()
            if not own.num_rows:
                continue
            ids, vectors = _integers(own.combine_chunks().to_batches()[0], dim, scale)
            most = int(np.ceil(norm * np.sqrt((vectors * vectors).sum(axis=1).max(initial=0)))) + 1
            if most >= 1 << 53:
                raise ValueError(f"scores up to {most} are not exact; use a smaller scale")
            parts.append(_search(spark, {"ids": ids, "vectors": vectors, "scale": scale, "most": most}, rows, k, bins))
    hits = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for part in parts:
        hits = hits.union(part) if len(parts) > 1 else part
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
