"""Nearest-neighbour search, metadata filters and context text.

Exact top-k (R1) has two physical strategies, chosen by a size check:

* **broadcast**: when the query block (rows x dim x 8 bytes) is under
  ``broadcast_limit_bytes`` it is shipped once to every task; each task scans
  its slice of the vector table with NumPy block products and keeps a running
  top-k per query, emitting at most ``k`` rows per query per task.
* **blocked**: otherwise queries are hashed into strips of bounded size and vectors
  into parts; each strip meets each part in a sorted run of rows, the strip first,
  and the part's vectors pass it a block at a time. A task holds a strip with its hits and a block,
  and a vector is shuffled once a strip, a query once a part. No cross join, no pair rows.

Either way the final merge is ``row_number() <= k`` over ``(distance, id)``,
which Spark plans as a WindowGroupLimit. Vectors carry only (id, embedding)
through the scan; text and metadata are joined back to the k hits at the end.
"""

from __future__ import annotations

import math
from typing import Any, Dict, Iterator, Optional

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType


DEFAULT_BROADCAST_LIMIT = 256 * 1024 * 1024
#: Bytes of queries that a task holds (as doubles): of the broadcast strategy's, and of a strip.
QUERY_BYTES = 16 << 20
#: Bytes of vectors (as doubles) that pass a strip of queries at a time.
BLOCK_BYTES = 64 << 20
NO_HITS_TEXT = "No relevant information found in the knowledge base."   # fixed value
_QB = 512            # queries per tile
_VB = 1024            # vectors per tile
_SCORED = 1 << 17     # candidates scored exactly at a time


# ---------------------------------------------------------------- R2 filter
def _meta_col(df_cols, key: str) -> Column:
    if key in df_cols:
        return F.col(key)
    if "extra" in df_cols:
        return F.col("extra").getItem(key)
    return F.lit(None)


def compile_where(where: Optional[Dict[str, Any]], df_cols) -> Column:
    """R2: metadata filter dict -> Column. Missing keys: $ne/$nin hold, the rest fail."""
    if not where:
        return F.lit(True)
    parts = []
    for key, cond in where.items():
        if key == "$and":
            parts.append(_all([compile_where(c, df_cols) for c in cond]))
        elif key == "$or":
            parts.append(_any([compile_where(c, df_cols) for c in cond]))
        else:
            c = _meta_col(df_cols, key)
            if not isinstance(cond, dict):
                cond = {"$eq": cond}
            for op, val in cond.items():
                parts.append(_compare(c, op, val))
    return _all(parts)


def _all(cs):
    out = F.lit(True)
    for c in cs:
        out = out & c
    return out


def _any(cs):
    out = F.lit(False)
    for c in cs:
        out = out | c
    return out


def _compare(c: Column, op: str, val) -> Column:
    """Compares as the literal's type; a value that has no such reading does not match."""
    def kind(v) -> str:
        return ("boolean" if isinstance(v, bool) else "decimal(38,10)" if isinstance(v, int)
                else "double" if isinstance(v, float) else "string")

    def read(v) -> Column:
        return c.try_cast(kind(v))

    if op in ("$in", "$nin"):
        hit = F.lit(False)
        for v in val:
            hit = hit | F.coalesce(read(v) == F.lit(v), F.lit(False))
        return hit if op == "$in" else ~hit
    does = {"$eq": lambda x, y: x == y, "$ne": lambda x, y: x == y, "$gt": lambda x, y: x > y, "$gte": lambda x, y: x >= y,
            "$lt": lambda x, y: x < y, "$lte": lambda x, y: x <= y}
    if op not in does:
        raise ValueError(f"unknown filter operator {op}")
    hit = F.coalesce(does[op](read(val), F.lit(val)), F.lit(False))
    return ~hit if op == "$ne" else hit


# ------------------------------------------------------------ block top-k
def usable(v: Column) -> Column:
    """Whether a vector has components, and all of them finite."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _as_matrix(series: pd.Series, dim: int | None = None) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim or 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def _sortable(ids: np.ndarray) -> np.ndarray:
    return ids.astype(str) if ids.dtype == object else ids


def _copies(M: np.ndarray) -> np.ndarray:
    """The number of each row among the different rows."""
    rows = np.ascontiguousarray(M + 0.0).view(np.dtype((np.void, M.itemsize * M.shape[1]))).ravel()
    return np.unique(rows, return_inverse=True)[1].ravel()


def _places(hit: np.ndarray) -> np.ndarray:
    """Flat places of what is true, where little is."""
    flat = hit.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    return (8 * words[:, None] + np.arange(8))[flat.reshape(-1, 8)[words]]


class _TopK:
    """Running exact top-k of squared L2 distance for a fixed query block.

    Work is tiled (``_QB`` queries x ``_VB`` vectors) so memory per tile is
    bounded whatever the block sizes. A tile's distances come from one matrix
    product in single precision (in double where that tells too little apart); every candidate
    at or below the query's k-th smallest, plus what rounding can add, is scored again exactly
    and kept in the query's free slots. Full slots are sorted by (distance, id) and cut to ``k``. So
    ties are never cut, however many there are. Equal queries are searched once, and of
    equal vectors only the ``k`` smallest ids can be hits.

    ``marks``: a row a query; only queries of equal marks count as equal. ``cap``: a distance
    a query beyond which its hits are of no use."""

    def __init__(self, Q: np.ndarray, k: int, marks: np.ndarray | None = None, cap: np.ndarray | None = None):
        self.k, self.of = k, None     # which different query each query is
        self.first = np.arange(len(Q))
        cap = np.full(len(Q), np.inf) if cap is None else cap
        if len(Q) and Q.shape[1]:
            of = _copies(Q if marks is None else np.hstack([Q, marks]))
            if of.max() + 1 < len(Q):
                self.of, self.first = of, np.unique(of, return_index=True)[1]
                most = np.full(len(self.first), -np.inf)
                np.maximum.at(most, of, cap)
                Q, cap = Q[self.first], most
        self.Q = Q
        self.qn = (Q * Q).sum(1) if len(Q) else np.zeros(0)
        self.small = len(Q) > 0 and self.qn.max() < 1e30
        self.ones = np.hstack([Q, np.ones((len(Q), 1))]).astype(np.float32) if self.small else None
        self.cap, self.worst = cap, cap.copy()   # no hit beyond ``worst`` is wanted
        self.slots = 2 * max(k, 0) + 8
        self.used = np.zeros(len(Q), np.int64)
        self.full = np.zeros(len(Q), bool)       # whether ``worst`` is the k-th hit's distance, and worst_i its id
        self.best_d = None            # (nq, slots) distances, inf = empty slot
        self.best_i = None            # (nq, slots) ids
        self.worst_i = None

    def add(self, V: np.ndarray, ids: np.ndarray, at: np.ndarray | None = None) -> None:
        """The vectors ``V`` for the queries at the places ``at`` (among the different ones), or for all."""
        if len(V) == 0 or len(self.Q) == 0 or self.k <= 0:
            return
        ids = _sortable(ids)
        if len(V) > self.k and V.shape[1]:
            of = _copies(V)
            if of.max() + 1 < len(V):
                order = np.lexsort((ids, of))
                nth = np.arange(len(V)) - np.searchsorted(of[order], of[order])
                keep = np.sort(order[nth < self.k])
                V, ids = V[keep], ids[keep]
        if self.best_d is None:
            self.best_d = np.full((len(self.Q), self.slots), np.inf)
            self.best_i = np.zeros((len(self.Q), self.slots), dtype=ids.dtype)
            self.worst_i = np.zeros(len(self.Q), dtype=ids.dtype)
        if ids.dtype.kind == "U" and ids.dtype.itemsize > self.best_i.dtype.itemsize:
            self.best_i = self.best_i.astype(ids.dtype)       # widen, never truncate
            self.worst_i = self.worst_i.astype(ids.dtype)
        at = np.arange(len(self.Q)) if at is None else at
        for v0 in range(0, len(V), _VB):
            some = V[v0:v0 + _VB]
            vn = (some * some).sum(1)
            low = np.ascontiguousarray(np.hstack([-2.0 * some, vn[:, None]]).astype(np.float32).T) if self.small and vn.max() < 1e30 else None
            for q0 in range(0, len(at), _QB):
                self._tile(at[q0:q0 + _QB], some, vn, low, ids[v0:v0 + _VB])

    def _near(self, near: np.ndarray, edge: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of what is at or below the rows' edges; where these let too many through, the row's own k-th bounds them."""
        k = self.k
        edge = edge.copy()
        many = ~np.isfinite(edge)     # few hits as yet
        if k < near.shape[1] and many.any():
            edge[many] = np.partition(near[many], k - 1, axis=1)[:, k - 1] + 2 * slack[many]
        up = np.nextafter(edge.astype(near.dtype), np.array(np.inf, near.dtype))
        rows = np.flatnonzero(near.min(axis=1) <= up)
        part = near if len(rows) == len(near) else near[rows]
        width = near.shape[1]
        hit = _places(part <= up[rows, None])
        r = hit // width
        if k < width and len(hit) > 4 * k + 16:
            over = (np.bincount(r, minlength=len(rows)) > 4 * k + 16) & ~many[rows]
            if over.any():
                kth = np.partition(part[over], k - 1, axis=1)[:, k - 1] + 2 * slack[rows[over]]
                edge[rows[over]] = np.minimum(edge[rows[over]], kth)
                up = np.nextafter(edge.astype(near.dtype), np.array(np.inf, near.dtype))
                hit = _places(part <= up[rows, None])
                r = hit // width
        return rows[r], hit - r * width

    def _tile(self, at: np.ndarray, V: np.ndarray, vn: np.ndarray, low: np.ndarray | None, ids: np.ndarray) -> None:
        qn, most = self.qn[at], vn.max()
        edge = self.worst[at] - qn    # distances less the query's own square
        q = v = None
        if low is not None:
            slack = 2 * np.finfo(np.float32).eps * (V.shape[1] + 4) * (qn + 2 * most) + 1e-36
            q, v = self._near(self.ones[at] @ low, edge + slack, slack)
            if len(q) > (4 * self.k + 16) * len(at):
                q = None
        if q is None:
            near = self.Q[at] @ (-2.0 * V.T)
            near += vn
            slack = 8 * np.finfo(np.float64).eps * (V.shape[1] + 4) * (qn + most)
            q, v = self._near(near, edge + slack, slack)
        worst, full = self.worst[at], self.full[at]
        worst_i = self.worst_i[at]
        d, kept = [], []
        for a in range(0, len(q), _SCORED):
            x, y = q[a:a + _SCORED], v[a:a + _SCORED]
            diff = self.Q[at[x]] - V[y]
            exact = np.einsum("nd,nd->n", diff, diff)
            better = (exact < worst[x]) | ((exact == worst[x]) & (~full[x] | (ids[y] < worst_i[x])))
            kept.append(a + np.flatnonzero(better))
            d.append(exact[better])
        if kept and sum(map(len, kept)):
            kept = np.concatenate(kept)
            self._keep(at, q[kept], ids[v[kept]], np.concatenate(d))

    def _keep(self, at: np.ndarray, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Put the hits of ``at[q]`` (``q`` ascending) into slots."""
        k = self.k
        gains = np.bincount(q, minlength=len(at))
        tight = self.used[at] + gains > self.slots
        if tight.any():
            self._cut(at[tight])
            tight = self.used[at] + gains > self.slots
        if tight.any():               # more than all slots: sorted with those there are
            rows = np.flatnonzero(tight)
            more = tight[q]
            place = at[rows]
            all_q = np.concatenate([np.searchsorted(rows, q[more]), np.repeat(np.arange(len(rows)), k)])
            all_d = np.concatenate([d[more], self.best_d[place, :k].ravel()])
            all_i = np.concatenate([ids[more], self.best_i[place, :k].ravel()])
            order = np.lexsort((all_i, all_d, all_q))
            first = np.searchsorted(all_q[order], np.arange(len(rows)))
            pick = order[first[:, None] + np.arange(k)[None, :]]  # every query has its k slots at least
            self.best_d[place, :k], self.best_i[place, :k] = all_d[pick], all_i[pick]
            self.used[place] = k      # more than the slots came
            self._bound(place)
            q, ids, d = q[~more], ids[~more], d[~more]
        gains[tight] = 0
        begin = np.cumsum(gains) - gains
        slot = self.used[at][q] + np.arange(len(q)) - begin[q]
        self.best_d[at[q], slot], self.best_i[at[q], slot] = d, ids
        self.used[at] += gains
        ready = at[~self.full[at] & (self.used[at] >= k) & (gains > 0)]
        if len(ready):
            self._cut(ready)

    def _cut(self, rows: np.ndarray) -> None:
        """Sort the rows' slots by (distance, id) and keep the first ``k``."""
        k = self.k
        D, I = self.best_d[rows], self.best_i[rows]
        order = np.argsort(D, axis=1)
        Ds = np.take_along_axis(D, order, 1)
        tied = np.flatnonzero(((Ds[:, 1:] == Ds[:, :-1]) & np.isfinite(Ds[:, 1:])).any(1))
        if len(tied):
            n, w = len(tied), D.shape[1]
            flat = np.lexsort((I[tied].ravel(), D[tied].ravel(), np.repeat(np.arange(n), w)))
            order[tied] = flat.reshape(n, w) - np.arange(n)[:, None] * w
        order = order[:, :k]
        self.best_d[rows, k:] = np.inf
        self.best_d[rows, :k], self.best_i[rows, :k] = np.take_along_axis(D, order, 1), np.take_along_axis(I, order, 1)
        self.used[rows] = np.minimum(self.used[rows], k)
        self._bound(rows)

    def _bound(self, rows: np.ndarray) -> None:
        kth = self.best_d[rows, self.k - 1]
        self.full[rows] = np.isfinite(kth) & (kth <= self.cap[rows])
        self.worst[rows], self.worst_i[rows] = np.minimum(kth, self.cap[rows]), self.best_i[rows, self.k - 1]

    def frame(self, qids: np.ndarray) -> pd.DataFrame:
        if self.best_i is None:
            return pd.DataFrame({"query_id": pd.Series(qids[:0]), "id": pd.Series([], dtype=object),
                                 "distance": pd.Series([], dtype="float64")})
        for a in range(0, len(self.Q), _QB):
            self._cut(np.arange(a, min(a + _QB, len(self.Q))))
        best_d, best_i = self.best_d[:, :self.k], self.best_i[:, :self.k]
        if self.of is not None:
            best_d, best_i = best_d[self.of], best_i[self.of]
        keep = np.isfinite(best_d)
        ids = best_i[keep]
        if ids.dtype.kind == "U":          # back to Python str for Arrow
            ids = ids.astype(object)
        return pd.DataFrame({"query_id": np.repeat(qids, keep.sum(1)), "id": ids, "distance": best_d[keep]})


def _final_topk(partial: DataFrame, k, k_col: Optional[str] = None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc(), F.col("id").asc())
    ranked = partial.withColumn("rank", F.row_number().over(w))
    limit = F.col(k_col) if k_col else F.lit(int(k))
    return ranked.where(F.col("rank") <= limit)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 5, *, query_id: str = "query_id",
        query_vec: str = "embedding", id_col: str = "id", vec_col: str = "embedding",
        where: Optional[Dict[str, Any]] = None, strategy: str = "auto",
        broadcast_limit_bytes: int = QUERY_BYTES,
        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """R1 (+R2): ``(query_id, rank, id, distance)``, k rows per query at most,
    ascending squared L2 distance, ties broken by id. Null vectors, null or
    non-finite components and vectors of another length than the queries' take
    no part; queries of several lengths are an error. ``block_bytes``: of the vectors
    that pass a strip of queries at a time, in the blocked strategy."""
    if where:
        vectors = vectors.where(compile_where(where, vectors.columns))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v")).where(usable(F.col("_v")))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_q")).where(usable(F.col("_q")))
    id_type = v.schema["id"].dataType.simpleString()
    qid_type = q.schema["query_id"].dataType.simpleString()
    out_schema = f"query_id {qid_type}, id {id_type}, distance double"

    dims = q.agg(F.min(F.size("_q")).alias("least"), F.max(F.size("_q")).alias("most")).first()
    if dims["least"] != dims["most"]:
        raise ValueError(f"query vectors have {dims['least']} to {dims['most']} components")
    dim = int(dims["most"] or 0)
    v = v.where(F.size("_v") == dim)
    max_rows = max(1, broadcast_limit_bytes // (max(dim, 1) * 8))
    pdf = None
    if strategy in ("auto", "broadcast"):
        # one bounded pass: never more than max_rows + 1 query rows reach the driver
        pdf = q.limit(max_rows + 1).toPandas()
        if strategy == "auto":
            strategy = "broadcast" if len(pdf) <= max_rows else "blocked"
        elif len(pdf) > max_rows:
            raise ValueError("query block exceeds broadcast_limit_bytes; use strategy='blocked'")

    if strategy == "broadcast":
        bc = vectors.sparkSession.sparkContext.broadcast(
            (pdf["query_id"].to_numpy(), _as_matrix(pdf["_q"])))

        def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, Q = bc.value
            top = _TopK(Q, k)
            for part in it:
                top.add(_as_matrix(part["_v"]), part["id"].to_numpy())
            yield top.frame(qids)

        partial = v.mapInPandas(scan, out_schema)
    else:
        partial = _strips_topk(q, v, k, dim, block_bytes)
    return _final_topk(partial, k).select("query_id", "rank", "id", "distance")


def _strips(queries: int, vectors: int, k: int, dim: int, cores: int) -> tuple[int, int]:
    """(strips of queries, parts of vectors) for some four tasks a core. A vector is shuffled once a strip, a query and its
    hits (a hit, which is sorted too, counts as 72 bytes) once a part: as many strips as keep both together small."""
    tasks, row = 4 * cores, 8 * max(dim, 1) + 16
    even = math.sqrt(tasks * max(queries, 1) * (row + 72 * max(k, 1)) / (max(vectors, 1) * row))
    least = queries * max(8 * max(dim, 1), 6 * max(k, 1)) / QUERY_BYTES     # 6: a hit's share where its 32 bytes are five times the query's
    strips = max(1, math.ceil(least), min(round(even), tasks))
    return strips, max(1, math.ceil(tasks / strips))


def _strips_topk(q: DataFrame, v: DataFrame, k: int, dim: int, block_bytes: int, rows_of: tuple | None = None) -> DataFrame:
    """Partial hits (query_id, id, distance): those of each strip of queries (query_id, _q) in each part of the vectors (id, _v).

    With columns ``_now`` (bits) and ``_cap`` of the queries and ``_at`` (int) of the vectors, a query meets only the vectors
    whose ``_at`` is a bit set in its ``_now``, and has no hits beyond its ``_cap``. ``rows_of``: rows of (q, v), where known."""
    chosen = "_now" in q.columns
    n_q, n_v = rows_of or (q.count(), v.count())
    strips, parts = _strips(n_q, n_v, k, dim, q.sparkSession.sparkContext.defaultParallelism)
    kind = "array<float>" if q.schema["_q"].dataType == v.schema["_v"].dataType == ArrayType(FloatType()) else "array<double>"
    types = {"query_id": q.schema["query_id"].dataType, "id": v.schema["id"].dataType}

    def cells(strip: Column, part: Column, side: int, vec: str) -> list[Column]:
        held, other = ("query_id", "id") if side == 0 else ("id", "query_id")
        cols = [(strip * parts + part).cast("int").alias("cell"), F.lit(side).alias("side"), F.col(held),
                F.lit(None).cast(types[other]).alias(other), F.col(vec).cast(kind).alias("vec")]
        if chosen:
            cols += [F.col("_at") if side else F.lit(-1).alias("_at"), (F.lit(None).cast("binary") if side else F.col("_now")).alias("_now"),
                     (F.lit(None).cast("double") if side else F.col("_cap")).alias("_cap")]
        return cols

    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    qs = q.withColumn("_n", F.lit(parts)).select("*", every.alias("_every"))
    vs = v.withColumn("_n", F.lit(strips)).select("*", every.alias("_every"))
    rows = qs.select(*cells(F.pmod(F.xxhash64("query_id"), F.lit(strips)), F.col("_every"), 0, "_q")).unionByName(
        vs.select(*cells(F.col("_every"), F.pmod(F.xxhash64("id"), F.lit(parts)), 1, "_v")))
    order = ["cell", "side", *(["_at"] if chosen else [])]
    rows = rows.select("cell", "side", "query_id", "id", "vec", *(["_at", "_now", "_cap"] if chosen else []))
    rows = rows.repartitionById(strips * parts, F.col("cell")).sortWithinPartitions(*order)
    schema = StructType([StructField("query_id", types["query_id"]), StructField("id", types["id"]), StructField("distance", DoubleType())])
    arrow = to_arrow_schema(schema)
    at_once = max(1, block_bytes // (max(dim, 1) * 8))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)

    def bits(column: pa.Array) -> np.ndarray:
        return np.vstack([np.frombuffer(x, np.uint8) for x in column.to_pylist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, qids, blocks, marks, caps, top, asked = None, [], [], [], [], None, None

        def hits() -> Iterator[pa.RecordBatch]:
            if top is not None:
                found = top.frame(np.concatenate(qids))
                for a in range(0, len(found), 100_000):
                    some = found.iloc[a:a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(some[f.name], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in (0, 1, *([5] if chosen else []))]
            edges = [0, *(np.flatnonzero(np.any([np.diff(x) != 0 for x in key], axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if int(key[0][lo]) != cell:
                    yield from hits()
                    cell, qids, blocks, marks, caps, top, asked = int(key[0][lo]), [], [], [], [], None, None
                some = batch.slice(lo, hi - lo)
                if key[1][lo] == 0:
                    qids.append(some.column(2).to_pandas().to_numpy())
                    blocks.append(matrix(some.column(4)))
                    if chosen:
                        marks.append(bits(some.column(6)))
                        caps.append(some.column(7).to_numpy())
                    continue
                if blocks:
                    if chosen:
                        now = np.concatenate(marks)
                        top = _TopK(np.concatenate(blocks), k, now, np.concatenate(caps))
                        asked = np.ascontiguousarray(now[top.first].T)     # a row has eight cells
                    else:
                        top = _TopK(np.concatenate(blocks), k)
                    blocks, marks, caps = [], [], []
                if top is None:       # no query fell into the strip
                    continue
                at = np.flatnonzero(asked[key[2][lo] // 8] & (128 >> (key[2][lo] % 8))) if chosen else None
                if at is not None and not len(at):
                    continue
                for a in range(0, hi - lo, at_once):
                    block = some.slice(a, at_once)
                    top.add(matrix(block.column(4)), block.column(3).to_pandas().to_numpy(), at)
        yield from hits()

    return rows.mapInArrow(run, schema)


# ------------------------------------------------------------- R3-R7
def knn_by_text(queries: DataFrame, vectors: DataFrame, k: int = 5, *, text_col: str = "query",
                vec_col: str = "embedding", embed_fn=None, dim: int = 256, **kw) -> DataFrame:
    """Embed the query text unless a vector is given; neither is an error.

    The embedding is added in place (a narrow column), never joined back."""
    from docspark.operators.embedding import embed
    has_text, has_vec = text_col in queries.columns, vec_col in queries.columns
    if not has_text and not has_vec:
        raise ValueError("queries need a text or a vector column")
    qq = queries
    if has_text:
        qq = embed(qq, text_col, fn=embed_fn, dim=dim, out_col="_emb").drop("token_count")
        given = F.col(vec_col) if has_vec else F.lit(None)
        qq = qq.withColumn("_qv", F.coalesce(given, F.col("_emb")))
    else:
        qq = qq.withColumn("_qv", F.col(vec_col))
    qq = qq.withColumn("_qv", F.when(F.col("_qv").isNull(),
                                     F.raise_error(F.lit("query without text or vector")))
                               .otherwise(F.col("_qv")))
    return knn(qq, vectors, k, query_vec="_qv", vec_col=vec_col, **kw)


def shape_results(hits: DataFrame, vectors: DataFrame, id_col: str = "id", keep: Optional[tuple] = None) -> DataFrame:
    """Join text/metadata back to the hits; id as string, text '' when absent.

    ``keep``: columns of the vector table to return; None: text, source and all
    other metadata, the vector left out. AQE broadcasts the hits' side if it is small."""
    if keep is None:
        rest = [c for c in vectors.columns if c not in (id_col, "id", "embedding", "token_count", "query_id", "rank", "distance")]
        keep = ("text", "source", *[c for c in rest if c not in ("text", "source")])
    side = vectors.select(F.col(id_col).alias("id"), *[F.col(c) for c in keep if c in vectors.columns])
    out = hits.join(side, "id", "left")
    cols = [F.col("query_id"), F.col("rank"), F.col("id").cast("string").alias("id")]
    if "text" in keep:
        cols.append(F.coalesce(F.col("text"), F.lit("")).alias("text") if "text" in out.columns
                    else F.lit("").alias("text"))
    for c in keep:
        if c != "text" and c in out.columns:
            cols.append(F.col(c))
    cols.append(F.col("distance"))
    return out.select(*cols)


def build_context(hits: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``[Document i] (source: S)\\ntext`` blocks in rank order joined by a blank line."""
    block = F.struct(F.col("rank"), F.col(source_col).alias("s"), F.col(text_col).alias("t"))
    body = F.array_join(F.transform(
        F.array_sort(F.collect_list(block)),
        lambda x: F.concat(F.lit("[Document "), x["rank"].cast("string"), F.lit("] (source: "),
                           F.coalesce(x["s"], F.lit("Unknown Source")), F.lit(")\n"),
                           F.coalesce(x["t"], F.lit("")))), "\n\n")
    return hits.groupBy("query_id").agg(body.alias("context"))


def context_fallback(queries: DataFrame, contexts: DataFrame, query_col: str = "query") -> DataFrame:
    """Empty query -> ''; no hits -> the fixed sentence."""
    j = queries.select("query_id", query_col).join(contexts, "query_id", "left")
    ctx = (F.when(F.coalesce(F.col(query_col), F.lit("")) == "", F.lit(""))
            .when(F.col("context").isNull(), F.lit(NO_HITS_TEXT))
            .otherwise(F.col("context")))
    return j.select("query_id", ctx.alias("context"))


def rag_search(queries: DataFrame, vectors: DataFrame, k: int = 3, *, query_col: str = "query",
               vec_col: str = "embedding", embed_fn=None, dim: int = 256, k_col: Optional[str] = None,
               where=None, payload: Optional[DataFrame] = None, **kw) -> DataFrame:
    """Table of questions -> context text per question (R3 -> R1 -> R4 -> R5 -> R6).

    ``k_col`` allows a per-row k (rank <= k); the search itself uses the largest k.
    ``payload`` (id, text, source, ...) is where hit text comes from when it
    is stored apart from the vectors; by default the vector table itself."""
    nonempty = queries.where(F.coalesce(F.col(query_col), F.lit("")) != "") \
        if query_col in queries.columns else queries
    kmax = int(nonempty.agg(F.max(k_col)).first()[0] or 0) if k_col else k
    if query_col in queries.columns and vec_col not in queries.columns:
        hits = knn_by_text(nonempty, vectors, kmax, text_col=query_col, vec_col=vec_col,
                           embed_fn=embed_fn, dim=dim, where=where, **kw)
    else:
        hits = knn(nonempty, vectors, kmax, query_vec=vec_col, vec_col=vec_col, where=where, **kw)
    if k_col:
        hits = hits.join(queries.select("query_id", k_col), "query_id").where(F.col("rank") <= F.col(k_col))
    shaped = shape_results(hits, payload if payload is not None else vectors, keep=("text", "source"))
    ctx = build_context(shaped)
    qq = queries if query_col in queries.columns else queries.withColumn(query_col, F.lit("x"))
    return context_fallback(qq, ctx, query_col)


def answer_tool_calls(calls: DataFrame, vectors: DataFrame, k: int = 3, *, tool: str = "rag_search",
                      query_vectors: Optional[DataFrame] = None, payload: Optional[DataFrame] = None,
                      embed_fn=None, dim: int = 256, where=None, **kw) -> DataFrame:
    """The context text that answers each search call of a table of tool calls.

    ``calls``: the rows of ``extract_tool_calls``; those of ``tool`` are answered,
    with their ``query`` and ``k`` arguments (``k`` if absent or no number). The
    query's text is embedded by ``embed_fn``, or looked up in ``query_vectors``
    (query, embedding; a row a query); one that is not there has no hits. Returns ``calls``'
    own columns with ``context``, a row a call: repeated rows and shared call ids stay apart."""
    asked = calls.where(F.col("name") == tool)
    own = [c for c in calls.columns if c not in ("name", "arguments")]
    asked = asked.select(*own, F.get_json_object("arguments", "$.query").alias("query"),
                         F.coalesce(F.get_json_object("arguments", "$.k").try_cast("int"), F.lit(k)).alias("_k"))
    # what is asked is the key: a call's id is a label of 32 bits, which calls may share; equal questions are searched once
    asked = asked.withColumn("_asked", F.to_json(F.struct("query", "_k"), {"ignoreNullFields": "false"}))
    questions = asked.select(F.col("_asked").alias("query_id"), "query", "_k").dropDuplicates(["query_id"])
    if query_vectors is not None:
        questions = questions.join(query_vectors.select("query", "embedding"), "query", "left")
        questions = questions.where(F.col("embedding").isNotNull())
    context = rag_search(questions, vectors, k, k_col="_k", payload=payload, embed_fn=embed_fn, dim=dim, where=where, **kw)
    empty = F.coalesce(F.col("query"), F.lit("")) == ""
    return asked.join(context.withColumnRenamed("query_id", "_asked"), "_asked", "left").select(
        *own, F.coalesce("context", F.when(empty, "").otherwise(NO_HITS_TEXT)).alias("context"))
