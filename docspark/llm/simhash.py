"""SimHash near-duplicates, searched with BK-trees.

Every text gets a 64-bit SimHash of its word shingles. Two fingerprints are
linked at ``radius`` or fewer differing bits, and a document's class is the
smallest document id that its fingerprint can reach over links.

Finding the links. The distinct fingerprints are dealt into shards such that
two fingerprints within the radius always meet in one: the 64 bits are cut
into ``radius + 1`` runs, at least one of which is equal in such a pair, and
each run's value names a shard. Each shard builds a BK-tree (the children of a
node are keyed by their integer Hamming distance to it) and is searched by its
own members, following only edges within ``radius`` of the distance to the
node. A shard of more than ``shard_size`` fingerprints is dealt again by runs
of the bits that are still free; after three rounds at most 2**19 different
fingerprints can share a shard at radius 2, whatever the input.

A shard yields a spanning forest (at most one link a member), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import small_side, store, workers_ready
from docspark.llm.components import components

#: Shingles whose bits are counted at once: bounds the memory of a very long text.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one UTF-8 text as an unsigned integer."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words)
    if n == 0:
        return 0
    whole = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(whole, seed)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: n - shingle + 1], ends[shingle - 1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        spans = zip(first[at:at + CHUNK].tolist(), last[at:at + CHUNK].tolist(), strict=True)
        h = np.array([digest(whole[a:b], seed) for a, b in spans], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): one row a document, fp the SimHash's 64 bits as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [fingerprint(t.as_py(), shingle, seed) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


class BKTree:
    """Integers under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            at = self.children[at].setdefault((value ^ self.values[at]).bit_count(), new)
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at ``radius`` or less from ``value``."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if len(below) > 2 * radius + 1:
                for edge in range(d - radius, d + radius + 1):
                    if edge in below:
                        todo.append(below[edge])
            else:
                todo += [node for edge, node in below.items() if abs(edge - d) <= radius]
        return found


def forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (member, root) that join the members reachable within a shard."""
    tree, up = BKTree(), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for value in members:
        near = tree.within(value, radius)
        tree.add(value)
        up.append(len(up))
        for other in near:
            a, b = top(other), top(len(up) - 1)
            if a != b:
                up[max(a, b)] = min(a, b)
    return [(members[i], members[top(i)]) for i in range(len(members)) if up[i] != i]


def _runs(fixed: int, radius: int) -> list[int]:
    """The bits outside ``fixed`` in ``radius + 1`` runs, each as a mask with ``fixed``."""
    free = [i for i in range(64) if not fixed >> i & 1]
    cuts = [round(len(free) * k / (radius + 1)) for k in range(radius + 2)]
    return [fixed | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, radius: int = 2, shard_size: int = 4096, rounds: int = 3) -> DataFrame:
    """(a, b): links between the distinct values of ``fps.fp`` that join every
    two within ``radius`` bits, directly or over others."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                unsigned = np.array(members.as_py(), np.int64).view(np.uint64).tolist()
                for x, y in forest(sorted(unsigned), radius):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    out, masks = [], [0]
    level = fps.select("fp", F.lit(0).alias("dealt"))
    for k in range(rounds):
        cut = [_runs(m, radius) for m in masks]
        # the runs of the mask that a row was dealt by so far
        dealt = F.array(*[F.array(*[F.struct(F.lit(i * (radius + 1) + j).alias("dealt"),
                                            F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                                   for j, m in enumerate(c)]) for i, c in enumerate(cut)])
        rows = level.select("fp", F.explode(F.element_at(dealt, F.col("dealt") + 1)).alias("s")).select("fp", "s.*")
        sizes = store(rows.groupBy("dealt", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
        last = k == rounds - 1
        fit = sizes if last else sizes.where(F.col("n") <= shard_size)
        shards = (rows.join(fit.drop("n"), ["dealt", "key"])
                  .groupBy("dealt", "key").agg(F.collect_list("fp").alias("fps")).select("fps"))
        out.append(shards.mapInArrow(search, "a long, b long"))
        large = sizes.where(F.col("n") > shard_size)
        if last or not large.take(1):
            break
        level = store(rows.join(large.drop("n"), ["dealt", "key"]).select("fp", "dealt"), "large-shards")
        masks = [m for c in cut for m in c]
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 2, seed: int = 42, shard_size: int = 4096) -> DataFrame:
    """One row a row of ``docs``: ``id_col``, fingerprint (16 hex digits), component_id.

    ``shingle``: words a shingle; a shorter text is one shingle; no words, null
    text included: fingerprint zero, linked like any other. Repeated rows each
    come back, in one class. A row with a null id gets the class of its
    fingerprint, null if no row there has an id. Other columns of ``docs`` are
    neither read nor returned, whatever their names. An empty table gives an
    empty result.
    """
    workers_ready(docs.sparkSession)
    rows = store(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    least = store(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    nodes = components(links(least, radius, shard_size))
    roots = nodes.join(least.withColumnRenamed("fp", "node"), "node")
    root = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(root, "root").select(F.col("node").alias("fp"), "component_id")
    classes = (least.join(linked, "fp", "left")
               .select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with one document of each class: that with the smallest id.

    Ties on the id go to the smaller hash of the text; rows that repeat id and
    text are one document, and one of them stays. Rows without an id come after
    all others, so such a row stays only if its whole class has no id."""
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
                   F.xxhash64(text_col).alias("text_hash"))
    name = "row"
    while name in docs.columns:
        name += "_"
    found = near_duplicates(docs.select(row.alias(name), F.col(text_col).alias("text")), name, "text", **options)
    rows = found.groupBy(name).agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("component_id"))
    rows = rows.withColumn("goes", F.col(name) != F.col("component_id")).where("goes or rows > 1")
    rows = store(rows.select(name, "goes"), "not-alone")  # these go, or one of several stays; all others stay
    named = docs.withColumn(name, row)
    alone = named.join(small_side(rows.select(name)), name, "left_anti").drop(name)
    several = rows.where("not goes").select(name)
    if not several.take(1):
        return alone
    return alone.union(named.join(small_side(several), name, "left_semi").dropDuplicates([name]).drop(name))
