"""Merkle manifest of a dataset, as content-addressed records, and proofs by descent.

Every row is a leaf: the digest of its fields. The leaves of a source, in the
order of their ids, are cut into runs of ``FANOUT``; a run's digest is that of
its members, level by level up to one subroot, and the subroots make the root
in the same way. What is stored of a node is a record from its digest to its
children's digests.

A proof starts at the root with nothing but a leaf's rank: each base-16 digit of
the rank, highest first, picks a child, and the children that are not picked
are the proof's segment of that level. The segments are then reversed, from leaf
to root. Leaves of one run share all of their way but the last step, so a run
descends as one row, and the leaves part at its last record.

Scale: rows travel as digests, never with their texts. Ranks come from a range
partitioning and counts, so a source that holds most of the rows is spread
like any other. Records are looked up by (digest, salt), the salt being drawn
from the node's place: equal subtrees of repeated rows are one content but do
not meet in one task. All trees are walked at equal heights: a height whose records
are too many to broadcast has few runs below each of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import hot_lookup, store

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SALTS = 64


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def encoded(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(F.concat(*[encoded(c) for c in fields]))


@dataclass
class Manifest:
    """``leaves``: tree, rank, n (leaves of the tree) and the leaf's own columns.
    ``levels[h]``, h from 1: the nodes of height h of all trees: tree, place, digest,
    children. ``top`` likewise for the tree of the subroots; ``trees``: tree, source,
    place (among the sources), n, subroot. ``root``: the digest, None without a row."""

    leaves: DataFrame
    trees: DataFrame
    levels: list = field(default_factory=list)
    top: list = field(default_factory=list)
    root: str | None = None


def numbered(rows: DataFrame, tree: str, order: list) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in the order given, within ``tree``) and ``n`` (rows of the tree).

    Rows that the order does not tell apart get different ranks in the order they
    were stored. No task holds a whole tree: the rows are range-partitioned, and
    their places are shifted by the counts of the partitions before."""
    spread = [F.col(tree), *order, F.col("_stored")]
    rows = store(rows.withColumn("_stored", F.monotonically_increasing_id()), "merkle-rows")
    placed = rows.repartitionByRange(*spread).sortWithinPartitions(*spread)
    placed = store(placed.drop("_stored").withColumn("_at", F.monotonically_increasing_id()), "merkle-placed")
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    spans = placed.groupBy(tree, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(tree, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                         F.sum("_rows").over(Window.partitionBy(tree)).alias("n"))
    # a row a tree and partition; stored, so that the planner knows its bytes and broadcasts it where it is small
    spans = store(spans, "merkle-spans")
    return placed.withColumn("_part", part).join(spans, [tree, "_part"]).withColumn(
        "rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _raise(nodes: DataFrame, tall: int, name: str) -> list:
    """The levels above ``nodes`` (tree, place, digest, width: nodes of the tree at this height)."""
    levels = []
    for _ in range(tall):
        runs = nodes.where("width > 1").groupBy(
            "tree", F.expr(f"place div {FANOUT}").alias("place"), F.expr(f"(width + {FANOUT - 1}) div {FANOUT}").alias("width"))
        run = F.sort_array(F.collect_list(F.struct(nodes["place"].alias("at"), nodes["digest"])))
        nodes = runs.agg(run["digest"].alias("children")).withColumn("digest", digest(F.concat_ws("", "children")))
        nodes = store(nodes, name)
        levels.append(nodes)
    return levels


def _height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def build(docs: DataFrame, fields=FIELDS, source_col: str = "source", id_col: str = "doc_id",
          extra: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``, of which only ``fields`` (and the columns of ``extra``) are read.

    Any field may be null; null sources are a tree of their own, the first; null ids
    come first in their tree; rows of equal id are ordered by their digest; equal rows are
    a leaf each. An empty table has no root. ``extra``: columns by name that
    stay with the leaves."""
    named = {f"f{i}": F.col(c) for i, c in enumerate(fields)}
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *[c.alias(k) for k, c in named.items()],
                       *[c.alias(k) for k, c in (extra or {}).items()])
    rows = rows.withColumn("leaf", leaf_digest([F.col(k) for k in named])).drop(*named)
    rows = rows.withColumn("tree", encoded(F.col("source")))
    leaves = store(numbered(rows, "tree", [F.col("id"), F.col("leaf")]), "merkle-leaves")
    tallest = leaves.agg(F.max("n")).first()[0] or 0
    levels = _raise(leaves.select("tree", F.col("rank").alias("place"), F.col("leaf").alias("digest"), F.col("n").alias("width")),
                    _height(tallest), "merkle-level")
    # a subroot is the one node at the top of its tree, or the lone leaf
    subroots = leaves.where("n = 1").select("tree", "leaf")
    for level in levels:
        subroots = subroots.unionByName(level.where("width = 1").select("tree", F.col("digest").alias("leaf")))
    known = leaves.where("rank = 0").select("tree", "source", F.col("n").alias("leaves_below"))
    ordered = known.join(subroots.withColumnRenamed("leaf", "subroot"), "tree").withColumn("all", F.lit(""))
    trees = numbered(ordered, "all", [F.col("source")])
    trees = store(trees.select("tree", "source", F.col("rank").alias("place"), F.col("leaves_below").alias("n"), "subroot",
                               F.col("n").alias("width")), "merkle-trees")
    count = trees.count()
    top = _raise(trees.select(F.lit("").alias("tree"), "place", F.col("subroot").alias("digest"), "width"), _height(count), "merkle-top")
    root = (top[-1].select("digest") if top else trees.select("subroot")).first()
    return Manifest(leaves, trees.drop("width"), levels, top, root[0] if root else None)


def _salt(tree: Column, place: Column) -> Column:
    return F.pmod(F.xxhash64(tree, place), F.lit(_SALTS)).cast("int")


def records(level: DataFrame) -> DataFrame:
    """Digest-to-children records of a level, one a digest and salt of the places where it stands."""
    return level.select(F.col("digest").alias("record"), _salt(F.col("tree"), F.col("place")).alias("salt"), "children") \
        .dropDuplicates(["record", "salt"])


def _segment(digit: Column) -> Column:
    others = F.filter("children", lambda _, i: i != digit)
    return F.struct(digit.cast("int").alias("digit"), F.concat_ws("", others).alias("siblings"))


def _descend(rows: DataFrame, levels: list, tree: Column, place: Column, least: int) -> DataFrame:
    """Follow ``rows`` (height, digest, segments) from their tree's top to nodes of height ``least`` - 1.

    ``place``: of the node of that height. A row lower than a level passes it by."""
    for h in range(len(levels), least - 1, -1):
        active = F.col("height") >= h
        shift = FANOUT ** (h - least + 1)
        at = F.expr(f"_place div {shift}")
        # rows that wait have a key of their own each: none that many share
        key = F.when(active, F.col("digest")).otherwise(F.concat(F.lit("wait "), tree, F.lit(" "), place.cast("string")))
        rows = rows.withColumn("_place", place).withColumn("record", key).withColumn("salt", _salt(tree, at))
        rows = rows.join(records(levels[h - 1]), ["record", "salt"], "left")
        digit = F.expr(f"(_place div {shift // FANOUT}) % {FANOUT}") if shift >= FANOUT else F.lit(0)
        lost = F.raise_error(F.concat(F.lit("no record of node "), F.col("record")))
        child = F.when(F.col("children").isNull(), lost).otherwise(F.get("children", digit.cast("int")))
        rows = rows.withColumn("segments", F.when(active, F.concat("segments", F.array(_segment(digit)))).otherwise(F.col("segments"))) \
            .withColumn("digest", F.when(active, child).otherwise(F.col("digest"))).drop("_place", "record", "salt", "children")
    return rows


def prove(manifest: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """Proofs of ``leaves`` (rows of ``manifest.leaves``, each at most once; None: all of them).

    Returns the leaves' own columns with ``leaf`` as the descent found it, ``subroot``,
    ``root`` and ``path``: from the leaf's run to the root, the place of the node in
    its run and the digests of the run's others, joined."""
    leaves = manifest.leaves if leaves is None else leaves
    own = [c for c in leaves.columns if c not in ("tree", "rank", "n", "leaf")]
    none = F.array().cast("array<struct<digit:int,siblings:string>>")
    # the root's descent ends at the subroots: one row a source
    trees = manifest.trees.select("tree", F.col("n").alias("leaves_below"), F.col("place").alias("source_place"),
                                  F.lit(manifest.root).cast("string").alias("digest"), none.alias("segments"), F.lit(len(manifest.top)).alias("height"))
    trees = _descend(trees, manifest.top, F.lit(""), F.col("source_place"), 1)
    trees = store(trees.select("tree", "leaves_below", F.col("digest").alias("subroot"), F.col("segments").alias("top")), "merkle-ways")
    runs = leaves.groupBy("tree", F.expr(f"rank div {FANOUT}").alias("run"), "n").agg(
        F.collect_list(F.struct(F.expr(f"rank % {FANOUT}").alias("digit"), *own)).alias("asked"))
    if not manifest.levels:
        height = F.lit(0)
    else:
        height = F.lit(0)
        for h in range(len(manifest.levels)):
            height = F.when(F.col("n") > FANOUT ** h, h + 1).otherwise(height)
    runs = store(runs.withColumn("height", height), "merkle-runs")
    total = manifest.trees.agg(F.sum("n")).first()[0] or 0
    runs = hot_lookup(runs, trees, "tree", "leaves_below", total)
    runs = runs.withColumn("digest", F.col("subroot")).withColumn("segments", F.col("top"))
    runs = _descend(runs, manifest.levels, F.col("tree"), F.col("run"), 2)
    # the run's record: its leaves part here
    if manifest.levels:
        key = F.when(F.col("height") > 0, F.col("digest")).otherwise(F.concat(F.lit("wait "), F.col("tree")))
        runs = runs.withColumn("record", key).withColumn("salt", _salt(F.col("tree"), F.col("run")))
        runs = runs.join(records(manifest.levels[0]), ["record", "salt"], "left").drop("record", "salt")
    else:
        runs = runs.withColumn("children", F.lit(None).cast("array<string>"))
    lost = F.raise_error(F.concat(F.lit("no record of node "), F.col("digest")))
    members = F.when(F.col("height") == 0, F.array("digest")).otherwise(F.coalesce("children", lost))
    out = runs.withColumn("children", members).select("children", "digest", "height", "subroot", "segments", F.explode("asked").alias("a"))
    digit = F.col("a.digit").cast("int")
    last = F.when(F.col("height") > 0, F.array(_segment(digit))).otherwise(none)
    return out.select(*[F.col(f"a.{c}").alias(c) for c in own], F.get("children", digit).alias("leaf"), "subroot",
                      F.lit(manifest.root).cast("string").alias("root"),
                      F.concat(last, F.reverse("segments")).alias("path"))


def proof_digest(path: str = "path") -> Column:
    """One digest over all siblings of a proof, from the leaf's run up to the root."""
    return digest(F.concat_ws("", F.col(f"{path}.siblings")))


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that ``leaf`` and the siblings of a proof make."""
    def up(below: Column, step: Column) -> Column:
        cut = step["digit"] * 64
        return digest(F.concat(F.substr(step["siblings"], F.lit(1), cut), below, F.substr(step["siblings"], cut + 1)))
    return F.aggregate(path, leaf, up)
