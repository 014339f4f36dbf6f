"""The file manifest, the chunk manifest and the vector table as keyed
Parquet tables with set-wise (never per-key) upserts and deletes, published
together as snapshots that share what did not change.

Layout of a table set::

    <set>/<table>/snapshot=<n>/tableset_bucket=<b>/...parquet   immutable
    <set>/_layouts/<n>                    which snapshot holds each bucket of each table
    <set>/_committed/<n>                  empty marker: snapshot n of every table is complete

Rows are bucketed by a hash of their source. A snapshot writes the buckets whose
rows changed, in full, and its layout names the older snapshots' folders for the
rest (copy on write). The layout has an entry a bucket, not a file or a row, so it is as small
as the number of buckets, which a set keeps from its first snapshot.

A writer takes the next number above every directory and marker there is, so a
snapshot that a crash left half written is never reused, writes all buckets and the
layout, and then creates the one marker, which must not exist. Readers take the highest
marker, so they see all tables of the old or of the new state (T17). One writer
at a time is assumed; of two, the second to create the marker fails.
``expire_snapshots`` deletes what no kept snapshot names.
"""

from __future__ import annotations

import json
from typing import Any, Dict, Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from docspark.operators.retrieval import compile_where

FILES_SCHEMA = "source string, size bigint, mtime bigint, sha256 string, updated_at bigint"
CHUNKS_SCHEMA = "source string, chunk_id string"
VECTORS_SCHEMA = "id string, source string, text string, embedding array<float>"


# ------------------------------------------------------------ snapshots
TABLES = ("files", "chunks", "vectors")
BUCKETS = 64                      # of a new set, unless the caller says otherwise
BUCKET = "tableset_bucket"


def _path(spark: SparkSession, path: str):
    """The path's file system, and the path, of the Hadoop API: works for object stores too."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str, prefix: str = "") -> list:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return [int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()]


def _names(spark: SparkSession, path: str) -> list:
    fs, p = _path(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []


def _tables(spark: SparkSession, table_set: str) -> list:
    return [n for n in _names(spark, table_set) if not n.startswith(("_", "."))]


def current_snapshot(spark: SparkSession, table_set: str) -> Optional[int]:
    """Highest committed snapshot number of the set, None before the first."""
    return max(_numbers(spark, f"{table_set.rstrip('/')}/_committed"), default=None)


def next_snapshot(spark: SparkSession, table_set: str) -> int:
    """A number above every marker, layout and directory, committed or not."""
    root = table_set.rstrip("/")
    used = _numbers(spark, f"{root}/_committed") + _numbers(spark, f"{root}/_layouts")
    for name in _tables(spark, root):
        used += _numbers(spark, f"{root}/{name}", "snapshot=")
    return max(used, default=0) + 1


def snapshot_path(table_set: str, name: str, n: int) -> str:
    return f"{table_set.rstrip('/')}/{name}/snapshot={n}"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_layout(spark: SparkSession, table_set: str, n: Optional[int]) -> dict:
    """``{"buckets": how many, "tables": {name: {"schema": json, "at": {bucket: snapshot}}}}``; of no
    snapshot, or of one whose tables were written without a layout, no tables."""
    if n is not None:
        fs, p = _path(spark, f"{table_set.rstrip('/')}/_layouts/{n}")
        if fs.exists(p):
            read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            stream = fs.open(p)
            try:
                return json.loads(read.toString(stream, "UTF-8"))
            finally:
                stream.close()
    return {"buckets": None, "tables": {}}


def bucket_count(spark: SparkSession, table_set: str, default: int = BUCKETS) -> int:
    return read_layout(spark, table_set, current_snapshot(spark, table_set))["buckets"] or default


def read_table(spark: SparkSession, table_set: str, name: str, schema: str, buckets: Optional[Sequence[int]] = None,
               n: Optional[int] = None) -> DataFrame:
    """A table of the published snapshot (or of snapshot ``n``); an absent one reads as empty.

    ``buckets``: only these, whose folders alone are then listed and read."""
    n = current_snapshot(spark, table_set) if n is None else n
    held = read_layout(spark, table_set, n)["tables"].get(name)
    if held is not None:
        wanted = held["at"].items() if buckets is None else [(str(b), held["at"][str(b)]) for b in buckets if str(b) in held["at"]]
        paths = [f"{snapshot_path(table_set, name, m)}/{BUCKET}={b}" for b, m in wanted]
        kind = StructType.fromJson(json.loads(held["schema"]))
        return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)
    if n is not None:
        path = snapshot_path(table_set, name, n)
        fs, p = _path(spark, path)
        if fs.exists(p):  # written in full, without a layout
            found = (spark.read.parquet(path) if name == "vectors" else spark.read.schema(schema).parquet(path)).drop(BUCKET)
            return found if buckets is None else found.where(bucket_of(F.col("source"), bucket_count(spark, table_set)).isin(list(buckets)))
    return spark.createDataFrame([], schema)


def init_tables(spark: SparkSession, table_set: str, schemas: Optional[Dict[str, str]] = None, buckets: int = BUCKETS) -> None:
    """Empty typed tables as a first snapshot, where the set has none."""
    if current_snapshot(spark, table_set) is not None:
        return
    n = next_snapshot(spark, table_set)
    schemas = schemas or {"files": FILES_SCHEMA, "chunks": CHUNKS_SCHEMA, "vectors": VECTORS_SCHEMA}
    write_layout(spark, table_set, n, {name: (spark.createDataFrame([], schema).schema, []) for name, schema in schemas.items()}, buckets)
    publish(spark, table_set, n)


def write_snapshot(df: DataFrame, table_set: str, name: str, n: int) -> None:
    """Write the rows of one table's ``snapshot=n`` by bucket (of their source, unless they have a
    column ``tableset_bucket``); they stay invisible until ``publish``. Rows of a bucket go to one file,
    or, where they are too many, to several: the write is rebalanced by measured sizes."""
    if BUCKET not in df.columns:
        df = df.withColumn(BUCKET, bucket_of(F.col("source"), bucket_count(df.sparkSession, table_set)))
    rows = df.hint("rebalance", BUCKET)
    rows.write.mode("errorifexists").partitionBy(BUCKET).parquet(snapshot_path(table_set, name, n))


def write_layout(spark: SparkSession, table_set: str, n: int, written: Dict[str, tuple], buckets: Optional[int] = None) -> None:
    """The layout of snapshot ``n``: that of the current one, with the buckets of ``written`` (name ->
    (schema, buckets that were rewritten)) taken from the folders of snapshot ``n``, or dropped where it has none."""
    root = table_set.rstrip("/")
    old = read_layout(spark, root, current_snapshot(spark, root))
    layout = {"buckets": old["buckets"] or buckets or BUCKETS, "tables": {k: dict(v) for k, v in old["tables"].items()}}
    for name, (schema, touched) in written.items():
        held = layout["tables"].get(name, {"schema": None, "at": {}})
        known = StructType.fromJson(json.loads(held["schema"])) if held["schema"] else StructType([])
        merged = StructType(list(known.fields) + [f for f in schema.fields if f.name not in known.names and f.name != BUCKET])
        there = set(_numbers(spark, snapshot_path(root, name, n), f"{BUCKET}="))
        at = {b: m for b, m in held["at"].items() if int(b) not in set(touched)}
        at |= {str(b): n for b in touched if b in there}
        layout["tables"][name] = {"schema": merged.json(), "at": at}
    fs, p = _path(spark, f"{root}/_layouts/{n}")
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(layout).encode()))
    out.close()


def publish(spark: SparkSession, table_set: str, n: int) -> None:
    """The one marker that makes snapshot ``n`` of all tables current."""
    fs, p = _path(spark, f"{table_set.rstrip('/')}/_committed/{n}")
    fs.create(p, False).close()


def expire_snapshots(spark: SparkSession, table_set: str, keep: int = 2) -> int:
    """Delete what only snapshots before the last ``keep`` need, and what crashes left behind below
    the current number; returns the number of folders deleted.

    A bucket's folder stays as long as a kept layout names it. Markers go first, so
    a reader never starts on a snapshot that is being taken away; one that started before
    may lose its files: keep as many snapshots as readers take to finish."""
    if keep < 1:
        raise ValueError("the current snapshot cannot expire")
    root = table_set.rstrip("/")
    markers = sorted(_numbers(spark, f"{root}/_committed"))
    if not markers:
        return 0
    kept, newest = markers[-keep:], markers[-1]
    layouts = {m: read_layout(spark, root, m)["tables"] for m in kept}
    for m in markers[:-keep]:
        fs, p = _path(spark, f"{root}/_committed/{m}")
        fs.delete(p, False)
    named = {(name, m, int(b)) for tables in layouts.values() for name, t in tables.items() for b, m in t["at"].items()}
    whole = {(name, m) for m, tables in layouts.items() for name in _tables(spark, root) if name not in tables}
    gone = 0
    for name in _tables(spark, root):
        for m in _numbers(spark, f"{root}/{name}", "snapshot="):
            if m > newest or (name, m) in whole:
                continue
            path = snapshot_path(root, name, m)
            there = _numbers(spark, path, f"{BUCKET}=")
            needed = [b for b in there if (name, m, b) in named]
            for target in ([f"{path}/{BUCKET}={b}" for b in there if b not in needed] if needed else [path]):
                fs, p = _path(spark, target)
                fs.delete(p, True)
                gone += 1
    for m in _numbers(spark, f"{root}/_layouts"):
        if m < newest and m not in kept:
            fs, p = _path(spark, f"{root}/_layouts/{m}")
            fs.delete(p, False)
    return gone


# ------------------------------------------------------------ manifest ops
def manifest_sources(files: DataFrame) -> DataFrame:
    """T2."""
    return files.select("source")


def lookup_signatures(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Left join; null signature for unknown sources."""
    return keys.select("source").join(files.select("source", "size", "mtime", "sha256"), "source", "left")


def upsert_signatures(files: DataFrame, new: DataFrame, updated_at) -> DataFrame:
    """T4: insert or overwrite by source, stamping ``updated_at``."""
    stamped = new.select("source", "size", "mtime", "sha256",
                         F.lit(updated_at).cast("bigint").alias("updated_at"))
    return files.join(stamped.select("source"), "source", "left_anti").unionByName(stamped)


def delete_sources(table: DataFrame, sources: DataFrame) -> DataFrame:
    """T5: drop rows of the given sources (used on both manifest tables)."""
    return table.join(sources.select("source"), "source", "left_anti")


def chunk_ids_of(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """T6."""
    return chunks.join(sources.select("source"), "source", "left_semi")


def replace_chunk_ids(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Per source, the old id set is replaced; duplicates are ignored.

    ``new`` holds (source, chunk_id) rows and may carry sources with no ids:
    pass ``sources`` separately through ``delete_sources`` for those."""
    fresh = new.select("source", "chunk_id").where(F.col("chunk_id").isNotNull()) \
        .dropDuplicates(["source", "chunk_id"])
    return delete_sources(chunks, new).unionByName(fresh)


def old_chunk_counts(changes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Old chunk count per changed source, 0 when none."""
    counts = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("old_chunks"))
    return changes.join(counts, "source", "left") \
        .withColumn("old_chunks", F.coalesce(F.col("old_chunks"), F.lit(0)).cast("bigint"))


# ------------------------------------------------------------ vector ops
def assign_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Random id where absent. Non-deterministic: materialise the result once
    (checkpoint or write) before using it twice."""
    if id_col not in df.columns:
        return df.withColumn(id_col, F.expr("uuid()"))
    return df.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), F.expr("uuid()")))


def validate_columns(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Ids must be present and unique; a null or repeated id fails the job when
    the frame is computed. Repeats are found by an aggregation of the ids alone."""
    n = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = n.where("_n > 1 and _id is not null")
    bad = F.when(F.col(id_col).isNull(), F.raise_error(F.lit("null id in vector upsert"))) \
        .when(F.col("_id").isNotNull(), F.raise_error(F.concat(F.lit("repeated id in vector upsert: "), F.col("_id").cast("string"))))
    joined = df.join(repeated.select("_id"), F.col(id_col) == F.col("_id"), "left")
    return joined.withColumn(id_col, bad.otherwise(F.col(id_col))).drop("_id")


def empty_files(changes: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Added or modified sources whose text yields no chunk."""
    changed = changes.where(F.col("status").isin("added", "modified")).select("source", "status")
    return changed.join(new_chunks.select("source"), "source", "left_anti")


def upsert_vectors(vectors: DataFrame, new: DataFrame, id_col: str = "id",
                   version_col: Optional[str] = None) -> DataFrame:
    """Replace by id (text, metadata and vector together). Inside ``new`` the
    row with the highest ``version_col`` wins, of equal versions or without a version
    the one whose other columns are greatest, so a repeated id is one row whatever the
    order of the input. A null version is the lowest. Empty input changes nothing."""
    # the winner of each id as an aggregate that combines map-side (skew safe)
    cols = [c for c in new.columns if c != id_col]
    ranked = [F.col(version_col)] if version_col else []
    ranked += [F.to_json(F.struct(F.col(c))) if isinstance(new.schema[c].dataType, (MapType, VariantType)) else F.col(c)
               for c in cols if c != version_col]
    if cols:
        new = new.groupBy(id_col).agg(F.max_by(F.struct(*cols), F.struct(*ranked)).alias("_v")) \
            .select(id_col, "_v.*").select(*new.columns)
    else:
        new = new.distinct()
    return vectors.join(new.select(id_col), id_col, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_vectors(vectors: DataFrame, ids: Optional[DataFrame] = None,
                   where: Optional[Dict[str, Any]] = None, id_col: str = "id") -> DataFrame:
    """By ids, by metadata filter, or both (a row goes when both hold)."""
    if ids is None and where is None:
        raise ValueError("need ids or where")
    if ids is not None and where is None:
        return vectors.join(ids.select(id_col), id_col, "left_anti")
    pred = compile_where(where, vectors.columns)
    if ids is None:
        return vectors.where(~pred)
    marked = vectors.join(ids.select(id_col).distinct().withColumn("_hit", F.lit(True)), id_col, "left")
    return marked.where(~(F.coalesce(F.col("_hit"), F.lit(False)) & pred)).drop("_hit")


def count_vectors(vectors: DataFrame) -> DataFrame:
    """T12."""
    return vectors.agg(F.count(F.lit(1)).alias("n"))
