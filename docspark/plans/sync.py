"""Incremental sync of the knowledge base.

``sync_tables`` is the pure core: given the labelled changes, the manifests and
the rebuilt chunks of changed files, it returns the next file manifest, the next
chunk manifest and the per-source plan. ``sync_once`` runs the whole job against
the tables of a set: detect, preprocess and embed the changed files, write the buckets
of the changed sources as the next snapshot, and commit all tables by one marker. Up to the
marker the old snapshot is current and untouched (T17): nothing is rolled back.

Paths stay in tables from the listing to the tasks that open the files. What the
driver holds is the numbers of the touched buckets.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import ann
from docspark.operators import changes as D
from docspark.operators import chunks as K
from docspark.operators import tables as TB
from docspark.operators.embedding import CONTENTS_SCHEMA, embed, new_contents, text_key, with_contents
from docspark.plans.ingest import preprocess
from docspark.session import checkpoint_dir, cut_lineage
from docspark.sources.files import load_documents, supported_files
from docspark.sources.paths import hash_files, list_files


def sync_tables(changes: DataFrame, files: DataFrame, chunks: DataFrame, new_chunks: DataFrame, updated_at):
    """(next files manifest, next chunk manifest, plan) from the labelled changes.

    ``changes`` feeds all three: cut its lineage before, so that detection runs once."""
    touched = changes.where(F.col("status").isin("added", "modified", "deleted"))
    changed = touched.where(F.col("status") != "deleted")
    kept = TB.delete_sources(files, touched)
    next_files = kept.unionByName(changed.select("source", "size", "mtime", "sha256",
                                                 F.lit(updated_at).cast("bigint").alias("updated_at")))
    fresh = new_chunks.join(changed.select("source"), "source", "left_semi")
    next_chunks = TB.delete_sources(chunks, touched).unionByName(
        fresh.select("source", "chunk_id").dropDuplicates(["source", "chunk_id"]))
    plan = TB.old_chunk_counts(touched.select("source", "status"), chunks)
    plan = plan.withColumn("action", F.when(F.col("status") == "deleted", "delete")
                                      .when(F.col("status") == "modified", "rebuild")
                                      .otherwise("build"))
    return next_files, next_chunks, plan


@dataclass
class SyncResult:
    version: Optional[int]
    plan: DataFrame
    rejects: DataFrame


def _embed_contents(spark: SparkSession, table_set: str, fresh: DataFrame, name: str, model: dict, read: list):
    """(``fresh`` with embeddings, the buckets ``read`` of the set's contents, the rows new to them)."""
    # vectors of other lengths or of texts cut elsewhere are other models'
    name = "|".join(str(x) for x in (name, model["dim"] if model["fn"] is None else "fn", model["max_tokens"]))
    known = TB.read_table(spark, table_set, "contents", CONTENTS_SCHEMA, read)
    learned = cut_lineage(new_contents(fresh, known, name, **model))
    return with_contents(fresh, known.unionByName(learned), name), known, learned


def sync_once(spark: SparkSession, kb_roots, table_set: str, *, recursive: bool = True, only_supported: bool = True,
              confirm: bool = True, dry_run: bool = False, embed_fn=None, embed_batch: int = 128, dim: int = 256,
              max_tokens: Optional[int] = None, now: Optional[int] = None, registry=None, buckets: int = TB.BUCKETS, keep: Optional[int] = None,
              index: bool = False, index_cells: Optional[int] = None, embed_model: Optional[str] = None, **how) -> SyncResult:
    """One sync of the folders ``kb_roots`` into the tables under ``table_set``.

    A file that a loader rejects is in the result's ``rejects`` and stays out of
    the manifest, so the next sync tries it again; what the tables held of it
    goes. A file under several roots counts once. ``registry``: its loaders,
    splitters and chunkers are used. ``buckets``: of a set that has none yet. ``keep``:
    snapshots that stay (None: all). ``index``: a set that has no cell index gets one, of
    ``index_cells`` cells; one that has is kept up to date in any case, cell by cell.
    ``embed_model``: a name for ``embed_fn`` (another name for another model); embeddings are then kept by
    content in the set's table ``contents``, and a text that it holds is not embedded again, wherever it
    is found. The table keeps texts of deleted files. ``how``: arguments of ``preprocess``."""
    def numbers(df: DataFrame, bucket) -> list:
        return sorted(r[0] for r in df.select(bucket).distinct().collect())

    checkpoint_dir(spark)
    files = TB.read_table(spark, table_set, "files", TB.FILES_SCHEMA)
    now = int(time.time()) if now is None else int(now)

    # The listing: no file is opened.
    listing = supported_files(list_files(spark, kb_roots, recursive), "path", only_supported)
    listing = listing.groupBy("path").agg(F.max("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
    current = listing.select(F.col("path").alias("source"), F.col("length").alias("size"),
                             F.unix_seconds("modificationTime").alias("mtime"), "modificationTime")
    labelled = cut_lineage(D.classify(current.drop("modificationTime"), files))
    if confirm:
        suspects = labelled.where(F.col("status") == "suspect").select(F.col("source").alias("path"), F.col("c_size").alias("length"))
        hashes = cut_lineage(hash_files(suspects).where(F.col("sha256").isNotNull()).select(
            F.col("path").alias("source"), F.col("sha256").alias("new_sha256")))
        labelled = D.confirm_with_hashes(labelled, hashes)
    else:
        labelled = D.confirm_suspects(labelled, current.drop("modificationTime"), confirm=False)
    changes = cut_lineage(D.finalize(labelled))

    count = TB.bucket_count(spark, table_set, buckets)
    touched = numbers(changes.where(F.col("status") != "unchanged"), TB.bucket_of(F.col("source"), count))
    has_tables = set(TB.TABLES) <= set(TB.read_layout(spark, table_set, TB.current_snapshot(spark, table_set))["tables"])
    if not touched and (dry_run or has_tables) and (not index or ann.has_index(spark, table_set)):
        # nothing to do: a snapshot that shares all buckets
        plan = spark.createDataFrame([], "source string, status string, old_chunks bigint, action string")
        n = None
        if not dry_run:
            n = TB.next_snapshot(spark, table_set)
            TB.write_layout(spark, table_set, n, {}, count)
            TB.publish(spark, table_set, n)
            if keep is not None:
                TB.expire_snapshots(spark, table_set, keep)
        return SyncResult(n, plan, spark.createDataFrame([], "source string, error_type string, message string"))

    # Load, chunk and embed the added and modified files, once.
    wanted = changes.where(F.col("status").isin("added", "modified")).select("source")
    wanted = cut_lineage(current.join(wanted, "source", "left_semi").select(
        F.col("source").alias("path"), "modificationTime", F.col("size").alias("length")))
    loaders = registry.loaders if registry is not None else None
    docs, rejects = load_documents(spark, only_supported=only_supported, loaders=loaders, files=wanted)
    rejects = cut_lineage(rejects)
    fresh = K.dedupe_chunks(preprocess(docs.join(rejects.select("source"), "source", "left_anti"), registry=registry, **how))
    model = dict(fn=embed_fn, batch=embed_batch, dim=dim, max_tokens=max_tokens)
    learned, new_buckets = None, []
    if not dry_run and embed_model is not None:
        fresh = cut_lineage(fresh)
        fresh, known_contents, learned = _embed_contents(spark, table_set, fresh, embed_model, model,
                                                        numbers(fresh, TB.bucket_of(text_key(F.col("text")), count)))
        new_buckets = numbers(learned, TB.bucket_of(F.col("text_key"), count))
    elif not dry_run:
        fresh = embed(fresh, "text", **model)
    fresh = cut_lineage(fresh)

    # a rejected file is as good as deleted from the tables, and absent from the manifest
    known = files.select("source")
    failed = rejects.select("source").distinct().withColumn("_bad", F.lit(True))
    changes = cut_lineage(changes.join(failed, "source", "left").withColumn(
        "status", F.when(F.col("_bad"), F.lit("deleted")).otherwise(F.col("status"))).drop("_bad"))
    # only the buckets of touched sources are read of the large tables, and written of all
    gone = changes.where(F.col("status") != "unchanged").select("source")
    old_files = TB.read_table(spark, table_set, "files", TB.FILES_SCHEMA, touched)
    old_chunks = TB.read_table(spark, table_set, "chunks", TB.CHUNKS_SCHEMA, touched)
    next_files, next_chunks, plan = sync_tables(changes, old_files, old_chunks, fresh, now)
    new_rejects = plan.join(rejects.select("source"), "source", "left_semi").join(known, "source", "left_anti")
    plan = plan.join(new_rejects.select("source"), "source", "left_anti")  # nothing to do for these
    if dry_run:
        return SyncResult(None, plan, rejects)
    plan = cut_lineage(plan)  # the old tables that it counts may expire

    old_vectors = TB.read_table(spark, table_set, "vectors", TB.VECTORS_SCHEMA, touched)
    # ids are content-addressed and hold their source, so a source's vectors are its own
    new = K.dedupe_chunks(fresh, "chunk_id", ("source",)).withColumnRenamed("chunk_id", "id")
    next_vectors = old_vectors.join(gone, "source", "left_anti").unionByName(new, allowMissingColumns=True)
    n = TB.next_snapshot(spark, table_set)
    written = {}
    bucket = TB.bucket_of(F.col("source"), count)
    for name, rows in (("vectors", next_vectors), ("chunks", next_chunks), ("files", next_files)):
        TB.write_snapshot(rows.withColumn(TB.BUCKET, bucket), table_set, name, n)
        written[name] = (rows.schema, touched)
    if new_buckets:
        by_text = TB.bucket_of(F.col("text_key"), count)
        contents = known_contents.where(by_text.isin(new_buckets)).unionByName(learned)
        TB.write_snapshot(contents.withColumn(TB.BUCKET, by_text), table_set, "contents", n)
        written["contents"] = (contents.schema, new_buckets)
    if index or ann.has_index(spark, table_set):
        columns = ("id", "source", "embedding")
        before = TB.read_table(spark, table_set, "vectors", TB.VECTORS_SCHEMA).join(gone, "source", "left_anti").select(*columns)
        written |= ann.index_tables(spark, table_set, n, gone, new.select(*columns), before.unionByName(new.select(*columns)), index_cells)
    TB.write_layout(spark, table_set, n, written, count)
    TB.publish(spark, table_set, n)
    if keep is not None:
        TB.expire_snapshots(spark, table_set, keep)
    return SyncResult(n, plan, rejects)
