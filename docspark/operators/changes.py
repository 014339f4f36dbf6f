"""Change detection as set algebra over (source, size, mtime, sha256).

One full outer join of the current listing with the manifest labels every
source; content hashes are computed only for *suspects* (same source, other
size/mtime), so unchanged files never have their bytes read or hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATUSES = ("added", "modified", "deleted", "unchanged")


def fast_signature(files: DataFrame, source_col: str = "source", sha256: Column | None = None) -> DataFrame:
    """Size and whole-second mtime, no hash (``content`` is not touched).

    Accepts a binary-file scan (path, length, modificationTime) or a frame that
    already has size/mtime."""
    cols = files.columns
    size = F.col("size") if "size" in cols else F.col("length")
    mtime = F.col("mtime") if "mtime" in cols else F.unix_seconds(F.col("modificationTime"))
    src = F.col(source_col) if source_col in cols else F.col("path")
    return files.select(src.alias("source"), size.cast("bigint").alias("size"),
                        mtime.cast("bigint").alias("mtime"),
                        (F.lit(None) if sha256 is None else sha256).cast("string").alias("sha256"))


def content_hash(c: Column) -> Column:
    """sha256 hex of the bytes (strings hash as UTF-8)."""
    return F.sha2(c, 256)


def strong_signature(files: DataFrame, content_col: str = "content", source_col: str = "source") -> DataFrame:
    """Fast signature plus sha256 of the content, in one pass."""
    return fast_signature(files.withColumn("_hash", content_hash(F.col(content_col))), source_col, F.col("_hash"))


def added(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """D3: in the listing, not in the manifest."""
    return current.join(manifest.select("source"), "source", "left_anti")


def deleted(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """In the manifest, not in the listing."""
    return manifest.join(current.select("source"), "source", "left_anti")


def classify(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """One full outer join; status added/deleted/unchanged/suspect."""
    cur = current.select("source", F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"),
                         F.lit(True).alias("_in_cur"))
    old = manifest.select("source", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"),
                          F.col("sha256").alias("o_sha256"), F.lit(True).alias("_in_old"))
    j = cur.join(old, "source", "full_outer")
    same = F.col("c_size").eqNullSafe(F.col("o_size")) & F.col("c_mtime").eqNullSafe(F.col("o_mtime"))
    status = (F.when(F.col("_in_old").isNull(), "added")
               .when(F.col("_in_cur").isNull(), "deleted")
               .when(same, "unchanged")
               .otherwise("suspect"))
    return j.withColumn("status", status).drop("_in_cur", "_in_old")


def suspects(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources in both whose size or mtime differs, by one inner join of the keys."""
    old = manifest.select("source", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"))
    same = F.col("size").eqNullSafe(F.col("o_size")) & F.col("mtime").eqNullSafe(F.col("o_mtime"))
    return current.select("source", "size", "mtime").join(old, "source").where(~same).select("source")


def confirm_suspects(classified: DataFrame, current: DataFrame, content_col: str = "content",
                     confirm: bool = True, of: DataFrame | None = None) -> DataFrame:
    """A suspect whose stored (non-null) hash equals the new hash is unchanged,
    else modified; with ``confirm`` off every suspect is modified.

    Only the suspects' contents are hashed, after a key join. ``of``: their
    sources where known, else they are taken from ``classified``, whose join
    the plan then holds twice."""
    if not confirm:
        return classified.withColumn("status", F.when(F.col("status") == "suspect", "modified")
                                     .otherwise(F.col("status"))) \
                         .withColumn("new_sha256", F.lit(None).cast("string"))
    of = classified.where(F.col("status") == "suspect").select("source") if of is None else of
    hashed = current.select("source", F.col(content_col)).join(of, "source", "left_semi") \
        .select("source", content_hash(F.col(content_col)).alias("new_sha256"))
    return confirm_with_hashes(classified, hashed)


def confirm_with_hashes(classified: DataFrame, hashed: DataFrame) -> DataFrame:
    """D6 with hashes computed elsewhere (``source, new_sha256`` for the suspects),
    e.g. from a second scan that reads only the suspect files."""
    j = classified.join(hashed.select("source", "new_sha256"), "source", "left")
    st = (F.when((F.col("status") == "suspect") & F.col("o_sha256").isNotNull()
                 & (F.col("o_sha256") == F.col("new_sha256")), "unchanged")
           .when(F.col("status") == "suspect", "modified")
           .otherwise(F.col("status")))
    return j.withColumn("status", st)


def finalize(confirmed: DataFrame) -> DataFrame:
    """Project a confirmed classification to ``(source, status, size, mtime, sha256)``."""
    c = confirmed
    return c.select(
        "source", "status",
        F.coalesce(F.col("c_size"), F.col("o_size")).alias("size"),
        F.coalesce(F.col("c_mtime"), F.col("o_mtime")).alias("mtime"),
        F.when(F.col("status") == "modified", F.col("new_sha256"))
         .when(F.col("status") == "deleted", F.col("o_sha256"))
         .when(F.col("status") == "unchanged", F.coalesce(F.col("new_sha256"), F.col("o_sha256")))
         .alias("sha256"))


def detect_changes(current: DataFrame, manifest: DataFrame, content_col: str = "content",
                   confirm: bool = True) -> DataFrame:
    """``(source, status, size, mtime, sha256)``; the signature is the one to
    store: the new hash for modified files, none for added ones. One full outer
    join labels all sources; the suspects come from an inner join of the keys."""
    of = suspects(current, manifest) if confirm else None
    return finalize(confirm_suspects(classify(current, manifest), current, content_col, confirm, of))


def change_counts(changes: DataFrame) -> DataFrame:
    """Count per status, zeros included (four-row label table joined left)."""
    spark = changes.sparkSession
    labels = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(F.broadcast(counts), "status", "left") \
        .select("status", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def ordered_changes(changes: DataFrame) -> DataFrame:
    """Listing order for display (status, then source)."""
    return changes.orderBy("status", "source")
