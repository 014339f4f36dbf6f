"""Inputs derived from the driver tables, shared by the registered queries.

The driver tables carry no dirt, headers, tool calls or file snapshots, so
each query injects what its operator needs with an expression that both
Spark and the SQL oracle evaluate identically (recipes in FIXTURES.md).
Every derivation is row-wise over the whole table: work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

MTIME0 = 1700000000       # fixed epoch base for derived file snapshots
UPDATED_AT = 1750000000   # fixed "now" for manifest stamps, so runs agree


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def chr_(n: int) -> Column:
    return F.lit(chr(n))


def dirty(text: Column) -> Column:
    """Dirt: CRLF/CR runs, tabs, control chars, VT/FF, edge spaces."""
    lf_run = F.concat(chr_(13), chr_(10), chr_(13), chr_(10), chr_(10), chr_(9), F.lit(" "))
    return F.concat(F.lit("  "), F.replace(text, F.lit("\n"), lf_run), chr_(1), F.lit("  x"),
                    chr_(11), chr_(12), F.lit(" y"), chr_(13))


def dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", dirty(F.col("text")).alias("text"))


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown over every document: a title, one '## S' header per line break,
    every 7th line a '### D' header, plus a fenced block holding a fake header."""
    d = table(spark, sf_dir, "documents")
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n## S\n"))
    fence = F.concat(F.lit("\n```\n# not a header\n```\n### D"), F.col("doc_id").cast("string"),
                     F.lit("\ntail line"))
    text = F.concat(F.lit("# T"), F.col("doc_id").cast("string"), F.lit("\n"), body, fence)
    return d.select("doc_id", text.alias("text"))


def docs_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file ``kb/<doc_id>.txt`` with size and mtime."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("kb/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"),
        F.col("text"))


def file_snapshots(spark: SparkSession, sf_dir: str):
    """(previous manifest, current listing) derived from ``documents``.

    previous: doc_id % 10 <> 0, size +1 when doc_id % 7 = 2, mtime -60 when
    doc_id % 5 = 1, no stored hash when doc_id % 3 = 0. current: doc_id % 10 <> 9.
    """
    d = docs_as_files(spark, sf_dir).withColumn("h", F.sha2(F.col("text"), 256))
    id_ = F.col("doc_id")
    prev = d.where(id_ % 10 != 0).select(
        "source",
        (F.length("text") + F.when(id_ % 7 == 2, 1).otherwise(0)).cast("bigint").alias("size"),
        (F.lit(MTIME0) + id_ - F.when(id_ % 5 == 1, 60).otherwise(0)).cast("bigint").alias("mtime"),
        F.when(id_ % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("h")).alias("sha256"),
        F.lit(UPDATED_AT - 1000).cast("bigint").alias("updated_at"))
    cur = d.where(id_ % 10 != 9).select(
        "source", "text",
        F.length("text").cast("bigint").alias("size"),
        (F.lit(MTIME0) + id_).cast("bigint").alias("mtime"))
    return prev, cur


def tool_call_text(role: Column, turn: Column, conv_id: Column, text: Column) -> Column:
    """Inject one valid rag_search call (turn % 4 = 1) or a valid+invalid pair (turn % 4 = 3)."""
    good = F.concat(text, F.lit("<tool_call>"),
                    F.lit('{"name":"rag_search","arguments":{"query":"q'), conv_id.cast("string"),
                    F.lit('","k":'), (F.lit(1) + conv_id % 5).cast("string"), F.lit("}}"),
                    F.lit("</tool_call>"))
    pair = F.concat(F.lit("<tool_call>\n"), F.lit('{"name":"a"}'), F.lit("\n</tool_call> <tool_call>{bad</tool_call>"),
                    text)
    return (F.when((role == "assistant") & (turn % 4 == 1), good)
             .when((role == "assistant") & (turn % 4 == 3), pair)
             .otherwise(text))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role",
                    tool_call_text(F.col("role"), F.col("turn"), F.col("conv_id"), F.col("text")).alias("text"))


#: Documents a folder of ``documents_folder``, on average.
FOLDER_FILES = 2000


def documents_folder(spark: SparkSession, sf_dir: str, bad_utf8: bool = False) -> str:
    """Every document written as its own text file ``.../<folder>/doc_id=<id>.txt``, which ends
    with a line feed, by tasks of Spark, under the shared checkpoint folder. Rows of one id share
    a file. Written once per input directory and reused.
    With ``bad_utf8`` every 17th document ends with the byte 0xFF (invalid UTF-8)."""
    import hashlib

    from docspark.operators.tables import _path
    from docspark.session import checkpoint_dir
    from docspark.sources.paths import write_files
    key = hashlib.sha1(sf_dir.rstrip("/").encode()).hexdigest()[:12]
    name = "files_bad_utf8" if bad_utf8 else "files"
    root = f"{checkpoint_dir(spark).rstrip('/')}/docspark-fixtures/{key}/{name}"
    fs, done = _path(spark, f"{root}._SUCCESS")
    if not fs.exists(done):
        fs.delete(_path(spark, root)[1], True)  # what a run that did not end left behind
        d = table(spark, sf_dir, "documents").select("doc_id", "text")
        if bad_utf8:
            bad = F.concat(F.col("text"), F.unhex(F.lit("FF")).cast("string"))
            d = d.withColumn("text", F.when(F.col("doc_id") % 17 == 0, bad).otherwise(F.col("text")))
        folder = F.pmod(F.xxhash64("doc_id"), F.lit(d.count() // FOLDER_FILES + 1)).cast("string")
        id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
        write_files(d.select(F.concat(folder, F.lit("/doc_id="), id_, F.lit(".txt")).alias("path"),
                             F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("content")), root)
        fs.create(done, True).close()
    return root
