"""File scans and per-format readers.

``scan_files`` lists and opens files in tasks (``sources.paths``). Readers turn the
content into document rows; per-file failures become reject rows instead of
failing the job (S8).
"""

from __future__ import annotations

import csv
import io
import os
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from docspark.functions import text as T
from docspark.options import SUPPORTED_EXTS
from docspark.sources.paths import list_files, read_files

TEXT_EXTS = (".txt", ".md", ".html", ".htm")
REJECT_SCHEMA = "source string, error_type string, message string"


def _classify_roots(spark: SparkSession, roots: Sequence[str]):
    """(files, dirs) among the roots that exist, via the Hadoop file system API
    (works for local, HDFS and object-store paths)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files, dirs = [], []
    for r in roots:
        r = str(r)
        if "://" not in r and not r.startswith("file:"):
            r = os.path.abspath(os.path.expanduser(r))
        p = jvm.org.apache.hadoop.fs.Path(r)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            continue
        (dirs if fs.getFileStatus(p).isDirectory() else files).append(r)
    return files, dirs


def scan_files(spark: SparkSession, roots: Sequence[str], recursive: bool = True, content: bool = True) -> DataFrame:
    """``path, modificationTime, length, content, read_error`` for every file under the roots.

    Missing roots yield nothing; a file reached through two roots appears once per
    root; hidden names and names with pattern characters are files like any other.
    The files are opened in tasks. ``content=False``: the listing alone, no file is read."""
    listing = list_files(spark, roots, recursive)
    return read_files(listing) if content else listing


def supported_files(df: DataFrame, path_col: str = "path", only_supported: bool = True) -> DataFrame:
    """Keep the supported extensions (case-insensitive)."""
    if not only_supported:
        return df
    return df.where(T.file_ext(F.col(path_col)).isin(list(SUPPORTED_EXTS)))


def file_metadata(df: DataFrame) -> DataFrame:
    """Source, file_name, file_ext (lower), file_size, file_mtime (whole seconds),
    page_1based = page + 1. Values already present win (set-default semantics)."""
    cols = set(df.columns)

    def have(c, derived):
        return F.coalesce(F.col(c), derived) if c in cols else derived

    src = F.col("source") if "source" in cols else F.col("path")
    out = df.withColumn("source", src)
    derived_size = F.col("length") if "length" in cols else F.lit(None).cast("bigint")
    derived_mtime = F.unix_seconds(F.col("modificationTime")) if "modificationTime" in cols \
        else F.lit(None).cast("bigint")
    page = F.col("page") if "page" in cols else F.lit(None).cast("int")
    return (out.withColumn("file_name", have("file_name", T.file_name(F.col("source"))))
               .withColumn("file_ext", have("file_ext", T.file_ext(F.col("source"))))
               .withColumn("file_size", have("file_size", derived_size).cast("bigint"))
               .withColumn("file_mtime", have("file_mtime", derived_mtime).cast("bigint"))
               .withColumn("page", page.cast("int"))
               .withColumn("page_1based", have("page_1based", page + 1).cast("int")))


def read_text_docs(files: DataFrame, exts=TEXT_EXTS) -> tuple:
    """S3: .txt/.md/.html/.htm -> one document per file (HTML kept raw).

    Returns (documents, rejects); invalid UTF-8 goes to rejects (charset
    detection is not built)."""
    f = files.where(T.file_ext(F.col("path")).isin(list(exts))) if exts else files
    raw = F.col("content").cast("string")
    ok = F.try_validate_utf8(raw).isNotNull()
    docs = f.where(ok).select(F.col("path").alias("source"), raw.alias("text"), "length", "modificationTime")
    rejects = f.where(~ok).select(F.col("path").alias("source"), F.lit("UnicodeDecodeError").alias("error_type"),
                                  F.lit("invalid UTF-8").alias("message"))
    return docs, rejects


def csv_row_text(row: dict) -> str:
    """``key: value`` lines; keys and values stripped, overflow cells joined by commas,
    missing cells print as None (csv.DictReader conventions)."""
    def val(v):
        if isinstance(v, str):
            return v.strip()
        if isinstance(v, list):
            return ",".join(x.strip() for x in v)
        return v
    return "\n".join(f"{k.strip() if k is not None else k}: {val(v)}" for k, v in row.items())


def read_csv_rows(files: DataFrame) -> tuple:
    """One document per CSV row, text = ``col: value`` lines, metadata ``row``.

    Headers differ per file, so each file is parsed with the csv module inside
    mapInPandas (rows of one file never leave its task). Returns (docs, rejects)."""
    f = files.where(T.file_ext(F.col("path")) == ".csv").select("path", "content", "length",
                                                                  "modificationTime")

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2 ** 31 - 1)  # a cell may be as long as its file
        cols = ["source", "text", "row", "length", "modificationTime", "error_type", "message"]
        for pdf in it:
            for path, content, length, mtime in pdf.itertuples(index=False):
                out = []
                try:
                    text = bytes(content).decode("utf-8")
                    for i, row in enumerate(csv.DictReader(io.StringIO(text, newline=""))):
                        out.append((path, csv_row_text(row), i, length, mtime, None, None))
                except Exception as e:  # S8: one bad file as a whole, the rest go on
                    out = [(path, None, None, length, mtime, type(e).__name__, str(e))]
                if out:
                    yield pd.DataFrame(out, columns=cols)

    parsed = f.mapInPandas(parse, "source string, text string, row int, length bigint, "
                                  "modificationTime timestamp, error_type string, message string")
    return (parsed.where(F.col("error_type").isNull()).drop("error_type", "message"),
            parsed.where(F.col("error_type").isNotNull()).select("source", "error_type", "message"))


def read_json_docs(files_or_text: DataFrame, text_col: str = "text") -> DataFrame:
    """Keep the raw text and add the parsed value (NULL when not JSON)."""
    return files_or_text.withColumn("json_value", F.try_parse_json(F.col(text_col)))


def route_by_ext(files: DataFrame, loaders: dict | None = None) -> tuple:
    """S7 (+U1): pick a loader by lower-case extension; unknown -> no documents.

    ``loaders`` maps extension -> function(files DataFrame) -> (docs, rejects).
    Built-ins: text (.txt .md .html .htm), .csv, .json. Returns (docs, rejects)."""
    table = {ext: "text" for ext in TEXT_EXTS}
    table.update({".csv": "csv", ".json": "json"})
    custom = {k.lower(): v for k, v in (loaders or {}).items()}
    ext = T.file_ext(F.col("path"))
    docs_parts, rej_parts = [], []
    builtin_kinds = {}
    for e, kind in table.items():
        if e not in custom:
            builtin_kinds.setdefault(kind, []).append(e)
    if "text" in builtin_kinds:
        d, r = read_text_docs(files, exts=tuple(builtin_kinds["text"]))
        docs_parts.append(d)
        rej_parts.append(r)
    if "csv" in builtin_kinds:
        d, r = read_csv_rows(files.where(ext == ".csv"))
        docs_parts.append(d)
        rej_parts.append(r)
    if "json" in builtin_kinds:
        d, r = read_text_docs(files, exts=(".json",))
        docs_parts.append(read_json_docs(d))
        rej_parts.append(r)
    for e, fn in custom.items():
        res = fn(files.where(ext == e))
        d, r = res if isinstance(res, tuple) else (res, None)
        docs_parts.append(d)
        if r is not None:
            rej_parts.append(r)
    docs = docs_parts[0]
    for d in docs_parts[1:]:
        docs = docs.unionByName(d, allowMissingColumns=True)
    rejects = rej_parts[0]
    for r in rej_parts[1:]:
        rejects = rejects.unionByName(r, allowMissingColumns=True)
    return docs, rejects


def load_documents(spark: SparkSession, roots: Sequence[str] = (), recursive: bool = True, only_supported: bool = True,
                   loaders: dict | None = None, files: DataFrame | None = None) -> tuple:
    """S1 -> S2 -> S7 -> S6: (documents with file metadata, rejects).

    ``files``: a listing (path, modificationTime, length) to load instead of the roots.
    The listing is parted by loader before any file is opened, so each file is
    read by one scan and files without a loader by none."""
    listing = list_files(spark, roots, recursive) if files is None else files
    custom = {k.lower(): v for k, v in (loaders or {}).items()}
    kinds = {"text": [e for e in TEXT_EXTS if e not in custom],
             "csv": [e for e in (".csv",) if e not in custom],
             "json": [e for e in (".json",) if e not in custom]}
    docs_parts, rej_parts = [], []

    def add(read: DataFrame, loaded) -> None:
        d, r = loaded if isinstance(loaded, tuple) else (loaded, None)
        docs_parts.append(d)
        rej_parts.append(unread(read))
        if r is not None:
            rej_parts.append(r)

    def read(exts) -> DataFrame:
        return read_files(listing.where(T.file_ext(F.col("path")).isin(list(exts))))

    if kinds["text"]:
        found = read(kinds["text"])
        add(found, read_text_docs(opened(found), exts=kinds["text"]))
    if kinds["csv"]:
        found = read([".csv"])
        add(found, read_csv_rows(opened(found)))
    if kinds["json"]:
        found = read([".json"])
        d, r = read_text_docs(opened(found), exts=(".json",))
        add(found, (read_json_docs(d), r))
    for e, fn in custom.items():
        if only_supported and e not in SUPPORTED_EXTS:
            continue
        found = read([e])
        add(found, fn(opened(found)))
    docs = docs_parts[0]
    for d in docs_parts[1:]:
        docs = docs.unionByName(d, allowMissingColumns=True)
    rejects = rej_parts[0]
    for r in rej_parts[1:]:
        rejects = rejects.unionByName(r, allowMissingColumns=True)
    return file_metadata(docs), rejects


def opened(files: DataFrame) -> DataFrame:
    """The files of a read that could be opened, without the error column."""
    return files.where(F.col("read_error").isNull()).drop("read_error")


def unread(files: DataFrame) -> DataFrame:
    """A reject row for every file of a read that could not be opened."""
    kind = F.regexp_extract("read_error", r"(?s)\A(\w+): (.*)\z", 1)
    return files.where(F.col("read_error").isNotNull()).select(
        F.col("path").alias("source"), kind.alias("error_type"), F.regexp_extract("read_error", r"(?s)\A(\w+): (.*)\z", 2).alias("message"))
