"""

Each takes ``(spark, sf_dir)`` and returns a DataFrame over whole driver
tables (or data Spark derives from them row by row). Computed columns carry
the same aliases as the SQL oracles in ``oracles.py``.
"""

from __future__ import annotations

import re
from typing import Callable, Dict

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docspark.functions import text as TX
from docspark.operators import changes as D
from docspark.operators import chunks as K
from docspark.operators import clean as C
from docspark.operators import embedding as E
from docspark.operators import messages as M
from docspark.operators import retrieval as R
from docspark.operators import sections as P
from docspark.operators import tables as TB
from docspark.plans import fixtures as X
from docspark.sources import files as S
from docspark.streaming import tokens as W

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: Dict[str, Query] = {}

SYSTEM_PROMPT = "Answer briefly, and say when you do not know."


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _t(spark, sf, name):
    return X.table(spark, sf, name)


# =============================================================== C: cleaning
@query
def clean_text(spark, sf):
    return C.clean_text(X.dirty_documents(spark, sf)).select("doc_id", "text")


@query
def clean_text_native(spark, sf):
    steps = [s for s in C.DEFAULT_STEPS if s != "nfkc"]
    return C.clean_text(X.dirty_documents(spark, sf), steps=steps).select("doc_id", "text")


@query
def remove_null_bytes(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit(".\x00")).alias("text"))
    return C.remove_null_bytes(d)


@query
def normalize_nfkc(spark, sf):
    d = _t(spark, sf, "documents").select(
        "doc_id", F.replace(F.replace("text", F.lit("a"), F.lit("ａ")), F.lit("fi"), F.lit("ﬁ")).alias("text"))
    return C.normalize_nfkc(d)


@query
def normalize_newlines(spark, sf):
    return C.normalize_newlines(X.dirty_documents(spark, sf))


@query
def strip_control_chars(spark, sf):
    return C.strip_control_chars(X.dirty_documents(spark, sf))


@query
def dehyphenate(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("e "), F.lit("e-\n")).alias("text"))
    return C.dehyphenate(d)


@query
def strip_lines(spark, sf):
    return C.strip_lines(X.dirty_documents(spark, sf))


@query
def collapse_inline_spaces(spark, sf):
    return C.collapse_inline_spaces(X.dirty_documents(spark, sf))


@query
def collapse_blank_lines(spark, sf):
    return C.collapse_blank_lines(C.normalize_newlines(X.dirty_documents(spark, sf)))


@query
def final_strip(spark, sf):
    return C.final_strip(X.dirty_documents(spark, sf))


@query
def drop_empty(spark, sf):
    d = _t(spark, sf, "documents")
    t = (F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string"))
          .when(F.col("doc_id") % 5 == 1, F.lit("")).otherwise(F.col("text")))
    return C.drop_empty(d.select("doc_id", t.alias("text")))


# =============================================================== S: sources
_EXTS = [".txt", ".MD", ".html", ".htm", ".csv", ".json", ".pdf", ".exe", ".Docx", ".ppt", "", ".tar.gz", ".pptx"]


def _paths(spark, sf):
    d = _t(spark, sf, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("doc_id") % len(_EXTS)).cast("int") + 1)
    return d.select("doc_id", F.concat(F.lit("kb/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"),
                                       ext).alias("path"))


@query
def supported_files(spark, sf):
    return S.supported_files(_paths(spark, sf)).select("doc_id", "path",
                                                       TX.file_ext(F.col("path")).alias("file_ext"))


@query
def file_metadata(spark, sf):
    d = _t(spark, sf, "documents")
    files = d.select(
        "doc_id",
        F.concat(F.lit("kb/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.timestamp_seconds(F.lit(X.MTIME0) + F.col("doc_id") + F.lit(0.75)).alias("modificationTime"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 5).cast("int").alias("page"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("given.txt")).alias("file_name"))
    return S.file_metadata(files).select("doc_id", "source", "file_name", "file_ext", "file_size",
                                         "file_mtime", "page", "page_1based")


@query
def read_json_docs(spark, sf):
    ev = _t(spark, sf, "events")
    text = F.when(F.col("event_id") % 9 == 0, F.replace("props", F.lit('"k"'), F.lit("k"))).otherwise(F.col("props"))
    d = S.read_json_docs(ev.select("event_id", text.alias("text")))
    return d.select("event_id", F.col("json_value").isNotNull().alias("is_json"),
                    F.try_variant_get("json_value", "$.k", "bigint").alias("k"))


def _customer_csv_files(spark, sf):
    """customer rows as CSV files of at most 1000 rows each (bounded groups)."""
    c = _t(spark, sf, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_name"),
                       F.col("c_nationkey").cast("string"),
                       F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.col("c_mktsegment"))
    files = (c.select(F.floor(F.col("c_custkey") / 1000).alias("part"), F.struct("c_custkey", line.alias("l")).alias("r"))
               .groupBy("part")
               .agg(F.array_sort(F.collect_list("r")).alias("rows")))
    header = "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment"
    body = F.concat(F.lit(header + "\n"), F.array_join(F.transform("rows", lambda r: r["l"]), "\n"), F.lit("\n"))
    return files.select(
        F.concat(F.lit("customers/part-"), F.col("part").cast("string"), F.lit(".csv")).alias("path"),
        F.encode(body, "UTF-8").alias("content"),
        F.octet_length(body).cast("bigint").alias("length"),
        F.timestamp_seconds(F.lit(X.MTIME0)).alias("modificationTime"))


def _doc_id_of(col: str):
    return F.regexp_extract(col, r"doc_id=(\d+)\.txt$", 1).cast("bigint")


@query
def scan_files(spark, sf):
    """S1 over a folder holding every document as a file (written by Spark): ``size`` is counted on the bytes read."""
    files = S.supported_files(S.scan_files(spark, [X.documents_folder(spark, sf)]))
    return files.select(_doc_id_of("path").alias("doc_id"), F.octet_length("content").cast("bigint").alias("size"))


@query
def read_text_docs(spark, sf):
    """S3: decoded text per file (the text sink ends each file with a line feed)."""
    docs, _rejects = S.read_text_docs(S.scan_files(spark, [X.documents_folder(spark, sf)]))
    return docs.select(_doc_id_of("source").alias("doc_id"), "text")


@query
def with_rejects(spark, sf):
    """A file that cannot be decoded becomes a reject row; the others load."""
    files = S.scan_files(spark, [X.documents_folder(spark, sf, bad_utf8=True)])
    _docs, rejects = S.route_by_ext(files)
    return rejects.select(_doc_id_of("source").alias("doc_id"), "error_type")


@query
def route_by_ext(spark, sf):
    """S7 + S2 + S6: load the folder through the extension router."""
    docs, _rejects = S.load_documents(spark, [X.documents_folder(spark, sf)])
    return docs.select(_doc_id_of("source").alias("doc_id"), "file_ext", F.length("text").alias("n_chars"))


@query
def read_csv_rows(spark, sf):
    docs, _rejects = S.read_csv_rows(_customer_csv_files(spark, sf))
    return docs.select("source", "row", "text")


# =============================================================== P: sections
@query
def markdown_sections(spark, sf):
    return P.markdown_sections(X.markdown_documents(spark, sf)).select("doc_id", "section", "h1", "h2", "h3", "h4", "text")


@query
def merge_section_metadata(spark, sf):
    md = X.markdown_documents(spark, sf).join(_t(spark, sf, "documents").select("doc_id", F.col("lang").alias("h4")),
                                              "doc_id")
    return P.markdown_sections(md).select("doc_id", "section", "h1", "h2", "h3", "h4")


@query
def html_sections(spark, sf):
    pg = _t(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    return P.html_sections(pg).select("page_id", "section", "h1", "h2", "h3", "h4", "text")


@query
def html_section_headers(spark, sf):
    s = html_sections(spark, sf)
    return s.where(F.col("h1").isNotNull()).select("page_id", "h1").distinct()


@query
def json_sections(spark, sf):
    ev = _t(spark, sf, "events").select("event_id", F.col("props").alias("text"))
    return P.json_sections(ev).select("event_id", "section", "text")


@query
def structure_split(spark, sf):
    """P4 over a mixed set: markdown (.md), pages (.html), event props (.json), plain (.txt)."""
    md = X.markdown_documents(spark, sf).select(
        F.concat(F.lit("kb/md/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), "text")
    pg = _t(spark, sf, "pages").select(
        F.concat(F.lit("kb/html/"), F.col("page_id").cast("string"), F.lit(".html")).alias("source"),
        F.col("html").alias("text"))
    js = _t(spark, sf, "events").select(
        F.concat(F.lit("kb/json/"), F.col("event_id").cast("string"), F.lit(".json")).alias("source"),
        F.col("props").alias("text"))
    tx = X.docs_as_files(spark, sf).select("source", "text")
    files = S.file_metadata(md.unionByName(pg).unionByName(js).unionByName(tx))
    return P.structure_split(files).select("source", "section", "h1", "h2", "h3", "h4", "text")


# =============================================================== K: chunks
@query
def recursive_chunks(spark, sf):
    d = C.clean_text(_t(spark, sf, "documents").select("doc_id", "text"))
    ch = K.recursive_chunks(d, "text")
    return K.add_end_index(ch).select("doc_id", "chunk_pos", "start_index", "end_index", "text")


def _document_chunks(spark, sf):
    d = C.clean_text(_t(spark, sf, "documents").select("doc_id", "text"))
    return d, K.add_end_index(K.recursive_chunks(d, "text"))


@query
def chunk_invariants(spark, sf):
    """K1, K6, K7 over all documents: each chunk is the text at its place and at most the size;
    together they have every character that is not white space."""
    d, ch = _document_chunks(spark, sf)
    at = F.substring(F.col("whole"), F.col("start_index") + 1, F.col("end_index") - F.col("start_index"))
    def solid(c):
        return F.length(F.regexp_replace(c, r"\s", ""))

    d = d.select("doc_id", F.col("text").alias("whole"), solid(F.col("text")).alias("solid"))
    return ch.join(d, "doc_id").groupBy("doc_id").agg(
        F.min(at == F.col("text")).alias("all_placed"), (F.max(F.length("text")) <= 1000).alias("all_fit"),
        (F.sum(solid("text")) >= F.max("solid")).alias("covered"))


_FOUR = re.compile(r"[^ \t\n\x0b\f\r]{1,4}")


def _runs_of_four(text: str) -> list[tuple[int, int]]:
    """Tokens of the query below: runs of up to four characters without white space."""
    return [m.span() for m in _FOUR.finditer(text)]


@query
def token_chunks(spark, sf):
    """K5 over all documents, whole texts: chunks of at most 200 tokens, counted again in each chunk; without
    an overlap they have every character that is not white space exactly once."""
    d = C.clean_text(_t(spark, sf, "documents").select("doc_id", "text"))
    ch = K.recursive_chunks(d, "text", size=200, overlap=0, unit="token", tokens=_runs_of_four)
    tokens = F.size(F.regexp_extract_all("text", F.lit(_FOUR.pattern), F.lit(0)))
    return ch.groupBy("doc_id").agg((F.max(tokens) <= 200).alias("all_fit"),
                                    F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("solid"))


@query
def single_chunk_ids(spark, sf):
    """K10 on K1's output: the id where the cleaned text is one chunk, null elsewhere."""
    from docspark.plans.ingest import preprocess as pp
    ch = pp(X.docs_as_files(spark, sf))
    one = F.count(F.lit(1)) == 1
    return ch.groupBy("doc_id").agg(F.when(one, F.max("chunk_id")).alias("chunk_id"))


@query
def preprocess(spark, sf):
    from docspark.plans.ingest import preprocess as pp
    return pp(X.docs_as_files(spark, sf).drop("doc_id"))


@query
def preprocess_metadata(spark, sf):
    """K12 keeps what a user adds to a document, to its chunks."""
    from docspark.plans.ingest import preprocess as pp
    d = X.docs_as_files(spark, sf).join(_t(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("site")),
                                        "doc_id")
    ch = pp(d.withColumn("row", (F.col("doc_id") % 7).cast("int")))
    return ch.groupBy("doc_id", "language", "site", "row").agg((F.count(F.lit(1)) > 0).alias("chunked"))


def _line_chunks(spark, sf, text_override=None, with_start=True, page=None):
    """Lines of every document as chunks of file kb/<doc_id>.txt (empty lines dropped),
    start_index = character offset of the line in its file."""
    d = X.docs_as_files(spark, sf)
    if text_override is not None:
        d = d.withColumn("text", text_override)
    lines = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    w = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start_index",
                             F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int"))
    lines = lines.where(F.trim("text") != "")
    lines = lines.withColumn("file_name", TX.file_name(F.col("source"))) \
                 .withColumn("page", F.lit(page).cast("int")) \
                 .withColumn("page_1based", (F.col("page") + 1).cast("int"))
    if not with_start:
        lines = lines.withColumn("start_index", F.lit(None).cast("int"))
    lines = K.add_chunk_index(lines, "source", ("line_no",))
    lines = K.add_end_index(lines)
    lines = K.add_citation(lines)
    return K.add_chunk_id(lines)


@query
def chunk_metadata(spark, sf):
    return _line_chunks(spark, sf).select("source", "chunk_index", "start_index", "end_index",
                                          "citation", "chunk_id")


@query
def end_index(spark, sf):
    """K7."""
    return _line_chunks(spark, sf).select("source", "start_index", "end_index")


@query
def chunk_index(spark, sf):
    """K8: 0-based position of each chunk in its file."""
    return _line_chunks(spark, sf).select("source", "start_index", "chunk_index")


@query
def citation(spark, sf):
    """K9 with pages on every third file (name#p<page>), chunk numbers elsewhere."""
    ch = _line_chunks(spark, sf)
    ch = ch.withColumn("page_1based", F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 4 + 1).cast("int")))
    return K.add_citation(ch.drop("citation")).select("source", "chunk_index", "citation")


@query
def chunk_id(spark, sf):
    """K10."""
    return _line_chunks(spark, sf).select("source", "chunk_index", "chunk_id")


@query
def dedupe_chunks(spark, sf):
    ch = _line_chunks(spark, sf, with_start=False)
    return K.dedupe_chunks(ch).select("source", "chunk_index", "chunk_id")


# =============================================================== D: changes
@query
def fast_signature(spark, sf):
    _, cur = X.file_snapshots(spark, sf)
    return D.fast_signature(cur)


@query
def strong_signature(spark, sf):
    _, cur = X.file_snapshots(spark, sf)
    return D.strong_signature(cur, "text")


@query
def added_files(spark, sf):
    prev, cur = X.file_snapshots(spark, sf)
    return D.added(cur, prev).select("source")


@query
def deleted_files(spark, sf):
    prev, cur = X.file_snapshots(spark, sf)
    return D.deleted(cur, prev).select("source")


@query
def classify_files(spark, sf):
    prev, cur = X.file_snapshots(spark, sf)
    return D.classify(cur, prev).select("source", "status")


@query
def confirm_suspects(spark, sf):
    prev, cur = X.file_snapshots(spark, sf)
    c = D.classify(cur, prev)
    sus = c.where(F.col("status") == "suspect")
    return D.confirm_suspects(sus, cur, "text").select("source", "status")


@query
def detect_changes(spark, sf):
    prev, cur = X.file_snapshots(spark, sf)
    return D.detect_changes(cur, prev, "text")


@query
def change_counts(spark, sf):
    return D.change_counts(detect_changes(spark, sf))


@query
def ordered_changes(spark, sf):
    return D.ordered_changes(detect_changes(spark, sf)).select("status", "source")


# =============================================================== T: keyed tables
def _old_chunk_manifest(spark, sf):
    ch = _line_chunks(spark, sf)
    return ch.where(F.col("doc_id") % 10 != 0).select("source", "chunk_id")


def _changed(spark, sf):
    return detect_changes(spark, sf).where(F.col("status").isin("added", "modified"))


@query
def manifest_sources(spark, sf):
    prev, _ = X.file_snapshots(spark, sf)
    return TB.manifest_sources(prev)


@query
def lookup_signatures(spark, sf):
    prev, cur = X.file_snapshots(spark, sf)
    return TB.lookup_signatures(cur, prev)


@query
def upsert_signatures(spark, sf):
    prev, _ = X.file_snapshots(spark, sf)
    return TB.upsert_signatures(prev, _changed(spark, sf), X.UPDATED_AT)


@query
def delete_sources(spark, sf):
    prev, _ = X.file_snapshots(spark, sf)
    gone = detect_changes(spark, sf).where(F.col("status") == "deleted")
    return TB.delete_sources(prev, gone)


@query
def chunk_ids_of(spark, sf):
    mod = detect_changes(spark, sf).where(F.col("status") == "modified")
    return TB.chunk_ids_of(_old_chunk_manifest(spark, sf), mod)


def _new_chunk_rows(spark, sf):
    """Chunks of the changed files (rebuilt with page 0, so ids differ from the old ones)."""
    ch = _line_chunks(spark, sf, page=0)
    return ch.join(_changed(spark, sf).select("source"), "source", "left_semi").select("source", "chunk_id")


@query
def replace_chunk_ids(spark, sf):
    return TB.replace_chunk_ids(_old_chunk_manifest(spark, sf), _new_chunk_rows(spark, sf))


@query
def old_chunk_counts(spark, sf):
    ch = detect_changes(spark, sf).where(F.col("status") != "unchanged").select("source", "status")
    return TB.old_chunk_counts(ch, _old_chunk_manifest(spark, sf))


@query
def empty_files(spark, sf):
    """Changed files whose text yields no chunk (every 13th file is blank)."""
    blank = F.when(F.col("doc_id") % 13 == 0, F.lit("  \n ")).otherwise(F.col("text"))
    return TB.empty_files(detect_changes(spark, sf), _line_chunks(spark, sf, text_override=blank))


def _synced(spark, sf):
    """T13 on the derived snapshots; detection runs once."""
    from docspark.plans.sync import sync_tables
    from docspark.session import cut_lineage
    prev, cur = X.file_snapshots(spark, sf)
    changes = cut_lineage(D.detect_changes(cur, prev, "text"))
    new = _line_chunks(spark, sf, page=0).join(changes.where(F.col("status").isin("added", "modified")).select("source"),
                                               "source", "left_semi").select("source", "chunk_id")
    return sync_tables(changes, prev, _old_chunk_manifest(spark, sf), new, X.UPDATED_AT)


@query
def sync_files(spark, sf):
    """The file manifest after one sync (deleted dropped, changed upserted)."""
    return _synced(spark, sf)[0]


@query
def sync_chunks(spark, sf):
    return _synced(spark, sf)[1]


@query
def sync_plan(spark, sf):
    """T14 dry run: what a sync would do, per source."""
    return _synced(spark, sf)[2]


@query
def sync_job(spark, sf):
    """T13 + T17 + S8 as the real job: the documents' folder is synced into a table set
    twice, the second time without work; what the committed tables hold of each file."""
    import uuid

    from docspark.plans.sync import sync_once
    from docspark.session import checkpoint_dir
    folder = X.documents_folder(spark, sf, bad_utf8=True)
    tables = f"{checkpoint_dir(spark).rstrip('/')}/docspark-sync/{uuid.uuid4().hex}"
    sync_once(spark, [folder], tables, now=X.UPDATED_AT, dim=16)
    sync_once(spark, [folder], tables, now=X.UPDATED_AT + 1, dim=16)
    files = TB.read_table(spark, tables, "files", TB.FILES_SCHEMA)
    chunks = TB.read_table(spark, tables, "chunks", TB.CHUNKS_SCHEMA)
    vectors = TB.read_table(spark, tables, "vectors", TB.VECTORS_SCHEMA)
    n_chunks = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"))
    n_vectors = vectors.groupBy("source").agg(F.countDistinct("id").alias("n_vectors"))
    out = files.join(n_chunks, "source", "left").join(n_vectors, "source", "left")
    return out.select(_doc_id_of("source").alias("doc_id"), "size", "updated_at",
                      (F.coalesce("n_chunks", F.lit(0)) > 0).alias("has_chunks"),
                      F.col("n_chunks").eqNullSafe(F.col("n_vectors")).alias("vectors_agree"))


@query
def init_tables(spark, sf):
    """The tables of a fresh set, read back empty, beside the rows of a first snapshot."""
    import uuid

    from docspark.session import checkpoint_dir
    tables = f"{checkpoint_dir(spark).rstrip('/')}/docspark-sync/{uuid.uuid4().hex}"
    TB.init_tables(spark, tables)
    before = TB.read_table(spark, tables, "chunks", TB.CHUNKS_SCHEMA)
    n = TB.next_snapshot(spark, tables)
    TB.write_snapshot(_old_chunk_manifest(spark, sf), tables, "chunks", n)
    unseen = TB.read_table(spark, tables, "chunks", TB.CHUNKS_SCHEMA)
    out = before.agg(F.count(F.lit(1)).alias("n")).select(F.lit("fresh").alias("state"), "n").union(
        unseen.agg(F.count(F.lit(1)).alias("n")).select(F.lit("written"), "n"))
    TB.publish(spark, tables, n)
    after = TB.read_table(spark, tables, "chunks", TB.CHUNKS_SCHEMA)
    return out.union(after.agg(F.count(F.lit(1)).alias("n")).select(F.lit("published"), "n"))


@query
def assign_ids(spark, sf):
    """T9 + T10: given ids stay, absent ones are made; checked for uniqueness."""
    from docspark.session import cut_lineage
    d = _t(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("d"), F.col("doc_id"))).alias("id"), "text")
    v = TB.validate_columns(cut_lineage(TB.assign_ids(d)))
    return v.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("id")).alias("given"), F.length("id").alias("id_chars"))


def _vectors(spark, sf):
    e = _t(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", "embedding", F.lit(1).alias("version"))


@query
def upsert_vectors(spark, sf):
    base = _vectors(spark, sf)
    new = base.select((F.col("id") * 2).alias("id"), (F.col("label") + 100).alias("label"), "embedding",
                      F.lit(2).alias("version"))
    return TB.upsert_vectors(base, new, "id", "version").select("id", "label", "version")


@query
def delete_vectors(spark, sf):
    base = _vectors(spark, sf)
    ids = base.select((F.col("id") * 3).alias("id"))
    return TB.delete_vectors(base, ids=ids, where={"label": {"$lt": 5}}).select("id", "label")


@query
def count_vectors(spark, sf):
    return TB.count_vectors(_vectors(spark, sf))


# =============================================================== E: embedding
def _token_table(spark, sf):
    e = _t(spark, sf, "embeddings")
    n_valid = F.lit(1) + F.col("vec_id") % 8
    t = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"))
    mask = F.when(F.col("vec_id") % 2 == 0, F.col("pos") < n_valid).otherwise(F.col("pos") >= F.lit(8) - n_valid)
    return t.select(F.col("vec_id").alias("id"), "pos",
                    F.slice("embedding", F.col("pos") * 8 + 1, F.lit(8)).alias("vec"),
                    mask.cast("int").alias("mask"))


def _vec_summary(v):
    total = F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return [F.round(total, 6).alias("total"), F.round(F.element_at(v, 1).cast("double"), 6).alias("first"),
            F.size(v).alias("dim")]


@query
def last_token_pool(spark, sf):
    p = E.last_token_pool(_token_table(spark, sf))
    return p.select("id", "token_count", *_vec_summary(F.col("embedding")))


@query
def l2_normalize(spark, sf):
    e = _t(spark, sf, "embeddings")
    scaled = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("v"))
    n = E.l2_normalize(scaled, "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    return n.select("vec_id", F.round(norm, 6).alias("norm"), *_vec_summary(F.col("v")))


@query
def truncate_tokens(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    t = E.truncate_tokens(d, "tokens")
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.element_at("tokens", -1).alias("last_token"))


@query
def token_usage(spark, sf):
    d = _t(spark, sf, "documents").select(
        "source", F.size(F.split("text", " ")).alias("token_count"))
    return E.token_usage(d, "token_count", by=["source"])


@query
def embed(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "text")
    return E.embed(d, "text", dim=256).select("doc_id", "token_count", "embedding")


@query
def embed_contents(spark, sf):
    """E1 by content over all documents, the English ones embedded before: which texts are looked up,
    and whether every document has the vector that embedding it alone gives."""
    from docspark.session import cut_lineage
    d = _t(spark, sf, "documents").select("doc_id", "text", "lang")
    known = cut_lineage(E.new_contents(d.where("lang = 'en'"), spark.createDataFrame([], E.CONTENTS_SCHEMA), "hashing", dim=64))
    new = cut_lineage(E.new_contents(d, known, "hashing", dim=64))
    found = E.with_contents(d, known.unionByName(new), "hashing").withColumn("text_key", E.text_key(F.col("text")))
    alone = E.embed(d, "text", dim=64).select("doc_id", F.col("embedding").alias("own"))
    reused = new.select("text_key", F.lit(False).alias("reused"))
    return found.join(alone, "doc_id").join(reused, "text_key", "left").select(
        "doc_id", "text_key", F.coalesce("reused", F.lit(True)).alias("reused"), (F.col("embedding") == F.col("own")).alias("agrees"))


# =============================================================== R: retrieval
def _doc_vectors(spark, sf):
    e = _t(spark, sf, "embeddings")
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label").join(d, "id", "left")


def _questions(spark, sf):
    e = _t(spark, sf, "embeddings")
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return e.select(F.col("vec_id").alias("query_id"), "embedding") \
        .join(d, "query_id", "left").withColumn("query", F.coalesce("query", F.lit(""))) \
        .withColumn("k", (F.col("query_id") % 4).cast("int"))


@query
def knn(spark, sf):
    e = _t(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = R.knn(q, e, 5, id_col="vec_id")
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query
def knn_blocked(spark, sf):
    """R1 through the blocked (cogroup) strategy used for large query sets."""
    e = _t(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = R.knn(q, e, 5, id_col="vec_id", strategy="blocked", block_bytes=64 * 1024)
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def _one_hot(spark, sf):
    """Every embedding as the one-hot vector of its label: many equal distances."""
    e = _t(spark, sf, "embeddings")
    hot = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(F.col("label") % 16 == i, 1.0).otherwise(0.0))
    return e.select("vec_id", hot.alias("embedding"))


@query
def knn_ties(spark, sf):
    """R1 where hundreds of vectors are equally far: ties go to the smaller id."""
    e = _one_hot(spark, sf)
    hits = R.knn(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, 7, id_col="vec_id")
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query
def knn_ties_blocked(spark, sf):
    e = _one_hot(spark, sf)
    hits = R.knn(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, 7, id_col="vec_id", strategy="blocked",
                 block_bytes=16 * 1024)
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query
def knn_filtered_extra(spark, sf):
    """R2 on user metadata: missing keys, values of another type, not-in lists."""
    e = _t(spark, sf, "embeddings")
    v = e.select("vec_id", "embedding", "label", F.when(F.col("label") % 3 == 0, F.create_map(F.lit("n"), F.col("label").cast("string")))
                 .when(F.col("label") % 3 == 1, F.create_map(F.lit("n"), F.lit("word"))).otherwise(F.create_map(F.lit("other"), F.lit("1")))
                 .alias("extra"))
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = R.knn(q, v, 5, id_col="vec_id", where={"n": {"$nin": [3, 6]}, "$or": [{"n": {"$gt": 4}}, {"n": "word"}, {"other": 1}],
                                                 "label": {"$ne": "x"}})
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query
def knn_filtered(spark, sf):
    e = _t(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = R.knn(q, e, 5, id_col="vec_id", where={"$or": [{"label": {"$in": [1, 3, 5]}}, {"label": 8}]})
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query
def shape_results(spark, sf):
    v = _doc_vectors(spark, sf)
    e = _t(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = R.knn(q, e, 3, id_col="vec_id")
    s = R.shape_results(hits, v)
    return s.select("query_id", "rank", "id", "text", "source", F.round("distance", 6).alias("distance"))


@query
def build_context(spark, sf):
    v = _doc_vectors(spark, sf)
    e = _t(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return R.build_context(R.shape_results(R.knn(q, e, 3, id_col="vec_id"), v))


@query
def context_fallback(spark, sf):
    """R6: '' for an empty question, the fixed sentence when a question has no hit."""
    qs = _questions(spark, sf)
    hits = R.knn(qs, _t(spark, sf, "embeddings"), 3, id_col="vec_id") \
        .join(qs.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k"))
    ctx = R.build_context(R.shape_results(hits, _doc_vectors(spark, sf)))
    return R.context_fallback(qs, ctx)


@query
def rag_search(spark, sf):
    """R6 + R7: per-question k (0..3, 0 -> no hits), given query vectors."""
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return R.rag_search(_questions(spark, sf), e, k=3, k_col="k", payload=_doc_vectors(spark, sf))


@query
def knn_by_text(spark, sf):
    """Benchmark texts embedded (offline hashing model) against chunk vectors."""
    from docspark.plans.ingest import preprocess as pp
    ch = pp(X.docs_as_files(spark, sf).drop("doc_id"))
    vec = E.embed(ch, "text", dim=256).select(F.col("chunk_id").alias("id"), "embedding")
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.knn_by_text(q, vec, 5, text_col="query", dim=256)


def _stored_index(spark, sf):
    """The cell index of ``embeddings``, kept in the shared folder: built for the files as they
    are (names, lengths, times), and found again as long as they stay so."""
    import hashlib

    from docspark.operators import ann
    from docspark.session import checkpoint_dir
    e = _t(spark, sf, "embeddings")
    known = []
    for f in sorted(e.inputFiles()):
        fs, p = TB._path(spark, f)
        st = fs.getFileStatus(p)
        known.append(f"{f} {st.getLen()} {st.getModificationTime()}")
    key = hashlib.sha1("\n".join(known).encode()).hexdigest()[:16]
    table_set = f"{checkpoint_dir(spark).rstrip('/')}/docspark-index/embeddings-{key}"
    if not ann.has_index(spark, table_set):
        ann.build_index(e, table_set, id_col="vec_id")
    return table_set


@query
def knn_approx(spark, sf):
    """Search in the stored cell index (recall: ``knn_approx_recall``)."""
    from docspark.operators.ann import search_index
    e = _t(spark, sf, "embeddings")
    return search_index(e.select(F.col("vec_id").alias("query_id"), "embedding"), _stored_index(spark, sf), 5)


@query
def knn_approx_recall(spark, sf):
    """R8 against R1 for all questions: every one has min(k, n) hits, nine of ten of the exact
    ones are among them, and with ``slack`` 1 they are the exact ones."""
    from docspark.operators.ann import search_index
    index = _stored_index(spark, sf)
    e = _t(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    out = None
    for k, slack in ((5, 0.32), (50, 0.32), (5, 1.0)):
        exact = R.knn(q, e, k, id_col="vec_id").select("query_id", "id", F.lit(1).alias("x"))
        near = search_index(q, index, k, slack=slack).select("query_id", "id", F.lit(1).alias("y"))
        both = exact.join(near, ["query_id", "id"], "full").agg(F.count("x").alias("n_exact"), F.count("y").alias("n_hits"),
                                                                 F.count(F.when(F.col("x") == F.col("y"), 1)).alias("n_both"))
        row = both.select(F.lit(k).alias("k"), F.lit(slack == 1.0).alias("is_exact"), "n_hits",
                          (F.col("n_both") >= F.col("n_exact") * (1.0 if slack == 1.0 else 0.9)).alias("recall_ok"))
        out = row if out is None else out.unionByName(row)
    return out


# =============================================================== M: messages
@query
def extract_tool_calls(spark, sf):
    return M.extract_tool_calls(X.replies(spark, sf))


@query
def call_ids(spark, sf):
    return M.extract_tool_calls(X.replies(spark, sf)).select("conv_id", "turn", "ordinal", "call_id")


@query
def invalid_tool_calls(spark, sf):
    return M.invalid_tool_calls(X.replies(spark, sf))


@query
def strip_tool_calls(spark, sf):
    r = X.replies(spark, sf)
    return r.select("conv_id", "turn", M.strip_tool_calls_col(F.col("text")).alias("content"))


@query
def finish_reason(spark, sf):
    return M.finish_reason(X.replies(spark, sf))


def _transcript(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query
def format_messages(spark, sf):
    f = M.format_messages(X.replies(spark, sf))
    return f.select("conv_id", F.size("messages").alias("n_messages"), _transcript(F.col("messages")).alias("transcript"))


@query
def chat_history(spark, sf):
    r = X.replies(spark, sf).withColumn("version", F.lit(1))
    edits = r.where((F.col("role") == "user") & (F.col("turn") % 4 == 2)) \
        .withColumn("text", F.concat("text", F.lit(" (edited)"))).withColumn("version", F.lit(2))
    latest = M.chat_history(r.unionByName(edits))
    f = M.format_messages(latest)
    return f.select("conv_id", F.size("messages").alias("n_messages"), _transcript(F.col("messages")).alias("transcript"))


@query
def assemble_prompt(spark, sf):
    p = M.assemble_prompt(X.replies(spark, sf), SYSTEM_PROMPT)
    return p.select("conv_id", "turn", F.size("messages").alias("n_messages"),
                    _transcript(F.col("messages")).alias("prompt"))


@query
def last_message(spark, sf):
    return M.last_message(X.replies(spark, sf))


@query
def assistant_text(spark, sf):
    return M.assistant_text(X.replies(spark, sf)).select("conv_id", "turn", "text")


@query
def route_turn(spark, sf):
    return M.route_turn(X.replies(spark, sf))


@query
def strip_special_tokens(spark, sf):
    r = X.replies(spark, sf)
    t = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("\n")).otherwise(F.lit("")), F.col("text"),
                 F.when(F.col("turn") % 3 == 0, F.lit("<|im_end|>"))
                  .when(F.col("turn") % 3 == 1, F.lit("<|endoftext|>\n"))
                  .otherwise(F.lit("<|endoftext|><|im_end|>")))
    return M.strip_special_tokens(r.select("conv_id", "turn", t.alias("text")))


@query
def answer_tool_calls(spark, sf):
    """Each rag_search call's query ('q<n>') is answered with the given
    vector of embedding n and its own k."""
    e = _t(spark, sf, "embeddings")
    given = e.select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query"), "embedding")
    vec = e.select(F.col("vec_id").alias("id"), "embedding")
    return R.answer_tool_calls(M.extract_tool_calls(X.replies(spark, sf)), vec, query_vectors=given,
                               payload=_doc_vectors(spark, sf))


# =============================================================== W: token stream
def _deltas(spark, sf):
    """Assistant replies (plus an end token) cut into pieces of 1 + conv_id % 7
    characters in one regex pass, plus one end-marker row per chat."""
    r = X.replies(spark, sf).where(F.col("role") == "assistant")
    r = r.withColumn("text", F.concat("text", F.lit("<|im_end|>")))
    pattern = F.concat(F.lit("(?s).{1,"), (F.lit(1) + F.col("conv_id") % 7).cast("string"), F.lit("}"))
    chat = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    cut = r.select(chat.alias("chat_id"), F.regexp_extract_all("text", pattern, 0).alias("p"))
    pieces = cut.select("chat_id", F.posexplode("p").alias("seq", "delta")) \
        .select("chat_id", F.col("seq").cast("long").alias("seq"), "delta", F.lit(False).alias("is_end"))
    ends = cut.select("chat_id", F.size("p").cast("long").alias("seq"), F.lit("").alias("delta"),
                      F.lit(True).alias("is_end"))
    return pieces.unionByName(ends)


@query
def drop_empty_deltas(spark, sf):
    return W.drop_empty_deltas(_deltas(spark, sf))


@query
def assemble_stream(spark, sf):
    return W.assemble_stream(W.drop_empty_deltas(_deltas(spark, sf)))


@query
def stream_events(spark, sf):
    return W.stream_events_batch(W.drop_empty_deltas(_deltas(spark, sf)))


@query
def stream_events_streaming(spark, sf):
    """W1 as a Structured Streaming job: the deltas land as Parquet files in the
    checkpoint folder, stream through the keyed state machine with an
    available-now trigger into a Parquet file sink, and are read back."""
    import uuid

    from docspark.session import checkpoint_dir
    base = f"{checkpoint_dir(spark).rstrip('/')}/docspark-stream/{uuid.uuid4().hex}"
    late = _deltas(spark, sf).where("seq % 3 = 0")      # repeated deltas, some after the chat's end
    _deltas(spark, sf).unionByName(late).write.parquet(f"{base}/in")
    schema = "chat_id string, seq long, delta string, is_end boolean"
    events = W.stream_events(spark.readStream.schema(schema).parquet(f"{base}/in"))
    q = (events.writeStream.format("parquet").outputMode("append")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(W.EVENT_SCHEMA).parquet(f"{base}/out")


def _summary(events):
    """Of each chat: its content, the calls in it and how it ended."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "content", F.struct("ordinal", "content")))),
                                    lambda x: x["content"]), "")
    return events.groupBy("chat_id").agg(
        text.alias("content"), F.sum((F.col("kind") == "tool_call").cast("long")).alias("n_calls"),
        F.max(F.when(F.col("kind") == "done", F.col("content"))).alias("finish"))


@query
def stream_summary(spark, sf):
    """W1-W3 equal M1-M4: the stream's events against the whole replies."""
    return _summary(stream_events(spark, sf))


@query
def stream_gap(spark, sf):
    """W1 on raw deltas: stop tokens that are cut in two or stand alone, empty deltas."""
    extra = _deltas(spark, sf).select("chat_id", (F.col("seq") * 2 + 1).alias("seq"), F.lit("").alias("delta"), F.lit(False).alias("is_end"))
    return _summary(W.stream_events_batch(_deltas(spark, sf).withColumn("seq", F.col("seq") * 2).unionByName(extra)))


@query
def stream_summary_streaming(spark, sf):
    """The same through Structured Streaming, with repeated and late deltas."""
    return _summary(stream_events_streaming(spark, sf))
