"""Preprocess -- documents -> sections -> clean -> chunks -> metadata -> ids.

Input: rows of loaded documents with at least ``source`` and ``text``; optional
``file_name, file_ext, file_size, file_mtime, page, citation, row``. Output: the
that user metadata reaches the search.

The steps are array columns of the document's row: its sections (P4), their
texts cleaned (C11, NFKC being the one step outside the JVM), their chunks
(K1). Exploding the chunks gives their place in the document, so documents that
are a whole file need no shuffle at all. Rows of a file that is several rows
(CSV rows, pages) get their place from the small table of their chunk counts.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import chunks as K
from docspark.operators import clean as C
from docspark.operators import sections as P
from docspark.session import ensure_parallelism
from docspark.sources.files import file_metadata

CHUNK_COLUMNS = ["chunk_id", "source", "file_name", "file_ext", "file_size", "file_mtime",
                 "page", "page_1based", "h1", "h2", "h3", "h4", "chunk_index", "start_index",
                 "end_index", "citation", "text"]
#: Columns of a load that say nothing of the text.
_INTERNAL = ("path", "content", "length", "modificationTime", "json_value", "section", "chunk_pos")


def _texts_column(sections: Column, steps: Collection[str], blank_lines: int) -> Column:
    """The sections' texts, cleaned."""
    @F.pandas_udf("array<string>")
    def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata
        for texts in T.pieces(batches):
            yield texts.map(lambda many: None if many is None else [unicodedata.normalize("NFKC", t or "") for t in many])

    texts = F.transform(sections, lambda s: F.coalesce(s["text"], F.lit("")))
    if "nfkc" in steps:
        if "null_bytes" in steps:  # comes before NFKC
            texts = F.transform(texts, T.remove_null_bytes)
        wide = F.exists(texts, lambda t: t.rlike(r"[^\x00-\x7f]"))
        texts = F.coalesce(nfkc.asNondeterministic()(F.when(wide, texts)), texts)
    rest = [s for s in steps if s != "nfkc"]
    return F.transform(texts, lambda t: C.cleaned(t, rest, blank_lines))


def _chunks_column(texts: Column, cutter: K.Chunker) -> Column:
    @F.pandas_udf(f"array<{K.CHUNK_SCHEMA}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in T.pieces(batches):
            yield many.map(lambda ts: [[{"text": c, "start_index": at} for c, at in cutter.placed(t)] for t in ts])
    return run.asNondeterministic()(texts)


def _finish(d: DataFrame, extra: Sequence[str]) -> DataFrame:
    d = K.add_chunk_id(K.add_citation(K.add_end_index(d)))
    return d.select(*CHUNK_COLUMNS, *extra)


def preprocess(docs: DataFrame, registry=None, steps: Collection[str] = C.DEFAULT_STEPS, blank_lines: int = 2,
               kinds: Sequence[str] = ("md", "html", "json"), sections: dict | None = None, **how) -> DataFrame:
    """A row a chunk. ``steps`` and ``blank_lines``: see ``clean.cleaned``; ``kinds`` and
    ``sections``: see ``sections.sections_column``; the rest: see ``chunks.chunker``.

    ``chunk_index`` counts a file's chunks by page, row, section and place. Two
    documents of one source without page and row are each counted from 0:
    list a file once."""
    d = file_metadata(docs)
    cutter = K.chunker(**how)
    extra = [c for c in d.columns if c not in CHUNK_COLUMNS and c not in _INTERNAL]
    if registry is not None and (registry.splitters or registry.chunkers):
        return _finish(_with_registry(d, registry, steps, blank_lines, kinds, sections or {}, how), extra)
    d = ensure_parallelism(d)
    several = [c for c in ("page", "row") if c in d.columns and c in docs.columns]
    if not several:
        return _finish(_chunk_rows(d, cutter, steps, blank_lines, kinds, sections or {}, []), extra)
    # the one row of a plain file needs no join: only files of several rows pass the shuffle
    many = F.lit(False)
    for c in several:
        many = many | F.col(c).isNotNull()
    parts = [_chunk_rows(some, cutter, steps, blank_lines, kinds, sections or {}, order)
             for some, order in ((d.where(~many), []), (d.where(many), several))]
    return _finish(parts[0].unionByName(parts[1]), extra)


def _chunk_rows(d: DataFrame, cutter, steps, blank_lines: int, kinds, sections: dict, several: Sequence[str]) -> DataFrame:
    """A row a chunk with ``chunk_index``; ``several``: what orders the rows of a file, if it has more than one."""
    prior = [h for h in P.HEADER_KEYS if h in d.columns]
    keep = [c for c in d.columns if c not in ("text", *P.HEADER_KEYS, *_INTERNAL)]
    found = P.sections_column(F.col("text"), F.col("file_ext"), kinds, cutter.size, **sections)
    d = d.select(*keep, *prior, found.alias("_sections"))
    d = d.withColumn("_texts", _texts_column(F.col("_sections"), steps, blank_lines))
    d = d.withColumn("_chunks", _chunks_column(F.col("_texts"), cutter)).drop("_texts")

    def laid(chunks: Column, i: Column) -> Column:
        at = F.get(F.col("_sections"), i)
        heads = [F.coalesce(at[h], F.col(h)).alias(h) if h in prior else at[h].alias(h) for h in P.HEADER_KEYS]
        return F.transform(chunks, lambda c: F.struct(*heads, c["start_index"].alias("start_index"), c["text"].alias("text")))

    rows = d.select(*keep, F.flatten(F.transform("_chunks", laid)).alias("_rows"))
    rows = _placed(rows, several) if several else rows.withColumn("_before", F.lit(0).cast("bigint"))
    # the outer form: an inner one would infer a filter on the array, and so compute it twice
    rows = rows.select(*keep, F.col("_before").alias("_first"), F.posexplode_outer("_rows").alias("_at", "_c")).where("_c is not null")
    rows = rows.withColumn("chunk_index", (F.col("_first") + F.col("_at")).cast("int"))
    return rows.select(*keep, "chunk_index", "_c.*")


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``_before``: chunks of the rows before in the file. The chunk counts alone meet by file."""
    part = F.struct("source", *order)
    counts = rows.groupBy(part.alias("_part")).agg(F.sum(F.size("_rows")).alias("_n"))
    before = Window.partitionBy("_part.source").orderBy(*[F.col(f"_part.{c}").asc_nulls_first() for c in order])
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(counts, "_part").drop("_part")


def _with_registry(d: DataFrame, registry, steps, blank_lines, kinds, sections, how) -> DataFrame:
    """The operators one after the other: user splitters and chunkers work on rows."""
    d = P.structure_split(d, kinds, int(how.get("size", K.CHUNK_SIZE)), registry=registry, **sections)
    d = C.clean_text(d, "text", steps, blank_lines)
    d = registry.apply_chunkers(d, **how) if registry.chunkers else K.recursive_chunks(d, "text", **how)
    order = ("page", "row", "section", "chunk_pos") if "row" in d.columns else ("page", "section", "chunk_pos")
    return K.add_chunk_index(d, "source", order)
