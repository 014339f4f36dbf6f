"""Recursive chunking and chunk metadata.

K1 works on offsets. A text is cut at the places of the first separator that
occurs in it; cuts give spans. Spans shorter than the size are laid end to end:
with the running sum of their lengths, the furthest span that still fits in a
chunk and the first that still fits in the overlap are found by bisection, so a
chunk costs two searches whatever the number of spans. Spans that are not
shorter are cut again by the separators after it. Chunks of short spans are
trimmed, and dropped if nothing is left.

Where a tokenizer gives the places of its tokens, a text is tokenised once, and
sizes are differences in the sorted places of the tokens' borders. As a chunk by itself
may have other tokens than within its text, a chunk counts as fitting only
when its own tokens do.

K1 is an Arrow-batched pandas UDF (narrow, no shuffle); K7-K11 are column
expressions and joins of small tables.
"""

from __future__ import annotations

import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.options import CHUNK_OVERLAP, CHUNK_SIZE, DEFAULT_SEPARATORS
from docspark.session import ensure_parallelism

CHUNK_SCHEMA = "array<struct<text:string,start_index:int>>"


def clamp_overlap(size: int, overlap: int) -> int:
    """K4: an overlap over the size becomes a fifth of it."""
    return overlap if overlap <= size else max(0, size // 5)


class Chunker:
    """K1-K6. ``keep``: where a separator stays, ``"end"`` of the span before it,
    ``"start"`` (or True) of the span after it, or nowhere (False: chunks then
    join their spans with it). ``length``: what ``size`` and ``overlap`` count,
    characters if None."""

    def __init__(self, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                 separators: Sequence[str] = DEFAULT_SEPARATORS, keep: bool | str = "end",
                 length: Callable[[str], int] | None = None):
        self.size, self.overlap = int(size), clamp_overlap(int(size), int(overlap))
        self.separators, self.keep, self.length = tuple(separators), keep, length

    def spans(self, text: str, lo: int, hi: int, separator: str) -> list[tuple[int, int]]:
        """``text[lo:hi]`` cut at a separator, without empty spans; no separator: characters."""
        if not separator:
            return [(i, i + 1) for i in range(lo, hi)]
        wide, cuts, ends = len(separator), [lo], []
        at = text.find(separator, lo, hi)
        while at >= 0:
            ends.append(at + wide if self.keep == "end" else at)
            cuts.append(at if self.keep and self.keep != "end" else at + wide)
            at = text.find(separator, at + wide, hi)
        return [(a, b) for a, b in zip(cuts, [*ends, hi], strict=True) if a < b]

    def packed(self, text: str, spans: list[tuple[int, int]], separator: str) -> Iterator[str]:
        """Chunks of neighbouring short spans: as many as fit, beginning with those that fit in the overlap."""
        glue = "" if self.keep else separator
        count = self.length or len
        between = count(glue)
        sums = list(accumulate((count(text[a:b]) + between for a, b in spans), initial=0))
        first, last, n = 0, 0, len(spans)
        while last < n:
            last = max(last + 1, bisect_right(sums, sums[first] + between + self.size) - 1)
            whole = glue.join(text[a:b] for a, b in spans[first:last]) if glue else text[spans[first][0]:spans[last - 1][1]]
            if chunk := whole.strip():
                yield chunk
            if last < n:
                back = max(sums[last] - between - self.overlap, sums[last + 1] - between - self.size)
                first = min(last, bisect_left(sums, back, first))

    def cut(self, text: str, lo: int, hi: int, level: int = 0) -> Iterator[str]:
        tried = range(level, len(self.separators))
        found = next((i for i in tried if text.find(self.separators[i], lo, hi) >= 0), len(self.separators) - 1)
        separator, count = self.separators[found], self.length or len
        last = found == len(self.separators) - 1 or not separator
        short: list[tuple[int, int]] = []
        for a, b in self.spans(text, lo, hi, separator):
            if (b - a if self.length is None else count(text[a:b])) < self.size:
                short.append((a, b))
                continue
            yield from self.packed(text, short, separator)
            short = []
            if last:
                yield text[a:b]  # too long, and no separator is left: kept as it is
            else:
                yield from self.cut(text, a, b, found + 1)
        yield from self.packed(text, short, separator)

    def chunks(self, text: str | None) -> list[str]:
        return list(self.cut(text or "", 0, len(text or "")))

    def placed(self, text: str | None) -> list[tuple[str, int]]:
        """K6: each chunk with its first place at or after the end of the one before less the overlap; -1: none."""
        out, at, size = [], 0, 0
        for chunk in self.chunks(text):
            at = (text or "").find(chunk, max(0, at + size - self.overlap))
            size = len(chunk)
            out.append((chunk, at))
        return out


Spans = Sequence[tuple[int, int]]


class TokenChunker(Chunker):
    """K5 with token offsets: ``tokens`` gives the (start, end) of each token of a text, in order.

    No chunk has more than ``size`` tokens when it is tokenised by itself, but for a
    single character that has. Spans too long for any separator are cut between tokens.
    Chunks are slices of the text, separators between their spans included, so
    ``start_index`` is exact. ``overlap`` counts tokens of the whole text."""

    def __init__(self, tokens: Callable[[str], Spans], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                 separators: Sequence[str] = DEFAULT_SEPARATORS, keep: bool | str = "end"):
        super().__init__(size, overlap, separators, keep)
        if self.size < 1:
            raise ValueError("a chunk has at least one token")
        self.tokens = tokens

    def slices(self, text: str | None) -> Iterator[tuple[int, int]]:
        """The chunks' places in the text, trimmed, without empty ones."""
        found = [(a, b) for a, b in self.tokens(text or "") if a < b]
        starts, ends = sorted(a for a, _ in found), sorted(b for _, b in found)

        def inside(a: int, b: int) -> int:
            """Tokens that lie in ``[a, b)``, in part or whole."""
            return max(0, bisect_left(starts, b) - bisect_right(ends, a))

        whole = text or ""
        for a, b in self.laid(whole, self.pieces(whole, 0, len(whole), 0, starts, inside), starts, inside):
            a, b = _trimmed(whole, a, b)
            if a < b:
                yield a, b

    def pieces(self, text: str, lo: int, hi: int, level: int, starts: list[int], inside) -> Iterator[tuple[int, int, int]]:
        """Short spans in order with the number of the cut that each comes of: neighbours of one cut may share a chunk."""
        todo, groups = [(lo, hi, level, 0)], 0
        while todo:
            a, b, level, group = todo.pop()
            if level < 0:
                yield a, b, group
                continue
            groups += 1
            found = next((i for i in range(level, len(self.separators)) if self.separators[i] and text.find(self.separators[i], a, b) >= 0), None)
            if found is None:  # between its tokens; neighbours make chunks as words do
                cuts = sorted({a, *starts[bisect_right(starts, a):bisect_left(starts, b)], b})
                todo += [(x, y, -1, groups) for x, y in zip(cuts, cuts[1:])][::-1]
                continue
            parts = self.spans(text, a, b, self.separators[found])
            todo += [(x, y, -1 if inside(x, y) < self.size else found + 1, groups) for x, y in parts][::-1]

    def fits(self, text: str, a: int, b: int) -> bool:
        a, b = _trimmed(text, a, b)
        return b - a <= 1 or len(self.tokens(text[a:b])) <= self.size

    def laid(self, text: str, pieces: Iterator[tuple[int, int, int]], starts: list[int], inside) -> Iterator[tuple[int, int]]:
        for _, some in groupby(pieces, key=lambda p: p[2]):
            spans = [p[:2] for p in some]
            n, first, last = len(spans), 0, 0
            while last < n:
                begin, done = spans[first][0], last
                last = max(done + 1, bisect_right(range(n), self.size, lo=done, key=lambda i: inside(begin, spans[i][1])))
                while not self.fits(text, spans[first][0], spans[last - 1][1]):
                    if last > done + 1:      # without its last span
                        last -= max(1, (last - done - 1) // 16)
                    elif first < done:       # with less overlap
                        first += 1
                    else:
                        break
                if last == done + 1 and first == done and not self.fits(text, *spans[done]):
                    yield from self.halved(text, *spans[done], starts)
                else:
                    yield spans[first][0], spans[last - 1][1]
                if last < n:
                    end, after = spans[last - 1][1], spans[last][1]
                    first = next((i for i in range(first, last) if inside(spans[i][0], end) <= self.overlap
                                  and inside(spans[i][0], after) <= self.size), last)

    def halved(self, text: str, a: int, b: int, starts: list[int]) -> Iterator[tuple[int, int]]:
        """A span that does not fit by itself, cut at its middle token, or its middle character, until its parts do."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self.fits(text, a, b):
                yield a, b
                continue
            x, y = bisect_right(starts, a), bisect_left(starts, b)
            cut = starts[(x + y) // 2] if x < y else (a + b) // 2
            todo += [(cut, b), (a, cut)]

    def chunks(self, text: str | None) -> list[str]:
        return [(text or "")[a:b] for a, b in self.slices(text)]

    def placed(self, text: str | None) -> list[tuple[str, int]]:
        return [((text or "")[a:b], a) for a, b in self.slices(text)]


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while a < b and text[b - 1].isspace():
        b -= 1
    return a, b


def chunker(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = DEFAULT_SEPARATORS,
            keep: bool | str = "end", unit: str = "char", length: Callable[[str], int] | None = None,
            tokens: Callable[[str], Spans] | None = None) -> Chunker:
    """K5: ``unit`` "token" counts by ``tokens`` (the places of a text's tokens: one call a text and one a
    chunk, sizes hold) or by ``length`` (the length of a piece, one call each; sums of
    pieces are taken for the length of a chunk); without either it warns and counts characters."""
    if unit not in ("char", "token"):
        raise ValueError(f"unknown length unit {unit!r}")
    if unit == "token" and tokens is not None:
        return TokenChunker(tokens, size, overlap, separators, keep)
    if unit == "token" and length is None:
        warnings.warn("no token length function given: chunk sizes count characters", stacklevel=2)
    return Chunker(size, overlap, separators, keep, length if unit == "token" else None)


def recursive_chunks(df: DataFrame, text_col: str = "text", start_index: bool = True, **how) -> DataFrame:
    """K1 (+K2-K6, see ``chunker``): one row per chunk with ``chunk_pos`` (position in
    its section), ``start_index`` (relative to the section) and ``text``.
    Other columns are carried through."""
    cutter = chunker(**how)

    @F.pandas_udf(CHUNK_SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in T.pieces(batches):
            yield texts.map(lambda t: [{"text": c, "start_index": at if start_index else None} for c, at in cutter.placed(t)])

    df = ensure_parallelism(df)
    others = [c for c in df.columns if c != text_col]
    call = run.asNondeterministic()(F.col(text_col))     # so that no filter copies the call
    return (df.select(*others, call.alias("_chunks"))
              .select(*others, F.posexplode("_chunks").alias("chunk_pos", "_c"))
              .select(*others, "chunk_pos", F.col("_c.text").alias(text_col),
                      F.col("_c.start_index").alias("start_index")))


def add_end_index(df: DataFrame, text_col: str = "text") -> DataFrame:
    """K7."""
    return df.withColumn("end_index", F.col("start_index") + F.length(text_col))


def add_chunk_index(df: DataFrame, key: str = "source",
                    order_cols: Sequence[str] = ("page", "section", "chunk_pos")) -> DataFrame:
    """K8: 0-based position of the chunk inside its file, across pages and sections.

    Skew-safe form: chunks are counted per section (a map-side-combining
    aggregate over tiny rows), a running sum over those counts per file gives
    each section's offset, and the offsets are joined back on the section key.
    A file holding a large share of all chunks therefore never sends its
    chunk rows (with their text) to a single task; only its per-section
    counts meet in one window partition. When ``order_cols`` has no
    within-section position the plain window is used."""
    order_cols = list(order_cols)
    pos = order_cols[-1]
    sec = order_cols[:-1]
    if not sec:
        w = Window.partitionBy(key).orderBy(F.col(pos).asc_nulls_first())
        return df.withColumn("chunk_index", F.row_number().over(w) - 1)
    # null-safe surrogate keys for the join (page is often NULL)
    keyed = df
    for c in sec:
        keyed = keyed.withColumn(f"_k_{c}", F.coalesce(F.col(c).cast("string"), F.lit("\u0000")))
    kcols = [key] + [f"_k_{c}" for c in sec]
    counts = keyed.groupBy(*kcols, *[F.col(c) for c in sec]).agg(F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in sec])
         .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*kcols, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # rank inside the section, partitioned by the join keys so the join below
    # reuses this partitioning (one shuffle of the chunk rows in total)
    within = Window.partitionBy(*kcols).orderBy(F.col(pos).asc_nulls_first())
    ranked = keyed.withColumn("_r", F.row_number().over(within) - 1)
    out = ranked.join(offsets, kcols, "inner")
    return out.withColumn("chunk_index", (F.col("_off") + F.col("_r")).cast("int")) \
              .drop("_off", "_r", *[f"_k_{c}" for c in sec])


def add_citation(df: DataFrame) -> DataFrame:
    """K9: ``name#p{page}`` when the page is known, else ``name#chunk{i}``; existing wins."""
    existing = F.col("citation") if "citation" in df.columns else None
    return df.withColumn("citation", T.citation(F.col("file_name"), F.col("page_1based"),
                                                F.col("chunk_index"), existing))


def add_chunk_id(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Content-addressed id; page falls back page_1based -> page -> ''."""
    page = F.coalesce(F.col("page_1based").cast("string"), F.col("page").cast("string"))
    return df.withColumn("chunk_id", T.chunk_id(F.col("source"), page, F.col("start_index"),
                                                F.col(text_col)))


def dedupe_chunks(df: DataFrame, id_col: str = "chunk_id",
                  order_cols: Sequence[str] = ("chunk_index",)) -> DataFrame:
    """Keep the first row per id (deterministic, unlike dropDuplicates).

    An aggregation, not a window: ``min_by`` combines map-side, so an id
    repeated millions of times (boilerplate text) is reduced in every task
    before the shuffle instead of landing whole in one task."""
    cols = [c for c in df.columns if c != id_col]
    key = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in cols if c not in order_cols])
    best = F.min_by(F.struct(*[F.col(c) for c in cols]), key).alias("_first")
    return df.groupBy(id_col).agg(best).select(id_col, "_first.*").select(*df.columns)
