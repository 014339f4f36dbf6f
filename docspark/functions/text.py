"""Column expressions for text cleaning and ids (JVM regex, whole-stage codegen).

Java and Python regex differ in places; each pattern below is written so the
Java engine gives what Python's ``str``/``re`` operations give:

* Python ``str.strip()`` removes Unicode White_Space *and* U+001C..U+001F;
  Java ``(?U)\\s`` lacks the latter, so they are added explicitly.
* Java ``\\v`` is a class of vertical white space, so VT is written ``\\x0b``.
* ``(?d)`` (UNIX_LINES) keeps U+0085/U+2028/U+2029/CR from ending lines.
* Replacement strings carry real LF characters, not backslash escapes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

_WS = r"[\s\x1c-\x1f]"               # Python str.isspace() set, under (?U)
_WS_NO_LF = r"[[\s\x1c-\x1f]&&[^\n]]"


def remove_null_bytes(c: Column) -> Column:
    return F.regexp_replace(c, r"\x00", "")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def strip_control_chars(c: Column) -> Column:
    # keeps TAB, LF and CR
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def dehyphenate(c: Column) -> Column:
    # Python's Unicode \w; non-overlapping, left to right like re.sub
    return F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")


def strip_lines(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?Umd)^{_WS_NO_LF}+|{_WS_NO_LF}+$", "")


def collapse_inline_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\f\x0b]+", " ")


def collapse_blank_lines(c: Column, n: int = 2) -> Column:
    n = max(1, int(n))
    return F.regexp_replace(c, r"\n{" + str(n + 1) + ",}", "\n" * n)


def final_strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{_WS}+|{_WS}+\z", "")


def file_ext(path: Column) -> Column:
    """Lower-case suffix with its dot ('' when none), like ``Path.suffix.lower()``.

    A leading dot of the name alone is not a suffix (``.bashrc`` has none).
    """
    name = file_name(path)
    ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)\z", 1)
    # Path('a.').suffix == '' : a bare trailing dot is no suffix
    return F.lower(F.when(ext == ".", F.lit("")).otherwise(ext))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def chunk_id(source: Column, page: Column, start: Column, text: Column) -> Column:
    """sha1 of ``source||p=<page>||s=<start>||th=<sha1(text)>`` (missing parts are '')."""
    return F.sha1(F.concat(
        F.coalesce(source.cast("string"), F.lit("")), F.lit("||p="),
        F.coalesce(page.cast("string"), F.lit("")), F.lit("||s="),
        F.coalesce(start.cast("string"), F.lit("")), F.lit("||th="),
        F.sha1(F.coalesce(text, F.lit("")))))


def citation(file_name_: Column, page_1based: Column, chunk_index: Column,
             existing: Column | None = None) -> Column:
    derived = F.when(page_1based.isNotNull(),
                     F.concat(file_name_, F.lit("#p"), page_1based.cast("string"))) \
        .otherwise(F.concat(file_name_, F.lit("#chunk"), chunk_index.cast("string")))
    return derived if existing is None else F.coalesce(existing, derived)


#: Characters that a Python UDF takes at a time.
PIECE = 1 << 20


def pieces(batches: Iterator[pd.Series], most: int = PIECE) -> Iterator[pd.Series]:
    """The Arrow batches of texts, or of arrays of texts, in runs of some ``most`` characters, so that what a
    UDF makes of a batch is never held whole."""
    for s in batches:
        first, size = 0, 0
        for i, x in enumerate(s):
            size += 0 if x is None else len(x) if isinstance(x, str) else sum(len(t or "") for t in x)
            if size >= most:
                yield s.iloc[first:i + 1]
                first, size = i + 1, 0
        if first < len(s):
            yield s.iloc[first:]
