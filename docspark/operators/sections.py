"""Structure (section) splitting by file kind.

A document's sections are an array column, so no document leaves its task and
nothing is shuffled; ``posexplode`` makes rows of them.

* Markdown (P1) is column expressions only: a regular expression cuts the text
  into lines and whole fenced blocks, header lines become marked headings, and
  one fold over the headings carries the path down.
* HTML (P2) needs a tolerant parser and JSON (P3) a walk of nested values:
  these are Arrow-batched pandas UDFs that return the array.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.session import ensure_parallelism

HEADER_KEYS = ("h1", "h2", "h3", "h4")
SECTION = "struct<h1:string,h2:string,h3:string,h4:string,text:string>"
KIND_BY_EXT = {".md": "md", ".html": "html", ".htm": "html", ".json": "json"}

# Marks inside a text while it is cut: between its parts, before a heading, after its name.
# They are private-use characters, which P1 drops from the text beforehand.
_PART, _HEAD, _NAME = "\ue000", "\ue001", "\ue002"
#: A fenced block up to its closing line or the end of the text; a line.
_FENCED = "|".join(rf"{fence}(?s:.*?)(?:\n{mark}[^\n]*|(?=\n\z))\n"
                   for fence, mark in (("```(?![^\n]*```)", "```"), ("~~~", "~~~")))
_LINES = rf"{_FENCED}|[^\n]*\n"


# ------------------------------------------------------------------ P1
def markdown_column(text: Column, strip_headers: bool = True) -> Column:
    """Sections of a Markdown text as an array of SECTION.

    A header is a line of one to four ``#`` and then a space or the line's end;
    it closes deeper ones; lines inside fenced code are never headers; blank
    lines part blocks, which are joined with two spaces and a line feed, as are
    neighbours of one header path; sections without text vanish."""
    plain = F.regexp_replace(T.strip_lines(F.coalesce(text, F.lit(""))), r"[\p{C}\p{Z}&&[^ \n]]", "")
    parts = F.regexp_extract_all(F.concat(plain, F.lit("\n")), F.lit(_LINES), F.lit(0))

    def marked(part: Column) -> Column:
        part = F.substring(part, F.lit(1), F.length(part) - 1)  # without its line feed
        heading = F.concat(F.lit(_HEAD), F.regexp_replace(part, r"^(#{1,4})(?: +(.*))?$", f"$1{_NAME}$2{_NAME}"))
        if not strip_headers:
            heading = F.concat(heading, F.lit(_PART), part)
        return F.when(part.rlike("^#{1,4}(?: |$)"), heading).otherwise(part)

    cut = F.split(F.array_join(F.transform(parts, marked), _PART), _HEAD)
    # of each piece: its heading's level and name (none for what comes before the first), and its text
    pieces = F.transform(cut, lambda p: F.struct(
        F.when(F.contains(p, F.lit(_NAME)), F.length(F.substring_index(p, _NAME, 1))).alias("level"),
        F.substring_index(F.substring_index(p, _NAME, 2), _NAME, -1).alias("name"),
        F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring_index(p, _NAME, -1), f"^{_PART}+|{_PART}+$", ""),
                                          f"{_PART}{{2,}}", "  \n"), _PART, "\n").alias("text")))
    # bound to a lambda variable, so that the pieces are made once and not once a block
    return F.get(F.transform(F.array(pieces), _sections_of_pieces), 0)


#: Pieces folded into one array: an array grows by copies, so a long text is folded block by block.
_BLOCK_PIECES = 256


def _sections_of_pieces(pieces: Column) -> Column:
    """The fold of P1: the header path in force and the open section are carried along;
    a section is put out when a piece of another path comes."""
    none = [F.lit(None).cast("string").alias(h) for h in HEADER_KEYS]

    def state_of(path, last, out) -> Column:
        return F.struct(*path, last.cast(SECTION).alias("last"), out.alias("out"))

    def step(state: Column, piece: Column) -> Column:
        path = [F.when(piece["level"].isNull() | (piece["level"] > k), state[h]).when(piece["level"] == k, piece["name"]).alias(h)
                for k, h in enumerate(HEADER_KEYS, 1)]
        last = state["last"]
        same = last.isNotNull()
        for h, now in zip(HEADER_KEYS, path, strict=True):
            same = same & last[h].eqNullSafe(now)
        text = F.when(same, F.concat(last["text"], F.lit("  \n"), piece["text"])).otherwise(piece["text"])
        keep = piece["text"] == ""
        out = F.when(keep | same | last.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(last)))
        return state_of(path, F.when(keep, last).otherwise(F.struct(*path, text.alias("text")).cast(SECTION)), out)

    def block(state: Column, at: Column) -> Column:
        inner = state_of([state[h].alias(h) for h in HEADER_KEYS], state["last"], F.array().cast(f"array<{SECTION}>"))
        some = F.slice(pieces, at * _BLOCK_PIECES + 1, F.lit(_BLOCK_PIECES))
        # one fold a block: its result is a lambda variable, too
        folded = F.aggregate(some, inner, step)
        return F.get(F.transform(F.array(folded), lambda f: state_of([f[h].alias(h) for h in HEADER_KEYS], f["last"],
                                                                     F.concat(state["out"], F.array(f["out"])))), 0)

    start = state_of(none, F.lit(None), F.array().cast(f"array<array<{SECTION}>>"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK_PIECES).cast("int"))
    return F.aggregate(blocks, start, block, lambda s: F.when(s["last"].isNull(), F.flatten(s["out"])).otherwise(
        F.concat(F.flatten(s["out"]), F.array(s["last"]))))


# ------------------------------------------------------------------ P2
class _HtmlSections(HTMLParser):
    """Text grouped by the headers in force. Script and style need their closing
    tag; the head ends with ``</head>``, ``<body>`` or any tag of the body."""

    _RAW = frozenset({"script", "style"})
    _HEAD_ONLY = frozenset({"meta", "link", "base", "title", "noscript", "head", "html"})
    _BLOCK = frozenset({"p", "div", "li", "ul", "ol", "br", "tr", "td", "th", "table", "section", "article", "nav", "header", "footer",
                        "pre", "blockquote", "main", "aside", "h5", "h6", "dd", "dt", "body", "form", "hr"})

    def __init__(self, headers: dict[str, str], each_element: bool):
        super().__init__(convert_charrefs=True)
        self.headers, self.each = headers, each_element
        self.path: dict[str, str] = {}
        self.raw: str | None = None
        self.in_head = self.in_title = False
        self.heading: str | None = None
        self.words: list[str] = []
        self.lines: list[str] = []
        self.out: list[tuple[dict[str, str], str]] = []

    def _text(self) -> str:
        text, self.words = " ".join("".join(self.words).split()), []
        return text

    def _end_line(self) -> None:
        """The line, or the header, that was open is complete."""
        text = self._text()
        if self.heading:
            level = int(self.heading[1:])
            self.path = {k: v for k, v in self.path.items() if int(k[1:]) < level} | {self.heading: text}
            self.heading = None
        elif text:
            self.lines.append(text)
            if self.each:
                self._end_section()

    def _end_section(self) -> None:
        if self.lines:
            self.out.append(({self.headers[t]: v for t, v in self.path.items()}, "  \n".join(self.lines)))
        self.lines = []

    def handle_starttag(self, tag, attrs):
        if tag in self._RAW:
            self.raw = tag
        elif tag == "head":
            self.in_head = True
        elif tag == "title":
            self.in_title = True
        elif tag == "noscript":  # text for readers without scripts: a block of the page like any other
            if not self.in_head:
                self._end_line()
        else:
            if tag not in self._HEAD_ONLY:
                self.in_head = self.in_title = False
            if tag in self.headers:
                self._end_line()
                self._end_section()
                self.heading = tag
            elif tag in self._BLOCK:
                self._end_line()

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None
        elif tag == "head":
            self.in_head = self.in_title = False
        elif tag == "title":
            self.in_title = False
        elif tag == "noscript":
            if not self.in_head:
                self._end_line()
        elif tag in self._BLOCK or tag in self.headers:
            self._end_line()

    def handle_data(self, data):
        if not (self.raw or self.in_head or self.in_title):
            self.words.append(data)

    def sections(self):
        self._end_line()
        self._end_section()
        return self.out


def html_sections_of(html: str, levels: int = 4, each_element: bool = False) -> list[dict[str, Any]]:
    parser = _HtmlSections({h: h for h in HEADER_KEYS[:levels]}, each_element)
    parser.feed(html)
    parser.close()
    return [{**dict.fromkeys(HEADER_KEYS), **path, "text": text} for path, text in parser.sections()]


# ------------------------------------------------------------------ P3
def _indexed(value):
    """Lists as objects keyed by index, all the way down."""
    if isinstance(value, list):
        value = {str(i): v for i, v in enumerate(value)}
    return {k: _indexed(v) for k, v in value.items()} if isinstance(value, dict) else value


def json_pieces(value: dict, limit: int = 1000, convert_lists: bool = False, least: int | None = None) -> list[str]:
    """An object as pieces of at most ``limit`` characters, each a JSON object that keeps the key paths.

    Members go in order into the open piece while they fit whole. One that does
    not is opened: its members follow in its place, in a new piece if the open
    one holds ``least`` characters. What cannot be opened goes in as it is, so
    one long list or text may pass the limit."""
    least = max(limit - 200, 50) if least is None else least
    done: list[str] = []
    piece: dict = {}
    # members still to place, the next one last: path and value
    todo: list[tuple[tuple[str, ...], Any]] = [((k,), v) for k, v in reversed((_indexed(value) if convert_lists else value).items())]

    def put(path: tuple[str, ...], v) -> None:
        at = piece
        for key in path[:-1]:
            at = at.setdefault(key, {})
        at[path[-1]] = v

    while todo:
        path, v = todo.pop()
        used = len(json.dumps(piece))
        if len(json.dumps({path[-1]: v})) < limit - used:
            put(path, v)
            continue
        if used >= least:
            done.append(json.dumps(piece, ensure_ascii=False))
            piece = {}
        if isinstance(v, dict):
            todo += [((*path, k), inner) for k, inner in reversed(v.items())]
        else:
            put(path, v)
    return [*done, json.dumps(piece, ensure_ascii=False)] if piece else done


# ------------------------------------------------------------ array columns
def _whole(text: str) -> list[dict[str, Any]]:
    return [{**dict.fromkeys(HEADER_KEYS), "text": text}]


def html_column(text: Column, levels: int = 4, each_element: bool = False) -> Column:
    """P2 as an array of SECTION; a text that cannot be parsed is one section, null is null."""
    def one(t: str | None):
        if t is None:
            return None
        try:
            return html_sections_of(t, levels, each_element)
        except Exception:
            return _whole(t)

    @F.pandas_udf(f"array<{SECTION}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)
    return run.asNondeterministic()(text)     # so that no filter copies the call


def json_column(text: Column, limit: int = 1000, convert_lists: bool = False) -> Column:
    """P3 as an array of SECTION; what is no JSON object is one section, null is null."""
    def one(t: str | None):
        if t is None:
            return None
        try:
            value = json.loads(t)
            pieces = json_pieces(value, limit, convert_lists) if isinstance(value, dict) else [t]
        except Exception:
            pieces = [t]
        return [s for p in pieces for s in _whole(p)]

    @F.pandas_udf(f"array<{SECTION}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)
    return run.asNondeterministic()(text)


def whole_column(text: Column) -> Column:
    none = [F.lit(None).cast("string").alias(h) for h in HEADER_KEYS]
    return F.array(F.struct(*none, F.coalesce(text, F.lit("")).alias("text")).cast(SECTION))


def sections_column(text: Column, ext: Column, kinds: Sequence[str] = ("md", "html", "json"), limit: int = 1000,
                    convert_lists: bool = False, strip_headers: bool = True, each_element: bool = False) -> Column:
    """P4 as an array of SECTION, by file extension; kinds that are not asked for stay whole.
    Only texts of a kind are sent to its UDF."""
    def is_kind(kind: str) -> Column:
        return ext.isin([e for e, k in KIND_BY_EXT.items() if k == kind])

    t = F.coalesce(text, F.lit(""))
    out = F.when(F.lit(False), whole_column(text))
    if "md" in kinds:
        out = out.when(is_kind("md"), markdown_column(text, strip_headers))
    if "html" in kinds:
        out = out.when(is_kind("html"), html_column(F.when(is_kind("html"), t), each_element=each_element))
    if "json" in kinds:
        out = out.when(is_kind("json"), json_column(F.when(is_kind("json"), t), limit, convert_lists))
    return out.otherwise(whole_column(text))


# ------------------------------------------------------------------ rows
def _explode(df: DataFrame, sections: Column, text_col: str) -> DataFrame:
    others = [c for c in df.columns if c not in (text_col, "section", *HEADER_KEYS)]
    prior = [h for h in HEADER_KEYS if h in df.columns]
    rows = df.select(*others, *prior, sections.alias("_sections"))
    # the outer form: an inner one would infer a filter on the array, and so compute it twice
    rows = rows.select(*others, *prior, F.posexplode_outer("_sections").alias("section", "_s")).where("_s is not null")
    # P5: the document's keys first, the section's override them
    heads = [F.coalesce(F.col(f"_s.{h}"), F.col(h)).alias(h) if h in prior else F.col(f"_s.{h}").alias(h) for h in HEADER_KEYS]
    return rows.select(*others, "section", *heads, F.col("_s.text").alias(text_col))


def markdown_sections(df: DataFrame, text_col: str = "text", strip_headers: bool = True) -> DataFrame:
    """A row a section."""
    return _explode(ensure_parallelism(df), markdown_column(F.col(text_col), strip_headers), text_col)


def html_sections(df: DataFrame, text_col: str = "text", each_element: bool = False) -> DataFrame:
    """A row a section; on parser failure the document is kept whole."""
    return _explode(ensure_parallelism(df), html_column(F.coalesce(text_col, F.lit("")), each_element=each_element), text_col)


def json_sections(df: DataFrame, text_col: str = "text", limit: int = 1000, convert_lists: bool = False) -> DataFrame:
    """A row a piece; unparseable or non-object JSON is kept whole."""
    return _explode(ensure_parallelism(df.drop("json_value")),
                    json_column(F.coalesce(text_col, F.lit("")), limit, convert_lists), text_col)


def structure_split(df: DataFrame, kinds: Sequence[str] = ("md", "html", "json"), limit: int = 1000, registry=None,
                    text_col: str = "text", **how) -> DataFrame:
    """Pick the splitter by extension (.md, .html/.htm, .json); a kind that is
    not asked for passes through whole, which also wins over a registered
    splitter; other extensions pass through as one section. Registered
    splitters (U2) get their own branch for their extensions."""
    df = df.drop("json_value")
    custom = {e: fn for e, fn in (registry.splitters if registry is not None else {}).items()
              if KIND_BY_EXT.get(e) in (None, *kinds)}
    ext = F.col("file_ext")
    rest = df.where(~ext.isin(list(custom)) | ext.isNull()) if custom else df
    out = _explode(ensure_parallelism(rest), sections_column(F.col(text_col), ext, kinds, limit, **how), text_col)
    for e, fn in custom.items():
        part = fn(df.where(ext == e))
        if "section" not in part.columns:
            part = part.withColumn("section", F.lit(0))
        out = out.unionByName(part, allowMissingColumns=True)
    return out

