"""License scans by conditional compression.

A document's blocks (lines, and paragraphs of several lines) that hold a cue
word are candidates. Windows around their cues, three times as long as the
longest notice, are compressed with zstandard, alone and once with every
template as raw dictionary, and the templates are ranked by the bytes they save.
In that order they are compared by the exact differences in wording, and the first
that is confirmed wins: every word of the template is there, in order, and next to
none stands between them but in the template's variable parts. So of notices that
begin alike, the one that explains most of the window is reported. Scans are row-local, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import workers_ready

#: Notices by licence, as their licences word them; <...> marks a variable part of at most VARIABLE words.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "all-rights-reserved": ("All rights reserved.", "Copyright <year and holder>. All rights reserved."),
}

CUES = ("licen", "rights reserved", "permission", "redistribution", "copyright", "released under")
#: Words that a variable part may hold.
VARIABLE = 12
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_TEMPLATE_WORD = re.compile(r"<[^<>]*>|" + _WORD.pattern)
_CUE = re.compile("|".join(CUES))
#: Windows whose result a worker keeps at once.
_KEPT = 20_000


def template_words(text: str) -> list[str]:
    """A template's words; an empty one is a variable part."""
    return ["" if w[0] == "<" else w.lower() for w in _TEMPLATE_WORD.findall(text)]


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str], tuple[int, int]]:
    """Words of the template that the block lacks, words that stand between its
    words beyond the variable parts, and the first and last word matched."""
    steps = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    equal = [s for s in steps if s[0] == "equal"]
    if not equal:
        return [w for w in template if w], [], (0, 0)
    first, last = equal[0][3], equal[-1][4]
    missing, extra = [], []
    for kind, a, b, c, d in steps:
        if kind != "equal":
            missing += [w for w in template[a:b] if w]
            between = block[max(c, first):min(d, last)]
            extra += between[VARIABLE if "" in template[a:b] else 0:]
    return missing, extra, (first, last)


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the lines with a cue, and of the paragraphs of several lines that hold one."""
    at, para = 0, []
    for line in [*text.split("\n"), ""]:
        low = line.lower()
        if line.strip():
            para.append((at, at + len(line), any(cue in low for cue in CUES)))
            if para[-1][2]:
                yield para[-1][:2]
        else:
            joined = text[para[0][0]:para[-1][1]].lower() if len(para) > 1 else ""
            if any(cue in joined for cue in CUES) or any(cue in " ".join(joined.split()) for cue in CUES):
                yield para[0][0], para[-1][1]
            para = []
        at += len(line) + 1


def joined(said: list[str]) -> tuple[str, list[int]]:
    """Words as one text, each with a space after it, and where each begins."""
    starts, at = [], 0
    for w in said:
        starts.append(at)
        at += len(w) + 1
    return "".join([w + " " for w in said]), starts


def wording(fixed: list[str]) -> re.Pattern:
    """A template's words in ``joined`` text, with nothing between them but in its variable parts."""
    return re.compile("(?<![^ ])" + "".join([re.escape(w) + " " if w else f"(?:[^ ]+ ){{0,{VARIABLE}}}?" for w in fixed]))


class Scanner:
    """Ranks templates for a window by the bytes that each saves as a dictionary."""

    def __init__(self, templates: dict[str, tuple[str, ...]], tried: int | None = None, level: int = 3):
        self.known = [(name, text, template_words(text)) for name, texts in templates.items() for text in texts]
        self.wordings = [wording(fixed) for _, _, fixed in self.known]
        #: Words that a notice may hold: its template's, its variable parts' and a tenth more.
        self.longest = max((len(f) + len(f) // 10 + VARIABLE * f.count("") for _, _, f in self.known), default=0)
        self.tried, self.seen = tried, {}
        make = zstandard.ZstdCompressor
        self.alone = make(level=level, write_content_size=False)
        self.given = [make(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
            " ".join(fixed).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, _, fixed in self.known]

    def rank(self, said: list[str]) -> list[tuple[int, int]]:
        """(bytes saved, template number), the largest saving first; ties in template order."""
        data = " ".join(said).encode("utf-8", "replace")
        base = len(self.alone.compress(data))
        saved = [(base - len(c.compress(data)), i) for i, c in enumerate(self.given)]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def match(self, said: list[str]) -> tuple | None:
        """(first word, word after the last, license, template, saved, extra words) of the
        first template that is confirmed, in the order of the rank, among the ``tried`` best or all."""
        window, starts = joined(said)
        if window not in self.seen:
            if len(self.seen) > _KEPT:
                self.seen.clear()
            self.seen[window] = self._match(said, window, starts)
        return self.seen[window]

    def _match(self, said: list[str], window: str, starts: list[int]) -> tuple | None:
        there = {"", *said}
        for saved, i in self.rank(said)[:self.tried]:
            name, text, fixed = self.known[i]
            if not there.issuperset(fixed):
                continue
            exact = self.wordings[i].search(window)
            if exact:
                missing, extra, (first, last) = [], [], (bisect_left(starts, exact.start()), bisect_left(starts, exact.end()))
            else:
                missing, extra, (first, last) = differences(fixed, said)
            if first < last and not missing and len(extra) * 10 <= len(fixed):
                return first, last, name, text, saved, extra
        return None


def notices(scanner: Scanner, said: list[str]) -> list[tuple]:
    """What ``scanner`` matches around the cues, without overlaps; a window holds whatever
    notice has its first cue or one at most a notice's length after it."""
    found, done, reach = [], 0, scanner.longest
    text, starts = joined(said)
    cues = [bisect_right(starts, m.start()) - 1 for m in _CUE.finditer(text)]
    todo: list[tuple] = [(0, len(said), 0)]  # words from, to, and the first that may be a cue; or a notice
    while todo:
        begin, end, at, *rest = todo.pop()
        if rest:
            found.append((begin, end, at, *rest))
            done = end
            continue
        begin = max(begin, done)
        k = bisect_left(cues, max(begin, at))
        if k == len(cues) or cues[k] >= end:
            continue
        cue = cues[k]
        begin = max(begin, cue - reach)
        hit = scanner.match(said[begin:min(end, cue + 2 * reach + 1)])
        if hit is None:
            todo.append((begin, end, cue + reach + 1))
            continue
        first, last = begin + hit[0], begin + hit[1]
        if first > cue + reach:  # it may go on beyond the window: left to the window of its own cue
            todo += [(begin, end, cue + reach + 1), (begin, first, cue)]
        else:
            todo += [(last, end, cue), (first, last, *hit[2:]), (begin, first, cue)]
    return found


def scan(scanner: Scanner, text: str) -> list[tuple]:
    """The notices of a text, in order; of overlapping blocks, the line before its paragraph."""
    found: list[tuple] = []
    if not any(cue in " ".join(text.lower().split()) for cue in CUES):
        return found
    for a, b in sorted(set(blocks(text)), key=lambda s: (s[1] - s[0], s)):
        parts, at = [], a
        for f in sorted(f for f in found if f[0] < b and a < f[1]):
            parts.append((at, f[0]))
            at = f[1]
        for x, y in [*parts, (at, b)]:
            spans = [(x + m.start(), x + m.end()) for m in _WORD.finditer(text[x:y])]
            found += [(spans[first][0], spans[last - 1][1], *hit)
                      for first, last, *hit in notices(scanner, [text[i:j].lower() for i, j in spans])]
    return sorted(found)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, tuple[str, ...]] | None = None, tried: int | None = None) -> DataFrame:
    """One row a notice found: ``id_col``, start, end, license, template, saved_bytes, extra_words, exact.

    ``start`` and ``end`` are code points in the text, from the first to the
    last word matched. The templates (all, or the ``tried`` that save most) are compared
    word by word in the order of bytes saved, up to the first that is confirmed; it lacks no word, and extra words inside it are a tenth of
    its words at most (``exact``: none). ``saved_bytes`` are those of the window
    around the cue; they order the templates and rule none out. Null or empty
    texts and texts without a cue have no rows; repeated rows are scanned each.
    Other columns are neither read nor returned.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, tried)
        for batch in batches:
            rows = [(at, *hit, not hit[-1]) for at, text in enumerate(batch.column(1).to_pylist()) if text
                    for hit in scan(scanner, text)]
            at, *cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                names=["id", "start", "end", "license", "template", "saved_bytes", "extra_words", "exact"])

    workers_ready(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([
        T.StructField("id", source.schema["id"].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("license", T.StringType()), T.StructField("template", T.StringType()), T.StructField("saved_bytes", T.LongType()),
        T.StructField("extra_words", T.ArrayType(T.StringType())), T.StructField("exact", T.BooleanType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
