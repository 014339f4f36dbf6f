"""Packing token sequences: first-fit decreasing with a tournament tree.

``tokenise`` turns every document into token ids and cuts them into pieces of
at most ``capacity`` ids. ``pack`` deals the pieces into randomised groups of
bounded size and packs each group on its own: pieces in decreasing length go to
the first bin with room, found by walking down a tournament tree whose nodes
hold the largest free capacity below them (two steps a level, no bin scan).
``sequences`` joins the pieces of a bin to the final ids.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import store, workers_ready

#: Different words whose ids a Python worker keeps at once (about 50 MB).
CACHED_WORDS = 250_000
#: Bytes of text whose words are looked up at once.
_AT_ONCE = 1 << 21
_PUNCTUATION = b".,;:!?#$%&*"
#: Letters past ASCII that are their own normal form.
_LATIN = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
#: A letter, marks, white space.
_CLOSING = rf"([a-z{_LATIN}])([.,;:!?#$%&*]+)([\x20\t-\r])"
_WORD = re.compile(f"[a-z{_LATIN}]+")


class WordIds:
    """Ids of texts from a tokenizer that drops white space and case: no token
    crosses white space, so a text's ids are those of its words. Arrow splits
    many texts and numbers their different words; each of these is encoded once
    while it is kept, its ids lie in one pool, and the texts' ids are gathered
    from there. Words of letters alone are one run to the tokenizer: those
    of ASCII and Latin-1 letters go straight to its model, others are encoded many
    at a time and told apart by the word end of their last token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: Case and bytes of the Latin-1 letters, as the model reads them.
        self.latin = str.maketrans({c: spelled(c.lower())[0][0] for c in _LATIN})
        normalizer = self.tokenizer.normalizer
        self.normalise = normalizer.normalize_str if normalizer else None
        self.clear()

    def clear(self) -> None:
        """Forgets the words. By word its number; by number where its ids begin in the pool, and how many."""
        self.known: dict[bytes, int] = {}
        self.pool, self.first, self.size = array("I"), array("q"), array("i")

    def _encode(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        tokens = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokens(w)]).tobytes() for w in words]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return self._encode(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _letters(self, word: bytes) -> bool:
        """Whether the tokenizer sees letters alone: some letters come apart into a letter and a
        mark, which is one run with the punctuation after it."""
        if word.isascii():
            return word.isalpha()
        said = word.decode("utf-8", "replace")
        return said.isalpha() and (self.normalise is None or self.normalise(said).isalpha())

    def learn(self, words: list[bytes]) -> None:
        """Numbers and ids of different words that are not known."""
        found: dict[bytes, bytes] = {}
        split, plain, letters, other, latin, whole = {}, [], set(), set(), self.latin, _WORD.fullmatch
        for w in words:
            said = w.decode()
            if whole(said):
                plain.append((w, said if said.isascii() else said.translate(latin)))
                continue
            core = w.rstrip(_PUNCTUATION)
            if self._letters(core):
                split[w] = (core, w[len(core):])
                letters.add(core)
                if core != w:
                    other.add(w[len(core):])
            else:
                other.add(w)
        found.update(zip([w for w, _ in plain], self._encode_plain([s for _, s in plain]), strict=True))
        for some, encode in ((letters, self._encode_letters), (other, self._encode)):
            todo = [w for w in some if w not in found]
            found.update(zip(todo, encode([w.decode() for w in todo]), strict=True))
        for w, (core, end) in split.items():
            found[w] = found[core] + found[end] if end else found[core]
        raw = [found[w] for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        self.known.update(zip(words, range(len(self.first), len(self.first) + len(words)), strict=True))
        self.first.frombytes((len(self.pool) + np.cumsum(sizes) - sizes).tobytes())
        self.size.frombytes(sizes.astype(np.int32).tobytes())
        self.pool.frombytes(b"".join(raw))

    def ids(self, texts: pa.Array | list[bytes]) -> Iterator[bytes]:
        """Ids of each text (no nulls) as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _AT_ONCE)) + 1
            yield from self._ids(texts.slice(at, upto - at))
            at = upto

    def _ids(self, texts: pa.Array) -> Iterator[bytes]:
        texts = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower needs values that begin at 0
        # case is dropped, and marks after a letter are a run of their own; "<|" may open a special token
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _CLOSING, r"\1 \2\3"))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHED_WORDS:
            self.clear()
        number = list(map(self.known.get, words))
        new = [w for w, n in zip(words, number, strict=True) if n is None]
        if new:
            self.learn(new)
            number = list(map(self.known.__getitem__, words))
        index = np.array(number, np.int64)[coded.indices.to_numpy()]
        size = np.frombuffer(self.size, np.int32)[index].astype(np.int64)
        upto = np.cumsum(size)
        place = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(np.frombuffer(self.first, np.int64)[index] - (upto - size), size)
        raw = np.frombuffer(self.pool, np.uint32)[place].tobytes()
        ends = 4 * np.append(0, upto)[split.offsets.to_numpy()]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield raw[a:b]


_ENCODERS: dict[str, WordIds] = {}


def _encoder(path: str | None) -> WordIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
             end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """The pieces of every document, written to the shared folder.

    Columns: piece (unique), ``id_col``, start, length, doc_tokens, ids (binary,
    little-endian unsigned 32-bit). A document is its ids and ``end_id``; null
    text counts as empty, so every row, repeated ones included, has a piece.
    ``tokenizer``: path of a tokenizer file that the executors can open; None
    is the public ``word_bpe_49k.json``. It must drop white space. Other columns
    are neither read nor returned. An empty table gives no pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        end = int(end_id).to_bytes(4, "little")
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            rows, size = [], 0
            for at, ids in enumerate(encoder.ids(texts)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    rows.append((number, at, start, min(capacity, total - start), total,
                                 ids[4 * start:4 * (start + capacity)]))
                    number += 1
                size += len(ids)
                if size > 1 << 22 or at == len(texts) - 1:
                    p, row, s, n, t, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p, pa.int64()), batch.column(0).take(pa.array(row)), pa.array(s, pa.int64()),
                         pa.array(n, pa.int64()), pa.array(t, pa.int64()), pa.array(b, pa.binary())],
                        names=["piece", "id", "start", "length", "doc_tokens", "ids"])
                    rows, size = [], 0
        encoder.clear()  # a worker that waits for other work holds no words
        pa.default_memory_pool().release_unused()

    workers_ready(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([
        T.StructField("piece", T.LongType()), T.StructField("id", source.schema["id"].dataType),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")],
        T.StructField("ids", T.BinaryType())])
    return store(source.mapInArrow(run, schema), "pieces").withColumnRenamed("id", id_col)


class Bins:
    """Bins of equal capacity under a tournament tree of their free room."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, length: int) -> tuple[int, int]:
        """The first bin with room for ``length``, and the room it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        free, room[at] = room[at], room[at] - length
        bin_number = at - self.leaves
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return bin_number, free


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; equal lengths in the given order."""
    bins, placed = Bins(len(lengths), capacity), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        number, free = bins.first_fit(lengths[i])
        placed[i] = (number, capacity - free)
    return placed


def pack(pieces: DataFrame, capacity: int = 4096, group_size: int = 20_000, seed: int = 17) -> DataFrame:
    """(piece, sequence_id, offset): every piece's place, gapless from 0 in each sequence.

    ``pieces``: piece (unique long) and length (1 to ``capacity``). Groups are
    drawn by a seeded hash of the piece and hold ``group_size`` pieces on
    average, whatever the input; a group leaves at most a few bins part full."""
    groups = max(1, -(-pieces.count() // group_size))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        placed = np.array(first_fit_decreasing(rows["length"].tolist(), capacity), np.int64).reshape(-1, 2)
        return pd.DataFrame({"piece": rows["piece"].to_numpy(), "sequence_id": (key[0] << 32) + placed[:, 0],
                             "offset": placed[:, 1]})

    return (pieces.select("piece", "length", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups)).alias("group"))
            .groupBy("group").applyInPandas(run, "piece long, sequence_id long, offset long"))


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed ids, without padding."""
    return (pieces.join(places, "piece").groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
            .select("sequence_id", "length", F.aggregate(
                "parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids")))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
                   **options) -> DataFrame:
    """One row a piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The CRC-32 is of the piece's ids as stored; the ids themselves stay in the
    table that ``tokenise`` wrote, and are not shuffled."""
    pieces = tokenise(docs, id_col, text_col, capacity, **options)
    short = pieces.select("piece", id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return short.join(pack(pieces, capacity), "piece").drop("piece")
