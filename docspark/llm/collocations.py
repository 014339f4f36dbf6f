r"""Collocations: phrases whose words come together more often than their parts say.

Counts come from depth-truncated suffix trees, built in parts that fit in memory
(vertical partitioning in the manner of ERA):

1. The corpus is read as runs of words. Every word starts a suffix of at most
   ``longest`` words; a task adds up equal suffixes before they are shuffled, so
   a leaf of the tree is a different suffix with its total.
2. Suffixes are divided by word prefixes. The suffixes of a prefix are one
   subtree; a prefix with more leaves than ``budget`` is lengthened by a word, as
   often as needed, and light prefixes are put together, first-fit decreasing, in groups of at
   most ``budget`` leaves (more only where one bin of prefixes has more).
3. A group's subtrees are built alone: its suffixes are sorted, a node is a range of them
   that share their first words, and its count is the sum of its leaves' totals.
   Nodes above a group's prefixes are summed over the groups.

A phrase with ``least`` occurrences has only words, and pairs of neighbours, with as many,
so suffixes also end at rarer words and before rarer pairs. Tasks know both by bitmaps of
hashes, one MB each whatever the corpus; a collision leaves a rare word or pair in,
which costs a leaf and changes no count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import small_side, store, workers_ready

SEED = 42            # of Spark's xxhash64
BITS = 1 << 23       # of the bitmap of frequent words
_BLOCK = 1 << 20     # bytes of a text that are split at a time
_WORDS = 200_000     # different words that a task keeps
_SUFFIXES = 1 << 19  # words of the runs that a task takes at a time
_ID = 20             # bits of a task's word number
_BREAK = 0           # a word number that ends a run
# ends of pieces become a word of their own, tabs a space
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, a block at a time; ``\\n`` ends a piece, empty ones count for nothing."""
    at = 0
    while at < len(text):
        end = at + _BLOCK
        if end < len(text):  # cut at a space; a word longer than a block stays whole
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\t", at, end))
            while cut < 0 and end < len(text):
                cut = min((i for i in (text.find(b" ", end), text.find(b"\t", end)) if i >= 0), default=len(text))
            end = cut
        yield text[at:end].lower().translate(_CUT).replace(b"\n", b" \n ").split(b" ")
        at = end + 1


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    langs, texts = (batch.column(i).cast(pa.large_binary()) for i in (0, 1))
    for i in range(batch.num_rows):
        yield langs[i].as_py(), texts[i].as_py()


def _read(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def count_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word, n: all occurrences. A null language is ``und``, a null text empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                c.pop(b"", None)
                c.pop(b"\n", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(c), np.int64))), pa.array(list(c), pa.string()),
                                                  pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
            counts.clear()
        for batch in batches:
            for lang, text in _texts(batch):
                for words in _blocks(text):
                    counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > _WORDS:
                yield from flush()
        yield from flush()

    rows = _read(docs, text_col, lang_col).mapInArrow(run, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _frequent_bits(counted: DataFrame, least: int, h: Column) -> bytes:
    """A bit for every hash with ``least`` or more: 1 MB, however many there are."""
    h = F.pmod(h, F.lit(BITS)) + 1
    parts = counted.where(F.col("n") >= least).groupBy(F.bitmap_bucket_number(h).alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in parts:
        size = len(r["bits"])
        out[(r["at"] - 1) * size:r["at"] * size] = r["bits"]
    return bytes(out)


class _Runs:
    """A task's runs of frequent words, as numbers, and what is counted over them."""

    def __init__(self, frequent: bytes, longest: int):
        import xxhash

        self.hash, self.frequent, self.longest = xxhash.xxh64_intdigest, frequent, longest
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = [b""]
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.known: dict[bytes, dict[bytes, int]] = {}
        self.parts: dict[bytes, list[tuple[np.ndarray, int]]] = {}
        self.kept = self.size = 0

    def number(self, lang: bytes, w: bytes) -> int:
        h = self.hash(lang + b" " + w, seed=SEED)
        bit = h & (BITS - 1)
        if w == b"\n" or not self.frequent[bit >> 3] >> (bit & 7) & 1:
            return _BREAK
        n = len(self.words)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        self.hashes[n] = h
        self.words.append(w)
        return n

    def add(self, lang: bytes, text: bytes) -> Iterator[None]:
        """Takes a text; yields where enough has come together to be counted."""
        tail: list[bytes] = []
        for words in _blocks(text):
            words = tail + [w for w in words if w]
            # the last words wait for what follows them
            done = max(0, len(words) - self.longest + 1)
            self.take(lang, words, done)
            tail = words[done:]
            if self.size >= _SUFFIXES or self.kept >= _WORDS:
                yield
        self.take(lang, tail, len(tail))

    def take(self, lang: bytes, words: list[bytes], starts: int) -> None:
        """A run in which suffixes begin at the first ``starts`` words."""
        if not starts:
            return
        known = self.known.setdefault(lang, {})
        new = set(words).difference(known)
        for w in new:
            known[w] = self.number(lang, w)
        self.kept += len(new)
        ids = np.zeros(len(words) + 1, np.int32)  # ends in a break
        ids[:-1] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        self.parts.setdefault(lang, []).append((ids, starts))
        self.size += len(ids)

    def drain(self) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each language: numbers, where suffixes begin, and hashes of the pairs that begin at each place (0: none)."""
        for lang, parts in self.parts.items():
            ids = np.concatenate([p for p, _ in parts])
            ends = np.cumsum([len(p) for p, _ in parts])
            begins = np.zeros(len(ids) + 1, np.int32)
            np.add.at(begins, ends - [len(p) for p, _ in parts], 1)
            np.add.at(begins, ends - [len(p) - n for p, n in parts], -1)
            begins = (np.cumsum(begins[:-1]) > 0) & (ids != _BREAK)
            h = self.hashes[ids]
            pairs = np.zeros(len(ids), np.uint64)
            pairs[:-1] = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(23)
            pairs[:-1][(ids[:-1] == _BREAK) | (ids[1:] == _BREAK)] = 0
            yield lang, ids, begins, pairs
        self.parts, self.size = {}, 0

    def rest(self) -> None:
        """Begins anew once too many words are known; only after ``drain``."""
        if self.kept >= _WORDS:
            self.clear()


def _over_runs(docs: DataFrame, frequent: bytes, longest: int, text_col: str, lang_col: str, count, schema: str) -> DataFrame:
    """``count(runs)`` yields the batches for what a task's runs hold so far."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(shared.value, longest)
        for batch in batches:
            for lang, text in _texts(batch):
                for _ in runs.add(lang, text):
                    yield from count(runs)
                    runs.rest()
        yield from count(runs)

    return _read(docs, text_col, lang_col).mapInArrow(run, schema)


def pair_counts(runs: _Runs) -> Iterator[pa.RecordBatch]:
    """Hashes (of 41 bits) of neighbours and how often they came."""
    for _, _, begins, pairs in runs.drain():
        h, n = np.unique(pairs[begins & (pairs != 0)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])


def suffix_counts(runs: _Runs, pair_bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The runs' different suffixes, cut before rare words and pairs, with their totals."""
    longest, per = runs.longest, 63 // _ID
    for lang, ids, begins, pairs in runs.drain():
        at = np.flatnonzero(begins)
        if not len(at):
            continue
        bit = pairs & np.uint64(BITS - 1)
        goes_on = (pairs != 0) & (pair_bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        goes_on, ids = np.append(goes_on, np.zeros(longest, bool)), np.append(ids, np.zeros(longest, np.int32))
        rows, alive = np.zeros((longest, len(at)), np.int32), np.ones(len(at), bool)
        for k in range(longest):
            if k:
                alive &= goes_on[at + k - 1]
            rows[k] = np.where(alive, ids[at + k], 0)
        keys = []
        for first in range(0, longest, per):  # as many word numbers as a key holds
            key = np.zeros(len(at), np.int64)
            for k in range(first, min(first + per, longest)):
                key = key << _ID | rows[k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.ones(len(at), bool)
        new[1:] = False
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        first_of = np.flatnonzero(new)
        totals = np.diff(np.append(first_of, len(at)))
        rows = rows[:, order[first_of]]
        words = pa.array(runs.words, pa.string())
        said = pc.binary_join_element_wise(*[words.take(pa.array(r, mask=r == 0)) for r in rows], " ", null_handling="skip")
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(totals), np.int64))), said,
                                          pa.array(totals, pa.int64())], names=["lang", "suffix", "n"])


def count_suffixes(docs: DataFrame, frequent: bytes, least: int, longest: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, suffix, n: the leaves, every different suffix of at most ``longest`` words with its total."""
    pairs = _over_runs(docs, frequent, longest, text_col, lang_col, pair_counts, "pair long, n long")
    bits = _frequent_bits(pairs.groupBy("pair").agg(F.sum("n").alias("n")), least, F.col("pair"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = _over_runs(docs, frequent, longest, text_col, lang_col,
                      lambda runs: suffix_counts(runs, np.frombuffer(shared.value, np.uint8)), "lang string, suffix string, n long")
    return rows.groupBy("lang", "suffix").agg(F.sum("n").alias("n"))


def _prefix(depth: int) -> Column:
    return F.substring_index("suffix", " ", depth)


def group_leaves(leaves: DataFrame, longest: int, budget: int) -> tuple[DataFrame, int]:
    """``leaves`` with ``depth`` (words of their prefix) and ``part`` (their group), and the number of groups.

    A prefix of more than ``budget`` leaves is heavy and goes on by a word; there are
    at most leaves/budget of them at a depth, and they travel as hashes. Light
    prefixes fall into bins by hash, a sixteenth of the budget each on average; the bins' sizes are
    packed first-fit decreasing up to 16,384 of them; beyond, 16 neighbours go together."""
    total = leaves.count()
    here, done = leaves, None
    for depth in range(1, longest + 1):
        key = F.xxhash64("lang", _prefix(depth))
        here = here.withColumn("key", key)
        if depth < longest:
            heavy = store(here.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > budget).select("key"), "phrases-heavy")
            if heavy.isEmpty():
                light, more = here, None
            else:
                heavy = small_side(heavy)
                light, more = here.join(heavy, "key", "left_anti"), here.join(heavy, "key", "left_semi")
        else:
            light, more = here, None
        light = light.withColumn("depth", F.lit(depth))
        done = light if done is None else done.unionByName(light)
        if more is None:
            break
        here = more.drop("key")
    bins = 1 << max(6, (16 * total // budget).bit_length())
    done = done.withColumn("bin", F.pmod("key", F.lit(bins)).cast("int")).drop("key")
    if bins > 1 << 14:
        return done.withColumn("part", F.shiftright("bin", 4)).drop("bin"), bins >> 4
    sizes = [(r["bin"], r["count"]) for r in done.groupBy("bin").count().collect()]
    parts = first_fit(dict(sizes), budget)
    spark = leaves.sparkSession
    table = spark.createDataFrame(list(parts.items()) or [(0, 0)], "bin int, part int")
    return done.join(F.broadcast(table), "bin").drop("bin"), max(parts.values(), default=0) + 1


def first_fit(sizes: dict[int, int], budget: int) -> dict[int, int]:
    """Groups of bins, first-fit decreasing; a bin over the budget is a group of its own."""
    free: list[int] = []
    out = {}
    start = 0
    for b, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        for g in range(start, len(free)):
            if free[g] >= n:
                break
        else:
            g = len(free)
            free.append(budget)
        free[g] -= n
        out[b] = g
        while start < len(free) and free[start] <= 0:
            start += 1
    return out


def subtree(leaves: pa.Table, longest: int, least: int) -> pa.Table:
    """Nodes of a group's subtrees: lang, phrase, words, n, summed from the leaves below them.

    Nodes at or below their group's prefix are whole, and kept from ``least`` on;
    those above it hold what this group adds to them."""
    leaves = leaves.combine_chunks()
    m = leaves.num_rows
    empty = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())]).empty_table()
    if m == 0:
        return empty

    def one(name: str) -> pa.Array:
        c = leaves.column(name)
        return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    split = pc.split_pattern(one("suffix"), " ")
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(split).dictionary_encode()
    rows = np.zeros((longest, m), np.int32)
    start = np.cumsum(size) - size
    where = np.repeat(np.arange(m), size)
    rows[np.arange(len(where)) - np.repeat(start, size), where] = coded.indices.to_numpy() + 1
    lang = one("lang").dictionary_encode().indices.to_numpy()
    order = np.lexsort([*rows[::-1], lang])
    n, depth, size, lang, rows = one("n").to_numpy()[order], one("depth").to_numpy()[order], size[order], lang[order], rows[:, order]
    new = np.ones(m, bool)
    new[1:] = lang[1:] != lang[:-1]
    out = []
    for k in range(longest):
        new = new.copy()
        new[1:] |= rows[k, 1:] != rows[k, :-1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(n, at)
        keep = (rows[k, at] > 0) & ((total >= least) | (depth[at] > k + 1))
        at, total = at[keep], total[keep]
        if len(at):
            picked = pa.array(order[at])
            phrase = pc.binary_join(pc.list_slice(split.take(picked), 0, k + 1), " ")
            out.append(pa.table([one("lang").take(picked), phrase, pa.array(np.full(len(at), k + 1, np.int32)), pa.array(total)], schema=empty.schema))
    return pa.concat_tables(out) if out else empty


def count_phrases(docs: DataFrame, least: int = 100, longest: int = 5, budget: int = 400_000, text_col: str = "text",
                  lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases, words): stored tables of the phrases of 1 to ``longest`` words with ``least`` occurrences
    or more (lang, phrase, words, n), and of all words (lang, word, n)."""
    workers_ready(docs.sparkSession)
    words = store(count_words(docs, text_col, lang_col), "phrases-words")
    frequent = _frequent_bits(words, least, F.xxhash64(F.concat_ws(" ", "lang", "word")))
    leaves = store(count_suffixes(docs, frequent, least, longest, text_col, lang_col), "phrases-leaves")
    grouped, parts = group_leaves(leaves, longest, budget)
    schema = "lang string, phrase string, words int, n long"
    nodes = grouped.groupBy("part").applyInArrow(lambda t: subtree(t, longest, least), schema)
    phrases = nodes.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return store(phrases, "phrases"), words


def score_phrases(phrases: DataFrame, words: DataFrame, cover: int = 100) -> DataFrame:
    """Candidates (phrases of two words or more) with their weakest cut: lang, phrase, a, l, r, n, score.

    A cut after k words has the score floor(1000 a n / (l r)), in exact decimals; the
    lowest counts, of equals that with the least k. A candidate goes if a longer
    one that holds it has ``cover`` percent of its occurrences. It is enough to
    look at those longer by one word: whatever holds it through more words has no more occurrences than these."""
    candidates = phrases.where("words > 1")
    part = F.split("phrase", " ")
    longer = candidates.where("words > 2").select("lang", F.col("n").alias("m"), F.explode(F.array_distinct(F.array(
        F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("m") < cover * F.col("n"), F.lit(True))).drop("m")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", F.array_join(F.slice(part, F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice(part, F.col("k") + 1, F.col("words")), " ").alias("rest"))
    known = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(known.toDF("lang", "head", "l"), ["lang", "head"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    cuts = cuts.join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    cuts = cuts.withColumn("score", score)
    return cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select(
        "lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def top_phrases(scored: DataFrame, limit: int = 2000) -> DataFrame:
    """The first ``limit`` of each language, with ``rank``: by score, then a, both descending, then phrase."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)
