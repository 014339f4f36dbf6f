import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF001
from docspark.llm import packing, queries

SCHEMA = "doc_id long, text string, piece string, start int, sequence_id string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def texts():
    return ["", None, "Plain words, and CAPITALS! It's the dog's 42.5 km...", "É è ß ñandú ŒUVRE é ﬁ ΣΟΦΟΣ",
            "a<|endoftext|>b <|startoftext|>", "tab\tline\nfeed\x0b\x0c\r\x1c\x85\xa0 x", "don't'll 'S 're,x;y:z!?.,",
            "日本語 テキスト 🙂🙂", "word " * 30000, ".", "THE. The, the; THE", "İstanbul İ"]


def test_ids_equal_the_tokenizer(spark, tokenizer):
    rows = [(i, t, "c", 1, "c") for i, t in enumerate(texts())] + [(0, "twice", "c", 1, "c"), (0, "twice", "c", 1, "c"), (None, "no id", "c", 1, "c")]
    pieces = packing.tokenise(spark.createDataFrame(rows, SCHEMA))
    docs = defaultdict(list)
    for r in pieces.collect():
        docs[r.doc_id].append(r)
    for i, t in enumerate(texts()):
        if i == 0:
            continue
        parts = sorted(docs[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist()
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [2], t
        assert all(r.doc_tokens == len(ids) and r.length == len(r.ids) // 4 <= 4096 for r in parts)
        assert [r.start for r in parts] == list(range(0, len(ids), 4096))
    assert len(docs[0]) == 3 and len(docs[None]) == 1


def test_query_on_a_table(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_pack_documents"](spark, SF001).collect()
    seqs, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.start, r.length))
        ids = tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert set(seen) == set(docs)
    for parts in [*seqs.values(), *seen.values()]:
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert all(sum(n for _, n in p) <= 4096 for p in seqs.values())


def brute_first_fit(lengths, capacity):
    free, placed = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(capacity)
        placed[i] = (b, capacity - free[b])
        free[b] -= lengths[i]
    return placed


def test_tree_equals_scan():
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 64, 501):
        lengths = [rng.choice([1, 2, 5, 10, rng.randint(1, 100)]) for _ in range(n)]
        assert packing.first_fit_decreasing(lengths, 100) == brute_first_fit(lengths, 100)


def test_groups_and_sequences(spark, tokenizer):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the cat sat "), (F.col("id") % 90).cast("int")).alias("text"))
    pieces = packing.tokenise(df, capacity=128)
    places = packing.pack(pieces, 128, group_size=100)
    out = packing.sequences(pieces, places).collect()
    assert sum(r.length for r in out) == sum(len(tokenizer.encode("the cat sat " * (i % 90), add_special_tokens=False).ids) + 1 for i in range(500))
    assert all(len(r.ids) == 4 * r.length <= 4 * 128 for r in out)
    padding = sum(128 - r.length for r in out) / sum(128 for _ in out)
    assert padding < 0.05
    empty = packing.pack_documents(df.limit(0))
    assert empty.count() == 0


def test_every_letter_before_every_mark(tokenizer):
    """Letters that come apart into a letter and a mark are one run with what follows."""
    import public_tokenizers
    words = [x + c + m for c in map(chr, range(0x80, 0x20000)) if c.isalpha() and (not unicodedata.normalize("NFC", c.lower()).isalpha() or ord(c) % 97 == 0)
             for m in (".", ",###", "") for x in ("", "a")]
    assert len(words) > 2000
    got = list(packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).ids([w.encode() for w in words]))
    want = tokenizer.encode_batch(words, add_special_tokens=False)
    assert [w for w, g, e in zip(words, got, want) if np.frombuffer(g, "<u4").tolist() != e.ids] == []


def test_workers_keep_no_words_between_tasks(spark):
    """A worker that waits for the next stage holds none of the words it has met."""
    import pyarrow as pa

    df = spark.range(400, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + 50)).alias("text"))
    assert packing.tokenise(df).count() == 400

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.known) + len(getattr(e, "pool", b"")) for e in packing._ENCODERS.values())])], names=["n"])

    found = [r.n for r in spark.range(64, numPartitions=16).mapInArrow(kept, "n long").collect()]
    assert len(found) == 16 and max(found) == 0


def test_arrays_that_begin_anywhere(tokenizer):
    """Slices of Arrow arrays, cast or not, and texts beyond what is looked up at once."""
    import pyarrow as pa

    given = [t or "" for t in texts()] * 3 + ["Éa. ÀB, Ü! aé? ÿ; ß:", "ÉCOLE, Été. x×, ÷."] + ["öÄ ab, " * 400_000, "last. One"]
    want = [e.ids for e in tokenizer.encode_batch(given, add_special_tokens=False)]
    own = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for column in (pa.array(given).slice(5).cast(pa.large_string()), pa.array(given, pa.large_string()).slice(5)):
        assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(column)] == want[5:]
