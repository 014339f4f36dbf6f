import os
import sys
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF01

sys.path.insert(0, os.path.dirname(__file__))
from test_decontaminate import brute as brute_leaks  # noqa: E402
from test_simhash import brute_classes  # noqa: E402


def test_rows_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    kept = docs
    frame = spark.read.parquet(f"{SF01}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, SF01)
        assert frame.columns == columns
        ids = {r.doc_id for r in frame.select("doc_id").collect()}
        before = kept
        if name == "language_id":
            assert ids >= {d for d, t in before if any(c.isalpha() for c in t or "") and len(t) > 200}
            assert not ids & {d for d, t in before if not any(c.isalpha() for c in t or "")}
            want = ids
        elif name == "near_duplicates":
            want = {int(d) for d, _, c in brute_classes(before) if d == c}
            assert len(want) < len(before)
        else:
            want = {d for d, _ in before} - {d for d, _ in brute_leaks(before, bench)}
            assert len(want) < len(before)
        assert ids == want, name
        kept = [(d, t) for d, t in before if d in want]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, SF01).collect()
    got, places = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert dict(got) == {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in kept}
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096


def test_hostile_tables(spark, scratch):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", None, None, None), (3, "some words here", "en", "s", 1),
            (3, "some words here", "en", "s", 1), (4, "x " * 60_000, "en", "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{scratch}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{scratch}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{scratch}/{name}").collect()
        assert {r.doc_id for r in out} == ({3, 4} if some else set())


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "plain words in a row", "en", "s", 1, 2, 3, 4, "x", "y", "z")],
                                 "doc_id long, text string, lang string, source string, n_chars long, row int, found int, hit int, fp string, "
                                 "component_id string, text_hash string")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF01)
        assert out.columns == docs.columns and out.collect() == docs.collect()
    assert corpus_pipeline.STAGES[3][1](spark, docs, SF01).count() == 1
