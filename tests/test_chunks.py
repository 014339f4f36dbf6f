from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docspark.operators import chunks as K
from docspark.options import DEFAULT_SEPARATORS


def sp(size=1000, overlap=150, keep="end", seps=DEFAULT_SEPARATORS):
    return K.Chunker(size, overlap, seps, keep)


def test_no_separator_falls_to_characters():
    t = "x" * 2500
    out = sp().chunks(t)
    assert [len(c) for c in out] == [1000, 1000, 800]
    # overlap carried back 150 characters
    starts = [s for _, s in sp().placed(t)]
    assert starts == [0, 850, 1700]


def test_size_boundaries():
    # a piece of exactly `size` is not "shorter than size": it is split to
    # characters and merged back, which gives the same single chunk
    assert sp().chunks("a" * 999) == ["a" * 999]
    assert sp().chunks("a" * 1000) == ["a" * 1000]
    out = sp().placed("a" * 1001)
    assert [(len(c), s) for c, s in out] == [(1000, 0), (151, 850)]


def test_only_spaces_gives_nothing():
    assert sp().chunks(" " * 3000) == []


def test_overlap_clamp():
    assert K.clamp_overlap(100, 500) == 20 and K.clamp_overlap(100, 100) == 100 and K.clamp_overlap(3, 4) == 0


def test_goldens():
    t = "One two. Three four! Five\n\nSix seven eight nine ten. Eleven"
    assert sp(20, 5).chunks(t) == ["One two.", "Three four! Five", "Six seven eight", "nine ten.", "Eleven"]
    assert sp(12, 0).chunks("aaaa bbbb cccc dddd") == ["aaaa bbbb", "cccc dddd"]
    assert sp(9, 4).chunks("a b c d e f g h") == ["a b c d", "c d e f", "e f g h"]
    assert sp(5, 0, False, [",", ""]).chunks("aa,,bb,cc") == ["aa,bb", "cc"]
    assert sp(4, 0, "end", ["."]).chunks("abcdefgh. i.") == ["abcdefgh.", "i."]


def test_keep_separator_modes():
    s_end = K.Chunker(10, 0, ["."], "end").chunks("aaa.bbb.ccc.ddd")
    s_start = K.Chunker(10, 0, ["."], "start").chunks("aaa.bbb.ccc.ddd")
    s_true = K.Chunker(10, 0, ["."], True).chunks("aaa.bbb.ccc.ddd")
    s_none = K.Chunker(10, 0, ["."], False).chunks("aaa.bbb.ccc.ddd")
    assert s_end == ["aaa.bbb.", "ccc.ddd"]
    assert s_start == ["aaa.bbb", ".ccc.ddd"]
    assert s_true == s_start
    assert s_none == ["aaa.bbb", "ccc.ddd"]


def test_chinese_punctuation():
    t = "甲" * 600 + "。" + "乙" * 600 + "，" + "丙" * 10
    out = sp().chunks(t)
    assert out[0].endswith("。") and len(out[0]) == 601


def test_same_paragraph_twice_start_index():
    para = "word " * 300
    t = para.strip() + "\n\n" + para.strip()
    cs = sp().placed(t)
    for c, s in cs:
        assert t[s:s + len(c)] == c


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .,\n。")), max_size=3000),
       st.integers(min_value=20, max_value=300), st.integers(min_value=0, max_value=60))
def test_invariants(text, size, overlap):
    overlap = min(overlap, size)
    s = K.Chunker(size, overlap, DEFAULT_SEPARATORS, "end")
    for c, st_ in s.placed(text):
        assert 0 < len(c) <= size
        assert c == c.strip()
        assert st_ >= 0 and text[st_:st_ + len(c)] == c


def test_dataframe_matches_python_and_partitions(spark):
    rows = [(i, ("Sentence number %d. " % i) * (30 + 17 * i)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    exp = {(i, p, s, c) for i, t in rows for p, (c, s) in enumerate(sp().placed(t))}
    for n in (1, 5):
        got = {(r.doc_id, r.chunk_pos, r.start_index, r.text)
               for r in K.recursive_chunks(df.repartition(n), "text").collect()}
        assert got == exp


def test_chunk_ids_and_dedupe(spark):
    df = spark.createDataFrame([("kb/a.txt", "a.txt", None, 0, 0, "dup", 0),
                                ("kb/a.txt", "a.txt", None, 1, 0, "dup", 0),
                                ("kb/a.txt", "a.txt", 3, 0, 5, "x", 1)],
                               "source string, file_name string, page int, section int, start_index int, "
                               "text string, chunk_pos int")
    df = df.withColumn("page_1based", F.col("page") + 1)
    d = K.add_chunk_index(df, "source", ("page", "section", "chunk_pos"))
    d = K.add_citation(K.add_chunk_id(K.add_end_index(d)))
    rows = sorted(d.collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in rows] == [0, 1, 2]
    assert rows[0].chunk_id == rows[1].chunk_id           # same text and start -> same id
    assert rows[2].citation == "a.txt#p4" and rows[0].citation == "a.txt#chunk0"
    import hashlib
    th = hashlib.sha1(b"x").hexdigest()
    assert rows[2].chunk_id == hashlib.sha1(f"kb/a.txt||p=4||s=5||th={th}".encode()).hexdigest()
    assert K.dedupe_chunks(d).count() == 2


def test_token_length_unit():
    words = lambda s: len(s.split())
    out = K.chunker(5, 0, [" ", ""], False, "token", words).chunks("one two three four five six seven eight nine ten eleven")
    # the separator " " counts 0 words, so five words fill a chunk of size 5
    assert out == ["one two three four five", "six seven eight nine ten", "eleven"]
    assert K.chunker(5, 0, [" ", ""], False).chunks("one two three") == ["one", "two", "three"]
    import pytest
    with pytest.warns(UserWarning, match="count characters"):
        assert K.chunker(5, 0, [" ", ""], False, "token").chunks("one two three") == ["one", "two", "three"]
    with pytest.raises(ValueError):
        K.chunker(unit="line")


def subwords(text):
    """Greedy pieces of a small vocabulary: a text cut inside one has other tokens than before."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        wide = next(len(p) for p in ("abcabc", "bca", "abc", "ca", "b.", text[at]) if text.startswith(p, at))
        out.append((at, at + wide))
        at += wide
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abc .,\n。\u00e9")), max_size=600), st.integers(1, 40), st.integers(0, 12),
       st.sampled_from(["end", "start", False]))
def test_token_sizes_hold(text, size, overlap, keep):
    placed = K.chunker(size, overlap, keep=keep, unit="token", tokens=subwords).placed(text)
    seen = set()
    for c, at in placed:
        assert c and c == c.strip() and text[at:at + len(c)] == c
        assert len(subwords(c)) <= size
        seen |= set(range(at, at + len(c)))
    starts = [at for _, at in placed]
    assert starts == sorted(starts)
    if keep:
        assert all(i in seen for i, c in enumerate(text) if not c.isspace())
    else:
        lost = {c for i, c in enumerate(text) if i not in seen}
        assert all(c.isspace() or c in DEFAULT_SEPARATORS for c in lost)
    if not overlap:
        assert sum(len(c) for c, _ in placed) == len(seen)


def brute_words(text, size, overlap):
    """Words laid by hand: as many as fit, then back by at most ``overlap`` of them, and never the whole."""
    words, out, first, last = text.split(), [], 0, 0
    while last < len(words):
        last = max(last + 1, min(len(words), first + size))
        out.append(" ".join(words[first:last]))
        first = max(first, last - min(overlap, size - 1))
    return out


def test_token_chunks_of_plain_words():
    import re
    words = lambda s: [m.span() for m in re.finditer(r"\S+", s)]
    for n in (0, 1, 4, 5, 6, 11, 60):
        text = " ".join(f"w{i}" for i in range(n))
        for size, overlap in ((5, 0), (5, 2), (5, 4), (1, 0), (2, 1)):
            got = K.chunker(size, overlap, [" "], "end", "token", tokens=words).chunks(text)
            want = brute_words(text, size, overlap)
            if size > 1:  # a span as large as the size is cut again, here between its tokens
                assert got == want, (n, size, overlap)
            else:
                assert got == text.split()


def test_token_chunks_with_a_public_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from conftest import SF001
    path = public_tokenizers.path("byte_bpe_50k.json")
    kept = {}

    def offsets(text):
        if "t" not in kept:
            kept["t"] = Tokenizer.from_file(path)
            kept["t"].encode_special_tokens = True
        return kept["t"].encode(text, add_special_tokens=False).offsets

    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").where("doc_id < 60 and text is not null")
    rows = K.recursive_chunks(d, "text", size=64, overlap=8, unit="token", tokens=offsets).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    assert len(rows) > len(texts)
    for r in rows:
        assert texts[r.doc_id][r.start_index:r.start_index + len(r.text)] == r.text
        assert len(offsets(r.text)) <= 64
    long = "\u4e2d\u6587🙂" * 4000  # no separator, several tokens a character
    cut = K.chunker(64, 8, unit="token", tokens=offsets).chunks(long)
    assert max(len(offsets(c)) for c in cut) <= 64 and len(cut) < 4000


def test_a_batch_is_chunked_in_pieces(spark):
    """What the chunk and NFKC functions make of a batch is handed on piece by piece, no text lost or split."""
    import pandas as pd

    from docspark.functions import text as T
    texts = pd.Series(["a" * 400] * 7 + [None, "", "b" * 5000, "c"])
    got = list(T.pieces([texts, pd.Series([], dtype=object)], 1000))
    assert [x for s in got for x in s] == texts.tolist() and [len(s) for s in got] == [3, 3, 4, 1]
    lists = pd.Series([["a" * 600, None], None, ["b" * 600], []])
    assert [len(s) for s in T.pieces([lists], 1000)] == [3, 1]
    big = spark.range(6).selectExpr("id", "repeat(concat('w', id, ' '), 200000) as text").coalesce(1)
    plan = K.recursive_chunks(big, size=100_000)
    kept = {r.id: r.n for r in plan.groupBy("id").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert set(kept) == set(range(6)) and all(n >= 599_000 for n in kept.values())
