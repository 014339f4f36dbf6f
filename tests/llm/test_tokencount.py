import math
import random

import public_tokenizers
import pytest
import sentencepiece

from conftest import SF001
from docspark.llm import queries, tokencount


@pytest.fixture(scope="module")
def pieces():
    return tokencount.zipf_scores(tokencount.read_pieces())


def brute(pretoken, pieces, penalty=10.0):
    """Best score and counts over all segmentations, by plain recursion from the end."""
    unknown = min(pieces.values()) - penalty
    longest = max(map(len, pieces))
    memo = {0: (0.0, 0)}
    for end in range(1, len(pretoken) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            s = pieces.get(pretoken[start:end])
            if s is not None:
                options.append((memo[start][0] + s, -start, memo[start][1] + 1))
        if pretoken[end - 1] not in pieces:
            options.append((memo[end - 1][0] + unknown, -(end - 1), memo[end - 1][1] + len(pretoken[end - 1].encode())))
        best = max(options, key=lambda o: (o[0], o[1]))
        memo[end] = (best[0], best[2])
    return memo[len(pretoken)][1]


def words():
    rng = random.Random(3)
    out = ["", "the", "theory", "theories", "日本語", "🙂🙂", "naïve", "a" * 300, "x\u2581y", "don't", "42.5%"]
    return out + ["".join(rng.choices("theandio rnx\u00e9\u4e2d🙂", k=rng.randint(1, 14))).replace(" ", "") for _ in range(800)]


def test_counts_equal_brute_force(pieces):
    trie = tokencount.Trie(pieces)
    for w in words() + words()[::-1]:
        assert trie.tokens(tokencount.MARK + w) == brute(tokencount.MARK + w, pieces), w
    # one node for each different prefix
    assert len(trie.score) == 1 + len({(tokencount.MARK + w)[:k] for w in words() for k in range(1, len(w) + 2)})


def test_bounded_trie_gives_equal_counts(pieces, monkeypatch):
    whole, small = tokencount.Trie(pieces), tokencount.Trie(pieces)
    monkeypatch.setattr(tokencount, "NODES", 50)
    for at in range(0, 800, 40):
        some = {w.encode() for w in words()[at:at + 40] if w}
        small.learn(some)
        assert len(small.score) < 1000
        for w in some:
            assert small.terminal[w] == whole.tokens(tokencount.MARK + w.decode())


def test_equals_the_library_in_unigram_mode():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1  # unigram
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    trie = tokencount.Trie(tokencount.read_pieces())
    plain = [w for w in words() if w.isascii() and w]
    # its n-best list ranks by score alone; the single best comes from a shortcut that can miss it
    assert all(len(model.nbest_encode(w, nbest_size=2)[0]) == trie.tokens(tokencount.MARK + w) for w in plain)


def test_scores_are_log_probabilities(pieces):
    assert abs(sum(math.exp(s) for s in pieces.values()) - 1) < 1e-9
    raw = tokencount.read_pieces()
    assert sorted(raw, key=lambda p: (-raw[p], p)) == sorted(pieces, key=lambda p: -pieces[p])
    trie = tokencount.Trie(pieces)
    for w in ("the", "language", "processing", "international"):
        assert trie.tokens(tokencount.MARK + w) == 1
    assert tokencount.zipf_scores({}) == {}


def test_near_the_files_own_tokenizer(spark):
    """The best segmentation under the scores is not that of the merges, yet hardly longer."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect() if r.text]
    own = sum(map(len, model.encode(texts, num_threads=1)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sum(r.n_tokens for r in tokencount.count_tokens(df).collect())
    assert abs(got / own - 1) < 0.05, (got, own)


def test_long_words(pieces):
    rng = random.Random(8)
    trie = tokencount.Trie(pieces)
    for n in (511, 512, 513, 600, 5_000):
        w = "".join(rng.choices("theandiornx\u00e9\u4e2d🙂", k=n))
        assert trie.tokens(tokencount.MARK + w) == brute(tokencount.MARK + w, pieces), n
    # nodes and kept words do not grow with a word's length
    before = len(trie.score)
    assert trie.total([b"the", b"a" * 50_000, b"a" * 50_000]) == trie.tokens(tokencount.MARK + "the") + 2 * trie.tokens(tokencount.MARK + "a" * 50_000)
    assert len(trie.score) < before + 2 * tokencount.DEPTH and set(trie.terminal) == {b"the"}


def test_bounds_within_one_text(pieces, monkeypatch):
    monkeypatch.setattr(tokencount, "NODES", 50)
    trie, many = tokencount.Trie(pieces), [w.encode() for w in words() if w]
    assert trie.total(many) == sum(brute(tokencount.MARK + w.decode(), pieces) for w in many)
    assert len(trie.score) <= 50 + tokencount.DEPTH


def test_documents(spark, pieces):
    rows = [(1, "the theory of the theories"), (2, None), (3, ""), (4, " \t\n"), (5, "a\u00a0b c"), (1, "the theory of the theories"), (None, "x"),
            (6, "the " * 100_000)]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, n_tokens string, id int")
    got = sorted(map(tuple, tokencount.count_tokens(df).collect()), key=str)
    want = [(d, len((t or "").encode().split()), sum(brute(tokencount.MARK + w.decode(), pieces) for w in (t or "").encode().split()) if d != 6
             else 100_000 * brute(tokencount.MARK + "the", pieces)) for d, t in rows]
    assert got == sorted(want, key=str)
    assert tokencount.count_tokens(df.limit(0)).count() == 0


def test_query_on_a_table(spark, pieces):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    kept = {}
    for r in queries.QUERIES["op8_token_counts"](spark, SF001).collect():
        want = 0
        for w in (docs[r.doc_id] or "").encode().split():
            if w not in kept:
                kept[w] = brute(tokencount.MARK + w.decode(), pieces)
            want += kept[w]
        assert r.n_tokens == want
