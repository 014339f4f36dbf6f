import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docspark.llm import collocations, queries

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, word int, part string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, "x", "r") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, longest=5, limit=2000):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        counts[lang, tuple(words[i:i + k])] += 1
    f = {k: v for k, v in counts.items() if v >= least}
    out = {}
    for (lang, ws), a in f.items():
        inside = any(la == lang and len(q) > len(ws) and 100 * v >= 100 * a and any(q[i:i + len(ws)] == ws for i in range(len(q)))
                     for (la, q), v in f.items())
        if len(ws) > 1 and not inside:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]])
                                        for k in range(1, len(ws)))
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[:limit]))


def mined(spark, rows, least, budget=400_000, limit=2000):
    phrases, words = collocations.count_phrases(frame(spark, rows), least=least, budget=budget)
    top = collocations.top_phrases(collocations.score_phrases(phrases, words), limit)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in top.collect())


def corpus(seed, size=250):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "é", "É", "a" * 40, "x-y", "I", "is", "\x00", " b", "|", "(c)"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", "\r\n", " ; "]
    rows = []
    for _ in range(size):
        said = []
        for _ in range(rng.randint(0, 40)):
            said += ["New York is big"] if rng.random() < 0.2 else [rng.choice(words[:rng.randint(1, len(words))])]
            said.append(rng.choice(ends))
        rows.append((rng.choice(["en", "de", None, "und", "", "e n"]), "".join(said)))
    return rows + [(None, None), ("en", None), ("en", ""), ("en", " .,;"), ("en", "the " * 3000), ("en", "of the " * 3000)]


def test_equals_brute_force(spark):
    rows = corpus(1)
    want = brute(rows, 8)
    assert len(want) > 100
    assert mined(spark, rows, 8) == want
    # prefixes over the budget are lengthened, and their nodes summed over groups
    assert mined(spark, rows, 8, budget=5) == want
    assert mined(spark, rows, 8, budget=40, limit=7) == brute(rows, 8, limit=7)


def test_query_and_empty(spark, scratch):
    assert mined(spark, [], 2) == [] and mined(spark, [(None, None)], 1) == []
    rows = [("en", "Tick tock goes the clock. ")] * 60 + [("en", "tick tock")] * 40 + [("fr", "tick tock")] * 99
    frame(spark, rows).write.parquet(f"{scratch}/documents.parquet")
    got = queries.QUERIES["op12_collocations"](spark, scratch).collect()
    assert [tuple(r) for r in got] == [("en", 1, "tick tock", 100, 100, 100, 380, 3800)]


def test_blocks_do_not_cut_phrases(monkeypatch):
    bits = b"\xff" * (collocations.BITS // 8)
    text = lower(" ".join(t or "" for _, t in corpus(4, 60))).encode()

    def counted(**sizes):
        for k, v in sizes.items():
            monkeypatch.setattr(collocations, k, v)
        out, pairs = Counter(), Counter()
        for into, count in ((out, lambda r: collocations.suffix_counts(r, np.frombuffer(bits, np.uint8))), (pairs, collocations.pair_counts)):
            r = collocations._Runs(bits, 5)
            for _ in r.add(b"en", text):
                for b in count(r):
                    into.update(dict(zip(b.column(-2).to_pylist(), b.column(-1).to_pylist())))
                r.rest()
            for b in count(r):
                into.update(dict(zip(b.column(-2).to_pylist(), b.column(-1).to_pylist())))
        return out, pairs
    whole = counted()
    pieces = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text.decode())]
    assert sum(whole[0].values()) == sum(map(len, pieces)) and sum(whole[1].values()) == sum(max(0, len(p) - 1) for p in pieces)
    assert sorted(whole[1].values()) == sorted(Counter(x for p in pieces for x in zip(p, p[1:])).values())
    for block, words, size in ((64, 400_000, 1 << 20), (200, 7, 1 << 20), (7, 3, 5), (1, 1, 1)):
        assert counted(_BLOCK=block, _WORDS=words, _SUFFIXES=size) == whole


def test_groups(spark):
    got = collocations.first_fit({0: 5, 1: 9, 2: 4, 3: 1, 4: 12}, 10)
    assert got == {4: 0, 1: 1, 0: 2, 2: 2, 3: 1}
    leaves = spark.createDataFrame([("en", f"a b{i % 7} c{i}", 1) for i in range(200)] + [("en", "a", 9), ("en", "z q", 1)], "lang string, suffix string, n long")
    rows = collocations.group_leaves(leaves, 5, 30)[0].collect()
    assert len(rows) == 202 and {r.depth for r in rows if r.suffix.startswith("a b")} == {2} and {r.depth for r in rows if r.suffix == "z q"} == {1}
    sizes = Counter(r.part for r in rows)
    assert max(sizes.values()) <= 2 * 30


def test_exact_arithmetic(spark):
    # products past 64 bits, and quotients just below a whole number
    big = 10 ** 12
    phrases = spark.createDataFrame([("en", "a", 1, big - 1), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 3)], "lang string, phrase string, words int, n long")
    words = spark.createDataFrame([("en", "a", 7 * big)], "lang string, word string, n long")
    got = collocations.score_phrases(phrases, words).first()
    assert got.score == 1000 * (big - 3) * 7 * big // ((big - 1) * (big + 1)) == 6999


def test_subtree_counts():
    t = pa.table({"lang": ["en"] * 3, "suffix": ["a b c", "a b", "a d"], "n": [3, 2, 1], "depth": pa.array([1, 1, 1], pa.int32())})
    got = {(r["phrase"], r["n"]) for r in collocations.subtree(t, 5, 2).to_pylist()}
    assert got == {("a", 6), ("a b", 5), ("a b c", 3)}


def test_frequent_bits_match_the_workers_hash(spark):
    import xxhash
    words = spark.createDataFrame([("en", f"w{i}é", i) for i in range(300)], "lang string, word string, n long")
    key = F.xxhash64(F.concat_ws(" ", "lang", "word"))
    bits = collocations._frequent_bits(words, 100, key)
    for i in range(300):
        h = xxhash.xxh64_intdigest(f"en w{i}é".encode(), seed=42) % collocations.BITS
        assert bool(bits[h >> 3] >> (h & 7) & 1) == (i >= 100)
    assert words.where(F.col("n") > 500).count() == 0 and not any(collocations._frequent_bits(words, 500, key))
