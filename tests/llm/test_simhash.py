import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docspark.llm import simhash
from docspark.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component_id long, row int"


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ")
             .replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows, radius=2):
    fps = [brute_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((str(d), f"{f:016x}", str(least.get(top(i)))) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def case_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["É", "ß", "Wort"]
    rows = []
    for d in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 40, 400]))]
        rows.append((d * 3, " ".join(base)))
        for k in range(rng.choice([0, 0, 1, 3])):
            base = base + ["Extra"] * k
            rows.append((d * 3 + 1000 + k, "\t".join(base).upper() if k == 2 else "\n ".join(base)))
    return rows + [(7777, None), (7776, ""), (7775, " \x0b\x0c "), (7777, None), (None, ""), (None, "lone one"),
                   (8000, "x " * 70000), (8001, "x " * 70001), (0, "another text under a used id")]


def test_classes_equal_brute_force(spark):
    rows = case_rows()
    df = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in rows], SCHEMA)
    for shard_size in (4096, 2):  # the small one deals every shard again
        got = simhash.near_duplicates(df, shard_size=shard_size)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == brute_classes(rows)


def test_links_over_rounds_lose_none(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(25):  # chains of one to four flipped bits, all bits alike
            b ^= sum(1 << k for k in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
            fps.add(b)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    up = {s: s for s in signed}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, f in enumerate(fps):
        for j in range(i):
            if (f ^ fps[j]).bit_count() <= 2:
                up[top(signed[i])] = top(signed[j])
    groups = {}
    for s in signed:
        groups.setdefault(top(s), []).append(s)
    want = {s: min(g) for g in groups.values() if len(g) > 1 for s in g}
    for shard_size in (4096, 3):
        assert {r.node: r.root for r in components(simhash.links(df, 2, shard_size)).collect()} == want


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100)]
    hub = [(1000, 2000 + i) for i in range(200)]
    df = spark.createDataFrame(chain + hub + chain + [(5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(101)} | {1000: 1000} | {2000 + i: 1000 for i in range(200)}
    assert components(df.limit(0)).count() == 0


def test_bk_tree_equals_scan():
    rng = random.Random(3)
    values = [rng.getrandbits(12) for _ in range(500)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        want = sorted(i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2)
        assert sorted(tree.within(q, 2)) == want


def test_drop_keeps_one_row_a_class(spark):
    rows = [(5, "same text here now"), (3, "same text here now"), (3, "same text here now"), (None, "same text here now"),
            (9, "quite another text with words"), (None, "only without id"), (None, "only without id"), (4, None), (2, "")]
    df = spark.createDataFrame([(d, t, "a", 1, 2) for d, t in rows], SCHEMA)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(3, "same text here now"), (9, "quite another text with words"), (None, "only without id"),
                          (2, "")], key=str)
    empty = df.limit(0)
    assert simhash.drop_near_duplicates(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_unlinked_documents_stay(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[
        F.xxhash64(F.col("id"), F.lit(k)).cast("string") for k in range(30)]).alias("text"))
    assert simhash.drop_near_duplicates(df).count() == 50
