import hashlib
import random
import zlib

from pyspark.sql import functions as F

from docspark.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank int, digest string, children int"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text=None):
    said = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in said))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {}
    for s in order:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        levels[s] = levels_of([leaf_of(r) for r in trees[s]])
    top = levels_of([levels[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for rank, r in enumerate(trees[s]):
            tampers = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node, proof = leaf_of(r, lower(r["text"])) if tampers else leaf_of(r), ""
            for way, at in ((levels[s], rank), (top, place)):
                for level in way[:-1]:
                    run, digit = level[at // 16 * 16:at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:digit] + run[digit + 1:])
                    node = H("".join(run[:digit] + [node] + run[digit + 1:]))
                    at //= 16
            root = top[-1][0]
            out.append((str(r["doc_id"]), leaf_of(r), levels[s][-1][0], root, H(proof), node, node == root))
    return sorted(out)


def proved(spark, rows, scratch):
    path = f"{scratch}/documents.parquet"
    spark.createDataFrame([tuple(r.get(c) for c in ("doc_id", "text", "lang", "source", "n_chars")) + ("t", 1, "d", 2) for r in rows],
                          SCHEMA).repartition(3).write.parquet(path)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                  for r in queries.QUERIES["op11_merkle_manifest"](spark, scratch).collect())


def document(i, source, text="Some Text", lang="en"):
    return {"doc_id": i, "source": source, "lang": lang, "n_chars": None if text is None else len(text), "text": text}


def test_equals_brute_force(spark, scratch):
    rng = random.Random(3)
    rows = [document(i, "big", f"Text {i}") for i in rng.sample(range(10_000), 300)]
    rows += [document(i, f"s{i % 40}") for i in range(60)]                      # more sources than a run has members
    rows += [document(i, "sixteen") for i in range(16)] + [document(i, "seventeen") for i in range(17)]
    rows += [document(1, None, None, None), document(2, None), document(None, "nulls", ""), document(None, "nulls", None), document(5, "")]
    rows += [document(7, "same", "A b") for _ in range(40)]                     # repeated rows are a leaf each
    rows += [document(8, "same", t) for t in ("Z", "a", "É", "x" * 300_000)] + [document(-3, "ä"), document(4, "Ä"), document(6, "z")]
    rows += [document(10, "lone", "No Change?"), document(11, "öther", "é 1:2:-")]
    assert proved(spark, rows, scratch) == brute(rows)


def test_one_source_and_one_row(spark, scratch):
    rows = [document(i, "only") for i in range(257)]
    assert proved(spark, rows, f"{scratch}/a") == brute(rows)
    assert proved(spark, rows[:1], f"{scratch}/b") == brute(rows[:1])
    assert proved(spark, [], f"{scratch}/c") == []


def test_tampering_is_found(spark, scratch):
    rows = [document(i, "s", "Upper" if i % 2 else "lower") for i in range(100)]
    verified = {int(r[0]): r[-1] for r in proved(spark, rows, scratch)}
    for i, ok in verified.items():
        assert ok == (zlib.crc32(str(i).encode()) % 5 != 0 or i % 2 == 0)


def test_proofs_come_from_the_records(spark, scratch):
    """A record that is missing or holds other children is no proof."""
    df = spark.createDataFrame([(i, "s", "en", 1, "t") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.build(df, extra={"doc_id": F.col("doc_id")})
    some = merkle.prove(manifest, manifest.leaves.where("doc_id in (3, 39)")).collect()
    assert sorted(r.doc_id for r in some) == [3, 39]
    assert all(r.root == manifest.root and [len(p.siblings) // 64 for p in r.path] == ([15, 2] if r.doc_id == 3 else [7, 2]) for r in some)
    manifest.levels[0] = manifest.levels[0].where("place > 0")
    try:
        merkle.prove(manifest).collect()
        raise AssertionError("a lost record must fail")
    except Exception as e:
        assert "no record of node" in str(e)


def test_equal_subtrees_are_spread(spark):
    nodes = spark.range(1000).select(F.lit("t").alias("tree"), F.col("id").alias("place"), F.lit("d").alias("digest"), F.array(F.lit("c")).alias("children"))
    assert 32 <= merkle.records(nodes).count() <= 64
