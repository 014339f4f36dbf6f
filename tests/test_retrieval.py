import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from docspark.operators import ann
from docspark.operators import retrieval as R
from docspark.operators import tables as TB
from docspark.operators.ann import knn_approx


def brute(Q, qids, V, vids, k):
    out = {}
    for qi, q in zip(qids, Q):
        d = ((V - q) ** 2).sum(1)
        order = sorted(range(len(vids)), key=lambda j: (d[j], vids[j]))[:k]
        out[qi] = [(vids[j], d[j]) for j in order]
    return out


def _emb(spark):
    return spark.read.parquet(f"{SF01}/embeddings.parquet")


def test_knn_matches_brute_force_both_strategies(spark):
    e = _emb(spark)
    pdf = e.toPandas()
    V = np.vstack(pdf.embedding.map(lambda v: np.asarray(v, dtype=np.float64)))
    ids = pdf.vec_id.tolist()
    qsel = list(range(0, len(ids), 7))
    exp = brute(V[qsel], [ids[i] for i in qsel], V, ids, 5)
    q = e.where(F.col("vec_id") % 7 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    for strategy in ("broadcast", "blocked"):
        got = {}
        for r in R.knn(q, e, 5, id_col="vec_id", strategy=strategy, block_bytes=32 * 1024).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
        for qi, lst in got.items():
            lst.sort()
            assert [x[1] for x in lst] == [x[0] for x in exp[qi]]
            assert np.allclose([x[2] for x in lst], [x[1] for x in exp[qi]], atol=1e-9)
        assert set(got) == set(exp)


def test_fewer_hits_than_k_and_string_ids(spark):
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [0.9, 0.0])], "query_id int, embedding array<float>")
    rows = R.knn(q, v, 5).orderBy("rank").collect()
    assert [(r.rank, r.id) for r in rows] == [(1, "b"), (2, "a")]


def test_where_compiler_missing_keys(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 7)], "id int, tag string, n int")
    def ids(w):
        return sorted(r.id for r in df.where(R.compile_where(w, df.columns)).collect())
    assert ids({"tag": "x"}) == [1]
    assert ids({"tag": {"$ne": "x"}}) == [2]          # missing key: $ne holds
    assert ids({"tag": {"$nin": ["x"]}}) == [2]
    assert ids({"tag": {"$in": ["x", "y"]}}) == [1]
    assert ids({"n": {"$gte": 6}}) == [2]
    assert ids({"$or": [{"n": {"$lt": 6}}, {"tag": {"$eq": "zz"}}]}) == [1]
    assert ids({"$and": [{"n": {"$gt": 1}}, {"n": {"$lte": 5}}]}) == [1]


def test_rag_search_fallbacks(spark):
    v = spark.createDataFrame([("a", [0.0, 0.0], "ta", "s1"), ("b", [1.0, 0.0], "tb", None)],
                              "id string, embedding array<float>, text string, source string")
    q = spark.createDataFrame([(1, "hello", [0.9, 0.0], 2), (2, "", [0.0, 0.0], 3), (3, "x", [0.0, 0.0], 0)],
                              "query_id int, query string, embedding array<float>, k int")
    ctx = {r.query_id: r.context for r in R.rag_search(q, v, k=3, k_col="k").collect()}
    assert ctx[1] == "[Document 1] (source: Unknown Source)\ntb\n\n[Document 2] (source: s1)\nta"
    assert ctx[2] == ""
    assert ctx[3] == R.NO_HITS_TEXT


def test_knn_approx_recall(spark):
    e = _emb(spark)
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.id) for r in R.knn(q, e, 5, id_col="vec_id").collect()}
    approx = {(r.query_id, r.id) for r in knn_approx(q, e.select(F.col("vec_id").alias("id"), "embedding"), 5).collect()}
    recall = len(exact & approx) / len(exact)
    assert recall >= 0.9, recall


def _clustered(spark, n, centers, dim=8, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    C = rng.normal(size=(centers, dim))
    V = C[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, dim))
    return V, spark.createDataFrame([(f"v{i:05d}", [float(x) for x in v]) for i, v in enumerate(V)], "id string, embedding array<double>")


def test_index_always_fills_k_and_is_exact_with_slack_one(spark, scratch):
    V, v = _clustered(spark, 900, 12)
    bad = spark.createDataFrame([("n1", None), ("n2", [None] * 8), ("n3", [float("nan")] * 8), ("n4", [])], "id string, embedding array<double>")
    same = spark.createDataFrame([(f"w{i}", [0.5] * 8) for i in range(40)], "id string, embedding array<double>")
    table_set = f"{scratch}/set"
    ann.build_index(v.unionByName(bad).unionByName(same), table_set, 12)
    q = v.where("id < 'v00020'").select(F.col("id").alias("query_id"), "embedding").unionByName(
        bad.select(F.col("id").alias("query_id"), "embedding"))
    for k in (1, 7, 100, 2000):
        exact = sorted(tuple(r)[:3] for r in R.knn(q, v.unionByName(same), k).collect())
        got = sorted(tuple(r)[:3] for r in ann.search_index(q, table_set, k, slack=1.0).collect())
        assert got == exact and len(got) == 20 * min(k, 940)
        loose = ann.search_index(q, table_set, k, first=0.05).collect()
        assert len(loose) == 20 * min(k, 940)
    report = {}
    near = {(r.query_id, r.id) for r in ann.search_index(q, table_set, 5, first=0.01, report=report).collect()}
    assert report["share"] < 0.5                                      # clusters: most cells are never read
    assert len(near & {(r.query_id, r.id) for r in R.knn(q, v, 5).collect()}) >= 0.9 * 100
    # blocks of queries: the same hits
    few = sorted(tuple(r)[:3] for r in ann.search_index(q, table_set, 7, slack=1.0, limit_bytes=2000).collect())
    assert few == sorted(tuple(r)[:3] for r in R.knn(q, v.unionByName(same), 7).collect())


def test_index_reads_only_probed_cells(spark, scratch):
    _, v = _clustered(spark, 600, 10)
    ann.build_index(v, f"{scratch}/set", 10)
    assert sorted(TB.read_layout(spark, f"{scratch}/set", 1)["tables"]["cells"]["at"]) == [str(i) for i in range(10)]
    part = TB.read_table(spark, f"{scratch}/set", "cells", "id string, cell int", [3, 4])
    assert {r.cell for r in part.select("cell").distinct().collect()} == {3, 4}
    assert all("tableset_bucket=3" in f or "tableset_bucket=4" in f for f in part.inputFiles())


def test_empty_index(spark, scratch):
    none = spark.createDataFrame([("a", None)], "id string, embedding array<double>")
    ann.build_index(none, f"{scratch}/set")
    q = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<double>")
    assert ann.search_index(q, f"{scratch}/set", 3).collect() == []
    ann.build_index(spark.createDataFrame([("a", [2.0])], "id string, embedding array<double>"), f"{scratch}/set")
    assert [tuple(r) for r in ann.search_index(q, f"{scratch}/set", 3).collect()] == [(1, 1, "a", 1.0)]


def test_sync_keeps_the_index(spark, scratch):
    import os

    from docspark.plans.sync import sync_once
    kb, table_set = f"{scratch}/kb", f"{scratch}/set"
    os.makedirs(kb)

    def write(i, text, when):
        with open(f"{kb}/f{i}.txt", "w") as f:
            f.write(text)
        os.utime(f"{kb}/f{i}.txt", (when, when))
    for i in range(40):
        write(i, f"word{i % 5} topic{i % 5} extra{i}", 1_700_000_000)
    sync_once(spark, [kb], table_set, now=1, dim=16, index=True, index_cells=5)
    write(3, "completely other content now", 1_700_000_100)
    os.remove(f"{kb}/f9.txt")
    sync_once(spark, [kb], table_set, now=2, dim=16, keep=1)
    v = TB.read_table(spark, table_set, "vectors", TB.VECTORS_SCHEMA)
    at = TB.read_layout(spark, table_set, 2)["tables"]["cells"]["at"]
    assert 1 in at.values() and 2 in at.values()                      # some cells stayed as they were
    cells = TB.read_table(spark, table_set, "cells", "id string")
    assert sorted(r.id for r in cells.collect()) == sorted(r.id for r in v.collect()) and v.count() == 39
    counts = {r["cell"]: r["n"] for r in TB.read_table(spark, table_set, "centroids", "cell int, n bigint").collect()}
    assert counts == {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()} | {c: 0 for c, n in counts.items() if n == 0}
    q = v.select(F.col("id").alias("query_id"), "embedding")
    assert sorted(tuple(r)[:3] for r in ann.search_index(q, table_set, 4, slack=1.0).collect()) == sorted(tuple(r)[:3] for r in R.knn(q, v, 4).collect())


def test_final_topk_is_window_group_limit(spark):
    e = _emb(spark)
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    plan = R.knn(q, e, 5, id_col="vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_topk_kernel_tiling(monkeypatch):
    rng = np.random.default_rng(0)
    V = rng.normal(size=(301, 8))
    V[50] = V[51]                                   # an exact tie, broken by id
    Q = np.vstack([V[50] + 1e-3, rng.normal(size=(40, 8))])
    ids = np.arange(301) * 3
    exp = brute(Q, list(range(len(Q))), V, ids.tolist(), 6)
    monkeypatch.setattr(R, "_QB", 7)
    monkeypatch.setattr(R, "_VB", 13)
    top = R._TopK(Q, 6)
    for s in range(0, 301, 50):                     # several Arrow batches
        top.add(V[s:s + 50], ids[s:s + 50])
    f = top.frame(np.arange(len(Q)))
    for qi in range(len(Q)):
        got = f[f.query_id == qi].sort_values(["distance", "id"])
        assert got.id.tolist() == [x[0] for x in exp[qi]]


def test_topk_kernel_odd_vectors(monkeypatch):
    """Vectors that single precision cannot tell apart or hold, more ties than slots, ids that grow longer."""
    monkeypatch.setattr(R, "_QB", 5)
    monkeypatch.setattr(R, "_VB", 64)
    rng = np.random.default_rng(3)
    near = rng.normal(size=(400, 6))
    signs = np.array([[1.0 if i >> b & 1 else -1.0 for b in range(6)] for i in range(64)] * 6)
    for V in (near, 1e6 + 1e-3 * near, 1e25 * near, 1e-25 * near, signs, np.vstack([near[::-1], near])):
        ids = rng.permutation(len(V))
        Q = np.vstack([V[:9], V[:1], np.zeros((1, 6))])
        for k in (1, 3, 30, 1000):
            top = R._TopK(Q, k)
            for a in range(0, len(V), 150):
                top.add(V[a:a + 150], ids[a:a + 150])
            f = top.frame(np.arange(len(Q)))
            for qi, q in enumerate(Q):
                diff = q - V
                d = np.einsum("nd,nd->n", diff, diff)
                order = np.lexsort((ids, d))[:k]
                got = f[f.query_id == qi]
                assert got.id.tolist() == ids[order].tolist() and got.distance.tolist() == d[order].tolist()
    top = R._TopK(np.zeros((1, 2)), 2)
    top.add(np.array([[1.0, 0.0]]), np.array(["b"], dtype=object))
    top.add(np.array([[0.0, 1.0], [2.0, 0.0]]), np.array(["a-longer-id", "c"], dtype=object))
    assert top.frame(np.array([7])).id.tolist() == ["a-longer-id", "b"]


def test_topk_kernel_some_queries_and_caps():
    V = np.arange(20.0)[:, None]
    Q = np.array([[0.0], [0.0], [10.0]])
    top = R._TopK(Q, 3, np.array([[1], [2], [1]]), np.array([np.inf, 1.0, 4.0]))
    top.add(V[:10], np.arange(10), np.array([0, 1]))
    top.add(V[10:], np.arange(10, 20), np.array([2]))
    f = top.frame(np.array([5, 6, 7]))
    assert list(zip(f.query_id, f.id)) == [(5, 0), (5, 1), (5, 2), (6, 0), (6, 1), (7, 10), (7, 11), (7, 12)]
    assert len(R._TopK(Q, 3).Q) == 2 and len(top.Q) == 3


def test_rounds_do_not_grow_with_queries(spark, scratch):
    """However many queries there are, a round of the search is one job for all, with the same hits."""
    _, v = _clustered(spark, 500, 9)
    ann.build_index(v, f"{scratch}/set", 9)
    q = v.where("id < 'v00200'").select(F.col("id").alias("query_id"), "embedding")
    seen = []
    for limit in (R.DEFAULT_BROADCAST_LIMIT, 2000):
        for slack in (0.32, 1.0):
            report = {}
            hits = sorted(map(tuple, ann.search_index(q, f"{scratch}/set", 4, slack=slack, first=0.2, limit_bytes=limit, report=report).collect()))
            assert report["rounds"] <= 4 and len(hits) == 800
            seen.append((hits, report["share"]))
    assert seen[0] == seen[2] and seen[1] == seen[3]


def test_ties_beyond_any_margin(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(200, [0.0, 1.0]), (201, None), (202, [float("nan"), 1.0]), (203, [1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    for how in ({}, {"strategy": "broadcast"}, {"strategy": "blocked", "block_bytes": 256}):
        got = sorted((r.query_id, r.rank, r.id) for r in R.knn(q, v, 5, **how).collect())
        assert got == [(1, k + 1, k) for k in range(5)], how


def test_filters_compare_by_type(spark):
    df = spark.createDataFrame([(1, {"n": "abc"}, 5), (2, {"n": "12"}, 7), (3, {}, 9)], "id int, extra map<string,string>, n2 int")
    ids = lambda where: sorted(r.id for r in df.where(R.compile_where(where, df.columns)).collect())
    assert ids({"n": {"$gt": 9}}) == [2] and ids({"n2": "x"}) == [] and ids({"n2": {"$ne": "x"}}) == [1, 2, 3]
    assert ids({"n": {"$nin": [12]}}) == [1, 3] and ids({"n": {"$in": ["abc", 12]}}) == [1, 2] and ids({"n2": {"$lte": 7.0}}) == [1, 2]


def test_user_embeddings_are_cut_and_normalised(spark):
    from docspark.operators.embedding import embed
    df = spark.createDataFrame([(1, " a b  c d"), (2, None), (3, "")], "id int, text string")
    seen = lambda texts: [[3.0 * len(t.split()), 4.0 * len(t.split())] for t in texts]
    rows = sorted(embed(df, fn=seen, max_tokens=3).collect())
    assert [(r.token_count, [round(x, 4) for x in r.embedding]) for r in rows] == [(3, [0.6, 0.8]), (0, [0.0, 0.0]), (0, [0.0, 0.0])]
    whole = embed(spark.createDataFrame([(1, "w " * 900 + "日本語")], "id int, text string"), max_tokens=None).first()
    assert whole.token_count == 903


def test_calls_with_equal_ids_get_their_own_answers(spark):
    v = spark.createDataFrame([("a", [0.0, 0.0], "ta", "s1"), ("b", [1.0, 0.0], "tb", "s2")], "id string, embedding array<float>, text string, source string")
    given = spark.createDataFrame([("qa", [0.0, 0.1]), ("qb", [1.0, 0.1])], "query string, embedding array<float>")
    calls = spark.createDataFrame([(1, 0, 0, "call_x", "rag_search", '{"query":"qa","k":1}'), (2, 0, 0, "call_x", "rag_search", '{"query":"qb","k":1}'),
                                   (2, 0, 0, "call_x", "rag_search", '{"query":"qb","k":1}'), (3, 0, 0, None, "rag_search", '{"k":1}'),
                                   (4, 0, 0, "call_y", "other", "{}"), (5, 0, 1, "call_z", "rag_search", '{"query":"qb","k":0}')],
                                  "conv_id int, turn int, ordinal int, call_id string, name string, arguments string")
    got = sorted((r.conv_id, r.ordinal, r.call_id, r.context) for r in R.answer_tool_calls(calls, v, query_vectors=given).collect())
    a, b = "[Document 1] (source: s1)\nta", "[Document 1] (source: s2)\ntb"
    assert got == [(1, 0, "call_x", a), (2, 0, "call_x", b), (2, 0, "call_x", b), (3, 0, None, ""), (5, 1, "call_z", R.NO_HITS_TEXT)]


def test_blocked_search_shuffles_strips_not_block_pairs(spark, monkeypatch):
    """However small its blocks, the blocked strategy sends a vector once a strip of queries, and finds all hits."""
    rng = np.random.default_rng(4)
    V = rng.integers(-2, 3, size=(500, 3)).astype(float)     # many equal vectors and distances
    v = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(V)], "id string, embedding array<double>")
    q = v.select(F.substring("id", 2, 3).cast("int").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    exp = brute(V, list(range(500)), V, [f"v{i:03d}" for i in range(500)], 4)
    for strip in (1 << 20, 100 * 3 * 8):
        monkeypatch.setattr(R, "QUERY_BYTES", strip)
        hits = R.knn(q, v, 4, strategy="blocked", block_bytes=64)
        assert "CoGroup" not in hits._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in hits.collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id))
        assert {i: [x[1] for x in sorted(g)] for i, g in got.items()} == {i: [x[0] for x in e] for i, e in exp.items()}


def test_many_queries_are_not_broadcast(spark, monkeypatch):
    e = _emb(spark)
    monkeypatch.setattr(R.knn, "__kwdefaults__", R.knn.__kwdefaults__ | {"broadcast_limit_bytes": R.knn.__kwdefaults__["broadcast_limit_bytes"] >> 12})
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = R.knn(q, e, 2, id_col="vec_id")                   # 500 queries of 64 components: 250 KB
    assert "Exchange" in hits._jdf.queryExecution().executedPlan().toString() and hits.count() == 1000
    assert "cell" in hits._jdf.queryExecution().optimizedPlan().toString()
