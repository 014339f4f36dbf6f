"""Brute-force checks for the registered queries that have no SQL oracle:
the Spark result over whole sf0.001 tables equals a plain-Python loop."""
import math
import re

import numpy as np
import pyarrow.parquet as pq

import __spark_entry__ as E
from conftest import SF001


def _pd(name):
    return pq.read_table(f"{SF001}/{name}.parquet").to_pandas()


def test_html_sections_by_plain_search(spark):
    """Every page's header and paragraphs, found by regular expressions in its raw text."""
    import html as H
    got = {}
    for r in E.queries()["html_sections"](spark, SF001).collect():
        got.setdefault(r.page_id, []).append((r.section, r.h1, r.text))
    plain = lambda t: " ".join(H.unescape(re.sub(r"<[^>]*>", "", t)).split())
    for pid, raw in zip(_pd("pages").page_id, _pd("pages").html):
        headers = [plain(h) for h in re.findall(r"<h1>(.*?)</h1>", raw, re.S)]
        assert {h for _, h, _ in got[pid] if h} == set(headers)
        said = " ".join(t.replace("  \n", " ") for _, _, t in sorted(got[pid]))
        for p in re.findall(r"<p>(.*?)</p>", raw.split("</head>")[1].split("<article>")[1], re.S):
            for line in re.split(r"<(?:br|p|li|ul|ol|div|tr|td|table|pre|blockquote)[^>]*>", p):
                assert plain(line) in said


def test_structure_split_routes_by_extension(spark):
    got = E.queries()["structure_split"](spark, SF001)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.source, []).append((r.section, r.h1, r.text))
    docs = {f"kb/{i}.txt": t for i, t in zip(_pd("documents").doc_id, _pd("documents").text)}
    events = {f"kb/json/{i}.json": t for i, t in zip(_pd("events").event_id, _pd("events").props)}
    assert all(rows[s] == [(0, None, t)] for s, t in docs.items())
    assert all([x[2] for x in rows[s]] == [t] for s, t in events.items())     # flat objects fit one piece
    assert all(rows[f"kb/md/{i}.md"][0][1] == f"T{i}" for i in _pd("documents").doc_id)
    assert all(f"kb/html/{i}.html" in rows for i in _pd("pages").page_id)


def test_preprocess_numbers_every_file(spark):
    rows = {}
    for r in E.queries()["preprocess"](spark, SF001).collect():
        rows.setdefault(r.source, []).append(r)
    texts = {f"kb/{i}.txt": t for i, t in zip(_pd("documents").doc_id, _pd("documents").text)}
    assert set(rows) == {s for s, t in texts.items() if t and t.strip()}
    for s, rs in rows.items():
        rs.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in rs] == list(range(len(rs)))
        assert all(r.end_index - r.start_index == len(r.text) <= 1000 and r.citation == f"{r.file_name}#chunk{r.chunk_index}" for r in rs)


def test_embed_unit_length_and_counts(spark):
    rows = E.queries()["embed"](spark, SF001).collect()
    docs = dict(zip(_pd("documents").doc_id, _pd("documents").text))
    for r in rows:
        v = np.asarray(r.embedding, dtype=np.float64)
        assert len(v) == 256 and abs(np.linalg.norm(v) - 1) < 1e-5
        toks = re.findall(r"\w+", docs[r.doc_id].lower())
        assert r.token_count == len(toks)


def test_knn_by_text_brute_force(spark):
    from pyspark.sql import functions as F
    from docspark.operators.embedding import embed
    from docspark.plans import fixtures as X
    from docspark.plans.ingest import preprocess
    got = {}
    for r in E.queries()["knn_by_text"](spark, SF001).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    ch = preprocess(X.docs_as_files(spark, SF001).drop("doc_id"))
    vec = embed(ch, "text", dim=256).select("chunk_id", "embedding").toPandas()
    q = embed(X.table(spark, SF001, "benchmark").select(F.col("item_id").alias("query_id"), "text"),
              "text", dim=256).select("query_id", "embedding").toPandas()
    V = np.vstack(vec.embedding.map(lambda x: np.asarray(x, dtype=np.float64)))
    ids = vec.chunk_id.tolist()
    for qid, qv in zip(q.query_id, q.embedding):
        d = ((V - np.asarray(qv, dtype=np.float64)) ** 2).sum(1)
        best = sorted(range(len(ids)), key=lambda j: (d[j], ids[j]))[:5]
        assert [i for _, i in sorted(got[qid])] == [ids[j] for j in best]


def test_streaming_query_equals_batch_twin(spark):
    a = E.queries()["stream_events_streaming"](spark, SF001)
    b = E.queries()["stream_events"](spark, SF001)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
