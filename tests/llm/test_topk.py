import math
import random

import duckdb

from conftest import SF001
from docspark.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(queries_, rows, k, scale=64):
    def ints(v):
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v)
        return [math.floor(scale * x) for x in v] if ok else None
    out = []
    asked = {}
    for i, v in queries_:
        if i is not None and ints(v) is not None:
            asked[i] = min(v, asked.get(i, v))
    for i, v in asked.items():
        q = ints(v)
        got = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, w in rows
                     if j is not None and j != i and (c := ints(w)) is not None and len(c) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(got[:k])]
    return sorted(out)


def cases():
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5]) for _ in range(4)]) for i in range(300)]  # many ties
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300, 420)]  # equal vectors
    rows += [(500, None), (520, [1.0, None, 0.0, 0.0]), (540, [float("nan"), 1.0, 0.0, 0.0]), (541, [float("inf"), 0.0, 0.0, 1.0]),
             (None, [1.0, 1.0, 1.0, 1.0]), (560, [2.0, 3.0]), (561, [1.0, 1.0]), (580, []), (40, [1.0, 1.0, 1.0, 1.0]), (7, rows[7][1])]
    return rows


def test_equals_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(i, v, "clash", "x") for i, v in rows], SCHEMA).repartition(5)
    asked = [(i, v) for i, v in rows if i is None or i % 20 == 0]
    for options in ({}, {"bins": 3}, {"block_bytes": 200}, {"k": 1000}):
        got = topk.exact_topk(df.where("vec_id % 20 = 0 or vec_id is null"), df, **options)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == brute(asked, rows, options.get("k", 20)), options


def test_empty(spark):
    df = spark.createDataFrame([(1, [1.0], "a", "b")], SCHEMA)
    assert topk.exact_topk(df.limit(0), df).count() == 0
    assert topk.exact_topk(df, df.limit(0)).count() == 0
    assert topk.exact_topk(df, df).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{SF001}/embeddings.parquet')")
    want = con.sql(queries.ORACLES["op3_exact_topk"]).fetchall()
    got = queries.QUERIES["op3_exact_topk"](spark, SF001).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 500
