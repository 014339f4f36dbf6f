"""The registered queries of this package and their SQL.

A query applies its operator to its whole table; where a contract fixes the
columns, they are derived from the operator's output here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import chat, collocations, decontaminate, langid, licenses, lm, merkle, packing, secretscan, simhash, tokencount, topk, urlfilter
from docspark.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a conversation, read back from its segments and the loss masks of its
    examples. The two digests are each one hash over a whole conversation, so its
    turns meet here."""
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    segments = chat.format_turns(turns)
    read = chat.read_turns(segments, chat.expand(segments))
    whole = read.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "loss_text"))).alias("t"))
    said = F.concat_ws("", F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.col("t.loss_text"))
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                        "formatted_chars")


ORACLES["op2_chat_prefix_targets"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
x AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<turn', '&lt;turn'), '</turn', '&lt;/turn') AS body,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '&nl;') AS head FROM t),
e AS (SELECT *, '<turn ' || head || '>' || chr(10) || body || '</turn>' || chr(10) AS segment FROM x)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, segment)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors.where("vec_id % 20 = 0"), vectors)


ORACLES["op3_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op4_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(crc_mod(F.col("doc_id"), 5), F.lit(1))  # a null id is in no held-out fold
    model = langid.fit(docs.where(fold != 0))
    return langid.identify(docs, model).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(crc_mod(F.col("doc_id"), 7), F.lit(0))  # a null id is in no held-out fold
    model = lm.learn(docs.where(fold != 2))
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    return lm.score(docs, model).withColumn("held_out", held)


#: (action, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, each folded from its leaf, or from the tampered one of every
    document whose id's CRC-32 is divisible by 5: its text with A-Z lower-cased."""
    docs = table(spark, sf_dir, "documents")
    folded = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = merkle.leaf_digest([folded if c == "text" else F.col(c) for c in merkle.FIELDS])
    manifest = merkle.build(docs, extra={"doc_id": F.col("doc_id"), "tampered": F.when(crc_mod(F.col("doc_id"), 5) == 0, changed)})
    proofs = merkle.prove(manifest).withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf")))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS tree, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
      || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    CASE WHEN doc_id IS NULL THEN FALSE ELSE xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))),
      lambda c, b: xor(c // 256, list_extract(t, (xor(c, b) % 256) + 1))), 4294967295) % 5 = 0 END AS tampers
  FROM documents, crc_table),
l AS (
  SELECT *, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS changed FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l),
lv AS (
  SELECT tree, 0 AS height, list(leaf ORDER BY rank) AS nodes FROM r GROUP BY tree
  UNION ALL
  SELECT tree, height + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))
  FROM lv WHERE len(nodes) > 1),
sub AS (
  SELECT lv.tree, nodes[1] AS subroot, row_number() OVER (ORDER BY s.source NULLS FIRST) - 1 AS place
  FROM lv JOIN (SELECT DISTINCT tree, source FROM r) s ON s.tree = lv.tree WHERE len(nodes) = 1),
tv AS (
  SELECT 0 AS height, list(subroot ORDER BY place) AS nodes FROM sub
  UNION ALL
  SELECT height + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))
  FROM tv WHERE len(nodes) > 1),
steps AS (
  SELECT r.doc_id, r.leaf, r.changed, r.tampers, r.tree, r.rank, x.place, 0 AS step, 0 AS height, FALSE AS above, r.rank AS at,
    r.leaf AS plain, CASE WHEN r.tampers THEN r.changed ELSE r.leaf END AS folded, '' AS proof
  FROM r JOIN sub x ON x.tree = r.tree
  UNION ALL
  SELECT s.doc_id, s.leaf, s.changed, s.tampers, s.tree, s.rank, s.place, s.step + 1,
    CASE WHEN n.w = 1 THEN 0 ELSE s.height + 1 END, s.above OR n.w = 1, CASE WHEN n.w = 1 THEN s.place ELSE s.at // 16 END, s.plain,
    CASE WHEN n.w = 1 THEN s.folded ELSE sha256(array_to_string(list_concat(list_concat(n.run[1:s.at % 16], [s.folded]), n.run[s.at % 16 + 2:16]), '')) END,
    CASE WHEN n.w = 1 THEN s.proof ELSE s.proof || array_to_string(list_concat(n.run[1:s.at % 16], n.run[s.at % 16 + 2:16]), '') END
  FROM steps s JOIN (
    SELECT FALSE AS above, tree, height, i AS run_at, nodes[i * 16 + 1:i * 16 + 16] AS run, len(nodes) AS w FROM lv, unnest(range(0, (len(nodes) + 15) // 16)) u(i)
    UNION ALL
    SELECT TRUE, NULL, height, i, nodes[i * 16 + 1:i * 16 + 16], len(nodes) FROM tv, unnest(range(0, (len(nodes) + 15) // 16)) u(i)) n
  ON n.above = s.above AND n.height = s.height AND n.run_at = s.at // 16 AND (s.above OR n.tree = s.tree)
  WHERE NOT (s.above AND n.w = 1)),
done AS (SELECT *, row_number() OVER (PARTITION BY tree, rank ORDER BY step DESC) AS back FROM steps),
root AS (SELECT nodes[1] AS root FROM tv WHERE len(nodes) = 1)
SELECT done.doc_id, done.leaf, sub.subroot, root.root, sha256(done.proof) AS proof_sha256, done.folded AS folded_root, done.folded = root.root AS verified
FROM done JOIN sub ON sub.tree = done.tree, root WHERE done.back = 1
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language."""
    phrases, words = collocations.count_phrases(table(spark, sf_dir, "documents"))
    return collocations.top_phrases(collocations.score_phrases(phrases, words)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLES["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 6)) a(k), unnest(range(1, len(ws) - k + 2)) b(i)),
f AS (SELECT lang, phrase, k, count(*) AS n FROM g GROUP BY lang, phrase, k HAVING count(*) >= 100),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, n, string_split(phrase, ' ') AS ws, k FROM f WHERE k > 2),
h AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, n, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM s, unnest(range(2, k)) a(m), unnest(range(1, k - m + 2)) b(i)) GROUP BY lang, phrase),
c AS (
  SELECT f.lang, f.phrase, f.n AS a, f.k AS size, string_split(f.phrase, ' ') AS ws FROM f LEFT JOIN h ON h.lang = f.lang AND h.phrase = f.phrase
  WHERE f.k > 1 AND (h.n IS NULL OR 100 * h.n < 100 * f.n)),
x AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:size], ' ') AS rest FROM c, unnest(range(1, size)) u(j)),
y AS (
  SELECT x.lang, x.phrase, x.a, b.n AS l, e.n AS r, t.n AS n, CAST((1000 * CAST(x.a AS HUGEINT) * t.n) // (CAST(b.n AS HUGEINT) * e.n) AS BIGINT) AS score, j
  FROM x JOIN f b ON b.lang = x.lang AND b.phrase = x.head JOIN f e ON e.lang = x.lang AND e.phrase = x.rest JOIN t ON t.lang = x.lang),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM y),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM z WHERE cut = 1)
SELECT * FROM o WHERE rank <= 2000
"""


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document. A document counts as a repository, its source as its owner."""
    read = secretscan.read_texts(table(spark, sf_dir, "documents"))
    rows = secretscan.by_document(read, secretscan.find_secrets(read))
    return rows.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                       "spans", "n_live", "n_examples")


def _secret_sql() -> str:
    parts = []
    for i, (kind, pattern, group) in enumerate(secretscan.KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"SELECT row, repository, owner, {i} AS place, '{kind}' AS kind, string_split_regex(t, {p}) AS gaps, "
                     f"regexp_extract_all(t, {p}, 0) AS whole, regexp_extract_all(t, {p}, {group}) AS said FROM d WHERE regexp_matches(t, {p})")
    return r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS repository, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
m AS (""" + " UNION ALL ".join(parts) + rf"""),
o AS (
  SELECT row, repository, owner, place, kind, whole[i] AS w, said[i] AS value,
    CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS start
  FROM m, unnest(range(1, len(whole) + 1)) u(i)),
s AS (
  SELECT row, repository, owner, place, kind, start, start + length(w) AS finish, sha256(value) AS hash,
    len(list_distinct(string_split(value, ''))) >= {secretscan.LEAST_VARIETY} AND NOT regexp_matches(translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{secretscan.PLACEHOLDERS}')
      AND (kind <> 'key' OR (regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9][^0-9]*[0-9][^0-9]*[0-9]'))) AS live
  FROM o WHERE kind <> 'assign' OR length(value) >= {secretscan.LEAST_ASSIGNED}),
f AS (SELECT hash, count(DISTINCT repository) AS repositories, count(DISTINCT owner) AS owners FROM s GROUP BY hash),
j AS (
  SELECT s.*, CASE WHEN owners >= 3 OR (owners > 1 AND repositories >= 20) THEN 'example' WHEN live THEN 'live' ELSE 'weak' END AS verdict
  FROM s JOIN f ON f.hash = s.hash),
k AS (
  SELECT * FROM j WHERE kind IN ('assign', 'access', 'hex') OR (verdict = 'live' AND NOT EXISTS (
    SELECT 1 FROM j b WHERE b.row = j.row AND b.kind IN ('assign', 'access', 'hex') AND b.start < j.finish AND j.start < b.finish)))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, place) FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, place) FILTER (kind IS NOT NULL), '') AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_examples
FROM d LEFT JOIN k ON k.row = d.row GROUP BY d.row, d.doc_id
"""


ORACLES["op13_secret_scan"] = _secret_sql()
