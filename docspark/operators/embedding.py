"""Embedding columns.

E1 ``embed`` uses a user batch function (list[str] -> list[list[float]]) in an
iterator pandas UDF, so a model is loaded once per Python worker and fed
``batch`` texts at a time. Without a function it uses a JVM-only offline
embedding: tokenise -> hashed term counts -> L2 normalise (pyspark.ml), which
keeps the whole stage in the JVM.

``new_contents`` and ``with_contents`` embed by content: a text that a table of embeddings already
holds, under its sha1 and the model's name, is not embedded again, and one that
repeats is embedded once.
"""

from __future__ import annotations

from typing import Callable, Iterator, List, Optional

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from docspark.session import ensure_parallelism

EmbeddingFn = Callable[[List[str]], List[List[float]]]

#: Fixed value: tokens that ``truncate_tokens`` keeps.
MAX_TOKENS = 512


def l2_normalize_col(v: Column, eps: float = 1e-12) -> Column:
    """V / max(||v||, eps) as a higher-order expression (stays in codegen)."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(eps)))


def l2_normalize(df: DataFrame, col: str = "embedding", out: Optional[str] = None) -> DataFrame:
    return df.withColumn(out or col, l2_normalize_col(F.col(col)))


def truncate_tokens(df: DataFrame, tokens_col: str = "tokens", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Keep the first ``max_tokens`` tokens."""
    return df.withColumn(tokens_col, F.slice(F.col(tokens_col), 1, max_tokens))


def last_token_pool(df: DataFrame, id_col: str = "id", pos_col: str = "pos",
                    vec_col: str = "vec", mask_col: str = "mask") -> DataFrame:
    """Vector at the last unmasked position per id (left or right padding alike)."""
    return (df.where(F.col(mask_col) == 1)
              .groupBy(id_col)
              .agg(F.max_by(vec_col, pos_col).alias("embedding"),
                   F.count(F.lit(1)).alias("token_count")))


def token_usage(df: DataFrame, count_col: str = "token_count", by: Optional[List[str]] = None) -> DataFrame:
    """E5: total tokens embedded, overall or per group."""
    agg = F.sum(count_col).alias("total_tokens")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


_SPACELESS = r"\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
#: A word, or one character of a script that is written without spaces.
_TOKEN = rf"(?U)[{_SPACELESS}]|[\w&&[^{_SPACELESS}]]+"


def tokens_column(text: Column, max_tokens: Optional[int] = None) -> Column:
    """Lower-case tokens of the offline embedding: words, and single characters of scripts without spaces."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    return found if max_tokens is None else F.slice(found, 1, max_tokens)


def _hashing_embed(df: DataFrame, text_col: str, out_col: str, dim: int, max_tokens: Optional[int]) -> DataFrame:
    tmp_tok, tmp_tf, tmp_n = "_emb_tokens", "_emb_tf", "_emb_norm"
    out = df.withColumn(tmp_tok, tokens_column(F.col(text_col), max_tokens))
    out = HashingTF(inputCol=tmp_tok, outputCol=tmp_tf, numFeatures=dim).transform(out)
    out = Normalizer(inputCol=tmp_tf, outputCol=tmp_n, p=2.0).transform(out)
    return (out.withColumn(out_col, vector_to_array(F.col(tmp_n), "float32"))
               .withColumn("token_count", F.size(tmp_tok))
               .drop(tmp_tok, tmp_tf, tmp_n))


def _udf_embed(fn: EmbeddingFn, batch: int):
    @F.pandas_udf("array<double>")
    def _embed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            texts = s.tolist()
            vecs: list = []
            for i in range(0, len(texts), batch):
                vecs.extend(fn(texts[i:i + batch]))
            yield pd.Series(vecs)
    return _embed.asNondeterministic()     # called once, and never inside the normalisation


def embed(df: DataFrame, text_col: str = "text", fn: Optional[EmbeddingFn] = None, batch: int = 128, dim: int = 256,
          out_col: str = "embedding", max_tokens: Optional[int] = None) -> DataFrame:
    """Add ``embedding`` (array<float>, unit length; all zero stays zero) and ``token_count``.

    A text is embedded whole, or up to ``max_tokens`` tokens for a model that takes no
    more (the same number for stored texts and questions); ``token_count`` counts what was embedded. ``fn`` gets the
    text cut there (tokens parted by white space); its vectors are normalised here."""
    df = ensure_parallelism(df)
    if fn is None:
        return _hashing_embed(df, text_col, out_col, dim, max_tokens)
    text = F.coalesce(F.col(text_col), F.lit(""))
    most = "" if max_tokens is None else int(max_tokens)
    head = F.regexp_extract(text, rf"\A(?:\s*+\S++){{0,{most}}}+", 0) if max_tokens is not None else text
    count = F.size(F.regexp_extract_all(head, F.lit(r"\S+"), F.lit(0)))
    df = df.withColumn("token_count", count).withColumn(out_col, _udf_embed(fn, batch)(head))
    return df.withColumn(out_col, l2_normalize_col(F.col(out_col)).cast("array<float>"))


#: A text's embedding under a model, whoever holds the text.
CONTENTS_SCHEMA = "text_key string, model string, embedding array<float>, token_count int"
#: Texts that more than one row in so many has are looked up by broadcast: there are fewer than this number.
HEAVY = 1000


def text_key(text: Column) -> Column:
    """sha1 of the text's UTF-8 bytes; null counts as empty."""
    return F.sha1(F.coalesce(text, F.lit("")).cast("binary"))


def new_contents(df: DataFrame, known: DataFrame, model: str, text_col: str = "text", **how) -> DataFrame:
    """The rows that ``known`` (``CONTENTS_SCHEMA``) lacks for the texts of ``df``, a row a different text.

    ``how``: arguments of ``embed``. Repeats of a text are dropped in the tasks before the shuffle
    and before the model. What ``known`` holds of other models is not looked at."""
    texts = df.select(text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.groupBy("text_key").agg(F.min("text").alias("text"))
    held = known.where(F.col("model") == model).select("text_key")
    fresh = embed(texts.join(held, "text_key", "left_anti"), "text", **how)
    return fresh.select("text_key", F.lit(model).alias("model"), "embedding", "token_count")


def with_contents(df: DataFrame, contents: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``df`` with embedding and token_count looked up in ``contents``; texts it lacks have null.

    A text that a large part of the rows has would send them all to one task: texts of
    over a thousandth of the rows, so fewer than a thousand, are counted first and their
    embeddings broadcast; the rest is joined by key. Of repeated entries the least is taken."""
    own = "_text_key"
    rows = df.drop("embedding", "token_count").withColumn(own, text_key(F.col(text_col)))
    found = contents.where(F.col("model") == model).groupBy(F.col("text_key").alias(own)).agg(
        F.min(F.struct("embedding", "token_count")).alias("_found"))
    counts = rows.groupBy(own).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg((F.count(F.lit(1)) / HEAVY).alias("_most"))
    heavy = counts.where(F.col("_n") > total.scalar()).select(own)
    heavy_found = F.broadcast(heavy.join(found, own, "left").select(own, "_found", F.lit(True).alias("_heavy")))
    marked = rows.join(heavy_found, own, "left")
    light = marked.where("_heavy is null").drop("_found", "_heavy").join(found, own, "left")
    both = marked.where("_heavy").drop("_heavy").unionByName(light)
    return both.select(*[c for c in rows.columns if c != own], "_found.embedding", "_found.token_count")
