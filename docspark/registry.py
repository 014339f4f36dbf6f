"""User extension points, keyed by lower-case file extension.

* loaders (U1): ``fn(files DataFrame) -> documents`` or ``(documents, rejects)``;
  used by ``sources.files.route_by_ext``; a registered extension overrides
  the built-in loader.
* structure splitters (U2): ``fn(documents DataFrame) -> sections DataFrame``
  (``section``, ``h1..h4``, ``text``); built-ins fill only unset extensions,
  and a kind switched off in the options stays off even when registered.
* chunkers (U3): a batch function ``list[str] -> list[list[str]]`` wrapped in
  a pandas UDF; other extensions use the recursive splitter.
* embedding function (U4): pass ``fn`` to ``operators.embedding.embed``.
"""

from __future__ import annotations

from typing import Callable, Dict, List

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docspark.operators import chunks as K


class Registry:
    def __init__(self):
        self.loaders: Dict[str, Callable] = {}
        self.splitters: Dict[str, Callable] = {}
        self.chunkers: Dict[str, Callable[[List[str]], List[List[str]]]] = {}

    def register_loader(self, ext: str, fn: Callable) -> None:
        self.loaders[ext.lower()] = fn

    def register_structure_splitter(self, ext: str, fn: Callable) -> None:
        self.splitters[ext.lower()] = fn

    def register_chunker(self, ext: str, fn: Callable[[List[str]], List[List[str]]]) -> None:
        self.chunkers[ext.lower()] = fn

    def apply_chunkers(self, df: DataFrame, **how) -> DataFrame:
        """Registered chunkers for their extensions, the recursive splitter elsewhere.
        Custom chunkers give no offsets, so their start_index is NULL."""
        ext = F.col("file_ext")
        parts = [K.recursive_chunks(df.where(~ext.isin(list(self.chunkers)) | ext.isNull()), "text", **how)]
        for e, fn in self.chunkers.items():
            udf = _chunker_udf(fn)
            sub = df.where(ext == e)
            others = [c for c in sub.columns if c != "text"]
            parts.append(sub.select(*others, F.posexplode(udf(F.col("text"))).alias("chunk_pos", "text"))
                            .withColumn("start_index", F.lit(None).cast("int")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


def _chunker_udf(fn):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(fn(texts.fillna("").tolist())))
    return run.asNondeterministic()
