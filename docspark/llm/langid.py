"""Language identification: averaged hashed subword embeddings, linear softmax.

A text's letters are lower-cased, everything else parts words, and the byte
n-grams of the words (with their borders) are hashed into buckets. A text is
the average of its n-grams' embeddings; a linear layer and a softmax give the
languages. Embeddings and layer are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows; another part of the sample sets the
softmax temperature and the confidence under which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import workers_ready

UNKNOWN = "und"
SIZES = (2, 3, 4)
#: Bytes whose n-grams are hashed at once: bounds the memory of a very long text.
CHUNK = 1 << 20
#: Rows whose shares, 16 KB each, are handed on at once: buffers of that size stay with the executor.
SHARES = 100
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def grams(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's n-grams, in chunks; ``buckets`` is a power of two."""
    clean = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    last = SIZES[-1] - 1
    for at in range(0, max(1, len(clean) - last), CHUNK):
        a = np.frombuffer(clean, np.uint8, min(len(clean) - at, CHUNK + last), at).astype(np.uint32)
        final = at + CHUNK >= len(clean) - last
        h = a
        for n in range(2, SIZES[-1] + 1):
            h = h[:-1] * np.uint32(0x01000193) ^ a[n - 1:]
            if n in SIZES:
                # a chunk's n-grams start in it; the last chunk has all that are left
                yield ((h if final else h[:CHUNK]) * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> shift


def average(text: str, buckets: int) -> np.ndarray:
    """Share of each bucket among a text's n-grams."""
    counts = np.zeros(buckets)
    for g in grams(text, buckets):
        counts += np.bincount(g, minlength=buckets)
    return counts / max(1.0, counts.sum())


@dataclass
class Model:
    langs: list[str]
    #: Embeddings times layer: what an n-gram adds to each language, before averaging.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: A smaller confidence is rejected.
    least: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.table + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence, rejected."""
        if not has_letter(text) or not self.langs:
            return UNKNOWN, 0.0, True
        total, n = np.zeros(len(self.langs)), 0
        for g in grams(text, len(self.table)):
            total += self.table[g].sum(axis=0)
            n += len(g)
        p = softmax((total / max(1, n) + self.bias) / self.temperature)
        at = int(np.argmax(p))
        return self.langs[at], float(p[at]), bool(p[at] < self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(x: np.ndarray, labels: list[str], dim: int = 16, epochs: int = 30, batch: int = 16, rate: float = 20.0,
          seed: int = 7, rejected: float = 0.001) -> Model:
    """A calibrated model from averages ``x`` and their languages.

    Every fifth row calibrates: the temperature has the best likelihood on
    them, and the least confidence is what all but the share ``rejected`` of
    them reach, one half at most."""
    langs = sorted(set(labels))
    y = np.array([langs.index(v) for v in labels], np.int64)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    embed = rng.normal(0, 0.3, (x.shape[1], dim))
    layer, bias = np.zeros((dim, len(langs))), np.zeros(len(langs))
    rows = np.flatnonzero(~held)
    steps = epochs * -(-max(1, len(rows)) // batch)
    done = 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), batch):
            some = rows[at:at + batch]
            mean = x[some] @ embed
            g = softmax(mean @ layer + bias)
            g[np.arange(len(some)), y[some]] -= 1
            g *= rate * (1 - done / steps) / len(some)
            back = g @ layer.T
            layer -= mean.T @ g
            bias -= 0.01 * g.sum(axis=0)
            hit = np.flatnonzero(x[some].any(axis=0))
            embed[hit] -= x[some][:, hit].T @ back
            done += 1
    model = Model(langs, embed @ layer, bias)
    z = model.logits(x[held])
    if len(z):
        grid = np.geomspace(0.25, 8, 41)
        nll = [-np.log(softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(nll))])
        model.least = min(0.5, float(np.quantile(softmax(z / model.temperature).max(axis=1), rejected)))
    return model


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4000,
        buckets: int = 4096, **options) -> Model:
    """A model from at most ``sample_rows`` different labelled texts.

    The sample is the texts with the smallest hash of text and label, so it is
    spread over the whole table and does not depend on its order; rows that
    repeat count once. Rows with a null label or a text without letters teach
    nothing. What reaches the driver is n-gram counts, at most ``buckets`` a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SHARES) for b in batches for at in range(0, b.num_rows, SHARES)):
            kept = [(h, lang, text) for h, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
                    if has_letter(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.string()),
                 pa.array([average(k[2], buckets).astype(np.float32).tobytes() for k in kept], pa.binary())],
                names=["h", "lang", "x"])

    workers_ready(labelled.sparkSession)
    rows = labelled.select(F.xxhash64(F.col(text_col), F.col(lang_col)).alias("h"), F.col(text_col).alias("text"),
                           F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    last = rows.select("h").distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if last is None:
        return Model([], np.zeros((buckets, 0)), np.zeros(0))
    sample = (rows.where(F.col("h") <= last).mapInArrow(run, "h long, lang string, x binary")
              .groupBy("h").agg(F.min("lang").alias("lang"), F.min("x").alias("x")).orderBy("h").toArrow())
    if not sample.num_rows:
        return Model([], np.zeros((buckets, 0)), np.zeros(0))
    x = np.stack([np.frombuffer(v, np.float32) for v in sample["x"].to_pylist()])
    return train(x, sample["lang"].to_pylist(), **options)


def predictor(spark, model: Model):
    """A column function: text to struct(lang string, score double, rejected boolean)."""
    workers_ready(spark)

    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang", "score", "rejected"])

    return F.pandas_udf(run, T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                                         T.StructField("rejected", T.BooleanType())]))


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred",
             score_col: str = "score", rejected_col: str = "rejected") -> DataFrame:
    """``docs`` with each whole text's language, calibrated confidence (0 to 1) and whether it is rejected.

    Null text or one without a letter: ``und``, score 0, rejected; so is every
    text under a model that has learned nothing. Columns of ``docs`` that have
    these names are replaced."""
    found = predictor(docs.sparkSession, model)(F.col(text_col).cast("string"))
    name = "found"
    while name in docs.columns:
        name += "_"
    return (docs.withColumn(name, found).withColumn(lang_col, F.col(name)["lang"])
            .withColumn(score_col, F.col(name)["score"]).withColumn(rejected_col, F.col(name)["rejected"]).drop(name))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose language the model rejects."""
    found = predictor(docs.sparkSession, model)(F.col(text_col).cast("string"))
    return docs.where(~found["rejected"])


