import random
import zlib

import numpy as np

from conftest import SF01
from docspark.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string, score string, found int, rejected string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 1, "clash") for i, t, lang in rows], SCHEMA)


def made(n=200):
    rng = random.Random(0)
    parts = {"en": ["the", "and", "ing", "tion", "wh"], "de": ["der", "sch", "ung", "ich", "über"], "fr": ["eau", "que", "ément", "les", "é"]}
    return [(i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(rng.randint(3, 60))), lang)
            for i in range(n) for lang in [rng.choice(list(parts))]]


def test_learns_and_rejects(spark):
    rows = made()
    model = langid.fit(frame(spark, rows))
    fresh = [(i, t, lang) for i, t, lang in made(260)[200:]] + [(900, None, "en"), (901, "", None), (902, "12 345 !?", "fr"), (903, "wh" * 700_000, None)]
    out = langid.identify(frame(spark, fresh), model)
    assert out.columns == ["doc_id", "text", "lang", "score", "found", "rejected", "lang_pred"]
    got = {r.doc_id: r for r in out.collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in fresh[:60]]) > 0.97
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[903].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(frame(spark, fresh), model)
    assert kept.columns == ["doc_id", "text", "lang", "score", "found", "rejected"]
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {900, 901, 902} and len(ids) >= 58


def test_sample_bound_and_repeats(spark):
    rows = made(100) * 3 + [(1000, None, "en"), (1001, "text", None), (1002, "...", "fr")]
    seen = []
    real = langid.train
    langid.train = lambda x, labels, **o: seen.append(len(labels)) or real(x, labels, epochs=1, **o)
    try:
        langid.fit(frame(spark, rows))
        langid.fit(frame(spark, rows), sample_rows=30)
    finally:
        langid.train = real
    assert seen[0] == 100 and 28 <= seen[1] <= 30


def test_nothing_to_learn(spark):
    model = langid.fit(frame(spark, [(1, "x", None)]))
    assert [tuple(r)[-1] for r in langid.identify(frame(spark, [(1, "words", "en")]), model).collect()] == ["und"]
    assert langid.keep_identified(frame(spark, []), model).count() == 0
    one = langid.fit(frame(spark, [(1, "only english", "en")] * 3))
    assert langid.identify(frame(spark, [(1, "words", None)]), one).first().lang_pred == "en"


def test_chunks_cover_every_gram():
    rng = random.Random(1)
    text = "".join(rng.choices("abc é", k=5000))
    whole = np.sort(np.concatenate(list(langid.grams(text, 4096))))
    real = langid.CHUNK
    langid.CHUNK = 97
    try:
        cut = np.sort(np.concatenate(list(langid.grams(text, 4096))))
    finally:
        langid.CHUNK = real
    assert np.array_equal(whole, cut)


def test_prediction_is_of_averages(spark):
    rows = made(60)
    model = langid.fit(frame(spark, rows))
    for _, t, _ in rows[:10]:
        p = langid.softmax(model.logits(langid.average(t, 4096)) / model.temperature)
        lang, score, _ = model.predict(t)
        assert lang == model.langs[int(np.argmax(p))] and abs(score - p.max()) < 1e-6


def test_query_held_out_accuracy(spark):
    df = queries.QUERIES["op5_language_id"](spark, SF01)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = df.collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_shares_are_handed_on_in_small_batches(spark, monkeypatch):
    """A batch of shares, one row a text and 16 KB each, is bounded however many rows Spark sends at once."""
    import pyarrow as pa

    rows = spark.createDataFrame([("the cat", "en"), ("le chat", "fr")], "text string, lang string")
    frame, sizes = type(rows), []
    real = frame.mapInArrow

    def spied(self, run, schema):
        given = pa.RecordBatch.from_arrays([pa.array(range(950), pa.int64()), pa.array([f"some words {i}" for i in range(950)]),
                                            pa.array(["en"] * 950)], names=["h", "text", "lang"])
        sizes.extend((b.num_rows, b.nbytes) for b in run(iter([given])))
        return real(self, run, schema)

    monkeypatch.setattr(frame, "mapInArrow", spied)
    assert langid.fit(rows).langs == ["en", "fr"]
    assert sum(n for n, _ in sizes) == 950 and max(b for _, b in sizes) < 2 << 20
