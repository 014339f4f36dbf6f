import random
import re

import pytest

from conftest import SF01
from docspark.llm import decontaminate as D
from docspark.llm import queries

DOCS = "doc_id long, text string, item_id string, h string, pos int"
ITEM = ("Yesterday the baker told young Tomas that 12 loaves weigh 30 kg, and that Tomas could carry "
        "12 loaves across the old bridge for 4.5 dollars a day.")
PLAIN = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa"


def items(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, PLAIN, "x"), (3, "one short item only here", "x"), (4, "tiny item", "x"), (5, None, "x"),
                                  (6, "", "x"), (2, PLAIN, "x"), (7, "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "x")], "item_id long, text string, pos string")


def found(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "c", "c", 1) for d, t in rows], DOCS)
    return {(r.doc_id, r.item_id): r for r in D.find_contamination(df, items(spark), **options).collect()}


def test_cases(spark):
    swapped = ITEM.replace("Tomas", "Elena").replace("12", "77").replace("30", "31").replace("4.5", "9,25").replace("kg", "lb").replace("dollars", "euros")
    mixed = swapped.replace("Elena could", "Boris could").replace("77 loaves across", "78 loaves across")
    words = PLAIN.split()
    rows = [
        (1, "Before it. " + ITEM + " After it."), (2, swapped), (3, mixed), (4, ITEM.lower()), (5, ITEM.upper()),
        (6, re.sub(r"[ ,.]+", lambda m: " \n" if "." in m.group() else " ", ITEM.replace("4.5", "4;5"))),
        (10, "x " * 500 + PLAIN.replace(" ", "\t\n  ") + " y" * 500), (11, " ".join(words[:12])), (12, " ".join(words[2:15])),
        (13, " ".join(words[:8] + ["zulu"] + words[9:])), (14, " ".join(words[:7] + ["zulu"] + words[8:])),
        (15, " ".join(words[:8]) + " filler " + " ".join(words[8:])),
        (20, "say: one, short ITEM only here!"), (21, "one short item only"), (22, "tiny item"), (23, None), (24, ""), (25, "..."),
        (26, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (None, PLAIN), (30, PLAIN), (30, PLAIN), (31, PLAIN), (31, "clean words")]
    got = found(spark, rows)
    assert set(got) == {(1, 1), (2, 1), (4, 1), (5, 1), (6, 1), (10, 2), (12, 2), (15, 2), (20, 3), (None, 2), (30, 2), (31, 2)}
    assert got[2, 1].changed_slots and not got[1, 1].changed_slots and not got[4, 1].changed_slots
    assert got[1, 1].covered_words == got[1, 1].item_words and got[12, 2].covered_words == 13
    assert set(found(spark, rows, broadcast_rows=0)) == set(got)


def test_filter_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, PLAIN, "a", "b", 1), (1, "clean", "a", "b", 2), (2, None, "a", "b", 3), (None, "clean", "a", "b", 4),
                                (None, PLAIN, "a", "b", 5), (3, "clean", "a", "b", 6), (3, "clean", "a", "b", 6)], DOCS)
    out = D.decontaminate(df, items(spark))
    assert out.columns == df.columns
    assert sorted(r.pos for r in out.collect()) == [2, 3, 4, 6, 6]
    assert D.decontaminate(df.limit(0), items(spark)).count() == 0
    assert D.decontaminate(df, items(spark).limit(0)).count() == 7


def brute(docs, bench, window=8, overlap=13):
    """Plain texts without numbers or names inside sentences: covered words of equal runs."""
    def toks(t):
        return re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    index = {}
    for i, t in bench:
        w = toks(t)
        for k in range(len(w) - window + 1):
            index.setdefault(tuple(w[k:k + window]), []).append((i, k))
    out = set()
    size = {i: len(toks(t)) for i, t in bench}
    for d, t in docs:
        w, cover = toks(t), {}
        for k in range(len(w) - window + 1):
            for i, p in index.get(tuple(w[k:k + window]), ()):
                cover.setdefault(i, set()).update(range(p, p + window))
        out |= {(d, i) for i, c in cover.items() if len(c) >= min(overlap, size[i])}
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    df = queries.QUERIES["op4_benchmark_contamination"](spark, SF01)
    got = {(r.doc_id, r.item_id) for r in df.collect()}
    want = brute(docs, bench)
    assert len(want) > 3 and got == want


def test_native_plan(spark):
    plan = queries.QUERIES["op4_benchmark_contamination"](spark, SF01)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_random_slots(spark, seed):
    rng = random.Random(seed)
    base = ["the shop sold {a} pens and {b} cups to {n} while {n} kept {a} pens for the other {b} guests of town"]
    rows, want = [], set()
    for d in range(30):
        a, b, n = rng.choice(["3", "44"]), rng.choice(["5", "6.5"]), rng.choice(["Ada", "Bob"])
        t = base[0].format(a=a, b=b, n=n)
        if rng.random() < 0.4:
            t = t.replace(f"{a} pens for", "999 pens for")
        else:
            want.add(d)
        rows.append((d, t))
    bench = spark.createDataFrame([(1, base[0].format(a="12", b="9", n="Tim"))], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in D.find_contamination(df, bench).collect()} == want


def test_verbatim_runs_rich_in_slots(spark):
    train, pack = "A train goes 60 km in 2 hours, then 90 km in 3 hours", "Add 3 kg, 5 kg and 12 lb of rice"
    bench = spark.createDataFrame([(1, train), (2, pack), (3, "Walk 5 km in 2 hours")], "item_id long, text string")
    rows = [(1, f"We read: {train}. And more."), (2, train.upper()), (3, train.replace("90", "91")), (4, train.replace("60", "61").replace("90", "91")),
            (5, f"Now {pack.lower()} to it"), (6, pack.replace("12", "13")), (7, "they walk 5 km in 2 hours a day"), (8, "they walk 6 km in 2 hours a day")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, 1), (2, 1), (5, 2), (7, 3)}
    for options in ({}, {"broadcast_rows": 0}):
        got = D.find_contamination(df, bench, **options).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert all(r.covered_words == r.item_words and not r.changed_slots for r in got)


def test_verbatim_runs_beside_an_inconsistent_slot(spark):
    item = ("the small ferry takes 40 guests over the calm lake each morning before the first bell of town "
            "rings and 40 guests back when it is dark again")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    swapped = item.replace("40", "55")
    rows = [(1, item), (2, item[::-1].replace("04", "14", 1)[::-1]), (3, item.replace("40", "41", 1)), (4, swapped), (5, swapped.replace("55", "56", 1)),
            (6, "the small ferry takes 41 guests over the calm lake till noon or so one old red kite rings and 42 guests back when it is dark again")]
    got = {r.doc_id: r for r in D.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert not got[1].changed_slots and got[2].changed_slots and got[4].changed_slots
    assert got[1].covered_words == got[4].covered_words == got[1].item_words > got[5].covered_words


def test_verbatim_runs_beside_a_repeated_unit(spark):
    item = "the road is 7 km long and after it the tired old driver still has to go on through the dark forest for 9 km"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, item[:-2] + "miles")], "doc_id long, text string")
    assert [r.doc_id for r in D.find_contamination(df, bench).collect()] == [1]
