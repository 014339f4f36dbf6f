import random

from conftest import SF01
from docspark.llm import licenses, queries

MIT = licenses.TEMPLATES["MIT"][2]
SCHEMA = "doc_id long, text string, start string, license int"


def scanned(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], SCHEMA)
    return sorted(licenses.scan_licenses(df, **options).collect(), key=lambda r: (str(r.doc_id), r.start))


def test_cases(spark):
    filler = "words of a quite unrelated story that goes on and on. " * 300
    wrapped = MIT.replace("any person", "any\nperson").replace("documentation", "\n  documentation")
    rows = [
        (1, "text\nLicensed under CC BY-NC 4.0.\nmore"), (2, "Licensed under CC BY 4.0."), (3, "licensed under the apache license version 2.0"),
        (4, "This work is licensed under the GNU General Public License, version 3."), (5, "This work is licensed under the GNU General Public License, version 2."),
        (6, "This work is licensed under the GNU General Public License, version 4."), (7, "a\n\n" + wrapped + ".\n\nb"),
        (8, filler + "Released under the MIT License. " + filler), (9, "Copyright 2024 Jane Roe and others. All rights reserved."),
        (10, "he released the dog under the bridge; MIT gave no license"), (11, "my driving licence is old, permission denied"), (12, None), (13, ""),
        (14, "All rights reserved.\nReleased under the MIT License."), (15, "Released under the\nMIT License."), (None, "Released under the MIT License."),
        (16, "Released under the MIT License."), (16, "Released under the MIT License."), (17, "İ " * 50 + "\nReleased under the MIT License.")]
    got = scanned(spark, rows)
    assert [(str(r.doc_id), r.license) for r in got] == sorted([
        ("1", "CC-BY-NC-4.0"), ("2", "CC-BY-4.0"), ("3", "Apache-2.0"), ("4", "GPL-3.0"), ("5", "GPL-2.0"), ("7", "MIT"), ("8", "MIT"),
        ("9", "all-rights-reserved"), ("14", "all-rights-reserved"), ("14", "MIT"), ("15", "MIT"), ("None", "MIT"), ("16", "MIT"), ("16", "MIT"), ("17", "MIT")],
        key=lambda x: x[0]) or [(str(r.doc_id), r.license) for r in got]
    texts = {d: t for d, t in rows}
    for r in got:
        assert r.exact and r.saved_bytes > 0
        said = [m.lower() for m in licenses._WORD.findall(texts[r.doc_id][r.start:r.end])]
        want = [w for w in licenses.template_words(r.template) if w]
        assert said[:1] == want[:1] and said[-1] == want[-1]
    assert scanned(spark, []) == []


def test_differences():
    fixed = licenses.template_words("Copyright <year>. All rights reserved.")
    assert licenses.differences(fixed, "so copyright 2020 x y all rights reserved now".split()) == ([], [], (1, 8))
    assert licenses.differences(fixed, "copyright all rights held".split())[0] == ["reserved"]
    assert licenses.differences(["mit", "license"], "mit expat license".split())[1] == ["expat"]


def test_rank_prefers_the_own_template():
    scanner = licenses.Scanner(licenses.TEMPLATES, 5)
    for i, (_, _, fixed) in enumerate(scanner.known):
        said = [w or "2024" for w in fixed]
        top = scanner.rank(said)
        assert i in [j for _, j in top[:3]]


def test_the_rank_decides(spark, monkeypatch):
    """Of two notices that begin alike the one that saves more wins; with the ranks reversed it does not."""
    header = ("/* Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
              "compliance with the License. */")
    long = licenses.TEMPLATES["Apache-2.0"][1]
    assert [r.template for r in scanned(spark, [(1, header)])] == [long]
    own = licenses.Scanner.rank
    words = [m.lower() for m in licenses._WORD.findall(header)]
    assert licenses.Scanner(licenses.TEMPLATES).match(words)[3] == long
    monkeypatch.setattr(licenses.Scanner, "rank", lambda self, said: own(self, said)[::-1])
    assert licenses.Scanner(licenses.TEMPLATES).match(words)[3] != long


def test_versions_are_told_apart(spark):
    gpl = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
           "License as published by the Free Software Foundation, either version %d of the License, or (at your option) any later version.")
    got = scanned(spark, [(n, "story\n" + gpl % n + "\nstory") for n in (2, 3, 4)])
    assert [(r.doc_id, r.license, r.exact) for r in got] == [(2, "GPL-2.0", True), (3, "GPL-3.0", True)]


def test_rank_of_the_own_template_on_varied_text(spark):
    rng = random.Random(11)
    said = sorted({w.lower() for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(100).collect()
                   for w in licenses._WORD.findall(r.text or "")})
    scanner = licenses.Scanner(licenses.TEMPLATES)
    places = []
    for i, (_, _, fixed) in enumerate(scanner.known):
        for _ in range(20):
            around = rng.choices(said, k=2 * scanner.longest)
            cut = rng.randrange(len(around))
            window = around[:cut] + [w or "2024" for w in fixed] + around[cut:]
            places.append([j for _, j in scanner.rank(window)].index(i))
    assert sum(p == 0 for p in places) >= 0.8 * len(places), places


def brute(text):
    """Notices by plain search of their words, line by line."""
    out = []
    for line in text.split("\n"):
        said = " ".join(licenses._WORD.findall(line.lower()))
        for name, texts in licenses.TEMPLATES.items():
            for t in texts:
                if "<" not in t and f" {' '.join(licenses.template_words(t))} " in f" {said} ":
                    out.append(name)
    return sorted(out)


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = {}
    for r in queries.QUERIES["op9_license_scan"](spark, SF01).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    want = {d: b for d, t in docs.items() if (b := brute(t or ""))}
    assert len(want) > 10 and {d: sorted(v) for d, v in got.items()} == want


def test_long_lines_are_covered(spark):
    rng = random.Random(1)
    parts = [" ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 900))) for _ in range(20)]
    text = " Licensed under the MIT License. ".join(parts)
    assert len(scanned(spark, [(1, text)])) == 19


def test_notices_in_long_varied_lines(spark):
    rng = random.Random(5)
    said = sorted({w for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(200).collect() for w in (r.text or "").split()
                   if w.isalpha() and not any(cue in w.lower() for cue in ("licen", "rights", "permission", "redistribution", "copyright"))})
    names = [(n, t.replace("<year and holder>", "2024 Jane Roe")) for n, texts in licenses.TEMPLATES.items() for t in texts]
    rows = []
    for size in (300, 1500, 3000, 3900, 9000):
        for n, t in names:
            filler = " ".join(rng.choices(said, k=size // 6))
            cut = rng.randrange(len(filler))
            rows.append((len(rows), f"{filler[:cut]} {t} {filler[cut:]}", n))
    got = scanned(spark, [r[:2] for r in rows])
    assert [(r.doc_id, r.license) for r in got] == sorted([(d, n) for d, _, n in rows], key=lambda r: str(r[0]))
    assert all(r.exact for r in got)


def test_notices_side_by_side(spark):
    texts = [t.replace("<year and holder>", "2024 Jane Roe") for ts in licenses.TEMPLATES.values() for t in ts]
    got = scanned(spark, [(1, " and so ".join(texts * 3)), (2, "copyright " + "law " * 13 + "all rights reserved. Copyright 2020 X. All rights reserved.")])
    assert [r.doc_id for r in got] == [1] * 3 * len(texts) + [2, 2]
