import json

from docspark.operators import sections as P


def markdown(spark, *texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = sorted(P.markdown_sections(df, **how).collect(), key=lambda r: (r.id, r.section))
    return [[(r.h1, r.h2, r.h3, r.h4, r.text) for r in rows if r.id == i] for i in range(len(texts))]


def test_markdown_goldens(spark):
    got = markdown(
        spark, "# A\nintro\n## B\nb1\n\nb2\n### C\nc\n## D\nd\n# E\ne",
        "# T\n## Empty\n## S\nx\n```\n# not\n\n```\n#####  deep\n#nospace",
        "# T\n## S\na\n## S\nb", "", "\n \n", "plain\n\n\n  text ", "# only a header", "~~~\n# code\nopen to the end\n\n",
        "```inline``` is no fence\n# H\nx", "#\nempty name", "a\u200bb\u00a0c\n\t# T \nx", "```\n~~~\n# in\n```\n# out\ny", None)
    assert got == [
        [("A", None, None, None, "intro"), ("A", "B", None, None, "b1  \nb2"), ("A", "B", "C", None, "c"), ("A", "D", None, None, "d"),
         ("E", None, None, None, "e")],
        [("T", "S", None, None, "x\n```\n# not\n\n```\n#####  deep\n#nospace")],
        [("T", "S", None, None, "a  \nb")], [], [], [(None, None, None, None, "plain  \ntext")], [],
        [(None, None, None, None, "~~~\n# code\nopen to the end\n\n")],
        [(None, None, None, None, "```inline``` is no fence"), ("H", None, None, None, "x")], [("", None, None, None, "empty name")],
        [(None, None, None, None, "abc"), ("T", None, None, None, "x")],
        [(None, None, None, None, "```\n~~~\n# in\n```"), ("out", None, None, None, "y")], []]
    assert markdown(spark, "# A\nx", strip_headers=False) == [[("A", None, None, None, "# A\nx")]]


def test_markdown_is_native_and_narrow(spark):
    df = spark.createDataFrame([(1, "# A")], "id int, text string")
    plan = P.markdown_sections(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_html_sections_scoped():
    html = ("<html><head><title>t</title><style>p{}</style><script>var x='<h1>no</h1>';</script></head>"
            "<body><p>pre</p><h1>One &amp; only</h1><p>a</p><h2>Two</h2><p>b</p><div>c</div>"
            "<h1>Three</h1><p>d</p></body></html>")
    out = P.html_sections_of(html)
    assert out == [
        {"h1": None, "h2": None, "h3": None, "h4": None, "text": "pre"},
        {"h1": "One & only", "h2": None, "h3": None, "h4": None, "text": "a"},
        {"h1": "One & only", "h2": "Two", "h3": None, "h4": None, "text": "b  \nc"},
        {"h1": "Three", "h2": None, "h3": None, "h4": None, "text": "d"},
    ]


def test_html_omitted_tags():
    def texts(html):
        return [(o["h1"], o["text"]) for o in P.html_sections_of(html)]
    assert texts("<head><title>t</title><p>a<p>b") == [(None, "a  \nb")]
    assert texts("<html><head><meta charset=x><title>t<body>a") == [(None, "a")]
    assert texts("<h1>One<p>a<h1>Two</h1>b") == [("One", "a"), ("Two", "b")]
    assert texts("<h1>open to the end") == [] and texts("x<script>var a='<p>'") == [(None, "x")]
    assert texts("<noscript>no</noscript><style>p{}</style>y") == [(None, "no  \ny")] and texts("") == []
    assert texts("<body>a<noscript>b<p>c") == [(None, "a  \nb  \nc")]                       # unclosed: the page goes on
    assert texts("<head><noscript><link rel=x></noscript><title>t</title></head><body>x") == [(None, "x")]


def test_html_each_element():
    out = P.html_sections_of("<h1>H</h1><p>a</p><p>b</p>", each_element=True)
    assert [o["text"] for o in out] == ["a", "b"]


def test_json_split_pieces():
    obj = {"a": {"x": "1" * 40, "y": "2" * 40}, "b": [1, 2, 3], "c": "é"}
    pieces = P.json_pieces(obj, 60, least=10)
    assert all(isinstance(json.loads(p), dict) for p in pieces)
    merged = {}
    for p in pieces:
        d = json.loads(p)
        for k, v in d.items():
            if isinstance(v, dict):
                merged.setdefault(k, {}).update(v)
            else:
                merged[k] = v
    assert merged == obj
    assert any("é" in p for p in pieces)                  # not ASCII-escaped
    conv = P.json_pieces({"l": [1, 2]}, convert_lists=True)
    assert json.loads(conv[0]) == {"l": {"0": 1, "1": 2}}


def test_json_non_object_kept_whole(spark):
    df = spark.createDataFrame([("kb/a.json", "[1,2]", ".json"), ("kb/b.json", "{bad", ".json"),
                                ("kb/c.json", '{"k": 1}', ".json")], "source string, text string, file_ext string")
    rows = sorted((r.source, r.text) for r in P.structure_split(df).collect())
    assert rows == [("kb/a.json", "[1,2]"), ("kb/b.json", "{bad"), ("kb/c.json", '{"k": 1}')]


def test_structure_split_off_switch_and_passthrough(spark):
    df = spark.createDataFrame([("a.md", "# H\nx", ".md"), ("b.txt", "# H\nx", ".txt")],
                               "source string, text string, file_ext string")
    on = {r.source: (r.h1, r.text) for r in P.structure_split(df).collect()}
    assert on == {"a.md": ("H", "x"), "b.txt": (None, "# H\nx")}
    off = {r.source: (r.h1, r.text) for r in
           P.structure_split(df, kinds=("html", "json")).collect()}
    assert off == {"a.md": (None, "# H\nx"), "b.txt": (None, "# H\nx")}


def test_section_metadata_override(spark):
    df = spark.createDataFrame([("a.md", "# H\nx", ".md", "doc-h1", "doc-h3")],
                               "source string, text string, file_ext string, h1 string, h3 string")
    r = P.structure_split(df).collect()[0]
    assert (r.h1, r.h3) == ("H", "doc-h3")


def test_markdown_with_many_headings(spark):
    """The fold goes block by block: paths, merges and order hold over the blocks' borders."""
    import random

    from pyspark.sql import functions as F

    from docspark.operators import sections as P
    rng = random.Random(5)
    lines, want, path = [], [], {}
    for i in range(1500):
        level = rng.choice([1, 2, 2, 3, 4, 4, 5])
        if level <= 4 and rng.random() < 0.8:
            name = f"h{rng.randrange(3)}"
            path = {k: v for k, v in path.items() if k < level} | {level: name}
            lines.append(f"{'#' * level} {name}")
        if rng.random() < 0.7:
            lines += [f"text {i}", ""]
            key = tuple(path.get(k) for k in range(1, 5))
            if want and want[-1][0] == key:
                want[-1][1].append(f"text {i}")
            else:
                want.append((key, [f"text {i}"]))
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "# only\n")], "id int, text string")
    got = {r.id: r.s for r in df.select("id", P.markdown_column(F.col("text")).alias("s")).collect()}
    assert len(want) > 2 * P._BLOCK_PIECES and got[2] == [] and got[3] == []
    assert [((s.h1, s.h2, s.h3, s.h4), s.text) for s in got[1]] == [(k, "  \n".join(t)) for k, t in want]
