import os
import re

from pyspark.sql import functions as F

from docspark.plans.ingest import preprocess
from docspark.registry import Registry
from docspark.sources import files as S
from docspark.sources import paths as P


def make_folder(root):
    def w(rel, data, mode="w"):
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, mode) as f:
            f.write(data)
    w("a.txt", "plain text\n")
    w("sub/b.md", "# Title\n## Part\nbody\n")
    w("sub/c.MD", "upper ext\n")
    w("deep/x/d.html", "<h1>H</h1><p>para</p><script>bad()</script>")
    w("e.htm", "<p>no header</p>")
    w("f.csv", 'name,note\nann,"line1\nline2"\nbob\ncarl,x,extra\n')
    w("g.json", '{"k": {"a": 1}}')
    w("h.json", "not json")
    w("i.exe", "MZ")
    w("bad.txt", b"\xff\xfe\xfa", "wb")
    w("empty.txt", "")
    w("with blank.txt", "blank name")
    w(".hidden.txt", "a name like any other")
    w("_under.txt", "a name like any other")


def test_scan_and_supported(spark, scratch):
    make_folder(scratch)
    files = S.scan_files(spark, [scratch, os.path.join(scratch, "missing")])
    names = sorted(os.path.basename(r.path) for r in files.select("path").collect())
    assert ".hidden.txt" in names and "_under.txt" in names
    assert "with blank.txt" in names and "i.exe" in names
    sup = sorted(os.path.basename(r.path) for r in S.supported_files(files).select("path").collect())
    assert "i.exe" not in sup and "c.MD" in sup
    flat = S.scan_files(spark, [scratch], recursive=False)
    assert all(os.path.dirname(r.path) == scratch for r in flat.select("path").collect())


def test_load_route_and_rejects(spark, scratch):
    make_folder(scratch)
    docs, rejects = S.load_documents(spark, [scratch])
    rows = {os.path.basename(r.source): r for r in docs.collect() if r.row is None}
    assert rows["a.txt"].text == "plain text\n" and rows["a.txt"].file_ext == ".txt"
    assert rows["c.MD"].file_ext == ".md"
    assert rows["g.json"].json_value is not None and rows["h.json"].json_value is None
    csv_rows = sorted((r.row, r.text) for r in docs.where(F.col("row").isNotNull()).collect())
    assert csv_rows == [(0, "name: ann\nnote: line1\nline2"), (1, "name: bob\nnote: None"),
                        (2, "name: carl\nnote: x\nNone: extra")]
    rej = [os.path.basename(r.source) for r in rejects.collect()]
    assert rej == ["bad.txt"]
    assert rows["a.txt"].file_size == len("plain text\n")
    assert isinstance(rows["a.txt"].file_mtime, int)


def test_preprocess_files_end_to_end(spark, scratch):
    make_folder(scratch)
    docs, _ = S.load_documents(spark, [scratch])
    ch = preprocess(docs)
    by = {}
    for r in ch.collect():
        by.setdefault(os.path.basename(r.source), []).append(r)
    assert "empty.txt" not in by and "bad.txt" not in by and "i.exe" not in by
    md = by["b.md"][0]
    assert (md.h1, md.h2, md.text) == ("Title", "Part", "body")
    html = by["d.html"][0]
    assert html.h1 == "H" and "bad()" not in html.text
    csv = sorted(by["f.csv"], key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in csv] == [0, 1, 2]
    assert [r.text.split("\n")[0] for r in csv] == ["name: ann", "name: bob", "name: carl"]   # row order
    assert by["a.txt"][0].citation == "a.txt#chunk0"


def test_registry_overrides(spark, scratch):
    make_folder(scratch)
    reg = Registry()
    reg.register_loader(".EXE", lambda f: f.select(F.col("path").alias("source"),
                                                   F.lit("exe body").alias("text")))
    reg.register_chunker(".txt", lambda texts: [[t.upper()] for t in texts])
    docs, _ = S.load_documents(spark, [scratch], loaders=reg.loaders, only_supported=False)
    ch = {os.path.basename(r.source): r.text for r in preprocess(docs, registry=reg).collect()}
    assert ch["i.exe"] == "exe body"
    assert ch["a.txt"] == "PLAIN TEXT"


HOSTILE = ["a[1].txt", "{x}.txt", "star*.txt", "what?.txt", "_draft.md", ".note.txt", "50%.txt", "a%20b.txt", "two  blanks .txt", "ü.txt", "back\\slash.txt",
           "_dir/in.txt", ".dir/in.txt", "[d]/in.txt", "x=1/in.txt", "new\nline.txt"]


def test_names_are_taken_as_they_are(spark, scratch):
    for n in HOSTILE:
        os.makedirs(os.path.dirname(f"{scratch}/{n}") or scratch, exist_ok=True)
        with open(f"{scratch}/{n}", "w") as f:
            f.write(f"text of {n}")
    os.symlink(scratch, f"{scratch}/_dir/loop")
    want = sorted(f"{scratch}/{n}" for n in HOSTILE)
    for entries in (100_000, 1):                       # one round, and a round a folder
        got = P.list_files(spark, [scratch], entries=entries).collect()
        assert sorted(r.path for r in got) == want
    assert sorted(r.path for r in P.list_files(spark, [f"{scratch}/a[1].txt", f"file://{scratch}/[d]", f"{scratch}/none"]).collect()) == [
        f"{scratch}/[d]/in.txt", f"{scratch}/a[1].txt"]
    docs, rejects = S.load_documents(spark, [scratch])
    assert {r.source: r.text for r in docs.collect()} == {f"{scratch}/{n}": f"text of {n}" for n in HOSTILE} and rejects.count() == 0
    for r in got:
        st = os.stat(r.path)
        assert r.length == st.st_size and int(r.modificationTime.timestamp()) == int(st.st_mtime)


def test_unreadable_files_are_rejects(spark, scratch):
    for n in ("a.txt", "gone.txt", "b.json"):
        with open(f"{scratch}/{n}", "w") as f:
            f.write("{}")
    listing = P.list_files(spark, [scratch])
    os.remove(f"{scratch}/gone.txt")
    docs, rejects = S.load_documents(spark, files=listing)
    assert sorted(os.path.basename(r.source) for r in docs.collect()) == ["a.txt", "b.json"]
    assert [(os.path.basename(r.source), r.error_type) for r in rejects.collect()] == [("gone.txt", "FileNotFoundError")]
    hashes = {os.path.basename(r.path): r.sha256 for r in P.hash_files(listing).collect()}
    import hashlib
    assert hashes == {"a.txt": hashlib.sha256(b"{}").hexdigest(), "b.json": hashlib.sha256(b"{}").hexdigest(), "gone.txt": None}


def test_scan_query_counts_the_bytes_it_reads(spark, scratch, monkeypatch):
    from docspark.plans import queries
    spark.createDataFrame([(1, "one"), (2, ""), (3, "d\u00e9j\u00e0"), (4, None)], "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    listed = P.list_files
    monkeypatch.setattr(S, "list_files", lambda *a, **k: listed(*a, **k).withColumn("length", F.lit(0).cast("bigint")))
    assert sorted(map(tuple, queries.scan_files(spark, scratch).collect())) == [(1, 4), (2, 1), (3, 7), (4, 1)]


def test_many_large_files_go_in_small_batches(spark, scratch, monkeypatch):
    for i in range(40):
        with open(f"{scratch}/{i}.txt", "w") as f:
            f.write(str(i % 10) * 700_000)
    got = P.read_files(P.list_files(spark, [scratch])).select("path", F.length("content").alias("n"), F.sha2("content", 256).alias("h")).collect()
    assert len(got) == 40 and {r.n for r in got} == {700_000} and len({r.h for r in got}) == 10


def test_no_file_list_on_the_driver():
    """The job hands tables of paths to its tasks; it collects nothing but bucket numbers."""
    import inspect

    from docspark.plans import sync
    source = inspect.getsource(sync.sync_once)
    assert "toLocalIterator" not in source and "toPandas" not in source and source.count(".collect()") == 1


def test_ship_package_once(spark):
    from docspark import session as SS
    SS.ship_package(spark)
    SS.ship_package(spark)                           # idempotent per application
    assert spark.sparkContext.applicationId in SS._SHIPPED
    from pyspark.sql import functions as F
    import pandas as pd

    @F.pandas_udf("string")
    def where_from(s: pd.Series) -> pd.Series:
        import docspark
        return s.map(lambda _: "ok" if docspark.__name__ == "docspark" else "no")
    assert spark.range(2).select(where_from(F.col("id").cast("string")).alias("x")).first().x == "ok"


def test_documents_folder_is_written_by_tasks_into_few_folders(spark, scratch):
    """A file a document, thousands of them a folder, and nothing else: the driver commits no folder a document."""
    from docspark.plans import fixtures as X
    rows = [(i, f"text {i}\nä") for i in range(300)] + [(7, "again"), (9, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{scratch}/documents.parquet")
    for bad, name in ((False, "plain"), (True, "bad")):
        root = X.documents_folder(spark, scratch, bad_utf8=bad)
        found = {os.path.join(d, f) for d, _, files in os.walk(root) for f in files}
        assert len(found) == 300 and len({os.path.dirname(f) for f in found}) <= 2, name
        held = {int(re.search(r"doc_id=(\d+)\.txt$", f)[1]): open(f, "rb").read() for f in found}
        end = lambda i: b"\xff" if bad and i % 17 == 0 else b""
        assert held[7] == b"again\n" + "text 7\nä\n".encode() and held[9] == b"\n" + "text 9\nä\n".encode()
        assert all(held[i] == f"text {i}\nä".encode() + end(i) + b"\n" for i in range(300) if i not in (7, 9))
    assert X.documents_folder(spark, scratch, bad_utf8=True) == root
    assert {f.name for f in os.scandir(os.path.dirname(root)) if f.is_dir()} == {"files", "files_bad_utf8"}


def test_written_files_do_not_mind_a_second_attempt(spark, scratch):
    from docspark.sources.paths import list_files, write_files
    rows = spark.createDataFrame([("a/x.txt", b"1"), ("a/y.txt", b""), ("b.txt", b"3")], "path string, content binary")
    for _ in range(2):
        assert write_files(rows, f"{scratch}/out") == 3
    got = {r.path[len(scratch) + 5:]: r.length for r in list_files(spark, [f"{scratch}/out"]).collect()}
    assert got == {"a/x.txt": 1, "a/y.txt": 0, "b.txt": 1} and os.listdir(scratch) == ["out"]
