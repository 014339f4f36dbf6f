import os
import time

from pyspark.sql import functions as F

from conftest import SF01
from docspark.operators import tables as TB
from docspark.plans import fixtures as X
from docspark.plans.queries import detect_changes
from docspark.plans.sync import sync_once


def test_expected_counts_sf001(spark):
    counts = {r.status: r.n for r in detect_changes(spark, SF01).groupBy("status")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"added": 100, "deleted": 100, "modified": 95, "unchanged": 705}


def test_classify_never_reads_content(spark, scratch):
    from docspark.operators import changes as D
    spark.createDataFrame([("a", 1, 1, b"x")], "source string, size bigint, mtime bigint, content binary") \
        .write.parquet(f"{scratch}/cur")
    cur = spark.read.parquet(f"{scratch}/cur")
    old = spark.createDataFrame([("a", 1, 2, None, 0)], "source string, size bigint, mtime bigint, sha256 string, updated_at bigint")
    plan = D.classify(cur, old)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:string,size:bigint,mtime:bigint>" in plan
    full = D.detect_changes(cur, old)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(content" in full                       # hashing happens only in the suspect branch


def _write(path, text, mtime=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    if mtime is not None:
        os.utime(path, (mtime, mtime))


def _tables(spark, root):
    files = TB.read_table(spark, root, "files", TB.FILES_SCHEMA)
    chunks = TB.read_table(spark, root, "chunks", TB.CHUNKS_SCHEMA)
    return ({r.source: (r.size, r.sha256) for r in files.collect()},
            sorted((r.source, r.chunk_id) for r in chunks.collect()))


def test_sync_cycle(spark, scratch):
    kb, tables = os.path.join(scratch, "kb"), os.path.join(scratch, "tables")
    _write(f"{kb}/a.txt", "alpha " * 300, 1_700_000_000)
    _write(f"{kb}/sub/b.md", "# T\n## S\nbeta text\n", 1_700_000_000)
    _write(f"{kb}/c.exe", "binary", 1_700_000_000)
    r1 = sync_once(spark, [kb], tables, now=1)
    assert r1.version == 1
    files1, chunks1 = _tables(spark, tables)
    assert sorted(os.path.basename(s) for s in files1) == ["a.txt", "b.md"]
    assert all(sha is None for _, sha in files1.values())        # added: stored without hash
    vec = TB.read_table(spark, tables, "vectors", TB.VECTORS_SCHEMA)
    assert vec.count() == len(chunks1)

    # nothing changed -> same tables (sync twice = no change)
    sync_once(spark, [kb], tables, now=2)
    assert _tables(spark, tables) == (files1, chunks1)

    # touch a.txt (same bytes, new mtime): suspect, no stored hash -> modified, hash stored
    _write(f"{kb}/a.txt", "alpha " * 300, 1_700_000_100)
    # edit b.md, delete nothing yet
    _write(f"{kb}/sub/b.md", "# T\n## S\nbeta changed\n", 1_700_000_200)
    r3 = sync_once(spark, [kb], tables, now=3)
    plan = {os.path.basename(r.source): r.action for r in r3.plan.collect()}
    assert plan == {"a.txt": "rebuild", "b.md": "rebuild"}
    files3, chunks3 = _tables(spark, tables)
    assert all(sha is not None for _, sha in files3.values())

    # touch again: suspect with the same stored hash -> unchanged, nothing rebuilt
    _write(f"{kb}/a.txt", "alpha " * 300, 1_700_000_300)
    r4 = sync_once(spark, [kb], tables, now=4, dry_run=True)
    assert r4.version is None and r4.plan.count() == 0

    os.remove(f"{kb}/sub/b.md")
    sync_once(spark, [kb], tables, now=5)
    files5, chunks5 = _tables(spark, tables)
    assert [os.path.basename(s) for s in files5] == ["a.txt"]
    assert all(s.endswith("a.txt") for s, _ in chunks5)
    vec = TB.read_table(spark, tables, "vectors", TB.VECTORS_SCHEMA)
    assert {r.id for r in vec.collect()} == {c for _, c in chunks5}


def test_failed_sync_keeps_old_snapshot(spark, scratch):
    kb, tables = os.path.join(scratch, "kb"), os.path.join(scratch, "tables")
    _write(f"{kb}/a.txt", "one two three", 1_700_000_000)
    sync_once(spark, [kb], tables, now=1)
    before = _tables(spark, tables)
    _write(f"{kb}/b.txt", "new file", 1_700_000_000)

    def broken(texts):
        raise RuntimeError("embedding service down")
    try:
        sync_once(spark, [kb], tables, now=2, embed_fn=broken)
        raise AssertionError("sync should fail")
    except Exception as e:
        assert "embedding service down" in str(e) or "RuntimeError" in str(e)
    assert TB.current_snapshot(spark, tables) == 1
    assert _tables(spark, tables) == before
    sync_once(spark, [kb], tables, now=3)                      # retry succeeds
    assert len(_tables(spark, tables)[0]) == 2


def test_crash_after_each_write_keeps_the_old_state(spark, scratch, monkeypatch):
    kb, tables = os.path.join(scratch, "kb"), os.path.join(scratch, "tables")
    _write(f"{kb}/a.txt", "one two three", 1_700_000_000)
    sync_once(spark, [kb], tables, now=1)
    before = _tables(spark, tables)
    vectors = sorted(r.id for r in TB.read_table(spark, tables, "vectors", TB.VECTORS_SCHEMA).collect())
    _write(f"{kb}/b.txt", "new file", 1_700_000_000)
    write, publish = TB.write_snapshot, TB.publish
    for dies_at in ("vectors", "chunks", "files", "publish"):
        def dying(df, root, name, n, dies_at=dies_at):
            write(df, root, name, n)
            if name == dies_at:
                raise RuntimeError("killed")

        def no_marker(*args):
            raise RuntimeError("killed")
        monkeypatch.setattr(TB, "write_snapshot", dying)
        monkeypatch.setattr(TB, "publish", no_marker if dies_at == "publish" else publish)
        try:
            sync_once(spark, [kb], tables, now=2)
            raise AssertionError("the sync should die")
        except RuntimeError:
            pass
        assert TB.current_snapshot(spark, tables) == 1 and _tables(spark, tables) == before
        assert sorted(r.id for r in TB.read_table(spark, tables, "vectors", TB.VECTORS_SCHEMA).collect()) == vectors
    monkeypatch.setattr(TB, "write_snapshot", write)
    monkeypatch.setattr(TB, "publish", publish)
    r = sync_once(spark, [kb], tables, now=3)
    assert r.version > 4 and len(_tables(spark, tables)[0]) == 2
    import pytest
    with pytest.raises(Exception):
        TB.publish(spark, tables, r.version)              # a marker is never written twice


def test_rejects_overlapping_roots_and_loaders(spark, scratch):
    from docspark.registry import Registry
    kb, tables = os.path.join(scratch, "kb"), os.path.join(scratch, "tables")
    _write(f"{kb}/sub/a.txt", "alpha text", 1_700_000_000)
    _write(f"{kb}/x.pdf", "MZ", 1_700_000_000)
    with open(f"{kb}/bad.txt", "wb") as f:
        f.write(b"\xff\xfe")
    reg = Registry()
    reg.register_loader(".pdf", lambda f: f.select(F.col("path").alias("source"), F.lit("from the pdf").alias("text")))
    r = sync_once(spark, [kb, f"{kb}/sub"], tables, now=1, registry=reg)
    files, chunks = _tables(spark, tables)
    assert sorted(os.path.basename(s) for s in files) == ["a.txt", "x.pdf"] and len(chunks) == 2
    assert [os.path.basename(x.source) for x in r.rejects.collect()] == ["bad.txt"]
    assert sorted(os.path.basename(x.source) for x in r.plan.collect()) == ["a.txt", "x.pdf"]
    _write(f"{kb}/bad.txt", "mended", 1_700_000_500)
    sync_once(spark, [kb], tables, now=2, registry=reg)
    assert len(_tables(spark, tables)[0]) == 3


def test_assign_and_validate_ids(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y")], "id string, text string")
    out = TB.assign_ids(df).checkpoint()          # materialise once: uuid() is random
    ids = [r.id for r in out.collect()]
    assert ids[0] == "a" and len(ids[1]) == 36
    assert [r.id for r in out.collect()] == ids
    import pytest
    with pytest.raises(Exception):
        TB.validate_columns(df).collect()
    with pytest.raises(Exception):
        TB.validate_columns(spark.createDataFrame([("a", "x"), ("a", "y")], "id string, text string")).collect()
    assert TB.validate_columns(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")).count() == 2


def test_delete_vectors_needs_ids_or_where(spark):
    import pytest
    v = spark.createDataFrame([("a", 1)], "id string, label int")
    with pytest.raises(ValueError):
        TB.delete_vectors(v)
    assert TB.delete_vectors(v, where={"label": 1}).count() == 0


def _buckets(tables, name):
    """{snapshot: its bucket folders} as they lie on disk."""
    root = os.path.join(tables, name)
    return {d: sorted(b for b in os.listdir(os.path.join(root, d)) if b.startswith(TB.BUCKET))
            for d in sorted(os.listdir(root))} if os.path.isdir(root) else {}


def test_one_changed_file_rewrites_one_bucket(spark, scratch):
    kb, tables = os.path.join(scratch, "kb"), os.path.join(scratch, "tables")
    for i in range(60):
        _write(f"{kb}/f{i}.txt", f"text number {i} " * 30, 1_700_000_000)
    sync_once(spark, [kb], tables, now=1, buckets=16)
    assert TB.bucket_count(spark, tables) == 16
    first = {name: _buckets(tables, name) for name in TB.TABLES}
    assert all(len(f["snapshot=1"]) > 10 for f in first.values())
    before = {r.source: r for r in TB.read_table(spark, tables, "files", TB.FILES_SCHEMA).collect()}
    _write(f"{kb}/f7.txt", "changed", 1_700_000_500)
    assert sync_once(spark, [kb], tables, now=2).version == 2
    for name in TB.TABLES:
        now = _buckets(tables, name)
        assert now["snapshot=1"] == first[name]["snapshot=1"] and len(now["snapshot=2"]) == 1
    after = {r.source: r for r in TB.read_table(spark, tables, "files", TB.FILES_SCHEMA).collect()}
    assert len(after) == 60 and {s for s in after if after[s] != before[s]} == {f"{kb}/f7.txt"}
    vec = TB.read_table(spark, tables, "vectors", TB.VECTORS_SCHEMA).collect()
    assert [r.text for r in vec if r.source.endswith("/f7.txt")] == ["changed"] and len({r.id for r in vec}) == len(vec) >= 60
    # the first snapshot is still whole
    assert TB.read_table(spark, tables, "files", TB.FILES_SCHEMA, n=1).count() == 60
    # nothing changed: a snapshot without a file of its own
    assert sync_once(spark, [kb], tables, now=3).version == 3 and "snapshot=3" not in _buckets(tables, "files")
    assert len(_tables(spark, tables)[0]) == 60


def test_expiry_keeps_what_kept_snapshots_name(spark, scratch):
    kb, tables = os.path.join(scratch, "kb"), os.path.join(scratch, "tables")
    for i in range(12):
        _write(f"{kb}/f{i}.txt", f"text {i}", 1_700_000_000)
    sync_once(spark, [kb], tables, now=1, buckets=4)
    for step in (2, 3, 4):
        _write(f"{kb}/f{step}.txt", f"changed {step}", 1_700_000_000 + step)
        sync_once(spark, [kb], tables, now=step)
    state = _tables(spark, tables)
    # what a crash left: a snapshot above the current one stays, one below goes
    os.makedirs(f"{tables}/files/snapshot=9/{TB.BUCKET}=0")
    before = sum(len(b) for name in TB.TABLES for b in _buckets(tables, name).values())
    gone = TB.expire_snapshots(spark, tables, keep=1)
    left = {name: _buckets(tables, name) for name in TB.TABLES}
    layout = TB.read_layout(spark, tables, 4)["tables"]
    for name in TB.TABLES:
        named = {(f"snapshot={m}", f"{TB.BUCKET}={b}") for b, m in layout[name]["at"].items()}
        assert {(s, b) for s, bs in left[name].items() for b in bs if s != "snapshot=9"} == named
    assert gone > 0 and before > sum(len(b) for x in left.values() for b in x.values())
    assert _tables(spark, tables) == state and TB.current_snapshot(spark, tables) == 4
    assert TB.expire_snapshots(spark, tables, keep=1) == 0
    import pytest
    with pytest.raises(ValueError):
        TB.expire_snapshots(spark, tables, keep=0)
    # goes on from there; a snapshot's number is never used again
    _write(f"{kb}/f0.txt", "again", 1_700_009_000)
    assert sync_once(spark, [kb], tables, now=9, keep=1).version == 10
    assert len(_tables(spark, tables)[0]) == 12 and "snapshot=9" not in _buckets(tables, "files")
    os.remove(f"{kb}/f0.txt")
    sync_once(spark, [kb], tables, now=10)
    assert len(_tables(spark, tables)[0]) == 11


def test_sync_with_hostile_names(spark, scratch):
    kb, tables = os.path.join(scratch, "kb"), os.path.join(scratch, "tables")
    names = ["a[1].txt", "{x}.md", "st*r.txt", "_u.txt", ".d.txt", "50%.txt", "q?.txt", "_dir/.x/in[2].txt"]
    for n in names:
        _write(f"{kb}/{n}", f"text of {n}", 1_700_000_000)
    r = sync_once(spark, [kb], tables, now=1)
    files, chunks = _tables(spark, tables)
    assert sorted(files) == sorted(f"{kb}/{n}" for n in names) and len(chunks) == len(names) and r.rejects.count() == 0
    _write(f"{kb}/a[1].txt", "text of a[1].txt", 1_700_000_900)      # touched: hashed, not yet known
    sync_once(spark, [kb], tables, now=2)
    _write(f"{kb}/a[1].txt", "text of a[1].txt", 1_700_000_950)      # touched again: the hash is known
    assert sync_once(spark, [kb], tables, now=3, dry_run=True).plan.count() == 0
    os.remove(f"{kb}/{names[-1]}")
    plan = {r.source: r.action for r in sync_once(spark, [kb], tables, now=4).plan.collect()}
    assert plan == {f"{kb}/{names[-1]}": "delete"} and len(_tables(spark, tables)[0]) == len(names) - 1


def test_upsert_and_delete_with_repeated_ids(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "id string, label int, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 7, 1), ("c", 3, None), ("c", 4, None)], "id string, label int, v int")
    got = sorted(tuple(r) for r in TB.upsert_vectors(old, new).collect())
    assert got == [("a", 1, 0), ("b", 7, 1), ("c", 4, None)]
    assert sorted(tuple(r) for r in TB.upsert_vectors(old, new.orderBy("label"), version_col="v").collect()) == got
    extra = spark.createDataFrame([("b", {"k": "1"}), ("b", {"k": "2"})], "id string, extra map<string,string>")
    assert TB.upsert_vectors(extra.limit(0), extra).collect()[0].extra == {"k": "2"}
    ids = spark.createDataFrame([("b",), ("b",), ("a",)], "id string")
    assert [tuple(r) for r in TB.delete_vectors(old, ids=ids, where={"label": {"$lt": 2}}).collect()] == [("b", 2, 0)]
    assert TB.delete_vectors(old, ids=ids).count() == 0


def _counting(folder):
    """An embedding function that leaves a file a text it was asked for."""
    def fn(texts):
        import hashlib
        import uuid
        for t in texts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w", encoding="utf-8") as f:
                f.write(t)
        return [[float(b) + 1 for b in hashlib.sha1(t.encode()).digest()[:8]] for t in texts]
    return fn


def test_sync_embeds_a_text_once(spark, scratch):
    kb, tables, asked = (os.path.join(scratch, x) for x in ("kb", "tables", "asked"))
    os.makedirs(asked)
    paragraphs = [f"paragraph {i} " + "word " * 150 for i in range(12)]
    _write(f"{kb}/a.txt", "\n\n".join(paragraphs), 1_700_000_000)
    _write(f"{kb}/b.txt", "the same text", 1_700_000_000)
    _write(f"{kb}/c.txt", "the same text", 1_700_000_000)
    how = dict(embed_fn=_counting(asked), buckets=8)

    def vectors():
        return {(os.path.basename(r.source), r.text): list(r.embedding)
                for r in TB.read_table(spark, tables, "vectors", TB.VECTORS_SCHEMA).collect()}

    sync_once(spark, [kb], tables, now=1, embed_model="m", **how)
    first = vectors()
    texts = {t for _, t in first}
    assert len(os.listdir(asked)) == len(texts) < len(first)         # b and c share one
    plain = os.path.join(scratch, "plain")
    sync_once(spark, [kb], plain, now=1, embed_fn=_counting(os.path.join(scratch)), buckets=8)
    assert {(os.path.basename(r.source), r.text): list(r.embedding)
            for r in TB.read_table(spark, plain, "vectors", TB.VECTORS_SCHEMA).collect()} == first

    # moved and copied files: the model is not called
    os.rename(f"{kb}/a.txt", f"{kb}/moved.txt")
    _write(f"{kb}/copy.txt", "the same text", 1_700_000_500)
    n = len(os.listdir(asked))
    sync_once(spark, [kb], tables, now=2, embed_model="m", **how)
    assert len(os.listdir(asked)) == n
    moved = vectors()
    assert {t: v for (f, t), v in moved.items() if f == "moved.txt"} == {t: v for (f, t), v in first.items() if f == "a.txt"}
    assert ("copy.txt", "the same text") in moved and not any(f == "a.txt" for f, _ in moved)

    # one changed paragraph: only chunks with other texts than before
    paragraphs[5] = "another " + paragraphs[5]
    _write(f"{kb}/moved.txt", "\n\n".join(paragraphs), 1_700_000_900)
    sync_once(spark, [kb], tables, now=3, embed_model="m", **how)
    changed = {t for _, t in vectors()} - texts
    assert 0 < len(os.listdir(asked)) - n == len(changed) < len(texts)

    # another model shares nothing, and the old one is still there
    n = len(os.listdir(asked))
    _write(f"{kb}/b.txt", "the same text", 1_700_001_000)
    sync_once(spark, [kb], tables, now=4, embed_model="m2", **how)
    assert len(os.listdir(asked)) == n + 1


def test_contents_with_a_hot_text(spark):
    from docspark.operators import embedding as E
    rows = [(i, "hot" if i % 3 else f"t{i}", "x") for i in range(3000)] + [(3001, None, "x"), (3002, "", "x"), (3001, None, "x")]
    df = spark.createDataFrame(rows, "id long, text string, model string")
    none = spark.createDataFrame([], E.CONTENTS_SCHEMA)
    known = E.new_contents(df.where("text = 'hot'"), none, "m", dim=8)
    new = E.new_contents(df, known, "m", dim=8)
    assert known.count() == 1 and new.count() == 1001
    got = E.with_contents(df, known.unionByName(new).unionByName(known), "m")
    assert got.columns == ["id", "text", "model", "embedding", "token_count"]
    want = E.embed(df, "text", dim=8)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert E.with_contents(df, known, "m2").where("embedding is not null").count() == 0
    assert E.with_contents(df.limit(0), known, "m").count() == 0 and E.new_contents(df.limit(0), known, "m").count() == 0
