"""Physical-plan checks: the shapes that matter at scale."""
from pyspark.sql import functions as F

from conftest import SF001
from docspark.plans import fixtures as X
from docspark.plans.ingest import preprocess


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_preprocess_has_no_shuffle_beyond_spread(spark):
    p = plan_of(preprocess(X.docs_as_files(spark, SF001).drop("doc_id")))
    # at most the round-robin spread of a tiny input; never a hash/range shuffle
    assert "hashpartitioning" not in p and "rangepartitioning" not in p and "Window" not in p
    assert "BatchEvalPython" not in p


def test_change_detection_has_one_full_outer_join(spark):
    import __spark_entry__ as E
    from docspark.operators import changes as D
    p = plan_of(E.queries()["detect_changes"](spark, SF001))
    assert p.count("FullOuter") == 1
    _, cur = X.file_snapshots(spark, SF001)
    assert "Join" not in plan_of(D.strong_signature(cur, "text"))
    for name in ("sync_files", "sync_chunks", "sync_plan"):
        assert "FullOuter" not in plan_of(E.queries()[name](spark, SF001)), name   # detected once, before


def test_row_local_messages_shuffle_nothing(spark):
    import __spark_entry__ as E
    for name in ("extract_tool_calls", "invalid_tool_calls", "finish_reason", "strip_tool_calls"):
        assert "Exchange" not in plan_of(E.queries()[name](spark, SF001)), name


def test_building_these_plans_runs_no_job(spark):
    import __spark_entry__ as E
    tracker = spark.sparkContext.statusTracker()
    names = ("clean_text", "markdown_sections", "html_sections", "json_sections", "structure_split", "recursive_chunks", "preprocess",
             "detect_changes", "embed", "extract_tool_calls", "finish_reason", "route_turn", "assemble_prompt", "stream_events")
    X.replies(spark, SF001), X.documents_folder(spark, SF001)
    for t in ("documents", "pages", "events", "conversations", "embeddings"):
        X.table(spark, SF001, t)
    for name in names:
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        E.queries()[name](spark, SF001)
        # reading a file's schema is a job of its own in Spark; nothing beyond those
        jobs = tracker.getJobIdsForGroup(f"build-{name}")
        stages = [tracker.getJobInfo(j) for j in jobs]
        assert all(len(j.stageIds) == 1 for j in stages if j), name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_filters_and_columns_reach_the_scan(spark):
    from docspark.operators.messages import assistant_text
    c = X.table(spark, SF001, "conversations")
    p = plan_of(assistant_text(c).select("conv_id", "text"))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)" in p
    assert "ReadSchema: struct<conv_id:bigint,role:string,text:string>" in p


def test_no_row_python_udfs_anywhere(spark):
    import __spark_entry__ as E
    for name in ("clean_text", "markdown_sections", "extract_tool_calls", "knn", "detect_changes"):
        assert "BatchEvalPython" not in plan_of(E.queries()[name](spark, SF001)), name


def test_change_counts_broadcasts_only_the_label_table(spark):
    import __spark_entry__ as E
    p = plan_of(E.queries()["change_counts"](spark, SF001))
    assert "BroadcastExchange" in p


def test_plain_files_pass_no_shuffle_for_their_place(spark, scratch):
    """Files of one row are chunked where they lie, also beside files of several rows."""
    from docspark.plans.ingest import preprocess
    rows = [(f"f{i}.txt", "text " * 50, None) for i in range(20)] + [("c.csv", f"name: {i}", i) for i in range(5)]
    spark.createDataFrame(rows, "source string, text string, row int").write.parquet(f"{scratch}/docs")
    docs = spark.read.parquet(f"{scratch}/docs")
    out = preprocess(docs)
    assert sorted((r.source, r.chunk_index) for r in out.collect() if r.source == "c.csv") == [("c.csv", i) for i in range(5)]
    assert {r.chunk_index for r in out.collect() if r.source != "c.csv"} == {0}
    plain = preprocess(docs.withColumn("row", F.lit(None).cast("int")))
    assert "Exchange hashpartitioning" not in plain._jdf.queryExecution().executedPlan().toString() and plain.count() == 25
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    union = plan[plan.index("Union"):]
    first, second = union.split("\n:- ", 1)[1].split("\n+- ", 1)
    assert "Join" not in first and "Join" in second
