from pyspark.sql import functions as F

from docspark.operators import messages as M


def _df(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")


def test_tool_call_variants(spark):
    texts = [
        'hi <tool_call>{"name":"a","arguments":{"q":"x","k":2}}</tool_call> and '
        '<tool_call>{"name":"b"}</tool_call> tail',                     # two calls, text after
        "<tool_call>[1,2]</tool_call><tool_call>3</tool_call>",          # array / number bodies
        '<tool_call>{"arguments":{}}</tool_call><tool_call>{"name":5}</tool_call>',  # name missing / not str
        "a < b <tool_call>unclosed",                                      # '<' in text, unclosed tag
        "",                                                               # empty content
        '<tool_call>\n{"name":"s","arguments":"str"}\n</tool_call>',
    ]
    df = _df(spark, texts)
    calls = {(r.turn, r.ordinal): (r.name, r.arguments) for r in M.extract_tool_calls(df).collect()}
    assert calls == {(0, 0): ("a", '{"q":"x","k":2}'), (0, 1): ("b", "{}"), (5, 0): ("s", '"str"')}
    bad = {(r.turn, r.pos): r.reason for r in M.invalid_tool_calls(df).collect()}
    assert bad == {(1, 0): "not_object", (1, 1): "not_object", (2, 0): "bad_name", (2, 1): "bad_name"}
    fr = {r.turn: (r.finish_reason, r.content) for r in M.finish_reason(df).collect()}
    assert fr[0] == ("tool_calls", "hi  and  tail")
    assert fr[3] == ("stop", "a < b <tool_call>unclosed")
    assert fr[4] == ("stop", "")
    assert fr[5] == ("tool_calls", None)


def test_call_ids_deterministic(spark):
    df = _df(spark, ['<tool_call>{"name":"a"}</tool_call>'])
    a = M.extract_tool_calls(df).collect()[0].call_id
    b = M.extract_tool_calls(df).collect()[0].call_id
    assert a == b and a.startswith("call_") and len(a) == 13


def test_strip_special_tokens(spark):
    df = _df(spark, ["\nabc<|im_end|>", "x<|endoftext|><|im_end|>", "y<|endoftext|>\n", "<|im_end|>z<|im_end|>"])
    got = [r.text for r in M.strip_special_tokens(df).orderBy("turn").collect()]
    assert got == ["abc", "x", "y<|endoftext|>", "z"]


def test_history_and_prompt(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (2, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    p = {(r.conv_id, r.turn): [(m.role, m.content) for m in r.messages]
         for r in M.assemble_prompt(df, "SYS").collect()}
    assert p[(1, 2)] == [("system", "SYS"), ("user", "q1"), ("assistant", "a1"), ("user", "q2")]
    assert p[(2, 0)] == [("system", "SYS"), ("user", "z")]
    last = {r.conv_id: r.text for r in M.last_message(df).collect()}
    assert last == {1: "q2", 2: "z"}
    log = df.withColumn("version", F.lit(1)).unionByName(
        spark.createDataFrame([(1, 1, "assistant", "a1 edited", 2)],
                              "conv_id long, turn long, role string, text string, version int"))
    h = {r.turn: r.text for r in M.chat_history(log).where("conv_id = 1").collect()}
    assert h == {0: "q1", 1: "a1 edited", 2: "q2"}
