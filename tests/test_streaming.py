import os
import random

import pandas as pd
from hypothesis import given, settings, strategies as st

from docspark.streaming import tokens as W
from docspark.streaming.tokens import ReplyParser, parse_call

TEXT = ('Intro <b>not a tag</b> a<b <tool_call>{"name":"rag_search","arguments":{"query":"x","k":2}}</tool_call>'
        ' mid <tool_call>{bad</tool_call><tool_call>{"name":"b"}</tool_call> end <tool')


def run_cut(text, cuts):
    p = ReplyParser("c")
    pieces, prev = [], 0
    for c in sorted(set(cuts)) + [len(text)]:
        pieces.append(text[prev:c])
        prev = c
    for i, d in enumerate(pieces):
        p.offer(i, d, False)
    p.offer(len(pieces), "", True)
    return p.out


def summary(events):
    content = "".join(e[3] for e in events if e[2] == "content")
    calls = [(e[4], e[5]) for e in events if e[2] == "tool_call"]
    kinds = [e[2] for e in events]
    return content, calls, kinds[0], kinds[-1], [e[1] for e in events]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=len(TEXT)), max_size=40))
def test_stream_equals_batch_for_any_cut(cuts):
    content, calls, first, last, ords = summary(run_cut(TEXT, cuts))
    # M1-M4 on the whole text: valid calls go, everything else is content
    assert content == "Intro <b>not a tag</b> a<b  mid <tool_call>{bad</tool_call> end <tool"
    assert calls == [("rag_search", '{"query":"x","k":2}'), ("b", "{}")]
    assert first == "role" and last == "done"
    assert ords == list(range(len(ords)))
    assert "<tool_call>{bad</tool_call>" in content and content.endswith(" end <tool")


def test_out_of_order_and_duplicates():
    p = ReplyParser("c")
    p.offer(1, "b", False)
    p.offer(0, "a", False)
    p.offer(0, "a", False)                  # duplicate, dropped
    p.offer(3, "", True)
    assert "".join(e[3] for e in p.out if e[2] == "content") == "ab"
    p.offer(2, "c", False)
    ev = p.out
    assert "".join(e[3] for e in ev if e[2] == "content") == "abc" and ev[-1][2] == "done"


def test_unclosed_tag_flushed_and_finish_reason():
    p = ReplyParser("c")
    p.offer(0, '<tool_call>{"name":"a"}</tool_call><tool_call>{"na', False)
    p.offer(1, "", True)
    kinds = [e[2] for e in p.out]
    assert kinds == ["role", "tool_call", "content", "done"]
    assert p.out[2][3] == '<tool_call>{"na' and p.out[-1][3] == "tool_calls"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=60), max_size=20))
def test_stop_tokens_in_any_cut(cuts):
    text = "a<|im_end|>b <|endoftext|><tool_call>{\"name\":\"f\"}</tool_call><|im_en c<|im_end|>"
    content, calls, *_ = summary(run_cut(text, [c for c in cuts if c < len(text)]))
    assert (content, calls) == ("ab <|im_en c", [("f", "{}")])


def test_late_deltas_do_not_open_a_closed_chat():
    p = ReplyParser("c")
    p.offer(0, "hi", False)
    p.offer(1, "", True)
    q = ReplyParser.from_state("c", p.state_row())
    assert q.offer(0, "hi", False) and q.offer(5, "late", False) and q.out == []


def test_parse_call_rules():
    assert parse_call('{"name":"a","arguments":NaN}') is None and parse_call('{"name":"a","name":"b"}') is None
    assert parse_call('{"name":"a"}') == ("a", "{}")
    assert parse_call('{"name":1}') is None and parse_call("[1]") is None and parse_call("{x") is None


def test_batch_twin(spark):
    rows = [("c1", i, d, False) for i, d in enumerate(["he", "llo <tool", '_call>{"name":"f"}</tool_', "call>!"])]
    rows += [("c1", 4, "", True), ("c2", 0, "x", False), ("c2", 1, "", True)]
    df = spark.createDataFrame(rows, "chat_id string, seq long, delta string, is_end boolean")
    ev = W.stream_events_batch(df).toPandas().sort_values(["chat_id", "ordinal"])
    c1 = ev[ev.chat_id == "c1"]
    assert "".join(c1[c1.kind == "content"].content) == "hello !"
    assert list(c1[c1.kind == "tool_call"].tool_name) == ["f"]


def test_structured_streaming_state(spark, scratch):
    """Deltas arrive as Parquet files over several micro-batches, out of order."""
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    text = 'Hello <tool_call>{"name":"rag_search","arguments":{"query":"q"}}</tool_call> bye'
    pieces = [text[i:i + 5] for i in range(0, len(text), 5)]
    rows = [("chat-1", i, d, False) for i, d in enumerate(pieces)] + [("chat-1", len(pieces), "", True)]
    rnd = random.Random(3)
    rnd.shuffle(rows)
    batches = [rows[:6], rows[6:12], rows[12:]]
    schema = "chat_id string, seq long, delta string, is_end boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = W.stream_events(stream)
    ckpt = os.path.join(scratch, "ckpt")
    q = (out.writeStream.format("memory").queryName("ev_test").outputMode("append")
            .option("checkpointLocation", ckpt).start())
    try:
        for i, b in enumerate(batches):
            pd.DataFrame(b, columns=["chat_id", "seq", "delta", "is_end"]).to_parquet(
                os.path.join(src, f"part-{i}.parquet"))
            q.processAllAvailable()
    finally:
        q.stop()
    ev = spark.sql("select * from ev_test").toPandas().sort_values("ordinal")
    assert "".join(ev[ev.kind == "content"].content) == "Hello  bye"
    assert list(ev[ev.kind == "tool_call"].tool_name) == ["rag_search"]
    assert ev.kind.iloc[0] == "role" and ev.kind.iloc[-1] == "done"
    assert list(ev.ordinal) == list(range(len(ev)))


def test_null_chat_is_a_chat(spark):
    rows = [(None, 0, "a", False), (None, 1, '<tool_call>{"name":"f"}</tool_call>', True), ("c", 0, "b", True)]
    df = spark.createDataFrame(rows, "chat_id string, seq long, delta string, is_end boolean")
    ev = W.stream_events_batch(df).collect()
    assert [(r.kind, r.content) for r in sorted((r for r in ev if r.chat_id is None), key=lambda r: r.ordinal)] == [
        ("role", "assistant"), ("content", "a"), ("tool_call", None), ("done", "tool_calls")]
    from docspark.operators import messages as M
    whole = spark.createDataFrame([(None, '<tool_call>{"name":"f"}</tool_call>')], "chat_id string, text string")
    assert M.extract_tool_calls(whole, keys=("chat_id",)).first().call_id == [r.call_id for r in ev if r.kind == "tool_call"][0]
