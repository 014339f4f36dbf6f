"""Turning ordered token deltas of model replies into events.

Input rows: ``chat_id, seq, delta, is_end``. Output events:
``chat_id, ordinal, kind (role|content|tool_call|done), content, tool_name,
arguments, call_id``.

The per-chat state machine (``ReplyParser``) is shared by

* ``stream_events`` -- Structured Streaming, ``groupBy(chat_id)
  .applyInPandasWithState`` with the parser state in the state store and a
  processing-time timeout that expires idle chats; early deltas wait in state
  until the gap closes, duplicates (``seq < next_seq``) are dropped;
* ``stream_events_batch`` -- the same parser over a static table, one pass per
  chat in ``seq`` order (a chat is one reply, bounded by the model's output limit).

The stream needs the deltas as they were sent, empty ones and stop tokens
included: a missing ``seq`` is a delta that has not arrived, and what follows
waits for it. Stop tokens are removed in the parser, also when cut over deltas.
A static table has all its deltas, so gaps in it (as ``drop_empty_deltas`` leaves)
are no delay there.

Rules kept from the reference: content outside tags is emitted as it comes;
a possible partial opening tag at the end of the buffer is held back; a
closed tag with a valid body becomes a tool_call event, a bad body is emitted
as content with its tags. Fixed here: several calls in one delta are all
parsed, a call opened and closed in the last delta is kept, an unclosed tag
is flushed as content at the end, every call gets its own ordinal, and
``done`` carries finish_reason tool_calls when a call was emitted.
"""

from __future__ import annotations

import hashlib
import json
from typing import Dict, Iterator, List, Optional, Tuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docspark.operators.messages import STOP_TOKENS

OPEN, CLOSE = "<tool_call>", "</tool_call>"
EVENT_SCHEMA = ("chat_id string, ordinal long, kind string, content string, tool_name string, "
                "arguments string, call_id string")
STATE_SCHEMA = ("buffer string, in_tool boolean, next_seq long, ordinal long, n_calls long, "
                "pending string, started boolean, closed boolean")


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def _unique_keys(pairs):
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key repeats")
    return found


def parse_call(body: str) -> Optional[Tuple[str, str]]:
    """(name, compact arguments) for a valid body, else None. As in the table's
    parser, NaN and the infinities are no JSON, and keys may not repeat."""
    try:
        data = json.loads(body.strip(), parse_constant=_no_constant, object_pairs_hook=_unique_keys)
    except Exception:
        return None
    if not isinstance(data, dict) or not isinstance(data.get("name"), str):
        return None
    args = data.get("arguments", {})
    return data["name"], json.dumps(args, separators=(",", ":"), ensure_ascii=False)


class ReplyParser:
    def __init__(self, chat_id: str, buffer: str = "", in_tool: bool = False, next_seq: int = 0,
                 ordinal: int = 0, n_calls: int = 0, pending: Optional[Dict[int, Tuple[str, bool]]] = None,
                 started: bool = False, closed: bool = False):
        self.chat_id, self.closed = chat_id, closed
        self.buffer, self.in_tool = buffer, in_tool
        self.next_seq, self.ordinal, self.n_calls = next_seq, ordinal, n_calls
        self.pending = pending or {}
        self.started = started
        self.out: List[tuple] = []

    # ---------------------------------------------------------------- events
    def _emit(self, kind, content=None, name=None, args=None, cid=None):
        self.out.append((self.chat_id, self.ordinal, kind, content, name, args, cid))
        self.ordinal += 1

    def _content(self, text: str):
        if text:
            self._emit("content", text)

    # ---------------------------------------------------------------- input
    def offer(self, seq: int, delta: Optional[str], is_end: bool) -> bool:
        """Take one delta; process every delta that is now in order. Returns whether
        the chat is closed. What was processed before, or comes after the end, is dropped."""
        if not self.closed and seq >= self.next_seq:
            self.pending.setdefault(seq, (delta or "", bool(is_end)))
            while not self.closed and self.next_seq in self.pending:
                self.take(self.next_seq, *self.pending.pop(self.next_seq))
        return self.closed

    def take(self, seq: int, delta: Optional[str], is_end: bool) -> None:
        """Process a delta whose turn it is, whatever numbers are missing before it."""
        if self.closed or seq < self.next_seq:
            return
        self.next_seq = seq + 1
        if not self.started:
            self._emit("role", "assistant")
            self.started = True
        self.buffer += delta or ""
        for tok in STOP_TOKENS:
            self.buffer = self.buffer.replace(tok, "")
        self._drain()
        if is_end:
            self._finish()

    def _drain(self):
        while True:
            if not self.in_tool:
                i = self.buffer.find(OPEN)
                if i >= 0:
                    self._content(self.buffer[:i])
                    self.buffer = self.buffer[i + len(OPEN):]
                    self.in_tool = True
                    continue
                cut = self._hold_back_from(self.buffer)
                self._content(self.buffer[:cut])
                self.buffer = self.buffer[cut:]
                return
            j = self.buffer.find(CLOSE)
            if j < 0:
                return
            body, self.buffer = self.buffer[:j], self.buffer[j + len(CLOSE):]
            self.in_tool = False
            parsed = parse_call(body)
            if parsed is None:
                self._content(OPEN + body + CLOSE)
            else:
                key = f"{'' if self.chat_id is None else self.chat_id}:{self.n_calls}"
                cid = "call_" + hashlib.sha1(key.encode()).hexdigest()[:8]
                self._emit("tool_call", None, parsed[0], parsed[1], cid)
                self.n_calls += 1

    @staticmethod
    def _hold_back_from(buf: str) -> int:
        """Index where a possible beginning of an opening tag or a stop token starts (len(buf) if none)."""
        k = buf.rfind("<")
        if k >= 0 and any(len(buf) - k < len(mark) and mark.startswith(buf[k:]) for mark in (OPEN, *STOP_TOKENS)):
            return k
        return len(buf)

    def _finish(self):
        if self.in_tool:
            self._content(OPEN + self.buffer)
        else:
            self._content(self.buffer)
        self.buffer, self.in_tool = "", False
        self.pending.clear()
        self.closed = True
        self._emit("done", "tool_calls" if self.n_calls else "stop")

    # ---------------------------------------------------------------- state io
    def state_row(self) -> tuple:
        return (self.buffer, self.in_tool, self.next_seq, self.ordinal, self.n_calls,
                json.dumps({str(k): [v[0], v[1]] for k, v in self.pending.items()}), self.started, self.closed)

    @classmethod
    def from_state(cls, chat_id: str, row) -> "ReplyParser":
        buffer, in_tool, next_seq, ordinal, n_calls, pending, started, closed = row
        pend = {int(k): (v[0], bool(v[1])) for k, v in json.loads(pending or "{}").items()}
        return cls(chat_id, buffer or "", bool(in_tool), int(next_seq), int(ordinal), int(n_calls),
                   pend, bool(started), bool(closed))

    def frame(self) -> pd.DataFrame:
        cols = ["chat_id", "ordinal", "kind", "content", "tool_name", "arguments", "call_id"]
        return pd.DataFrame(self.out, columns=cols)


def drop_empty_deltas(deltas: DataFrame, delta_col: str = "delta") -> DataFrame:
    """Stop tokens removed per delta; empty deltas dropped (end markers kept).

    For tables (``assemble_stream``, ``stream_events_batch``): on a stream it would
    leave numbers missing, so ``stream_events`` takes the deltas as they were."""
    d = F.col(delta_col)
    for tok in STOP_TOKENS:
        d = F.replace(d, F.lit(tok), F.lit(""))
    out = deltas.withColumn(delta_col, d)
    end = F.coalesce(F.col("is_end"), F.lit(False)) if "is_end" in deltas.columns else F.lit(False)
    return out.where((F.coalesce(F.col(delta_col), F.lit("")) != "") | end)


def assemble_stream(deltas: DataFrame) -> DataFrame:
    """Batch twin -- the full text of each chat, deltas in seq order."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return deltas.groupBy("chat_id").agg(
        F.array_join(F.transform(parts, lambda x: F.coalesce(x["delta"], F.lit(""))), "").alias("text"))


def stream_events_batch(deltas: DataFrame) -> DataFrame:
    """W1/W2/W3 over a static table.

    Deltas are hash-partitioned by chat and sorted by (chat, seq) inside each
    partition; one pass of ``mapInPandas`` then feeds them to one parser per
    chat, carrying a chat's parser across Arrow batch boundaries. This is the
    grouped plan without building a pandas frame per chat."""
    src = deltas.select(F.col("chat_id").cast("string").alias("chat_id"), "seq", "delta",
                        F.coalesce(F.col("is_end"), F.lit(False)).alias("is_end"))
    spark = deltas.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = src.repartition(n, "chat_id").sortWithinPartitions("chat_id", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser, current = None, object()  # not None: that is a chat of its own
        cols = ["chat_id", "ordinal", "kind", "content", "tool_name", "arguments", "call_id"]
        for pdf in batches:
            out: List[tuple] = []
            for cid, seq, delta, end in zip(pdf["chat_id"].tolist(), pdf["seq"].tolist(),
                                            pdf["delta"].tolist(), pdf["is_end"].tolist()):
                if cid != current:
                    if parser is not None:
                        out.extend(parser.out)
                    parser, current = ReplyParser(cid), cid
                parser.take(seq, delta, end)
            if parser is not None:
                out.extend(parser.out)
                parser.out = []
            yield pd.DataFrame(out, columns=cols)

    return ordered.mapInPandas(run, EVENT_SCHEMA)


def stream_events(deltas: DataFrame, idle_timeout_ms: Optional[int] = None) -> DataFrame:
    """Streaming events with keyed state (append mode). A null chat id is a chat of its own.

    A closed chat keeps a small state with its next number, so that a late or
    repeated delta does not open it again; the timeout removes it. With ``idle_timeout_ms`` a chat that gets no delta for that long is
    flushed (held-back text, unclosed tag) and closed by a processing-time
    timeout; use it with a processing-time trigger. Spark then schedules
    no-data micro-batches to fire timers, so ``processAllAvailable`` would not
    return -- which is why it is off by default (chats close on their end row)."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chat_id = None if key[0] is None else str(key[0])
        if state.hasTimedOut:
            p = ReplyParser.from_state(chat_id, state.get)
            if not p.closed:
                p._finish()
            state.remove()
            yield p.frame()
            return
        p = ReplyParser.from_state(chat_id, state.get) if state.exists else ReplyParser(chat_id)
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, delta, end in zip(rows["seq"].tolist(), rows["delta"].tolist(), rows["is_end"].tolist()):
            p.offer(seq, delta, end)
        state.update(p.state_row())
        if idle_timeout_ms:
            state.setTimeoutDuration(int(idle_timeout_ms))
        yield p.frame()

    src = deltas.select(F.col("chat_id").cast("string").alias("chat_id"), "seq", "delta",
                        F.coalesce(F.col("is_end"), F.lit(False)).alias("is_end"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_timeout_ms else GroupStateTimeout.NoTimeout
    return src.groupBy("chat_id").applyInPandasWithState(step, EVENT_SCHEMA, STATE_SCHEMA, "append", timeout)
