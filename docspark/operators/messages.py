"""Model replies and conversation tables.

Tool calls are pulled out with ``regexp_extract_all`` + ``posexplode`` and
parsed as JSON in the JVM; history, prompts and last messages are windows and
grouped ordered lists keyed by conversation. Nothing leaves the JVM.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, Window, functions as F

from docspark.functions import json as J
from docspark.functions import text as T

TAG_RE = r"(?s)<tool_call>(.*?)</tool_call>"
# Stop tokens removed from replies, and the default end token.
STOP_TOKENS = ("<|im_end|>", "<|endoftext|>")
DEFAULT_EOS = "<|im_end|>"


def bodies(text: Column) -> Column:
    """The bodies of all closed tags, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TAG_RE), F.lit(1))


def _valid(body: Column) -> Column:
    return J.is_json_object(F.trim(body)) & J.json_name(F.trim(body)).isNotNull()


def valid_bodies(text: Column) -> Column:
    return F.filter(bodies(text), _valid)


def call_id(chat: Column, ordinal: Column) -> Column:
    """``call_`` + 8 hex digits from the chat's key and the call's ordinal, so that
    re-runs agree, and so do a stream and a table."""
    return F.concat(F.lit("call_"), F.substring(F.sha1(F.concat_ws(":", chat.cast("string"), ordinal.cast("string"))), 1, 8))


def extract_tool_calls(df: DataFrame, text_col: str = "text", keys=("conv_id", "turn")) -> DataFrame:
    """M1: every valid ``<tool_call>{json}</tool_call>`` body in order:
    ``keys..., ordinal, call_id, name, arguments``. Row by row, without a shuffle."""
    keys = list(keys)
    b = df.select(*keys, F.posexplode(valid_bodies(F.col(text_col))).alias("ordinal", "body"))
    body = F.trim(F.col("body"))
    return b.select(*keys, "ordinal",
                    call_id(F.concat_ws("-", *[F.col(k).cast("string") for k in keys]), F.col("ordinal")).alias("call_id"),
                    J.json_name(body).alias("name"),
                    J.json_arguments(body).alias("arguments"))


def invalid_tool_calls(df: DataFrame, text_col: str = "text", keys=("conv_id", "turn")) -> DataFrame:
    """M2: bodies dropped for bad JSON, a non-object, or a missing/non-string name."""
    keys = list(keys)
    b = df.select(*keys, F.posexplode(bodies(F.col(text_col))).alias("pos", "body"))
    body = F.trim(F.col("body"))
    reason = (F.when(F.try_parse_json(body).isNull(), "bad_json")
               .when(~J.is_json_object(body), "not_object")
               .otherwise("bad_name"))
    return b.where(~_valid(F.col("body"))).select(*keys, "pos", "body", reason.alias("reason"))


def strip_tool_calls_col(text: Column) -> Column:
    """M3: content without the tags, stripped; empty -> NULL."""
    return F.nullif(T.final_strip(F.regexp_replace(F.coalesce(text, F.lit("")), TAG_RE, "")), F.lit(""))


def finish_reason(df: DataFrame, text_col: str = "text", keys=("conv_id", "turn")) -> DataFrame:
    """M3 + M4: ``finish_reason`` is tool_calls when at least one valid call
    exists (content = stripped text), else stop (content = original text).
    Row by row: repeated keys are rows of their own."""
    j = df.select(*keys, F.col(text_col).alias("_text"), F.size(valid_bodies(F.col(text_col))).cast("bigint").alias("n_calls"))
    has = F.col("n_calls") > 0
    return j.select(*keys,
                    F.when(has, "tool_calls").otherwise("stop").alias("finish_reason"),
                    F.when(has, strip_tool_calls_col(F.col("_text"))).otherwise(F.col("_text")).alias("content"),
                    "n_calls")


def strip_special_tokens(df: DataFrame, text_col: str = "text", eos: str = DEFAULT_EOS) -> DataFrame:
    """Drop the end token everywhere, then one trailing stop token of each
    kind (in order), then leading/trailing line feeds."""
    c = F.replace(F.col(text_col), F.lit(eos), F.lit(""))
    for tok in STOP_TOKENS:
        c = F.when(c.endswith(F.lit(tok)), F.substring(c, F.lit(1), F.length(c) - len(tok))).otherwise(c)
    c = F.regexp_replace(c, r"\A\n+|\n+\z", "")
    return df.withColumn(text_col, c)


def message_struct(role: Column, content: Column, tool_calls: Optional[Column] = None) -> Column:
    fields = [role.alias("role"), content.alias("content")]
    if tool_calls is not None:
        fields.append(tool_calls.alias("tool_calls"))
    return F.struct(*fields)


def format_messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text") -> DataFrame:
    """M5: ordered message list per conversation (bounded by the conversation)."""
    m = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    return df.groupBy(conv).agg(
        F.transform(F.array_sort(F.collect_list(m)),
                    lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def chat_history(log: DataFrame, conv: str = "conv_id", msg_id: str = "turn",
                 version: str = "version") -> DataFrame:
    """M6: append log -> latest row per (conversation, message id); an aggregate
    with map-side combine, so a message edited many times is reduced early."""
    cols = [c for c in log.columns if c not in (conv, msg_id)]
    return (log.groupBy(conv, msg_id).agg(F.max_by(F.struct(*cols), F.col(version)).alias("_v"))
               .select(conv, msg_id, "_v.*").select(*log.columns))


def assemble_prompt(df: DataFrame, system_text: str, conv: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text") -> DataFrame:
    """M7: for each user turn: system message + strictly earlier turns + the input."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    hist = F.collect_list(F.struct(F.col(role).alias("role"), F.col(text).alias("content"))).over(w)
    out = df.withColumn("history", hist).where(F.col(role) == "user")
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("content")))
    user = F.array(F.struct(F.lit("user").alias("role"), F.col(text).alias("content")))
    return out.select(conv, turn, F.concat(system, F.col("history"), user).alias("messages"))


def last_message(df: DataFrame, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """M8."""
    return df.groupBy(conv).agg(F.max(turn).alias("last_turn"),
                                F.max_by(role, turn).alias("role"),
                                F.max_by(text, turn).alias("text"))


def assistant_text(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """M9: assistant messages with non-empty content."""
    return df.where((F.col(role) == "assistant") & (F.coalesce(F.col(text), F.lit("")) != ""))


def route_turn(df: DataFrame, text_col: str = "text", conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """M10: 'tools' when the last message carries a valid tool call, else 'end'.
    Only the last message of a conversation is parsed."""
    last = last_message(df, conv, turn, text=text_col)
    return last.select(conv, "last_turn",
                       F.when(F.size(valid_bodies(F.col("text"))) > 0, "tools").otherwise("end").alias("route"))
