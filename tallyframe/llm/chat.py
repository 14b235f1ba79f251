"""Op 9. Chat formatting: roles through a finite-state machine, texts through a template.

A template is plain data: the marks around a turn, the roles whose text carries loss, the
allowed successor roles (the machine's transitions, from ``start``) and the accepting
roles. Control marks all begin with ``<|``; in roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, so no mark can appear inside a text and unescaping is exact.

``format_turns`` works row by row (one window on the conversation gives the previous
role) and never gathers a conversation. ``format_conversations`` joins a conversation's
turns into one string, which the digests need as a whole.

Defined results: null roles and texts count as empty; turns sort by (turn, role, text),
nulls first, so ties and repeated rows have one order; a null conversation id is one
conversation; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEMPLATE = {
    "open": "<|turn|>", "text": "<|text|>", "close": "<|end|>\n",
    "loss_roles": ["assistant"],
    "next": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "accept": ["assistant"],
}


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def _step_ok(before: Column, role: Column, template: dict) -> Column:
    ok = F.lit(False)
    for state, after in template["next"].items():
        ok = ok | ((before == F.lit(state)) & role.isin(*after))
    return ok


def _segments(role: Column, text: Column, template: dict) -> Column:
    """One turn as (text, loss) segments: the head, the text, the closing mark."""
    def seg(t: Column, loss: Column) -> Column:
        return F.struct(t.alias("text"), loss.alias("loss"))
    head = F.concat(F.lit(template["open"]), escape(role), F.lit(template["text"]))
    return F.array(seg(head, F.lit(False)), seg(escape(text), role.isin(*template["loss_roles"])),
                   seg(F.lit(template["close"]), F.lit(False)))


def _clean(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    empty = F.lit("")
    return df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                     F.coalesce(F.col(f"`{role}`"), empty).alias("role"), F.coalesce(F.col(f"`{text}`"), empty).alias("text"))


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, turn, role, order_ok, segments) of every turn."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = _clean(df, conv, turn, role, text)
    before = F.coalesce(F.lag("role").over(w), F.lit("start"))
    return t.withColumn("__before", before).select(
        "conv_id", "turn", "role", _step_ok(F.col("__before"), F.col("role"), template).alias("order_ok"),
        _segments(F.col("role"), F.col("text"), template).alias("segments"))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, is_valid, formatted, segments (text, loss)."""
    t = _clean(df, conv, turn, role, text)
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    start = F.struct(F.lit("start").alias("state"), F.lit(True).alias("ok"))
    end = F.aggregate("turns", start, lambda a, x: F.struct(
        x["role"].alias("state"), (a["ok"] & _step_ok(a["state"], x["role"], template)).alias("ok")))
    g = g.withColumn("__end", end).withColumn("segments", F.flatten(F.transform(
        "turns", lambda x: _segments(x["role"], x["text"], template))))
    return g.select("conv_id", (F.col("__end.ok") & F.col("__end.state").isin(*template["accept"])).alias("is_valid"),
                    F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The (role, text) turns of a formatted conversation."""
    def mark(m: str) -> str:
        return m.replace("|", "\\|")
    turns = F.filter(F.split(formatted, mark(template["open"])), lambda x: x != "")  # what stands before the first mark
    close = len(template["close"])

    def turn(x: Column) -> Column:
        part = F.split(x, mark(template["text"]), 2)
        body = F.element_at(part, 2)
        return F.struct(unescape(F.element_at(part, 1)).alias("role"),
                        unescape(F.substr(body, F.lit(1), F.length(body) - close)).alias("text"))
    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
