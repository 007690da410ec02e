"""Chat formatting: a state machine checks turn order, a declarative template gives text and loss spans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import q

# One row per role: what opens its turns, what closes them, whether its text is learned.
TEMPLATE = {
    "system": {"open": "[SYS]", "close": "[/SYS]", "loss": False},
    "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
    "assistant": {"open": "[ANS]", "close": "</s>", "loss": True},
    "tool": {"open": "[TOOL]", "close": "[/TOOL]", "loss": False},
}
# Turns of any other role carry its name: OTHER[0] name OTHER[1] text OTHER[2]; a missing role has OTHER[3] as its name.
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]", "[NONE]")
START = "start"
# From a state (the last role) to the roles that may follow; a conversation is valid when it ends after one of ENDS.
MOVES = {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")}
ENDS = ("assistant",)


def control_strings(template: dict) -> list[str]:
    """Every string that means something to a reader of the output, in a fixed order."""
    found = list(dict.fromkeys([x for r in template.values() for x in (r["open"], r["close"])] + list(OTHER)))
    firsts = {c[0] for c in found}
    if any("\\" in c or len(c) < 2 or firsts & set(c[1:]) for c in found):
        raise ValueError("control strings are two or more characters, none a backslash, and none but the first begins a control string")
    if len(found) > 62:
        raise ValueError("more control strings than codes")
    return found


def _codes(template: dict) -> list[tuple[str, str]]:
    names = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    return [("\\", "\\\\")] + [(c, "\\" + n) for c, n in zip(control_strings(template), names)]


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    """Text in which every backslash and control string is a backslash and a code, so that none is left to misread."""
    for raw, code in _codes(template):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    """The inverse of `escape`.

    The text is cut at its escaped backslashes first, so that a code is never read across one.
    """
    def decode(part):
        for raw, code in _codes(template)[1:]:
            part = F.replace(part, F.lit(code), F.lit(raw))
        return part
    return F.array_join(F.transform(F.split(text, r"\\\\"), decode), "\\")


def _state_after(roles: Column) -> Column:
    table = F.create_map(*[F.lit(x) for s, nxt in MOVES.items() for r in nxt for x in (f"{s}>{r}", r)])
    return F.aggregate(roles, F.lit(START), lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit(">"), F.coalesce(r, F.lit("")))), F.lit("error")))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation: `(conv, n_turns, valid, segments, formatted, loss_spans)`.

    `segments` are `(text, loss)` in order; `formatted` is their text in one string and
    `loss_spans` the `(start, length)` of the learned parts in code points, from 1.
    `valid` says whether the roles follow MOVES and end in ENDS; invalid conversations
    are formatted all the same. Turns come by `turn`, nulls first; ties by role, then
    text; repeated rows are repeated turns. A null text is empty, a null role or one
    the template does not know is kept by name. Rows with a null conversation id are
    one conversation. Other columns do not pass. An empty table gives an empty result.
    A conversation is put together in one task, since its output is one string.
    """
    t = df.select(q(conv).alias("conv"), F.struct(q(turn).alias("turn"), q(role).alias("role"), F.coalesce(q(text), F.lit("")).alias("text")).alias("t"))
    g = t.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def part(s, loss):
        return F.struct(s.alias("text"), F.lit(loss).alias("loss"))

    def segments(x):
        known = [F.when(x["role"] == name, F.array(part(F.lit(r["open"]), False), part(escape(x["text"], template), bool(r["loss"])), part(F.lit(r["close"]), False)))
                 for name, r in template.items()]
        name = F.coalesce(escape(x["role"], template), F.lit(OTHER[3]))
        other = F.array(part(F.concat(F.lit(OTHER[0]), name, F.lit(OTHER[1])), False), part(escape(x["text"], template), False), part(F.lit(OTHER[2]), False))
        return F.coalesce(*known, other)

    d = g.select("conv", F.size("turns").cast("long").alias("n_turns"), _state_after(F.col("turns.role")).isin(*ENDS).alias("valid"),
                 F.flatten(F.transform("turns", segments)).alias("segments"))
    size = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("segments", size, lambda a, s: F.struct(
        (a["at"] + F.char_length(s["text"])).alias("at"),
        F.when(s["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.char_length(s["text"]).alias("length"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return d.select(F.col("conv").alias(conv), "n_turns", "valid", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The `(role, text)` turns of a formatted conversation, unescaped."""
    import re

    opens = "|".join([re.escape(r["open"]) for r in template.values()] + [re.escape(OTHER[0]) + "(?:(?!" + re.escape(OTHER[1]) + r").)*+" + re.escape(OTHER[1])])
    closes = "|".join([re.escape(r["close"]) for r in template.values()] + [re.escape(OTHER[2])])
    head = F.regexp_extract_all(formatted, F.lit(f"(?s)({opens}).*?(?:{closes})"), F.lit(1))
    body = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{opens})(.*?)(?:{closes})"), F.lit(1))

    def turn(h, b):
        known = reduce(lambda w, kv: w.when(h == kv[1]["open"], kv[0]), template.items(), F.when(F.lit(False), ""))
        name = F.substring(h, len(OTHER[0]) + 1, F.char_length(h) - len(OTHER[0]) - len(OTHER[1]))
        other = F.when(name != OTHER[3], unescape(name, template))
        return F.struct(F.coalesce(known, other).alias("role"), unescape(b, template).alias("text"))
    return F.zip_with(head, body, turn)


def read_loss_text(formatted: Column, spans: Column, template: dict = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    parts: Sequence = F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]), template))
    return F.array_join(parts, "")
