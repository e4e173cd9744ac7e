"""Operator 6: chat formatting with relational expressions only.

Turns are collected and sorted per conversation; adjacent turns of one role
become one message, whose turns a marker separates. Template (text T, turn
separator ``[TURN]``):

    user        [INST] T [/INST]
    assistant   <s> T </s>            (T is under the loss mask)
    system      <<SYS>> T <</SYS>>
    other role  [ROLE] role [/ROLE] T [END]

A control string inside a text gets a backslash after its first character, and
one that already has backslashes there gets one more; so no text can hold a
control string and the change can be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, running
from .common import sha256_hex, table

TURN = "[TURN]"
#: Opening and closing strings of the roles that have their own.
FRAMES = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [END]")
_REST = r"(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|END\]|TURN\])"
_MESSAGE = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|\[ROLE\] .*? \[/ROLE\] .*? \[END\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def _opening(role: Column) -> Column:
    known = F.when(F.lit(False), F.lit(""))
    for name, (begin, _) in FRAMES.items():
        known = known.when(role == name, F.lit(begin))
    return known.otherwise(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])))


def _closing(role: Column) -> Column:
    known = F.when(F.lit(False), F.lit(""))
    for name, (_, end) in FRAMES.items():
        known = known.when(role == name, F.lit(end))
    return known.otherwise(F.lit(OTHER[2]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of (conv_id, turn, role, text) rows.

    ``mask`` is an array of (chars, loss) stretches that cover ``formatted`` in
    order; assistant texts are under the loss, separators and frames aren't.
    Null texts and roles are empty strings, nulls sort first, ties of ``turn``
    go by role, then text; repeated rows are turns of their own. A null conv_id
    is a conversation. Other columns are left out. An empty table gives none.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    at = lambda i: F.get("turns", i)["role"]
    starts = F.filter(F.transform("turns", lambda _, i: i), lambda i: (i == 0) | (at(i) != at(i - 1)))
    messages = F.transform(
        "starts",
        lambda s, k: F.struct(at(s).alias("role"), F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: escape(t["text"])).alias("texts")),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            "messages",
            lambda m: F.concat(
                F.array(piece(_opening(m["role"]), False)),
                F.flatten(F.transform(m["texts"], lambda t, i: F.when(i == 0, F.array(piece(t, m["role"] == "assistant"))).otherwise(F.array(piece(F.lit(TURN), False), piece(t, m["role"] == "assistant"))))),
                F.array(piece(_closing(m["role"]), False)),
            ),
        )
    )
    built = sorted_turns.withColumn("starts", starts).withColumn("messages", messages).withColumn("pieces", pieces)
    return built.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["text"]).alias("chars"), p["loss"].alias("loss"))).alias("mask"),
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) read back from the formatted strings and their masks."""
    found = F.regexp_extract_all("formatted", F.lit(_MESSAGE), F.lit(0))

    def body(m: Column, begin: Column | int, end: int) -> Column:
        begin = F.lit(begin) if isinstance(begin, int) else begin
        return F.substring(m, begin + 1, F.length(m) - begin - end)

    def turns(m: Column) -> Column:
        role, text = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
        for name, (begin, end) in FRAMES.items():
            role = role.when(m.startswith(begin), F.lit(name))
            text = text.when(m.startswith(begin), body(m, len(begin), len(end)))
        header = F.instr(m, OTHER[1]) - 1
        role = role.otherwise(unescape(F.substring(m, F.lit(len(OTHER[0]) + 1), header - len(OTHER[0]))))
        text = text.otherwise(body(m, header + len(OTHER[1]), len(OTHER[2])))
        return F.transform(F.split(text, r"\[TURN\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    place = lambda e: F.transform("mask", lambda p, i: F.struct((F.get(e, i) - p["chars"]).alias("begin"), p["chars"].alias("chars"), p["loss"].alias("loss")))
    ends = let(running(F.transform("mask", lambda p: p["chars"]), lambda x, y: x + y), place)
    loss = F.transform(F.filter("places", lambda p: p["loss"]), lambda p: unescape(F.substring(F.col("formatted"), p["begin"] + 1, p["chars"])))
    return formatted.withColumn("places", ends).select("conv_id", "formatted", F.flatten(F.transform(found, turns)).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t (conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = read_conversations(format_conversations(turns))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(digest).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed as (
  select *, row_number() over w as n, lag(role) over w as before, lead(role) over w as after from turns
  window w as (partition by conv_id order by turn nulls first, role, text)
), sized as (
  select *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|END\]|TURN\])', '\1\\\2\3', 'g'))
    + case when before is null or before <> role then case role when 'user' then 7 when 'assistant' then 4 when 'system' then 8
        else 16 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|END\]|TURN\])', '\1\\\2\3', 'g')) end else 6 end
    + case when after is null or after <> role then case role when 'user' then 8 when 'assistant' then 5 when 'system' then 9 else 6 end else 0 end as chars
  from placed
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""
