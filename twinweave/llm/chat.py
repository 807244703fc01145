"""Chat formatting with Spark expressions only.

Grammar of a formatted conversation (control strings are fixed values below)::

    <s> block*        block := [INST] texts [/INST]                    role user
                             | texts </s>                              role assistant
                             | [ROLE] role [/ROLE] texts [/TURN]       any other role
                      texts := text ([NEXT] text)*

Adjacent turns of one role share a block; ``[NEXT]`` still marks each turn.  A
control string inside a text gets one backslash after its first character (and
one more if it had some), which is undone by taking one away.

A conversation is built in two steps, so that a very long one is sorted, merged
and rendered in pieces of ``chunk`` turns by many tasks; only the finished
pieces of a conversation meet in one row.  Pieces are cut by the value of
``turn``, which needs one shuffle.  Where that leaves a piece with over
``CROWDED`` times as many rows (equal or null turns; a count over the two key
columns tells), all rows are first dealt by ranges over (conv_id, turn, role,
text, row) and pieces are cut by position.  The result is the same.

Defined cases: a null text is the empty text; a null role is the role with the
empty name; rows are ordered by turn (null first), then role, then text, and
repeated rows are turns of their own; rows with a null conv_id form one
conversation; an empty table gives an empty table; texts of any length are whole; columns not named are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS = "<s>", "</s>"
_REST = r"(/?s>|/?INST\]|/?ROLE\]|/TURN\]|NEXT\])"
ESCAPE = (r"([<\[])(\\*)" + _REST, r"$1$2\\$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _REST, r"$1$2$3")
#: Times its number of turns that a piece may have before pieces are cut by position.
CROWDED = 4
_BLOCK = r"(?s)\[INST\].*?\[/INST\]|\[ROLE\].*?\[/ROLE\].*?\[/TURN\]|.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE[0]), F.lit(ESCAPE[1]))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE[0]), F.lit(UNESCAPE[1]))


def _opening(role: str) -> str:
    return f"case {role} when 'user' then '[INST]' when 'assistant' then '' else concat('[ROLE]', {role}, '[/ROLE]') end"


def _closing(role: str) -> str:
    return f"case {role} when 'user' then '[/INST]' when 'assistant' then '</s>' else '[/TURN]' end"


#: Merges adjacent same-role turns of one piece.
_MERGE = """aggregate(turns, cast(array() as array<struct<role: string, texts: array<string>>>), (acc, t) ->
  if(size(acc) > 0 and acc[size(acc) - 1].role = t.role,
     concat(slice(acc, 1, size(acc) - 1),
            array(named_struct('role', t.role, 'texts', concat(acc[size(acc) - 1].texts, array(t.text))))),
     concat(acc, array(named_struct('role', t.role, 'texts', array(t.text))))))"""

#: Each block with what precedes it inside the piece.
_RENDER = f"""transform(blocks, (b, i) -> named_struct(
  'glue', if(i = 0, '', concat({_closing('blocks[i - 1].role')}, {_opening('b.role')})),
  'loss', b.role = 'assistant', 'texts', b.texts))"""

_SPANS = """aggregate(rendered, named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, len: int>>)), (a, b) ->
  named_struct(
    'at', a.at + length(b.glue) + length(array_join(b.texts, '[NEXT]')),
    'spans', if(b.loss, concat(a.spans, aggregate(b.texts,
        named_struct('at', a.at + length(b.glue), 'spans', cast(array() as array<struct<start: int, len: int>>)),
        (c, t) -> named_struct('at', c.at + length(t) + 6,
                               'spans', concat(c.spans, array(named_struct('start', c.at, 'len', length(t))))),
        c -> c.spans)), a.spans)),
  a -> a.spans)"""

_GLUED = f"""transform(pieces, (p, i) -> named_struct(
  'glue', case when i = 0 then concat('{BOS}', {_opening('p.first_role')})
               when pieces[i - 1].last_role = p.first_role then '[NEXT]'
               else concat({_closing('pieces[i - 1].last_role')}, {_opening('p.first_role')}) end,
  'core', p.core, 'spans', p.spans))"""

_ALL_SPANS = """flatten(aggregate(glued, named_struct('at', 0, 'spans', cast(array() as array<array<struct<start: int, len: int>>>)), (a, p) ->
  named_struct(
    'at', a.at + length(p.glue) + length(p.core),
    'spans', concat(a.spans, array(transform(p.spans, s ->
        named_struct('start', s.start + a.at + length(p.glue), 'len', s.len))))),
  a -> a.spans))"""


def _pieces(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows ``conv_id, turn, t`` with the number of a piece; pieces follow the order of (turn, role, text)."""
    by_turn = rows.withColumn("piece", F.floor(F.col("turn") / chunk))
    most = by_turn.groupBy("conv_id", "piece").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= CROWDED * chunk:
        return by_turn
    order = ["conv_id", "turn", "t", "row"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.withColumn("piece", F.floor(F.monotonically_increasing_id() / chunk))


def format_chat(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", chunk: int = 256) -> DataFrame:
    """``conv_id, formatted, loss_spans``: spans are code points of ``formatted``
    (start from 0, length), one for each assistant text, escaped as it stands."""
    rows = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")).alias("t"))
    pieces = (
        _pieces(rows, chunk).groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .withColumn("blocks", F.expr(_MERGE))
        .withColumn("rendered", F.expr(_RENDER))
        .select("conv_id", "piece",
                F.expr("blocks[0].role").alias("first_role"),
                F.expr("blocks[size(blocks) - 1].role").alias("last_role"),
                F.expr("array_join(transform(rendered, b -> concat(b.glue, array_join(b.texts, '[NEXT]'))), '')").alias("core"),
                F.expr(_SPANS).alias("spans")))
    whole = (
        pieces.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("piece", "first_role", "last_role", "core", "spans"))).alias("pieces"))
        .withColumn("glued", F.expr(_GLUED)))
    return whole.select(
        "conv_id",
        F.expr("concat(array_join(transform(glued, p -> concat(p.glue, p.core)), ''), "
               + _closing("pieces[size(pieces) - 1].last_role") + ")").alias("formatted"),
        F.expr(_ALL_SPANS).alias("loss_spans"))


def _turns(block: Column) -> Column:
    """The turns of one block, unescaped, as (role, text)."""
    kind = F.when(block.startswith("[INST]"), "user").when(block.startswith("[ROLE]"), "other").otherwise("assistant")
    role = F.when(kind == "other", unescape(F.substring_index(F.substr(block, F.lit(7)), "[/ROLE]", 1))).otherwise(kind)
    body = (
        F.when(kind == "user", F.substr(block, F.lit(7), F.length(block) - 13))
        .when(kind == "other", F.regexp_replace(F.substr(block, F.lit(1), F.length(block) - 7), r"(?s)^\[ROLE\].*?\[/ROLE\]", ""))
        .otherwise(F.substr(block, F.lit(1), F.length(block) - 4)))
    return F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))


def read_chat(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text`` read back from :func:`format_chat`'s output:
    turns are (role, text) as they came, loss_text all text under the mask."""
    return formatted.select(
        "conv_id", "formatted",
        F.flatten(F.transform(
            F.regexp_extract_all(F.substr("formatted", F.lit(len(BOS) + 1)), F.lit(_BLOCK), F.lit(0)), _turns)).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(
            F.substr(F.col("formatted"), s["start"] + 1, s["len"]))), "").alias("loss_text"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Query form: sizes and digests, all read back from the formatted text."""
    back = read_chat(format_chat(conversations))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
