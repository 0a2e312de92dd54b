"""Operator 2: chat formatting by a finite-state machine over roles.

A declarative template says how a turn is marked, which roles are learned from
and which role may follow which. Each conversation becomes one string with the
segments it is made of; a segment carries its loss flag. Control strings inside
texts are escaped reversibly, so the turns can be read back from the string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The template. ``follows`` are the transitions of the machine: state, then the
#: roles that lead on from it; the state after a turn is its role. A conversation
#: is valid if every turn has a transition and it ends in a state of ``ends``.
TEMPLATE = {
    "open": "### ",
    "labels": {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"},
    "sep": ": ",
    "close": " </turn>\n",
    "loss": ["assistant"],
    "start": "start",
    "follows": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user", "tool"], "tool": ["assistant"]},
    "ends": ["assistant"],
}
#: Escapes, in the order in which they are made; the first is undone last. No
#: escape holds a control string, and each backslash left begins an escape.
ESCAPES = [("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e")]
ROLE_ESCAPES = [*ESCAPES, (": ", "\\c")]


def escape(text: Column, pairs: list = ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs: list = ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Returns conv_id, formatted, segments (text, loss), valid, bad_turn: the place
    from 0 of the first turn that the machine does not allow (the count of turns if
    it ends too soon; null if valid). Invalid conversations are formatted as well.

    Columns used are conv_id, turn, role, text; others are ignored. Turns go by
    turn (nulls first), then role, then text; repeated rows stay. A null text is
    empty; a null role is an empty role, which nothing allows. Rows of a null
    conv_id are one conversation. An empty table gives no rows.

    A conversation is one output row, so its turns have to meet in one task; rows
    are formatted before that, and nothing but their text travels."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.coalesce(*[F.when(role == r, F.lit(name)) for r, name in template["labels"].items()], F.concat(F.lit("?"), escape(role, ROLE_ESCAPES)))
    head = F.concat(F.lit(template["open"]), label, F.lit(template["sep"]))
    row = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("said"), head.alias("head"))
    convs = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def parts(x: Column) -> Column:
        piece = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        return F.array(piece(x["head"], F.lit(False)), piece(escape(x["said"]), x["role"].isin(template["loss"])), piece(F.lit(template["close"]), F.lit(False)))

    allowed = F.array(*[F.lit(f"{a} {b}") for a, after in template["follows"].items() for b in after])
    state = lambda i: F.when(i == 0, F.lit(template["start"])).otherwise(F.get(F.col("rows.role"), i - 1))
    places = F.sequence(F.lit(0), F.size("rows") - 1)
    wrong = F.filter(places, lambda i: ~F.array_contains(allowed, F.concat(state(i), F.lit(" "), F.get(F.col("rows.role"), i))))
    ends = F.when(~F.element_at(F.col("rows.role"), -1).isin(template["ends"]), F.size("rows"))
    out = convs.select("conv_id", F.flatten(F.transform("rows", parts)).alias("segments"), F.coalesce(F.get(wrong, F.lit(0)), ends).alias("bad_turn"))
    return out.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments", F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def read_chats(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Adds turns (role, text), read back from the formatted string alone."""
    labels = F.create_map(*[F.lit(x) for role, name in template["labels"].items() for x in (name, role)])

    def turn(t: Column) -> Column:
        at = F.instr(t, template["sep"])
        label = F.substring(t, F.lit(len(template["open"]) + 1), at - 1 - len(template["open"]))
        other = unescape(F.substring(label, F.lit(2), F.length(label)), ROLE_ESCAPES)
        body = F.substring(t, at + len(template["sep"]), F.length(t))
        return F.struct(F.coalesce(F.element_at(labels, label), other).alias("role"), unescape(body).alias("text"))

    pieces = F.split("formatted", template["close"].replace("\n", "\\n"), -1)  # the last is empty
    return formatted.withColumn("turns", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn))


def extra_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold control strings and an escape."""
    text = r"\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def op2_role_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = read_chats(format_chats(rows.unionByName(extra_conversation(spark))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e')) + 15 + length(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'tool' THEN 'Tool'
    ELSE '?' || replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), ': ', '\c') END)) AS BIGINT) AS formatted_chars,
  bool_and((prev || ' ' || role) IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user', 'assistant tool', 'tool assistant') AND (nxt IS NOT NULL OR role = 'assistant')) AS valid
FROM p GROUP BY conv_id
"""
