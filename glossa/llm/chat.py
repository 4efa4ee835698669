"""Chat formatting over reply trees, in DataFrame functions only.

Messages name the message that they reply to. Pointers to the parent are doubled by self-joins: after round k every
message knows its ancestor 2^k replies up, and the score and number of the messages on the way, so a tree of any depth
takes log2 of it rounds. Leaves are ranked within their tree by the mean score of their branch; the chosen ones walk the
kept pointers back down, again doubling, which lists the messages of their paths and no others. Each path is formatted as
one conversation, with a mask of what a model is to learn.

The template writes ``<s>``, then each turn with its marks. A text that holds one of the marks' control strings gets a
backslash behind the string's first character (one more if there are some already), so a plain control string is always a
mark; reading takes one backslash away again. Texts without control strings stay as they are.

Defined cases: null texts and roles are written as empty ones; texts of any length are formatted whole; a message whose
parent is null or absent is a root; a message without an id is never replied to; of rows with one id the first (by role,
text, then place) takes the replies, the others are leaves of their own; branches of equal score go by their leaf's id,
then place; rows of a null tree form one tree; a cycle of replies raises; an empty table gives an empty result; other
columns are ignored. A conversation is one row, so it must fit in memory. In the query, turns go by turn, role, and a hash of
the text, repeated ones included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clip_columns, staged, table
from .sharding import global_rank

START = "<s>"
#: Marks before and behind the text of a turn, by role. Other roles are written out between two marks.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
OTHER = ("[TURN]", "[TURN]", "[/TURN]")
LEARNED = "assistant"
#: A control string of the marks: its first character, backslashes, and the rest.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|TURN\]))"
ENDS = r"(?<=\[/INST\]|\[/SYS\]|</s>|\[/TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def by_role(role: Column, which: int, other: Column) -> Column:
    chosen = F
    for name, marks in MARKS.items():
        chosen = chosen.when(role == name, F.lit(marks[which]))
    return chosen.otherwise(other)


def formatted(turns: str) -> tuple[Column, Column]:
    """The conversation of an array of (role, text), and its mask: (turn, start, end) in code points, end exclusive."""
    def piece(t: Column) -> Column:
        named = F.concat(F.lit(OTHER[0]), escape(t["role"]), F.lit(OTHER[1]))
        return F.struct(by_role(t["role"], 0, named).alias("open"), escape(t["text"]).alias("body"), by_role(t["role"], 1, F.lit(OTHER[2])).alias("close"), (t["role"] == LEARNED).alias("learned"))

    pieces = F.transform(turns, piece)
    whole = F.concat(F.lit(START), F.array_join(F.transform(pieces, lambda p: F.concat(p["open"], p["body"], p["close"])), ""))
    lengths = F.transform(pieces, lambda p: F.struct(F.length(p["open"]).alias("a"), F.length(p["body"]).alias("b"), F.length(p["close"]).alias("c"), p["learned"].alias("learned")))
    none = F.array().cast("array<struct<turn:int,start:int,end:int>>")

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + p["a"]
        span = F.array(F.struct(s["turn"].alias("turn"), start.alias("start"), (start + p["b"]).alias("end")))
        return F.struct((start + p["b"] + p["c"]).alias("at"), (s["turn"] + 1).alias("turn"), F.when(p["learned"], F.concat(s["mask"], span)).otherwise(s["mask"]).alias("mask"))

    mask = F.aggregate(lengths, F.struct(F.lit(len(START)).alias("at"), F.lit(0).alias("turn"), none.alias("mask")), step, lambda s: s["mask"])
    return whole, mask


def read_turns(conversation: str) -> Column:
    """The formatted turns of a conversation, marks and all."""
    parts = F.split(F.substr(F.col(conversation), F.lit(len(START) + 1)), ENDS, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_turn(turn: Column) -> Column:
    """(role, text) of a formatted turn."""
    def between(a: str, b: str) -> Column:
        return unescape(F.substr(turn, F.lit(len(a) + 1), F.length(turn) - len(a) - len(b)))

    out = F
    for name, (a, b) in MARKS.items():
        out = out.when(F.startswith(turn, F.lit(a)), F.struct(F.lit(name).alias("role"), between(a, b).alias("text")))
    opening, again, closing = OTHER
    rest = F.substr(turn, F.lit(len(opening) + 1), F.length(turn) - len(opening) - len(closing))
    cut = F.instr(rest, again)
    return out.otherwise(F.struct(unescape(F.substr(rest, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(rest, cut + len(again))).alias("text")))


def learned_text(turns: str, mask: str) -> Column:
    """What lies under the mask, without escapes, one span behind the other. turns: as read_turns gives them."""
    step = lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + F.length(t)))
    starts = F.aggregate(turns, F.array(F.lit(len(START))), step)
    # the offsets go along as the carried value of the fold, so they are made once
    start = F.struct(starts.alias("starts"), F.array().cast("array<string>").alias("found"))

    def take(s: Column, m: Column) -> Column:
        text = F.substr(F.get(F.col(turns), m["turn"]), m["start"] - F.get(s["starts"], m["turn"]) + 1, m["end"] - m["start"])
        return F.struct(s["starts"].alias("starts"), F.concat(s["found"], F.array(unescape(text))).alias("found"))

    return F.aggregate(mask, start, take, lambda s: F.array_join(s["found"], ""))


def branches(spark: SparkSession, replies: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every message with its depth and the total score of its path; and the doubled pointers (row, up) round by round.

    replies: (row, up, score), up the row of the parent or null.
    """
    state = replies.select("row", "up", F.lit(1).cast("long").alias("depth"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    n, ended, going = replies.count(), [state.where("up is null")], staged(spark, state.where("up is not null"), "pointers")
    jumps = []
    while going.limit(1).count():
        if 1 << len(jumps) > n:
            raise ValueError("the replies form a cycle")
        jumps.append(going.select("row", "up"))
        # only messages that aren't at their root yet are joined and written again
        above = reduce(DataFrame.union, [*ended, going]).select(F.col("row").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        moved = staged(spark, going.join(above, "up").select("row", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total")), "pointers")
        ended.append(moved.where("up is null"))
        going = moved.where("up is not null")
    return reduce(DataFrame.union, ended).select("row", "depth", "total"), jumps


def conversations(spark: SparkSession, messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, branch, score, n_turns, conversation, mask): the best branches of every tree, or all of them, best first.

    messages: tree, id, parent, role, text, score.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = messages.select("tree", "id", "parent", text("role").alias("role"), text("text").alias("text"), "score").withColumn("row", F.monotonically_increasing_id())
    rows = staged(spark, rows, "messages")
    first = rows.where("id is not null").groupBy("id").agg(F.min_by("row", F.struct("role", F.xxhash64("text"), "row")).alias("up"))
    named = rows.where("parent is not null").select("row", "score", F.col("parent").alias("id")).join(first, "id", "left").select("row", "up", "score")
    replies = staged(spark, named.union(rows.where("parent is null").select("row", F.lit(None).cast("long"), "score")), "parents")
    paths, jumps = branches(spark, replies)
    leaves = paths.join(replies.where("up is not null").select(F.col("up").alias("row")), "row", "left_anti").join(rows.select("row", "tree", "id"), "row")
    leaves = staged(spark, leaves.select("tree", (F.col("total") / F.col("depth")).alias("score"), "id", F.col("row").alias("leaf")), "branches")
    ranked = staged(spark, global_rank(spark, leaves, [F.col("tree"), F.desc("score"), F.col("id"), F.col("leaf")], "rank"), "ranked")
    firsts = ranked.groupBy("tree").agg(F.min("rank").alias("first")).withColumnRenamed("tree", "_tree")
    chosen = ranked.join(firsts, F.col("tree").eqNullSafe(F.col("_tree"))).withColumn("branch", F.col("rank") - F.col("first")).select("tree", "branch", "score", "leaf")
    chosen = staged(spark, chosen if best is None else chosen.where(F.col("branch") < best), "chosen")
    parts = [chosen.select("leaf", F.col("leaf").alias("row"), F.lit(0).cast("long").alias("back"))]
    for k, jump in enumerate(jumps):
        further = reduce(DataFrame.union, parts).join(jump, "row").select("leaf", F.col("up").alias("row"), (F.col("back") + (1 << k)).alias("back"))
        parts.append(staged(spark, further, "paths"))
    path = reduce(DataFrame.union, parts)
    turns = path.join(rows.select("row", "role", "text"), "row").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns"))
    whole, mask = formatted("turns")
    out = chosen.join(turns, "leaf")
    return out.select("tree", "branch", "score", F.size("turns").cast("long").alias("n_turns"), whole.alias("conversation"), mask.alias("mask"))


def as_messages(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Conversations without replies as trees: each turn replies to the one before it. turns: conv_id, turn, role, text."""
    numbered = staged(spark, turns.withColumn("_tie", F.monotonically_increasing_id()), "turns")
    order = numbered.withColumn("_h", F.xxhash64("text")).select("conv_id", "turn", "role", "_h", "_tie")
    placed = staged(spark, global_rank(spark, order, [F.col(c) for c in order.columns], "id"), "placed")
    # a conversation's first turn replies to nothing: it is the least id of its conversation
    firsts = placed.groupBy("conv_id").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("_first"))
    ids = placed.join(firsts, "id", "left").select("_tie", "id", F.when(F.col("_first").isNull(), F.col("id") - 1).alias("parent"))
    return numbered.join(ids, "_tie").select(F.col("conv_id").alias("tree"), "id", "parent", "role", "text", F.lit(0.0).alias("score"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = clip_columns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = staged(spark, conversations(spark, as_messages(spark, given.union(added))), "conversations")
    read = out.select("tree", "conversation", "mask", read_turns("conversation").alias("parts"))
    read = read.select("tree", "conversation", F.size("parts").cast("long").alias("n_turns"), F.transform("parts", read_turn).alias("turns"), learned_text("parts", "mask").alias("learned"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), "n_turns", F.sha2(said_all, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("conversation").cast("long").alias("formatted_chars"),
    )


#: op12 for DuckDB, from the turns themselves and the lengths of marks and escapes.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(t)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
p AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|SYS\]|TURN\])')) AS n, length(role) + len(regexp_extract_all(role, '[<\[]\\*/?(?:s>|INST\]|SYS\]|TURN\])')) AS r FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5 ELSE r + 19 END))::BIGINT AS formatted_chars FROM p GROUP BY conv_id
"""
