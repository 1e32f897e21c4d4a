"""Chat formatting of reply trees: paths by iterative self-joins, best branches, one text a path.

Messages form trees by ``parent``.  Every message's 2^i-th ancestor comes from a self-join of the
2^(i-1)-th ones, and the members of the root-to-leaf paths double with it: after round i a leaf
knows its 2^i nearest ancestors, so a path of length n takes log2 n joins.  Each round writes only the
members that it adds.  Branches are ranked within their tree by the sum of their messages' scores (ties:
the longer path, then the smaller leaf id), and each chosen branch becomes one text:

    <s>[INST] role [/INST] text</s>  for every message, one after another

Control strings inside roles and texts get a backslash after their first character (one more,
where backslashes stand there already), so the template's own marks are the only ones in the
output and reading back removes exactly that backslash.  ``loss`` holds the spans (code points,
end exclusive) of the assistant texts in the output.

Defined cases: null role or text: empty; a null tree (conv_id) is a tree like others, all its rows
one; very long texts are one value, as others are; a parent that is missing makes a root; a null turn comes first; a table without rows gives none;
messages of a cycle reach no root and are left out; other columns are ignored, whatever their names.
Rows of equal turn are ordered by role, then text; exact repeats are separate messages.  The text of
one path is put together in one task, as it is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Fixed marks of the template: <s> </s> [INST] [/INST] <<SYS>> <</SYS>>
_TAIL = r"(?=/?s>|/?INST\]|</?SYS>>)"
BEGIN, ROLE_END, END = "<s>[INST] ", " [/INST] ", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)" + _TAIL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)\\" + _TAIL, "$1")


def paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """tree, leaf, msg, up (steps above the leaf) for every root-to-leaf path.

    ``messages`` has tree, msg (unique in its tree) and parent.
    """
    # joins never match null trees, but structs that hold them
    nodes = messages.select(F.struct("tree").alias("tree"), "msg", "parent")
    known = nodes.select("tree", F.col("msg").alias("parent"), F.lit(True).alias("_there"))
    # the ancestor 2^i steps up, null beyond the root
    jump = scratch.write(
        nodes.join(known, ["tree", "parent"], "left").select("tree", "msg", F.when(F.col("_there"), F.col("parent")).alias("up")),
        "jump0",
    )
    inner = jump.filter(F.col("up").isNotNull()).select("tree", F.col("up").alias("msg")).distinct()
    member = scratch.write(
        jump.join(inner, ["tree", "msg"], "left_anti").select("tree", F.col("msg").alias("leaf"), "msg", F.lit(0).cast("long").alias("up")), "member0"
    )
    step, i = 1, 0
    n = jump.count()
    hop = jump.filter(F.col("up").isNotNull())
    while step <= n and not hop.isEmpty():
        i += 1
        more = member.join(hop.withColumnRenamed("up", "_to"), ["tree", "msg"]).select(
            "tree", "leaf", F.col("_to").alias("msg"), (F.col("up") + step).alias("up")
        )
        member = member.unionByName(scratch.write(more, f"member{i}"))
        step *= 2
        to = hop.select("tree", F.col("msg").alias("up"), F.col("up").alias("_next"))
        further = hop.join(to, ["tree", "up"]).select("tree", "msg", F.col("_next").alias("up"))
        hop = scratch.write(further, f"jump{i}")
    return member.withColumn("tree", F.col("tree.tree"))


def best_paths(messages: DataFrame, member: DataFrame, top: int | None = 1) -> DataFrame:
    """Members of the ``top`` best branches of each tree (None: of all), with role, text and rank."""
    key, plain = F.struct("tree").alias("tree"), F.col("tree.tree")
    told = member.withColumn("tree", key).join(messages.select(key, "msg", "role", "text", "score"), ["tree", "msg"])
    if top is None:
        return told.withColumn("tree", plain)
    rank = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("n"), "leaf")
    branches = told.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("n"))
    chosen = branches.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top)
    return told.join(chosen.select("tree", "leaf", "rank"), ["tree", "leaf"]).withColumn("tree", plain)


def format_paths(told: DataFrame) -> DataFrame:
    """One row for each path: tree, leaf, formatted, loss (spans of assistant texts in it)."""
    text = escape(F.coalesce("text", F.lit("")))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(BEGIN), escape(role), F.lit(ROLE_END))
    path = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("turn")).over(path)
    turns = told.select(
        "tree", "leaf", "up", F.concat(head, text, F.lit(END)).alias("turn"), F.length(head).alias("head"), (role == "assistant").alias("taught")
    )
    placed = turns.withColumn("to", end - len(END)).withColumn("from", F.col("to") + len(END) - F.length("turn") + F.col("head"))
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("k"), "turn", "taught", "from", "to")))
    return placed.groupBy("tree", "leaf").agg(in_order.alias("t")).select(
        "tree", "leaf",
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["taught"]), lambda x: F.struct(x["from"].alias("start"), x["to"].alias("end"))).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    pieces = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    def turn(x):
        cut = F.locate(ROLE_END, x)
        return F.struct(
            unescape(x.substr(F.lit(len(BEGIN) + 1), cut - len(BEGIN) - 1)).alias("role"),
            unescape(x.substr(cut + len(ROLE_END), F.length(x))).alias("text"),
        )

    return F.transform(pieces, turn)


def taught_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as trees of one branch: each row replies to the one before it."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(by_turn).cast("long")
    return conversations.select("conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("tree"), at.alias("msg"), (at - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def op10_chat_trees(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark, "chats")
    messages = scratch.write(chains(rows.unionByName(extra)), "messages")
    out = format_paths(best_paths(messages, paths(messages, scratch)))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = out.withColumns({"turns": read_back(F.col("formatted")), "taught": taught_text(F.col("formatted"), F.col("loss"))}).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("taught").cast("long").alias("loss_chars"), F.sha2("taught", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return scratch.settled(read)[0]
