"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees by their parents.  Iterative self-joins, which double the reach of each step, give every message the
score of its path from the root and its depth; each leaf stands for one root-to-leaf path, a conversation's branches are
ranked by their path scores, and the messages of the chosen paths are found by walking back from their leaves, again by
doubling.  Each chosen path is formatted as one conversation.

The template marks a turn with `<s>[ROLE] ` ... `</s>`, ROLE in capitals between square brackets.  In texts and roles the
control characters `\\`, `<` and `[` become `\\b`, `\\l` and `\\s`, in roles also `|` and `]` become `\\p` and `\\r`, so that no marker can occur
in them; unescaping gives the exact text again.

Defined cases: a null text or role is empty; messages with the same conversation and turn follow each other by role and
text; rows with a null conv_id are one conversation; a parent that does not exist makes its messages roots; messages on a
cycle of parents, or below one, have no root and are left out; a conversation has at least one row; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import materialise


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\s"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("|"), F.lit("\\p")), F.lit("]"), F.lit("\\r"))


def unescape(text: Column) -> Column:
    for code, char in ("\\p", "|"), ("\\r", "]"), ("\\s", "["), ("\\l", "<"), ("\\b", "\\"):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def chain(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    number = F.row_number().over(order)
    return rows.select(
        "conv_id",
        number.cast("long").alias("node"),
        F.when(number > 1, (number - 1).cast("long")).alias("parent"),
        F.lit(1.0).alias("score"),
        "role",
        "text",
    )


def best_paths(tree: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, branch (0 for the best), depth, role and text of the messages of the top-ranked paths of each tree.

    tree: conv_id, node (unique in its tree), parent (null at a root), score, role, text.  Branches with equal path
    scores are ranked by their leaves' nodes.  The loops end after log2(depth) rounds.
    """
    zero = F.lit(0).cast(tree.schema["conv_id"].dataType)
    key = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", zero).alias("id"))  # null equals null
    tree = materialise(tree.withColumn("conv_id", key), "tree")
    links = tree.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    reach = links.select("conv_id", "node", F.col("parent").alias("up"), "score", F.lit(1).cast("long").alias("depth"))
    up = lambda df: df.select(
        "conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2")
    )
    largest = tree.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    hops = []
    while 2 ** len(hops) <= largest:  # a path of more messages than its tree has goes in circles
        active = reach.where(F.col("up").isNotNull())  # only messages that have not reached a root take part in a round
        if active.isEmpty():
            break
        hops.append(active.select("conv_id", "node", "up"))
        moved = active.join(up(reach), ["conv_id", "up"], "left").select(
            "conv_id",
            "node",
            F.col("up2").alias("up"),
            (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"),
            (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
        )
        reach = materialise(reach.where(F.col("up").isNull()).unionByName(moved), "reach")
    reach = reach.where(F.col("up").isNull())
    inner = links.where(F.col("parent").isNotNull()).select("conv_id", F.col("parent").alias("node")).distinct()
    leaves = reach.join(inner, ["conv_id", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "node")) - 1
    path = leaves.withColumn("branch", rank).where(F.col("branch") < top).select("conv_id", "branch", "node")
    for hop in reversed(hops):  # from the leaves: half the path away, a quarter, and so on
        found = path.join(hop, ["conv_id", "node"]).select("conv_id", "branch", F.col("up").alias("node"))
        path = materialise(path.unionByName(found).distinct(), "path")
    return path.join(reach.select("conv_id", "node", "depth"), ["conv_id", "node"]).join(
        tree.select("conv_id", "node", "role", "text"), ["conv_id", "node"]
    ).select(F.when(~F.col("conv_id.none"), F.col("conv_id.id")).alias("conv_id"), "branch", "depth", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """conv_id, branch, formatted and loss_spans: one text for each path, and where in it the loss applies.

    loss_spans: array of (start, length) in code points, one for each assistant turn, of its escaped text.
    """
    turn = F.struct(
        "depth",
        F.concat(F.lit("<s>["), F.upper(escape_role(F.col("role"))), F.lit("|"), escape_role(F.col("role")), F.lit("] ")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("loss"),
    )
    rows = paths.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        body = state["at"] + F.char_length(t["head"])
        size = F.char_length(t["body"]).cast("long")
        span = F.array(F.struct(body.alias("start"), size.alias("length")))
        return F.struct(
            (body + size + 4).alias("at"), F.when(t["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    return rows.select(
        "conv_id",
        "branch",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("</s>"))), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, branch, turns (role, text), loss and formatted: parsed from the formatted text and its loss spans alone."""
    pieces = F.filter(F.split("formatted", "<s>\\["), lambda x: x != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "] ", 1)
        body = F.substring(piece, F.char_length(head) + 3, F.char_length(piece) - F.char_length(head) - 6)
        return F.struct(unescape(F.substring_index(head, "|", -1)).alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "branch", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss"))
