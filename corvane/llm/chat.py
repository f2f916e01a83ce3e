"""Operator 3 [native]: reply trees and their formatting.

Iterative self-joins with doubled steps give each message its root, depth and summed score, and then each chosen leaf its
whole path: a tree of depth d takes about log2(d) joins up and as many down. Branches are ranked by score, and each
chosen path is formatted as one conversation.

The template writes a turn as "### ", role, newline, text, "</turn>" and newline. In roles and texts "\\", "<" and "#" are
written as "\\b", "\\l" and "\\h" (and a newline in a role as "\\n"), so no text can hold a control string, and reading back
undoes it. The loss mask is a list of spans (start, length) in code points of the formatted string, one for each
assistant text.

Nulls: a null text or role is empty; messages with a null conversation make one conversation of id null; null turns come
first. Repeated rows and equal turns all count, ordered by role and text. An empty table gives no conversations. Messages
whose parent does not exist are roots; a cycle is an error. Other columns are not read. A conversation is one row of the
output, so it must fit in one string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TURN, END, LEARNED = "### ", "</turn>\n", "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def paths(messages: DataFrame, keep: int = 1, rounds: int = 40) -> DataFrame:
    """(tree, leaf, branch, node, up): the messages on the best root-to-leaf paths of each tree, branch 1 first; up counts from the leaf.

    messages: tree (not null), node, parent, score. Best is the largest summed score, then the longest, then the leaf of the smallest node."""
    nodes = cut(messages.select("tree", "node", "parent", "score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("to"), F.lit(1).cast("long").alias("depth"), F.col("score").cast("double").alias("total"))
    steps = [cut(linked)]
    while not steps[-1].where("to is not null").isEmpty():
        if len(steps) > rounds:
            raise ValueError("messages reply to each other in a cycle")
        # Only messages below a root's children have a step to double; others stay as they are.
        above = steps[-1].select("tree", F.col("node").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("total").alias("added"))
        met = steps[-1].where("to is not null").join(above, ["tree", "to"])
        steps.append(cut(met.select("tree", "node", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("added")).alias("total")).union(steps[-1].where("to is null"))))
    leaves = steps[-1].join(nodes.where("parent is not null").select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    if keep == 1:
        best = leaves.groupBy("tree").agg(F.max(F.struct("total", "depth", (-F.col("node")).alias("last"))).alias("m")).select("tree", (-F.col("m.last")).alias("leaf"), F.lit(1).alias("branch"))
    else:
        order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
        best = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= keep).select("tree", F.col("node").alias("leaf"), "branch")
    found = cut(best).select("tree", "leaf", "branch", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k in range(len(steps) - 2, -1, -1):
        onward = steps[k].where("to is not null").select("tree", "node", "to")
        # Cut, as each turn has the one before it twice.
        found = cut(found.union(found.join(onward, ["tree", "node"]).select("tree", "leaf", "branch", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))))
    return found


def format(messages: DataFrame, keep: int = 1) -> DataFrame:  # noqa: A001
    """(tree, branch, formatted, loss): each chosen path as one string, and its loss spans.

    messages: tree (not null), node, parent, role, text, score."""
    chosen = paths(messages, keep).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(TURN), F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turn = chosen.select("tree", "branch", "up", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role") == LEARNED, F.lit(False)).alias("learned"))
    size = (F.length("head") + F.length("body") + len(END)).cast("long")
    placed = turn.withColumn("end", F.sum(size).over(Window.partitionBy("tree", "branch").orderBy(F.desc("up"))))
    span = F.struct((F.col("end") - len(END) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length"))
    told = placed.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct("end", F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("learned"), span).alias("span")))).alias("turns"))
    return told.select("tree", "branch", F.array_join(F.col("turns.turn"), "").alias("formatted"), F.array_compact(F.col("turns.span")).alias("loss"))


def read(formatted: DataFrame) -> DataFrame:
    """(tree, branch, at, role, text, learned, spans, formatted_chars): the turns, read back from the strings; learned where a loss span covers just this turn's text."""
    pieces = formatted.select("tree", "branch", F.length("formatted").cast("long").alias("formatted_chars"), F.size("loss").alias("spans"), F.posexplode(F.split("formatted", END)).alias("at", "piece")).where("piece <> ''")
    line = F.instr("piece", "\n")
    before = F.sum((F.length("piece") + len(END)).cast("long")).over(Window.partitionBy("tree", "branch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    turns = pieces.select("tree", "branch", "at", "spans", "formatted_chars", F.substr("piece", F.lit(len(TURN) + 1), line - len(TURN) - 1).alias("role"), F.substr("piece", line + 1).alias("body"), (F.coalesce(before, F.lit(0)) + line).alias("start"))
    loss = formatted.select("tree", "branch", F.explode("loss").alias("s")).select("tree", "branch", "s.start", "s.length", F.lit(True).alias("learned"))
    met = turns.withColumn("length", F.length("body").cast("long")).join(loss, ["tree", "branch", "start", "length"], "left")
    role = unescape(F.replace(F.col("role"), F.lit("\\n"), F.lit("\n")))
    return met.select("tree", "branch", "at", role.alias("role"), unescape(F.col("body")).alias("text"), F.coalesce("learned", F.lit(False)).alias("learned"), "spans", "formatted_chars")


def linear(conversations: DataFrame) -> DataFrame:
    """The messages of conversations (conv_id, turn, role, text): each turn replies to the one before it. An assistant turn scores the code points of its text."""
    rows = conversations.select("conv_id", "turn", "role", "text", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"))
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    return rows.withColumn("node", F.row_number().over(order).cast("long")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.when(F.col("role") == LEARNED, F.length("text").cast("double")).otherwise(0.0))


def digests(turns: DataFrame) -> DataFrame:
    """(tree, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what read() gives."""
    told = turns.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "learned"))).alias("t"), F.max("spans").alias("spans"), F.max("formatted_chars").alias("formatted_chars"))
    learned = F.filter("t", lambda x: x["learned"])
    checked = F.when(F.size(learned) == F.col("spans"), F.array_join(F.transform(learned, lambda x: x["text"]), "")).otherwise(F.raise_error(F.lit("the loss mask covers more than assistant texts")).cast("string"))
    told = told.withColumn("loss", checked)
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return told.select("tree", "branch", F.size("t").cast("long").alias("n_turns"), F.sha2(F.encode(whole, "utf-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"), "formatted_chars")
