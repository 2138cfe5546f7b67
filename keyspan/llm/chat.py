"""Operator 10: conversations from reply trees, with DataFrame functions only.

Messages point at the message they answer. Iterative self-joins double the pointers: after round k every
message knows its ancestor 2**k steps up and the score of the way there, so a tree of depth d takes
log2(d) rounds. Leaves are ranked by the score of their branch, and the chosen leaves walk the stored
pointers back from the longest to the shortest, which names each message on a chosen branch once.
Texts take no part in any of this; they are joined to the chosen branches at the end.

A conversation is written as ``<s>``, then its turns: ``[INST] text [/INST]`` for a user, ``text</s>`` for an
assistant, ``<<SYS>>role<</SYS>>text</s>`` for any other role. A control string inside a text gets one more
backslash after its first character, and reading takes one away, so texts that hold such backslashes survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyspan.session import materialize

CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\]|</?SYS>>)"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>>.*?<</SYS>>.*?</s>|.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, branch, score, node, pos): the messages of the ``top`` best branches of each tree.

    ``nodes`` has tree, node, parent, score, unique in (tree, node). Branch 1 has the largest sum of scores;
    ties go to the longer branch, then to the smaller leaf id. A message whose parent is null, missing or
    itself is a root. Messages on or below a cycle of replies have no way to a root and are in no branch.
    """
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    answers = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")) & (F.col("parent") != F.col("node"))
    state = nodes.join(known, answers, "left").select(
        "tree", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("depth"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    state = materialize(state, "replies")
    parents = state.select("tree", F.col("up").alias("node")).where("node IS NOT NULL").distinct()
    levels: list[DataFrame] = []
    rounds = state.count().bit_length() + 1
    # Only messages that have not reached their root are joined again.
    done, active = state.where("up IS NULL"), state.where("up IS NOT NULL")
    while len(levels) < rounds and not active.isEmpty():
        levels.append(active)
        above = done.unionByName(active).select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"),
            F.col("depth").alias("depth2"), F.col("score").alias("score2"),
        )
        moved = active.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select(
            "tree", "node", F.col("up2").alias("up"),
            (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score"),
        )
        moved = materialize(moved, "replies")
        done, active = done.unionByName(moved.where("up IS NULL")), moved.where("up IS NOT NULL")
    inner = parents.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    leaves = done.join(
        inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti"
    )
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), F.asc("node"))
    path = (
        leaves.withColumn("branch", F.row_number().over(best))
        .where(F.col("branch") <= top)
        .select("tree", "branch", "score", "node", F.col("depth").alias("pos"))
    )
    for k in reversed(range(len(levels))):
        jump = levels[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        here = F.struct("node", "pos")
        there = F.struct(F.col("up").alias("node"), (F.col("pos") - 2**k).alias("pos"))
        path = (
            path.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left")
            .select("tree", "branch", "score", F.explode(F.filter(F.array(here, there), lambda x: x["node"].isNotNull())).alias("x"))
            .select("tree", "branch", "score", "x.node", "x.pos")
        )
    return path


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """One formatted conversation for each chosen branch: (tree, branch, score, formatted, loss).

    ``messages`` has tree (a long), node (a long), parent, role, text, score; other columns are not read.
    ``loss`` lists the spans (start, end in code points) of the assistant texts inside ``formatted``.

    Null texts and roles count as empty, a null score as 0, null trees are one tree. Rows without a node id
    cannot be placed and give no turn. Rows that repeat a node id within a tree are one message (the least
    by parent, role, text, score stays). An empty table gives no rows. A conversation is one value, so its
    texts meet in one row; nothing else of a tree does, however many branches it has.
    """
    rows = messages.where("node IS NOT NULL").groupBy(
        F.col("tree").cast("long").alias("tree"), F.col("node").cast("long").alias("node")
    )
    rows = rows.agg(
        F.min(
            F.struct(
                F.col("parent").cast("long").alias("parent"), F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score"),
            )
        ).alias("m")
    )
    rows = materialize(rows.select("tree", "node", "m.*"), "messages")
    path = branches(rows.select("tree", "node", "parent", "score"), top)
    said = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = path.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
        "tree", "branch", "score", "pos", "role", escape(F.col("text")).alias("body")
    )
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    piece = (
        F.when(user, F.concat(F.lit("[INST] "), "body", F.lit(" [/INST]")))
        .when(assistant, F.concat("body", F.lit("</s>")))
        .otherwise(F.concat(F.lit("<<SYS>>"), escape(F.col("role")), F.lit("<</SYS>>"), "body", F.lit("</s>")))
    )
    before = Window.partitionBy("tree", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("piece", piece).withColumn(
        "start", F.lit(3).cast("long") + F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))
    )
    span = F.when(assistant, F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    return (
        turns.groupBy("tree", "branch")
        .agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("pos", "piece", span.alias("span")))).alias("all"))
        .select(
            "tree", "branch", "score",
            F.concat(F.lit("<s>"), F.array_join(F.col("all.piece"), "")).alias("formatted"),
            F.filter("all.span", lambda s: s.isNotNull()).alias("loss"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role and text of each turn) and ``learned`` (the text under the loss mask), read from the output."""
    pieces = F.regexp_extract_all(F.expr("substring(formatted, 4)"), F.lit(TURN), F.lit(0))

    def turn(p: Column) -> Column:
        head, tail = F.regexp_extract(p, r"(?s)^<<SYS>>(.*?)<</SYS>>", 1), F.regexp_extract(p, r"(?s)^<<SYS>>.*?<</SYS>>(.*)</s>$", 1)

        def said(role: Column, text: Column) -> Column:
            return F.struct(role.alias("role"), unescape(text).alias("text"))

        return (
            F.when(p.startswith("[INST] "), said(F.lit("user"), p.substr(F.lit(8), F.length(p) - 15)))
            .when(p.startswith("<<SYS>>"), said(unescape(head), tail))
            .otherwise(said(F.lit("assistant"), p.substr(F.lit(1), F.length(p) - 4)))
        )

    def under(span: Column) -> Column:
        return F.col("formatted").substr(span["start"].cast("int") + 1, (span["end"] - span["start"]).cast("int"))

    masked = F.transform("loss", lambda s: unescape(under(s)))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("learned", F.array_join(masked, ""))
