"""Chat formatting of reply trees; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import durable

# The template. Each turn is an opening string, its text and a closing string; roles without strings of
# their own carry their name in the turn.
START = "<s>"
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER_OPEN, OTHER_MIDDLE, OTHER_CLOSE = "[ROLE] ", " [TEXT] ", " [/ROLE]"
#: Control strings without the backslashes that escape them: first character, backslashes, rest.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|OUT\]|TEXT\])"
CONTROL_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|OUT\]|TEXT\])"
CLOSINGS = r" (?:\[/INST\]|</s>|\[/SYS\]|\[/ROLE\])"


def escape(text: Column) -> Column:
    """One backslash more inside whatever reads as a control string; nothing else changes, so it can be undone."""
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL_ESCAPED), F.lit("$1$2$3"))


def reply_paths(messages: DataFrame, top_k: int | None = 1) -> DataFrame:
    """messages (tree_id, msg_id, parent_id, role, text, score) -> (tree_id, leaf_id, path_rank, depth, msg_id, role,
    text), one row per message of each chosen root-to-leaf path, depth from 0.

    Jump tables join to themselves: table k holds each message's 2^k-th ancestor, so a chain of n messages needs
    log2(n) joins. Paths of a tree are ranked by the sum of scores (null: 0), then by the leaf's id; top_k None keeps
    all. A parent that is not among the tree's messages makes a root; messages on or below a cycle have no root and
    are left out; of messages repeated with one id the least by role and text stays. Null ids: a null msg_id can't be
    replied to, so it is dropped; tree_id null is a tree of its own."""
    first = Window.partitionBy("tree_id", "msg_id").orderBy("role", "text", "parent_id")
    m = (
        messages.where("msg_id IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1")
        .select("tree_id", "msg_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        .withColumn("tree", F.coalesce(F.col("tree_id").cast("string"), F.lit("\0")))
    )
    m = durable(m, "chat-messages")
    ids = m.select("tree", F.col("msg_id").alias("id"), F.col("parent_id").alias("up"), "score")
    known = ids.select("tree", F.col("id").alias("up"), F.lit(True).alias("known"))
    # jump: the ancestor 2^k above; gain: the scores of the 2^k messages from id up; steps: how many there are
    jump = durable(
        ids.join(known, ["tree", "up"], "left")
        .select("tree", "id", F.when(F.col("known"), F.col("up")).alias("up"), F.col("score").alias("gain"), F.lit(1).cast("long").alias("steps")),
        "chat-jump",
    )
    # messages that have reached their root leave the recursion and only serve as ancestors
    tables, waiting = [jump], jump.where("up IS NOT NULL").count()
    ended = [jump.where("up IS NULL")]
    while waiting:
        everyone = reduce(DataFrame.unionByName, ended, tables[-1].where("up IS NOT NULL"))
        above = everyone.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("gain").alias("g2"), F.col("steps").alias("s2"))
        jump = durable(
            tables[-1].where("up IS NOT NULL").join(above, ["tree", "up"])
            .select("tree", "id", F.col("up2").alias("up"), (F.col("gain") + F.col("g2")).alias("gain"), (F.col("steps") + F.col("s2")).alias("steps")),
            "chat-jump",
        )
        left = jump.where("up IS NOT NULL").count()
        if left == waiting:  # only cycles and what hangs on them never reach a root
            break
        tables.append(jump)
        ended.append(jump.where("up IS NULL"))
        waiting = left
    rooted = reduce(DataFrame.unionByName, ended).select("tree", "id", F.col("gain").alias("total"), F.col("steps").alias("n"))
    inner = tables[0].where("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    leaves = rooted.join(inner, ["tree", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "id"))
    leaves = leaves.withColumn("path_rank", rank)
    if top_k is not None:
        leaves = leaves.where(F.col("path_rank") <= top_k)
    # from the leaf up: after table k all ancestors less than 2^(k+1) above it are there
    path = durable(leaves.select("tree", F.col("id").alias("leaf_id"), "path_rank", "id", F.lit(0).cast("long").alias("below"), "n"), "chat-path")
    for k, t in enumerate(tables):
        hop = t.where("up IS NOT NULL").select("tree", "id", "up")
        more = path.join(hop, ["tree", "id"]).select("tree", "leaf_id", "path_rank", F.col("up").alias("id"), (F.col("below") + (1 << k)).alias("below"), "n")
        path = path.unionByName(more)
        if k % 3 == 2:
            path = durable(path, "chat-path")
    out = path.join(m.withColumnRenamed("msg_id", "id"), ["tree", "id"])
    return out.select("tree_id", "leaf_id", "path_rank", (F.col("n") - 1 - F.col("below")).alias("depth"), F.col("id").alias("msg_id"), "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, path_rank, depth, role, text) -> one row per path: formatted, and loss_spans, the code-point
    ranges [start, end) of the assistant texts, escaped as they stand, inside it.

    Turn lengths are summed by a window that spills; only the finished conversation is gathered into one string, which
    is what the result is."""
    text, role = escape(F.col("text")), F.col("role")
    opening = F.lit(None).cast("string")
    closing = F.lit(OTHER_CLOSE)
    opening = F.concat(F.lit(OTHER_OPEN), escape(role), F.lit(OTHER_MIDDLE))
    for name, (before, after) in TURNS.items():
        opening = F.when(role == name, F.lit(before)).otherwise(opening)
        closing = F.when(role == name, F.lit(after)).otherwise(closing)
    p = paths.select("tree_id", "leaf_id", "path_rank", "depth", "role", opening.alias("o"), text.alias("t"), closing.alias("c"))
    p = p.withColumn("whole", F.concat("o", "t", "c"))
    before = Window.partitionBy("tree_id", "leaf_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(len(START)) + F.coalesce(F.sum(F.length("whole")).over(before), F.lit(0)) + F.length("o")
    p = p.withColumn("start", start.cast("long"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.length("t")).alias("end")))
    got = p.groupBy("tree_id", "leaf_id").agg(
        F.first("path_rank").alias("path_rank"),
        F.sort_array(F.collect_list(F.struct("depth", "whole", span.alias("span")))).alias("turns"),
    )
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return got.select(
        "tree_id", "leaf_id", "path_rank",
        F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: t["whole"]), "")).alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    body = F.substring(formatted, len(START) + 1, F.length(formatted))
    parts = F.filter(F.split(body, CLOSINGS, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        rest = F.substr(x, F.lit(len(OTHER_OPEN) + 1))
        at = F.instr(rest, OTHER_MIDDLE)
        out = F.struct(
            unescape(F.substr(rest, F.lit(1), at - 1)).alias("role"),
            unescape(F.substr(rest, at + len(OTHER_MIDDLE))).alias("text"),
        )
        for name, (opening, _) in TURNS.items():
            own = F.struct(F.lit(name).alias("role"), unescape(F.substr(x, F.lit(len(opening) + 1))).alias("text"))
            out = F.when(F.startswith(x, F.lit(opening)), own).otherwise(out)
        return out

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
