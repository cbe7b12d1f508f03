"""Chat formatting from reply trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.common import store

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of one path that meet in the first of two gathering steps.
BLOCK = 64


def escape(text: Column) -> Column:
    """No ``<|`` is left: every ``<``, backslashes, ``|`` gets one more backslash."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, and the role stays on its line."""
    marked = F.regexp_replace(escape(role), r"<(\\*)n>", r"<\\$1n>")
    return F.regexp_replace(marked, "\n", "<n>")


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(role, "<n>", "\n")
    return unescape(F.regexp_replace(lines, r"<\\(\\*)n>", r"<$1n>"))


def best_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` highest-scored root-to-leaf paths of every tree.

    ``nodes``: tree, node (unique bigint), parent (null at a root), score. Self-joins
    double the known stretch of every path, so a tree of depth d takes log2(d) rounds
    and only nodes whose path goes on take part in the next one. A branch scores the
    sum over its nodes; ties go to the smaller leaf. Returns tree, path (its leaf),
    place (1, 2, ...), depth (0 at the root), node. A parent that is no node makes
    its child a root; a cycle raises ValueError; null scores count as 0.
    """
    known = nodes.select(F.col("node").alias("_known"))
    sum_ = F.coalesce("score", F.lit(0)).cast("double").alias("sum")
    # Roots, of which there is one a tree, would all meet under one null.
    roots, replies = nodes.where("parent is null"), nodes.where("parent is not null")
    linked = replies.join(known, replies["parent"] == known["_known"], "left").select("tree", "node", F.col("_known").alias("up"), sum_)
    step = store(linked.unionByName(roots.select("tree", "node", F.lit(None).cast(known.schema["_known"].dataType).alias("up"), sum_)))
    parents = step.where("up is not null").select(F.col("up").alias("node")).distinct()
    total = nodes.count()
    done, jumps, length = [], [], 1
    open_ = step
    while True:
        done.append(open_.where("up is null").select("tree", "node", "sum"))
        going = open_.where("up is not null")
        jumps.append(going.select("node", "up"))
        if going.isEmpty():
            break
        if length > total:
            raise ValueError("the reply links run in a circle")
        # A node's stretch ends before `up`; that node's own stretch continues it.
        far = step_all(done, going).select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"))
        open_ = store(going.join(far, "up").select("tree", "node", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum")))
        length *= 2
    ended = step_all(done)
    leaves = ended.join(parents, "node", "left_anti")
    ranked = leaves.withColumn("place", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("sum"), "node")))
    path = store(ranked.where(F.col("place") <= best).select("tree", F.col("node").alias("path"), "place", "node", F.lit(0).cast("bigint").alias("_back")))
    length = 1
    for jump in jumps[:-1]:
        further = path.join(jump, "node").select("tree", "path", "place", F.col("up").alias("node"), (F.col("_back") + length).alias("_back"))
        path = store(path.unionByName(further))
        length *= 2
    depths = path.groupBy("path").agg(F.max("_back").alias("_longest"))
    return path.join(depths, "path").select("tree", "path", "place", (F.col("_longest") - F.col("_back")).alias("depth"), "node")


def step_all(done: list[DataFrame], going: DataFrame | None = None) -> DataFrame:
    """All nodes with what is known of their paths; settled ones have no ``up``."""
    out = going.select("node", "up", "sum", "tree") if going is not None else None
    for d in done:
        d = d.select("node", F.lit(None).cast("bigint").alias("up"), "sum", "tree")
        out = d if out is None else out.unionByName(d)
    return out


def format_paths(turns: DataFrame) -> DataFrame:
    """One conversation per path: every turn marked, control strings escaped.

    ``turns``: path, depth, role, text. Returns path, formatted. Blocks of turns are
    joined before a path's blocks meet, so a long path arrives pre-aggregated.
    """
    turn = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    blocks = turns.groupBy("path", (F.col("depth") / BLOCK).cast("bigint").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("depth", turn.alias("said")))).alias("said")
    ).select("path", "block", F.array_join(F.col("said.said"), "").alias("said"))
    return blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "said"))).alias("said")).select(
        "path", F.array_join(F.col("said.said"), "").alias("formatted")
    )


def read_turns(formatted: Column) -> Column:
    """Back from ``formatted``: an array of (role, text); the loss lies on assistant texts."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        body = p.substr(cut + 1, F.length(p) - cut - len(END) - 1)
        return F.struct(unescape_role(p.substr(F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(turns: Column) -> Column:
    """The text under the loss mask: each assistant text once, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """Format flat conversations (conv_id, turn, role, text) as chains of replies.

    Every row replies to the row before it in its conversation (by turn; ties by
    role, then by a hash of the text, so repeated rows all stay). Null texts and roles are empty, a
    null conv_id is one conversation of its own, null turns come first, an empty
    table gives none. Returns conv_id, formatted. Other columns are ignored.
    """
    from tidewire.operators.ordering import number_rows

    narrow = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = store(number_rows(narrow.withColumn("_hash", F.xxhash64("text")), ["conv_id", "turn", "role", "_hash"], "node"))
    first = numbered.groupBy("conv_id").agg(F.min("node").alias("_first")).select("_first")
    nodes = numbered.join(first, numbered["node"] == first["_first"], "left").select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("_first").isNull(), F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score")
    )
    chosen = best_paths(nodes)
    turns = chosen.join(numbered.select("node", "role", "text"), "node").select("path", "depth", "tree", "role", "text")
    said = format_paths(turns)
    trees = chosen.where("depth = 0").select("path", F.col("tree").alias("conv_id"))
    return said.join(trees, "path").select("conv_id", "formatted")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted text back gives."""
    return formatted.withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", loss_text(F.col("_turns"))).select(
        "conv_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
