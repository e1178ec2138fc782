"""Chat formatting of reply trees.

Messages form trees by their parents. Root-to-leaf paths are enumerated by iterative self-joins with doubled
jumps (a path of 1,000 messages takes ten rounds), branches are ranked by the sum of their scores, and every
chosen path becomes one conversation in one string.

Template: ``<s>role[INST]text[/INST]</s>`` per turn. Control strings inside roles and texts get a backslash
after their first character (and one more, if they have some already); reading takes one away, so every text
comes back unchanged. Only column functions are used.

Defined cases: null role and text are empty, an unknown parent makes a root, messages that hang on a cycle
belong to no path, ties in the score go to the smaller leaf, an empty table gives an empty result. A null tree
is a tree like any other. Node numbers must be unique in their tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

_CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"
_END = "[/INST]</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def paths(nodes: DataFrame, per_tree: int | None = None) -> DataFrame:
    """``tree, leaf, node, dist, rank`` of the best ``per_tree`` root-to-leaf paths of each tree (all if None).

    ``nodes``: ``tree`` (not null), ``node``, ``parent``, ``score``. ``dist`` counts from the leaf.
    """
    own = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = own.select("tree", F.col("node").alias("parent"))
    jumps = stage(own.join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")), "llm-jumps")
    parents = jumps.select("tree", F.col("up").alias("node")).distinct()
    walks = stage(
        own.join(parents, ["tree", "node"], "left_anti").select(
            "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")
        ),
        "llm-walks",
    )
    roots = stage(own.join(jumps.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node"), "llm-roots")
    step, size = 1, own.count()
    done = [walks]
    while step <= size:  # beyond that only cycles are left
        far = done[0]
        for more in done[1:]:
            far = far.unionByName(more)
        new = stage(
            far.join(jumps, ["tree", "node"]).select(
                "tree", "leaf", F.col("up").alias("node"), (F.col("dist") + step).alias("dist")
            ),
            "llm-walks",
        )
        if not new.limit(1).count():
            break
        done.append(new)
        next_ = jumps.select("tree", F.col("node").alias("up"), F.col("up").alias("upper"))
        jumps = stage(jumps.join(next_, ["tree", "up"]).select("tree", "node", F.col("upper").alias("up")), "llm-jumps")
        step *= 2
    walked = done[0]
    for more in done[1:]:
        walked = walked.unionByName(more)
    rooted = walked.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    scores = (
        walked.join(own.select("tree", "node", "score"), ["tree", "node"])
        .groupBy("tree", "leaf")
        .agg(F.sum("score").alias("path_score"))
        .join(rooted, ["tree", "leaf"], "left_semi")
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
    best = scores.withColumn("rank", rank)
    if per_tree is not None:
        best = best.where(F.col("rank") <= per_tree)
    return walked.join(best, ["tree", "leaf"])


def format_paths(nodes: DataFrame, per_tree: int | None = None) -> DataFrame:
    """``tree, leaf, rank, path_score, formatted, loss`` for each chosen path.

    ``nodes`` has ``role`` and ``text`` too. ``loss`` has one flag per turn: its text is trained on
    (role ``assistant``).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.concat(F.lit("<s>"), escape(role), F.lit("[INST]"), escape(text), F.lit(_END))
    said = nodes.select("tree", "node", turn.alias("turn"), (role == "assistant").alias("loss"))
    rows = paths(nodes, per_tree).join(said, ["tree", "node"])
    turns = F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "turn", "loss")))
    return (
        rows.groupBy("tree", "leaf", "rank", "path_score")
        .agg(turns.alias("turns"))
        .select(
            "tree", "leaf", "rank", "path_score",
            F.array_join(F.col("turns.turn"), "").alias("formatted"),
            F.col("turns.loss").alias("loss"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """Array of ``role, text`` read back from a formatted conversation."""
    pieces = F.split(formatted, r"\[/INST\]</s>", -1)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(4)), "[INST]", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "[INST]") + 6)).alias("text"),
        ),
    )
