"""Chat formatting over reply trees, with DataFrame operations only.

A tree is a set of messages that point at their parents. ``branch_paths`` finds, by iterative self-joins, the path from
the root to each chosen leaf; the joins double the distance they span, so a path of n messages takes log2(n) of them.
``format_conversations`` renders each chosen path as one conversation with a loss mask, and ``read_back`` undoes it.

Defined results:

* a parent that is null or isn't in the tree makes its message a root; messages on or below a cycle are left out;
* a null text or role is an empty string; a null tree id or node id leaves the message out;
* repeated (tree, node) rows count once (the smallest by parent, role and text is used);
* equal scores: the longer branch goes first, then the smaller leaf id; null scores rank last;
* an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postline.llm.common import cut

#: The template. Inside texts, the two characters that start a control string are written as codes.
HEAD, AFTER_ROLE, END = "### ", ":\n", "</turn>\n"
CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_CODE = (":", "\\c")
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """text without any ``#``, ``<`` or lone backslash, so that it can't hold a control string."""
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``. Every backslash starts a code there, so the order of the replacements loses nothing."""
    for plain, code in (ROLE_CODE, *reversed(CODES)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def branch_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, depth) of each message on the ``branches`` best root-to-leaf paths of each tree.

    nodes: tree, node, parent and score (any numbers that compare). Depth 0 is the root.
    """
    links = cut(
        nodes.filter("tree IS NOT NULL AND node IS NOT NULL")
        .groupBy("tree", "node")
        .agg(F.min(F.struct("parent", "score")).alias("m"))
        .select("tree", "node", "m.parent", "m.score")
    )
    ids = links.select("tree", F.col("node").alias("parent"))
    jump = cut(links.select("tree", "node", "parent").join(ids, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up")))
    jumps = []
    most = links.count()
    while (1 << len(jumps)) <= most and not jump.isEmpty():
        jumps.append(jump)
        further = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = cut(jump.join(further, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up")))
    # what still has an ancestor that far up is on or below a cycle
    looped = jump.select("tree", "node")
    parents = links.select("tree", F.col("parent").alias("node")).distinct()
    leaves = links.join(parents, ["tree", "node"], "left_anti").join(looped, ["tree", "node"], "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "score", "node", F.lit(0).cast("bigint").alias("back"))
    depths = climb(leaves, jumps, every=False).select("tree", "leaf", "score", F.col("back").alias("depth"))
    best = Window.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), F.col("depth").desc(), "leaf")
    chosen = cut(depths.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches))
    paths = climb(chosen.select("tree", "leaf", "depth", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("back")), jumps, every=True)
    return paths.select("tree", "leaf", "node", (F.col("depth") - F.col("back")).alias("depth"))


def climb(paths: DataFrame, jumps: list[DataFrame], every: bool) -> DataFrame:
    """paths with each row's ancestors too (every), or moved up to its root. One self-join for each doubled distance."""
    for k in reversed(range(len(jumps))):
        hop = paths.join(jumps[k], ["tree", "node"], "inner" if every else "left")
        step = F.lit(1 << k).cast("bigint")
        if every:
            up = hop.withColumns({"node": F.col("up"), "back": F.col("back") + step}).drop("up")
            paths = cut(paths.unionByName(up.select(paths.columns)))
        else:
            paths = hop.withColumns({"node": F.coalesce("up", "node"), "back": F.col("back") + F.when(F.col("up").isNotNull(), step).otherwise(0)}).drop("up")
    return paths if every or not jumps else cut(paths)


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row for each chosen path of each tree: tree, leaf, n_turns, formatted, and loss.

    messages: tree, node, parent, role, text, score. loss: the turn's index, and the start and length in code points of
    the escaped text in ``formatted`` that is trained on, for each assistant turn.
    """
    paths = branch_paths(messages, branches)
    said = (
        messages.groupBy("tree", "node")
        .agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
        .select("tree", "node", "m.role", "m.text")
    )
    head = F.concat(F.lit(HEAD), F.replace(escaped(F.col("role")), F.lit(ROLE_CODE[0]), F.lit(ROLE_CODE[1])), F.lit(AFTER_ROLE))
    parts = paths.join(said, ["tree", "node"]).select("tree", "leaf", "depth", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + F.lit(len(END))
    placed = parts.withColumn("start", F.coalesce(F.sum(size.cast("bigint")).over(before), F.lit(0)) + F.char_length("head"))
    span = F.struct(F.col("depth").cast("bigint").alias("turn"), F.col("start"), F.char_length("body").cast("bigint").alias("length"))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("shown"))
    return placed.groupBy("tree", "leaf").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["shown"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == TRAINED_ROLE, span))).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text): no text holds a control string, so cutting is exact."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    at = lambda p: F.instr(p, F.lit(AFTER_ROLE))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substr(p, F.lit(len(HEAD) + 1), at(p) - F.lit(len(HEAD) + 1))).alias("role"),
            unescaped(F.substr(p, at(p) + F.lit(len(AFTER_ROLE)))).alias("text"),
        ),
    )


def under_mask(formatted: Column, loss: Column) -> Column:
    """All text under a loss mask, cut out of the formatted conversation by the mask's starts and lengths, and unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
