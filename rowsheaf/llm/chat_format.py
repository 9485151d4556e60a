"""Reply trees as training conversations: paths from root to leaf, ranked, formatted, and read back.

DataFrame functions only.

The template. A turn is ``### role: text</turn>`` and a line feed. In role and text a backslash is put before
every backslash, ``###`` and the slash of ``</turn>``, in a role also before a colon; dropping the backslash
before any character undoes it. So the end mark never occurs inside a text, nor the start mark unescaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rowsheaf.plans.files import materialise

START, END = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    """``text`` without control strings; :func:`unescape` gives it back."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("###"), F.lit("\\###")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escaped_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def reply_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """All paths from a root to a leaf of every tree, ranked, with the nodes of the chosen ones.

    ``nodes``: ``tree_id``, ``node_id``, ``parent_id`` (null for a root), ``score`` (double, null as 0); other
    columns are dropped. Returns ``tree_id, leaf_id, path_rank, depth, node_id`` for the ``top`` paths of each tree
    (all, if None): highest mean score first, ties to the smaller leaf. ``depth`` is 0 at the root.

    A null ``tree_id`` is a tree like any other, a null ``node_id`` a node that nothing can reply to. Rows that
    repeat a node's id are one node, with the smallest of their parents and the largest of their scores. A node whose
    parent is missing is the root of its own paths. A cycle raises.

    Each node knows an ancestor, and the sum and number of the scores from itself up to there, and takes over what
    that ancestor knows: the table is joined with itself, and the distance doubles, until all know their root. So a
    tree of depth n takes log2(n) joins. Only the chosen leaves are then led back up, over the ancestors of every doubling.
    """
    n = nodes.groupBy("tree_id", "node_id").agg(
        F.min("parent_id").alias("parent_id"), F.max(F.coalesce("score", F.lit(0.0))).alias("score")
    )
    # two structs are equal also where both hold a null
    key = lambda c: F.struct("tree_id", F.col(c).alias("id"))
    n = n.select(key("node_id").alias("node"), F.when(F.col("parent_id").isNotNull(), key("parent_id")).alias("far"), "score")
    n = materialise(n, "reply-nodes")
    known = n.select(F.col("node").alias("far"), F.lit(True).alias("is_there"))
    paths = n.join(known, "far", "left").select(
        "node", F.when(F.col("is_there"), F.col("far")).alias("far"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n")
    )
    paths = materialise(paths, "reply-paths")
    leaves = n.select("node").join(paths.select(F.col("far").alias("node")), "node", "left_anti")
    largest = n.groupBy("node.tree_id").count().agg(F.max("count")).first()[0] or 0

    hops = []  # every node's ancestor at distance 1, 2, 4, ...
    while True:
        open_ends = paths.where("far IS NOT NULL")
        if open_ends.isEmpty():
            break
        if 1 << len(hops) >= largest:
            raise ValueError("the replies of a tree form a cycle")
        hops.append(open_ends.select("node", "far"))
        above = paths.select(F.col("node").alias("far"), F.col("far").alias("next"), F.col("total").alias("more"), F.col("n").alias("longer"))
        longer = open_ends.join(above, "far").select(
            "node", F.col("next").alias("far"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("longer")).alias("n")
        )
        paths = materialise(paths.where("far IS NULL").unionByName(longer), "reply-paths")

    by_score = Window.partitionBy("node.tree_id").orderBy(F.desc(F.col("total") / F.col("n")), "node.id")
    ranked = paths.join(leaves, "node").withColumn("path_rank", F.row_number().over(by_score))
    if top is not None:
        ranked = ranked.where(F.col("path_rank") <= top)
    out = ranked.select(F.col("node.id").alias("leaf_id"), "path_rank", "node", (F.col("n") - 1).alias("depth"))
    out = materialise(out, "reply-chosen")
    for level, hop in enumerate(hops):
        further = out.join(hop, "node").select("leaf_id", "path_rank", F.col("far").alias("node"), (F.col("depth") - (1 << level)).alias("depth"))
        out = materialise(out.unionByName(further), "reply-chosen")
    return out.select("node.tree_id", "leaf_id", "path_rank", "depth", F.col("node.id").alias("node_id"))


def format_turns(turns: DataFrame, keys: list[str], loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``keys``, ``n_turns`` (long), ``formatted`` (the template over its turns) and
    ``loss_mask``, an array of (start, end) in code points of ``formatted``: the texts of ``loss_role``.

    ``turns``: ``keys``, ``position`` (order in the conversation; ties keep an order by role, then text), ``role``
    and ``text`` (null: empty). A conversation is one row, so it must fit a string (2 GB); nothing else is gathered.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), _escaped_role(role), F.lit(": "))
    rows = turns.select(
        *keys, "position", role.alias("role"), text.alias("text"), head.alias("_head"), escape(text).alias("_body")
    )
    order = Window.partitionBy(*keys).orderBy("position", "role", "text")
    piece = F.length("_head") + F.length("_body") + len(END)
    rows = rows.select(
        *keys,
        F.row_number().over(order).alias("_n"),
        F.concat("_head", "_body", F.lit(END)).alias("_piece"),
        (F.col("role") == loss_role).alias("_loss"),
        (F.sum(piece).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END)).alias("_end"),
        F.length("_body").alias("_size"),
    )
    span = F.struct((F.col("_end") - F.col("_size")).alias("start"), F.col("_end").alias("end"))
    gathered = rows.groupBy(*keys).agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("_n", "_piece"))).alias("_pieces"),
        F.sort_array(F.collect_list(F.when(F.col("_loss"), span))).alias("loss_mask"),
    )
    joined = F.array_join(F.col("_pieces._piece"), "")
    return gathered.select(*keys, "n_turns", joined.alias("formatted"), "loss_mask")


def read_turns(formatted: DataFrame, keys: list[str]) -> DataFrame:
    """The turns of :func:`format_turns` read back from the text alone.

    Returns ``keys, position`` (from 0), ``role``, ``text``, ``start`` and ``end`` of the still escaped text.
    """
    parts = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)
    parts = formatted.select(*keys, F.posexplode(parts).alias("position", "_part"))
    before = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("_part") + len(END)).over(before) - len(END)
    # a role has no bare colon, so the first ": " after an unescaped role ends it
    head = F.regexp_extract("_part", r"(?s)^### ((?:[^\\:]|\\.)*): ", 1)
    start = F.length(F.lit(START)) + F.length("_role") + 2
    turns = parts.withColumn("end", end).withColumn("_role", head).withColumn("_skip", start)
    body = F.expr("substring(_part, _skip + 1)")
    return turns.select(
        *keys,
        F.col("position").cast("long").alias("position"),
        unescape(F.col("_role")).alias("role"),
        unescape(body).alias("text"),
        (F.col("end") - F.length("_part") + F.col("_skip")).alias("start"),
        "end",
    )


def read_digests(formatted: DataFrame, keys: list[str]) -> DataFrame:
    """What is read back from formatted conversations, as digests: ``keys, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``. A turn counts as loss where the mask has its very span. Keys may be null."""
    # two structs are equal also where both hold a null
    formatted = formatted.select(F.struct(*keys).alias("_key"), "formatted", "loss_mask")
    turns = read_turns(formatted, ["_key"])
    mask = formatted.select("_key", F.explode("loss_mask").alias("_span"))
    mask = mask.select("_key", F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), F.lit(True).alias("_loss"))
    mask = mask.dropDuplicates(["_key", "start", "end"])
    turns = turns.join(mask, ["_key", "start", "end"], "left")
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    ordered = lambda value: F.array_join(F.sort_array(F.collect_list(value)).getField("v"), "")
    read = turns.groupBy("_key").agg(
        F.count("*").alias("n_turns"),
        F.sha2(ordered(F.struct("position", line.alias("v"))), 256).alias("turns_sha256"),
        ordered(F.when(F.col("_loss"), F.struct("position", F.col("text").alias("v")))).alias("_lost"),
    )
    size = formatted.select("_key", F.length("formatted").cast(T.LongType()).alias("formatted_chars"))
    return read.join(size, "_key").select(
        "_key.*", "n_turns", "turns_sha256", F.length("_lost").cast("long").alias("loss_chars"),
        F.sha2("_lost", 256).alias("loss_sha256"), "formatted_chars",
    )


def format_reply_trees(nodes: DataFrame, top: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """The chosen paths of :func:`reply_paths`, each formatted as one conversation.

    ``nodes`` also holds ``role`` and ``text``. Returns ``tree_id, leaf_id, path_rank, n_turns, formatted, loss_mask``.
    Rows that repeat a node's id are turns after one another, by role, then text. An empty table gives no rows.
    """
    node = F.struct("tree_id", "node_id").alias("_node")
    paths = reply_paths(nodes, top).select(node, "leaf_id", "path_rank", F.col("depth").alias("position"))
    turns = paths.join(nodes.select(node, "role", "text"), "_node")
    turns = turns.select("_node.tree_id", "leaf_id", "path_rank", "position", "role", "text")
    return format_turns(turns, ["tree_id", "leaf_id", "path_rank"], loss_role)


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """``conversations`` (``conv_id, turn, role, text``) as reply trees: each row replies to the one before it.

    Rows of a conversation are taken by turn; equal turns by role, then text, so repeated rows follow each other. The
    rows without a ``conv_id`` are one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node_id"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return rows.select(
        F.col("conv_id").alias("tree_id"), "node_id", parent.alias("parent_id"), F.lit(0.0).alias("score"), "role", "text"
    )
