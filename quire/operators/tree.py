"""Trees as adjacency tables: descent, closure, roll-ups, outlines.

Nodes have ``node_id``, ``parent_id`` (null at a root), ``title`` and an
``ordinal`` among siblings.  What a node gets from its ancestors or gives to
them is worked out by pointer doubling: after ``r`` rounds every node knows its
way up for ``2**r`` steps, so a tree of depth ``d`` takes ``log2(d)`` rounds of
joins on the node key, each checkpointed, and no bound is set on rows or depth.
A cycle is an error: it is found when a round finishes no node.

Null titles make null breadcrumbs.  Nodes that no root reaches (a parent that
is not there) have no place in a descent and count as roots in a closure or
roll-up.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import squeeze
from quire.lineage import cut

SEPARATOR = " › "


def _open(state: DataFrame, pointer: str, before: int | None) -> int:
    """Nodes whose way up goes on; fewer than ``before``, or there is a cycle."""
    n = state.where(F.col(pointer).isNotNull()).count()
    if before is not None and n == before > 0:
        raise ValueError(f"{n} nodes are on or below a cycle")
    return n


def _walk(nodes: DataFrame, orphans: bool) -> DataFrame:
    """``node_id, parent_id, title, breadcrumb, path, ids``: titles, ordinals and
    ids from the root down.  Without ``orphans`` nodes that no root reaches are left out."""
    state = cut(nodes.select(
        "node_id", "parent_id", "title", F.col("parent_id").alias("at"), F.col("title").alias("breadcrumb"), F.array("ordinal").alias("path"), F.array("node_id").alias("ids")
    ))
    left = _open(state, "at", None)
    while left:
        up = state.select(F.col("node_id").alias("at"), F.col("at").alias("_at"), F.col("breadcrumb").alias("_b"), F.col("path").alias("_p"), F.col("ids").alias("_i"), F.lit(True).alias("_there"))
        going = state.where("at is not null").join(up, "at", "left" if orphans else "inner")
        there = F.col("_there").isNotNull()
        further = going.select(
            "node_id", "parent_id", "title", F.col("_at").alias("at"), F.when(there, F.concat("_b", F.lit(SEPARATOR), "breadcrumb")).otherwise(F.col("breadcrumb")).alias("breadcrumb"),
            F.when(there, F.concat("_p", "path")).otherwise(F.col("path")).alias("path"), F.when(there, F.concat("_i", "ids")).otherwise(F.col("ids")).alias("ids"),
        )
        state = cut(state.where("at is null").unionByName(further))
        left = _open(state, "at", left)
    return state.drop("at")


def descend(nodes: DataFrame) -> DataFrame:
    """``node_id, parent_id, title, depth, breadcrumb, path`` of every node that
    a root reaches; sorting by ``path`` is pre-order."""
    return _walk(nodes, False).select("node_id", "parent_id", "title", (F.size("path") - 1).alias("depth"), "breadcrumb", "path")


def closure(nodes: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance``, each node with itself included."""
    above = _walk(nodes, True).select(F.col("node_id").alias("descendant"), F.posexplode(F.reverse("ids")).alias("distance", "ancestor"))
    return above.select("ancestor", "descendant", "distance")


def rollup_pages(nodes: DataFrame) -> DataFrame:
    """``node_id, page_start, page_end, subtree_size`` over each subtree (columns
    page_min, page_max).  In round ``r`` a node gives what it gathered from less
    than ``2**r`` steps below to its ancestor ``2**r`` steps above, so nothing
    is counted twice and no list of descendants is made."""
    state = cut(nodes.select("node_id", F.col("parent_id").alias("up"), "page_min", "page_max", F.lit(1).cast("long").alias("n")))
    left = _open(state, "up", None)
    while left:
        given = state.where("up is not null").groupBy(F.col("up").alias("node_id")).agg(F.min("page_min").alias("_low"), F.max("page_max").alias("_high"), F.sum("n").alias("_n"))
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("_up"))
        state = cut(state.join(given, "node_id", "left").join(above, "up", "left").select(
            "node_id", F.col("_up").alias("up"), F.least("page_min", "_low").alias("page_min"), F.greatest("page_max", "_high").alias("page_max"),
            (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
        ))
        left = _open(state, "up", left)
    return state.select("node_id", F.col("page_min").alias("page_start"), F.col("page_max").alias("page_end"), F.col("n").alias("subtree_size"))


def full_text(nodes: DataFrame) -> DataFrame:
    """``node_id, text_full``: titles of each subtree in pre-order, one per line.
    The result itself has a title once for every ancestor; a node's text is one
    value and must fit in memory."""
    placed = _walk(nodes, False).select(F.explode("ids").alias("node_id"), "path", "title")
    lines = F.sort_array(F.collect_list(F.struct("path", "title")))
    return placed.groupBy("node_id").agg(F.array_join(F.transform(lines, lambda x: x["title"]), "\n").alias("text_full"))


def outline(nodes: DataFrame) -> DataFrame:
    """``path, line``: titles indented by depth, blank titles left out."""
    placed = descend(nodes).where(F.trim("title") != "")
    return placed.select("path", F.concat(F.repeat(F.lit("\t"), F.col("depth")), F.trim("title")).alias("line"))


def levels(first: DataFrame, step: str) -> DataFrame:
    """``first`` and what the SQL ``step`` makes of each level in turn, read as
    ``{level}``, until a level has no ``children`` (a column, left out at last).
    Every level is checkpointed; none reads more than the one above it."""
    view, level = f"level_{uuid.uuid4().hex}", cut(first)
    found = level.drop("children")
    while not level.where("children is not null").isEmpty():
        level.createOrReplaceTempView(view)
        level = cut(first.sparkSession.sql(step.format(level=view)))
        found = found.unionByName(level.drop("children"))
    first.sparkSession.catalog.dropTempView(view)
    return found


def flatten_json(documents: DataFrame, column: str) -> DataFrame:
    """Nodes of a nested JSON tree (``title`` and ``children``) with path ids:
    ``doc_id, node_id, parent_id, title, ordinal, depth``."""
    tree = documents.select("doc_id", F.parse_json(F.col(column)).alias("tree")).where("tree is not null")
    first = tree.select(
        "doc_id", F.lit("0").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.expr("try_variant_get(tree, '$.title', 'string')").alias("title"),
        F.lit(0).alias("ordinal"), F.lit(0).alias("depth"), F.expr("try_variant_get(tree, '$.children', 'variant')").alias("children"),
    )
    return levels(first, """
        SELECT w.doc_id, concat(w.node_id, '.', c.pos) AS node_id, w.node_id AS parent_id, try_variant_get(c.value, '$.title', 'string') AS title, c.pos AS ordinal, w.depth + 1 AS depth,
          try_variant_get(c.value, '$.children', 'variant') AS children
        FROM {level} w, LATERAL variant_explode(w.children) c""")


def hierarchy(nodes: DataFrame, parent_kind: str = "part", child_kind: str = "condition", palette: int = 12) -> DataFrame:
    """One row per parent of ``parent_kind``: place, colour index, display title
    and its direct children of ``child_kind`` as an ordered array."""
    kids = (
        nodes.where(F.col("kind") == child_kind).groupBy(F.col("parent_id").alias("node_id"))
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "node_id", "title"))).alias("children"))
    )
    tops = nodes.where(F.col("kind") == parent_kind).select("node_id", "title", "ordinal")
    number = F.col("ordinal") + 1
    display = F.when(F.upper("title").rlike("^(PART|PT)"), F.col("title")).otherwise(F.concat(F.lit("PT "), number.cast("string"), F.lit(" · "), F.col("title")))
    return tops.join(kids, "node_id", "left").select(
        "node_id", "ordinal", display.alias("display_title"), (F.col("ordinal") % palette).cast("int").alias("colour"),
        F.coalesce(F.size("children"), F.lit(0)).alias("n_children"), "children",
    )


def filter_parts(nodes: DataFrame, needle: str, parent_kind: str = "part", child_kind: str = "condition") -> DataFrame:
    """Parents and children whose title holds ``needle`` in any case; a parent
    also stays for a child that does, and then only with such children."""
    hit = F.contains(F.lower("title"), F.lit(needle.lower()))
    kids = nodes.where((F.col("kind") == child_kind) & hit).select("node_id", "parent_id", "title")
    for_kids = kids.select(F.col("parent_id").alias("node_id")).distinct().withColumn("_kept", F.lit(True))
    tops = nodes.where(F.col("kind") == parent_kind).join(for_kids, "node_id", "left").where(hit | F.col("_kept")).select("node_id", "parent_id", "title")
    return tops.unionByName(kids)


def without_parent_kind(nodes: DataFrame, kind: str, excluded: str) -> DataFrame:
    """Nodes of ``kind`` whose parent (if any) is not of kind ``excluded``."""
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("kind").alias("_parent_kind"))
    return nodes.where(F.col("kind") == kind).join(parents, "parent_id", "left").where(F.col("_parent_kind").isNull() | (F.col("_parent_kind") != excluded)).drop("_parent_kind")


def sibling_ordinals(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds ``place``: from 0 among the children of a node, in ``order``."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("parent_id").orderBy(*order)) - 1)


def direct_clauses(nodes: DataFrame, parent_kind: str = "condition", child_kind: str = "clause", width: int = 160) -> DataFrame:
    """``node_id, title, clauses``: titles of the direct children, squeezed and
    cut to ``width`` characters, in sibling order."""
    kids = nodes.where(F.col("kind") == child_kind).groupBy(F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.left(squeeze(F.col("title")), F.lit(width)).alias("t")))).alias("k"))
    return nodes.where(F.col("kind") == parent_kind).select("node_id", "title").join(kids, "node_id", "left").select(
        "node_id", "title", F.coalesce(F.transform("k", lambda x: x["t"]), F.array().cast("array<string>")).alias("clauses")
    )
