"""Hierarchies as edge tables (node, parent), a null parent for roots.

Jobs climb by doubling: after k rounds every node knows what its 2**k nearest ancestors tell it, and its 2**k-th
ancestor. A tree of any depth takes log2(depth) rounds, each a join of two tables as large as the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.scratch import Scratch


def _rounds(scratch: Scratch, name: str, state: DataFrame, step) -> Iterator[DataFrame]:
    """state, then step(state) of each table before, all written, while an open node (`up` not null) has ancestors
    left to ask: nodes still open after log2 of all nodes lead into a cycle."""
    state = scratch.save(state, f"{name}-0")
    left, k = state.count().bit_length() + 1, 0
    yield state
    while left and not state.where("up is not null").isEmpty():
        left, k = left - 1, k + 1
        state = scratch.save(step(state), f"{name}-{k}")
        yield state


def climb(nodes: DataFrame, scratch: Scratch, name: str = "climb") -> DataFrame:
    """(node, value, up) for nodes (node, parent, value), one row for each node: the nearest value that isn't null
    on the way up, the node's own first. Where there is none, value is null, and up is null if the way ends, or
    a node on the cycle that it leads into. A parent that is no node ends the way.

    A round writes only the nodes that were open before it. If none of them closes, all lead into cycles, since of a
    way that ends the last part would have; and if as many nodes are reached as in the round before, those are the
    cycles. Tables of a size that grows with the nodes are merged, none is sent through the driver."""
    start = scratch.save(nodes.select("node", "value", F.when(F.col("value").isNull(), F.col("parent")).alias("up")), f"{name}-0")
    closed, known, state, k, before = start.where("up is null"), start.where("value is not null").select("node", "value"), start, 0, None
    while True:
        state = state.where("up is not null")
        now = tuple(state.agg(F.count("*"), F.count_distinct("up")).first())
        if not now[0] or now == before:
            return closed.unionByName(state)
        before, k = now, k + 1
        above = known.select(F.col("node").alias("at"), F.col("value").alias("v"), F.lit(None).cast(start.schema["up"].dataType).alias("u"))
        above = above.unionByName(state.select(F.col("node").alias("at"), F.lit(None).cast(start.schema["value"].dataType).alias("v"), F.col("up").alias("u")))
        rows = state.select("node", "up").join(above.hint("merge"), F.col("up") == F.col("at"), "left")
        state = scratch.save(rows.select("node", F.col("v").alias("value"), F.col("u").alias("up")), f"{name}-{k}")
        closed = closed.unionByName(state.where("up is null"))
        known = known.unionByName(state.where("value is not null").select("node", "value"))


def marked_above(nodes: DataFrame, scratch: Scratch, name: str = "marked") -> DataFrame:
    """(node, mark) for nodes (node, parent, mark): whether the node or any below it is marked."""

    def step(state: DataFrame) -> DataFrame:
        hit = state.where("mark and up is not null").select(F.col("up").alias("hit")).distinct()
        above = state.select(F.col("node").alias("at"), F.col("up").alias("u"))
        rows = state.join(above, F.col("up") == F.col("at"), "left").join(hit, F.col("node") == F.col("hit"), "left")
        return rows.select("node", (F.col("mark") | F.col("hit").isNotNull()).alias("mark"), F.col("u").alias("up"))

    for state in _rounds(scratch, name, nodes.select("node", "mark", F.col("parent").alias("up")), step):
        pass
    return state.select("node", "mark")


def inherit_attribute(tree: DataFrame) -> DataFrame:
    """H1: (node, value): the nearest value that isn't null on the way to the root, the node's own first."""
    return climb(tree.select("node", "parent", "value"), Scratch(tree.sparkSession)).select("node", "value")


def duplicate_capability(pages: DataFrame, widgets: DataFrame, fields: DataFrame, documents: DataFrame) -> DataFrame:
    """H2: (doc_id, page_no, may_copy, doc_signed): a page may not be copied if the document has XFA or the page has
    a signature widget, whose type is inherited; doc_signed: any page of the document has one. widgets (doc_id,
    page_no, node), fields: a tree with value = type, documents (doc_id, xfa)."""
    kinds = inherit_attribute(fields).where("value = 'Sig'").select("node")
    signed = widgets.join(kinds, "node", "left_semi").select("doc_id", "page_no").distinct().withColumn("signed", F.lit(True))
    whole = signed.select("doc_id", F.lit(True).alias("doc_signed")).distinct()
    rows = pages.join(documents, "doc_id", "left").join(signed, ["doc_id", "page_no"], "left").join(whole, "doc_id", "left")
    return rows.select("doc_id", "page_no", (~F.coalesce("xfa", F.lit(False)) & F.col("signed").isNull()).alias("may_copy"), F.coalesce("doc_signed", F.lit(False)).alias("doc_signed"))


def resolve_aliases(aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """H3: (name, target, status): names followed to a concrete target: ok, cycle, or missing (keeps its alias).
    One alias and one target for each name."""
    own = targets.select(F.col("name").alias("t_name"), F.col("target").alias("value"))
    nodes = aliases.select(F.col("name").alias("node"), F.col("to").alias("parent"))
    ends = nodes.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")).distinct().join(nodes.select("node").hint("merge"), "node", "left_anti")
    nodes = nodes.unionByName(ends).join(own.hint("merge"), F.col("node") == F.col("t_name"), "left").select("node", "parent", "value")
    found = aliases.join(climb(nodes, Scratch(aliases.sparkSession)).hint("merge"), F.col("name") == F.col("node"))
    status = F.when(F.col("value").isNotNull(), "ok").when(F.col("up").isNull(), "missing").otherwise("cycle")
    return found.select("name", F.coalesce("value", "to").alias("target"), status.alias("status"))


def prune_tree(tree: DataFrame) -> DataFrame:
    """H4: the nodes that stay: those that are, or have below them, a childless node that isn't deleted (`gone`)
    and has no deleted ancestor."""
    scratch = Scratch(tree.sparkSession)
    tree = scratch.save(tree, "tree")
    dead = climb(tree.select("node", "parent", F.when(F.col("gone"), True).alias("value")), scratch, "dead").where("value").select("node", F.lit(True).alias("dead"))
    inner = tree.where("parent is not null").select(F.col("parent").alias("node"), F.lit(True).alias("inner")).distinct()
    rows = tree.select("node", "parent").join(dead, "node", "left").join(inner, "node", "left")
    alive = marked_above(rows.select("node", "parent", (F.col("dead").isNull() & F.col("inner").isNull()).alias("mark")), scratch)
    return tree.join(alive.where("mark").select("node"), "node", "left_semi")


def prune_references(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """H4, ordered reference lists: (list_id, ord, node) without nodes that are not kept, numbered anew from 0."""
    rows = lists.join(kept.select("node"), "node", "left_semi")
    at = Window.partitionBy("list_id").orderBy("ord", "node")
    return rows.select("list_id", (F.row_number().over(at) - 1).cast("bigint").alias("ord"), "node")


def drop_dangling(references: DataFrame, kept_pages: DataFrame, aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """H5: references (ref_id, page, name) that lead to a kept page, directly or through a name."""
    named = resolve_aliases(aliases, targets).where("status = 'ok'").select("name", F.col("target").alias("named_page"))
    direct = named.unionByName(targets.select("name", F.col("target").alias("named_page")).join(named.hint("merge"), "name", "left_anti"))
    rows = references.join(direct.hint("merge"), "name", "left").withColumn("at", F.coalesce("page", "named_page"))
    return rows.join(kept_pages.select(F.col("page").alias("at")), "at", "left_semi").select("ref_id", F.col("at").alias("page"))


def kept_names(kept_pages: DataFrame, aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """H5: (name): the names that stay: targets on a kept page, and aliases whose way ends at none that is dropped, over
    however many others it goes. One that leads nowhere, or into a cycle, loses nothing and stays."""
    dropped = targets.join(kept_pages.select(F.col("page").alias("target")), "target", "left_anti").select("name", F.lit(True).alias("mark"))
    nodes = targets.select(F.col("name").alias("node"), F.lit(None).cast("string").alias("parent")).unionByName(aliases.select(F.col("name").alias("node"), F.col("to").alias("parent")))
    marked = nodes.join(dropped.hint("merge"), F.col("node") == F.col("name"), "left").select("node", "parent", F.col("mark").alias("value"))
    fate = climb(marked, Scratch(aliases.sparkSession), "names")  # the mark comes down from a dropped name to all that leads to it
    return fate.where("value is null").select(F.col("node").alias("name"))


def tree_consistency(edges: DataFrame, pointers: DataFrame, widgets: DataFrame, kept_pages: DataFrame) -> DataFrame:
    """H6: (node, violation), one row for each: reached twice, on a cycle, parent pointer other than an edge, widget
    on two pages, widget on a removed page, widget outside the tree.

    edges and pointers (node, parent), widgets (node, page). A cycle through a node of several parents shows
    as that node reached twice; one whose nodes have one parent each is reported with all its nodes.
    """
    scratch = Scratch(edges.sparkSession)
    parents = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
    twice = parents.where("n > 1").select("node", F.lit("reached twice").alias("violation"))
    single = parents.where("n = 1").select("node", "parent", F.lit(None).cast("boolean").alias("value"))
    cycle = climb(single, scratch).where("up is not null").select(F.col("up").alias("node"), F.lit("cycle").alias("violation"))
    wrong = pointers.select("node", F.col("parent").alias("p")).join(edges.hint("merge"), "node", "left").where("not (p <=> parent)").select("node", F.lit("parent pointer").alias("violation"))
    two = widgets.groupBy("node").agg(F.count_distinct("page").alias("n")).where("n > 1").select("node", F.lit("on two pages").alias("violation"))
    gone = widgets.join(kept_pages, "page", "left_anti").select("node", F.lit("on removed page").alias("violation"))
    outside = widgets.join(edges.select("node").hint("merge"), "node", "left_anti").select("node", F.lit("not in tree").alias("violation"))
    return twice.unionByName(cycle).unionByName(wrong).unionByName(two).unionByName(gone).unionByName(outside).distinct()


def clone_subtree(tree: DataFrame, roots: DataFrame, copy: str) -> DataFrame:
    """H7: the tree and, for each root (node), a copy of its subtree under new ids: references inside go to the
    copies, the root's own parent stays shared. New ids are a hash of the copy's name and the old id. Where the
    tree has a column `name`, that of a copied root begins with the copy's name."""
    tops = roots.select("node", F.lit(True).alias("top")).distinct()
    marked = tree.select("node", "parent").join(tops, "node", "left").withColumnRenamed("top", "value")
    inside = climb(marked, Scratch(tree.sparkSession)).where("value").select("node")
    ids = inside.select("node", F.concat(F.lit(f"{copy}-"), F.substring(F.sha2(F.concat_ws("/", F.lit(copy), "node"), 256), 1, 16)).alias("new"))
    rows = tree.join(ids, "node").join(ids.select(F.col("node").alias("parent"), F.col("new").alias("new_parent")), "parent", "left").join(tops, "node", "left")
    if "name" in tree.columns:
        rows = rows.withColumn("name", F.when(F.col("top"), F.concat(F.lit(f"{copy}_"), "name")).otherwise(F.col("name")))
    copies = rows.withColumn("node", F.col("new")).withColumn("parent", F.coalesce("new_parent", "parent")).select(*tree.columns)
    return tree.unionByName(copies)
