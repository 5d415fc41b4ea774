"""Parent-child links of unknown depth to roots, depths, paths, descendants and cycles.

The frontier grows from the roots outwards. A join per level would need as many rounds as the
deepest chain has rows (over ten thousand here), so each round's frontier is twice as many levels
deep as the last: every unresolved node carries a pointer to the ancestor 2^k levels up; where that
ancestor is already resolved (its depth is below 2^k) the node's root and depth follow from it, else
pointer and loop minimum are doubled. Nodes still unreached after enough rounds hang on a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import forget, materialize, small_side


def parent_links(df: DataFrame, node: str, parent: str, tbl: str) -> DataFrame:
    """Distinct nodes of one table with their parent, null where the node is a root.

    A null or empty parent, or one that is no node, makes a root. Null or empty node ids are no
    nodes. Of several parents given for one node the smallest counts (repeated rows give one).
    A node that is its own parent is a loop of one.
    """
    d = df.select(F.col(node).alias("node_id"), F.when(F.col(parent) != "", F.col(parent)).alias("parent_id"))
    d = d.filter(F.col("node_id").isNotNull() & (F.col("node_id") != "")).groupBy("node_id").agg(F.min("parent_id").alias("parent_id"))
    known = d.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("_known"))
    return d.join(known, "parent_id", "left").select(F.lit(tbl).alias("tbl"), "node_id", F.when(F.col("_known"), F.col("parent_id")).alias("parent_id"))


def resolve(links: DataFrame) -> DataFrame:
    """Root and depth of every node of ``links`` (tbl, node_id, parent_id as of :func:`parent_links`).

    Result: tbl, node_id, root_id, depth; nodes whose parents never end have depth -1 and as root_id
    the smallest node_id on the loop they run into. Empty in, empty out.

    Joins are on (tbl, pointer) against one row per node. Many nodes may point at one ancestor; only
    this streamed side is skewed, which adaptive execution splits, and it shrinks every round as
    nodes resolve. Rounds are written to the shared folder, so a lost executor costs one round.
    """
    done = materialize(links.filter("parent_id IS NULL").select("tbl", "node_id", F.col("node_id").alias("root_id"), F.lit(0).alias("depth")), "roots")
    resolved = [done]
    active = materialize(links.filter("parent_id IS NOT NULL").select("tbl", "node_id", F.col("parent_id").alias("up"), F.least("node_id", "parent_id").alias("low")), "active")
    left, nodes, step = active.count(), links.count(), 1
    while left and step <= 2 * nodes:
        settled = reduce(DataFrame.unionByName, resolved).select("tbl", F.col("node_id").alias("up"), "root_id", "depth", F.lit(None).cast("string").alias("up2"), F.lit(None).cast("string").alias("low2"))
        moving = active.select("tbl", F.col("node_id").alias("up"), F.lit(None).cast("string").alias("root_id"), F.lit(None).cast("int").alias("depth"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        both = materialize(active.join(settled.unionByName(moving), ["tbl", "up"]).select("tbl", "node_id", "root_id", (F.col("depth") + step).alias("depth"), "up2", F.least("low", "low2").alias("low2")), f"round{step}")
        resolved.append(both.filter("root_id IS NOT NULL").select("tbl", "node_id", "root_id", "depth"))
        if step > 1:
            forget(active)
        active = both.filter("root_id IS NULL").select("tbl", "node_id", F.col("up2").alias("up"), F.col("low2").alias("low"))
        left, step = active.count(), step * 2
    # `low` now covers at least as many steps as there are nodes, counted from the node itself: for a
    # node on a loop that is the whole loop. `up` is an ancestor far enough to lie on the loop.
    loop = active.select("tbl", F.col("node_id").alias("up"), F.col("low").alias("root_id"))
    cyclic = active.join(loop, ["tbl", "up"]).select("tbl", "node_id", "root_id", F.lit(-1).alias("depth"))
    return reduce(DataFrame.unionByName, [*resolved, cyclic])


def full_paths(links: DataFrame) -> DataFrame:
    """Path from the root to every node that has a root: tbl, node_id, root_id, depth, path.

    ``path`` holds depth + 1 ids, root first, node last. Round k appends to the paths of the
    frontier the 2^k ids below it. Nodes on or under a loop have no path and are left out.
    """
    done = materialize(links.filter("parent_id IS NULL").select("tbl", "node_id", F.array("node_id").alias("path")), "paths")
    resolved = [done]
    active = materialize(links.filter("parent_id IS NOT NULL").select("tbl", "node_id", F.col("parent_id").alias("up"), F.array("node_id").alias("tail")), "tails")
    left, nodes, step = active.count(), links.count(), 1
    empty = F.lit(None).cast("array<string>")
    while left and step <= 2 * nodes:
        # of all paths only those that some node waits for cross to the join
        asked = small_side(materialize(active.select("tbl", "up").distinct(), "asked"))
        settled = reduce(DataFrame.unionByName, resolved).withColumnRenamed("node_id", "up").join(asked, ["tbl", "up"], "left_semi").select("tbl", "up", "path", F.lit(None).cast("string").alias("up2"), empty.alias("tail2"))
        moving = active.select("tbl", F.col("node_id").alias("up"), empty.alias("path"), F.col("up").alias("up2"), F.col("tail").alias("tail2"))
        both = materialize(active.join(settled.unionByName(moving), ["tbl", "up"]).select("tbl", "node_id", F.concat("path", "tail").alias("path"), "up2", F.when(F.col("path").isNull(), F.concat("tail2", "tail")).alias("tail2")), f"path{step}")
        resolved.append(both.filter("path IS NOT NULL").select("tbl", "node_id", "path"))
        active = both.filter("path IS NULL").select("tbl", "node_id", F.col("up2").alias("up"), F.col("tail2").alias("tail"))
        unresolved = active.count()
        if unresolved == left:  # only loops are left: no node came nearer to a root
            break
        left, step = unresolved, step * 2
    out = reduce(DataFrame.unionByName, resolved)
    return out.select("tbl", "node_id", F.element_at("path", 1).alias("root_id"), (F.size("path") - 1).alias("depth"), "path")


def upward_paths(links: DataFrame) -> DataFrame:
    """For every node its proper ancestors, farthest first, and itself last: tbl, node_id, root_id, depth, path.

    As :func:`full_paths`, with the nodes on and under loops too. Their loop is cut above its smallest
    node, and the members that the cut hides are put back in front: going up, they are met last.
    So each other node of the loop is an ancestor once, at its least distance. root_id is then the
    loop's smallest node and ``depth`` the number of ancestors.
    """
    heads = resolve(links).filter("depth = -1 AND node_id = root_id").select("tbl", "node_id", F.lit(True).alias("_head"))
    marked = materialize(links.join(heads, ["tbl", "node_id"], "left"), "marked")
    cut = marked.select("tbl", "node_id", F.when(F.col("_head").isNull(), F.col("parent_id")).alias("parent_id"))
    paths = materialize(full_paths(cut), "cut")
    closing = marked.filter("_head").select("tbl", F.col("parent_id").alias("node_id"))
    rings = paths.join(closing, ["tbl", "node_id"]).select("tbl", "root_id", F.col("path").alias("_ring"))
    shared = F.size(F.array_intersect("path", "_ring"))
    whole = F.when(F.col("_ring").isNull(), F.col("path")).otherwise(F.concat(F.slice("_ring", shared + 1, F.size("_ring") - shared), "path"))
    d = paths.join(rings, ["tbl", "root_id"], "left").select("tbl", "node_id", "root_id", whole.alias("path"))
    return d.select("tbl", "node_id", "root_id", (F.size("path") - 1).alias("depth"), "path")


def ancestor_pairs(paths: DataFrame) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance, from :func:`full_paths` or :func:`upward_paths`; no node is its own."""
    pairs = paths.select("tbl", F.col("node_id").alias("descendant_id"), "depth", F.posexplode("path").alias("_at", "ancestor_id"))
    return pairs.filter(F.col("_at") < F.col("depth")).select("tbl", "ancestor_id", "descendant_id", (F.col("depth") - F.col("_at")).alias("distance"))


def descendant_counts(links: DataFrame) -> DataFrame:
    """Per node the number of its descendants and the height of the tree below it: tbl, node_id, n_descendants, height.

    Nodes without descendants have 0 and 0. A node on a loop has all other nodes that run into the
    loop as descendants, and height -1, as nothing below it ends; a node hanging under a loop has its
    own subtree.

    No pair is ever built: in round k every node knows the number of nodes less than 2^k levels below
    it and hands it to its ancestor 2^k levels up, so the rounds are log2 of the depth and each
    shuffles one row per node. Loops are counted from their resolved nodes.
    """
    nodes = materialize(resolve(links), "resolved")
    looped = nodes.filter("depth = -1").select("tbl", "node_id", "root_id")
    on = _loop_members(links, looped)
    # the loop's nodes are taken out; what hangs under them becomes trees
    below = links.join(on.select("tbl", "node_id"), ["tbl", "node_id"], "left_anti")
    gone = on.select("tbl", F.col("node_id").alias("parent_id"), F.lit(True).alias("_on"))
    up = below.join(gone, ["tbl", "parent_id"], "left").select("tbl", "node_id", F.when(F.col("_on").isNull(), F.col("parent_id")).alias("up"))
    state = materialize(up.select("tbl", "node_id", "up", F.lit(1).cast("long").alias("n"), F.lit(0).alias("h")), "below")
    step = 1
    while not state.filter("up IS NOT NULL").isEmpty():
        handed = state.filter("up IS NOT NULL").groupBy("tbl", F.col("up").alias("node_id")).agg(F.sum("n").alias("_n"), (F.max("h") + step).alias("_h"))
        further = state.select("tbl", F.col("node_id").alias("up"), F.col("up").alias("_up2"))
        grown = state.join(handed, ["tbl", "node_id"], "left").join(further, ["tbl", "up"], "left")
        new = materialize(grown.select("tbl", "node_id", F.col("_up2").alias("up"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("h", F.coalesce("_h", F.lit(0))).alias("h")), f"below{step}")
        forget(state)
        state, step = new, step * 2
    trees = state.select("tbl", "node_id", (F.col("n") - 1).alias("n_descendants"), F.col("h").cast("int").alias("height"))
    sizes = looped.groupBy("tbl", "root_id").agg((F.count("*") - 1).alias("n_descendants"))
    rings = on.join(sizes, ["tbl", "root_id"]).select("tbl", "node_id", "n_descendants", F.lit(-1).alias("height"))
    return trees.unionByName(rings)


def _loop_members(links: DataFrame, looped: DataFrame) -> DataFrame:
    """tbl, node_id, root_id of the nodes that lie on a loop themselves.

    Nodes that no other node runs through are peeled off by doubling: what is an ancestor 2^k levels
    up of something, for 2^k of at least the number of looped nodes, lies on the loop.
    """
    p = materialize(looped.join(links, ["tbl", "node_id"]).select("tbl", "node_id", F.col("parent_id").alias("up"), "root_id"), "loops")
    n, step = p.count(), 1
    while step < n:
        p = materialize(p.join(p.select("tbl", F.col("node_id").alias("up"), F.col("up").alias("_up2")), ["tbl", "up"]).select("tbl", "node_id", F.col("_up2").alias("up"), "root_id"), f"loops{step}")
        step *= 2
    return p.select("tbl", F.col("up").alias("node_id"), "root_id").distinct()
