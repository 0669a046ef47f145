"""Geometric clustering, bounding boxes, admissibility and block trees.

Trees are built level by level: each level is one aggregation of the points by
node (its box) and one narrow projection (the side of each point), so nothing
grows with the depth but the number of jobs. A node's id is 2 * parent + side,
the root is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Pieces, cut_lineage


def boxes(points: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """key, size, min_<axis> and max_<axis> of each cluster."""
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("size"), *[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def axis_boxes(points: DataFrame, key: str, x: str = "x") -> DataFrame:
    """(key, axis, lo, hi) for points of any dimension."""
    return points.select(key, F.posexplode(x).alias("axis", "v")).groupBy(key, "axis").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def bisect(points: DataFrame, axes: list[str], leaf_size: int, levels: int, strictly_above_right: bool = False) -> DataFrame:
    """`points` with the node each one is in after `levels` bisections.

    A node's longest axis (the first of equals) is cut at the middle of its box: below goes left, the rest
    right (with strictly_above_right the middle goes left). Nodes of up to leaf_size points, of no extent,
    or with an empty side stay leaves.
    """
    now = points.withColumn("node", F.lit(1).cast("long"))
    for level in range(levels):
        box = boxes(now.filter(F.col("node") >= (1 << level)), "node", axes)
        extent = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes]
        longest = F.greatest(*extent) if len(axes) > 1 else extent[0]
        axis, mid = F.lit(None).cast("int"), F.lit(None).cast("double")
        for i in reversed(range(len(axes))):
            axis = F.when(extent[i] == longest, i).otherwise(axis)
            mid = F.when(extent[i] == longest, (F.col(f"max_{axes[i]}") + F.col(f"min_{axes[i]}")) * 0.5).otherwise(mid)
        cut = box.filter((F.col("size") > leaf_size) & (longest > 0)).select("node", axis.alias("_axis"), mid.alias("_mid"))
        # A level has at most 2^level clusters to cut.
        joined = now.join(F.broadcast(cut) if level < 12 else cut, "node", "left")
        value = F.lit(None).cast("double")
        for i, a in enumerate(axes):
            value = F.when(F.col("_axis") == i, F.col(a)).otherwise(value)
        right = (value > F.col("_mid")) if strictly_above_right else (value >= F.col("_mid"))
        after = cut_lineage(joined.withColumn("node", F.when(F.col("_axis").isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("int"))).select(*points.columns, "node"))
        now, done = after, not after.filter(F.col("node") >= (2 << level)).limit(1).count()
        if done:
            break
    return now


def tree(points: DataFrame, axes: list[str]) -> DataFrame:
    """The node table of points with leaf numbers: node, parent, level, size, box, leaf. One aggregation over all ancestors."""
    ancestors = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("node"))).cast("int")), lambda d: F.struct(F.expr("0").alias("z"), d.alias("d")))
    spread = points.withColumn("_d", F.explode(F.transform(ancestors, lambda s: s["d"]))).withColumn("_leaf", F.col("_d") == 0)
    spread = spread.withColumn("node", F.expr("shiftright(node, _d)"))
    found = spread.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("_leaf").alias("leaf"), *[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])
    return found.withColumn("parent", F.when(F.col("node") > 1, F.expr("shiftright(node, 1)"))).withColumn("level", F.floor(F.log2("node")).cast("int"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """One row: nodes, leaves, depth, and the sizes of the least and largest leaf."""
    leaf = F.col("leaf")
    return nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(leaf).alias("n_leaves"),
        F.max("level").alias("depth"),
        F.min(F.when(leaf, F.col("level"))).alias("min_depth"),
        F.min(F.when(leaf, F.col("size"))).alias("min_leaf"),
        F.max(F.when(leaf, F.col("size"))).alias("max_leaf"),
    )


def squared_extent(axes: list[str], side: str = "") -> Column:
    """Squared Euclidean diameter of a box."""
    return sum(((F.col(f"{side}max_{a}") - F.col(f"{side}min_{a}")) ** 2 for a in axes[1:]), (F.col(f"{side}max_{axes[0]}") - F.col(f"{side}min_{axes[0]}")) ** 2)


def squared_gap(axes: list[str], one: str = "r_", other: str = "c_") -> Column:
    """Squared Euclidean distance of two boxes; 0 if they meet."""
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"{one}min_{a}") - F.col(f"{other}max_{a}"), F.col(f"{other}min_{a}") - F.col(f"{one}max_{a}"))
    return sum((gap(a) ** 2 for a in axes[1:]), gap(axes[0]) ** 2)


def max_extent(axes: list[str], side: str = "") -> Column:
    each = [F.col(f"{side}max_{a}") - F.col(f"{side}min_{a}") for a in axes]
    return F.greatest(*each) if len(each) > 1 else each[0]


def max_gap(axes: list[str], one: str = "r_", other: str = "c_") -> Column:
    each = [F.greatest(F.lit(0.0), F.col(f"{one}min_{a}") - F.col(f"{other}max_{a}"), F.col(f"{other}min_{a}") - F.col(f"{one}max_{a}")) for a in axes]
    return F.greatest(*each) if len(each) > 1 else each[0]


def admissible(kind: str, axes: list[str], eta: float) -> Column:
    """A predicate on pairs of boxes with prefixes r_ and c_ (and r_node, c_node).

    two_min:    least diameter <= eta * distance, Euclidean
    two:        both diameters <= eta * distance, Euclidean
    maximum:    both diameters <= eta * distance, in the maximum norm
    two_min_strict: least diameter < eta * distance, the variant of stencil matrices
    distant:    the boxes don't meet
    sphere:     centre distance > half the sum of both diameters
    hodlr:      different clusters
    """
    dr, dc, gap = squared_extent(axes, "r_"), squared_extent(axes, "c_"), squared_gap(axes)
    if kind == "two_min":
        return F.least(dr, dc) <= eta * eta * gap
    if kind == "two":
        return F.greatest(dr, dc) <= eta * eta * gap
    if kind == "maximum":
        return F.greatest(max_extent(axes, "r_"), max_extent(axes, "c_")) <= eta * max_gap(axes)
    if kind == "two_min_strict":
        return F.least(dr, dc) < eta * eta * gap
    if kind == "distant":
        return gap > 0
    if kind == "sphere":
        middle = lambda a, s: (F.col(f"{s}max_{a}") + F.col(f"{s}min_{a}")) * 0.5
        apart = sum(((middle(a, "r_") - middle(a, "c_")) ** 2 for a in axes[1:]), (middle(axes[0], "r_") - middle(axes[0], "c_")) ** 2)
        return F.sqrt(apart) > 0.5 * eta * (F.sqrt(dr) + F.sqrt(dc))
    if kind == "hodlr":
        return F.col("r_node") != F.col("c_node")
    raise ValueError(kind)


def pairs(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """All pairs of two short lists of clusters with their boxes, in one task; `dealt_pairs` is for long ones."""
    left = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns], F.lit(1).alias("_k"))
    right = cols.select(*[F.col(c).alias(f"c_{c}") for c in cols.columns], F.lit(1).alias("_k"))
    return left.join(right, "_k").drop("_k")


def dealt_pairs(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """All pairs of two lists of clusters with their boxes: a part of one list meets a part of the other in each task, which holds neither whole."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda df, s, parts: df.select(*[F.col(c).alias(f"{s}{c}") for c in df.columns]).repartition(parts)
    return side(rows, "r_", n).crossJoin(side(cols, "c_", min(4, n)))


def sparse_admissible(entries: DataFrame, sizes_row: DataFrame, sizes_col: DataFrame, n_most: int, by_count: bool = False) -> DataFrame:
    """(br, bc, measure, limit, admissible) of the blocks of a sparse matrix; entries(br, bc, row, col).

    The measure is the number of entries, or the lesser of the numbers of distinct rows and columns
    that have entries; accepted if below m * n / (2 (m + n)) in whole numbers and at most n_most.
    sizes_row(br, m) and sizes_col(bc, n) are the blocks' extents.
    """
    measure = F.count(F.lit(1)) if by_count else F.least(F.count_distinct("row"), F.count_distinct("col"))
    counted = entries.groupBy("br", "bc").agg(measure.alias("measure"))
    sized = counted.join(sizes_row, "br").join(sizes_col, "bc")
    limit = F.expr("CAST((m * n) DIV (2 * (m + n)) AS BIGINT)")
    return sized.withColumn("limit", limit).select("br", "bc", "measure", "limit", ((F.col("measure") < F.col("limit")) & (F.col("measure") <= n_most)).alias("admissible"))


def dissected_admissible(base: Column, strict: bool = False) -> Column:
    """A predicate for trees of dissected domains, over r_type and c_type: distinct domains (type 1) always qualify, else `base` decides.

    strict: blocks of two separators (type 2) never do.
    """
    apart = (F.col("r_type") == 1) & (F.col("c_type") == 1) & (F.col("r_node") != F.col("c_node"))
    found = F.coalesce(apart, F.lit(False)) | base
    return ~F.coalesce((F.col("r_type") == 2) & (F.col("c_type") == 2), F.lit(False)) & found if strict else found


def coupled_admissible(base: Column, interfaces: bool = False) -> Column:
    """A predicate on a row cluster that may be associated with a column cluster (r_associated): domains (type 1) qualify if they aren't
    associated, else `base` decides. interfaces: clusters of an interface (type 4) qualify against any domain, and interface parts
    (type 3) against domains that they aren't associated with, in either direction (c_associated).
    """
    r, c, rt, ct = F.col("r_associated"), F.col("c_associated"), F.col("r_type"), F.col("c_type")
    if not interfaces:
        return base | F.coalesce(r.isNotNull() & (r != F.col("c_node")) & (ct == 1) & (rt == 1), F.lit(False))
    found = base
    for rule in ((rt == 1) & (ct == 1) & (F.col("r_node") != F.col("c_node")), (rt == 4) & (ct == 1), (rt == 1) & (ct == 4), (rt == 3) & (ct == 1) & (r != F.col("c_node")), (rt == 1) & (ct == 3) & (c != F.col("r_node"))):
        found = found | F.coalesce(rule, F.lit(False))
    return found


def block_tree(nodes: DataFrame, axes: list[str], kind: str | Column, eta: float = 1.0, most_levels: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """(r_node, c_node, level, admissible, leaf) of the block tree of a cluster tree with itself.

    A pair is a leaf if it is admissible or either cluster is a leaf; else all pairs of sons follow.
    Each level is two equi-joins on the parents. `kind` is a name that `admissible` knows, or any predicate
    over the pair's columns: boxes, r_node, c_node, r_leaf, c_leaf and the columns named in `carry`, with r_ and c_.
    """
    test = admissible(kind, axes, eta) if isinstance(kind, str) else kind
    kept = ["node", "leaf", *carry, *[f"{n}_{a}" for a in axes for n in ("min", "max")]]
    nodes = cut_lineage(nodes.select("parent", *kept))  # every level reads it twice
    side = lambda s: nodes.select(F.col("parent").alias(f"{s}parent"), *[F.col(c).alias(f"{s}{c}") for c in kept])
    now = pairs(nodes.filter("node = 1").select(kept), nodes.filter("node = 1").select(kept)).withColumn("level", F.lit(0))
    found = Pieces()
    for level in range(most_levels):
        judged = now.withColumn("admissible", test).withColumn("leaf", F.col("admissible") | F.col("r_leaf") | F.col("c_leaf"))
        judged = cut_lineage(judged)
        found.add(judged.select("r_node", "c_node", "level", "admissible", "leaf"))
        split = judged.filter(~F.col("leaf")).select(F.col("r_node").alias("r_parent"), F.col("c_node").alias("c_parent"))
        if not split.limit(1).count():
            break
        now = split.join(side("r_"), "r_parent").join(side("c_"), "c_parent").drop("r_parent", "c_parent").withColumn("level", F.lit(level + 1))
    else:
        raise RuntimeError("the block tree is deeper than most_levels")
    return found.table()


def extended(nodes: DataFrame, depth: int, every: bool = True) -> DataFrame:
    """A tree whose leaves above `depth` get a chain of only sons with the same points down to it; every=False: one more level for leaves at depth - 1 alone."""
    short = nodes.filter("leaf").filter(F.col("level") < depth if every else F.col("level") == depth - 1)
    chain = short.select("*", F.explode(F.sequence(F.col("level") + 1, F.lit(depth))).alias("_l"))
    down = F.col("_l") - F.col("level")
    added = chain.withColumn("parent", F.expr("shiftleft(node, CAST(_l - level - 1 AS INT))")).withColumn("node", F.expr("shiftleft(node, CAST(_l - level AS INT))"))
    added = added.withColumn("leaf", F.col("_l") == depth).withColumn("level", F.col("level") + down).drop("_l")
    inner = nodes.join(short.select("node", F.lit(True).alias("_x")), "node", "left").withColumn("leaf", F.col("leaf") & F.col("_x").isNull()).drop("_x")
    return inner.unionByName(added.select(*nodes.columns))


def cut_to_depth(nodes: DataFrame, depth: int) -> DataFrame:
    """A tree without the levels below `depth`; what stood there is in its leaves."""
    return nodes.filter(F.col("level") <= depth).withColumn("leaf", F.col("leaf") | (F.col("level") == depth))


def balanced(nodes: DataFrame, depth: int) -> DataFrame:
    """All leaves at `depth`: deeper ones cut, others extended."""
    return extended(cut_to_depth(nodes, depth), depth)


def without_small(nodes: DataFrame, least: int) -> DataFrame:
    """A tree in which sons stay only if all sons of their node, and of its ancestors, have `least` points."""
    bad = nodes.filter((F.col("size") < least) & F.col("parent").isNotNull()).select(F.col("parent").alias("_p")).distinct()
    below = nodes.select("node", F.explode(F.expr("transform(sequence(1, greatest(1, level)), d -> shiftright(node, d))")).alias("_p")).join(bad, "_p", "left_semi").select("node").distinct()
    return nodes.join(below, "node", "left_anti").join(bad.select(F.col("_p").alias("node"), F.lit(True).alias("_x")), "node", "left").withColumn("leaf", F.col("leaf") | F.coalesce("_x", F.lit(False))).drop("_x")


def tree_faults(nodes: DataFrame) -> DataFrame:
    """(node, fault) of a node table that isn't a tree: no parent, sizes that don't add up, a leaf with sons or a node with neither, a box that doesn't hold its sons'."""
    axes = [c.removeprefix("min_") for c in nodes.columns if c.startswith("min_")]
    sons = nodes.filter(F.col("parent").isNotNull())
    summed = sons.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("_n"), *[f(f"{n}_{a}").alias(f"_{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])
    orphans = sons.join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select("node", F.lit("no parent").alias("fault"))
    both = nodes.join(summed, "node", "left")
    outside = F.lit(False)
    for a in axes:
        outside = outside | (F.col(f"_min_{a}") < F.col(f"min_{a}")) | (F.col(f"_max_{a}") > F.col(f"max_{a}"))
    fault = F.when(F.col("leaf") & F.col("_n").isNotNull(), "a leaf with sons").when(~F.col("leaf") & F.col("_n").isNull(), "neither leaf nor sons").when(F.col("_n") != F.col("size"), "sizes").when(outside, "box")
    return both.select("node", fault.alias("fault")).filter(F.col("fault").isNotNull()).unionByName(orphans)


def pairing_faults(nodes: DataFrame, ghosts: DataFrame) -> DataFrame:
    """(id): boundary nodes whose ghost is missing or in another cluster; nodes(id, cluster), ghosts(id, ghost)."""
    pair = ghosts.join(nodes.select("id", F.col("cluster").alias("_a")), "id").join(nodes.select(F.col("id").alias("ghost"), F.col("cluster").alias("_b")), "ghost", "left")
    return pair.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("id")


def sparsity_constant(blocks: DataFrame) -> DataFrame:
    """One row: the most leaf blocks of a row cluster and of a column cluster, and the greater of both."""
    leaves = blocks.filter("leaf")
    most = lambda k: leaves.groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias(f"csp_{k[0]}"))
    both = most("r_node").withColumn("_k", F.lit(1)).join(most("c_node").withColumn("_k", F.lit(1)), "_k")
    return both.select("csp_r", "csp_c", F.greatest("csp_r", "csp_c").alias("csp"))


def renumber(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(pos, ...) positions after a stable partition by `key`: parts in order, each in its own order.

    Positions within a part come from a window of that part; the parts' starts from their counts.
    """
    counts = points.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(F.col(key).alias("_k"), F.coalesce(F.sum("_n").over(W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    return points.withColumn("_rank", rank).join(starts, F.col(key) == F.col("_k")).withColumn("pos", F.col("_start") + F.col("_rank")).drop("_k", "_start", "_rank")
