"""Graph operators over edges (src, dst, w): levels, components, shortest paths, separators, partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once, with the smaller weight."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.min("w").alias("w"))


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among vertices(id)."""
    v = vertices.select("id").distinct()
    return edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")


def bfs_levels(edges: DataFrame, start: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """(id, level) of all vertices that start(id) reaches; one join for each level, over the frontier only."""
    seen = cut_lineage(start.select("id", F.lit(0).alias("level")).distinct())
    frontier = seen
    for level in range(1, most_levels):
        fresh = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = cut_lineage(fresh.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        if not frontier.limit(1).count():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    else:
        raise RuntimeError("the graph is deeper than most_levels")
    return seen


def is_connected(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: whether one vertex reaches all."""
    reached = bfs_levels(symmetric(edges), vertices.agg(F.min("id").alias("id")))
    return vertices.select("id").distinct().join(reached, "id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("connected"))


#: Edges of a checkpoint file of `components`.
EDGES_PER_FILE = 500_000


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(src, dst) -> (id, component): the smallest id each one reaches, for all ids in edges.

    Large-star and small-star rounds: each is two combined aggregations over the
    edges, which shrink towards one edge from each id to its component.
    """
    now = cut_lineage(edges.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    n = now.count()
    for _ in range(most_rounds):
        # Large-star: the larger neighbours of u go to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small-star: u and its smaller neighbours go to the least of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = cut_lineage(small.coalesce(n // EDGES_PER_FILE + 1))
        # Stars: nobody's centre has a centre, and nobody has two.
        stars = now.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("d")).first()
        chained = now.select(F.col("v").alias("x")).join(now.select(F.col("u").alias("x")), "x", "left_semi").limit(1).count()
        if stars["n"] == stars["d"] and not chained:
            break
        n = stars["n"]
    else:
        raise RuntimeError("components didn't settle")
    # One combined sum dealt by the id: centres stand once, and joins on the id need no further shuffle.
    ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))).alias("_end"))
    return ends.select("_end.*").groupBy("id").agg(F.min("component").alias("component"))


def shortest_paths(edges: DataFrame, start: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(id, dist) from start(id) over non-negative weights: relaxing the vertices that changed, until none does."""
    dist = cut_lineage(start.select("id", F.lit(0.0).alias("dist")).distinct())
    changed = dist
    for _ in range(most_rounds):
        offers = edges.join(changed.select(F.col("id").alias("src"), "dist"), "src").select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("offer"))
        best = offers.groupBy("id").agg(F.min("offer").alias("offer"))
        changed = cut_lineage(best.join(dist, "id", "left").filter(F.col("dist").isNull() | (F.col("offer") < F.col("dist"))).select("id", F.col("offer").alias("dist")))
        if not changed.limit(1).count():
            break
        dist = cut_lineage(dist.join(changed.select("id"), "id", "left_anti").unionByName(changed))
    else:
        raise RuntimeError("paths didn't settle")
    return dist


def n_nearest(edges: DataFrame, start: int, n: int, flagged: DataFrame | None = None) -> DataFrame:
    """(id, dist) of the first n vertices by path length, then id.

    With flagged(id) only flagged vertices are passed and returned; the start is always passed, and returned if flagged.
    """
    spark = edges.sparkSession
    if flagged is not None:
        edges = edges.join(flagged.select(F.col("id").alias("dst")), "dst", "left_semi")
    found = shortest_paths(edges, spark.range(start, start + 1))
    if flagged is not None:
        found = found.join(flagged.select("id"), "id", "left_semi")
    return found.orderBy("dist", "id").limit(n)


def simple_separator(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """(id): vertices of the larger side (side 0 if both are as large) with a neighbour on the other; sides(id, side)."""
    sizes = sides.agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")).first()
    scanned = sides.filter(F.col("side") == (1 if sizes["n0"] < sizes["n1"] else 0)).select("id", "side")
    other = sides.select(F.col("id").alias("dst"), F.col("side").alias("_o"))
    touching = scanned.join(edges.select(F.col("src").alias("id"), "dst"), "id").join(other, "dst").filter(F.col("_o") != F.col("side"))
    return touching.select("id").distinct()


def majority_side(couplings: DataFrame, sides: DataFrame) -> DataFrame:
    """(id, side): the side that a node has more couplings with; ties go by the parity of its id. couplings(id, nbr)."""
    counted = couplings.join(sides.select(F.col("id").alias("nbr"), "side"), "nbr").groupBy("id").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    return counted.select("id", F.when(F.col("n0") > F.col("n1"), 0).when(F.col("n0") < F.col("n1"), 1).otherwise((F.col("id") % 2).cast("int")).alias("side"))


def two_front_partition(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, side): two fronts grown alternately from a pair of far vertices until all are assigned.

    The first is the last vertex (largest level, then id) that a sweep from the smallest id reaches, the
    second the last one that a sweep from the first reaches.
    """
    both = symmetric(edges)
    last = lambda levels: levels.orderBy(F.desc("level"), F.desc("id")).select("id").limit(1)
    a = cut_lineage(last(bfs_levels(both, vertices.agg(F.min("id").alias("id")))))
    b = cut_lineage(last(bfs_levels(both, a)))
    assigned = cut_lineage(a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))))
    fronts = {0: a, 1: b}
    live = {0, 1}
    side = 0
    while live:
        if side in live:
            fresh = both.join(fronts[side].select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(assigned, "id", "left_anti")
            fronts[side] = cut_lineage(fresh)
            if fronts[side].limit(1).count():
                assigned = cut_lineage(assigned.unionByName(fronts[side].withColumn("side", F.lit(side))))
            else:
                live.discard(side)
        side = 1 - side
    rest = vertices.select("id").join(assigned, "id", "left_anti").withColumn("side", F.lit(0))
    return assigned.unionByName(rest)


def stencil_update(neighbours: DataFrame, considered: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id): considered nodes that have a neighbour outside the allowed set; neighbours(id, nbr)."""
    outside = neighbours.join(allowed.select(F.col("id").alias("nbr")), "nbr", "left_anti").select("id").distinct()
    return considered.select("id").join(outside, "id", "left_semi")


def levels_within(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(part, id, level) from start(part, id) over edges(part, src, dst): the fronts of all parts advance together."""
    seen = cut_lineage(start.select("part", "id", F.lit(0).alias("level")))
    frontier, level = seen, 0
    while frontier.limit(1).count():
        level += 1
        fresh = edges.join(frontier.select("part", F.col("id").alias("src")), ["part", "src"]).select("part", F.col("dst").alias("id")).distinct()
        frontier = cut_lineage(fresh.join(seen, ["part", "id"], "left_anti").withColumn("level", F.lit(level)))
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def partition(edges: DataFrame, vertices: DataFrame, bisections: int) -> DataFrame:
    """(id, part) of 2^bisections parts of about equal size: each part is cut across its levels from a vertex far out.

    The parts of a step are cut together: two sweeps of levels, from the least id and from the last vertex that
    reaches, then a cut after the first half of the part's vertices by (level, id). Vertices that the sweep doesn't
    reach come last. A part's order is a count of its levels and a window in one level, so no part meets in a task.
    """
    from pyspark.sql import Window as W

    now = cut_lineage(vertices.select("id", F.lit(0).cast("long").alias("part")).distinct())
    both = symmetric(edges).select("src", "dst")
    for _ in range(bisections):
        own = now.select("part", F.col("id").alias("src"))
        inner = cut_lineage(both.join(own, "src").join(now.select(F.col("part").alias("_p"), F.col("id").alias("dst")), "dst").filter(F.col("part") == F.col("_p")).select("part", "src", "dst"))
        first = levels_within(inner, now.groupBy("part").agg(F.min("id").alias("id")))
        last = first.groupBy("part").agg(F.max(F.struct("level", "id"))["id"].alias("id"))
        swept = levels_within(inner, last)
        placed = cut_lineage(now.join(swept, ["part", "id"], "left").withColumn("level", F.coalesce("level", F.lit((1 << 31) - 1))))
        counts = placed.groupBy("part", "level").agg(F.count(F.lit(1)).alias("n"))
        ahead = W.partitionBy("part").orderBy("level").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("half", F.ceil(F.sum("n").over(W.partitionBy("part")) / 2))
        joined = placed.join(counts, ["part", "level"])
        # Only the level in which the half ends is put in order.
        split = joined.filter((F.col("before") < F.col("half")) & (F.col("half") < F.col("before") + F.col("n")))
        ordered = split.withColumn("_r", F.row_number().over(W.partitionBy("part", "level").orderBy("id"))).select("id", (F.col("before") + F.col("_r") > F.col("half")).alias("_right"))
        right = joined.join(ordered, "id", "left").withColumn("_right", F.coalesce("_right", F.col("before") >= F.col("half")))
        now = cut_lineage(right.select("id", (2 * F.col("part") + F.col("_right").cast("int")).alias("part")))
    return now


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: edges between parts(id, part), and the least and the largest part."""
    cut = symmetric(edges).filter(F.col("src") < F.col("dst")).join(parts.select(F.col("id").alias("src"), F.col("part").alias("a")), "src").join(parts.select(F.col("id").alias("dst"), F.col("part").alias("b")), "dst")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.lit(1).alias("_k"))
    return cut.agg(F.count_if(F.col("a") != F.col("b")).alias("cut"), F.lit(1).alias("_k")).join(sizes, "_k").drop("_k")


def subdomains(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, part, separator) of parts(id, part): vertices with a neighbour in a part of a smaller number form the separator, so inner vertices of different parts don't touch."""
    both = symmetric(edges)
    touching = both.join(parts.select(F.col("id").alias("src"), F.col("part").alias("a")), "src").join(parts.select(F.col("id").alias("dst"), F.col("part").alias("b")), "dst").filter(F.col("a") > F.col("b"))
    return parts.join(touching.select(F.col("src").alias("id"), F.lit(True).alias("separator")).distinct(), "id", "left").withColumn("separator", F.coalesce("separator", F.lit(False)))


def nearest_by_path(edges: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """(source, id, dist, rank): for each of sources(id) its n nearest vertices by path length, then id; the source itself has rank 0.

    Weights must be positive (a lighter one raises an error): what a path passes is nearer than its end, so each round
    keeps n vertices a source and n - 1 rounds suffice. Of a vertex's edges only the n lightest (by weight, then end)
    can lead to one of the n nearest, so a hub offers n edges however many it has. Parallel edges count once.
    """
    from pyspark.sql import Window as W

    if n < 1:
        raise ValueError("n must be at least 1")
    lightest = W.partitionBy("src").orderBy("w", "dst")
    once = edges.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.min("w").alias("w"))
    checked = once.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(F.raise_error(F.lit("weights must be positive")).cast("double")))
    short = cut_lineage(checked.withColumn("_r", F.row_number().over(lightest)).filter(F.col("_r") <= n).drop("_r"))
    nearest = W.partitionBy("source").orderBy("dist", "id")
    now = cut_lineage(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh")).distinct())
    for _ in range(n - 1):
        offers = now.filter("fresh").select("source", F.col("id").alias("src"), "dist").join(short, "src").select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.lit(True).alias("fresh"))
        # Of equal distances the known one stands, so that an entry is offered onwards once for each distance.
        best = now.withColumn("fresh", F.lit(False)).unionByName(offers).groupBy("source", "id").agg(F.min(F.struct("dist", "fresh")).alias("b")).select("source", "id", "b.*")
        now = cut_lineage(best.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= n).drop("_r"))
        if not now.filter("fresh").limit(1).count():
            break
    return now.select("source", "id", "dist", (F.row_number().over(nearest) - 1).alias("rank"))
