"""Propagation over an edge table (src, dst). Every round is a join; lineage ends in the shared folder after each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .materialize import cut
from .quality import ALIASES


def _pairs(edges: DataFrame, direction: str) -> DataFrame:
    ends = ("src", "dst") if direction == "down" else ("dst", "src")
    return edges.select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b")).where("a is not null and b is not null").distinct()


#: Rows of a table that a join may send to the driver and all executors.
SMALL = 50_000


def _near(df: DataFrame, n: int) -> DataFrame:
    """df of n rows, for a join: sent to all executors if it is small, else joined by sorting. Spark alone goes by bytes, of files or of a shuffle, and takes a million numbers, which compress well, for small."""
    return F.broadcast(df) if n <= SMALL else df.hint("merge")


def closure(edges: DataFrame, seeds: DataFrame, direction: str = "down", max_depth: int | None = None, levels: int = 12) -> DataFrame:
    """(seed, node, depth): nodes reached from each seed (itself left out) and the fewest steps to them. seeds: (seed).

    Goes level by level first. What is still open after `levels` levels is reached over express
    edges: nodes with one way in and one way out are passed in one step, found by doubling, so a
    chain of n nodes takes about log2(n) rounds. Ends when nothing new is found, at any depth, or
    at max_depth if that is given. For many seeds closure_all() has fewer rounds.
    """
    e = cut(_pairs(edges, direction))
    found = cut(seeds.select("seed").where("seed is not null").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    frontier, n = found, found.count()
    total = n
    for depth in range(1, min(levels, max_depth if max_depth is not None else levels) + 1):
        step = _near(frontier, n).join(e, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        frontier = cut(step.join(_near(found.select("seed", "node"), total), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        n = frontier.count()
        total += n
        if not n:
            return found.where("depth > 0")
        found = cut(found.union(frontier)) if depth % 8 == 0 else found.union(frontier)
    if max_depth is None or levels < max_depth:
        found = _far(e, frontier, found, max_depth)
    return found.where("depth > 0")


def _far(e: DataFrame, frontier: DataFrame, found: DataFrame, max_depth: int | None) -> DataFrame:
    """found and what lies beyond the frontier, over express edges."""
    line = chains(e, frontier.select("node"))
    inner = cut(line.where("head is not null").select("node", "head", "steps"))
    m = inner.count()
    around = inner.select("node")
    direct = e.join(_near(around.withColumnRenamed("node", "b"), m), "b", "left_anti")
    fast = direct.join(_near(around.withColumnRenamed("node", "a"), m), "a", "left_anti").select("a", "b", F.lit(1).alias("w"))
    fast = cut(fast.union(direct.join(_near(inner.withColumnRenamed("node", "a"), m), "a").select(F.col("head").alias("a"), "b", (F.col("steps") + 1).alias("w"))))
    near = cut(found)
    n = frontier.count()
    while True:
        step = _near(frontier, n).join(fast, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node"), (F.col("depth") + F.col("w")).alias("depth"))
        step = step if max_depth is None else step.where(F.col("depth") <= max_depth)
        better = step.groupBy("seed", "node").agg(F.min("depth").alias("depth")).join(_near(near.select("seed", "node", F.col("depth").alias("known")), near.count()), ["seed", "node"], "left")
        frontier = cut(better.where("known is null or depth < known").select("seed", "node", "depth"))
        n = frontier.count()
        if not n:
            break
        near = cut(near.union(frontier).groupBy("seed", "node").agg(F.min("depth").alias("depth")))
    passed = near.join(_near(inner.withColumnRenamed("node", "member"), m), F.col("node") == F.col("head")).select("seed", F.col("member").alias("node"), (F.col("depth") + F.col("steps")).alias("depth"))
    passed = passed if max_depth is None else passed.where(F.col("depth") <= max_depth)
    return near.union(passed).groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def closure_all(edges: DataFrame, direction: str = "down") -> DataFrame:
    """closure() with every node as a seed, by path doubling: paths of up to 2 k steps are one of exactly k and one of up to k. The result may have a row for every two nodes; rounds are the logarithm of the longest shortest path."""
    known = cut(_pairs(edges, direction).where("a <> b").withColumn("d", F.lit(1)))
    k = 1
    while True:
        whole = known.where(F.col("d") == k)
        more = whole.join(known.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("d").alias("further")), "b").where("a <> c")
        more = more.groupBy("a", F.col("c").alias("b")).agg((F.min("further") + k).alias("d"))
        new = cut(more.join(known.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "d"))
        if new.isEmpty():
            return known.select(F.col("a").alias("seed"), F.col("b").alias("node"), F.col("d").alias("depth"))
        known, k = cut(known.union(new)), k * 2


def chains(e: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(node, head, first, steps, least): nodes with one edge in and one out, other than those of keep; edges (a, b).

    head is the nearest node before it that isn't one itself, first the chain's node after head,
    steps the distance from head; on a cycle of nothing but such nodes head is null and least the
    smallest node of the cycle. Pointers double each round.
    """
    ins, outs = e.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("prev")).where("n = 1"), e.groupBy("a").agg(F.count("*").alias("n")).where("n = 1")
    inner = ins.select(F.col("b").alias("node"), "prev").join(outs.select(F.col("a").alias("node")).hint("merge"), "node", "left_semi")
    if keep is not None:
        inner = inner.join(keep.select("node").distinct().hint("merge"), "node", "left_anti")
    inner = cut(inner)
    n = inner.count()
    one = inner.select(F.col("node").alias("prev"), F.lit(True).alias("on"))
    now = cut(inner.join(_near(one, n), "prev", "left").select("node", F.col("prev").alias("at"), F.col("on").isNotNull().alias("going"), F.col("node").alias("first"), F.lit(1).alias("steps"), F.col("node").alias("least")))
    while True:
        there = now.select(F.col("node").alias("at"), *[F.col(c).alias(f"next {c}") for c in ("at", "going", "first", "steps", "least")])
        moved = now.where("going").join(_near(there, n), "at").select(
            "node", F.col("next at").alias("at"), F.col("next going").alias("going"), F.col("next first").alias("first"), (F.col("steps") + F.col("next steps")).alias("steps"), F.least("least", "next least").alias("least"),
            (~F.col("next going") | (F.col("next least") < F.col("least"))).alias("changed"))
        moved = cut(moved)
        if moved.where("changed").isEmpty():
            break
        now = cut(now.where("not going").union(moved.drop("changed")))
    return now.select("node", F.when(~F.col("going"), F.col("at")).alias("head"), "first", "steps", "least")


def levels(edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, level): the longest path from a node without upstreams, 0 for those; on an acyclic graph."""
    e = edges.select("src", "dst").distinct()
    roots = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    frontier = cut(roots.select("node", F.lit(0).alias("level")))
    every = frontier
    for k in range(1, max_depth + 1):
        frontier = cut(frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(k).alias("level")).distinct())
        if frontier.isEmpty():
            return every.groupBy("node").agg(F.max("level").alias("level"))
        every = every.union(frontier)
    raise ValueError("the graph has a cycle or is deeper than max_depth")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node) on a cycle or behind one: what is left after peeling nodes without upstreams again and again."""
    e = cut(edges.select("src", "dst").distinct())
    n = e.count()
    while n:
        nxt = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        m = nxt.count()
        if m == n:
            break
        e, n = nxt, m
    return e.select(F.col("dst").alias("node")).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """(component, node) of every node on a cycle: strongly connected components of two or more nodes, or of one with an edge to itself; component is the smallest node.

    Chains are passed as one edge (they are in a component if both their ends are in the same).
    The rest is trimmed of nodes that have no edge in or none out; then each node takes the
    largest node that reaches it as its colour, and what reaches a colour's own node within the colour
    is its component. Components leave, and it starts again with edges within a colour.
    """
    e = cut(_pairs(edges, "down"))
    loops = e.where("a = b").select(F.col("a").alias("node"))
    e = cut(e.where("a <> b"))
    line = cut(chains(e))
    inner = line.where("head is not null")
    plain = e.join(line.select(F.col("node").alias("a")), "a", "left_anti").join(line.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
    # the last node of a chain, whose edge leads to one that is on none
    last = cut(e.join(inner.select(F.col("node").alias("a"), "head", "first"), "a").join(line.select(F.col("node").alias("b")), "b", "left_anti").select("head", "first", F.col("b").alias("tail")))
    looped = last.where("head = tail").select(F.col("head").alias("node"))
    g = cut(plain.union(last.where("head <> tail").select(F.col("head").alias("a"), F.col("tail").alias("b"))).distinct())
    parts = []
    while True:
        g = _trimmed(g)
        if g.isEmpty():
            break
        colour = _spread(g, g.select(F.col("a").alias("node")).union(g.select("b")).distinct().withColumn("c", F.col("node")))
        same = colour.select(F.col("node").alias("a"), F.col("c").alias("ca"))
        within = cut(g.join(same, "a").join(same.toDF("b", "cb"), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")))
        own = frontier = cut(colour.where("node = c"))
        while not frontier.isEmpty():
            back = within.join(frontier.select(F.col("node").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("node"), "c").distinct()
            frontier = cut(back.join(own, ["node", "c"], "left_anti"))
            own = cut(own.union(frontier))
        parts.append(own)
        g = cut(within.select("a", "b").join(own.select(F.col("node").alias("a")), "a", "left_anti").join(own.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
    spark = edges.sparkSession
    kind = e.schema["a"].dataType
    none = spark.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("c", kind)]))
    large = none
    for p in parts:
        large = large.union(p.select("node", "c"))
    # single nodes count only with a chain, or an edge, back to themselves
    sizes = large.groupBy("c").agg(F.count("*").alias("n"))
    large = large.join(sizes, "c").where("n > 1").select("node", "c")
    large = cut(large.union(looped.distinct().join(large.select("node"), "node", "left_anti").select("node", F.col("node").alias("c"))))
    ends = last.join(large.select(F.col("node").alias("head"), "c"), "head").join(large.select(F.col("node").alias("tail"), F.col("c").alias("ct")), "tail").where("c = ct")
    passed = inner.join(ends.select("head", "first", "c"), ["head", "first"]).select("node", "c")
    own = large.union(passed).distinct()
    least = own.groupBy("c").agg(F.min("node").alias("component"))
    out = cut(own.join(least, "c").select("component", "node").union(line.where("head is null").select(F.col("least").alias("component"), "node")))
    return out.union(loops.join(out.select("node"), "node", "left_anti").select(F.col("node").alias("component"), "node"))


def _trimmed(g: DataFrame) -> DataFrame:
    """g without nodes that have no edge in or none out, again and again."""
    n = g.count()
    while n:
        g = cut(g.join(g.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(g.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
        m = g.count()
        if m == n:
            break
        n = m
    return g


def _spread(g: DataFrame, colour: DataFrame) -> DataFrame:
    """Each node's colour, the largest c that reaches it."""
    colour = cut(colour)
    changed = colour
    while True:
        got = g.join(changed.select(F.col("node").alias("a"), "c"), "a").groupBy(F.col("b").alias("node")).agg(F.max("c").alias("got"))
        nxt = cut(colour.join(got, "node", "left").select("node", F.greatest("c", F.coalesce("got", "c")).alias("c"), (F.col("got") > F.col("c")).alias("new")))
        colour, changed = nxt.select("node", "c"), nxt.where("new").select("node", "c")
        if changed.isEmpty():
            return colour


def affected(edges: DataFrame, changed: DataFrame, added: DataFrame) -> DataFrame:
    """(node, reason): new, changed, or downstream of the first changed parent, else of the first changed ancestor."""
    seeds = changed.select("node").union(added.select("node")).distinct()
    reach = closure(edges, seeds.select(F.col("node").alias("seed")))
    near = reach.groupBy("node").agg(F.min(F.when(F.col("depth") == 1, F.col("seed"))).alias("parent"), F.min("seed").alias("ancestor"))
    own = changed.select("node", F.lit("changed").alias("own")).union(added.select("node", F.lit("new").alias("own"))).groupBy("node").agg(F.max("own").alias("own"))
    j = near.join(own, "node", "full")
    return j.select("node", F.coalesce("own", F.concat(F.lit("downstream of "), F.coalesce("parent", "ancestor"))).alias("reason"))


def removal(edges: DataFrame, node) -> DataFrame:
    """(node, depth, orphan): what lies downstream of a removed node; orphans have no other upstream."""
    spark = edges.sparkSession
    down = closure(edges, spark.range(1).select(F.lit(node).alias("seed")))
    others = edges.where(F.col("src") != node).select(F.col("dst").alias("node")).distinct().withColumn("has", F.lit(True))
    return down.join(others, "node", "left").select("node", "depth", F.col("has").isNull().alias("orphan"))


# Type changes that lose nothing; any other change of type breaks.
SAFE_CHANGES = [
    ("INT", "BIGINT"), ("INT", "FLOAT"), ("INT", "DOUBLE"), ("BIGINT", "DOUBLE"), ("FLOAT", "DOUBLE"), ("SMALLINT", "INT"), ("SMALLINT", "BIGINT"), ("TINYINT", "INT"), ("TINYINT", "BIGINT"), ("VARCHAR", "STRING"), ("CHAR", "STRING"), ("CHAR", "VARCHAR"), ("DATE", "TIMESTAMP"),
]
OTHER_NAMES = {k: v for k, v in ALIASES.items() if k not in {t for pair in SAFE_CHANGES for t in pair}}


def compatible(old: Column, new: Column) -> Column:
    """Whether a column of type `new` can stand in for one of type `old`: the same type, under any of its names, or a safe change."""
    names = F.create_map(*[F.lit(x) for p in OTHER_NAMES.items() for x in p])
    plain = lambda c: F.coalesce(names[F.upper(F.trim(c))], F.upper(F.trim(c)))
    pair = F.concat(plain(old), F.lit(">"), plain(new))
    return (plain(old) == plain(new)) | pair.isin(*[f"{a}>{b}" for a, b in SAFE_CHANGES])


def impact(edges: DataFrame, refs: DataFrame, contracts: DataFrame, changes: DataFrame) -> DataFrame:
    """(node, depth, columns, violations, severity) of everything downstream of changed tables.

    changes: (table, column, kind, old_type, new_type, new_name), kind ADD, REMOVE, RENAME or
    TYPE_CHANGE; refs: (node, table, column) that a node reads; contracts: (node, column,
    data_type) that it promises. Names are compared in lower case. A node is affected by the columns
    it reads, old names and new ones. A promised column that goes, is renamed, or takes a type that
    can't stand in for the promised one is a violation, and breaks. Without one, reading a
    removed or renamed column, or one whose new type can't stand in for the old, breaks; another
    change of type warns; the rest informs.
    """
    ch = changes.select("table", F.lower("column").alias("column"), "kind", "old_type", "new_type", F.lower("new_name").alias("new_name"))
    reach = cut(closure(edges, ch.select(F.col("table").alias("seed")).distinct()))
    hit = reach.withColumnRenamed("seed", "table").join(_near(ch, ch.count()), "table")
    names = hit.withColumn("column", F.explode(F.array_compact(F.array("column", "new_name"))))
    change = F.when(F.col("kind").isin("REMOVE", "RENAME"), 2).when(F.col("kind") == "TYPE_CHANGE", F.when(compatible(F.col("old_type"), F.col("new_type")) | F.col("old_type").isNull() | F.col("new_type").isNull(), 1).otherwise(2)).otherwise(0)
    read = names.join(refs.select("node", "table", F.lower("column").alias("column")).hint("merge"), ["node", "table", "column"], "left_semi").groupBy("node").agg(F.sort_array(F.collect_set("column")).alias("columns"), F.max(change).alias("rank"))
    what = F.when(F.col("kind") == "REMOVE", "COLUMN_REMOVED").when(F.col("kind") == "RENAME", "COLUMN_RENAMED").when((F.col("kind") == "TYPE_CHANGE") & F.col("new_type").isNotNull() & ~compatible(F.col("data_type"), F.col("new_type")), "TYPE_CHANGED")
    broken = hit.join(contracts.select("node", F.lower("column").alias("column"), "data_type").hint("merge"), ["node", "column"]).withColumn("what", what).where("what is not null")
    broken = broken.groupBy("node").agg(F.sort_array(F.collect_set(F.concat("column", F.lit(" "), "what"))).alias("violations"))
    g = reach.groupBy("node").agg(F.min("depth").alias("depth")).join(read.hint("merge"), "node", "left").join(broken.hint("merge"), "node", "left")
    none = F.array().cast("array<string>")
    rank = F.when(F.col("violations").isNotNull(), 2).otherwise(F.coalesce("rank", F.lit(0)))
    return g.select("node", "depth", F.coalesce("columns", none).alias("columns"), F.coalesce("violations", none).alias("violations"), F.element_at(F.array(F.lit("INFO"), F.lit("WARNING"), F.lit("BREAKING")), rank + 1).alias("severity"))


# how much of the column behind it a hop leaves, from all to none
TRANSFORMS = ("direct", "cast", "case", "expression", "window", "aggregate", "literal")


def lineage_trace(lineage: DataFrame, table, column: str, max_depth: int = 50, ranks: tuple[str, ...] = TRANSFORMS) -> DataFrame:
    """(table, column, depth, terminal, path, transforms, transform) behind a column; each (table, column) once, terminals have no source of their own.

    path is the shortest way to it, of equal ones the first in order of its "table.column" names,
    transforms the hops' kinds along it, and transform their composition: the furthest of them in
    `ranks`. A kind that ranks doesn't hold counts as the last, a null one as direct. Of several edges
    between two columns the nearest to direct counts.
    """
    name = lambda t, c: F.concat_ws(".", F.col(t).cast("string"), F.col(c))
    at = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, ranks)), c) - 1, F.lit(0))
    rank = F.when(F.array_contains(F.array(*map(F.lit, ranks)), F.col("kind")), at(F.col("kind"))).otherwise(len(ranks) - 1)
    e = lineage.select(F.struct(F.col("table").cast("string").alias("t"), F.col("column").alias("c")).alias("a"), F.struct(F.col("source_table").cast("string").alias("t"), F.col("source_column").alias("c")).alias("b"), name("source_table", "source_column").alias("name"), F.coalesce("transform", F.lit("direct")).alias("kind"))
    e = cut(e.withColumn("rank", rank.cast("int")).groupBy("a", "b", "name").agg(F.min(F.struct("rank", "kind")).alias("hop")))
    spark = lineage.sparkSession
    start = F.struct(F.lit(str(table)).alias("t"), F.lit(column).alias("c"))
    frontier = cut(spark.range(1).select(start.alias("node"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"), F.array().cast(e.select(F.array("hop").alias("h")).schema["h"].dataType).alias("hops")))
    found = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.struct(F.array_append("path", F.col("name")).alias("path"), F.array_append("hops", F.col("hop")).alias("hops")).alias("way"))
        # ways of one length to one node end alike, so the least is that of the least way to the node before
        step = step.groupBy("node").agg(F.min("way").alias("way")).join(found.select("node"), "node", "left_anti")
        frontier = cut(step.select("node", F.lit(depth).alias("depth"), "way.path", "way.hops"))
        if frontier.isEmpty():
            break
        found = cut(found.union(frontier)) if depth % 8 == 0 else found.union(frontier)
    has = e.select(F.col("a").alias("node")).distinct().withColumn("has", F.lit(True))
    out = found.where("depth > 0").join(has, "node", "left")
    return out.select(F.col("node.t").alias("table"), F.col("node.c").alias("column"), "depth", F.col("has").isNull().alias("terminal"), "path", F.transform("hops", lambda h: h["kind"]).alias("transforms"), F.array_max("hops")["kind"].alias("transform"))


def fragility(edges: DataFrame, p: DataFrame) -> DataFrame:
    """(node, upstream_risk, cascade, score, critical) from failure probabilities p (node, p); for dependency-size graphs, as it needs all pairs."""
    nodes = p.select("node", "p")
    n = nodes.count()
    pairs = cut(closure_all(edges).join(nodes.select(F.col("node").alias("seed")), "seed", "left_semi"))
    up = pairs.join(nodes.select(F.col("node").alias("seed"), F.col("p").alias("up")), "seed").groupBy("node").agg(F.max(F.col("up") * F.pow(F.lit(0.8), F.col("depth"))).alias("upstream_risk"), F.min("up").alias("weakest"))
    down = pairs.groupBy(F.col("seed").alias("node")).agg(F.count("*").alias("downstream"))
    j = nodes.join(up, "node", "left").join(down, "node", "left").na.fill(0, ["upstream_risk", "downstream"])
    cascade = F.least(F.lit(1.0), F.col("downstream") * F.col("p") / n)
    score = F.round(F.least(10 * (0.4 * F.col("p") + 0.3 * F.least(F.col("upstream_risk"), F.lit(1.0)) + 0.3 * cascade), F.lit(10.0)), 2)
    return j.select("node", F.round("upstream_risk", 6).alias("upstream_risk"), F.round(cascade, 6).alias("cascade"), score.alias("score"), ((F.col("p") > 0.3) & (F.coalesce("weakest", F.lit(1.0)) > 0.3)).alias("critical"))
