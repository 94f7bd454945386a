"""Guarded path expansion and multi-hop resolution over edge tables, by rounds that are settled each.

An expansion keeps every path from a root apart (a diamond gives two instances of its
lower node), with the guards met on it and the screen bands in which it is hidden or
unknown. A resolution keeps only which nodes a start has reached, and folds what it
finds into one state. All starts and roots advance together, one join a round.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.operators.graphs import settled

GUARDS = "array<struct<guard:string,branch:string>>"


class Limits(NamedTuple):
    """Where an expansion stops; each stop becomes a reason of its root."""

    depth: int = 32
    guards: int = 32
    instances: int = 2048


class Expansion(NamedTuple):
    instances: DataFrame
    roots: DataFrame


def opposite(guards: Column, guard: Column, branch: Column) -> Column:
    """Whether guards hold the same guard on another branch: both cannot be met."""
    return F.coalesce(F.exists(guards, lambda g: (g["guard"] == guard) & (g["branch"] != branch)), F.lit(False))


def compatible(left: Column, right: Column) -> Column:
    """Whether two guard sets can hold at once."""
    return ~F.exists(left, lambda g: opposite(right, g["guard"], g["branch"]))


def expand_paths(edges: DataFrame, roots: DataFrame, limits: Limits = Limits()) -> Expansion:
    """Every path of edges from the roots, and each root's completeness.

    edges(edge, src, dst, guard, branch, hidden, unknown): ``guard`` is null on edges without one;
    hidden and unknown are bit masks of bands. roots(root, node). Edges of a path are taken in
    the order of ``edge``.

    instances(root, path (its edges), node, depth, guards (as met), hidden, unknown (bands that are
    not hidden anywhere on the path, but unknown somewhere), truncated (the guard limit was
    met)). A path does not take an edge whose guard it holds on the other branch. It ends at a node
    that it already holds (reason ``cycle``; the edge back is an instance) and at the depth
    limit (reason ``depth``, if an edge goes on). Guards beyond their limit are
    left out (``guards``). Of a root the first instances in depth-first order stay
    (``instances``): a path is cut as soon as so many known ones come before it,
    since all that follow from it come after it too, so no more than the limit are ever carried.
    roots(root, complete, reasons): reasons are sorted; a root without edges is complete.
    """
    edges = settled(edges.select("edge", "src", "dst", "guard", "branch", "hidden", "unknown"))
    kind = edges.schema["edge"].dataType.simpleString()
    start = roots.select("root", "node").distinct()
    front = settled(start.select("root", F.expr(f"cast(array() as array<{kind}>)").alias("path"), F.array("node").alias("nodes"), "node", F.lit(0).alias("depth"), F.expr(f"cast(array() as {GUARDS})").alias("guards"), F.lit(0).alias("hidden"), F.lit(0).alias("unknown"), F.lit(False).alias("truncated"), F.lit(False).alias("back")))
    known, reasons = None, start.select("root", F.lit(None).cast("string").alias("reason")).limit(0)
    depth = 0
    while True:
        on = front.where("not back").join(edges, F.col("node") == F.col("src")).where(~opposite(F.col("guards"), F.col("guard"), F.col("branch")))
        if depth == limits.depth:
            reasons = reasons.union(on.select("root", F.lit("depth")).distinct())
            break
        depth += 1
        own = F.struct("guard", "branch")
        new = F.col("guard").isNotNull() & ~F.array_contains(F.transform("guards", lambda g: g["guard"]), F.col("guard"))
        full = F.size("guards") >= limits.guards
        step = on.select(
            "root", F.concat("path", F.array("edge")).alias("path"), F.concat("nodes", F.array("dst")).alias("nodes"), F.col("dst").alias("node"), F.lit(depth).alias("depth"),
            F.when(new & ~full, F.concat("guards", F.array(own))).otherwise(F.col("guards")).alias("guards"),
            front["hidden"].bitwiseOR(edges["hidden"]).alias("hidden"), front["unknown"].bitwiseOR(edges["unknown"]).alias("unknown"),
            (F.col("truncated") | new & full).alias("truncated"), F.array_contains("nodes", F.col("dst")).alias("back"),
        )
        every = step.withColumn("_new", F.lit(True)) if known is None else known.withColumn("_new", F.lit(False)).unionByName(step.withColumn("_new", F.lit(True)))
        ranked = settled(every.withColumn("_place", F.row_number().over(Window.partitionBy("root").orderBy("path"))))
        reasons = settled(reasons.union(ranked.where(F.col("_place") > limits.instances).select("root", F.lit("instances")).distinct()).distinct())
        kept = ranked.where(F.col("_place") <= limits.instances).drop("_place")
        known, front = kept.drop("_new"), kept.where("_new").drop("_new")
        if front.isEmpty():
            break
    found = known.select("root", "path", "node", "depth", "guards", "hidden", F.col("unknown").bitwiseAND(F.bitwise_not("hidden")).alias("unknown"), "truncated", "back")
    told = reasons.union(found.where("back").select("root", F.lit("cycle"))).union(found.where("truncated").select("root", F.lit("guards"))).distinct()
    lists = told.groupBy("root").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    states = start.select("root").distinct().join(lists, "root", "left").select("root", F.col("reasons").isNull().alias("complete"), F.coalesce("reasons", F.expr("cast(array() as array<string>)")).alias("reasons"))
    return Expansion(found.drop("back"), states)


def _walk(starts: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Every (start, node, hops) up to a number of hops, and those of just that number. A node comes again in each round that reaches it."""
    front = every = settled(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")))
    for k in range(1, hops + 1):
        front = settled(front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(k).alias("hops")).distinct())
        if front.isEmpty():
            break
        every = every.union(front)
    return every, front


def resolve(aliases: DataFrame, declared: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, state, target and hops of every start(node), following aliases to declarations.

    aliases(src, dst, star): a node's named aliases hide its star ones. declared(node): a declaration
    ends the walk. state: ``resolved`` (one declaration is reached; hops is the least number of
    aliases), ``ambiguous`` (several; target and hops are null), ``cycle`` (none, and a node
    is reached that comes back to itself), ``spent`` (none within ``hops`` aliases, and there
    are more), ``missing`` (none, and the walk ends). Two ways to one node are no cycle.
    """
    ends = settled(declared.select(F.col("node").alias("end")).distinct())
    named = aliases.where("not star").select("src").distinct()
    every = aliases.where("not star").select("src", "dst").union(aliases.where("star").join(named, "src", "left_anti").select("src", "dst")).distinct()
    edges = settled(every.join(ends, F.col("src") == F.col("end"), "left_anti"))
    asked = starts.select(F.col("node").alias("start")).distinct()
    walked, front = _walk(asked, edges, hops)
    least = settled(walked.groupBy("start", "node").agg(F.min("hops").alias("hops")))
    found = least.join(ends, F.col("node") == F.col("end")).groupBy("start").agg(F.count("*").alias("targets"), F.min("node").alias("target"), F.min("hops").alias("hops"))
    # Only walks that have not ended and found nothing can hold a cycle that matters: their nodes walk once more, to come back to themselves.
    more = settled(front.join(edges, F.col("node") == F.col("src")).select("start").distinct().join(found, "start", "left_anti"))
    nodes = least.join(more, "start", "left_semi").select(F.col("node").alias("start")).distinct()
    back = _walk(nodes, edges, hops)[0].where("hops > 0 and start = node").select("node").distinct()
    cyclic = least.join(more, "start", "left_semi").join(back, "node", "left_semi").select("start", F.lit(True).alias("cyclic")).distinct()
    told = asked.join(found, "start", "left").join(more.withColumn("more", F.lit(True)), "start", "left").join(cyclic, "start", "left")
    state = F.when(F.col("targets") == 1, "resolved").when(F.col("targets") > 1, "ambiguous").when(F.col("cyclic"), "cycle").when(F.col("more"), "spent").otherwise("missing")
    one = F.col("targets") == 1
    return told.select("start", state.alias("state"), F.when(one, F.col("target")).alias("target"), F.when(one, F.col("hops")).alias("hops"))
