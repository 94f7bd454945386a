"""Containment in nested spans: what is around or inside an element, and the nearest scope of a place or a name.

Elements are a nested set (``sources.html.elements``), and spans nest or stay apart as
those of a tree do. So containment needs no join of pairs: the furthest end of what
began before tells whether a scope is still open, and the last scope that opened at the
present depth is the innermost one. Both are running values over one sort by page
and place; a page's elements, which come from one row, are what one task holds at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _in_order() -> WindowSpec:
    return Window.partitionBy("page_id").orderBy("elem_id")


def within(match: Column) -> Column:
    """Whether an element around this one matches."""
    furthest = F.max(F.when(match, F.col("last"))).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(furthest >= F.col("elem_id"), F.lit(False))


def within_mask(mask: Column, bits: int) -> Column:
    """The bits that any element around this one has in a mask: one running value a bit, over one sort."""
    out = F.lit(0)
    for k in range(bits):
        out = out.bitwiseOR(F.when(within(mask.bitwiseAND(F.lit(1 << k)) != 0), 1 << k).otherwise(0))
    return out


def contains(match: Column) -> Column:
    """Whether an element inside this one matches."""
    # From the end backwards: a frame that reaches to the end would be read again for every row.
    nearest = F.min(F.when(match, F.col("elem_id"))).over(Window.partitionBy("page_id").orderBy(F.desc("elem_id")).rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(nearest <= F.col("last"), F.lit(False))


def nearest_scope(points: DataFrame, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """The points with ``scope`` (the innermost of their key's scopes around them) and ``state``.

    points(keys..., at, ...), scopes(keys..., scope, start, end): a scope holds the places from
    start to before end, and scopes of one key nest or stay apart. state: ``resolved``;
    ``ambiguous`` where two scopes of the same span are innermost (scope is then the
    smallest of them); ``none`` without a scope, and for points whose key or place is null. Empty
    and null spans hold nothing. No pair of a point and a scope is made: opens, closes and points
    are swept in order.
    """
    payload = [c for c in points.columns if c not in keys]
    spans = scopes.where("end > start").groupBy(*keys, "start", "end").agg(F.min("scope").alias("scope"), F.count("*").alias("n"))
    told = F.struct("scope", "n")
    kind = spans.select(told.alias("t")).schema["t"].dataType
    nothing, row = F.lit(None).cast(kind), points.select(F.struct(*payload).alias("row")).schema["row"].dataType
    event = lambda frame, at, order, delta, size, scope, held: frame.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(order).alias("_order"), F.lit(delta).alias("_delta"), size.cast("long").alias("_size"), scope.alias("_scope"), held.alias("_row"))
    none = F.lit(None).cast(row)
    events = (
        event(spans, "end", 0, -1, F.lit(0), nothing, none)
        .unionByName(event(spans, "start", 1, 1, F.col("start") - F.col("end"), told, none))
        .unionByName(event(points.where(" and ".join(f"`{k}` is not null" for k in [*keys, "at"])), "at", 2, 0, F.lit(0), nothing, F.struct(*payload)))
    )
    by = Window.partitionBy(*keys).orderBy("_at", "_order", "_size").rowsBetween(Window.unboundedPreceding, 0)
    deep = events.withColumn("_depth", F.sum("_delta").over(by)).where("_order > 0")
    innermost = F.last("_scope", ignorenulls=True).over(Window.partitionBy(*keys, "_depth").orderBy("_at", "_order", "_size").rowsBetween(Window.unboundedPreceding, 0))
    found = deep.withColumn("_found", innermost).where("_row is not null")
    state = F.when(F.col("_found.n") == 1, "resolved").when(F.col("_found.n") > 1, "ambiguous").otherwise("none")
    out = found.select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in payload), F.col("_found.scope").alias("scope"), state.alias("state"))
    lost = points.where(" or ".join(f"`{k}` is null" for k in [*keys, "at"]))
    missing = lost.select(*keys, *payload, F.lit(None).cast(kind["scope"].dataType).alias("scope"), F.lit("none").alias("state"))
    return out.unionByName(missing).select(*points.columns, "scope", "state")


def with_owner(elements: DataFrame, match: Column, name: str = "owner") -> DataFrame:
    """The elements with the elem_id of the nearest element around each that matches; null without one, or without a page_id.

    One pass over the elements: each is an event where it stands, and one that matches also opens
    and closes a scope, so what made the elements is not run again for the scopes.
    """
    event = lambda at, order, delta: F.struct(at.cast("long").alias("_at"), F.lit(order).alias("_order"), F.lit(delta).alias("_delta"))
    here, opens, closes = event(F.col("elem_id"), 2, 0), event(F.col("elem_id") + 1, 1, 1), event(F.col("last") + 1, 0, -1)
    scope = F.coalesce(match, F.lit(False)) & F.col("page_id").isNotNull() & (F.col("last") > F.col("elem_id"))
    # A scope's own events carry no more of the element than its number.
    events = elements.select(F.struct(*elements.columns).alias("_row"), F.when(scope, F.array(here, opens, closes)).otherwise(F.array(here)).alias("_events"))
    events = events.select("_row", F.inline("_events")).select(F.col("_row.page_id").alias("page_id"), "_at", "_order", "_delta", F.when(F.col("_order") == 1, F.col("_row.elem_id")).alias("_scope"), F.when(F.col("_order") == 2, F.col("_row")).alias("_row"))
    by = lambda *keys: Window.partitionBy(*keys).orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    deep = events.withColumn("_depth", F.sum("_delta").over(by("page_id"))).where("_order > 0")
    found = deep.withColumn("_found", F.last("_scope", ignorenulls=True).over(by("page_id", "_depth"))).where("_order = 2")
    owner = F.when(F.col("_depth") > 0, F.col("_found"))
    return found.select(*(F.col(f"_row.`{c}`").alias(c) for c in elements.columns), owner.alias(name))


def equal_names(named: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, members, pairs and the first two places of the names that several of a key's rows share; named(keys..., name, at).

    The pairs of equal names are counted, not made. Rows without a name share the null name.
    """
    place = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("at"))
    nth = lambda k: F.min(F.when(F.col("_place") == k, F.col("at")))
    groups = named.withColumn("_place", place).groupBy(*keys, "name").agg(F.count("*").alias("members"), nth(1).alias("first"), nth(2).alias("second"))
    pairs = F.expr("members * (members - 1) div 2")
    return groups.where("members > 1").select(*keys, "name", "members", pairs.alias("pairs"), "first", "second")
