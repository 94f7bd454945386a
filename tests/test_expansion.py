"""Guarded expansions and resolutions against depth-first versions on random graphs."""

import random
from collections import Counter

import pytest

from weftspark.operators.expansion import Limits, compatible, expand_paths, resolve

EDGE = "edge long, src long, dst long, guard string, branch string, hidden int, unknown int"


def depth_first(edges, roots, limits):
    """Instances in depth-first order, and the reasons of each root, by recursion."""
    rows, reasons = [], {}
    for root, node in roots:
        out, why = [], set()

        def visit(at, path, nodes, guards, hidden, unknown, cut):
            for e, src, dst, guard, branch, h, u in sorted(edges):
                if src != at or any(g == guard and b != branch for g, b in guards):
                    continue
                if len(path) == limits.depth:
                    why.add("depth")
                    continue
                if len(out) == limits.instances:
                    why.add("instances")
                    return
                new = guard is not None and guard not in [g for g, _ in guards]
                full = len(guards) >= limits.guards
                own = [*guards, (guard, branch)] if new and not full else guards
                now = cut or new and full
                out.append((root, [*path, e], dst, len(path) + 1, own, hidden | h, (unknown | u) & ~(hidden | h), now))
                if now:
                    why.add("guards")
                if dst in nodes:
                    why.add("cycle")
                else:
                    visit(dst, [*path, e], [*nodes, dst], own, hidden | h, unknown | u, now)

        visit(node, [], [node], [], 0, 0, False)
        rows += out
        reasons[root] = sorted(why)
    return rows, reasons


@pytest.mark.parametrize("seed,limits", [(1, Limits(6, 32, 10_000)), (2, Limits(5, 2, 10_000)), (3, Limits(32, 32, 25)), (4, Limits(3, 1, 7))])
def test_expansions_equal_depth_first(spark, seed, limits):
    rng = random.Random(seed)
    edges = []
    for e in range(26):
        guard = rng.choice((None, "a", "b", "c"))
        edges.append((e, rng.randrange(12), rng.randrange(12), guard, guard and rng.choice(("yes", "no")), rng.choice((0, 0, 3, 32)), rng.choice((0, 0, 48))))
    roots = [(f"r{i}", rng.randrange(12)) for i in range(6)] + [("lonely", 99)]
    wanted, reasons = depth_first(edges, roots, limits)
    got = expand_paths(spark.createDataFrame(edges, EDGE), spark.createDataFrame(roots, "root string, node long"), limits)
    rows = [(r.root, list(r.path), r.node, r.depth, [tuple(g) for g in r.guards], r.hidden, r.unknown, r.truncated) for r in got.instances.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, wanted))
    told = {r.root: (r.complete, r.reasons) for r in got.roots.collect()}
    if limits.instances > 1000:
        assert told == {k: (not v, v) for k, v in reasons.items()}
    else:  # What is left out by the instance limit is not looked at for other reasons.
        assert all(("instances" in v[1]) == ("instances" in reasons[k]) and v[0] == (not v[1]) for k, v in told.items())


def test_diamonds_stay_apart_and_branches_exclude_each_other(spark):
    edges = [(1, 0, 1, None, None, 0, 0), (2, 0, 2, None, None, 0, 0), (3, 1, 3, "g", "yes", 7, 0), (4, 2, 3, "g", "no", 0, 56), (5, 3, 4, "g", "no", 8, 0)]
    got = expand_paths(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(0, 0)], "root int, node long"))
    assert {tuple(r.path): (r.hidden, r.unknown) for r in got.instances.collect()} == {(1,): (0, 0), (2,): (0, 0), (1, 3): (7, 0), (2, 4): (0, 56), (2, 4, 5): (8, 48)}
    assert [tuple(r) for r in got.roots.collect()] == [(0, True, [])]
    sets = "array<struct<guard:string,branch:string>>"
    pairs = spark.createDataFrame([([("g", "yes")], [("g", "no")]), ([("g", "yes"), ("h", "no")], [("h", "no")]), ([], [("g", "no")])], f"a {sets}, b {sets}")
    assert [r[0] for r in pairs.select(compatible(pairs.a, pairs.b)).collect()] == [False, True, True]


def plain_state(start, edges, ends, hops):
    levels = [{start}]
    for _ in range(hops):
        levels.append({d for n in levels[-1] for d in edges.get(n, ()) if n not in ends})
    met = {}
    for k, level in enumerate(levels):
        for n in level:
            met.setdefault(n, k)
    found = [n for n in met if n in ends]
    if len(found) == 1:
        return "resolved", found[0], met[found[0]]
    if found:
        return "ambiguous", None, None
    if not any(edges.get(n) for n in levels[-1] if n not in ends):
        return "missing", None, None

    def returns(node):
        front = {node}
        for _ in range(hops):
            front = {d for n in front for d in edges.get(n, ()) if n not in ends}
            if node in front:
                return True
        return False

    return ("cycle" if any(returns(n) for n in met) else "spent"), None, None


@pytest.mark.parametrize("seed,hops", [(1, 4), (2, 8), (3, 1), (4, 30)])
def test_resolutions_equal_walks_of_each_start(spark, seed, hops):
    rng = random.Random(seed)
    n = 160
    given = [(rng.randrange(n), rng.randrange(n), rng.random() < 0.5) for _ in range(170)] + [(200 + i, 201 + i, False) for i in range(12)] + [(300, 301, True), (300, 302, True), (301, 303, True), (302, 303, True)]
    ends = {rng.randrange(n) for _ in range(8)} | {303}
    edges = {}
    for s, d, star in given:
        if not star or not any(x == s and not t for x, _, t in given):
            edges.setdefault(s, set()).add(d)
    starts = [*range(n), *range(200, 214), 300, 303]
    got = resolve(spark.createDataFrame(given, "src long, dst long, star boolean"), spark.createDataFrame([(e,) for e in ends], "node long"), spark.createDataFrame([(s,) for s in starts], "node long"), hops)
    rows = {r.start: (r.state, r.target, r.hops) for r in got.collect()}
    assert rows == {s: plain_state(s, edges, ends, hops) for s in starts}
    if seed == 1:
        assert {"resolved", "ambiguous", "cycle", "spent", "missing"} == {r[0] for r in rows.values()} or Counter(r[0] for r in rows.values())["spent"]
