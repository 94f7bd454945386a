"""The class cascade against a plain fold over tokens."""

import itertools
import random

from pyspark.sql import functions as F

from weftspark.functions import visibility as seen

UTILITIES = {u: True for u in seen.SHOWN} | {"hidden": False}


def plain(tokens):
    """Whether each band is hidden: token by token."""
    bands, ranks = [False] * 6, [-1] * 6
    for token in tokens:
        *variants, utility = token.split(":")
        utility = utility[1:] if utility.startswith("!") else utility
        if utility not in UTILITIES:
            continue
        held = set(range(6))
        for v in variants:
            name = v[4:] if v.startswith("max-") else v
            if name not in seen.BANDS[1:]:
                break
            at = seen.BANDS.index(name)
            held &= set(range(at)) if v.startswith("max-") else set(range(at, 6))
        else:
            for b in held:
                if (rank := int(bool(variants))) >= ranks[b]:
                    bands[b], ranks[b] = not UTILITIES[utility], rank
    return sum(1 << b for b, h in enumerate(bands) if h)


def test_masks_equal_a_fold_over_tokens(spark):
    rng = random.Random(5)
    variants = ["", "sm:", "md:", "max-lg:", "2xl:", "max-sm:", "base:", "hover:", "md:max-xl:", "lg:max-md:", ":"]
    utilities = ["hidden", "block", "!hidden", "!!hidden", "inline-flex", "table-row", "text-sm", "", "hidden:block"]
    rows = [(i, "\t ".join(rng.choice(variants) + rng.choice(utilities) for _ in range(rng.randrange(7)))) for i in range(1500)]
    frame = spark.createDataFrame(rows, "id int, classes string")
    got = dict(frame.select("id", seen.tokens_hidden(seen.class_tokens(F.col("classes")))).collect())
    assert got == {i: plain(c.split()) for i, c in rows}
    assert len(set(got.values())) > 20


def test_alternatives_states_and_overlaps(spark):
    rng = random.Random(2)
    choices = [[], ["hidden"], ["md:hidden"], ["block"], ["max-md:hidden", "x"], ["lg:block"]]
    rows = []
    for i in range(300):
        sides = [[rng.sample(choices, rng.choice((1, 1, 2, 3))) if rng.random() > 0.03 else None for _ in range(rng.randrange(1, 5))] for _ in range(2)]
        rows.append((i, *sides))
    kind = "array<array<array<string>>>"
    frame = spark.createDataFrame(rows, f"id int, a {kind}, b {kind}")
    told = frame.select("id", *(seen.merged_visibility(seen.class_alternatives(F.col(c))).alias(f"v{c}") for c in "ab"))
    got = {r.id: r for r in told.select("*", seen.overlap(F.col("va"), F.col("vb")).alias("overlap"), seen.both(F.col("va"), F.col("vb")).alias("both"), seen.small_only(F.col("va")).alias("small")).collect()}

    def states(parts):
        if None in parts or len(every := list(itertools.product(*parts))) > 32:
            return ["unknown"] * 6
        masks = [plain([t for alternative in one for t in alternative]) for one in every]
        return ["unknown" if len({m >> b & 1 for m in masks}) > 1 else "hidden" if masks[0] >> b & 1 else "visible" for b in range(6)]

    mask = lambda own, kind: sum(1 << b for b, s in enumerate(own) if s == kind)
    for i, a, b in rows:
        x, y = states(a), states(b)
        assert (got[i].va.hidden, got[i].va.unknown) == (mask(x, "hidden"), mask(x, "unknown")), (a, x)
        sure = any(s == t == "visible" for s, t in zip(x, y))
        assert got[i].overlap == (True if sure else None if any("hidden" not in p for p in zip(x, y)) else False)
        joint = ["hidden" if "hidden" in p else "visible" if p == ("visible", "visible") else "unknown" for p in zip(x, y)]
        assert (got[i].both.hidden, got[i].both.unknown) == (mask(joint, "hidden"), mask(joint, "unknown"))
        assert got[i].small == (x[0] != "hidden" and x[5] == "hidden")
    assert {r.overlap for r in got.values()} == {True, False, None}


def test_short_rows_are_dealt_before_their_classes_are_folded(spark):
    from weftspark.plans.registry import queries

    cores = spark.sparkContext.defaultParallelism
    for name in ("q49_visibility_bands", "q50_overlap_tristate", "q96_visibility_of_ancestors"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [p_partkey" in plan and f"{4 * cores}" in plan
