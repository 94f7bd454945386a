"""In which of six screen bands an element with given classes is seen, as bit masks in column expressions.

Bit i of a mask stands for band i (BANDS). A state is a struct of two masks: ``hidden``
and ``unknown``; bands in neither are visible. Classes are folded from left to right:
a token with variants overrides one without, whatever their order, else the later one
wins, each for the bands it covers. Several alternatives (a conditional class) leave a
band unknown where they differ, and so do classes that cannot be told.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("base", "sm", "md", "lg", "xl", "2xl")
ALL = (1 << len(BANDS)) - 1
#: Alternatives of an element's classes beyond which they cannot be told.
MOST_ALTERNATIVES = 32
# Utilities that set how an element is displayed.
SHOWN = ("block", "contents", "flex", "flow-root", "grid", "inline", "inline-block", "inline-flex", "inline-grid", "table", "table-cell", "table-row")
HIDDEN = ("hidden",)

_VARIANTS = {name: ALL & ~((1 << i) - 1) for i, name in enumerate(BANDS) if i} | {f"max-{name}": (1 << i) - 1 for i, name in enumerate(BANDS) if i}


def _known(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def class_tokens(classes: Column) -> Column:
    """The tokens of a class attribute."""
    return F.filter(F.split(classes, r"\s+"), lambda t: t != "")


def token_effect(token: Column) -> Column:
    """bands (mask), varied (whether variants limit it) and shown of a display token; null for any other, one with an unknown variant too."""
    parts = F.split(token, ":")
    size = F.size(parts)
    shown = F.element_at(_known(dict.fromkeys(SHOWN, True) | dict.fromkeys(HIDDEN, False)), F.regexp_replace(F.element_at(parts, -1), "^!", ""))
    bands = F.reduce(F.slice(parts, F.lit(1), size - 1), F.lit(ALL), lambda held, v: held.bitwiseAND(F.element_at(_known(_VARIANTS), v)))
    return F.when(shown.isNotNull() & bands.isNotNull(), F.struct(bands.alias("bands"), (size > 1).alias("varied"), shown.alias("shown")))


def tokens_hidden(tokens: Column) -> Column:
    """The mask of the bands in which an element with these class tokens is hidden."""
    start = F.struct(F.lit(0).alias("plain"), F.lit(0).alias("over"), F.lit(0).alias("set"))

    def fold(held: Column, e: Column) -> Column:
        off = F.when(e["shown"], 0).otherwise(e["bands"])
        over = held["over"].bitwiseAND(F.bitwise_not(e["bands"])).bitwiseOR(off)
        return F.struct(
            F.when(e["varied"], held["plain"]).otherwise(off).alias("plain"),
            F.when(e["varied"], over).otherwise(held["over"]).alias("over"),
            F.when(e["varied"], held["set"].bitwiseOR(e["bands"])).otherwise(held["set"]).alias("set"),
        )

    effects = F.filter(F.transform(tokens, token_effect), lambda e: e.isNotNull())
    return F.reduce(effects, start, fold, lambda s: s["plain"].bitwiseAND(F.bitwise_not(s["set"])).bitwiseOR(s["over"]))


def state(hidden: Column, unknown: Column) -> Column:
    return F.struct(hidden.cast("int").alias("hidden"), unknown.cast("int").alias("unknown"))


def class_alternatives(parts: Column) -> Column:
    """Every choice of one alternative (a list of tokens) a part, joined in order; null where a part is null or there are more than MOST_ALTERNATIVES."""
    none = F.array(F.expr("cast(array() as array<string>)"))
    several = F.reduce(parts, F.lit(1), lambda n, p: F.when(n <= MOST_ALTERNATIVES, n * F.when(p.isNotNull(), F.size(p))))
    product = F.reduce(parts, none, lambda held, p: F.flatten(F.transform(held, lambda left: F.transform(p, lambda right: F.concat(left, right)))))
    return F.when(several <= MOST_ALTERNATIVES, product)


def merged_visibility(alternatives: Column) -> Column:
    """The state over alternative token lists; all bands are unknown where they are null."""
    # Each list is folded once: what hides always and what hides at all are carried together.
    start = F.struct(F.lit(ALL).alias("always"), F.lit(0).alias("ever"))
    both_ways = lambda held, m: F.struct(held["always"].bitwiseAND(m).alias("always"), held["ever"].bitwiseOR(m).alias("ever"))
    told = F.reduce(F.transform(alternatives, tokens_hidden), start, both_ways, lambda s: state(s["always"], s["ever"].bitwiseAND(F.bitwise_not(s["always"]))))
    return F.coalesce(told, state(F.lit(0), F.lit(ALL)))


def both(left: Column, right: Column) -> Column:
    """The state of what is seen only where both are."""
    hidden = left["hidden"].bitwiseOR(right["hidden"])
    return state(hidden, left["unknown"].bitwiseOR(right["unknown"]).bitwiseAND(F.bitwise_not(hidden)))


def overlap(left: Column, right: Column) -> Column:
    """Whether two elements are seen in one band: true, false, or null where it cannot be told."""
    seen = F.lit(ALL).bitwiseAND(F.bitwise_not(left["hidden"].bitwiseOR(right["hidden"])))
    sure = seen.bitwiseAND(F.bitwise_not(left["unknown"].bitwiseOR(right["unknown"])))
    return F.when(sure != 0, True).when(seen == 0, False)


def small_only(visibility: Column) -> Column:
    """Whether an element is not hidden in the first band, and hidden in the last."""
    last = 1 << (len(BANDS) - 1)
    return (visibility["hidden"].bitwiseAND(F.lit(1)) == 0) & (visibility["hidden"].bitwiseAND(F.lit(last)) != 0)
