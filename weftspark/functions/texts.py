"""Columns that make texts safe for a terminal, a shell, JSON or an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that a terminal must not get: controls, and marks that turn the direction of writing.
UNSAFE = r"[\x{00}-\x{1f}\x{7f}-\x{9f}\x{2028}-\x{202e}\x{2066}-\x{2069}]"
MOST_DESCRIPTOR, NO_DESCRIPTOR = 160, "unknown element"


def terminal_text(text: Column) -> Column:
    return F.regexp_replace(text, UNSAFE, " ")


def descriptor(text: Column) -> Column:
    """One line of at most MOST_DESCRIPTOR characters; a default where nothing is left."""
    line = F.substring(F.trim(F.regexp_replace(terminal_text(text), r"\s+", " ")), 1, MOST_DESCRIPTOR)
    return F.coalesce(F.nullif(line, F.lit("")), F.lit(NO_DESCRIPTOR))


def shell_quoted(text: Column) -> Column:
    return F.when(text.rlike("^[A-Za-z0-9_./:@+-]+$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def regex_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


#: Code points that must not cross a JSON boundary as themselves, besides those that JSON escapes anyway.
BOUNDARY = "<>&" + "".join(map(chr, [*range(0x7F, 0xA0), *range(0x2028, 0x202F), *range(0x2066, 0x206A)]))


def boundary_escaped(text: Column) -> Column:
    """``<``, ``>``, ``&``, later controls, line and paragraph marks and marks of direction as JSON escapes."""
    code = lambda c: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))
    safe = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.contains(F.lit(BOUNDARY), c) & (c != ""), code(c)).otherwise(c)), "")
    return F.when(text.rlike(f"[{BOUNDARY}]"), safe).otherwise(text)


def offsets(text: Column, word: str) -> Column:
    """0-based places of all occurrences of a fixed word, left to right, without overlaps.

    One pass carries the place; places are gathered as one growing text, which is split at the end.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, part: F.struct((a["at"] + F.length(part) + len(word)).alias("at"), F.concat(a["out"], F.lit(","), (a["at"] + F.length(part)).cast("string")).alias("out"))
    parts = F.split(text, rf"\Q{word}\E", -1)
    blocks = F.transform(F.array(parts), lambda own: F.aggregate(F.slice(own, F.lit(1), F.size(own) - 1), start, step, lambda a: F.substring(a["out"], 2, 1 << 30)))
    found = F.get(blocks, F.lit(0))
    return F.when(found == "", F.array().cast("array<int>")).otherwise(F.split(found, ",").cast("array<int>"))


# The marks of thousands.
MARKS = ("", "K", "M", "B", "T")


def compact_number(n: Column) -> Column:
    """A whole number in its largest unit with at most one decimal, halves away from zero: 1000 is 1K, 1250 is 1.3K, 999950 is 1M."""
    size = F.abs(n)
    tenths = [size * 10 if k == 0 else F.floor((size + 50 * 1000 ** (k - 1)) / (100 * 1000 ** (k - 1))) for k in range(len(MARKS))]
    shown = lambda t, mark: F.concat(F.floor(t / 10).cast("string"), F.when(t % 10 != 0, F.concat(F.lit("."), (t % 10).cast("string"))).otherwise(""), F.lit(mark))
    out = shown(tenths[-1], MARKS[-1])
    for k in range(len(MARKS) - 2, -1, -1):
        out = F.when(tenths[k] < 10_000, shown(tenths[k], MARKS[k])).otherwise(out)
    return F.concat(F.when(n < 0, "-").otherwise(""), out)
