"""Secret scans: fixed patterns, and values in credential contexts weighed by how many guesses they would take.

A value after a credential word ("the password is ...", "pwd -> ...") is a
secret if guessing it is costly. The cost is the base-10 logarithm of the guesses
of the cheapest segmentation into common words (with capitals and look-alike
characters), dates, repeats, keyboard walks and sequences, and brute-force
spans: a shortest path over the value's positions in which each further segment
costs a factor of ten. Placeholders, plain words and walks such as ``qwerty12345``
are cheap and left alone; random strings of any kind of characters are not. Words are
ranked by how often chosen secrets hold them (WORDS), then by the number of texts
that hold them, counted in Spark over the whole corpus with every credential context
and every assignment taken out, so that no secret ranks itself. A word needs
LEAST_TEXTS texts that differ: texts set bits of a 64-bit mark by their hash, which
copies of one text set alike, so as many bits as that prove as many texts. The
MOST_WORDS first go to the tasks, at most a megabyte. Ranks follow the corpus that is
given: to scan parts of it alike, make them once and hand them in.

Words are looked for up to the longest that is ranked, walks and repeats of any
length. Units of a repeat are looked for up to LONGEST characters: a longer unit
alone takes more than LONGEST powers of ten of guesses, far above COSTLY, so what is
a secret does not depend on it. The work is linear in the value and, by looking at
neighbours only, in the spans of a text.

Edge cases: a null or empty text has no spans; positions are code points, ends
exclusive; ties between segmentations do not change the cost; repeated rows and
null doc_ids keep their rows; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.text import text_chunks

KINDS = ("assign", "access", "hex")
ADDED = "guess"
#: Log10 of the guesses from which a value in a credential context is a secret, and the least length of its core.
COSTLY, LEAST = 8.0, 6
#: Longest unit of a repeat; dates have ten characters, walks, repeats and brute force no limit.
LONGEST = 24
#: Words of the corpus that are ranked, the bound of what is sent to the tasks; their least length; texts that must hold one.
MOST_WORDS, LEAST_WORD, LEAST_TEXTS = 20_000, 3, 24

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""\b(?i:pass(?:word|wd|phrase|code)s?|pwd|pw|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|bearer|login)\b["')\]]{0,2}[ \t]{0,4}"""
    r"""(?:(?:[:=]|->|=>|\||(?i:is|was|are)\b)[ \t]{0,4}|(?<=[Bb]earer)[ \t]+|(?<=BEARER)[ \t]+)["'(\[`]?([^\s"'`)\],;|]+)""",
    re.ASCII,
)
_HINTS = ("pass", "pwd", "pw", "secret", "token", "key", "credential", "bearer", "login")

# Common words of chosen secrets and placeholders, most frequent first.
WORDS = (
    "password", "admin", "welcome", "login", "secret", "letmein", "master", "dragon", "monkey", "shadow", "sunshine", "princess",
    "football", "baseball", "superman", "batman", "iloveyou", "trustno", "hello", "freedom", "whatever", "michael", "jordan", "hunter",
    "summer", "winter", "spring", "autumn", "monday", "friday", "sunday", "january", "february", "march", "april", "june", "july",
    "august", "september", "october", "november", "december", "love", "test", "testing", "user", "guest", "root", "default", "changeme",
    "change", "example", "sample", "dummy", "demo", "temp", "null", "none", "true", "false", "token", "key", "pass", "pwd", "api",
    "my", "your", "the", "here", "insert", "enter", "redacted", "hidden", "unknown", "string", "value", "placeholder", "company", "server",
    "database", "access", "private", "public", "computer", "internet", "service", "account", "qwerty", "azerty",
)
# Rows of common keyboards, and characters used for letters that they resemble.
WALKS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "azertyuiop", "qwertzuiop", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p", "abcdefghijklmnopqrstuvwxyz", "0123456789")
LOOKALIKE = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z"}

_PLAIN = str.maketrans(LOOKALIKE)
_DATES = tuple(
    re.compile(p)
    for p in (
        r"(?:19|20)\d\d",
        r"(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d",
        r"(?:0[1-9]|1[0-2])([-/.]?)(?:0[1-9]|[12]\d|3[01])\1(?:19|20)\d\d",
        r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])",
    )
)
_STEPS = {(a, b) for row in WALKS for x in (row, row[::-1]) for a, b in zip(x, x[1:])}


class Ranks(dict):
    """Words and their ranks, with the length of the longest."""

    longest = 0

    def __init__(self, *args):
        super().__init__(*args)
        self.longest = max(map(len, self), default=0)


RANKS = Ranks({w: i + 1 for i, w in enumerate(WORDS)})


def _longest(ranks: dict[str, int]) -> int:
    return ranks.longest if isinstance(ranks, Ranks) else max(map(len, ranks), default=0)


def _class_size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def _word_cost(part: str, ranks: dict[str, int]) -> float:
    """The cost of a word with capitals and look-alikes that ``ranks`` holds, as it is or plain."""
    low = part.lower()
    plain = low.translate(_PLAIN)
    cost = math.log10(ranks.get(low) or ranks[plain])
    if part != low:
        capitals = sum(c.isupper() for c in part)
        cost += math.log10(2) if part in (part.capitalize(), part.upper()) else math.log10(max(2, math.comb(len(part), capitals)))
    return cost + sum(a != b for a, b in zip(low, plain)) * math.log10(2) * (low not in ranks)


def guess_segments(value: str, ranks: dict[str, int] = RANKS) -> tuple[float, list[tuple[str, int, int]]]:
    """The least log10 of guesses over all segmentations, and the segments (kind, start, end) of one that reaches it."""
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_PLAIN)
    # Where the walk and the repeat of one character that end at each position begin; by unit, how far the last characters repeat.
    walk, same = list(range(n)), list(range(n))
    for i in range(1, n):
        if (low[i - 1], low[i]) in _STEPS:
            walk[i] = walk[i - 1]
        if value[i] == value[i - 1]:
            same[i] = same[i - 1]
    steps = [math.log10(_class_size(c)) for c in value]
    so_far = [0.0]
    for step in steps:
        so_far.append(so_far[-1] + step)
    alike, reach = [0] * (LONGEST + 1), _longest(ranks)
    dates: dict[int, list[tuple[int, float]]] = {}
    for k, pattern in enumerate(_DATES):
        for i in range(n):
            if m := pattern.match(value, i):
                dates.setdefault(m.end(), []).append((i, math.log10(130 if not k else 365 * 130)))
    # best[j]: cost of value[:j], where its last segment began, that segment's kind; a brute-force span grows without a new segment's factor.
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    brute: list[tuple[float, int]] = [(math.inf, 0)]
    for j in range(1, n + 1):
        new = lambda i: best[i][0] + (1.0 if i else 0.0)
        step = steps[j - 1]
        fresh = new(j - 1) + step
        grown = brute[j - 1][0] + step
        brute.append((grown, brute[j - 1][1]) if grown <= fresh else (fresh, j - 1))
        found = [(brute[j][0], brute[j][1], "brute")]
        for i in range(max(0, j - reach), j - 1):
            if low[i:j] in ranks or plain[i:j] in ranks:
                found.append((new(i) + _word_cost(value[i:j], ranks), i, "word"))
        found += [(new(i) + cost, i, "date") for i, cost in dates.get(j, ())]
        for i in {walk[j - 1], *range(max(walk[j - 1], j - LONGEST), j - 2)} if j - walk[j - 1] > 2 else ():
            found.append((new(i) + math.log10(47 * (j - i)), i, "walk"))
        if j - same[j - 1] >= 3:
            i = same[j - 1]
            found.append((new(i) + step + math.log10(j - i), i, "repeat"))
        for unit in range(2, min(LONGEST, j - 1) + 1):
            alike[unit] = alike[unit] + 1 if value[j - 1] == value[j - 1 - unit] else 0
            if (count := 1 + alike[unit] // unit) > 1:
                i = j - unit * count
                found.append((new(i) + so_far[j] - so_far[j - unit] + math.log10(count), i, "repeat"))
        best.append(min(found))
    out, j = [], n
    while j:
        _, i, kind = best[j]
        out.append((kind, i, j))
        j = i
    return best[n][0], out[::-1]


def find_secrets(text: str, ranks: dict[str, int] = RANKS) -> list[tuple[str, int, int, float | None]]:
    """Spans (kind, start, end, log10 of guesses of the value) by start, then kind: fixed patterns, and costly values in credential contexts."""
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    base, costs = [], {}

    def cost_of(value: str) -> float:
        if value not in costs:
            costs[value] = guess_segments(value, ranks)[0]
        return costs[value]

    if hinted:
        base += [("assign", *m.span(), cost_of(m[2])) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span(), None) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [("hex", *m.span(), None) for m in _HEX.finditer(text)]
    added = []
    if hinted:
        # Where the fixed patterns' spans begin, and how far they reach up to each of them.
        ends = sorted((a, b) for _, a, b, _ in base)
        starts, reach = [a for a, _ in ends], list(accumulate((b for _, b in ends), max))
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".:!?")
            start, end = m.start(1), m.start(1) + len(value)
            before = bisect_left(starts, end)
            if len(value) < LEAST or before and reach[before - 1] > start:
                continue
            cost = cost_of(value)
            if cost >= COSTLY:
                added.append((ADDED, start, end, cost))
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    return sorted(base + added, key=lambda s: (s[1], order[s[0]], s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))


def corpus_ranks(docs: DataFrame) -> Ranks:
    """Ranks of WORDS, then of the corpus's words of ASCII letters outside credential contexts, by the number of texts that hold them; ties by the word."""
    text = F.col("text").cast("string")
    outside = F.regexp_replace(F.regexp_replace(text, _ASSIGN.pattern, " "), _CONTEXT.pattern, " ")
    # Most texts have no credential word at all.
    outside = F.when(F.lower(text).rlike("|".join(_HINTS)), outside).otherwise(text)
    found = F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit(f"[a-z]{{{LEAST_WORD},}}"), F.lit(0)))
    mark = F.expr("shiftleft(1L, cast(pmod(xxhash64(cast(text as string)), 64) as int))")
    rows = docs.select(mark.alias("mark"), F.explode(found).alias("word"))
    counted = rows.groupBy("word").agg(F.count("*").alias("texts"), F.bit_or("mark").alias("marks")).where(F.bit_count("marks") >= LEAST_TEXTS)
    top = counted.orderBy(F.desc("texts"), "word").limit(MOST_WORDS).collect()
    return Ranks({w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *(r["word"] for r in top)]))})


def scan_secrets(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """doc_id and spans (an array of kind, start, end, log10_guesses) of every row of ``docs(doc_id, text)``.

    ``ranks`` are words and their ranks; none: ``corpus_ranks`` of the documents.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = corpus_ranks(own) if ranks is None else ranks

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            spans = [[dict(zip(("kind", "start", "end", "log10_guesses"), s)) for s in find_secrets(t, known)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return own.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,log10_guesses:double>>")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the fixed patterns' spans, all spans, and the costliest value's log10 of guesses to two places."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != ADDED)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(ADDED).alias(f"n_{ADDED}"),
        F.round(F.array_max(F.transform("spans", lambda s: s["log10_guesses"])), 2).alias("most_log10_guesses"),
    )


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of ordered spans, as the query computes it."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
