"""Periodic runs of words: heavy/light lag counting, then island scans at the lags that can hold a run.

A run is a stretch of consecutive words with smallest period q and at least
max(LEAST_WORDS, LEAST_TURNS * q) words that no neighbouring word extends keeping
period q. Its words match their partners q places on in an island of at least
max(LEAST_WORDS - q, (LEAST_TURNS - 1) * q) consecutive places, so a lag with fewer
matches in all holds none.

The matches of every lag up to a third of the text are counted exactly: for words
that are frequent in the text by autocorrelation of their places (FFT, rounded; the
spectra of all of them are added and turned back once), for rare words by the
differences of each two places, a million at a time. Lags are then taken in
ascending order. A run found at lag p accounts for known matches at p's multiples;
these are taken off, so a text that repeats one word is scanned at lag 1 only. A
lag that still has enough matches is looked at in steps of q/8 places first, for an
island covers so many steps in a row; only then all its places are compared. All
lags of one text take O(n log n) together even where every one of them passes.

A stretch with period q whose smallest period is less is the run of that period as
a whole (its words repeat at a divisor of q), so it has been seen before with the
same ends; that is how smallest periods are told.

Edge cases: null, empty and white texts have no words and no runs; a text of less
than LEAST_WORDS words has none; repeated rows give the same result each; extra
columns are ignored; an empty table gives no rows. A text is read by one task, with
memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.text import text_chunks

LEAST_WORDS, LEAST_TURNS = 24, 3
#: Differences of places that are held at once.
PAIRS = 1 << 20
#: Steps in which a lag is looked at before all places are.
STEPS = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_WORDS = r"[\x20\x09-\x0D]+"


def least_matches(lags: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_WORDS - lags, (LEAST_TURNS - 1) * lags)


def _frequent(places: list[np.ndarray], n: int, last: int) -> np.ndarray:
    """Matches by lag of the words with these places, by autocorrelation."""
    size = 1 << int(n + last - 1).bit_length()
    total = np.zeros(size // 2 + 1)
    for own in places:
        mark = np.zeros(size)
        mark[own] = 1
        spectrum = np.fft.rfft(mark)
        total += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(total, size)[: last + 1]).astype(np.int64)


def _rare(place: np.ndarray, rank: np.ndarray, last: int) -> np.ndarray:
    """Matches by lag of words whose places stand together in order; rank: how many places of the same word stand before."""
    out = np.zeros(last + 1, np.int64)
    done = np.concatenate(([0], np.cumsum(rank)))
    a = 0
    while a < len(place):
        b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, "right")) - 1)
        own = rank[a:b]
        back = np.arange(done[b] - done[a]) - np.repeat(done[a:b] - done[a], own) + 1
        later = np.repeat(np.arange(a, b), own)
        lags = place[later] - place[later - back]
        out += np.bincount(lags[lags <= last], minlength=last + 1)
        a = b
    return out


def lag_matches(ids: np.ndarray, last: int) -> np.ndarray:
    """How many places i have the same word at i + q, for every lag q up to ``last``."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    held = ids[order]
    starts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    sizes = np.diff(np.append(starts, n))
    heavy = sizes > max(16, 2 * int(n**0.5))
    light = np.repeat(~heavy & (sizes > 1), sizes)
    rank = (np.arange(n) - np.repeat(starts, sizes))[light]
    out = _rare(order[light], rank, last)
    if heavy.any():
        out += _frequent([order[s : s + k] for s, k in zip(starts[heavy], sizes[heavy])], n, last)
    out[0] = 0
    return out


def _islands(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], equal.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run (start, length, period) of a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    last = n // LEAST_TURNS
    matches, need = lag_matches(ids, last), least_matches(np.arange(last + 1))
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(matches >= need).tolist():
        least = int(need[q])
        if q == 0 or matches[q] < least:
            continue
        step = max(1, q // STEPS)
        if step > 1:
            a, b = _islands(ids[: n - q : step] == ids[q::step])
            if not len(a) or (b - a).max() < least // step:
                continue
        a, b = _islands(ids[: n - q] == ids[q:])
        long = b - a >= least
        for start, end in zip(a[long].tolist(), (b[long] + q).tolist()):
            if (start, end) not in found:
                found[start, end] = q
                times = np.arange(2 * q, min(last, end - start - 1) + 1, q)
                matches[times] -= end - start - times
    return sorted((start, end - start, q) for (start, end), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words are in no run after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_chunks(batches):
        known: dict[bytes, int] = {}
        runs, collapsed = [], []
        for text in part.column("text").to_pylist():
            own = text.encode().split()
            got = word_runs(np.array([known.setdefault(w, len(known)) for w in own], np.int64))
            if got:
                own = [own[i] for i in np.flatnonzero(kept_words(len(own), got)).tolist()]
            runs.append([dict(zip(("start", "length", "period"), r)) for r in got])
            collapsed.append(b" ".join(own).decode())
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(runs, kind), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period) and the text without the repetitions, of every row of ``docs(doc_id, text)``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_find, f"doc_id long, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which, for one id of ten, the words from some place on repeat 3 to 10 times and more; other texts, null ids included, as they are."""
    mark = F.crc32(doc_id.cast("string"))
    g = F.floor(mark / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % period).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise("")

    # As the only element of an array the words are a value of their own, cut from the text once and not for every word.
    words = F.array(F.filter(F.split(text, _WORDS), lambda w: w != ""))
    return F.when((mark % 10 == 0) & text.isNotNull(), F.get(F.transform(words, repeated), F.lit(0))).otherwise(text)


def run_digest(found: DataFrame) -> DataFrame:
    """Number of runs, the one of the greatest exact length/period (ties: smallest start, then period; null without runs), and digests."""
    none = F.lit(None).cast(RUNS[6:-1])
    best = F.reduce("runs", none, lambda held, r: F.when(held.isNull() | (r["length"] * held["period"] > held["length"] * r["period"]), r).otherwise(held))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    held = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return held.select(
        "doc_id",
        "n_runs",
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
