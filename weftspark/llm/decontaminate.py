"""Benchmark decontamination by CGK random walks, bit-sampling LSH and exact edit distance.

A CGK walk copies a string's current character again and again and moves on by a
random bit that depends on the step and the character. Two strings whose edit
distance is small fall into step again after each edit, so the walks' outputs
have a small Hamming distance. Bit sampling keeps a few of a walk's steps as a
bucket key; walks of its own for each repetition raise the recall.

Windows of a document begin at each word, and in long words at each character
after the first DEEP; an item enters the index once for each such place that has a
whole walk's steps left inside the item. A walk moves on by at most one byte a step,
so it never leaves the item, and an exact copy that begins where a window begins
always collides. The steps, sampled outputs and repetitions of a walk depend on the
item's length: CLASSES are chosen so that at least RECALL of the items with EDITS of
their bytes replaced collide, measured in the tests on items of 7 to 230 bytes. One
walk over a whole long item would hardly ever agree in its samples at that share of
edits; the walks from all of an item's words cover it together. A window drops out
as soon as no indexed key agrees with its first sampled outputs, which cannot lose a
collision. Every collision names a place in the document where the item should lie;
there the exact edit distance of the whole item to the best substring is computed,
and the pair is kept if it is at most EDITS of the item's length. Places of items of
up to 64 bytes are computed side by side. An edit changes at most GRAM of an item's
runs of GRAM bytes, so places that hold too few of these runs are left out before,
without loss.

Items are read in blocks of BLOCK_ITEMS, a bound on what is sent to the tasks;
documents are read once a block, whole, and never shuffled.

Edge cases: null or empty texts match nothing; items without words are left out;
letter case and the kind and length of white space do not count as edits; equal
items are reported each; a null doc_id keeps its rows; an empty table on either
side gives no rows; extra columns are kept by ``drop_leaks`` and ignored by
``find_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.shared import free_name, union_all
from weftspark.llm.text import mix, raw_bytes, text_chunks

#: Share of an item's length that may be edited; share of items edited so that are to be found; outputs of the first test.
EDITS, RECALL, EARLY = 0.15, 0.9, 5
#: Least item length, steps, sampled outputs and repetitions of its walks; shorter items allow no edit and are walked whole.
CLASSES = ((7, 5, 3, 12), (14, 6, 4, 6), (20, 10, 5, 8), (30, 12, 6, 4), (40, 16, 7, 4), (60, 20, 8, 3), (80, 28, 11, 2), (150, 44, 12, 2))
#: Bytes of a word after which windows begin at each character.
DEEP = 8
#: Bytes of the runs that a place must hold before its edit distance is computed.
GRAM = 5
#: Items of one block.
BLOCK_ITEMS = 20_000
#: Numbers that runs are dealt to, for a first look at which runs places hold.
RUN_NUMBERS = 16_384
#: Candidate places that are computed at once, and collisions that are held at once.
SLICE, HELD = 200_000, 4_000_000
_U = np.uint64
_REACH = max(steps for _, steps, _, _ in CLASSES)


class Walk:
    """One repetition of a class: whether the walk moves on, by step and byte; the steps sampled; a number for each sampled output."""

    def __init__(self, steps: int, sampled: int, repeat: int):
        rng = np.random.default_rng((77, steps, repeat))
        self.moves = rng.integers(0, 2, (steps, 256), dtype=np.uint8)
        self.samples = np.sort(rng.choice(steps, sampled, replace=False))
        self.weights = rng.integers(1, 1 << 63, sampled, dtype=np.uint64) | _U(1)
        self.early = min(EARLY, sampled)


def class_of(length: int) -> tuple[int, int, int]:
    """Steps, sampled outputs and repetitions of the walks of items of this length."""
    if length < CLASSES[0][0]:
        return length, length, 1
    return max(c for c in CLASSES if c[0] <= length)[1:]


_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FOLDED = np.where(_SPACES, 32, np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))).astype(np.uint8)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased and each run of white space one space, offsets of the rows, and each byte's place before."""
    out = _FOLDED[data]
    space = out == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[:1] = True
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    place = np.flatnonzero(keep)
    return out[place], np.searchsorted(place, offsets), place


def walk_keys(data: np.ndarray, starts: np.ndarray, walk: Walk, early: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of walks from these starts, and which starts remain; early: a bit table of the index's partial keys.

    ``data`` ends with _REACH zero bytes, so that every walk stays inside.
    """
    at, key = starts.copy(), np.zeros(len(starts), _U)
    left, taken = np.arange(len(starts)), 0
    for step in range(int(walk.samples[-1]) + 1):
        c = data[at]
        if step == walk.samples[taken]:
            key = (key ^ c) * walk.weights[taken]
            key ^= key >> _U(29)
            taken += 1
            if taken == walk.early and early is not None:
                hit = early[(key >> _U(44)).astype(np.int64)]
                at, key, left, c = at[hit], key[hit], left[hit], c[hit]
        at += walk.moves[step][c]
    return mix(key), left


def partial_keys(data: np.ndarray, starts: np.ndarray, walk: Walk) -> np.ndarray:
    """A table over the first 20 bits of keys after the outputs of the first test: which of them the index has."""
    at, key, taken = starts.copy(), np.zeros(len(starts), _U), 0
    table = np.zeros(1 << 20, bool)
    for step in range(int(walk.samples[walk.early - 1]) + 1):
        c = data[at]
        if step == walk.samples[taken]:
            key = (key ^ c) * walk.weights[taken]
            key ^= key >> _U(29)
            taken += 1
        at += walk.moves[step][c]
    table[(key >> _U(44)).astype(np.int64)] = True
    return table


def window_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where windows begin: each word, and each character of a word after its first DEEP bytes."""
    at, space = np.arange(len(data)), data == 32
    begin = np.where(space, at + 1, 0)
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begin[firsts] = np.maximum(begin[firsts], firsts)
    inside = at - np.maximum.accumulate(begin)
    return np.flatnonzero(~space & ((inside == 0) | (inside >= DEEP) & (data & 0xC0 != 0x80)))


def best_substring(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of the item to a substring of the text, and where that substring ends: Myers' bit vectors."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def may_hold(grams: list[bytes], text: bytes, allowed: int) -> bool:
    """Whether the text has as many of an item's runs as a substring within the allowed edits must have."""
    need = len(grams) - GRAM * allowed
    if need <= 0:
        return True
    held = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
    return sum(map(held.__contains__, grams)) >= need


def within(masks: np.ndarray, which: np.ndarray, lengths: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each item, of up to 64 bytes and given by the row of its bytes' bit masks, has a substring of data[lo:hi] within its allowed edits.

    Myers' bit vectors of all places side by side.
    """
    one = _U(1)
    last = (lengths - 1).astype(_U)
    pv, mv, score = np.full(len(lo), ~_U(0)), np.zeros(len(lo), _U), lengths.astype(np.int64)
    best = score.copy()
    for j in range(int((hi - lo).max()) if len(lo) else 0):
        eq = np.where(lo + j < hi, masks[which, data[np.minimum(lo + j, len(data) - 1)]], _U(0))
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += (ph >> last & one).astype(np.int64) - (mh >> last & one).astype(np.int64)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        best = np.minimum(best, score)
    return best <= (lengths * EDITS).astype(np.int64)


def run_numbers(data: np.ndarray) -> np.ndarray:
    """A number for the run of GRAM bytes from each place that has one."""
    n = max(0, len(data) - GRAM + 1)
    key = np.zeros(n, np.uint32)
    for i in range(GRAM):
        key = key * np.uint32(0x01000193) ^ data[i : i + n]
    return (key * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int32)


def runs_held(runs: np.ndarray, which: np.ndarray, numbers: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """At least as many of an item's runs as data[lo:hi] holds; runs: by item, its runs' numbers, filled up with RUN_NUMBERS; numbers: of the data's runs.

    Each place has a bit for each number; bits are set for its own runs and read for the item's, all places side by side.
    """
    words = RUN_NUMBERS // 64 + 1
    there, base, one = np.zeros(len(lo) * words, _U), np.arange(len(lo)) * words, _U(1)
    for j in range(int((hi - lo).max()) - GRAM + 1 if len(lo) else 0):
        number = np.where(lo + j + GRAM <= hi, numbers[np.minimum(lo + j, len(numbers) - 1)], RUN_NUMBERS + 1)
        there[base + (number >> 6)] |= one << (number & 63).astype(_U)
    total = np.zeros(len(lo), np.int64)
    for j in range(runs.shape[1]):
        number = runs[which, j]
        total += (there[base + (number >> 6)] >> (number & 63).astype(_U) & one).astype(np.int64)
    return total


class ItemIndex:
    """The buckets of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        data, offsets, _ = folded(*raw_bytes(pa.array([t for _, t in items], pa.string())))
        self.texts = [data[a:b].tobytes().strip() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.grams: dict[int, list[bytes]] = {}
        self.masks: dict[int, np.ndarray] = {}
        joined = b"".join(t + b" " for t in self.texts)
        ends = np.cumsum(self.lengths + 1)
        begins = ends - self.lengths - 1
        data = np.concatenate([np.frombuffer(joined, np.uint8), np.zeros(_REACH + 1, np.uint8)])
        starts = window_starts(data[: len(joined)], np.append(begins, len(joined)))
        item = np.searchsorted(ends, starts, "right")
        classes = [class_of(n) for n in self.lengths.tolist()]
        #: A walk, its tables of partial and of whole keys, its sorted keys, and the item and the place in the item of each.
        self.buckets: list[tuple[Walk, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for steps, sampled, repeats in sorted({c for c in classes if c[0]}):
            own = np.array([c == (steps, sampled, repeats) for c in classes])
            room = own[item] & (ends[item] - 1 - starts >= steps)
            for r in range(repeats):
                walk = Walk(steps, sampled, r)
                key, _ = walk_keys(data, starts[room], walk, None)
                order = np.argsort(key, kind="stable")
                number = item[room][order]
                whole = np.zeros(1 << 20, bool)
                whole[(key >> _U(44)).astype(np.int64)] = True
                self.buckets.append((walk, partial_keys(data, starts[room], walk), whole, key[order], number, starts[room][order] - begins[number]))

    def grams_of(self, number: int) -> list[bytes]:
        """The runs of GRAM bytes of an item, at every place."""
        if number not in self.grams:
            item = self.texts[number]
            self.grams[number] = [item[i : i + GRAM] for i in range(len(item) - GRAM + 1)]
        return self.grams[number]

    def masks_of(self, number: int) -> np.ndarray:
        """The places of each byte in an item of up to 64 bytes, as bits."""
        if number not in self.masks:
            self.masks[number] = np.zeros(256, _U)
            for i, c in enumerate(self.texts[number]):
                self.masks[number][c] |= _U(1 << i)
        return self.masks[number]

    def runs_of(self, numbers: np.ndarray) -> np.ndarray:
        """The numbers of some items' runs, a row each."""
        lists = [run_numbers(np.frombuffer(self.texts[k], np.uint8)) for k in numbers.tolist()]
        out = np.full((len(lists), max(map(len, lists))), RUN_NUMBERS, np.int64)
        for row, own in zip(out, lists):
            row[: len(own)] = own
        return out

    def step(self, number: np.ndarray) -> np.ndarray:
        """Bytes within which an item's collisions are one candidate."""
        return np.maximum(8, (self.lengths[number] * EDITS).astype(np.int64))

    def collisions(self, data: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows collide, where the item should begin, and its number; of an item's collisions near one place one may stand for all."""
        found = [np.zeros((0, 3), np.int64)]
        for walk, early, whole, keys, items, places in self.buckets:
            key, left = walk_keys(data, starts, walk, early)
            there = whole[(key >> _U(44)).astype(np.int64)]
            key, left = key[there], left[there]
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(hi > lo)
            total = np.cumsum((hi - lo)[hit])
            # Texts of one repeated character collide everywhere: so many collisions are held at once.
            for some in np.split(hit, np.searchsorted(total, np.arange(HELD, total[-1], HELD))) if len(hit) else ():
                n = (hi - lo)[some]
                which = np.repeat(some, n)
                entry = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window, number = starts[left[which]], items[entry]
                found.append(np.stack([window, window - places[entry], number], 1))
                if len(which) > HELD // 8:
                    near = np.stack([np.searchsorted(offsets, window, "right"), number, found[-1][:, 1] // self.step(number)], 1)
                    found[-1] = found[-1][np.unique(near, axis=0, return_index=True)[1]]
        return tuple(np.concatenate(found).T)


def leaks_in(index: ItemIndex, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item id, edits, start, end) for each item that a text of the column holds: the best place found; bytes of the original."""
    raw, raw_offsets = raw_bytes(column)
    data, offsets, place = folded(raw, raw_offsets)
    if not len(data) or not index.ids:
        return []
    starts = window_starts(data, offsets)
    padded = np.concatenate([data, np.zeros(_REACH + 1, np.uint8)])
    window, begin, number = index.collisions(padded, starts, offsets)
    if not len(begin):
        return []
    # Collisions of one item near one place are one candidate; the item lies in the row of the window.
    row = np.searchsorted(offsets, window, "right") - 1
    near = np.unique(np.stack([row, number, begin // index.step(number)], 1), axis=0, return_index=True)[1]
    allowed = (index.lengths[number] * EDITS).astype(np.int64)
    # A candidate stands for places up to a step apart, each of which edits may have moved.
    reach = allowed + index.step(number) + 8
    low, high = np.maximum(offsets[row], begin - reach), np.minimum(offsets[row + 1], begin + index.lengths[number] + reach)
    near = near[high[near] - low[near] >= index.lengths[number[near]] - allowed[near]]
    short = near[index.lengths[number[near]] <= 64]
    kept = []
    for at in range(0, len(short), SLICE):
        some = short[at : at + SLICE]
        used, which = np.unique(number[some], return_inverse=True)
        masks = np.stack([index.masks_of(k) for k in used.tolist()])
        kept.append(some[within(masks, which, index.lengths[number[some]], data, low[some], high[some])])
    long = near[index.lengths[number[near]] > 64]
    long = long[np.lexsort((high[long] - low[long], index.lengths[number[long]]))]
    numbers = run_numbers(padded)
    for at in range(0, len(long), SLICE // 50):
        some = long[at : at + SLICE // 50]
        used, which = np.unique(number[some], return_inverse=True)
        runs = index.runs_of(used)
        need = index.lengths[number[some]] - GRAM + 1 - GRAM * allowed[some]
        kept.append(some[(need <= 0) | (runs_held(runs, which, numbers, low[some], high[some]) >= need)])
    near = np.concatenate([near[:0], *kept])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in near[np.lexsort((begin[near], number[near], row[near]))].tolist():
        r, item = int(row[i]), index.texts[number[i]]
        held = best.get((r, int(number[i])))
        if held and held[0] == 0:
            continue
        lo, hi = int(low[i]), int(high[i])
        text = data[lo:hi].tobytes()
        if (whole := text.find(item)) >= 0:
            edits, end = 0, whole + len(item)
        elif may_hold(index.grams_of(int(number[i])), text, int(allowed[i])):
            edits, end = best_substring(item, text)
        else:
            continue
        if edits <= allowed[i] and (held is None or edits < held[0]):
            begin_at = end - best_substring(item[::-1], text[:end][::-1])[1] if edits else whole
            best[(r, int(number[i]))] = (edits, int(place[lo + begin_at]) - int(raw_offsets[r]), int(place[lo + end - 1]) + 1 - int(raw_offsets[r]))
    return [(r, index.ids[n], *found) for (r, n), found in sorted(best.items())]


def item_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded size, by id."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and trim(text) <> ''").distinct()
    blocks: list[list[tuple[int, str]]] = [[]]
    for row in own.orderBy("item_id", "text").toLocalIterator():
        if len(blocks[-1]) == BLOCK_ITEMS:
            blocks.append([])
        blocks[-1].append((row["item_id"], row["text"]))
    return blocks


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end (UTF-8 bytes of the text) for each item that a document of ``docs(doc_id, text)`` holds."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "item_id", "edits", "start", "end"]

    def scan(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items)
            for part in text_chunks(batches):
                if found := leaks_in(index, part.column("text")):
                    ids = part.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((ids[r], *rest) for r, *rest in found))], names)

        return own.mapInArrow(run, ", ".join(f"{n} long" for n in names))

    return union_all([scan(items) for items in item_blocks(benchmark)])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns kept, that hold no item. Documents are read where they lie; nothing is joined."""
    out, name = docs, free_name(docs, "read")

    def without(frame: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items)
            for part in text_chunks(batches, name):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, *_ in leaks_in(index, part.column(name))]] = False
                yield part.drop_columns([name]).filter(pa.array(keep))

        return frame.withColumn(name, F.col("text").cast("string")).mapInArrow(run, docs.schema)

    for items in item_blocks(benchmark):
        out = without(out, items)
    return out
