"""LM scoring by deleted interpolation: a bigram model mixed by context-frequency buckets.

Training documents are split by a hash of their id. One seventh of all is held
out for scores (remainder 2), one seventh is deleted from the counts while the
mixture is learned (remainder 3), the rest are main documents. For each bucket
of context frequencies (powers of two) expectation-maximisation on the deleted
seventh's tokens learns the weights of the bigram, unigram and uniform
estimates made from the main documents; scores then use the counts of all
training documents with these weights.

Counting is exact over all documents and every n-gram. A chunk of text (a
stretch of one input split) sends each distinct n-gram hash once, packed by hash
range; the owner of a range sums a bounded number of hashes and sends back to
each chunk the totals of those that other chunks hold too. So a frequent word is
one entry a chunk, not a row an occurrence, no vocabulary is broadcast, and what
moves grows with the corpus. Chunks then meet their totals again by chunk id.

Edge cases: a null or empty text is the end token alone; a null doc_id hashes as
an empty text (training) and keeps its row; repeated rows count again; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.shared import written
from weftspark.llm.text import mix, text_chunks, words

MODULUS, HELD_OUT, DELETED = 7, 2, 3
#: Bytes of text in a chunk, and of the corpus for each hash range (about half a million distinct n-grams).
CHUNK_BYTES, RANGE_BYTES = 12 << 20, 4 << 20
EM_ROUNDS = 60
#: Resolution of the deleted tokens' probabilities: cells a factor of two.
CELLS = 4
_U = np.uint64
_END, _START = (int(x) for x in mix(np.array([101, 202], _U)))
_LEFT, _RIGHT = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def ngram_keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of word hashes: token keys (an end after each row), bigram keys, context keys and the n+1 token offsets.

    Even keys are words, odd keys are pairs; the context of a row's first token is its start, counted by the ends.
    """
    n = len(offsets) - 1
    bounds = offsets + np.arange(n + 1)
    tokens = np.full(len(hashes) + n, _END, _U)
    tokens[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(offsets))] = hashes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = _START
    pairs = mix(before * _LEFT + mix(tokens + _RIGHT)) | _U(1)
    context = before.copy()
    context[bounds[:-1]] = _END
    return tokens & ~_U(1), pairs, context & ~_U(1), bounds


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte a number; 255 stands for a number in the 64-bit list that follows."""
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<i8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """The low 48 bits; the high ones are the hash range, which is known."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def distinct_counts(hashes: list[np.ndarray], offsets: list[np.ndarray], trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys of some rows and how often they occur in rows of training documents."""
    keys, weights, at = [], [], 0
    for h, o in zip(hashes, offsets):
        tokens, pairs, _, bounds = ngram_keys(h, o)
        own = np.repeat(trained[at : at + len(o) - 1], np.diff(bounds))
        keys += [tokens, pairs]
        weights += [own, own]
        at += len(o) - 1
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    packed = np.sort(keys[weights])
    every = np.unique(keys) if not weights.all() else packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
    left, right = np.searchsorted(packed, every, "left"), np.searchsorted(packed, every, "right")
    return every, right - left


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Slices with their chunk's id and whether it is of deleted documents: the same in every pass over the same input."""
    filled: dict[tuple[int, bool], int] = {}
    for part in text_chunks(batches):
        source, deleted = (part.column(c).to_numpy(zero_copy_only=False) for c in ("source", "deleted"))
        turns = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1], [True])))
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist()):
            piece = part.slice(a, b - a)
            for flag in (False, True):
                own = piece.filter(pa.array(deleted[a:b] == flag))
                if not own.num_rows:
                    continue
                key = int(source[a]), flag
                ends = filled.get(key, 0) + np.cumsum(pc.binary_length(own.column("text")).to_numpy())
                begins = np.concatenate(([filled.get(key, 0)], ends[:-1])) // CHUNK_BYTES
                filled[key] = int(ends[-1])
                cuts = np.flatnonzero(np.concatenate(([True], begins[1:] != begins[:-1], [True])))
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    name = (key[0] & ((1 << 64) - 1)) ^ (2 * int(begins[i]) + flag + 1)
                    yield int(mix(np.array([name], _U)).view(np.int64)[0]), flag, own.slice(i, j - i)


def _send(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct keys with their counts, a row for each hash range."""
    shift = _U(64 - int(math.log2(ranges)))
    open_chunks: dict[bool, tuple[int, list, list, list]] = {}

    def out(flag: bool) -> pa.RecordBatch:
        chunk, hashes, offsets, trained = open_chunks.pop(flag)
        keys, counts = distinct_counts(hashes, offsets, np.concatenate(trained))
        bounds = np.searchsorted(keys >> shift, np.arange(ranges + 1, dtype=_U)) if ranges > 1 else np.array([0, len(keys)])
        rows = [(r, chunk, flag, pack_keys(keys[a:b]), pack_counts(counts[a:b])) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], ["range", "chunk", "deleted", "keys", "counts"])

    for chunk, flag, part in _chunked(batches):
        if flag in open_chunks and open_chunks[flag][0] != chunk:
            yield out(flag)
        held = open_chunks.setdefault(flag, (chunk, [], [], []))
        for to, value in zip(held[1:], (*words(part.column("text")), ~part.column("held_out").to_numpy(zero_copy_only=False))):
            to.append(value)
    for flag in list(open_chunks):
        yield out(flag)


def _sum_range(table: pa.Table) -> pa.Table:
    """Totals of one hash range. For each chunk: a bit for each of its keys that other chunks hold too, and these keys' totals; a row with a null chunk has the range's sums."""
    keys = [unpack_keys(k) for k in table.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    counts = np.concatenate([unpack_counts(c, n) for c, n in zip(table.column("counts").to_pylist(), sizes)])
    deleted = np.repeat(table.column("deleted").to_numpy(), sizes)
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    runs = np.diff(np.append(starts, len(ranked)))
    main = np.add.reduceat(np.where(deleted, 0, counts)[order], starts)
    gone = np.add.reduceat(np.where(deleted, counts, 0)[order], starts)
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), runs)
    several = (runs > 1)[of]
    word = ranked[starts] & _U(1) == 0
    rows, at = [], 0
    for chunk, n in zip(table.column("chunk").to_pylist(), sizes.tolist()):
        own, which = several[at : at + n], of[at : at + n]
        rows.append((chunk, n, np.packbits(own).tobytes(), pack_counts(main[which][own]), pack_counts(gone[which][own]), None, None, None))
        at += n
    rows.append((None, None, None, None, None, int((word & (main + gone > 0)).sum()), int(main[word].sum()), int(gone[word].sum())))
    number = table.column("range")[0].as_py()
    return pa.Table.from_arrays([pa.array([number] * len(rows), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*rows), _TOTAL_TYPES))], names=_TOTAL_NAMES)


_TOTAL_NAMES = ["range", "chunk", "n", "several", "main", "gone", "vocabulary", "main_tokens", "gone_tokens"]
_TOTAL_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_TOTAL_SCHEMA = "range int, chunk long, n long, several binary, main binary, gone binary, vocabulary long, main_tokens long, gone_tokens long"


class ChunkCounts:
    """The corpus counts of every key of one chunk's documents."""

    def __init__(self, docs: pa.Table, totals: pa.Table, deleted: bool):
        self.hashes, self.offsets = [], []
        trained = ~docs.column("held_out").to_numpy()
        for part in text_chunks(iter(docs.to_batches())):
            h, o = words(part.column("text"))
            self.hashes.append(h)
            self.offsets.append(o)
        self.keys, own = distinct_counts(self.hashes, self.offsets, trained)
        none = np.zeros_like(own)
        self.main, self.gone = (none, own) if deleted else (own, none)
        at = 0
        for row in totals.sort_by("range").to_pylist():
            held = np.unpackbits(np.frombuffer(row["several"], np.uint8), count=row["n"]).astype(bool)
            spot = at + np.flatnonzero(held)
            self.main[spot], self.gone[spot] = unpack_counts(row["main"], len(spot)), unpack_counts(row["gone"], len(spot))
            at += row["n"]
        if at != len(self.keys):
            raise ValueError("the input changed between the passes: a chunk holds other n-grams than were counted")

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each slice: places of its tokens, pairs and contexts among the keys, and the token offsets."""
        for h, o in zip(self.hashes, self.offsets):
            tokens, pairs, context, bounds = ngram_keys(h, o)
            yield np.searchsorted(self.keys, tokens), np.searchsorted(self.keys, pairs), self._context(context), bounds

    def _context(self, context: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, context)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of its count's logarithm to base 2."""
    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0)


def _cells(docs: pa.Table, totals: pa.Table, main_tokens: int) -> pa.Table:
    """How many deleted tokens have a context bucket and main-count estimates near given powers of two."""
    c = ChunkCounts(docs, totals, True)
    found = []
    for token, pair, context, _ in c.rows():
        seen, once, many = c.main[context], c.main[token], c.main[pair]
        two = np.where(many > 0, 1 + np.round(-CELLS * np.log2(np.maximum(many, 1) / np.maximum(seen, 1))), 0).astype(np.int64)
        one = np.where(once > 0, 1 + np.round(-CELLS * np.log2(np.maximum(once, 1) / max(1, main_tokens))), 0).astype(np.int64)
        found.append(context_bucket(seen) << 40 | two << 20 | one)
    cells, n = np.unique(np.concatenate(found), return_counts=True)
    return pa.table({"bucket": cells >> 40, "pair": cells >> 20 & 0xFFFFF, "word": cells & 0xFFFFF, "n": n})


def learn_weights(cells: list[tuple[int, int, int, int]], vocabulary: int) -> dict[int, tuple[float, float, float]]:
    """Weights of the bigram, unigram and uniform estimates by bucket, by expectation-maximisation on (bucket, pair, word, n)."""
    out = {}
    if not cells:
        return out
    rows = np.array(sorted(cells), np.int64)
    p = np.zeros((len(rows), 3))
    for i in (0, 1):
        level = rows[:, 1 + i]
        p[:, i] = np.where(level > 0, 2.0 ** (-(level - 1) / CELLS), 0)
    p[:, 2] = 1 / (vocabulary + 1)
    for bucket in [-1, *np.unique(rows[:, 0]).tolist()]:
        own = rows[:, 0] == bucket if bucket >= 0 else rows[:, 0] > 0
        q, n = p[own], rows[own, 3].astype(float)
        if not len(n):
            continue
        weights = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            part = q * weights
            weights = (part / part.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
        # A tenth of a token for each estimate keeps every probability above zero.
        weights = (weights * n.sum() + 0.1) / (n.sum() + 0.3)
        out[bucket] = tuple(weights.tolist())
    return out


def weight_table(learned: dict[int, tuple[float, float, float]]) -> np.ndarray:
    """A row for each bucket to 64; buckets without deleted tokens take the weights over all contexts, an unseen context none for the bigram."""
    general = learned.get(-1, (0.4, 0.5, 0.1))
    out = np.array([learned.get(b, general) for b in range(65)])
    out[0, 0] = 0
    return out / out.sum(1, keepdims=True)


def _score(docs: pa.Table, totals: pa.Table, deleted: bool, tokens_seen: int, vocabulary: int, weights: np.ndarray) -> pa.Table:
    c = ChunkCounts(docs, totals, deleted)
    count = c.main + c.gone
    n_tokens, n_known, base, model = [], [], [], []
    for token, pair, context, bounds in c.rows():
        one, two, seen = count[token], count[pair], count[context]
        w = weights[context_bucket(seen)]
        chance = w[:, 0] * (two / np.maximum(seen, 1)) + w[:, 1] * (one / max(1, tokens_seen)) + w[:, 2] / (vocabulary + 1)
        for to, value in ((n_known, (one > 0).astype(np.int64)), (base, np.log10((one + 1) / (tokens_seen + vocabulary + 1))), (model, np.log10(chance))):
            to.append(np.add.reduceat(value, bounds[:-1]))
        n_tokens.append(np.diff(bounds))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return pa.Table.from_arrays([docs.column("doc_id"), docs.column("held_out"), *(pa.array(np.concatenate(v)) for v in (n_tokens, n_known)), pa.array(np.full(docs.num_rows, tokens_seen, np.int64)), *(pa.array(np.concatenate(v)) for v in (base, model))], names=names)


def interpolated_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs(doc_id, text)``.

    The rows are read three times in the order of their splits; those of another source than files (no file name, and so no
    split known) are first written to the shared folder.
    """
    if docs.where("input_file_name() = ''").limit(1).count():
        docs = written(docs.select("doc_id", "text"), "docs")
    rest = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(MODULUS))
    source = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (rest == HELD_OUT).alias("held_out"), (rest == DELETED).alias("deleted"), source.alias("source"))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = 1 << min(30, max(2, math.ceil(math.log2(max(1, size) / RANGE_BYTES))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _send(batches, ranges)

    sent = own.mapInArrow(send, "range int, chunk long, deleted boolean, keys binary, counts binary")
    totals = written(sent.groupBy("range").applyInArrow(_sum_range, _TOTAL_SCHEMA), "totals")
    sums = totals.where("chunk is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("vocabulary", "main_tokens", "gone_tokens"))).first()
    vocabulary, main_tokens = sums["vocabulary"], sums["main_tokens"]
    tokens_seen = main_tokens + sums["gone_tokens"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, flag, part in _chunked(batches):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([flag] * n), part.column("doc_id"), part.column("held_out"), part.column("text")], ["chunk", "deleted", "doc_id", "held_out", "text"])

    chunked = own.mapInArrow(label, "chunk long, deleted boolean, doc_id long, held_out boolean, text string")
    back = totals.where("chunk is not null").select("range", "chunk", "n", "several", "main", "gone")

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cells(left, right, main_tokens) if left.num_rows else pa.table({c: pa.array([], pa.int64()) for c in ("bucket", "pair", "word", "n")})

    gone = own.where("deleted").mapInArrow(label, "chunk long, deleted boolean, doc_id long, held_out boolean, text string")
    marked = gone.select("chunk").distinct()
    held = gone.groupBy("chunk").cogroup(back.join(marked, "chunk", "left_semi").groupBy("chunk")).applyInArrow(cells, "bucket long, pair long, word long, n long")
    learned = learn_weights([tuple(r) for r in held.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect()], vocabulary)
    weights = weight_table(learned)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, left.column("deleted")[0].as_py(), tokens_seen, vocabulary, weights)

    return chunked.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
