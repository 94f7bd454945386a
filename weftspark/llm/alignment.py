"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers' tokens of a whole Arrow batch are laid end to end over the batch's
bytes, each document with a place of its own before its first byte. Token lengths
summed up give the byte offset at which each token ends; the ends of A and of B are
counted once by bincount, and wherever both have one the text is cut. Prefix sums of
the cuts, read at the documents' borders, give each document's groups, and at a
token's end the group that it belongs to.

A link is a pair of tokens, one of A and one of B, that end at the same byte: since
no entry of a vocabulary is empty, there is one link a group, of its last tokens.
The number of links that hold an id pair is summed over all documents (added up by
document, then by task, before anything is shuffled). Every document's links are
then looked up: the most frequent pairs, BROADCAST_PAIRS at most, are broadcast, which
is nearly all links of a text, and the links of rarer ones, none of them a hot key,
are joined by a shuffle.

Edge cases: null and empty texts, and texts whose tokens of A or B do not give back
the bytes of a space and the text (a normalizer has changed them), have no tokens:
all numbers are 0 and the groups are ''. Strings of special tokens within texts are
plain text. Every row counts, those that repeat a doc_id or a text too; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm.shared import written
from weftspark.llm.text import raw_bytes, text_chunks
from weftspark.llm.token_records import WordEncoder

#: Id pairs that are broadcast at most (24 bytes each, about 100 MB as Spark's hashed table).
BROADCAST_PAIRS = 1_000_000
_COLUMNS = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<struct<a:int,b:int,n:int>>"


class ByteVocabulary:
    """The bytes of every entry of a vocabulary, laid end to end."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        size = self.size[ids]
        total = np.cumsum(size)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(self.start[ids] - (total - size), size)
        return self.data[at]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are their own letters, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted({*range(256)} - {*own})
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = WordEncoder(byte_level, literal=True)
        vocabulary = self.a.tokenizer.get_vocab()
        letters, entries = byte_letters(), [b""] * len(vocabulary)
        for entry, i in vocabulary.items():
            entries[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.a_bytes = ByteVocabulary(entries)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = ByteVocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]])
        if not (self.a_bytes.size.all() and self.b_bytes.size.all()):
            raise ValueError("an entry of a vocabulary has no bytes")

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A over a space and the text, and of B over the text; none for an empty text."""
        a = [np.frombuffer(x, self.a.dtype).astype(np.int64) for x in self.a.encode([" " + t for t in texts])]
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]
        return [x if t else x[:0] for x, t in zip(a, texts)], [x if t else x[:0] for x, t in zip(b, texts)]


def _faithful(own: ByteVocabulary, ids: list[np.ndarray], source: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Which documents' tokens give back their bytes (``source`` cut at ``border``)."""
    sizes = np.array([own.size[x].sum() for x in ids], np.int64)
    same = sizes == np.diff(border)
    held = [x for x, s in zip(ids, same) if s]
    made = own.joined(np.concatenate([np.zeros(0, np.int64), *held]))
    wanted = np.repeat(same, np.diff(border))
    wrong = np.zeros(len(source) + 1, np.int64)
    wrong[1:][wanted] = made != source[wanted]
    wrong = np.cumsum(wrong)
    return same & (wrong[border[1:]] == wrong[border[:-1]])


def _numbers(ids: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in decimal, each with a separator byte after it (none where 0), and the offsets of each."""
    digits = np.searchsorted(10 ** np.arange(1, 10), ids, "right") + 1
    size = digits + (sep > 0)
    end = np.cumsum(size)
    out = np.zeros(end[-1] if len(end) else 0, np.uint8)
    rest, at = ids.copy(), end - size + digits - 1
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        out[at[has] - k] = 48 + rest[has] % 10
        rest //= 10
    out[(end - 1)[sep > 0]] = sep[sep > 0]
    return out, np.concatenate(([0], end))


def align(a: list[np.ndarray], b: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray) -> dict[str, list]:
    """Groups and links of a batch of documents whose tokens of A and of B have the same bytes.

    For each document: n_groups, groups (the text ``a1,a2|b1;a3|b2,b3``), and the linked ids link_a and link_b in order.
    """
    count_a, count_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    doc_a, doc_b = np.repeat(np.arange(len(a)), count_a), np.repeat(np.arange(len(b)), count_b)
    # One more place a document, so that no end falls on another document's border.
    end_a, end_b = np.cumsum(a_size[ids_a]) + doc_a, np.cumsum(b_size[ids_b]) + doc_b
    length = int(max(end_a.max(initial=0), end_b.max(initial=0))) + 1
    cut = (np.bincount(end_a, minlength=length) > 0) & (np.bincount(end_b, minlength=length) > 0)
    before = np.concatenate(([0], np.cumsum(cut)))
    last_a, last_b = cut[end_a], cut[end_b]
    link_a, link_b = ids_a[last_a], ids_b[last_b]
    n_groups = np.bincount(doc_a[last_a], minlength=len(a))

    # Tokens in the groups' order, A's before B's.
    group, side = np.concatenate([before[end_a], before[end_b]]), np.repeat([0, 1], [len(ids_a), len(ids_b)])
    order = np.lexsort((side, group))
    last, side = np.concatenate([last_a, last_b])[order], side[order]
    sep = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(","))
    both = count_a + count_b
    ends = np.cumsum(both)
    sep[ends[both > 0] - 1] = 0
    text, at = _numbers(np.concatenate([ids_a, ids_b])[order], sep)
    text, border = text.tobytes(), at[np.concatenate(([0], ends))].tolist()
    links = np.concatenate(([0], np.cumsum(n_groups))).tolist()
    return {
        "n_groups": n_groups.tolist(),
        "groups": [text[x:y].decode() for x, y in zip(border[:-1], border[1:])],
        "link_a": [link_a[x:y] for x, y in zip(links[:-1], links[1:])],
        "link_b": [link_b[x:y] for x, y in zip(links[:-1], links[1:])],
    }


def _distinct_pairs(link_a: list[np.ndarray], link_b: list[np.ndarray]) -> pa.Array:
    """Each document's distinct linked pairs with their number."""
    doc = np.repeat(np.arange(len(link_a)), [len(x) for x in link_a])
    key = doc << 40 | np.concatenate([np.zeros(0, np.int64), *link_a]) << 20 | np.concatenate([np.zeros(0, np.int64), *link_b])
    key, n = np.unique(key, return_counts=True)
    offsets = np.searchsorted(key >> 40, np.arange(len(link_a) + 1))
    fields = [pa.array(x.astype(np.int32)) for x in (key >> 20 & 0xFFFFF, key & 0xFFFFF, n)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["a", "b", "n"]))


_PAIRS: dict[tuple[str, str], Pair] = {}


def aligned_tokens(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups, pairs (distinct linked ids with their number) of every row of ``docs(doc_id, text)``; ``row`` is a number of the row's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = byte_level, pieces
        if key not in _PAIRS:
            _PAIRS[key] = Pair(*key)
        own = _PAIRS[key]
        for part in text_chunks(batches):
            column = part.column("text")
            a, b = own.encode(column.to_pylist())
            data, offsets = raw_bytes(column)
            filled = np.diff(offsets) > 0
            border = offsets + np.concatenate(([0], np.cumsum(filled)))
            source = np.full(border[-1], 32, np.uint8)
            source[np.arange(len(data)) + np.repeat(np.cumsum(filled), np.diff(offsets))] = data
            good = _faithful(own.a_bytes, a, source, border) & _faithful(own.b_bytes, b, source, border)
            a, b = [x if g else x[:0] for x, g in zip(a, good)], [x if g else x[:0] for x, g in zip(b, good)]
            got = align(a, b, own.a_bytes.size, own.b_bytes.size)
            columns = [part.column("row"), part.column("doc_id"), pa.array([len(x) for x in a], pa.int64()), pa.array([len(x) for x in b], pa.int64()), pa.array(got["n_groups"], pa.int64()), pa.array(got["groups"], pa.string()), _distinct_pairs(got["link_a"], got["link_b"])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs"])

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, _COLUMNS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (links that hold the pair in all documents) and best (whether no other pair of this b has more)."""
    rows = aligned.select(F.explode("pairs").alias("p")).select("p.a", "p.b", "p.n")
    counts = rows.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The least count from which on there are at most so many pairs: a power of two."""
    steps = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("step")).count().collect()
    held, least = 0, 1 << 62
    for step, n in sorted(steps, reverse=True):
        held += n
        if held > most:
            break
        least = 1 << step
    return least


def link_sums(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best and count_sum over the links of every written row that has any."""
    rows = aligned.select("row", F.explode("pairs").alias("p")).select("row", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.n").alias("n"))
    least = _frequent_from(counts, BROADCAST_PAIRS)
    known = rows.join(F.broadcast(counts.where(F.col("count") >= least)), ["a", "b"], "left")
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    frequent = known.where("count is not null").groupBy("row").agg(*sums)
    rarer = counts.where(F.col("count") < least)
    if rarer.isEmpty():
        return frequent
    rare = known.where("count is null").select("row", "a", "b", "n").join(rarer, ["a", "b"]).groupBy("row").agg(*sums)
    return frequent.union(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned_digest(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and the groups' digest of every row."""
    tokens = aligned_tokens(docs, byte_level, pieces).withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    aligned = written(tokens, "aligned")
    counts = written(pair_counts(aligned), "counts")
    sums = link_sums(aligned, counts)
    return aligned.drop("pairs").join(sums, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        F.col("groups").alias("groups_sha256"),
    )
