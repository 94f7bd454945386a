"""N-gram Jaccard join: parity sketches, pigeonhole candidates by size band, exact verification.

A document's set is its distinct 5-word shingles. A parity sketch deals the
shingles' hash space into k cells and keeps the XOR of the hashes that fall in
each cell. Sketches are linear, so a cell can differ between two sets only where
a shingle of their symmetric difference falls: the number of differing cells is
a lower bound of that difference. Sets with intersection >= 3/4 of their union
differ in at most n/3 shingles, n being either size, so of the first n/3 + 1
non-empty cells of each, in one global order, at least one is equal in both
(where too few cells are filled, empty ones follow in the same order). Joining
those cells therefore finds every pair. The number of cells is fixed for a size
band (from lo to 4 lo: 2 lo cells); a set within a quarter of the next band is
sketched for that band too.

Lists are longer by a slack of n/9 cells. Linked documents then share more than
the smaller slack of them, so if either holds no more than that many cells that
are frequent in the corpus, they share a rare one. Pairs are taken from the rare
cells' groups. Only documents with more frequent cells than that can be missed,
and only by each other. They are joined again among themselves under their finest
sketch, one cell a shingle. There a cell that no other of them holds is a bit that
differs from every partner: a document with more than n/4 such bits has no link
left and goes, again and again, which leaves fewer for the others. Of two linked
sets the private bits together are at most a seventh of both sizes; so a group of
a cell (taken from each document's rarest n/4 + 1) is compared with its members
of fewest private bits for their size first, and a member drops out as soon as it
could link with none that is left, even if nothing else differed. A passage that
many otherwise different texts share therefore makes no pairs of these texts, and
copies of one text are one class after few rounds. Hot cells are aggregated before
they are shuffled and joined by cell with the leaders of a round: one of each group
at first, LEADERS times as many in each later round, which only what is still of
several classes reaches.

Members of those groups carry a parity sketch of SHORT_BITS bits besides: a pair
whose short sketches differ in too many bits is never made.
Candidates are compared by folded one-bit-a-shingle parity sketches first: more
differing bits than a linked pair of these sizes may have rule a pair out; the
rest is verified on the whole sets. What is asked for is the classes, so within
a group only pairs of different classes are compared. No pair is dropped.

Edge cases: null or empty texts have no shingles and stand alone; rows with a
null doc_id stand alone with a null component; rows that share a doc_id are one
node; equal sets are one class from the start; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm.components import connected_components
from weftspark.llm.shared import broadcast_if_small, written
from weftspark.llm.text import give_back, mix, shingle_sets, text_chunks, words

SHARE, OF = 75, 100
#: Sizes below this are sketched with one cell a shingle; bands from here grow by BAND_GROWTH.
FIRST_BAND, BAND_GROWTH = 64, 4
#: Members of a group up to which its cell counts as rare; how many times more leaders a larger group has in each round than in the one before, from one on.
SMALL_GROUP, LEADERS = 32, 64
#: Earlier cells of two lists that are compared before a pair is made once more.
LOOK_BACK = 12
#: Rows of an Arrow batch, which a task and its Python worker hold several times beside the heap; a pair comes with both whole sets.
BATCH_ROWS = 1_000
#: Ids that may be broadcast to filter the texts of candidates (16 MB); beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Equal sets that a task remembers, to send their cells once.
REMEMBERED = 500_000
#: Bits of the parity sketch that members of large groups carry, as SHORT columns of 64.
SHORT_BITS = 256
SHORT = tuple(f"s{i}" for i in range(SHORT_BITS // 64))
#: A set: the document that stands for it, its size and a part of its name (rows of one doc_id may hold different texts).
NODE = ("rep", "n", "mark")
_U = np.uint64


def size_bands(n: int) -> list[int]:
    """The band of a size, and the next one where a linked set could be in it."""
    low, band = FIRST_BAND, 0
    while n >= low:
        low *= BAND_GROWTH
        band += 1
    return [band, band + 1] if OF * n >= SHARE * low else [band]


def prefix_length(n: int) -> int:
    """One more than the largest symmetric difference with a linked set."""
    return n * (OF - SHARE) // SHARE + 1


def listed_cells(own: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """The cells of a sorted shingle set's parity sketch as hashes, in their global order, and how many are filled; at least ``prefix_length`` + ``slack`` of a large set."""
    salt = mix(np.array([band + 1], _U))
    if not band:
        return np.sort(mix(own ^ salt)), len(own)
    cells = 2 * FIRST_BAND * BAND_GROWTH ** (band - 1)
    place = ((own >> _U(32)) * _U(cells)) >> _U(32)
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    parity = np.bitwise_xor.reduceat(own, starts)
    full = parity != 0
    tokens = np.sort(mix(parity[full] ^ salt))
    filled = len(tokens)
    if (lack := prefix_length(len(own)) + slack(len(own)) - filled) > 0:
        empty = np.setdiff1d(np.arange(cells, dtype=_U), place[starts[full]])
        tokens = np.concatenate([tokens, mix(mix(empty + salt) ^ salt)[:lack]])
    return tokens, filled


def cell_tokens(own: np.ndarray, band: int) -> np.ndarray:
    return listed_cells(own, band)[0]


def parity_bits(own: np.ndarray) -> bytes:
    """A one-bit-a-shingle parity sketch; its size is a power of two, at least the set's size and 64 bits."""
    size = max(64, 1 << max(0, len(own) - 1).bit_length())
    place = (own & _U(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def short_sketch(own: np.ndarray) -> list[int]:
    """The parity sketch of SHORT_BITS bits, as signed 64-bit numbers."""
    parity = np.bincount((own & _U(SHORT_BITS - 1)).astype(np.int64), minlength=SHORT_BITS).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view(np.int64).tolist()


def differing_bits(x: bytes, y: bytes) -> int:
    """Hamming distance of two parity sketches; the longer one is folded by XOR, which keeps it a parity sketch."""
    x, y = (np.frombuffer(v, np.uint64) for v in ((x, y) if len(x) <= len(y) else (y, x)))
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def _lists(parts: list[np.ndarray], counts: list[int]) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat))


def slack(n: int) -> int:
    """Cells listed beyond ``prefix_length``."""
    return n // 9


def _print_of(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    spread = mix(own)
    return int(spread.sum(dtype=_U)), int(np.bitwise_xor.reduce(mix(spread + _U(1)))) if len(own) else 0


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_chunks(batches):
        sizes, prints, bits = [], [], []
        for own in shingle_sets(*words(part.column("text"))):
            sizes.append(len(own))
            prints.append(_print_of(own))
            bits.append(parity_bits(own))
        marks = np.array(prints, _U).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(bits, pa.binary())], ["doc_id", "n", "print1", "print2", "bits"])


def _first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, doc_id) of the listed cells; equal sets of one task send theirs once."""
    seen: set[tuple[int, int]] = set()
    for part in text_chunks(batches):
        ids, tokens, counts = [], [], []
        for doc, own in zip(part.column("doc_id").to_pylist(), shingle_sets(*words(part.column("text")))):
            mark = _print_of(own)
            if doc is None or not len(own) or mark in seen:
                continue
            if len(seen) < REMEMBERED:
                seen.add(mark)
            for band in size_bands(len(own)):
                tokens.append(cell_tokens(own, band)[: prefix_length(len(own)) + slack(len(own))])
                ids.append(doc)
                counts.append(len(tokens[-1]))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), counts))], ["token", "doc_id"])


def _finest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's size, the first half of its set's name, its short sketch and all its shingles."""
    for part in text_chunks(batches):
        ids, sizes, marks, short, tokens = [], [], [], [], []
        for doc, own in zip(part.column("doc_id").to_pylist(), shingle_sets(*words(part.column("text")))):
            if len(own):
                ids.append(doc)
                sizes.append(len(own))
                marks.append(_print_of(own)[0])
                short.append(short_sketch(own))
                tokens.append(own)
        columns = np.array(short, np.int64).reshape(-1, len(SHORT)).T
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(marks, _U).view(np.int64)), *map(pa.array, columns), _lists(tokens, sizes)], [*NODE, *SHORT, "tokens"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_chunks(batches):
        sets = [own.tobytes() for own in shingle_sets(*words(part.column("text")))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            linked.append(OF * common >= SHARE * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])
    give_back()


def _near_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops pairs whose sketches differ in more bits than the symmetric difference of linked sets may have members."""
    for batch in batches:
        rows = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist())
        keep = [differing_bits(x, y) * (OF + SHARE) <= (OF - SHARE) * (na + nb) for na, nb, x, y in rows]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    give_back()


def _near_pairs(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Written pairs whose whole parity sketches differ in few enough bits."""
    first, second = (reps.select(F.col("rep").alias(i), F.col("n").alias(f"n{i}"), F.col("bits").alias(v)) for i, v in (("a", "x"), ("b", "y")))
    near = pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "x", "y")
    return written(near.mapInArrow(_near_enough, "a long, b long"), "near", BATCH_ROWS)


def _verify(docs: DataFrame, near: DataFrame) -> DataFrame:
    """Written linked pairs (a, b), by the sets of the whole texts."""
    ids = written(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "ids")
    chosen = docs.join(broadcast_if_small(ids, ids.count(), BROADCAST_IDS), "doc_id", "left_semi")
    sets = written(chosen.mapInArrow(_sets, "doc_id long, shingles binary").distinct(), "sets", BATCH_ROWS)
    first, second = (sets.select(F.col("doc_id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    joined = near.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return written(joined.mapInArrow(_compare, "a long, b long, linked boolean").where("linked").select("a", "b"), "verified", BATCH_ROWS)


def _classed(rows: DataFrame, component: DataFrame) -> DataFrame:
    """The rows with the class that their document has by now."""
    return rows.join(component, rows["rep"] == component["node"], "left").select(*rows.columns, F.coalesce("component", "rep").alias("class"))


def _rare_pairs(rare: DataFrame, done: DataFrame) -> DataFrame:
    """Written pairs of two classes, of sizes that may link, in groups (token, rep, n, class) of at most SMALL_GROUP documents; not those done before.

    One shuffle by cell serves for dropping repeated rows and for both sides of the join.
    """
    held = rare.repartition("token").distinct()
    a, b = held.toDF("token", "a", "na", "ca"), held.toDF("token", "b", "nb", "cb")
    pairs = a.join(b, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (OF * F.least("na", "nb") >= SHARE * F.greatest("na", "nb")))
    return written(pairs.select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "pairs")


def _shared_cells(tokens: DataFrame) -> DataFrame:
    """Rows of cells that several documents list, with the least of these (hub) and whether they are more than SMALL_GROUP.

    Hardly any cell of a task comes twice, so sums before the shuffle and a join with them would be a second round of all cells.
    """
    group = Window.partitionBy("token")
    held = tokens.withColumns({"size": F.count("*").over(group), "hub": F.min("doc_id").over(group)}).where("size > 1")
    return held.select("token", "doc_id", "hub", (F.col("size") > SMALL_GROUP).alias("frequent"))


def _private(rows: DataFrame) -> DataFrame:
    """NODE and private, the number of a set's cells that no other set of the rows (NODE, token) holds; sets without any are left out."""
    alone = rows.groupBy("token").agg(F.count("*").alias("held"), *(F.min(c).alias(c) for c in NODE)).where("held = 1")
    return alone.groupBy(*NODE).agg(F.count("*").alias("private"))


def _crowded_groups(docs: DataFrame, affected: DataFrame) -> DataFrame | None:
    """Written groups (token, NODE, short sketch, excess) of the rarest cells of the affected documents that can still link; None if none can.

    ``excess`` is OF + SHARE times the private bits less OF - SHARE times the size: two sets whose sum is above 0 are not linked.
    """
    chosen = docs.join(broadcast_if_small(affected, affected.count(), BROADCAST_IDS), "doc_id", "left_semi")
    kinds = ", ".join(f"{c} long" for c in (*NODE, *SHORT))
    cells = written(chosen.mapInArrow(_finest, f"{kinds}, tokens array<long>").distinct(), "fine", BATCH_ROWS)
    before = cells.count()
    while True:
        rows = cells.select(*NODE, F.explode("tokens").alias("token"))
        known = cells.join(_private(rows), list(NODE), "left").withColumn("private", F.coalesce("private", F.lit(0)))
        left = written(known.where(OF * F.col("private") <= (OF - SHARE) * F.col("n")), "fine")
        after = left.count()
        if not after:
            return None
        cells = left.drop("private")
        if before - after <= after // 4:
            break
        before = after
    rows = left.select(*NODE, "private", *SHORT, F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    place = F.row_number().over(Window.partitionBy(*NODE).orderBy("held", "token"))
    need = F.floor(F.col("n") * (OF - SHARE) / OF) + 1 - F.col("private")
    excess = (OF + SHARE) * F.col("private") - (OF - SHARE) * F.col("n")
    return written(rows.join(counts, "token").withColumn("place", place).where(F.col("place") <= need).select("token", *NODE, *SHORT, excess.alias("excess")), "groups")


def _open(groups: DataFrame, component: DataFrame) -> DataFrame:
    """Written rows, with their classes, that may still link with another class of their group."""
    held = _classed(groups, component)
    least = held.groupBy("token").agg(F.min("excess").alias("least"), F.min("class").alias("low"), F.max("class").alias("high"))
    return written(held.join(least.where("low <> high"), "token").where(F.col("excess") + F.col("least") <= 0).drop("least", "low", "high"), "open")


def _led_pairs(held: DataFrame, turn: int, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written pairs (a, b) of a round's leaders with the other members, and the members without the leaders.

    A leader is the member with the least excess of a salted part of its group; the parts grow in number with the rounds.
    Two documents that share a passage meet in each of its cells. Where one of the LOOK_BACK cells before this one in
    the leader's list is among those before it in the other's, and the leader leads there too, they have met there
    already, or before; so a pair is made few times.
    """
    parts = min(1 << 40, LEADERS**turn)
    best = held.groupBy("token", F.pmod(F.xxhash64(*NODE), F.lit(parts)).alias("part")).agg(F.min(F.struct("excess", *NODE)).alias("first"))
    leads = best.select("token", *(F.col(f"first.{c}").alias(c) for c in NODE), F.lit(True).alias("leads"))
    earlier = Window.partitionBy(*NODE).orderBy("token").rowsBetween(-LOOK_BACK, -1)
    marked = held.join(leads, ["token", *NODE], "left")
    listed = written(marked.withColumns({"before": F.collect_list("token").over(earlier), "met": F.collect_list(F.when(F.col("leads"), F.col("token"))).over(earlier)}), "listed")
    lead = listed.where("leads").select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("class").alias("ca"), F.col("excess").alias("ea"), "met", *(F.col(c).alias(f"{c}_a") for c in SHORT))
    rest = listed.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("class").alias("cb"), F.col("excess").alias("eb"), "before", *SHORT)
    apart = reduce(add, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_a"))) for c in SHORT))
    fits = (F.col("ca") != F.col("cb")) & (F.col("ea") + F.col("eb") <= 0) & (OF * F.least("na", "nb") >= SHARE * F.greatest("na", "nb")) & (apart * (OF + SHARE) <= (F.col("na") + F.col("nb")) * (OF - SHARE))
    pairs = rest.join(lead, "token").where(fits & ~F.arrays_overlap("met", "before")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    others = listed.where("leads is null").drop("class", "leads", "before", "met")
    return written(pairs.join(done, ["a", "b"], "left_anti"), "pairs"), others


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """Written components after more links; every component goes in as a star of its members."""
    if links.isEmpty():
        return component
    return connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), "a", "b")


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for every row of ``docs(doc_id, text)``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(own.mapInArrow(_sketches, "doc_id long, n long, print1 long, print2 long, bits binary"), "sketches", BATCH_ROWS)
    filled = sketches.where("doc_id is not null and n > 0")
    same = ["n", "print1", "print2"]
    classes = filled.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("bits").alias("bits"))
    members = written(filled.select("doc_id", *same).join(classes.drop("bits"), same).select("doc_id", "rep", "n").distinct(), "members")
    reps = written(classes.select("rep", "n", "bits"), "reps")

    shared = written(_shared_cells(own.mapInArrow(_first_tokens, "token long, doc_id long")), "shared", BATCH_ROWS)
    links = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    # Each with the document that is the smallest of most of its cells' groups: this links most copies.
    most = shared.where("hub <> doc_id").repartition("doc_id").groupBy("doc_id", "hub").agg(F.count("*").alias("common"))
    nearest = most.groupBy("doc_id").agg(F.max_by("hub", F.struct("common", -F.col("hub"))).alias("hub"))
    named = nearest.join(members.select("doc_id", F.col("rep").alias("b")), "doc_id").join(members.select(F.col("doc_id").alias("hub"), F.col("rep").alias("a")), "hub")
    done = written(named.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    component = connected_components(links.union(_verify(own, _near_pairs(reps, done))), "a", "b")

    # Cells are far more than documents, so they get all that is known of theirs at once.
    known = written(_classed(members, component), "known")
    pairs = _rare_pairs(shared.where("not frequent").select("token", "doc_id").join(known, "doc_id").select("token", "rep", "n", "class"), done)
    done = done.union(pairs)
    # Waits for the links of the next round: what it would tell apart is at worst compared once more.
    waiting = _verify(own, _near_pairs(reps, pairs))

    allowed = F.floor(F.floor(F.col("n") / 9) * SHARE / OF)
    crowded = shared.where("frequent").select("token", "doc_id", F.count("*").over(Window.partitionBy("doc_id")).alias("crowd"))
    several = crowded.join(known, "doc_id").where(F.col("crowd") > allowed).select("token", "rep", "class")
    mixed = several.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("token")
    affected = written(several.join(mixed, "token", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "affected")
    groups = None if affected.isEmpty() else _crowded_groups(own, affected)
    turn = 0
    while groups is not None:
        held = _open(groups, component)
        if held.isEmpty():
            break
        pairs, groups = _led_pairs(held, turn, done)
        turn += 1
        if pairs.isEmpty():
            continue
        done, links = done.union(pairs), _verify(own, pairs)
        if not links.isEmpty():
            component, waiting = _joined(component, links.union(waiting)), waiting.limit(0)
    component = _joined(component, waiting)
    out = sketches.select("doc_id", F.col("n").alias("n_shingles")).join(component, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
