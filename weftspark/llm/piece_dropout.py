"""SentencePiece encoding and decoding with seeded merge-dropout.

A byte-pair agenda holds every candidate merge of neighbouring symbols, best
score first and leftmost among equals. When a candidate is taken from the agenda
a keyed hash of seed, document, the unit's place in the document, merged piece and
place in the unit says whether it is skipped; a skipped merge can come back only as
another candidate, after a neighbour has changed. So every occurrence of a word is
segmented by its own draws, the same on every run and machine, and without dropout
as the library does. Characters outside the vocabulary, and the space mark itself
where a text holds it, become byte pieces: decoding gives back every text.

No piece of a vocabulary read here holds a space mark after another character or
a line end, so merges never leave a unit (spaces and what follows them, up to the
next space or line end). A unit's run depends only on which of its events (candidates
taken, in order) are skipped. Each task remembers the runs that it has met as nodes
of a tree: a node is a unit with the events skipped so far, and lists the events that
follow; an occurrence whose draws skip none of these ends there, another one goes on
to the node of the first that it skips. New nodes run side by side, one event of each
a round, as rows of arrays; draws are arrays over all occurrences. Long units and
those with unknown characters go through the agenda one by one.

Edge cases: a null or empty text has no pieces, as in the library; a null doc_id
draws as 0; rows of one doc_id and text give the same pieces; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.text import give_back, mix, text_chunks

SEED, DROPOUT = 20240, 0.1
#: Nodes after which a task starts a new memory; none is kept beyond the task.
CACHE_NODES = 600_000
#: Symbols up to which units are merged side by side, in groups of no more symbols than these.
SHORT_UNITS = (6, 9, 12, 16, 24, 40)
#: New nodes up to which they are merged in fewer such groups.
FEW = 3000
#: Columns of a node: where its unit's symbols begin and how many there are, the node before it and the turn that was skipped (-1: a root), and the ends of its ids and events.
SYMBOLS, SIZE, PARENT, TURN, IDS, EVENTS = range(6)
#: Stands for a node that no occurrence has reached so far.
NOT_MADE = -2
MARK = "\u2581"
#: Stands for a space mark of the text while merging: two characters, so no symbol of one character and no piece equals it.
LITERAL = "\n\n"
_UNITS = re.compile(r" +[^ \n]*|\n+|[^ \n]+")
_FULL = (1 << 64) - 1
_U = np.uint64


def _mixed(x: int) -> int:
    """``mix`` of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _FULL
    return x ^ x >> 31


def _event(piece: int, place: int) -> int:
    """What a candidate adds to its draw."""
    return _mixed(piece << 32 | place)


def occurrence_keys(seed: int, doc: int, n: int) -> np.ndarray:
    """The keys of a document's units, by their places; the draw of an event is the high half of mix(key ^ event)."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(_mixed(_mixed(seed) + doc & _FULL)))


class Rows:
    """Numbers, or rows of them, that are added to; ``all`` is a view of those so far."""

    def __init__(self, kind, width: int = 0):
        self.held = np.zeros((1024, width) if width else 1024, kind)
        self.all = self.held[:0]

    def __len__(self) -> int:
        return len(self.all)

    def add(self, more: np.ndarray) -> None:
        n = len(self.all)
        if n + len(more) > len(self.held):
            held = np.zeros((n + len(more) + n // 2, *self.held.shape[1:]), self.held.dtype)
            held[:n] = self.all
            self.held = held
        self.held[n : n + len(more)] = more
        self.all = self.held[: n + len(more)]


class PieceCodec:
    """Encoder and decoder of one byte-pair SentencePiece model with byte fallback."""

    def __init__(self, path: str, seed: int = SEED, dropout: float = DROPOUT):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.seed, self.bar = seed, int(dropout * (1 << 32))
        self.byte_ids, self.ids, self.scores, self.raw = [0] * 256, {}, {}, [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {i} crosses units")
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.raw[i] = piece.replace(MARK, " ").encode()
        if not all(self.byte_ids):
            raise ValueError("the model has no byte pieces")
        self.kind = "H" if n <= 1 << 16 else "I"
        self._number_symbols(n)
        self._forget()

    def _number_symbols(self, n: int) -> None:
        """Numbers of characters, and a sorted table of the pairs of symbols that are a piece together.

        Pieces keep their ids; a character that is only part of pieces gets a number
        after them; all others share the last one, which no pair holds.
        """
        numbers = dict(self.ids)
        for c in sorted({c for piece in self.ids for c in piece} - set(numbers)):
            numbers[c] = n + len(numbers) - len(self.ids)
        self.numbers, self.symbols = numbers, n + len(numbers) - len(self.ids) + 1
        self.of_char = np.full(0x110000, self.symbols - 1, np.int32)
        for c, number in numbers.items():
            if len(c) == 1:
                self.of_char[ord(c)] = number
        self.of_char[32], self.of_char[ord(MARK)] = numbers.get(MARK, self.symbols - 1), self.symbols - 1
        rank = {score: k for k, score in enumerate(sorted(set(self.scores.values())))}
        rows = [(numbers[p[:k]] * self.symbols + numbers[p[k:]], rank[self.scores[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in numbers and p[k:] in numbers]
        pairs, ranks, merged = (np.array(c, t) for c, t in zip(zip(*sorted(rows)) if rows else ((-1,), (-1,), (-1,)), (np.int64, np.int32, np.int32)))
        # An open table: a pair stands at its slot or, where that is taken, at the next free one.
        self.shift = 64 - max(8, (16 * len(pairs)).bit_length())
        self.pairs = np.full((1 << 64 - self.shift) + len(pairs), -1, np.int64)
        self.ranks, self.merged = np.full(len(self.pairs), -1, np.int32), np.zeros(len(self.pairs), np.int32)
        for at, pair, rank, number in zip(self._slots(pairs).tolist(), pairs.tolist(), ranks.tolist(), merged.tolist()):
            while self.pairs[at] >= 0:
                at += 1
            self.pairs[at], self.ranks[at], self.merged[at] = pair, rank, number

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(_U) * _U(0x9E3779B97F4A7C15) >> _U(self.shift)).astype(np.int64)

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the piece that each pair would be; rank -1 where it is none."""
        wanted = left.astype(np.int64) * self.symbols + right
        at = self._slots(wanted)
        open_ = np.flatnonzero((self.pairs[at] != wanted) & (self.pairs[at] >= 0))
        while len(open_):
            at[open_] += 1
            open_ = open_[(self.pairs[at[open_]] != wanted[open_]) & (self.pairs[at[open_]] >= 0)]
        return self.ranks[at], self.merged[at]

    def _forget(self) -> None:
        #: Root node by unit; NODE columns in ``nodes``, the symbols of root nodes, and of all nodes their ids and their events, with the node that follows where one is skipped.
        self.roots: dict[str, int] = {}
        self.nodes, self.chars, self.ids_of, self.events, self.child = Rows(np.int64, 6), Rows(np.int32), Rows("<u2" if self.kind == "H" else "<u4"), Rows(_U), Rows(np.int32)

    def _run(self, chars: np.ndarray, sizes: np.ndarray, parents: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of units, each with the node before it and the turn skipped after that (-1: none): whether all their symbols are pieces, ids and how many, events after the last skipped one and how many."""
        begins, first = np.cumsum(sizes) - sizes, turns + 1
        none = np.zeros(0, np.int64)
        events, pieces = [(none, none, none.astype(_U))], [(none, none)]
        known = np.ones(len(sizes), bool)
        widths = SHORT_UNITS if len(sizes) > FEW else SHORT_UNITS[1::2]
        for low, width in zip((0, *widths), widths):
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            if not len(chosen):
                continue
            m, last, wide = len(chosen), self.symbols - 1, width + 1
            # Column `width` stands beyond both ends: its symbol is in no pair.
            inside = np.arange(wide) < sizes[chosen, None]
            own = np.full((m, wide), last, np.int32)
            own[inside] = chars[(begins[chosen, None] + np.arange(wide))[inside]]
            following = np.tile(np.append(np.arange(1, wide), width), m)
            before = np.tile(np.append(width, np.arange(width)), m)
            agenda, piece = np.full((m, wide), -1, np.int32), np.zeros((m, wide), np.int32)
            both = inside[:, 1:]
            agenda[:, :-1][both], piece[:, :-1][both] = self._offers(own[:, :-1][both], own[:, 1:][both])
            skip = np.zeros((m, max(int(first[chosen].max()), 1)), bool)
            at, node, turn = np.arange(m), parents[chosen], turns[chosen]
            while len(at := at[(more := turn >= 0)]):
                node, turn = node[more], turn[more]
                skip[at, turn] = True
                node, turn = self.nodes.all[node, PARENT], self.nodes.all[node, TURN]
            flat_own, flat_piece, alive, flat_alive = own.reshape(-1), piece.reshape(-1), inside, inside.reshape(-1)
            rows, turn, met = np.arange(m), 0, []
            rest = agenda
            while len(rows):
                i = rest.argmax(1)
                open_ = rest[np.arange(len(rows)), i] >= 0
                if not open_.all():
                    # Rows whose agenda is empty leave it.
                    rows, i, rest = rows[open_], i[open_], rest[open_]
                    if not len(rows):
                        break
                base = rows * wide
                new = flat_piece[base + i]
                met.append((rows, new, i))
                flat, here = rest.reshape(-1), np.arange(0, len(rows) * wide, wide)
                if turn < skip.shape[1]:
                    skipped = skip[rows, turn]
                    flat[(here + i)[skipped]] = -1
                    go = ~skipped
                    base, here, i, new = base[go], here[go], i[go], new[go]
                turn += 1
                place = base + i
                j = following[place]
                other = base + j
                after, prior = following[other], before[place]
                flat_own[place], flat_alive[other], flat[here + j] = new, False, -1
                following[place], before[base + after] = after, i
                ranks, numbers = self._offers(np.concatenate([new, flat_own[base + prior]]), np.concatenate([flat_own[base + after], new]))
                k = len(new)
                flat[here + i], flat_piece[place] = ranks[:k], numbers[:k]
                flat[here + prior], flat_piece[base + prior] = ranks[k:], numbers[k:]
            if met:
                at, new, i = (np.concatenate(c) for c in zip(*met))
                done = np.repeat(np.arange(len(met)), [len(r) for r, *_ in met])
                later = done >= first[chosen[at]]
                events.append((chosen[at[later]], done[later], mix(new[later].astype(_U) << _U(32) | i[later].astype(_U))))
            known[chosen] = ~(alive & (own >= len(self.raw))).any(1)
            pieces.append((np.repeat(chosen, alive.sum(1)), own[alive]))
        at, done, drawn = (np.concatenate(c) for c in zip(*events))
        good = known[at]
        at, done, drawn = at[good], done[good], drawn[good]
        order = np.argsort(at << 16 | done)
        owner, ids = (np.concatenate(c) for c in zip(*pieces))
        owner, ids = owner[known[owner]], ids[known[owner]]
        n = len(sizes)
        return known, ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n), drawn[order], np.bincount(at, minlength=n)

    def _add(self, chars: np.ndarray, sizes: np.ndarray, parents: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Numbers of new nodes, by their units' symbols; -1 for units that go one by one."""
        known, ids, n_ids, events, n_events = self._run(chars, sizes, parents, turns)
        numbers = np.where(known, len(self.nodes) + np.cumsum(known) - 1, -1)
        begins = np.cumsum(sizes) - sizes
        symbols = np.where(parents < 0, len(self.chars) + begins, self.nodes.all[parents, SYMBOLS] if len(self.nodes) else 0)
        if (parents < 0).all():
            self.chars.add(chars)
        ends, event_ends = len(self.ids_of) + np.cumsum(n_ids), len(self.events) + np.cumsum(n_events)
        self.nodes.add(np.stack([symbols, sizes, parents, turns, ends, event_ends], 1)[known])
        self.ids_of.add(ids)
        self.events.add(events)
        self.child.add(np.full(len(events), NOT_MADE, np.int32))
        return numbers

    def _add_roots(self, units: list[str]) -> np.ndarray:
        if not units:
            return np.zeros(0, np.int64)
        none = np.full(len(units), -1)
        return self._add(self.of_char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)], np.fromiter(map(len, units), np.int64, len(units)), none, none)

    def _span(self, nodes: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the nodes' ids or events begin, and how many they have."""
        ends = self.nodes.all[:, column]
        begin = np.where(nodes > 0, ends[nodes - 1], 0)
        return begin, ends[nodes] - begin

    def _settle(self, nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The last node of each occurrence, from its root and key."""
        nodes, rows = nodes.copy(), np.flatnonzero(nodes >= 0)
        while self.bar and len(rows):
            begin, n = self._span(nodes[rows], EVENTS)
            ends = np.cumsum(n)
            slot = np.repeat(begin - ends + n, n) + np.arange(ends[-1])
            skipped = np.flatnonzero((mix(np.repeat(keys[rows], n) ^ self.events.all[slot]) >> _U(32)) < self.bar)
            own = np.searchsorted(ends, skipped, "right")
            first = np.flatnonzero(np.diff(own, prepend=-1))
            own, slot = own[first], slot[skipped[first]]
            rows, begin = rows[own], begin[own]
            new = np.flatnonzero(self.child.all[slot] == NOT_MADE)
            if len(new):
                made, at = np.unique(slot[new], return_index=True)
                parents = nodes[rows[new[at]]]
                symbols, sizes, _, turns, *_ = self.nodes.all[parents].T
                upto = np.cumsum(sizes)
                chars = self.chars.all[np.repeat(symbols - upto + sizes, sizes) + np.arange(upto[-1])]
                numbers = self._add(chars, sizes, parents, turns + 1 + made - begin[new[at]])
                self.child.all[made] = numbers
            nodes[rows] = self.child.all[slot]
            rows = rows[nodes[rows] >= 0]
        return nodes

    def segment(self, unit: str, key: int | None = None) -> list[str]:
        """The pieces of one unit of any length, spaces as marks, by its key's draws (none: nothing is skipped); a mark in the text itself stays apart, as LITERAL."""
        symbols: list[str | None] = [MARK if c == " " else LITERAL if c == MARK else c for c in unit]
        n = len(symbols)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        scores, agenda = self.scores, []

        def offer(i: int, j: int) -> None:
            merged = symbols[i] + symbols[j]
            score = scores.get(merged)
            if score is not None:
                heapq.heappush(agenda, (-score, i, j, merged))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, merged = heapq.heappop(agenda)
            if symbols[i] is None or j >= n or symbols[j] is None or following[i] != j or symbols[i] + symbols[j] != merged:
                continue
            if key is not None and _mixed(key ^ _event(self.ids[merged], i)) >> 32 < self.bar:
                continue
            symbols[i], symbols[j] = merged, None
            following[i] = following[j]
            if following[j] < n:
                before[following[j]] = i
                offer(i, following[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s is not None]

    def _unit_ids(self, unit: str, key: int | None) -> bytes:
        out: list[int] = []
        for piece in self.segment(unit, key):
            number = self.ids.get(piece)
            if number is None:
                out += [self.byte_ids[b] for b in (MARK if piece == LITERAL else piece).encode()]
            else:
                out.append(number)
        return array(self.kind, out).tobytes()

    def encode_all(self, texts: list[str], docs: list[int]) -> list[np.ndarray]:
        """The ids of each text, drawn for its document."""
        if len(self.nodes) > CACHE_NODES:
            self._forget()
        flat, counts = [], []
        for text in texts:
            own = _UNITS.findall(" " + text) if text else []
            flat += own
            counts.append(len(own))
        new = set(flat).difference(self.roots)
        short = [u for u in new if len(u) <= SHORT_UNITS[-1]]
        self.roots.update(dict.fromkeys(new, -1))
        self.roots.update(zip(short, self._add_roots(short).tolist()))
        keys = np.concatenate([np.zeros(0, _U), *(occurrence_keys(self.seed, doc, n) for doc, n in zip(docs, counts))])
        nodes = self._settle(np.fromiter(map(self.roots.__getitem__, flat), np.int64, len(flat)), keys)
        single = np.flatnonzero(nodes < 0)
        apart = [np.frombuffer(self._unit_ids(flat[i], int(keys[i]) if self.bar else None), self.ids_of.all.dtype) for i in single.tolist()]
        for u in new:
            if len(u) > SHORT_UNITS[-1]:
                del self.roots[u]
        begin, n = self._span(nodes, IDS) if len(self.nodes) else (np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64))
        # Units that went one by one stand behind the ids of the nodes.
        ids = np.concatenate([self.ids_of.all, *apart]) if apart else self.ids_of.all
        n[single] = [len(x) for x in apart]
        begin[single] = len(self.ids_of) + np.cumsum(n[single]) - n[single]
        ends = np.cumsum(n)
        out = ids[np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *counts])].tolist()
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def encode(self, text: str, doc: int = 0) -> np.ndarray:
        return self.encode_all([text], [doc])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text; the dummy prefix's space is taken off."""
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode()


_CODECS: dict[tuple[str, int, float], PieceCodec] = {}


def codec(path: str, seed: int = SEED, dropout: float = DROPOUT) -> PieceCodec:
    """One codec a Python worker, model file and setting; what it remembers of texts goes with the task."""
    key = path, seed, dropout
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(path, seed, dropout)
    return _CODECS[key]


def encode_pieces(docs: DataFrame, model: str, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, text, ids (little-endian 32-bit), decoded of every row of ``docs(doc_id, text)``; ``decoded`` is made from the ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, seed, dropout)
        for part in text_chunks(batches):
            found = own.encode_all(part.column("text").to_pylist(), [doc or 0 for doc in part.column("doc_id").to_pylist()])
            ids, decoded = [x.astype("<u4").tobytes() for x in found], [own.decode(x) for x in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "text", "ids", "decoded"])
        # The worker lives on, in later stages too.
        own._forget()
        give_back()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, text string, ids binary, decoded string")


def piece_digest(encoded: DataFrame) -> DataFrame:
    """Number and checksum of the ids, the decoded text's digest, and whether it is the text."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )
