"""Token-id output: framed binary records with masked checksums and an offset index beside each file.

A record is ``u64 payload length | u32 masked crc of the length | payload | u32
masked crc of the payload``, all little-endian; the payload is the document's id
(i64), the width of an id in bytes (u8) and the token ids. The mask rotates the
crc-32 by 15 bits and adds 0xA282EAD8, so that a checksum stored inside other
checksummed data is not its own check. The index file has one ``u64 offset, u64
length, i64 doc_id`` entry a record, so a reader can fetch records in any order.

Documents are range-partitioned by id, so a file holds one id range and file
order is document order. A task writes to a name of its own; only the names in
the manifest, which Spark commits, are read, so repeated attempts do no harm.

Edge cases: a null or empty text is the single end id; a null doc_id sorts first
and is stored as the smallest 64-bit number, read back as null; repeated ids
keep all their rows; an empty table gives no files and no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm.shared import work_path, written
from weftspark.llm.text import text_chunks

END_ID = 0
NULL_ID = -(1 << 63)
#: Pieces whose ids a Python worker remembers (about 40 MB more than 600,000 took); what is forgotten is merged anew.
CACHE_WORDS = 900_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t\n\r -~{_LETTERS}]*")
# Fixed value: the vocabulary's published pattern, for the characters above, with the most frequent branch first.
_PIECES = re.compile(rf" ?[{_LETTERS}]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^\s0-9{_LETTERS}]++|\s+(?!\S)|\s+")
#: Pieces that the library encodes as one text.
RUN = 256
_HEAD = struct.Struct("<QI")
_OWN = struct.Struct("<qB")
_INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("doc_id", "<i8")])


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at an offset and the offset after it; raises ValueError where the bytes are damaged."""
    if at + 12 > len(data):
        raise ValueError(f"a record at {at} is cut off")
    length, crc = _HEAD.unpack_from(data, at)
    if crc != masked_crc(data[at : at + 8]):
        raise ValueError(f"the length of the record at {at} is damaged")
    end = at + 12 + length
    payload = data[at + 12 : end]
    if end + 4 > len(data) or struct.unpack_from("<I", data, end)[0] != masked_crc(payload):
        raise ValueError(f"the payload of the record at {at} is damaged")
    return payload, end + 4


def document_payload(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return _OWN.pack(NULL_ID if doc_id is None else doc_id, width) + ids


def parse_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc, width = _OWN.unpack_from(payload)
    return None if doc == NULL_ID else doc, np.frombuffer(payload, f"<u{width}", offset=_OWN.size).astype("<u4")


def index_entries(rows: list[tuple[int, int, int | None]]) -> bytes:
    return np.array([(at, n, NULL_ID if doc is None else doc) for at, n, doc in rows], _INDEX).tobytes()


def read_index(data: bytes) -> np.ndarray:
    """The entries (offset, length, doc_id) of an index file, in file order."""
    return np.frombuffer(data, _INDEX)


def stream_payloads(stream) -> Iterator[bytes]:
    """The payloads of a record file, one after another."""
    while head := stream.read(_HEAD.size):
        rest = stream.read(_HEAD.unpack(head)[0] + 4) if len(head) == _HEAD.size else b""
        yield unframe(head + rest, 0)[0]


class WordEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, remembering pieces.

    The library cuts a text into pieces by the published pattern of this
    vocabulary and never merges across a cut. Texts of ASCII and Latin letters
    are cut here by the same pattern, and each distinct piece is encoded once;
    texts with other characters, or with a special token's string, are encoded
    whole. With ``literal`` the strings of special tokens are plain text.
    """

    def __init__(self, path: str, literal: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        # Ids whose bytes begin with a space.
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, new: list[str]) -> list[tuple[str, bytes]]:
        """The pieces with their ids. Words after a space are cut apart in any text, so they go to the library in runs; each begins with the only id that holds a space."""
        spaced, others = [], []
        for p in new:
            (spaced if p[0] == " " and p[-1].isalpha() else others).append(p)
        runs, out = [spaced[i : i + RUN] for i in range(0, len(spaced), RUN)], []
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            cuts = (np.flatnonzero(self.spaced[ids]) * self.dtype.itemsize).tolist()
            if len(cuts) != len(run):
                others += run
                continue
            data = ids.astype(self.dtype).tobytes()
            out += [(p, data[a:b]) for p, a, b in zip(run, cuts, [*cuts[1:], len(data)])]
        return out + list(zip(others, self._whole(others)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        cut = [_PIECES.findall(t) if p else [] for t, p in zip(texts, plain)]
        # Each occurrence is looked up once; only the places of new pieces are looked at again.
        found = [list(map(self.known.get, c)) for c in cut]
        lack = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        new = list({c[i] for c, places in zip(cut, lack) for i in places})
        self.known.update(self._pieces(new))
        for c, f, places in zip(cut, found, lack):
            for i in places:
                f[i] = self.known[c[i]]
        rest = iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        return [b"".join(f) if p else next(rest) for f, p in zip(found, plain)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)``, write record and index files below ``folder`` and return the manifest.

    Manifest: file, index_file, shard, n_records, n_tokens, n_bytes; ``shard`` numbers follow document order.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode, out, index = encoder(vocabulary), None, None
        offset = records = tokens = 0
        end = np.array([end_id], encode.dtype).tobytes()
        width = encode.dtype.itemsize
        fs, base = _open(folder)
        name = f"{base}/part-{shard:06d}-{uuid.uuid4().hex}"
        for part in text_chunks(batches):
            if out is None:
                fs.create_dir(base, recursive=True)
                out, index = fs.open_output_stream(f"{name}.rec"), fs.open_output_stream(f"{name}.idx")
            ids, entries = part.column("doc_id").to_pylist(), []
            for doc, coded in zip(ids, encode.encode(part.column("text").to_pylist())):
                data = frame(document_payload(doc, width, coded + end))
                entries.append((offset, len(data), doc))
                out.write(data)
                offset += len(data)
                tokens += len(coded) // width + 1
            records += len(ids)
            index.write(index_entries(entries))
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{name}.rec", "index_file": f"{name}.idx", "shard": shard, "n_records": records, "n_tokens": tokens, "n_bytes": offset}], schema=pa.schema([("file", pa.string()), ("index_file", pa.string()), ("shard", pa.int32()), ("n_records", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ranged.mapInArrow(write, "file string, index_file string, shard int, n_records long, n_tokens long, n_bytes long"), "manifest")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the manifest's files and return doc_id, shard, start (ids before it in all files), n_tokens, ids (u32 bytes).

    The number of files is bounded by the number of write tasks, so the running sum over them is one small window.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", "shard", "n_bytes", before.alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at, rows, held = row["before"], [], 0
                with fs.open_input_stream(row["file"]) as stream:
                    for payload in stream_payloads(stream):
                        doc, ids = parse_payload(payload)
                        rows.append({"doc_id": doc, "shard": row["shard"], "start": at, "n_tokens": len(ids), "ids": ids.tobytes()})
                        at += len(ids)
                        held += ids.nbytes
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return files.repartition("file").mapInArrow(read, "doc_id long, shard int, start long, n_tokens long, ids binary")


def token_records(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write and read back: see ``write_records`` and ``read_records``."""
    folder = folder or work_path(docs.sparkSession, "records")
    return read_records(write_records(docs, vocabulary, folder), folder)


def record_digest(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc-32 of the ids as little-endian 32-bit numbers."""
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
