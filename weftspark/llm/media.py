"""Media columns: payloads stored as lossless WebP files in a binary column, read back as pixels and features.

Edge cases: a null or empty text is one block of padding; equal texts give equal
files; null and repeated doc_ids keep their rows; an empty table gives no rows;
extra columns are ignored. A payload beyond 16,384 rows of pixels gets wider
rows, whose last one is filled with 255 beyond the payload; one image holds 264 MB,
a longer text raises a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm import webp
from weftspark.llm.shared import written
from weftspark.llm.text import raw_bytes, text_chunks

#: Payloads are filled up with FILL to a positive multiple of BLOCK bytes: one row of pixels, a sample each.
BLOCK, FILL = 576, 255
#: Bytes of results that a task remembers for texts that come again.
REMEMBERED = 1 << 25


class Remembered:
    """The latest results by the digest of what they were made from, up to REMEMBERED bytes."""

    def __init__(self, make):
        self.make, self.known, self.held = make, {}, 0

    def get(self, data: bytes):
        key = hashlib.sha256(data).digest()
        if key not in self.known:
            if self.held > REMEMBERED:
                self.known, self.held = {}, 0
            self.known[key] = self.make(data)
            self.held += sum(len(x) for x in self.known[key])
        return self.known[key]


def payload_image(data: np.ndarray) -> bytes:
    """A payload (uint8, a multiple of BLOCK) as a WebP file."""
    rows = len(data) // BLOCK
    wide = -(-rows // webp.MAX_SIDE)
    if extra := -rows % wide:
        data = np.concatenate([data, np.full(extra * BLOCK, FILL, np.uint8)])
    return webp.encode_samples(data, BLOCK * wide)


def pixel_features(pixels: np.ndarray) -> str:
    """Size, mean and spread of the samples in thousandths, and an 8-bin brightness histogram."""
    counts = np.bincount(pixels[..., 1].reshape(-1), minlength=256)
    values, n = np.arange(256), pixels.shape[0] * pixels.shape[1]
    total, squares = int(counts @ values), int(counts @ (values * values))
    bins = counts.reshape(8, 32).sum(1).tolist()
    return f"{pixels.shape[1]}x{pixels.shape[0]};mean={total * 1000 // n};std={int(((squares * n - total * total) ** 0.5) * 1000 / n)};hist={','.join(map(str, bins))}"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media (a WebP file) of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        images = Remembered(lambda payload: (payload_image(np.frombuffer(payload, np.uint8)),))
        for part in text_chunks(batches):
            data, offsets = raw_bytes(part.column("text"))
            sizes, full, media = np.diff(offsets), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.full(max(1, -(-(b - a) // BLOCK)) * BLOCK, FILL, np.uint8)
                own[: b - a] = data[a:b]
                full.append(len(own))
                media.append(images.get(own.tobytes())[0])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(full, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Decode the files: doc_id, n_bytes, payload_bytes, payload (the decoded bytes), media_bytes, media_sha256, feature."""

    def read(data: bytes) -> tuple[bytes, str]:
        pixels = webp.decode(data)
        return pixels[..., 1].tobytes(), pixel_features(pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Remembered(read)
        for batch in batches:
            rows, held = [], 0
            for doc, n, full, data in zip(*(c.to_pylist() for c in batch.columns)):
                samples, feature = files.get(data)
                rows.append((doc, n, full, samples[:full], len(data), hashlib.sha256(data).hexdigest(), feature))
                held += full
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    own = media.select("doc_id", "n_bytes", "payload_bytes", "media")
    return own.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload binary, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as a media column in a table of the shared folder and read the table back."""
    return read_media(written(encode_media(docs), "media"))


def media_digest(read: DataFrame) -> DataFrame:
    """What identifies the payload and the file, without their bytes."""
    return read.select(
        "doc_id", "n_bytes", "payload_bytes",
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature",
    )
