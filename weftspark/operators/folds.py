"""Ordered folds: what each decision depends on is carried from row to row, not gathered.

Rows are dealt by key and sorted; a task reads them in Arrow batches and holds the
state of one key at a time. A key's rows are one task's work, since every decision
depends on the ones before. ``ordered_fold`` sorts them there too; where one key has most
rows, ``ordered_fold_of_blocks`` sorts on all cores, and that task orders packed blocks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable[[Any], Any], step: Callable[[Any, Any], tuple], schema: str) -> DataFrame:
    """``step(state, row)`` of every row in order, as rows of ``schema``; ``start(key)`` gives a key's first state, which steps change in place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in schema.split(",")]
        held, state = (), None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                now = getattr(row, key)
                if not held or held[0] != now:
                    held, state = (now,), start(now)
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _blocks(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, a_<order> and z_<order> (the first and the last place), data: rows in order, packed by some thousands of one key."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    ends = [f"{side}_{c}" for side in "az" for c in order]
    schema = ", ".join([f"`{key}` {types[key]}", *(f"`{c}` {types[c[2:]]}" for c in ends), "data binary"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            out = []
            for low, high in zip(cuts, cuts[1:]):
                part, sink = batch.slice(low, high - low), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                places = [part.column(part.schema.get_field_index(c))[i].as_py() for i in (0, part.num_rows - 1) for c in order]
                out.append([keys[low], *places, sink.getvalue().to_pybytes()])
            if out:
                fields = [batch.schema.field(key).with_name(key), *(batch.schema.field(c[2:]).with_name(c) for c in ends), pa.field("data", pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=pa.schema(fields))

    return rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(pack, schema)


def ordered_fold_of_blocks(rows: DataFrame, key: str, order: list[str], start: Callable[[Any], Any], step: Callable[[Any, Any], tuple], schema: str) -> DataFrame:
    """``ordered_fold`` for keys with very many rows: they are put in order by ranges and packed, so the task that folds a key sorts blocks and opens one at a time.

    Blocks come from sorted ranges, so none begins inside another: by first and last place they are in order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in schema.split(",")]
        held, state = (), None
        for frame in frames:
            for now, data in zip(frame[key], frame["data"]):
                if not held or held[0] != now:
                    held, state = (now,), start(now)
                yield pd.DataFrame([step(state, row) for row in pa.ipc.open_stream(data).read_pandas().itertuples(index=False)], columns=names)

    blocks = _blocks(rows, key, order)
    places = [F.col(f"{side}_{c}") for side in "az" for c in order]
    return blocks.repartition(key).sortWithinPartitions(key, *places).select(key, "data").mapInPandas(run, schema)
