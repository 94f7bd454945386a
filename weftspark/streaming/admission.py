"""The limiter and the keyed stores as streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftspark.operators.limiter import Counters, LimitRule, admit


def stream_admission(requests: DataFrame, rules: tuple[LimitRule, ...]) -> DataFrame:
    """Decisions on a stream ``requests(seq, ts_ms, client, repository)`` under client rules; state is a client's counters."""

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counters = Counters()
        if state.exists:
            counters.held = {(name, key[0]): (at, n, before) for name, at, n, before in zip(*state.get)}
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "seq"])
        out = [(r.seq, admit(counters, rules, int(r.ts_ms), {"client": r.client, "repository": r.repository})[0]) for r in rows.itertuples(index=False)]
        held = [(name, *v) for (name, _), v in counters.held.items()]
        state.update(tuple(list(c) for c in zip(*held)))
        yield pd.DataFrame(out, columns=["seq", "allowed"])

    return requests.groupBy("client").applyInPandasWithState(run, "seq long, allowed boolean", "name array<string>, started array<long>, n array<long>, before array<long>", "append", GroupStateTimeout.NoTimeout)


def latest_by_key(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """A keyed upsert: of the stored and the new rows the latest version of each key."""
    both = old.unionByName(new)
    return both.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_place = 1").drop("_place")


def upsert_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str, version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a micro-batch into a stored table; running a batch twice changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        write(latest_by_key(read(), batch, key, version))

    return each
