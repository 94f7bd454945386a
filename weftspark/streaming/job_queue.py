"""A job queue as a state machine: publish, claim, cache, finish and fail, in batches or as a stream.

Events are ``(queue, seq, at_ms, job, kind, until_ms, retry)`` in the order of (at_ms, seq).

``publish``  a new job is queued; one that has expired, failed, or is completed without a live cached result starts anew with
             no attempts; any other stays as it is, so publishing twice is publishing once.
``cache``    the job's result is cached until ``until_ms``.
``claim``    the first line that holds: ``missing``; ``expired`` (the job fails); ``completed`` (a live cached result);
             ``failed``; ``lapsed`` (completed, the result is gone); ``busy`` (its own lease is live); ``exhausted`` (no attempt is
             left; the job fails); ``busy`` (as many other leases of the queue are live as it may have); else ``claimed``: one
             attempt more and a lease.
``finish``   completes the job if its cached result is live, else ``unavailable``.
``fail``     back to the queue if it may be tried again and has attempts left, else the job fails.

The leases of a queue are shared by its jobs, so the queue is the key of the state. Live leases are at most
the queue's cap; jobs are kept in a map that a stream reads one entry at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from weftspark.operators.folds import ordered_fold
from weftspark.streaming.admission import latest_by_key

DECISION = "queue string, seq long, job string, kind string, answer string, attempts int"
JOB = "state string, attempts int, lease_ms long, expires_ms long, cached_ms long"


class Policy(NamedTuple):
    attempts: int = 3
    leases: int = 2
    lease_ms: int = 300_000
    job_ms: int = 86_400_000
    #: How long a stream keeps a job that no event touches.
    keep_ms: int = 7 * 86_400_000


class Job(NamedTuple):
    state: str
    attempts: int
    lease_ms: int
    expires_ms: int
    cached_ms: int


def decide(jobs: MutableMapping[str, Job], leases: dict[str, int], policy: Policy, event: Any) -> tuple:
    """The answer to one event; jobs and leases (job to its end) are changed in place."""
    now, name = int(event.at_ms), event.job
    job = jobs.get(name)
    for other in [k for k, end in leases.items() if end <= now]:
        del leases[other]

    def put(**changes: Any) -> Job:
        jobs[name] = own = job._replace(**changes)
        if own.state != "running":
            leases.pop(name, None)
        return own

    live = job is not None and job.cached_ms > now
    if event.kind == "publish":
        if job is None:
            jobs[name] = job = Job("queued", 0, 0, now + policy.job_ms, 0)
        elif job.expires_ms <= now or job.state == "failed" or job.state == "completed" and not live:
            job = put(state="queued", attempts=0, lease_ms=0, expires_ms=now + policy.job_ms)
        answer = job.state
    elif job is None:
        answer = "missing"
    elif event.kind == "cache":
        job, answer = put(cached_ms=int(event.until_ms)), "cached"
    elif event.kind == "finish":
        job, answer = (put(state="completed", lease_ms=0), "completed") if live else (job, "unavailable")
    elif event.kind == "fail":
        job = put(state="queued" if event.retry and job.attempts < policy.attempts else "failed", lease_ms=0)
        answer = job.state
    elif event.kind == "claim":
        if job.expires_ms <= now:
            job, answer = put(state="failed", lease_ms=0), "expired"
        elif live:
            job, answer = put(state="completed", lease_ms=0), "completed"
        elif job.state in ("failed", "completed"):
            answer = "failed" if job.state == "failed" else "lapsed"
        elif job.state == "running" and job.lease_ms > now:
            answer = "busy"
        elif job.attempts >= policy.attempts:
            job, answer = put(state="failed", lease_ms=0), "exhausted"
        elif len(leases) >= policy.leases:
            answer = "busy"
        else:
            job, answer = put(state="running", attempts=job.attempts + 1, lease_ms=now + policy.lease_ms), "claimed"
            leases[name] = job.lease_ms
    else:
        answer = "unknown"
    return event.queue, int(event.seq), name, event.kind, answer, job.attempts if job else 0


def batch_decisions(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The answer to every event of a table."""
    return ordered_fold(events, "queue", ["at_ms", "seq"], lambda _: ({}, {}), lambda state, row: decide(*state, policy, row), DECISION)


class _Stored(MutableMapping):
    """Jobs in a stream's map state."""

    def __init__(self, state: Any):
        self.state = state

    def __getitem__(self, name: str) -> Job:
        if not self.state.containsKey((name,)):
            raise KeyError(name)
        return Job(*self.state.getValue((name,)))

    def __setitem__(self, name: str, job: Job) -> None:
        self.state.updateValue((name,), tuple(job))

    def __delitem__(self, name: str) -> None:
        self.state.removeKey((name,))

    def __iter__(self) -> Iterator[str]:
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


class QueueProcessor(StatefulProcessor):
    """A queue's jobs, each dropped after ``keep_ms`` without an event, and its live leases."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job string", JOB, ttlDurationMs=self.policy.keep_ms)
        self.leases = handle.getMapState("leases", "job string", "end_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        batch = pd.concat(list(rows)).sort_values(["at_ms", "seq"])
        leases = {k[0]: v[0] for k, v in self.leases.iterator()}
        known = set(leases)
        jobs = _Stored(self.jobs)
        out = [decide(jobs, leases, self.policy, row) for row in batch.itertuples(index=False)]
        for name in known - set(leases):
            self.leases.removeKey((name,))
        for name, end in leases.items():
            self.leases.updateValue((name,), (end,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])

    def close(self) -> None:
        return


def stream_decisions(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The answers to a stream of events, each micro-batch in its own order. The session needs Spark's RocksDB state store."""
    return events.groupBy("queue").transformWithStateInPandas(QueueProcessor(policy), StructType.fromDDL(DECISION), "Append", "ProcessingTime")


def ledger_sink(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str, version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges micro-batches into a stored table by key, once each.

    ``_batch``, the number of the batch that wrote a row last, is stored with the rows, so the write that
    merges a batch also records it: a batch that comes again, after its write, is left out.
    """

    def each(batch: DataFrame, number: int) -> None:
        held, fresh = read(), batch.withColumn("_batch", F.lit(number).cast("long"))
        if held is not None:
            last = held.agg(F.max("_batch")).first()[0]
            if last is not None and last >= number:
                return
            fresh = latest_by_key(held, fresh, key, version)
        write(fresh)

    return each
