"""Sliding-window admission over a request log: two tumbling counters a rule, weighed by the time left of the earlier one."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.operators.folds import ordered_fold, ordered_fold_of_blocks


class LimitRule(NamedTuple):
    name: str
    scope: str
    limit: int
    window_ms: int


# The default rules of the two scopes.
DEFAULT_RULES = (LimitRule("client-burst", "client", 10, 600_000), LimitRule("client-day", "client", 20, 86_400_000), LimitRule("repository-day", "repository", 10, 86_400_000))


class Counters:
    """State of rules by identity: (window start, count, count of the window before)."""

    def __init__(self):
        self.held: dict[tuple[str, str], tuple[int, int, int]] = {}

    def used(self, rule: LimitRule, identity: str, now: int) -> tuple[int, int]:
        """Requests that count now, and the retry time if the rule denies."""
        start = now // rule.window_ms * rule.window_ms
        at, current, previous = self.held.get((rule.name, identity), (start, 0, 0))
        if at != start:
            current, previous = 0, current if at == start - rule.window_ms else 0
            self.held[rule.name, identity] = start, 0, previous
        else:
            self.held[rule.name, identity] = at, current, previous
        used = current + previous * (rule.window_ms - (now - start)) // rule.window_ms
        if used < rule.limit:
            return used, start + rule.window_ms
        if current < rule.limit and previous > 0:
            return used, start + rule.window_ms - -(-(rule.limit - current) * rule.window_ms // previous) + 1
        return used, start + 2 * rule.window_ms - -(-rule.limit * rule.window_ms // current) + 1

    def add(self, rule: LimitRule, identity: str) -> None:
        at, current, previous = self.held[rule.name, identity]
        self.held[rule.name, identity] = at, current + 1, previous


def admit(counters: Counters, rules: tuple[LimitRule, ...], now: int, identities: dict[str, str]) -> tuple[bool, str | None, int | None]:
    """One request: allowed only if all rules allow, and counted only then; else the denying rule that frees up last, and when."""
    told = [(r, *counters.used(r, identities[r.scope], now)) for r in rules]
    denied = [(free, r.name) for r, used, free in told if used >= r.limit]
    if denied:
        free, name = max(denied)
        return False, name, free
    for r, _, _ in told:
        counters.add(r, identities[r.scope])
    return True, None, None


def replay(requests: DataFrame, rules: tuple[LimitRule, ...], shard: str, few_shards: bool = False) -> DataFrame:
    """Decisions of ``requests(seq, ts_ms, client, repository, <shard>)`` in order of time within each shard.

    The shard must hold every request that shares an identity under these rules:
    the client for client rules alone, a connected component of clients and
    repositories where rules of both scopes must admit together. Requests are read in order and
    only the counters are held. ``few_shards`` says that a shard may hold most of the requests: they
    are then sorted by ranges on all cores, and a shard's task sorts packed blocks of them.
    """

    def step(counters: Counters, r: Any) -> tuple:
        return (r.seq, *admit(counters, rules, int(r.ts_ms), {"client": r.client, "repository": r.repository}))

    fold = ordered_fold_of_blocks if few_shards else ordered_fold
    return fold(requests, shard, ["ts_ms", "seq"], lambda _: Counters(), step, "seq long, allowed boolean, denied_by string, retry_at_ms long")


def retry_seconds(retry_at_ms: str, now_ms: str):
    return F.greatest(F.lit(1), F.least(F.lit(86_400), F.ceil((F.col(retry_at_ms) - F.col(now_ms)) / 1000)))
