"""Queries over graphs that the tables imply: guarded expansions and multi-hop resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators import expansion
from weftspark.plans.registry import query
from weftspark.sources.tables import table
from weftspark.streaming import job_queue

# Render edges between nations, one a supplier: every other one is guarded, some hide bands.
_RENDERS_SQL = """renders AS (SELECT s_suppkey AS edge, s_nationkey AS src, s_suppkey % 25 AS dst, CASE WHEN s_suppkey % 2 = 0 THEN 'g' || s_suppkey % 3 END AS guard, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'yes' ELSE 'no' END END AS branch,
 CAST(CASE WHEN s_suppkey % 5 = 0 THEN 7 WHEN s_suppkey % 7 = 0 THEN 48 ELSE 0 END AS INTEGER) AS hidden, CAST(CASE WHEN s_suppkey % 6 = 0 THEN 12 ELSE 0 END AS INTEGER) AS unknown FROM supplier)"""
_LIMITS = expansion.Limits(depth=4, guards=2, instances=60)
_EXPANDED_SQL = f"""{_RENDERS_SQL}, steps AS (
 SELECT n_nationkey AS root, CAST([] AS BIGINT[]) AS path, [n_nationkey] AS nodes, n_nationkey AS node, 0 AS depth, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS branches, 0 AS hidden, 0 AS unknown, false AS truncated, false AS back FROM nation
 UNION ALL SELECT s.root, list_append(s.path, e.edge), list_append(s.nodes, e.dst), e.dst, s.depth + 1,
  CASE WHEN e.guard IS NOT NULL AND NOT list_contains(s.ids, e.guard) AND len(s.ids) < {_LIMITS.guards} THEN list_append(s.ids, e.guard) ELSE s.ids END,
  CASE WHEN e.guard IS NOT NULL AND NOT list_contains(s.ids, e.guard) AND len(s.ids) < {_LIMITS.guards} THEN list_append(s.branches, e.branch) ELSE s.branches END,
  s.hidden | e.hidden, s.unknown | e.unknown, s.truncated OR e.guard IS NOT NULL AND NOT list_contains(s.ids, e.guard) AND len(s.ids) >= {_LIMITS.guards}, list_contains(s.nodes, e.dst)
 FROM steps s JOIN renders e ON e.src = s.node WHERE NOT s.back AND s.depth < {_LIMITS.depth} AND coalesce(s.branches[list_position(s.ids, e.guard)] = e.branch, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM steps WHERE depth > 0), kept AS (SELECT * FROM ranked WHERE place <= {_LIMITS.instances})"""


def _renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    guarded = k % 2 == 0
    return table(spark, sf_dir, "supplier").select(
        k.alias("edge"), F.col("s_nationkey").alias("src"), (k % 25).alias("dst"),
        F.when(guarded, F.concat(F.lit("g"), (k % 3).cast("string"))).alias("guard"), F.when(guarded, F.when(k % 4 == 0, "yes").otherwise("no")).alias("branch"),
        F.when(k % 5 == 0, 7).when(k % 7 == 0, 48).otherwise(0).alias("hidden"), F.when(k % 6 == 0, 12).otherwise(0).alias("unknown"),
    )


def _expanded(spark: SparkSession, sf_dir: str) -> expansion.Expansion:
    roots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("root"), F.col("n_nationkey").alias("node"))
    return expansion.expand_paths(_renders(spark, sf_dir), roots, _LIMITS)


@query(f"""WITH RECURSIVE {_EXPANDED_SQL} SELECT root, array_to_string(path, '>') AS path, node, depth, array_to_string(list_transform(list_zip(ids, branches), lambda g: g[1] || '=' || g[2]), ',') AS guards, hidden, unknown & ~hidden AS unknown, truncated FROM kept""")
def q93_guarded_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    guards = F.array_join(F.transform("guards", lambda g: F.concat_ws("=", g["guard"], g["branch"])), ",")
    found = _expanded(spark, sf_dir).instances
    return found.select("root", F.array_join(F.transform("path", lambda e: e.cast("string")), ">").alias("path"), "node", "depth", guards.alias("guards"), "hidden", "unknown", "truncated")


@query(f"""WITH RECURSIVE {_EXPANDED_SQL}, reasons AS (SELECT root, 'cycle' AS reason FROM kept WHERE back UNION SELECT root, 'guards' FROM kept WHERE truncated UNION SELECT root, 'instances' FROM ranked WHERE place > {_LIMITS.instances}
 UNION SELECT k.root, 'depth' FROM kept k JOIN renders e ON e.src = k.node WHERE k.depth = {_LIMITS.depth} AND NOT back AND coalesce(k.branches[list_position(k.ids, e.guard)] = e.branch, true))
SELECT n_nationkey AS root, count(reason) = 0 AS complete, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons FROM nation LEFT JOIN reasons ON root = n_nationkey GROUP BY n_nationkey""")
def q94_expansion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir).roots.select("root", "complete", F.array_join("reasons", ",").alias("reasons"))


# Names that parts export again from other parts: a named one for most, star ones for some, declarations among them.
_HOPS = 5
_ALIASES_SQL = f"""sized AS (SELECT *, (SELECT count(*) FROM part) AS n FROM part),
given AS (SELECT p_partkey AS src, (p_partkey * 3 + p_size) % n + 1 AS dst, false AS star FROM sized WHERE p_size % 4 < 3 UNION ALL SELECT p_partkey, p_partkey % n + 1, false FROM sized WHERE p_size % 9 = 0
 UNION ALL SELECT p_partkey, (p_partkey + p_size) % n + 1, true FROM sized UNION ALL SELECT p_partkey, (p_partkey * 5) % n + 1, true FROM sized WHERE p_size % 2 = 0),
ends AS (SELECT p_partkey AS node FROM part WHERE p_size % 10 = 7),
edges AS (SELECT DISTINCT src, dst FROM given g WHERE (NOT star OR NOT EXISTS (SELECT 1 FROM given o WHERE o.src = g.src AND NOT o.star)) AND src NOT IN (SELECT node FROM ends)),
walks AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS hops FROM part UNION SELECT w.start, e.dst, w.hops + 1 FROM walks w JOIN edges e ON e.src = w.node WHERE w.hops < {_HOPS})"""


@query(f"""WITH RECURSIVE {_ALIASES_SQL}, found AS (SELECT start, count(DISTINCT node) AS targets, min(node) AS target, min(hops) AS hops FROM walks WHERE node IN (SELECT node FROM ends) GROUP BY start),
more AS (SELECT DISTINCT start FROM walks WHERE hops = {_HOPS} AND node IN (SELECT src FROM edges)), back AS (SELECT DISTINCT node FROM walks WHERE start = node AND hops > 0),
cyclic AS (SELECT DISTINCT start FROM walks WHERE node IN (SELECT node FROM back) AND start IN (SELECT start FROM more))
SELECT p_partkey AS start, CASE WHEN targets = 1 THEN 'resolved' WHEN targets > 1 THEN 'ambiguous' WHEN p_partkey IN (SELECT start FROM cyclic) THEN 'cycle' WHEN p_partkey IN (SELECT start FROM more) THEN 'spent' ELSE 'missing' END AS state,
 CASE WHEN targets = 1 THEN target END AS target, CASE WHEN targets = 1 THEN hops END AS hops FROM part LEFT JOIN found ON start = p_partkey""")
def q95_resolved_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    k, size, n = F.col("p_partkey"), F.col("p_size"), F.lit(parts.count())
    kinds = (
        (size % 4 < 3, (k * 3 + size) % n + 1, False),
        (size % 9 == 0, k % n + 1, False),
        (F.lit(True), (k + size) % n + 1, True),
        (size % 2 == 0, (k * 5) % n + 1, True),
    )
    given = F.filter(F.array(*(F.when(test, F.struct(dst.cast("long").alias("dst"), F.lit(star).alias("star"))) for test, dst, star in kinds)), lambda x: x.isNotNull())
    aliases = parts.select(k.alias("src"), F.inline(given))
    return expansion.resolve(aliases, parts.where("p_size % 10 = 7").select(k.alias("node")), parts.select(k.alias("node")), _HOPS)


@query()
def q97_job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every event asks something of a job of its user's queue; answers depend on all that came before in the queue.
    k = F.col("event_id")
    kinds = ("publish", "claim", "claim", "cache", "fail", "finish", "claim", "publish", "fail", "finish")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 64).cast("string")).alias("queue"), k.alias("seq"), at.alias("at_ms"), F.concat(F.lit("j"), F.pmod(F.crc32(k.cast("string")), F.lit(9)).cast("string")).alias("job"),
        F.get(F.array(*map(F.lit, kinds)), (F.floor(k / 3) % len(kinds)).cast("int")).alias("kind"), (at + (k % 5) * 20_000_000).alias("until_ms"), (k % 4 > 0).alias("retry"),
    )
    return job_queue.batch_decisions(rows, job_queue.Policy(lease_ms=40_000_000, job_ms=400_000_000))
