"""The library's queries over the shared tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.operators import graphs, jobs, limiter, scoring, series
from weftspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

NOW = "1998-06-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    """The modules that register further queries."""
    import weftspark.plans.bands  # noqa: F401, PLC0415
    import weftspark.plans.more  # noqa: F401, PLC0415
    import weftspark.plans.trees  # noqa: F401, PLC0415
    import weftspark.plans.walks  # noqa: F401, PLC0415


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


# Page checks, scores and work.


def _text(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


_CHECKS_SQL = " UNION ALL ".join(
    f"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, '{c[0]}' AS id, '{c[1]}' AS category, '{c[2]}' AS severity, '{c[3]}' AS confidence, CAST({c[4]} AS DOUBLE) AS most, CAST({_text(c[5])} AS VARCHAR) AS work_group, ({c[6]}) AS passed FROM pages"
    for c in scoring.PAGE_CHECKS
)
_FINDINGS_SQL = f"""
checked AS ({_CHECKS_SQL}),
judged AS (SELECT *, CASE WHEN passed IS NULL THEN 'not-applicable' WHEN passed THEN 'pass' WHEN confidence = 'low' THEN 'advisory' ELSE 'fail' END AS status FROM checked),
findings AS (SELECT page_id, host, id, category, severity, confidence, work_group, status,
  most > 0 AND status NOT IN ('advisory', 'not-applicable') AS impacts_score,
  CASE WHEN status IN ('pass', 'advisory') THEN most ELSE 0.0 END AS score,
  CASE WHEN status = 'not-applicable' THEN 0.0 ELSE most END AS most FROM judged)"""
_WEIGHTS_SQL = "weights(category, weight) AS (VALUES " + ", ".join(f"('{c}', {w})" for c, w in scoring.CATEGORY_WEIGHTS.items()) + ")"


def _scores_sql(key: str) -> str:
    return f"""{_WEIGHTS_SQL},
sums AS (SELECT {key}, category, sum(score) AS raw, sum(most) AS raw_most FROM findings WHERE impacts_score GROUP BY ALL),
categories AS (SELECT k.{key}, w.category, w.weight, raw / nullif(raw_most, 0) AS ratio
  FROM (SELECT DISTINCT {key} FROM findings) k CROSS JOIN weights w LEFT JOIN sums s ON s.{key} = k.{key} AND s.category = w.category),
totals AS (SELECT {key}, CAST(floor(100 * sum(ratio * weight) / nullif(sum(CASE WHEN ratio IS NOT NULL THEN weight END), 0) + 0.5) AS BIGINT) AS score FROM categories GROUP BY {key}),
graded AS (SELECT *, CASE WHEN score IS NULL THEN NULL WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM totals)"""


_ACTIONABLES_SQL = """
actionables AS (SELECT *, CASE WHEN severity = 'error' AND status = 'fail' THEN 'P0' WHEN status = 'fail' AND confidence = 'high' THEN 'P1' ELSE 'P2' END AS priority,
  CASE WHEN status = 'advisory' THEN 'verify' ELSE 'fix' END AS disposition,
  CASE WHEN impacts_score THEN most - score ELSE 0.0 END AS impact
  FROM findings WHERE status IN ('fail', 'advisory'))"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.findings(scoring.page_results(table(spark, sf_dir, "pages")), scoring.catalog(spark))


def _scores(spark: SparkSession, sf_dir: str, key: str = "page_id") -> DataFrame:
    return scoring.total_scores(scoring.category_scores(_findings(spark, sf_dir), key), key)


@query(f"WITH {_FINDINGS_SQL}, {_scores_sql('page_id')} SELECT page_id, score, grade FROM graded")
def q01_page_audit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query(f"WITH {_FINDINGS_SQL}, {_scores_sql('page_id')} SELECT grade, count(*) AS pages FROM graded GROUP BY grade")
def q02_grade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("pages"))


@query(f"WITH {_FINDINGS_SQL}, {_scores_sql('page_id')} SELECT page_id, category, round(ratio, 6) AS ratio FROM categories")
def q03_category_scores_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.category_scores(_findings(spark, sf_dir), "page_id").select("page_id", "category", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {_FINDINGS_SQL}, {_ACTIONABLES_SQL} SELECT page_id, id, priority, disposition, impact, row_number() OVER (PARTITION BY page_id ORDER BY priority, impact DESC, id) AS place FROM actionables")
def q04_actionables_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("page_id").orderBy("priority", F.desc("impact"), "id")
    return scoring.actionables(_findings(spark, sf_dir)).select("page_id", "id", "priority", "disposition", "impact", F.row_number().over(by).cast("long").alias("place"))


@query(f"WITH {_FINDINGS_SQL}, {_ACTIONABLES_SQL} SELECT page_id, work_group, min(priority) AS priority, min(disposition) AS disposition, sum(impact) AS impact, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM actionables WHERE work_group IS NOT NULL GROUP BY page_id, work_group HAVING count(*) >= 2")
def q05_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.work_items(scoring.actionables(_findings(spark, sf_dir)))


@query(f"WITH {_FINDINGS_SQL}, {_ACTIONABLES_SQL}, ranked AS (SELECT host, page_id, id, impact, count(*) OVER (PARTITION BY host) AS n, row_number() OVER (PARTITION BY host ORDER BY impact DESC, page_id, id) AS place FROM actionables) SELECT host, page_id, id, impact FROM ranked WHERE n <= 50 OR place <= 20")
def q06_topk_if_over_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("host")
    ranked = scoring.actionables(_findings(spark, sf_dir)).withColumns({"n": F.count("*").over(by), "place": F.row_number().over(by.orderBy(F.desc("impact"), "page_id", "id"))})
    return ranked.where("n <= 50 or place <= 20").select("host", "page_id", "id", "impact")


@query(f"WITH {_FINDINGS_SQL}, {_ACTIONABLES_SQL} SELECT category, severity, count(*) AS n FROM actionables GROUP BY category, severity")
def q07_counts_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.actionables(_findings(spark, sf_dir)).groupBy("category", "severity").agg(F.count("*").alias("n"))


@query("SELECT page_id, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS t FROM pages) GROUP BY page_id")
def q08_evidence_distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tags, ",").alias("tags")).where("tags <> ''")


@query("SELECT doc_id, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS BIGINT) AS line FROM (SELECT doc_id, split_part(text, '@', 1) AS head FROM documents WHERE contains(text, '@'))")
def q09_first_match_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring_index("text", "@", 1)
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line"))


@query("SELECT source, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE regexp_matches(text, '[0-9]{4}') AND contains(text, 'the') AND regexp_matches(text, '[A-Z][a-z]+\\.') GROUP BY source")
def q10_all_patterns_same_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the")) & F.col("text").rlike("[0-9]{4}") & F.col("text").rlike(r"[A-Z][a-z]+\."))
    return found.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


# Daily series.

_DAILY_SQL = "daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily(table(spark, sf_dir, "events"))


@query(f"WITH {_DAILY_SQL} SELECT day, n, cents FROM daily")
def q11_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir)


_ERRORS_SQL = "errors AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), spine AS (SELECT CAST(unnest(generate_series(min(day), max(day) + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM errors), filled AS (SELECT s.day, coalesce(n, 0) AS n FROM spine s LEFT JOIN errors e ON e.day = s.day)"


@query(f"WITH {_ERRORS_SQL} SELECT day, n FROM filled WHERE day <= (SELECT max(day) FROM filled WHERE n > 0)")
def q12_trim_trailing_zero_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(series.day_of(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    return series.trim_trailing_zeros(series.with_spine(errors, "n", 3), "n")


@query("WITH ends AS (SELECT CAST(max(o_orderdate) AS DATE) AS last, greatest(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) - 540) AS first FROM orders) SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders, ends WHERE CAST(o_orderdate AS DATE) >= first GROUP BY 1")
def q13_clamp_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    first = days.agg(F.greatest(F.min("day"), F.date_sub(F.max("day"), 540)).alias("first"))
    return days.crossJoin(F.broadcast(first)).where("day >= first").select("day", "n")


@query("SELECT user_id, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 10")
def q14_top_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), "user_id").limit(10).crossJoin(F.broadcast(total))


@query("SELECT event_type, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type")
def q15_x_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT event_type, round(CASE WHEN lo >= 0 THEN 0.0 ELSE lo - pad END, 6) AS low, round(CASE WHEN lo < 0 THEN hi + pad WHEN hi <= 0 THEN 100.0 ELSE hi * 1.1 END, 6) AS high FROM (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) * 0.05 END AS pad FROM (SELECT event_type, min(value - 20) AS lo, max(value - 20) AS hi FROM events GROUP BY 1))")
def q16_y_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.y_domain(table(spark, sf_dir, "events").select("event_type", (F.col("value") - 20).alias("v")), "event_type", "v")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-08 12:00:00'")
def q17_time_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = "2024-01-08 12:00:00", "2024-01-05 00:00:00"
    return table(spark, sf_dir, "events").where(F.col("ts").between(F.lit(min(a, b)).cast("timestamp_ntz"), F.lit(max(a, b)).cast("timestamp_ntz"))).select("event_id", "ts")


@query("SELECT CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1")
def q18_ohlc_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.ohlc(table(spark, sf_dir, "events"))


@query("SELECT event_type, round(coalesce(regr_slope(CAST(n AS DOUBLE), CAST(day - DATE '2024-01-01' AS DOUBLE)), 0.0), 6) AS slope FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def q19_ols_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", series.day_of(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    return series.slope_per_day(days, "event_type", "n", "2024-01-01")


@query("SELECT day, event_type, n, CAST(coalesce(sum(n) OVER (PARTITION BY day ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def q20_stack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(series.day_of(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"))
    return series.stack_offsets(days, "day", "event_type", "n")


_PROBE_DAYS = "CAST(o_orderdate AS DATE)"


@query("""WITH probes AS (SELECT o_orderkey AS probe, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'),
points AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000),
days AS (SELECT d.day, max(p.day) AS back FROM (SELECT DISTINCT day FROM probes) d LEFT JOIN points p ON p.day <= d.day GROUP BY 1),
more AS (SELECT d.day, d.back, min(p.day) AS ahead FROM days d LEFT JOIN points p ON p.day >= d.day GROUP BY 1, 2)
SELECT probe, p.day, CASE WHEN ahead IS NULL THEN back WHEN back IS NULL THEN ahead WHEN p.day - back <= ahead - p.day THEN back ELSE ahead END AS nearest FROM probes p JOIN more m ON m.day = p.day""")
def q21_nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    probes = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("probe"), "day")
    points = orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select("day").distinct()
    return series.nearest_point(probes, points)


@query()
def q22_largest_triangle_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("value"))
    return series.decimate(hours, 60)


@query("WITH now AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS started, count(*) AS n FROM events GROUP BY 1, 2) SELECT a.user_id, a.started, a.n, coalesce(b.n, 0) AS before FROM now a LEFT JOIN now b ON b.user_id = a.user_id AND b.started = a.started - 86400")
def q23_tumbling_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.tumbling_counts(table(spark, sf_dir, "events"), 86_400)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), at.alias("ts_ms"), F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("repository"))


@query()
def q24_limiter_replay_single_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = limiter.LimitRule("client-day", "client", 2, 86_400_000)
    return limiter.replay(_requests(spark, sf_dir), (rule,), "client")


@query()
def q25_limiter_atomic_multi_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (limiter.LimitRule("client-day", "client", 2, 86_400_000), limiter.LimitRule("repository-day", "repository", 30, 86_400_000))
    # Clients and the five event types are one connected component here, so there is one shard.
    return limiter.replay(_requests(spark, sf_dir).withColumn("component", F.lit(0)), rules, "component", few_shards=True)


# Jobs, access and cache.


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("cache_key"), state.alias("state"),
        F.expr("cast(o_orderdate as timestamp) + interval 30 days").alias("expires"), F.expr("cast(o_orderdate as timestamp) + interval 10 days").alias("lease"),
        F.pmod(F.col("o_orderkey"), F.lit(4)).cast("int").alias("attempts"),
    )


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_returnflag = 'A'")
    return lines.groupBy(F.pmod(F.col("l_orderkey"), F.lit(1000)).alias("cache_key")).agg(F.expr("cast(max(l_shipdate) as timestamp) - interval 600 days").alias("cache_expires"))


_JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS cache_key, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS state,
  o_orderdate + INTERVAL 30 DAY AS expires, o_orderdate + INTERVAL 10 DAY AS lease, CAST(o_orderkey % 4 AS INTEGER) AS attempts FROM orders),
cache AS (SELECT l_orderkey % 1000 AS cache_key, max(l_shipdate) - INTERVAL 600 DAY AS cache_expires FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A' GROUP BY 1)"""
_AT = f"TIMESTAMP '{NOW}'"


@query(f"WITH {_JOBS_SQL} SELECT j.job_id, c_name AS token, CASE WHEN expires <= {_AT} THEN 'expired' WHEN cache_expires > {_AT} THEN 'completed' WHEN state = 'completed' THEN 'lapsed' ELSE state END AS shown_state FROM jobs j JOIN customer ON c_custkey = j.cache_key LEFT JOIN cache c ON c.cache_key = j.cache_key AND cache_expires > {_AT}")
def q26_job_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _jobs(spark, sf_dir)
    access = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("token"))
    tokens = own.select("job_id", F.col("cache_key").alias("owner")).join(access, "owner").select("job_id", "token")
    return jobs.read_model(own, tokens, _cache(spark, sf_dir), NOW)


@query(f"WITH {_JOBS_SQL} SELECT job_id FROM jobs j WHERE EXISTS (SELECT 1 FROM cache c WHERE c.cache_key = j.cache_key AND cache_expires > {_AT})")
def q27_semi_live_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _cache(spark, sf_dir).where(F.col("cache_expires") > F.lit(NOW).cast("timestamp"))
    return _jobs(spark, sf_dir).join(live, "cache_key", "left_semi").select("job_id")


@query(f"WITH {_JOBS_SQL} SELECT job_id FROM jobs j WHERE state = 'completed' AND NOT EXISTS (SELECT 1 FROM cache c WHERE c.cache_key = j.cache_key AND cache_expires > {_AT})")
def q28_anti_lapsed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _cache(spark, sf_dir).where(F.col("cache_expires") > F.lit(NOW).cast("timestamp"))
    return _jobs(spark, sf_dir).where("state = 'completed'").join(live, "cache_key", "left_anti").select("job_id")


@query(f"WITH {_JOBS_SQL} SELECT job_id, expires FROM jobs WHERE expires <= {_AT} ORDER BY expires, job_id LIMIT 250")
def q29_purge_oldest_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.oldest_expired(_jobs(spark, sf_dir), "expires", "job_id", NOW, 250).select("job_id", F.col("expires").cast("timestamp_ntz").alias("expires"))


_CLAIMS_SQL = f"""WITH {_JOBS_SQL}, told AS (SELECT j.*, cache_expires IS NOT NULL AS hit FROM jobs j LEFT JOIN cache c ON c.cache_key = j.cache_key AND cache_expires > {_AT}),
counted AS (SELECT *, (SELECT count(*) FROM told WHERE state = 'running' AND lease > {_AT}) - CASE WHEN state = 'running' AND lease > {_AT} THEN 1 ELSE 0 END AS others FROM told),
decided AS (SELECT *, CASE WHEN expires <= {_AT} THEN 'expired' WHEN hit THEN 'completed' WHEN state IN ('failed', 'completed') THEN 'terminal' WHEN state = 'running' AND lease > {_AT} THEN 'busy'
  WHEN attempts >= 3 THEN 'exhausted' WHEN others >= 1000000 THEN 'busy' ELSE 'claimed' END AS decision FROM counted)
SELECT job_id, decision, CASE WHEN decision = 'claimed' THEN attempts + 1 ELSE attempts END AS attempts_after FROM decided"""


@query(_CLAIMS_SQL)
def q30_claim_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _cache(spark, sf_dir).where(F.col("cache_expires") > F.lit(NOW).cast("timestamp")).select("cache_key", F.lit(True).alias("hit"))
    told = _jobs(spark, sf_dir).join(live, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return jobs.claims(told, 3, 1_000_000, NOW)


# Hashes, paths, budgets.


@query("SELECT c_custkey, sha256(concat_ws(chr(31), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment)) AS cache_key FROM customer")
def q31_cache_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat_ws("\x1f", "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment"), 256).alias("cache_key"))


@query("""WITH lines AS (SELECT source, doc_id, doc_id // 1000 AS part, lpad(CAST(doc_id AS VARCHAR), 12, '0') || ' ' || sha256(text) || ' ' || CAST(n_chars AS VARCHAR) || chr(10) AS line FROM documents),
parts AS (SELECT source, part, count(*) AS n, sha256(string_agg(line, '' ORDER BY doc_id)) AS digest FROM lines GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS entries, sha256(string_agg(digest, '' ORDER BY part)) AS digest FROM parts GROUP BY source""")
def q32_manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The digest of the digests of id ranges, in order: a source of any size is never one string.
    line = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(" "), F.sha2("text", 256), F.lit(" "), F.col("n_chars").cast("string"), F.lit("\n"))
    lines = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("part"), line.alias("line"))
    parts = lines.groupBy("source", "part").agg(F.count("*").alias("n"), F.sha2(F.expr("listagg(line, '') within group (order by line)"), 256).alias("digest"))
    return parts.groupBy("source").agg(F.sum("n").alias("entries"), F.sha2(F.expr("listagg(digest, '') within group (order by part)"), 256).alias("digest"))


_PATH_SQL = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT page_id, CASE WHEN ends_with(p, '.html') THEN 'content' WHEN ends_with(p, '/') THEN 'index' WHEN regexp_matches(p, '/[0-9]+$') THEN 'entry' ELSE 'other' END AS kind, regexp_matches(p, '(^|/)\\.\\.(/|$)') OR len(string_split(p, '/')) > 16 OR length(p) > 512 AS unsafe FROM (SELECT page_id, {_PATH_SQL} AS p FROM pages)")
def q33_path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    kind = F.when(p.endswith(".html"), "content").when(p.endswith("/"), "index").when(p.rlike("/[0-9]+$"), "entry").otherwise("other")
    unsafe = p.rlike(r"(^|/)\.\.(/|$)") | (F.size(F.split(p, "/")) > 16) | (F.length(p) > 512)
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), unsafe.alias("unsafe"))


_FULL_SQL = "regexp_extract(url, '://([^?#]*)', 1)"


@query(f"""WITH paths AS (SELECT DISTINCT {_FULL_SQL} AS path FROM pages), roots AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS root FROM pages WHERE page_id % 2 = 0 UNION SELECT DISTINCT regexp_extract(url, '://([^/?#]*/[a-z]+)/', 1) FROM pages WHERE page_id % 3 = 0),
hits AS (SELECT path, max(length(root)) AS n FROM paths JOIN roots ON starts_with(path, root || '/') GROUP BY path)
SELECT p.path, substr(p.path, 1, n) AS owner FROM paths p LEFT JOIN hits h ON h.path = p.path""")
def q34_owning_root_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    paths = pages.select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")).distinct()
    hosts = pages.where("page_id % 2 = 0").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("root"))
    folders = pages.where("page_id % 3 = 0").select(F.regexp_extract("url", "://([^/?#]*/[a-z]+)/", 1).alias("root"))
    return graphs.longest_prefix(paths, hosts.union(folders).distinct())


@query("""WITH RECURSIVE ranked AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
fold AS (SELECT source, doc_id, n_chars, place, n_chars <= 60000 AS kept, CASE WHEN n_chars <= 60000 THEN n_chars ELSE 0 END AS used FROM ranked WHERE place = 1
 UNION ALL SELECT r.source, r.doc_id, r.n_chars, r.place, f.used + r.n_chars <= 60000, f.used + CASE WHEN f.used + r.n_chars <= 60000 THEN r.n_chars ELSE 0 END FROM fold f JOIN ranked r ON r.source = f.source AND r.place = f.place + 1)
SELECT source, doc_id, kept FROM fold""")
def q35_greedy_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        used, kept = 0, []
        frame = frame.sort_values("doc_id")
        for n in frame["n_chars"]:
            kept.append(used + n <= 60_000)
            used += n * kept[-1]
        return frame.assign(kept=kept)[["source", "doc_id", "kept"]]

    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return rows.groupBy("source").applyInPandas(fold, "source string, doc_id long, kept boolean")


@query("SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) <= 60000 AS within FROM documents")
def q36_running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = series.running_total(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")
    return running.select("source", "doc_id", "running", (F.col("running") <= 60_000).alias("within"))


@query("SELECT p_type, p_partkey, dropped FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS place, greatest(count(*) OVER (PARTITION BY p_type) - 25, 0) AS dropped FROM part) WHERE place <= 25")
def q37_cap_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.capped(table(spark, sf_dir, "part").select("p_type", "p_partkey"), "p_type", "p_partkey", 25).select("p_type", "p_partkey", "dropped")


@query(f"WITH {_FINDINGS_SQL}, {_scores_sql('host')} SELECT host, score, grade FROM graded")
def q38_pool_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "host")


# Page elements.


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) = split_part(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/', 1) AS matches FROM pages")
def q39_html_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    return table(spark, sf_dir, "pages").select("page_id", lang.alias("lang"), (lang == F.split_part(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1), F.lit("/"), F.lit(1))).alias("matches"))


@query("SELECT page_id, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title_length, contains(html, '<meta name=\"description\"') AS described FROM pages")
def q40_title_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).cast("long").alias("title_length"), F.contains("html", F.lit('<meta name="description"')).alias("described"))


@query("SELECT page_id, count(*) AS links, count(*) FILTER (trim(t) = '') AS unnamed FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS t FROM pages) GROUP BY page_id")
def q41_link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("t"))
    return names.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.trim("t") == "").alias("unnamed"))


@query("SELECT l_orderkey, l_linenumber, level FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 6 + 1 AS level, lag(CAST(l_quantity AS BIGINT) % 6 + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS before FROM lineitem) WHERE level > before + 1")
def q42_heading_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("l_quantity").cast("long") % 6 + 1
    before = F.lag(level).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", level.alias("level"), before.alias("before")).where("level > before + 1").drop("before")


@query("SELECT a.l_orderkey, a.l_linenumber AS l_first, b.l_linenumber AS l_second FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_returnflag = b.l_returnflag AND a.l_shipdate < b.l_shipdate")
def q43_nav_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_returnflag") == F.col("b.l_returnflag")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.l_shipdate") < F.col("b.l_shipdate"))
    return a.join(b, same).select("a.l_orderkey", F.col("a.l_linenumber").alias("l_first"), F.col("b.l_linenumber").alias("l_second"))


# Every tag starts and ends one element here but p, b and br: these have no end tag on these pages, and none of the elements asked for is inside another.
_TAGS_SQL = "SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '<\\1></\\1>', 'gs'), '<!.*?>', '', 'gs') AS html FROM pages"


@query(f"SELECT page_id, len(regexp_extract_all(html, '<[a-z]')) AS elements, len(list_filter(regexp_extract_all(html, '<a [^>]*>[^<]*</?([a-z]+)', 1), lambda t: t <> 'a')) AS nested FROM ({_TAGS_SQL})")
def q44_nested_interactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.operators.elements import inside, tag_is
    from weftspark.sources.html import elements

    rows = elements(table(spark, sf_dir, "pages").select("page_id", "html")).where("tag is not null")
    nested = rows.withColumn("nested", tag_is("a", "button", "input", "select", "textarea") & inside("a", "button"))
    return nested.groupBy("page_id").agg(F.count("*").alias("elements"), F.count_if("nested").alias("nested"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'lorem ipsum') OR contains(text, 'Licensed under') OR contains(lower(text), 'todo')")
def q45_starter_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf_dir, "documents").where(F.contains(low, F.lit("lorem ipsum")) | F.contains("text", F.lit("Licensed under")) | F.contains(low, F.lit("todo"))).select("doc_id")


# Graphs.

_EDGES_SQL = "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 500 AS dst FROM lineitem WHERE l_linenumber = 1 AND l_suppkey <> l_partkey % 500), roots AS (SELECT DISTINCT s_suppkey AS node FROM supplier WHERE s_suppkey < 3)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return lines.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 500).alias("dst")).where("src <> dst").distinct()


def _reach_sql(hops: int) -> str:
    return f"WITH RECURSIVE {_EDGES_SQL}, steps(node, hops) AS (SELECT node, 0 FROM roots UNION SELECT e.dst, s.hops + 1 FROM steps s JOIN edges e ON e.src = s.node WHERE s.hops < {hops}) SELECT node, min(hops) AS hops FROM steps GROUP BY node"


@query(f"WITH RECURSIVE {_EDGES_SQL}, steps(node) AS (SELECT node FROM roots UNION SELECT e.dst FROM steps s JOIN edges e ON e.src = s.node) SELECT node FROM steps")
def q46_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.reach(_edges(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_suppkey < 3").select(F.col("s_suppkey").alias("node"))).select("node")


@query(_reach_sql(3))
def q47_bounded_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.reach(_edges(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_suppkey < 3").select(F.col("s_suppkey").alias("node")), 3)


_SUFFIXES = ("ring", "widget", "bolt", "gear", "plate")
_SUFFIX_SQL = "CASE " + " ".join(f"WHEN ends_with(p_name, '{s}') THEN {i}" for i, s in enumerate(_SUFFIXES)) + " END"


@query(f"SELECT stem, arg_min(p_partkey, (place, p_partkey)) AS p_partkey FROM (SELECT split_part(p_name, ' ', 1) || p_size AS stem, p_partkey, {_SUFFIX_SQL} AS place FROM part) WHERE place IS NOT NULL GROUP BY stem")
def q48_candidate_rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(_SUFFIXES))):
        place = F.when(F.col("p_name").endswith(s), i).otherwise(place)
    rows = table(spark, sf_dir, "part").select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_size").cast("string")).alias("stem"), "p_partkey", place.alias("place"))
    return rows.where("place is not null").groupBy("stem").agg(F.min_by("p_partkey", F.struct("place", "p_partkey")).alias("p_partkey"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, place FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 3")
def q51_top3_culprits(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), F.desc("l_quantity"), "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(by).cast("long").alias("place")).where("place <= 3")


@query("WITH sizes(viewport, width) AS (VALUES ('mobile', 390), ('desktop', 1440)), seen AS (SELECT n_regionkey, CASE n_nationkey % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS viewport, count(*) AS n FROM nation GROUP BY 1, 2) SELECT r_name, s.viewport, s.width, coalesce(n, 0) AS n, n IS NULL AS missing FROM region CROSS JOIN sizes s LEFT JOIN seen ON n_regionkey = r_regionkey AND seen.viewport = s.viewport")
def q52_matrix_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.createDataFrame([("mobile", 390), ("desktop", 1440)], "viewport string, width int")
    seen = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, "mobile").otherwise("desktop").alias("viewport")).agg(F.count("*").alias("n"))
    every = table(spark, sf_dir, "region").crossJoin(F.broadcast(sizes))
    return every.join(seen, ["r_regionkey", "viewport"], "left").select("r_name", "viewport", "width", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


_VERSIONS = ("0.1.0", "0.10.0", "0.9.3", "1.0.0-rc.1", "1.0.0", "1.2", "1.2.1", "0.1.0-rc.7")


@query("WITH v(version) AS (VALUES " + ", ".join(f"('{v}')" for v in _VERSIONS) + ") SELECT version, NOT contains(version, '-') AS released, row_number() OVER (ORDER BY list_transform(range(1, 7), lambda i: coalesce(TRY_CAST(nullif(split_part(replace(version, '-', '.'), '.', CAST(i AS INTEGER)), '') AS DOUBLE), 1e300)) DESC, version) AS place FROM v")
def q53_version_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(v,) for v in _VERSIONS], "version string")
    part = lambda i: F.coalesce(F.expr(f"try_cast(try_element_at(split(version, '[.-]'), {i}) as double)"), F.lit(1e300))
    keyed = rows.withColumn("key", F.array(*(part(i) for i in range(1, 7))))
    place = F.row_number().over(Window.orderBy(F.desc("key"), "version"))
    return keyed.select("version", (~F.contains("version", F.lit("-"))).alias("released"), place.cast("long").alias("place"))


@query("SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', ''), '([a-z])([A-Z])', '\\1-\\2', 'g')) AS kebab, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, len(string_split(p_name, ' ')) AS tokens FROM part")
def q54_kebab_and_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kebab = F.lower(F.regexp_replace(F.replace("p_name", F.lit(" "), F.lit("")), "([a-z])([A-Z])", "$1-$2"))
    slug = F.btrim(F.regexp_replace(F.lower(F.concat("p_brand", F.lit(" "), "p_name")), "[^a-z0-9]+", "-"), F.lit("-"))
    return table(spark, sf_dir, "part").select("p_partkey", kebab.alias("kebab"), slug.alias("slug"), F.size(F.split("p_name", " ")).cast("long").alias("tokens"))


@query("SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size, CASE WHEN count(*) > 10000 OR sum(n_chars) > 52428800 THEN 'rejected' WHEN count(*) > 40 OR sum(n_chars) > 120000 THEN 'queued' ELSE 'sync' END AS class FROM documents GROUP BY source")
def q55_workload_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"))
    kind = F.when((F.col("files") > 10_000) | (F.col("size") > 52_428_800), "rejected").when((F.col("files") > 40) | (F.col("size") > 120_000), "queued").otherwise("sync")
    return sums.withColumn("class", kind)


@query("SELECT user_id, k, event_id FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id, row_number() OVER (PARTITION BY user_id, CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1")
def q56_last_wins_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id", "ts")
    return rows.groupBy("user_id", "k").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
