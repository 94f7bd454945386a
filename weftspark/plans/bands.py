"""Queries over class strings that the parts' columns make: the cascade of classes by screen bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import visibility as seen
from weftspark.operators import scopes
from weftspark.plans.registry import query
from weftspark.sources.html import elements
from weftspark.sources.tables import spread, table

_PLAIN = ("block", "hidden", "flex", "text-sm", "!hidden")
_VARIANTS = ("sm", "md", "lg", "max-md", "hover", "md:max-xl", "2xl")
_UTILITIES = ("hidden", "grid", "inline")
_LAST = ("lg:hidden", "max-lg:flex", "hidden", "")


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _classes_sql(k: str, size: str) -> str:
    return f"({_listed(_PLAIN)})[{size} % 5 + 1] || ' ' || ({_listed(_VARIANTS)})[{k} % 7 + 1] || ':' || ({_listed(_UTILITIES)})[{size} % 3 + 1] || '  ' || ({_listed(_LAST)})[{k} % 4 + 1]"


def _classes(k: Column, size: Column) -> Column:
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    return F.concat(pick(_PLAIN, size % 5), F.lit(" "), pick(_VARIANTS, k % 7), F.lit(":"), pick(_UTILITIES, size % 3), F.lit("  "), pick(_LAST, k % 4))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")


# A band's state is that of its token of the highest rank: with variants before without, then the later one.
_CASCADE_SQL = f"""display(utility, shown) AS (VALUES ('block', true), ('flex', true), ('grid', true), ('inline', true), ('hidden', false)), bands(band, name) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(seen.BANDS))}),
tokens AS (SELECT id, place, string_split(token, ':')[:-2] AS variants, ltrim(string_split(token, ':')[-1], '!') AS utility FROM (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS place FROM (SELECT id, list_filter(string_split(classes, ' '), lambda x: x <> '') AS t FROM strings))),
limited AS (SELECT id, place, o.band, len(variants) > 0 AS varied, shown FROM tokens JOIN display USING (utility), bands o
 WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(variants) AS v) WHERE v NOT IN (SELECT name FROM bands WHERE band > 0 UNION ALL SELECT 'max-' || name FROM bands WHERE band > 0))
 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(variants) AS v) JOIN bands l ON v IN (l.name, 'max-' || l.name) WHERE CASE WHEN starts_with(v, 'max-') THEN o.band >= l.band ELSE o.band < l.band END)),
states AS (SELECT s.id, b.band, coalesce(arg_max(NOT l.shown, (l.varied, l.place)), false) AS hidden FROM strings s CROSS JOIN bands b LEFT JOIN limited l ON l.id = s.id AND l.band = b.band GROUP BY s.id, b.band),
masks AS (SELECT id, CAST(sum(CASE WHEN hidden THEN 1 << band ELSE 0 END) AS INTEGER) AS hidden FROM states GROUP BY id)"""


@query(f"WITH strings AS (SELECT p_partkey AS id, {_classes_sql('p_partkey', 'p_size')} AS classes FROM part), {_CASCADE_SQL} SELECT id AS p_partkey, hidden, 6 - bit_count(hidden) AS bands_shown, hidden & 1 = 0 AND hidden & 32 > 0 AS small_only FROM masks")
def q49_visibility_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _parts(spark, sf_dir).select("p_partkey", seen.merged_visibility(F.array(seen.class_tokens(_classes(F.col("p_partkey"), F.col("p_size"))))).alias("v"))
    return told.select("p_partkey", F.col("v.hidden").alias("hidden"), (len(seen.BANDS) - F.bit_count("v.hidden")).alias("bands_shown"), seen.small_only(F.col("v")).alias("small_only"))


@query(f"""WITH strings AS (SELECT p_partkey * 4 AS id, {_classes_sql('p_partkey', 'p_size')} AS classes FROM part UNION ALL SELECT p_partkey * 4 + 1, {_classes_sql('(p_partkey + 1)', '(p_size + 2)')} FROM part
 UNION ALL SELECT p_partkey * 4 + 2, {_classes_sql('(p_partkey + 1)', '(p_size + 2)')} || ' ' || {_classes_sql('(p_partkey + 3)', '(p_size + 1)')} FROM part), {_CASCADE_SQL},
sides AS (SELECT p_partkey, a.hidden AS one, CASE WHEN p_size % 11 = 0 THEN 0 ELSE b.hidden & c.hidden END AS two, CASE WHEN p_size % 11 = 0 THEN 63 ELSE xor(b.hidden, c.hidden) END AS unsure FROM part JOIN masks a ON a.id = p_partkey * 4 JOIN masks b ON b.id = p_partkey * 4 + 1 JOIN masks c ON c.id = p_partkey * 4 + 2)
SELECT p_partkey, CAST(two AS INTEGER) AS hidden, CAST(unsure AS INTEGER) AS unknown, CASE WHEN 63 & ~(one | two | unsure) > 0 THEN true WHEN 63 & ~(one | two) = 0 THEN false END AS overlap FROM sides""")
def q50_overlap_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One element against one whose classes have a conditional part, or (a size of 11, 22, ...) more alternatives than can be told.
    k, size = F.col("p_partkey"), F.col("p_size")
    always, more = seen.class_tokens(_classes(k + 1, size + 2)), seen.class_tokens(_classes(k + 3, size + 1))
    nothing = F.expr("cast(array() as array<string>)")
    parts = F.when(size % 11 == 0, F.array_repeat(F.array(nothing, more), 6)).otherwise(F.array(F.array(always), F.array(nothing, more)))
    told = _parts(spark, sf_dir).select("p_partkey", seen.merged_visibility(F.array(seen.class_tokens(_classes(k, size)))).alias("one"), seen.merged_visibility(seen.class_alternatives(parts)).alias("two"))
    return told.select("p_partkey", F.col("two.hidden").alias("hidden"), F.col("two.unknown").alias("unknown"), seen.overlap(F.col("one"), F.col("two")).alias("overlap"))


@query(f"""WITH strings AS (SELECT p_partkey * 3 AS id, {_classes_sql('p_partkey', 'p_size')} AS classes FROM part UNION ALL SELECT p_partkey * 3 + 1, {_classes_sql('(p_partkey + 1)', '(p_size + 2)')} FROM part UNION ALL SELECT p_partkey * 3 + 2, {_classes_sql('(p_partkey + 2)', '(p_size + 1)')} FROM part), {_CASCADE_SQL}
SELECT p_partkey, tag, CAST(h AS INTEGER) AS hidden FROM part JOIN masks a ON a.id = p_partkey * 3 JOIN masks b ON b.id = p_partkey * 3 + 1 JOIN masks c ON c.id = p_partkey * 3 + 2, LATERAL (VALUES ('div', a.hidden), ('section', a.hidden | b.hidden), ('p', a.hidden | b.hidden | c.hidden), ('i', a.hidden)) t(tag, h)""")
def q96_visibility_of_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An element is hidden where it or anything around it is.
    k, size = F.col("p_partkey"), F.col("p_size")
    html = F.concat(F.lit("<div class='"), _classes(k, size), F.lit("'><section class='"), _classes(k + 1, size + 2), F.lit("'><p class='"), _classes(k + 2, size + 1), F.lit("'>x</p></section><i></i></div>"))
    rows = elements(_parts(spark, sf_dir).select(k.alias("page_id"), html.alias("html")))
    own = rows.withColumn("own", seen.tokens_hidden(seen.class_tokens(F.coalesce(F.element_at("attrs", F.lit("class")), F.lit("")))))
    return own.select(F.col("page_id").alias("p_partkey"), "tag", F.col("own").bitwiseOR(scopes.within_mask(F.col("own"), len(seen.BANDS))).alias("hidden"))
