"""Queries over the pages' element trees: scopes, owners, names, and rules on pages made from table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators import elements as rules
from weftspark.operators import scopes
from weftspark.plans.registry import query
from weftspark.sources.html import elements
from weftspark.sources.tables import spread, table


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(table(spark, sf_dir, "pages")).where("tag is not null")


def _positions_sql(name: str, marks: str) -> str:
    """A table (page_id, tag, k, at): where the k-th of each mark (tag, sign) stands, in code points."""
    return f"""{name} AS (SELECT page_id, tag, k, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(sign) AS BIGINT) AS place
 FROM (SELECT page_id, tag, sign, parts, unnest(range(1, len(parts))) AS k FROM (SELECT page_id, tag, sign, string_split(html, sign) AS parts FROM pages, (VALUES {marks}) m(tag, sign))))"""


_POINT_TAGS = ("a", "script", "style", "h1", "title")
_SCOPE_TAGS = ("html", "head", "body", "nav", "ul", "li", "article", "footer")
_POINTS_SQL = _positions_sql("points", ", ".join(f"('{t}', '<{t}{' ' if t == 'a' else ''}')" for t in _POINT_TAGS))
_SCOPES_SQL = f"""{_positions_sql("opened", ", ".join(f"('{t}', '<{t}{' ' if t == 'html' else '>'}')" for t in _SCOPE_TAGS))}, {_positions_sql("closed", ", ".join(f"('{t}', '</{t}>')" for t in _SCOPE_TAGS))},
scopes AS (SELECT o.page_id, o.tag, o.place AS first, coalesce(c.place + length(o.tag) + 3, length(html)) AS last FROM opened o JOIN pages g ON g.page_id = o.page_id LEFT JOIN closed c ON o.page_id = c.page_id AND o.tag = c.tag AND o.k = c.k)"""


@query(f"""WITH {_POINTS_SQL}, {_SCOPES_SQL}
SELECT p.page_id, p.tag, p.place, arg_max(s.tag, s.first) AS scope, count(s.tag) AS depth FROM points p LEFT JOIN scopes s ON s.page_id = p.page_id AND s.first <= p.place AND p.place < s.last GROUP BY p.page_id, p.tag, p.place""")
def q86_scope_of_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The innermost scope of each offset, and how many are open there: the deepest scope's own depth among the scopes.
    rows = _elements(spark, sf_dir)
    points = rows.where(rules.tag_is(*_POINT_TAGS)).select("page_id", "tag", F.col("start").cast("long").alias("at"))
    spans = rows.where(rules.tag_is(*_SCOPE_TAGS)).select("page_id", "tag", "start", "end", F.col("elem_id"))
    nested = scopes.nearest_scope(points, spans.select("page_id", F.struct("start", "tag").alias("scope"), "start", "end"), ["page_id"])
    open_at = F.sum("step").over(scopes.Window.partitionBy("page_id").orderBy("at", "order"))
    ends = spans.select("page_id", F.explode(F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(1).alias("order"), F.lit(1).alias("step")), F.struct(F.col("end").cast("long").alias("at"), F.lit(0).alias("order"), F.lit(-1).alias("step")))).alias("e")).select("page_id", "e.*", F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("scope"))
    told = nested.select("page_id", "at", F.lit(2).alias("order"), F.lit(0).alias("step"), "tag", F.col("scope.tag").alias("scope"))
    return ends.unionByName(told).withColumn("depth", open_at).where("order = 2").select("page_id", "tag", F.col("at").alias("place"), "scope", F.col("depth").cast("long").alias("depth"))


_LANDMARKS = ("nav", "article", "footer")
_PIECES_SQL = f"pieces AS (SELECT page_id, landmark, regexp_extract(html, '<' || landmark || '>(.*?)</' || landmark || '>', 1, 's') AS part FROM pages, (VALUES {', '.join(f'({t!r})' for t in _LANDMARKS)}) l(landmark))"


@query(f"""WITH {_PIECES_SQL}, signs(tag, sign) AS (VALUES ('a', '<a '), ('p', '<p>'), ('li', '<li>'), ('h1', '<h1>'), ('b', '<b>')),
held AS (SELECT page_id, landmark, tag, len(string_split(part, sign)) - 1 AS n FROM pieces, signs), every AS (SELECT page_id, tag, len(string_split(html, sign)) - 1 AS n FROM pages, signs)
SELECT page_id, landmark, tag, n FROM held WHERE n > 0
UNION ALL SELECT e.page_id, 'none', e.tag, e.n - coalesce(h.n, 0) FROM every e LEFT JOIN (SELECT page_id, tag, sum(n) AS n FROM held GROUP BY ALL) h ON h.page_id = e.page_id AND h.tag = e.tag WHERE e.n > coalesce(h.n, 0)""")
def q87_nearest_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each element's nearest landmark, by nested-set numbers.
    rows = _elements(spark, sf_dir)
    marks = rows.where(rules.tag_is(*_LANDMARKS)).select("page_id", F.struct("elem_id", "tag").alias("scope"), (F.col("elem_id") + 1).alias("start"), (F.col("last") + 1).alias("end"))
    asked = rows.where(rules.tag_is("a", "p", "li", "h1", "b")).select("page_id", "tag", F.col("elem_id").alias("at"))
    found = scopes.nearest_scope(asked, marks, ["page_id"])
    return found.groupBy("page_id", F.coalesce("scope.tag", F.lit("none")).alias("landmark"), "tag").agg(F.count("*").alias("n"))


_TEXT_SQL = "replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({}, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&')"


@query(f"WITH {_PIECES_SQL} SELECT page_id, landmark, length(t) AS size, md5(t) AS digest FROM (SELECT page_id, landmark, {_TEXT_SQL.format('part')} AS t FROM pieces WHERE part <> '')")
def q88_landmark_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A landmark's text is cut from the page's text by its place in the nested set.
    rows = _elements(spark, sf_dir).where(rules.tag_is(*_LANDMARKS) & (F.col("text") != ""))
    return rows.select("page_id", F.col("tag").alias("landmark"), F.length("text").cast("long").alias("size"), F.md5("text").alias("digest"))


@query(f"""WITH {_positions_sql("points", "('a', '<a ')")}, links AS (SELECT page_id, k, {_TEXT_SQL.format("t")} AS name FROM (SELECT page_id, unnest(names) AS t, unnest(range(1, len(names) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*>(.*?)</a>', 1) AS names FROM pages)))
SELECT l.page_id, name, count(*) AS members, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs, min(place) AS first, list_sort(list(place))[2] AS second FROM links l JOIN points p ON p.page_id = l.page_id AND p.k = l.k GROUP BY l.page_id, name HAVING count(*) > 1""")
def q89_equal_link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _elements(spark, sf_dir).where(rules.tag_is("a")).select("page_id", F.col("text").alias("name"), F.col("start").cast("long").alias("at"))
    return scopes.equal_names(links, ["page_id"])


# Component pages made from the parts' columns: every rule of the library meets elements that keep and that break it.


def _made_page() -> Column:
    k, size = F.col("p_partkey"), F.col("p_size")
    on = lambda test, text: F.when(test, text).otherwise("")
    pieces = (
        "<html", on(size % 5 == 0, ' lang="en"'), "><body>\n<img src='a.png'", on(size % 3 > 0, F.concat(F.lit(" alt='"), "p_name", F.lit("'"))), ">\n<a href='/p'>", on(size % 4 > 0, F.col("p_name")), "</a>\n",
        "<form><button", on(size % 2 == 0, " type='submit'"), ">", on(size % 7 > 0, "go"), "</button><label for='m", (size % 3).cast("string"), "'>", F.col("p_brand"), "</label><input id='m", (size % 2).cast("string"), "' type='email'",
        on(size % 6 < 3, " autocomplete='email'"), "></form>\n<iframe", on(k % 3 == 0, " title='map'"), "></iframe><div onclick='f()'", on(k % 4 == 0, F.concat(F.lit(" role='button' tabindex='"), (k % 3 - 1).cast("string"), F.lit("'"))), ">x</div>\n",
        "<dialog", on(k % 5 < 3, " aria-label='ask'"), "></dialog>", on(k % 6 == 0, "<a href='/q'>q<button type='button'>n</button></a>"), "</body></html>",
    )
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces))


def _made(spark: SparkSession, sf_dir: str, html: Column) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_brand"), "p_partkey")
    return elements(parts.select(F.col("p_partkey").alias("page_id"), html.alias("html")))


_RULE_TESTS = {
    "html-lang-present": ("p_size % 5 = 0", 1), "images-have-alt": ("p_size % 3 > 0", 2), "links-have-accessible-names": ("p_size % 4 > 0", 3), "form-buttons-have-explicit-type": ("p_size % 2 = 0", 4), "icon-buttons-have-labels": ("p_size % 7 > 0", 4),
    "forms-have-labels": ("p_size % 3 = p_size % 2", 4), "personal-data-autocomplete-present": ("p_size % 6 < 3", 4), "iframes-have-title": ("p_partkey % 3 = 0", 5), "interactive-elements-are-semantic": ("p_partkey % 4 = 0", 5),
    "no-positive-tabindex": ("p_partkey % 4 > 0 OR p_partkey % 3 < 2", 5), "dialogs-have-accessible-names": ("p_partkey % 5 < 3", 6), "no-nested-interactive-controls": ("p_partkey % 6 > 0", 6),
}


@query(" UNION ALL ".join(f"SELECT p_partkey AS page_id, '{rule}' AS rule, CASE WHEN {test} THEN 'pass' ELSE 'fail' END AS status, CASE WHEN NOT ({test}) THEN {line} END AS line FROM part" for rule, (test, line) in _RULE_TESTS.items()))
def q90_rules_on_made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.page_findings(_made(spark, sf_dir, _made_page())).select("page_id", "rule", "status", "line")


def _made_sections() -> Column:
    """Two articles with headings and ids, and a field in each that refers to some of them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    say = lambda column: column.cast("string")
    pieces = (
        "<h1>top</h1>\n<article><h", say(size % 3 + 1), ">a</h", say(size % 3 + 1), ">\n<h", say(k % 4 + 1), ">b</h", say(k % 4 + 1), "><p id='e", say(k % 2), "'></p>\n<input aria-describedby='e", say(size % 2), " e", say(k % 2), "'></article>",
        "<article>\n<p id='e0'></p><p id='e", say(k % 3), "'></p><input aria-describedby='e", say(size % 3), "'></article>",
    )
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces))


@query("""WITH h AS (SELECT p_partkey AS page_id, p_size % 3 + 1 AS one, p_partkey % 4 + 1 AS two FROM part)
SELECT page_id, 3 AS line, CASE WHEN one = 1 AND two = 1 THEN 'second-h1' ELSE 'skipped-level' END AS fault FROM h WHERE one = 1 AND two = 1 OR two > one + 1""")
def q91_headings_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An article's headings are judged apart from the page's.
    return rules.heading_faults(_made(spark, sf_dir, _made_sections()), rules.tag_is("article"))


@query("""SELECT p_partkey AS page_id, 4 AS line, CASE WHEN p_size % 2 = p_partkey % 2 THEN 'valid' ELSE 'missing' END AS state FROM part
UNION ALL SELECT p_partkey, 5, CASE WHEN p_size % 3 NOT IN (0, p_partkey % 3) THEN 'missing' WHEN p_size % 3 = 0 AND p_partkey % 3 = 0 THEN 'ambiguous' ELSE 'valid' END FROM part""")
def q92_references_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ids count within the nearest article only; one that stands twice there is ambiguous.
    return rules.reference_state(_made(spark, sf_dir, _made_sections()), "aria-describedby", rules.tag_is("article")).select("page_id", "line", "state")
