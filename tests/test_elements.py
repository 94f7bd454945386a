"""Element rules on pages written for them."""

import pytest
from pyspark.sql import functions as F

from weftspark.operators import elements as el
from weftspark.operators import scopes
from weftspark.operators.graphs import reach
from weftspark.sources.html import elements

GOOD = """<html lang="en"><body><img alt=""><iframe title="map"></iframe><a href="/x"><img alt="home"></a><a href="/y"> go </a>
<form><button type="submit">send</button><label>name <input></label><label for="m">mail</label><input id="m" type="email" autocomplete="email"><input type="hidden"></form>
<dialog aria-label="ask"></dialog><div onclick="f()" role="button" tabindex="0">x</div><p tabindex="-1"></p></body></html>"""
BAD = {
    "html-lang-present": '<html lang=" "></html>',
    "images-have-alt": "<p>\n<img src='a.png'></p>",
    "iframes-have-title": "<iframe title=' '></iframe>",
    "no-positive-tabindex": "<p tabindex='3'></p>",
    "links-have-accessible-names": "<a href='/x'><img alt=''></a>",
    "icon-buttons-have-labels": "<button type='button'><svg></svg></button>",
    "no-nested-interactive-controls": "<a href='/x'>go <button type='button'>now</button></a>",
    "dialogs-have-accessible-names": "<div role='dialog'></div>",
    "interactive-elements-are-semantic": "<div onclick='f()'>x</div>",
    "form-buttons-have-explicit-type": "<form><button>send</button></form>",
    "forms-have-labels": "<label for='other'>x</label><input id='mine'>",
    "personal-data-autocomplete-present": "<label>mail <input type='email'></label>",
}


def test_each_rule_fails_on_its_page_and_passes_on_the_good_one(spark):
    names = sorted(BAD)
    pages = spark.createDataFrame([(0, GOOD), (1, ""), (2, None), *((10 + i, BAD[n]) for i, n in enumerate(names))], "page_id long, html string")
    rows = el.page_findings(elements(pages)).collect()
    assert len(rows) == (3 + len(BAD)) * len(el.rules())
    failed = {(r["page_id"], r["rule"]) for r in rows if r["status"] == "fail"}
    assert failed == {(10 + i, n) for i, n in enumerate(names)}
    assert {r["line"] for r in rows if r["rule"] == "images-have-alt" and r["status"] == "fail"} == {2}


def test_a_rule_of_ones_own_and_what_cannot_be_told(spark):
    pages = spark.createDataFrame([(1, "<video src='a'></video>"), (2, "<p></p>")], "page_id long, html string")
    own = el.ElementRule("video-has-captions", "accessibility", "warning", 1, el.tag_is("video"), F.lit(None).cast("boolean"))
    assert {(r["page_id"], r["status"]) for r in el.page_findings(elements(pages), [own]).collect()} == {(1, "advisory"), (2, "pass")}


def test_headings_and_references(spark):
    pages = spark.createDataFrame([(1, "<h1>a</h1>\n<h3>b</h3>\n<h1>c</h1><h2>d</h2>"), (2, "<p id='a'></p><i aria-labelledby='a  b'></i>")], "page_id long, html string")
    rows = elements(pages)
    assert {tuple(r) for r in el.heading_faults(rows).collect()} == {(1, 2, "skipped-level"), (1, 3, "second-h1")}
    assert [tuple(r) for r in el.broken_references(rows).collect()] == [(2, 1, "b")]


@pytest.mark.parametrize("hops", [None, 2])
def test_reach_of_a_chain_and_a_cycle(spark, hops):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 0), (50, 51)], "src long, dst long")
    got = {r["node"]: r["hops"] for r in reach(edges, spark.createDataFrame([(0,)], "node long"), hops).collect()}
    assert got == {i: i for i in range(10 if hops is None else hops + 1)}


# Scopes.


def plain_nearest(points, spans):
    """Each point's innermost span by trying every span."""
    out = []
    for key, at in points:
        around = sorted((b - a, s) for k, s, a, b in spans if k == key and at is not None and a <= at < b)
        ties = sum(size == around[0][0] for size, _ in around) if around else 0
        out.append((key, at, around[0][1] if around else None, "none" if not ties else "resolved" if ties == 1 else "ambiguous"))
    return out


def nested_spans(rng, low, high, depth=0):
    """Random spans that nest or stay apart, some of them twice and some that touch."""
    out, at = [], low
    while at < high and depth < 5:
        a = rng.randrange(at, high)
        b = rng.randrange(a, high + 1)
        out += [(a, b)] * (1 + (rng.random() < 0.1))
        if b > a:
            out += nested_spans(rng, a, b, depth + 1)
        at = max(b, a + 1)
    return out


def test_nearest_scopes_equal_every_span_tried(spark):
    import random

    rng = random.Random(7)
    spans = [(k, i, a, b) for k in range(12) for i, (a, b) in enumerate(nested_spans(rng, 0, 60))]
    spans = [(k, s, a, b) for k, s, a, b in spans if k != 3] + [(4, 999, None, 5)]
    points = [(k, at) for k in range(13) for at in (*range(0, 62), None)]
    got = scopes.nearest_scope(spark.createDataFrame(points, "k long, at long"), spark.createDataFrame(spans, "k long, scope long, start long, end long"), ["k"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_nearest(points, [s for s in spans if s[2] is not None])))


def test_around_and_inside_equal_the_tree(spark):
    import random

    rng, pages = random.Random(3), []
    for p in range(40):
        html, open_tags = "", []
        for _ in range(rng.randrange(60)):
            if open_tags and rng.random() < 0.45:
                html += f"</{open_tags.pop()}>"
            else:
                open_tags.append(rng.choice(("a", "nav", "div", "p")))
                html += f"<{open_tags[-1]}>é{rng.randrange(9)}"
        pages.append((p, html))
    rows = elements(spark.createDataFrame(pages, "page_id long, html string")).where("tag is not null")
    told = rows.withColumns({"in_nav": scopes.within(el.tag_is("nav")), "has_a": scopes.contains(el.tag_is("a"))})
    told = scopes.with_owner(told, el.tag_is("nav", "div")).collect()
    by = {}
    for r in told:
        by.setdefault(r.page_id, []).append(r)
    for page, own in by.items():
        html = dict(pages)[page]
        for x in own:
            above = [y for y in own if y.elem_id < x.elem_id <= y.last]
            assert all(y.start < x.start and x.end <= y.end for y in above) and x.depth == len(above) and html[x.start : x.start + 1 + len(x.tag)] == "<" + x.tag
            assert x.in_nav == any(y.tag == "nav" for y in above) and x.has_a == any(y.tag == "a" and x.elem_id < y.elem_id <= x.last for y in own)
            assert x.owner == max((y.elem_id for y in above if y.tag in ("nav", "div")), default=None)
            if x.tag in ("a", "nav"):
                import re

                assert x.text == re.sub("<[^>]*>", "", html[x.start : x.end])


def test_names_count_their_pairs(spark):
    rows = [(1, "a", 5), (1, "a", 3), (1, "a", 9), (1, "b", 1), (2, None, 4), (2, None, 2), (2, "a", 0)]
    got = scopes.equal_names(spark.createDataFrame(rows, "page_id long, name string, at long"), ["page_id"]).collect()
    assert {tuple(r) for r in got} == {(1, "a", 3, 3, 3, 5), (2, None, 2, 1, 2, 4)}


def test_owners_limit_headings_and_references(spark):
    html = "<h1>t</h1><article><h1 id='x'>a</h1><h2>b</h2><i aria-labelledby='x y'></i></article>\n<article><h3>c</h3><h5>d</h5><i aria-labelledby='x'></i><b id='z'></b><b id='z'></b><i aria-labelledby=' z '></i><i aria-labelledby=' '></i></article>"
    rows = elements(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert {tuple(r) for r in el.heading_faults(rows, el.tag_is("article")).collect()} == {(1, 2, "skipped-level")}
    assert sorted(tuple(r) for r in el.broken_references(rows, el.tag_is("article")).collect()) == [(1, 1, "y"), (1, 2, "x")]
    states = el.reference_state(rows, "aria-labelledby", el.tag_is("article"))
    assert [r.state for r in states.orderBy("elem_id").collect()] == ["missing", "missing", "ambiguous", "missing"]


def test_character_references_need_their_semicolon():
    from weftspark.sources.html import parse_elements

    html = "<article>a &ampLy &lt;b&gt; &amp;lt; &copy &copyx; &#x27;&#39 &</article><a href='?a=1&b=2&amp;c'>\n&amp</a>"
    rows = parse_elements(html)
    texts = [e["text"] if isinstance(e, dict) else e.text for e in rows]
    assert texts == ["a &ampLy <b> &lt; &copy &copyx; '&#39 &", "\n&amp"]
    last = rows[-1]
    attrs, start, end = (last["attrs"], last["start"], last["end"]) if isinstance(last, dict) else (last.attrs, last.start, last.end)
    assert attrs == {"href": "?a=1&b=2&c"} and html[start:end] == html[html.index("<a href") :]


def test_elements_are_made_once_for_each_result(spark):
    from weftspark.plans.trees import _made, _made_page, _made_sections

    sf = "/root/testdata/sf0.001"
    article = el.tag_is("article")
    sections = _made(spark, sf, _made_sections())
    results = [el.page_findings(_made(spark, sf, _made_page())), el.heading_faults(sections, article), el.reference_state(sections, "aria-describedby", article), el.broken_references(sections, article), scopes.with_owner(sections, article)]
    for rows in results:
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 1 and plan.count("repartition") <= 1 and plan.count("MapInArrow") + plan.count("MapInPandas") == 1
    assert all(r.rdd.getNumPartitions() > 1 for r in [sections])
