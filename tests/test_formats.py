"""Formats, escapes, places and redirects by cases."""

import pytest
from pyspark.sql import functions as F

from weftspark.functions import texts, urls


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("n,shown", [(0, "0"), (999, "999"), (1000, "1K"), (1049, "1K"), (1050, "1.1K"), (1250, "1.3K"), (999_949, "999.9K"), (999_950, "1M"), (12_345_678, "12.3M"), (2_000_000_000, "2B"), (-1250, "-1.3K"), (999_950_000_000, "1T"), (5 * 10**15, "5000T"), (None, None)])
def test_compact_numbers(spark, n, shown):
    assert one(spark, n, "long", texts.compact_number) == shown


def test_escapes_and_places(spark):
    assert one(spark, "a<‮b\x85&😀é⁩>", "string", texts.boundary_escaped) == "a\\u003c\\u202eb\\u0085\\u0026😀é\\u2069\\u003e"
    assert one(spark, "plain é", "string", texts.boundary_escaped) == "plain é"
    assert one(spark, "aXaaXX", "string", lambda v: texts.offsets(v, "X")) == [1, 4, 5]
    assert one(spark, "", "string", lambda v: texts.offsets(v, "X")) == [] and one(spark, "aaaa", "string", lambda v: texts.offsets(v, "aa")) == [0, 2]
    many = "é." * 30_000
    assert one(spark, many, "string", lambda v: texts.offsets(v, ".")) == list(range(1, 60_000, 2))


CHAINS = [
    (["http://a.io/x", "https://a.io/y"], True), (["http://a.io/x", "https://www.a.io"], True), (["https://a.io", "http://a.io"], False), (["https://a.io", "https://www.a.io", "https://a.io"], False),
    (["http://a.io", "https://a.io", "https://www.a.io/z"], True), (["https://a.io", "https://a.io:443/q"], True), (["http://a.io:8080", "https://a.io:8080"], False), (["http://a.io:8080", "http://a.io:8080/b"], True),
    (["https://x.a.io", "https://www.x.a.io"], False), (["http://localhost", "http://www.localhost"], True), (["http://1.2.3.4", "http://www.1.2.3.4"], False), (["https://u@a.io", "https://a.io"], False), (["https://a.io", "ftp://a.io"], False),
    (["https://A.io", "HTTPS://www.a.IO/"], True), (["https://www.www.a.io", "https://www.a.io"], False), (["http://[::1]/", "https://[::1]/"], True), (["https://a.io"], True), (["nothing"], False),
]


def test_redirect_chains(spark):
    rows = spark.createDataFrame([(i, c[0], c[1:]) for i, (c, _) in enumerate(CHAINS)], "i int, asked string, hops array<string>")
    got = dict(rows.select("i", urls.canonical_redirects(F.col("asked"), F.col("hops"))).collect())
    assert got == {i: fits for i, (_, fits) in enumerate(CHAINS)}
