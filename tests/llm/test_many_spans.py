"""Texts that hold very many spans of personal data, against the fixed patterns and a plain version of the candidates."""

import time

from tests.llm import data
from weftspark.llm.personal_data import _candidates, discovered, find_personal_data, redact


def test_very_many_addresses_in_one_text(spark):
    text = " ".join(f"mail user{i}@host{i % 97}.example.org or +49 30 {1000000 + i}," for i in range(20_000))
    docs = data.documents(spark, [text, "call +49 30 1234567"])
    began = time.time()
    rows = {r.doc_id: r.spans for r in find_personal_data(docs).collect()}
    assert time.time() - began < 120
    assert [tuple(s) for s in rows[0] if s.kind in ("email", "ip", "card", "phone")] == data.personal_spans(text)


def test_candidates_belong_to_the_word_in_which_they_begin(spark):
    texts = ["id a1 <x@y.org>,+49 30 123456 b22 10.0.0.1/10.0.0.2 c3", "+49 30 12 34 56 zz9", "n0 spans h3re", "(k@l.de)m4 tail9"]
    docs = data.documents(spark, texts)
    base, _ = discovered(docs)
    assert base.count() == len(texts)
    from pyspark.sql import functions as F

    from weftspark.llm import personal_data as own

    rows = own._with_spans(own._keyed(docs), "base", own._FIXED, own._NEEDS).withColumn("hits", F.regexp_extract_all("content", F.lit(own._MARKED_WORD), F.lit(0)))
    rows = rows.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("key"), "base", F.when(F.size("hits") > 0, F.split("content", own._MARKED_WORD, -1)).alias("gaps"), "hits")
    got = sorted((r.key, r.seed, r.instance) for r in _candidates(rows).collect())
    assert [g for g in got if g[1]] == sorted((i, True, t[a:b].lower()) for i, t in enumerate(texts) for k, a, b in data.personal_spans(t))
    plain = {(k, i) for k, seed, i in got if not seed}
    assert all(any(c.isdigit() for c in i) for _, i in plain) and not any("@" in i or "10.0" in i for _, i in plain)


def test_masks_of_very_many_spans(spark):
    text = " ".join(f"u{i}@h.org" for i in range(20_000))
    row = redact(data.documents(spark, [text])).first()
    assert row.text == " ".join(["<EMAIL>"] * 20_000)
