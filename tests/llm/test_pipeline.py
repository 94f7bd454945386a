"""The pipeline's stages one by one, and as a whole, on a small folder of tables."""

import re

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import data


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, toxic, copied, leaking and personal documents, with odd rows and a clashing column."""
    rng, root = data.rng(31), str(tmp_path_factory.mktemp("tables"))
    prose = lambda n: " ".join(data.words(rng, n, 900))
    bad = ["vile", "filth", "hate", "scum"]
    texts = [prose(60) for _ in range(60)]
    texts += [prose(30) + " " + " ".join(rng.choices(bad, k=12)) + " " + prose(20) for _ in range(60)]
    copied = prose(80)
    texts += [copied, " ".join(data.edited(rng, copied.split(), 0.02)), copied.upper()]
    items = [(i, prose(25)) for i in range(4)]
    texts += [prose(30) + " " + items[2][1] + " " + prose(30)]
    texts += ["write to anna.lee@example.com or +49 170 1234567 please", None, ""]
    frame = data.documents(spark, texts).withColumn("_read", F.lit("kept"))
    frame.write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(60 <= i < 120)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, texts, items


def ids(frame):
    return {r["doc_id"] for r in frame.select("doc_id").collect()}


def test_stages_one_by_one(spark, folder):
    root, texts, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    every = set(range(len(texts)))
    stage = dict(pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, root)
    assert ids(clean) == every - set(range(60, 120)) and clean.columns == docs.columns
    joined = stage["n-gram Jaccard join"](spark, docs, root)
    groups = data.components(dict(enumerate(texts)))
    assert ids(joined) == {i for i, (_, c) in groups.items() if i == c} and joined.columns == docs.columns
    kept = stage["benchmark decontamination"](spark, docs, root)
    assert ids(kept) == {i for i, t in enumerate(texts) if not any(item in (t or "") for _, item in items)} and kept.columns == docs.columns
    masked = {r["doc_id"]: r for r in stage["PII"](spark, docs, root).collect()}
    for i, t in enumerate(texts):
        assert (masked[i]["text"] is None) == (t is None)
        if t is not None and not data.personal_spans(t):
            assert masked[i]["text"] == t
        if t is not None:
            assert not data.personal_spans(masked[i]["text"]) and masked[i]["n_chars"] == len(masked[i]["text"])
    assert re.fullmatch("write to <EMAIL> or <PHONE> please", masked[124]["text"])
    assert {r["lossless"] for r in stage["SentencePiece encoding and decoding"](spark, docs, root).collect()} == {True}
    assert stage["PII"](spark, docs.drop("n_chars"), root).columns == docs.drop("n_chars").columns


def test_the_whole(spark, folder):
    root, texts, _ = folder
    rows = pipeline.run(spark, root).collect()
    assert {r["doc_id"] for r in rows} == set(range(60)) | {120, 124, 125, 126} and all(r["lossless"] for r in rows)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.mode("overwrite").parquet(f"{root}_none/{name}.parquet")
    assert pipeline.run(spark, f"{root}_none").count() == 0
