"""Ranks of the corpus's words: no secret ranks itself, whatever the table's size."""

import time

from tests.llm import data
from weftspark.llm.secrets import LEAST_TEXTS, RANKS, corpus_ranks, find_secrets, guess_segments, scan_secrets, secret_digest

SECRET = "qzxkvjwphtmrbn"


def guessed(spark, texts):
    return {r["doc_id"]: r["spans"] for r in secret_digest(scan_secrets(data.documents(spark, texts))).collect()}


def test_a_secret_of_a_small_table_is_found_with_the_default_ranks(spark):
    rows = guessed(spark, [f"the password is {SECRET}", "nothing here", None])
    assert rows == {0: "guess:16:30", 1: "", 2: ""}


def test_a_secret_in_many_texts_is_found_and_common_words_are_not(spark):
    rng = data.rng(3)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(30_000)]
    common = [n for n in names[:40]]
    texts = [f"the password is {SECRET} and {' '.join(common)} {' '.join(rng.sample(names, 60))} {i}" for i in range(700)]
    texts += [f"your password is {common[5]} now, token={SECRET}x", *[f"a copy holds {SECRET} too"] * 400]
    ranks = corpus_ranks(data.documents(spark, texts))
    assert SECRET not in ranks and {*common} <= {*ranks}
    rows = guessed(spark, texts)
    assert all(rows[i] == f"guess:16:{16 + len(SECRET)}" for i in range(700))
    assert rows[700].startswith("assign:") and "guess" not in rows[700]


def test_copies_prove_one_text_only(spark):
    same, several = ["an unusualword here"] * 500, [f"the everydayword is here {i}" for i in range(500)]
    ranks = corpus_ranks(data.documents(spark, same + several))
    assert "unusualword" not in ranks and "everydayword" in ranks and LEAST_TEXTS > 1


def test_very_many_credentials_in_one_text_take_seconds():
    rng = data.rng(1)
    lines = [f"password is {''.join(rng.choice('abcdefghjkmnpqrstuvwxyz23456789') for _ in range(11))}" for _ in range(100_000)]
    text = "\n".join(f"{line}, token=ab{i:07d}x" for i, line in enumerate(lines))
    began = time.time()
    spans = find_secrets(text)
    assert time.time() - began < 120
    assert sum(k == "guess" for k, *_ in spans) > 99_000 and sum(k == "assign" for k, *_ in spans) == 100_000


def test_long_units_and_words():
    unit = "k7" * 3 + "".join(chr(97 + i % 26) for i in range(0, 90, 7))
    assert len(unit) < 24 and guess_segments(unit * 3)[0] < guess_segments(unit * 3 + "q" * 3 + unit)[0]
    long = "supercalifragilisticexpialidocious"
    assert guess_segments(long, {long: 7})[0] < 1 < 8 < guess_segments(long, RANKS)[0]
