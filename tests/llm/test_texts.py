"""Secrets, token records, pieces, media, urls, toxicity, personal data, scores."""

import hashlib
import math
import re
import time
import tracemalloc
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import data
from weftspark.llm import interpolation, secrets, webp
from weftspark.llm.decontaminate import drop_leaks
from weftspark.llm.interpolation import interpolated_scores, learn_weights
from weftspark.llm.media import media_columns, media_digest, payload_image
from weftspark.llm.personal_data import find_personal_data, personal_digest, redact
from weftspark.llm.piece_dropout import PieceCodec, occurrence_keys, encode_pieces, piece_digest
from weftspark.llm.registry import tokenizer
from weftspark.llm.secrets import RANKS, corpus_ranks, find_secrets, guess_segments, scan_secrets, secret_digest
from weftspark.llm.shared import work_path
from weftspark.llm.token_records import WordEncoder, frame, read_index, read_records, record_digest, unframe, write_records
from weftspark.llm.toxicity import chain_scores, drop_toxic, fit_chain, table_categories
from weftspark.llm.url_rules import judge_urls

BPE, PIECES = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# Secrets.


def test_guess_costs_order_values():
    cost = lambda v: guess_segments(v)[0]
    assert max(cost("password1"), cost("qwerty12345"), cost("aaaaaaaaaaaa"), cost("P@ssw0rd2019"), cost("2021-03-04"), cost("abcabcabcabc")) < 8 < cost("x7Kq9zL2mW")
    assert [k for k, *_ in guess_segments("password2019")[1]] == ["word", "date"]
    for v in ("x", "password", "11", "zq9!ab", "qwertyqwerty"):
        parts = guess_segments(v)[1]
        assert "".join(v[a:b] for _, a, b in parts) == v
    # No split of a value is cheaper than its segmentation: each further part costs ten times the guesses.
    for v in ("summer2019xq", "monkeymonkey1"):
        assert all(cost(v) <= cost(v[:i]) + cost(v[i:]) + 1 + 1e-9 for i in range(1, len(v)))


def test_guess_cost_is_the_least_of_all_segmentations():
    """Every split of short values, every kind that fits each part."""
    ranks = {"pass": 2, "word": 5, "sun": 9}

    def part_costs(v):
        out = [sum(math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33) for c in v)]
        plain = v.lower().translate(str.maketrans(secrets.LOOKALIKE))
        if len(v) > 1 and (v.lower() in ranks or plain in ranks):
            out.append(secrets._word_cost(v, ranks))
        if len(v) > 2 and all((a, b) in secrets._STEPS for a, b in zip(v.lower(), v.lower()[1:])):
            out.append(math.log10(47 * len(v)))
        out += [math.log10(130) for p in secrets._DATES[:1] if p.fullmatch(v)] + [math.log10(365 * 130) for p in secrets._DATES[1:] if p.fullmatch(v)]
        for unit in range(1, len(v) // 2 + 1):
            if len(v) % unit == 0 and v[:unit] * (len(v) // unit) == v and (unit > 1 or len(v) > 2):
                out.append(sum(math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33) for c in v[:unit]) + math.log10(len(v) // unit))
        return out

    def least(v):
        return min([min(part_costs(v))] + [least(v[:i]) + 1 + min(part_costs(v[i:])) for i in range(1, len(v))])

    rng = data.rng(21)
    for v in ["password", "p4ssword", "Sun2019x", "ababab1", "qwerty1", "aaaa1111", *("".join(rng.choices("abp1s9-", k=rng.randrange(1, 8))) for _ in range(60))]:
        assert guess_segments(v, ranks)[0] == pytest.approx(least(v)), v


def test_long_values_take_time_in_proportion():
    began = time.time()
    guess_segments("ab1" * 20_000)
    guess_segments("a" * 60_000)
    assert time.time() - began < 60


def test_secret_spans(spark):
    key = "AKIA" + "Q7" * 9
    text = f"é password=abc12345 x AKIA1 {key} 0123456789abcdef01234567 token: short pwd: x7Kq9zL2mW."
    spans = [(k, text[a:b]) for k, a, b, _ in find_secrets(text)]
    assert spans == [("assign", "password=abc12345"), ("access", key), ("hex", "0123456789abcdef01234567"), ("guess", "x7Kq9zL2mW")]
    assert find_secrets("my password is required and the token was changed", {"required": 700, "change": 90}) == []
    for v in ("qzxkvjwphtmrbn", "839201748362"):
        assert [text_[a:b] for text_ in [f"the password is {v}"] for _, a, b, _ in find_secrets(text_)] == [v]
    prose = [f"they ask for whatever is required here {i}" for i in range(200)]
    assert corpus_ranks(data.documents(spark, prose))["required"] <= len(RANKS) + 9
    rows = by_id(secret_digest(scan_secrets(data.documents(spark, [text, None, ""]))))
    base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in find_secrets(text) if k != "guess")
    assert rows[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and rows[0]["n_guess"] == 1
    assert rows[1]["spans"] == "" and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secret_digest(scan_secrets(data.odd_documents(spark))).count() == 13


# Token records.


def test_token_records_round_trip(spark):
    docs = data.documents(spark, [*data.odd_texts(), None, "plain words, don't it's  two  spaces \n\n x", "<|endoftext|> a<|endoftext|>"])
    folder = work_path(spark, "records")
    manifest = write_records(docs, BPE, folder)
    rows = by_id(record_digest(read_records(manifest, folder)))
    library, start = Tokenizer.from_file(BPE), 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        assert (rows[r["doc_id"]]["start"], rows[r["doc_id"]]["n_tokens"], rows[r["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for r in manifest.collect():
        raw, index = (open(r[c].removeprefix("file://"), "rb").read() for c in ("file", "index_file"))
        for entry in read_index(index):
            unframe(raw, int(entry["offset"]))
    with pytest.raises(ValueError):
        unframe(frame(b"abc")[:-1] + b"\0", 0)
    with pytest.raises(ValueError):
        unframe(frame(b"abc")[:9], 0)


def test_token_records_odd_rows(spark):
    folder = work_path(spark, "records")
    rows = read_records(write_records(data.odd_documents(spark), BPE, folder), folder).collect()
    assert len(rows) == 13 and sum(r["doc_id"] is None for r in rows) == 1 and min(rows, key=lambda r: r["start"])["doc_id"] is None
    assert read_records(write_records(data.documents(spark, []), BPE, folder), folder).count() == 0


# Pieces.


def test_pieces_equal_the_library_without_dropout_and_are_lossless_with_it():
    plain, dropped, other = PieceCodec(PIECES, dropout=0.0), PieceCodec(PIECES), PieceCodec(PIECES, seed=9)
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), data.rng(6)
    texts = [t[:3000] for t in data.odd_texts()] + ["".join(rng.choices(["a", " ", "the", "\n", "中", "▁", "\0", "ing "], k=12)) for _ in range(300)]
    for t in texts:
        if "▁" not in t:
            assert plain.encode(t).tolist() == library.encode(t)
        for codec in (plain, dropped, other):
            assert codec.decode(codec.encode(t, 1)) == t
    words = " ".join(data.words(rng, 50)) + " international representation understanding"
    assert dropped.encode(words).tolist() != other.encode(words).tolist() != plain.encode(words).tolist()
    assert dropped.encode(words).tolist() == PieceCodec(PIECES).encode(words).tolist()


def test_every_occurrence_is_segmented_by_its_own_draws():
    codec, rng = PieceCodec(PIECES), data.rng(8)
    text = " ".join(rng.choices(["international", "representation", "the", "étude", "a", "▁x", "中文", "y" * 50, "under-standing"], k=400))
    units = re.findall(r" +[^ \n]*|\n+|[^ \n]+", " " + text)
    for doc in (0, 7, -3):
        keys = occurrence_keys(codec.seed, doc, len(units)).tolist()
        assert codec.encode(text, doc).tobytes() == b"".join(codec._unit_ids(u, k) for u, k in zip(units, keys))
    own = {tuple(codec.segment(" international", k)) for k in occurrence_keys(codec.seed, 5, 300).tolist()}
    assert len(own) > 5
    assert codec.encode(text, 1).tolist() != codec.encode(text, 2).tolist() and codec.decode(codec.encode(text, 2)) == text


def test_what_is_remembered_of_pieces_is_small_and_goes_with_the_task(spark):
    codec, rng = PieceCodec(PIECES), data.rng(11)
    text = " ".join("".join(rng.choices("etaoinshr", k=8)) for _ in range(60_000))
    tracemalloc.start()
    codec.encode(text)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60_000 * 700, held

    def left(batches):
        from weftspark.llm.piece_dropout import codec

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(codec(PIECES).roots)])], ["n"])

    one = spark.createDataFrame([(1, "some words that are remembered")], "doc_id long, text string").coalesce(1)
    assert encode_pieces(one, PIECES).count() == 1 and encode_pieces(one, PIECES).select("decoded").collect()[0][0] == "some words that are remembered"
    assert spark.range(0, 64, 1, 16).mapInArrow(left, "n long").agg({"n": "max"}).first()[0] == 0


def test_workers_give_freed_memory_back_at_the_end_of_a_task(monkeypatch):
    from weftspark.llm import parity_join
    from weftspark.llm import text as texts

    given = []
    for module in (texts, parity_join):
        monkeypatch.setattr(module, "give_back", lambda: given.append(1))
    rows = pa.RecordBatch.from_pydict({"text": ["a b", None, "c"]})
    assert [c.num_rows for c in texts.text_chunks(iter([rows, rows]))] == [3, 3] and len(given) == 1
    assert list(parity_join._compare(iter([]))) == list(parity_join._near_enough(iter([]))) == [] and len(given) == 3


def test_pieces_odd_rows(spark):
    rows = piece_digest(encode_pieces(data.odd_documents(spark), PIECES)).collect()
    assert len(rows) == 13 and all(r["lossless"] for r in rows)


# Media.


def test_webp_decodes_every_feature():
    rng = np.random.default_rng(7)
    for h, w in ((1, 1), (9, 21), (20, 17)):
        for colours in (2, 4, 11, 50, 0):
            p = rng.integers(0, 256, (h, w, 4), dtype=np.uint8) if not colours else rng.integers(0, 256, (colours, 4), dtype=np.uint8)[rng.integers(0, colours, (h, w))]
            for steps in ((), (2,), (0,), (1,), (3,), (0, 1, 2), (2, 0), (3, 0)):
                if 3 in steps and not colours:
                    continue
                for bits in (0, 6):
                    for mode in range(14) if steps == (0,) and not bits else (11,):
                        assert (webp.decode(webp.encode(p, steps, bits, bool(bits), mode)) == p).all()
        for colours in (1, 2, 4, 16, 256):
            for q in (rng.integers(0, colours, h * w).astype(np.uint8) * np.uint8(7 if colours < 30 else 1), np.tile(np.arange(colours, dtype=np.uint8), h * w)[: h * w]):
                assert (webp.decode(webp.encode_samples(q, w))[..., 1].reshape(-1) == q).all()
    data_ = webp.encode_samples(rng.integers(0, 200, 576).astype(np.uint8), 576)
    for broken in (b"RIFF", data_[:40], data_[:-60]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(broken)


def test_webp_decodes_alike_side_by_side_and_symbol_by_symbol(monkeypatch):
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) + b" " for n in rng.integers(2, 9, 300)]
    cases = [rng.integers(0, 256, 576 * 140), np.full(576 * 40, 7), np.repeat([3, 9], 576 * 20), np.frombuffer(b"".join(words[i] for i in (rng.zipf(1.3, 40000) % 300))[: 576 * 200], np.uint8)]
    cases = [c.astype(np.uint8) for c in cases]
    files = [webp.encode_samples(c, 576) for c in cases]
    grey = np.zeros((20, 24, 4), np.uint8)
    grey[..., 1], grey[..., 3] = rng.integers(0, 256, (20, 24)) % 40, 9
    files.append(webp.encode(grey, (), 3, True))
    side_by_side = [webp.decode(f) for f in files]
    monkeypatch.setattr(webp, "_green_pixels", lambda *_: None)
    for a, f in zip(side_by_side, files):
        assert (a == webp.decode(f)).all()
    assert all((a[..., 1].reshape(-1) == c).all() for a, c in zip(side_by_side, cases)) and (side_by_side[-1] == grey).all()


def test_media_files_use_palette_cache_and_copies(monkeypatch):
    """What the decoder meets in a file of the query: the transform, the cache bits, and fewer symbols than samples."""
    text = np.frombuffer((b"some words and some more words, and again some words. " * 40)[:1728], np.uint8)
    met, read = [], webp._read_image
    monkeypatch.setattr(webp, "_read_image", lambda bits, w, h, main: (met.append((bits.peek(5) & 31, main)), read(bits, w, h, main))[1])
    media = payload_image(text)
    bits = webp.BitReader(media[20:])
    assert bits.read(8) == 0x2F and bits.read(32) >> 28 == 0 and bits.read(1) == 1 and bits.read(2) == webp.PALETTE
    assert webp.decode(media)[..., 1].tobytes() == text.tobytes()
    assert met[-1] == (1 | webp.CACHE_BITS << 1, True) and len(met) == 2
    assert len(webp._matches(text.astype(np.int64))[0]) > 5 and len(media) < len(text) // 4


def test_media_files_share_their_side_codes_and_need_no_search_in_the_cache(monkeypatch):
    """One code a file is fitted, and no place of the cache has several colours that are read from it."""
    made, fit = [], webp._code_lengths
    monkeypatch.setattr(webp, "_code_lengths", lambda counts, limit: (made.append(len(counts)), fit(counts, limit))[1])
    webp._fixed_codes(True), webp._fixed_codes(False)
    made.clear()
    rng = np.random.default_rng(3)
    for n in (576, 576 * 9):
        samples = rng.integers(0, 250, n).astype(np.uint8)
        file = webp.encode_samples(samples, 576)
        assert made == [280 + (1 << webp.CACHE_BITS), 19]
        made.clear()
        slots, found = webp._green_slots(0xFF000000, webp.CACHE_BITS), []
        monkeypatch.setattr(webp, "_green_pixels", lambda symbols, *rest, f=webp._green_pixels: (found.append(symbols), f(symbols, *rest))[1])
        assert (webp.decode(file)[..., 1].reshape(-1) == samples).all()
        read = {s - 280 for s in found[0].tolist() if s >= 280}
        assert read and all(sum(slots[v] == place for v in range(len(np.unique(samples)))) == 1 for place in read)


def test_media_payloads_round_trip(spark):
    rows = media_digest(media_columns(data.odd_documents(spark))).collect()
    texts = {**dict(enumerate(data.odd_texts())), 100: "", None: "no id at all here today"}
    assert len(rows) == 13
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])


# Urls.


def test_url_rules_and_aliases(spark):
    link = '<html><link href="{0}" rel="canonical"></html>'
    rows = [
        (0, "https://A.EXAMPLE.com/de/x#top", ""), (1, "http://b.example.net/en/1", ""), (2, "http://b.net/en/1?x=/de/", ""), (3, "http://q.org/fr/2", None),
        (4, "http://plain.test/a", link.format("http://x.net/bad")), (5, "http://other.test/b", '<meta http-equiv="refresh" content="0; url=http://plain.test/a">'),
        (6, "http://free.test/c", link.format("http://y.net/z")), (7, "http://y.net/z", link.format("http://good.org/fr/1")),
        (8, None, "<p>"), (9, "no scheme", link.format("/x")), (10, "http://alone.test", ""), (10, "http://alone.test", ""), (11, "http://plain.test/k/l", link.format("../m")),
    ]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == 13
    assert got[0] == ("a.example.com", "/de/x", "example.com/de/", "block") and got[1][2:] == ("example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4][2:] == (None, "block") and got[5][2:] == (None, "block")
    # The component of 6 and 7 holds an explicitly allowed url, which has precedence; 7's own rule still stands.
    assert got[6][2:] == (None, "allow") and got[7][2:] == ("net/", "block")
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[10][3] == "allow"
    for r in rows:
        if r[1] and "://" in r[1]:
            assert got[r[0]][:2] == (urlparse(r[1]).netloc.lower(), urlparse(r[1]).path)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(empty).count() == 0


# Toxicity.


def test_chain_finds_planted_words_on_held_out_rows(spark):
    rng = data.rng(8)
    bad, texts, labels = ["vile", "scumbag", "stinkface"], [], []
    for i in range(900):
        tokens, toxic = data.words(rng, rng.randrange(20, 60), 300), i % 6 == 0
        if toxic:
            tokens[rng.randrange(len(tokens))] = rng.choice(bad).capitalize() + rng.choice(("", "!", "s"))
        texts.append(" ".join(tokens))
        labels.append((i, int(i % 5 > 0), int(toxic)))
    docs, given = data.documents(spark, [*texts, None, ""]), spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    scores = by_id(chain_scores(docs, table_categories(given)))
    held_out = [(scores[i]["p_toxic"] >= 0.5, bool(labels[i][2])) for i in range(600, 900)]
    assert sum(a == b for a, b in held_out) >= 290 and not any(a and not b for a, b in held_out)
    kept = drop_toxic(docs, table_categories(given))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s["p_toxic"] < 0.5}
    assert scores[900]["p_toxic"] < 0.5


def test_later_models_learn_from_out_of_fold_predictions():
    rng = np.random.default_rng(9)
    y = (rng.random(400) < 0.5).astype(float)
    lists = [np.array([0]) if v else np.zeros(0, int) for v in y]
    models, folded = fit_chain(lists, 1, np.stack([y, y], 1), np.arange(400) % 5)
    assert ((folded[:, 0] > 0.5) == (y > 0)).all() and len(models[1]) == len(models[0]) + 1


def test_clashing_names_and_labels(spark):
    from pyspark.sql import functions as F

    docs = data.documents(spark, ["mail a@b.cd now", None, ""]).withColumns({n: F.lit(1) for n in ("_scored", "_read", "_spans", "_span_key")})
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert drop_toxic(docs, table_categories(labels)).columns == docs.columns
    assert drop_leaks(docs, spark.createDataFrame([(1, "no such text at all here")], "item_id long, text string")).count() == 3
    assert redact(docs).columns == docs.columns and redact(docs).where("text like '%<EMAIL>%'").count() == 1


def test_chain_without_labels(spark):
    given = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert drop_toxic(data.odd_documents(spark), table_categories(given)).count() == 13
    one = spark.createDataFrame([(3, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert drop_toxic(data.odd_documents(spark), table_categories(one)).count() == 13


# Personal data.


def test_personal_data_equals_plain_patterns(spark):
    rng = data.rng(10)
    atoms = ["a@b.co", "x", "1.2.3.4", "300.1.1.1", "4799134681044206", "4111 1111-1111 1111", "+1 (269) 555-5822", "+12", ".", "@", "é", " ", "_", "9", "-", "a.b@c-d.e_f@g.h", "+1+2 345 678 90"]
    texts = ["".join(rng.choices(atoms, k=rng.randrange(1, 12))) for _ in range(250)] + ["9" * 3000, "a" * 20_000 + "@", None, ""]
    got = by_id(personal_digest(find_personal_data(data.documents(spark, texts))))
    for i, t in enumerate(texts):
        base = data.personal_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in data.PERSONAL] == [sum(s[0] == k for s in base) for k in data.PERSONAL]


def test_bootstrap_finds_what_stands_where_seeds_stand(spark):
    texts = [f"reach the desk under customer contact number +1 (269) 555-58{i:02d} today or later" for i in range(20)]
    texts += [f"reach the desk under customer contact number 777-88{i:02d} today or later" for i in range(3)]
    texts += [f"there were {1000 + i} cars in the year {1990 + i} and so on" for i in range(20)] + [None]
    docs = data.documents(spark, texts)
    got = by_id(personal_digest(find_personal_data(docs)))
    assert all(got[20 + i]["n_context"] == 1 for i in range(3)) and all(got[23 + i]["spans"] == "" for i in range(20))
    masked = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert masked[0] == "reach the desk under customer contact number <PHONE> today or later"
    assert masked[20] == "reach the desk under customer contact number <CONTEXT> today or later" and masked[30] == texts[30] and masked[43] is None


def test_seeds_and_found_names_may_have_few_digits(spark):
    names = ["anna.lee", "bo", "carl", "dora.may", "eve"]
    texts = [f"please write to our clerk at {n}@example.com,{n}@mail.org today" for n in names]
    texts += ["please write to our clerk at clerk_anna7 today", "please write to our clerk at @annalee today", "there was a gate_b2 for us", None]
    got = by_id(personal_digest(find_personal_data(data.documents(spark, texts))))
    assert [got[i]["n_context"] for i in range(9)] == [0] * 5 + [1, 1, 0, 0] and all(got[i]["n_email"] == 2 for i in range(5))
    assert texts[5][slice(*map(int, got[5]["spans"].split(":")[1:]))] == "clerk_anna7"


def test_personal_data_odd_rows(spark):
    docs = data.odd_documents(spark)
    assert find_personal_data(docs).count() == 13
    kept = redact(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.select("text").collect())) == sorted(map(str, docs.select("text").collect()))
    assert find_personal_data(data.documents(spark, [])).count() == 0


# Scores.


def test_scores_equal_plain_counts(spark, tmp_path, monkeypatch):
    rng = data.rng(11)
    texts = [" ".join(rng.choices(["the", "of", "and", "Cat", "dog", "ran", "far"], k=rng.randrange(0, 40))) for _ in range(300)] + [None, "zebra unseen"]
    data.documents(spark, texts).repartition(3).write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(interpolation, "RANGE_BYTES", 1 << 10)
    rows = by_id(interpolated_scores(spark.read.parquet(str(tmp_path / "docs"))))
    tokens = {i: [*(t or "").lower().split(), None] for i, t in enumerate(texts)}
    rest = {i: zlib.crc32(str(i).encode()) % 7 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if rest[i] != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (rest[i] == 2, len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_weights_follow_the_deleted_counts():
    learned = learn_weights([(3, 5, 9, 1000), (4, 0, 9, 1000)], 100)
    assert learned[3][0] > 0.9 and learned[4][0] < 0.01
    assert all(sum(w) == pytest.approx(1) for w in learned.values())


def test_frames_of_no_files_score_as_files_do(spark, tmp_path):
    rng = data.rng(12)
    own = data.documents(spark, [" ".join(data.words(rng, 30, 40)) for _ in range(80)]).repartition(4)
    own.write.parquet(str(tmp_path / "docs"))
    key = lambda r: (r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6))
    assert sorted(map(key, interpolated_scores(own).collect())) == sorted(map(key, interpolated_scores(spark.read.parquet(str(tmp_path / "docs"))).collect()))


def test_scores_odd_rows(spark, tmp_path):
    data.odd_documents(spark).write.parquet(str(tmp_path / "odd"))
    rows = interpolated_scores(spark.read.parquet(str(tmp_path / "odd"))).collect()
    assert len(rows) == 13 and all(math.isfinite(r["score"]) for r in rows)
    data.documents(spark, []).write.parquet(str(tmp_path / "none"))
    assert interpolated_scores(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_patterns_are_the_contracts():
    assert [m[0] for m in re.finditer(data.PERSONAL["ip"], "1.2.3.4.5")] == ["1.2.3.4"]
    assert pa.array([""]).to_pylist() == [""]


def test_known_pieces_are_looked_up_once():
    """A text of remembered pieces takes one look-up a piece, and new ones are the only ones asked for again."""
    asked = []

    class Told(dict):
        def get(self, key):
            asked.append(("get", key))
            return super().get(key)

        def __getitem__(self, key):
            asked.append(("again", key))
            return super().__getitem__(key)

    encoder, texts = WordEncoder(BPE), ["one two, two't 3 'll x\n  y '' é", "", "two one"]
    encoder.known = Told()
    plain = [np.array(encoder.tokenizer.encode(t).ids, "<u2").tobytes() for t in texts]
    assert encoder.encode(texts) == plain
    asked.clear()
    assert encoder.encode([*texts, "two new"]) == [*plain, np.array(encoder.tokenizer.encode("two new").ids, "<u2").tobytes()]
    assert [k for kind, k in asked if kind == "again"] == [" new"] and [k for kind, k in asked if kind == "get"][-2:] == ["two", " new"]


def test_rare_colours_take_one_symbol(monkeypatch):
    """Only frequent colours get a second symbol, a place of the cache, so codes are shorter; zeros between lengths are the same runs."""
    made, put = [], webp._put_code
    monkeypatch.setattr(webp, "_put_code", lambda bits, lengths: (made.append(lengths), put(bits, lengths)))
    samples = np.random.default_rng(3).permutation(np.repeat(np.arange(40, dtype=np.uint8), [9] * 32 + [540] * 8))
    file = webp.encode_samples(samples, 576)
    assert (webp.decode(file)[..., 1].reshape(-1) == samples).all()
    green = [x for x in made if len(x) == 280 + (1 << webp.CACHE_BITS)][-1]
    read = {s - 280 for s, n in enumerate(green) if n and s >= 280}
    slots = webp._green_slots(0xFF000000, webp.CACHE_BITS)
    often = {int(slots[v]) for v in range(256) if (samples == v).sum() >= 16}
    assert read and read <= often
    for lengths in ([0] * 150 + [1, 1], [1, 0, 0, 1], [2, 2] + [0] * 139 + [1], [1] + [0] * 300 + [1, 0, 0]):
        bits = webp.BitWriter()
        put(bits, lengths)
        code = webp._read_code(webp.BitReader(bits.take() + bytes(8)), len(lengths))
        assert sorted({e >> 4 for e in code.table}) == [s for s, n in enumerate(lengths) if n]
