"""SimHash classes, aligned tokens and periodic runs against plain versions."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import data
from weftspark.llm import simhash_ring as ring
from weftspark.llm.alignment import aligned_digest, aligned_tokens, byte_letters
from weftspark.llm.periodic_runs import find_runs, kept_words, lag_matches, planted, run_digest, word_runs
from weftspark.llm.registry import tokenizer

BPE, PIECES = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


# Periodic runs.


def plain_runs(w):
    """Every run by comparing all places at all lags; the smallest period by trying each smaller one."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i:
                start, end = i, j + q
                if end - start >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(start, end - p)) for p in range(1, q)):
                    out.append((start, end - start, q))
            i = max(j, i) + 1
    return sorted(out)


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_all_places_compared():
    rng = data.rng(5)
    for trial in range(150):
        w = []
        while len(w) < rng.choice((10, 60, 150, 260)):
            unit = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.randrange(1, 14))]
            w += unit * rng.randrange(1, 12) + unit[: rng.randrange(len(unit) + 1)]
        assert word_runs(np.array(w)) == plain_runs(w), (trial, w)


def test_lag_counts_of_frequent_and_rare_words_together():
    rng = np.random.default_rng(3)
    for n, kinds in ((300, 3), (1000, 40), (700, 700)):
        ids = np.minimum(rng.geometric(3 / kinds, n), kinds)
        assert lag_matches(ids, n // 3)[1:].tolist() == [int((ids[:-q] == ids[q:]).sum()) for q in range(1, n // 3 + 1)]


def test_runs_of_long_texts_take_time_in_proportion():
    import time

    began = time.time()
    assert word_runs(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    ids = np.random.default_rng(1).integers(0, 2, 200_000)
    ids[50_000:150_000] = np.tile(ids[50_000:60_000], 10)
    assert (50_000 >= (r := max(word_runs(ids), key=lambda x: x[1]))[0]) and r[2] == 10_000 and r[1] >= 100_000
    assert time.time() - began < 60


def test_kept_words_leave_the_first_period():
    assert np.flatnonzero(kept_words(40, [(2, 30, 3), (20, 15, 5)])).tolist() == [0, 1, 2, 3, 4, 35, 36, 37, 38, 39]


def test_run_rows_with_odd_texts(spark):
    rng = data.rng(9)
    texts = [None, "", " \x0b\n", "a " * 23, "a " * 24, "é ß " * 40, " ".join(data.words(rng, 900, 30)), *(" ".join(data.words(rng, rng.randrange(1, 400), 60)) for _ in range(120))]
    docs = data.documents(spark, texts).union(data.documents(spark, texts[3:6])).union(data.documents(spark, ["b c " * 30]).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("runs", F.lit("clash"))
    rows = run_digest(find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"), "runs"))).collect()
    wanted = [plain_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted))
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in wanted)
    assert find_runs(docs.limit(0)).count() == 0


# SimHash.


def plain_print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def noisy_prints(rng, n, most=7):
    base = rng.getrandbits(64)
    return {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(most))) for _ in range(n)}


def test_each_linked_pair_shares_a_key_and_a_chain_of_every_depth():
    rng = data.rng(2)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 5)))
        fits = [s for s in range(5) if all(((a ^ b) & m).bit_count() <= k for k, m in enumerate(ring.chain_masks(s)))]
        assert fits
        for depth in (2, 3, 4):
            assert any((a ^ b) & m == 0 and s in fits for s, m in ring.key_masks(depth))


@pytest.mark.parametrize(("small", "tile", "bound"), [(48, 2048, 1 << 18), (3, 8, 1 << 18), (3, 8, 10), (1, 10**6, 10)])
def test_print_links_give_the_classes_of_all_pairs(spark, monkeypatch, small, tile, bound):
    monkeypatch.setattr(ring, "SMALL_GROUP", small)
    monkeypatch.setattr(ring, "TILE", tile)
    monkeypatch.setattr(ring, "DEPTHS", ((2, bound), (3, 200), (4, None)))
    rng = data.rng(small + tile)
    prints = set().union(*(noisy_prints(rng, n) for n in (1, 3, 20, 60, 90)), {0, 1, (1 << 64) - 1}, {rng.getrandbits(64) for _ in range(50)})
    frame = spark.createDataFrame([(ring.signed(p),) for p in prints], "print long")
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in ring.print_links(frame).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    held = {frozenset(p) for p in pairs}
    root = {}
    wanted = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in map(tuple, held):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in prints} == wanted


def test_forests_are_no_larger_than_their_members():
    rng = data.rng(8)
    prints = np.array(sorted(noisy_prints(rng, 3000, 4)), np.uint64)
    a, b = ring.tile_forest(prints, 0)
    assert len(a) < len(prints) and (np.bitwise_count(a ^ b) <= 4).all()


def test_simhash_rows_with_odd_texts(spark):
    rng = data.rng(4)
    base = data.words(rng, 300)
    texts = [*data.odd_texts(), *(" ".join(data.edited(rng, base, 0.01)) for _ in range(60)), *(" ".join(data.words(rng, rng.randrange(1, 80))) for _ in range(60)), None, "one two three", "ONE two\tthree"]
    docs = data.documents(spark, texts).union(data.documents(spark, texts[2:4], 1)).union(data.documents(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("print", F.lit("clash"))
    rows = ring.near_duplicates(docs).collect()
    source = docs.collect()
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter((r.doc_id, f"{plain_print(r.text):016x}") for r in source)
    own = {}
    for r in source:
        if r.doc_id is not None:
            own.setdefault(r.doc_id, set()).add(plain_print(r.text))
    wanted = classes(own, lambda x, y: any((p ^ q).bit_count() <= 4 for p in own[x] for q in own[y]))
    assert {(r.doc_id, r.component_id) for r in rows} == {*wanted.items(), (None, None)}
    assert len({v for v in wanted.values()}) < len(wanted)
    assert ring.near_duplicates(docs.limit(0)).count() == 0


# Alignment.


def plain_alignment(texts):
    bpe = Tokenizer.from_file(BPE)
    bpe.encode_special_tokens = True
    letters = byte_letters()
    vocab = {i: bytes(letters[c] for c in e) for e, i in bpe.get_vocab().items() if e != "<|endoftext|>"}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = []
    for text in texts:
        want = (" " + (text or "")).encode()
        a = [(i, vocab[i]) for i in bpe.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in (pieces.encode(text) if text else []) for p in [pieces.id_to_piece(i)]]
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        ends = lambda own: np.cumsum([len(x) for _, x in own]).tolist()
        ea, eb = ends(a), ends(b)
        cuts = sorted({*ea} & {*eb})
        groups, links, x, y = [], [], 0, 0
        for cut in cuts:
            u, v = ea.index(cut, x) + 1, eb.index(cut, y) + 1
            groups.append("|".join(",".join(str(i) for i, _ in own) for own in (a[x:u], b[y:v])))
            links.append((a[u - 1][0], b[v - 1][0]))
            x, y = u, v
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for *_, links, _ in found for p in links)
    best = {}
    for (_, j), c in count.items():
        best[j] = max(best.get(j, 0), c)
    return [(na, nb, g, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha) for na, nb, g, links, sha in found]


def aligned_documents(spark):
    rng = data.rng(6)
    texts = [*data.odd_texts(), None, "<|endoftext|> and <s> </s> <unk> <0x41>", "  two  spaces ", "ﬁ ½ é  x", "x\r\ny\tz", "日本語のテキスト und Straße naïve", *(" ".join(data.words(rng, rng.randrange(1, 60), 300)) for _ in range(40))]
    return texts, data.documents(spark, texts).union(data.documents(spark, texts[:3])).withColumn("pairs", F.lit("clash")).withColumn("row", F.lit(1))


@pytest.mark.parametrize("most", [1_000_000, 5, 0])
def test_alignment_equals_the_plain_version(spark, monkeypatch, most):
    from weftspark.llm import alignment

    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    texts, docs = aligned_documents(spark)
    rows = aligned_digest(docs, BPE, PIECES).collect()
    wanted = plain_alignment([*texts, *texts[:3]])
    ids = [*range(len(texts)), 0, 1, 2]
    assert Counter(map(tuple, rows)) == Counter((i, *w) for i, w in zip(ids, wanted))
    assert aligned_digest(docs.limit(0), BPE, PIECES).count() == 0


def test_groups_are_readable(spark):
    row = aligned_tokens(data.documents(spark, ["unbelievable tokens"]), BPE, PIECES).first()
    bpe, pieces = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sides = [[bpe.decode([int(i) for i in g.split("|")[0].split(",")]), "".join(pieces.id_to_piece(int(i)) for i in g.split("|")[1].split(","))] for g in row.groups.split(";")]
    assert all(x == y.replace("▁", " ") for x, y in sides) and len(sides) == row.n_groups


def test_new_words_are_encoded_in_runs_with_the_same_ids():
    import public_tokenizers

    from weftspark.llm.token_records import WordEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    words = [f" {a}{b}" for a in ("thly", "Ärm", "ouble", "x", "ÿøn") for b in ("shansh", "é", "Q", "ting")] * 40
    texts = ["".join(words) + " it's 12 %%% \n\n end", "", " a  b\tc ", "Ġ a", "漢字 kanji"]
    encode, asked = WordEncoder(path), []
    whole = encode._whole
    encode._whole = lambda pieces: (asked.extend(pieces), whole(pieces))[1]
    assert encode.encode(texts) == whole(texts)
    assert not any(p.startswith(" ") and p[1:].isalpha() and p.isascii() for p in asked)


def test_pieces_of_a_task_are_not_forgotten_and_merged_again(monkeypatch):
    """Eight hundred thousand remembered pieces stay (all were dropped at 600,000 before), and the ids are the library's."""
    from weftspark.llm.token_records import WordEncoder

    encode = WordEncoder(BPE)
    encode.known = {f" {i}": b"" for i in range(800_000)}
    texts = ["some words that nobody knows yet", "and others, 12 of them"]
    assert encode.encode(texts[:1])[0] and len(encode.known) > 800_000
    seen, plain = [], encode._pieces
    monkeypatch.setattr(encode, "_pieces", lambda new: seen.extend(new) or plain(new))
    encode.encode(texts[:1])
    assert not seen
    fresh = WordEncoder(BPE)
    whole = [np.array(fresh.tokenizer.encode(t, add_special_tokens=False).ids, fresh.dtype).tobytes() for t in texts]
    assert [fresh.encode([t])[0] for t in texts] == whole
