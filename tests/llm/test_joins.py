"""N-gram Jaccard join, connected components, decontamination."""

import numpy as np
import pyarrow as pa

from tests.llm import data
from weftspark.llm import parity_join
from weftspark.llm.components import connected_components
from weftspark.llm.decontaminate import ItemIndex, best_substring, drop_leaks, find_leaks, leaks_in
from weftspark.llm.parity_join import cell_tokens, differing_bits, link_components, parity_bits, prefix_length, short_sketch, size_bands, slack


def linked(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_components(frame).collect()}


def test_components_of_chains_and_cycles(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root if x in got} and set(range(61)) <= set(got)


def test_sketches_bound_the_difference_and_share_a_listed_cell():
    rng = np.random.default_rng(2)
    for n in (1, 3, 8, 40, 63, 64, 90, 200, 256, 300, 1200):
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop, add = rng.integers(0, n // 7 + 1, 2)
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            apart = len(a) + len(b) - 2 * both
            assert differing_bits(parity_bits(a), parity_bits(b)) <= apart
            assert sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(short_sketch(a), short_sketch(b))) <= apart
            if 100 * both >= 75 * (len(a) + len(b) - both):
                lists = [{(band, t) for band in size_bands(len(s)) for t in cell_tokens(s, band)[: prefix_length(len(s)) + slack(len(s))].tolist()} for s in (a, b)]
                assert len(lists[0] & lists[1]) > min(slack(len(a)), slack(len(b)))


def test_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "SMALL_GROUP", 4)
    monkeypatch.setattr(parity_join, "LEADERS", 3)
    rng = data.rng(3)
    line = " ".join(data.words(rng, 12))
    texts = [" ".join(data.words(rng, rng.randrange(1, 60))) + (" " + line if k % 2 else "") for k in range(40)]
    base = data.words(rng, 80)
    texts += [" ".join(data.edited(rng, base, rng.choice((0.02, 0.04, 0.07)))) for _ in range(30)] + [" ".join(base)] * 3 + [line, line.upper()]
    texts += [" ".join(data.edited(rng, data.words(rng, 6), 0)) + " " + line for _ in range(15)]
    want = data.components(dict(enumerate(texts)))
    assert linked(data.documents(spark, texts)) == want


def test_a_shared_passage_makes_no_pairs_of_its_texts(spark, monkeypatch):
    """Texts of one passage and private ends: pairs made grow in proportion to the texts, and the classes are right."""
    rng, made = data.rng(9), []
    led = parity_join._led_pairs

    def counted(*a):
        pairs, others = led(*a)
        made[-1] += pairs.count()
        return pairs, others

    monkeypatch.setattr(parity_join, "SMALL_GROUP", 4)
    monkeypatch.setattr(parity_join, "_led_pairs", counted)
    passage = data.words(rng, 60)
    for n in (40, 160):
        made.append(0)
        texts = [" ".join(passage + data.words(rng, 14 + k % 3, 10**6)) for k in range(n)]
        texts += [" ".join(passage + data.words(rng, 3, 10**6)) for _ in range(10)]
        assert linked(data.documents(spark, texts)) == data.components(dict(enumerate(texts)))
    assert made[1] <= 4 * made[0] + 160


def test_join_odd_rows(spark):
    rows = link_components(data.odd_documents(spark)).collect()
    assert len(rows) == 13
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    want = data.components({**dict(enumerate(data.odd_texts())), 100: None})
    assert {k: v for k, v in got.items() if k is not None} == want and got[None][1] is None
    assert link_components(data.documents(spark, [])).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_best_substring_is_exact():
    rng = data.rng(4)
    for _ in range(60):
        item, text = (bytes(rng.choices(b"abc", k=n)) for n in (rng.randrange(1, 9), rng.randrange(1, 14)))
        want = min(edit_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert best_substring(item, text)[0] == want


def test_leaks_are_found_with_edits_and_clean_texts_are_not(spark):
    rng = data.rng(5)
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(35))) for i in range(60)]
    texts, hit = [], 0
    for i, text in items:
        changed = list(text)
        for _ in range(int(len(text) * 0.05)):
            changed[rng.randrange(len(changed))] = rng.choice("abcdefg")
        texts.append(" ".join(word() for _ in range(50)) + "\n" + "".join(changed) + " " + word())
    clean = [" ".join(word() for _ in range(300)) for _ in range(60)]
    docs, bench = data.documents(spark, texts + clean + [None, ""]), spark.createDataFrame([*items, (99, None), (98, " ")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs, bench).collect()}
    hit = sum((i, i) in found for i in range(60))
    assert hit >= 57 and all(a == b for a, b in found)
    for (i, _), r in found.items():
        assert edit_distance(items[i][1].lower(), texts[i].encode()[r["start"] : r["end"]].decode().lower()) <= r["edits"] + 2
    kept = {r["doc_id"] for r in drop_leaks(docs, bench).collect()}
    assert kept == set(range(122)) - {i for i, _ in found} and drop_leaks(docs, bench).columns == docs.columns
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0
    assert leaks_in(ItemIndex(items), pa.array(["", "x"])) == []


def test_leaks_odd_rows(spark):
    bench = spark.createDataFrame([(1, "the same words again and again")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in find_leaks(data.odd_documents(spark), bench).collect()) == [5, 5, 6]


def test_runs_lose_no_place_within_the_allowed_edits():
    from weftspark.llm.decontaminate import GRAM, best_substring, may_hold

    rng = np.random.default_rng(5)
    for _ in range(300):
        item = bytes(rng.integers(97, 101, int(rng.integers(1, 60))).astype(np.uint8))
        text = bytearray(item)
        for _ in range(int(rng.integers(0, 8))):
            at = int(rng.integers(0, len(text) + 1))
            text[at : at + int(rng.integers(0, 2))] = bytes(rng.integers(97, 101, int(rng.integers(0, 2))).astype(np.uint8))
        text, grams = b"zz" + bytes(text) + b"z", [item[i : i + GRAM] for i in range(len(item) - GRAM + 1)]
        assert may_hold(grams, text, best_substring(item, text)[0])


def test_items_of_every_length_are_found_at_the_stated_recall():
    from weftspark.llm.decontaminate import CLASSES, EDITS, RECALL

    rng = data.rng(12)
    word = lambda: "".join(rng.choices(["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"], k=rng.randrange(1, 4)))
    other = lambda n: " ".join("".join(rng.choices("qvwxyz", k=rng.randrange(2, 8))) for _ in range(n))
    for length in (1, 3, 6, 7, 10, 13, 15, 20, 29, 30, 39, 40, 60, 79, 90, 149, 150, 230):
        items = []
        while len(items) < 120:
            text = " ".join(word() for _ in range(length))[:length]
            if text == text.strip():
                items.append(text)
        for share in (0.0, EDITS):
            texts = []
            for item in items:
                changed = list(item)
                for at in rng.sample(range(length), int(length * share)):
                    changed[at] = rng.choice("bcfgjklm")
                texts.append(f"{other(20)} {''.join(changed)} {other(20)}")
            found = {(r, i) for r, i, *_ in leaks_in(ItemIndex(list(enumerate(items))), pa.array(texts))}
            share_found = sum((i, i) in found for i in range(120)) / 120
            assert share_found == 1 if not share or length < CLASSES[0][0] else share_found >= RECALL, (length, share, share_found)


def test_items_without_spaces_and_repeated_characters_are_found():
    solid = "".join(data.rng(13).choices("abcdefghijklmnop", k=80))
    changed = "".join("Z" if i % 9 == 0 else c for i, c in enumerate(solid))
    got = leaks_in(ItemIndex([(1, solid), (2, "x" * 90)]), pa.array([f"a {solid} b", f"a {changed} b", "x" * 3000, "nothing at all"]))
    assert [(r, i, e) for r, i, e, *_ in got] == [(0, 1, 0), (1, 1, 9), (2, 2, 0)]


def test_texts_are_cut_into_cells_once(spark, monkeypatch):
    """The sizes of the cells' groups come from the same pass and shuffle as their rows."""
    texts, plain = {i: " ".join(f"w{(i % 40) * 50 + k}" for k in range(30)) for i in range(100)}, parity_join._first_tokens
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        def told():
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        yield from plain(told())

    monkeypatch.setattr(parity_join, "_first_tokens", counted)
    found = linked(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert found == {i: (26, i % 40) for i in texts}
    assert seen.value == len(texts)


def test_pairs_come_to_python_in_bounded_batches(spark, monkeypatch):
    """A batch holds both whole sets of each pair, outside the heap: at the session's 10,000 rows, 1,500 pairs came at once."""
    most, plain = spark.sparkContext.accumulator(0), parity_join._compare
    over = spark.sparkContext.accumulator(0)
    texts = [(i, " ".join(f"w{(i % 1500) * 50 + k + (i >= 1500) * (k == 0) * 1000000}" for k in range(30))) for i in range(3000)]

    def counted(batches):
        def told():
            for batch in batches:
                most.add(batch.num_rows)
                over.add(batch.num_rows > parity_join.BATCH_ROWS)
                yield batch

        yield from plain(told())

    monkeypatch.setattr(parity_join, "_compare", counted)
    monkeypatch.setattr(parity_join, "BATCH_ROWS", 50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = linked(spark.createDataFrame(texts, "doc_id long, text string"))
    assert found == {i: (26, i % 1500) for i, _ in texts}
    assert most.value >= 1500 and over.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_cells_are_not_shuffled_for_their_documents_classes(spark, monkeypatch):
    """Size and class of a document come to its cells by one join; then the cells' rows go to their groups, where they are paired."""
    frames, plain = [], parity_join.written

    def kept(df, name, *rest):
        frames.append((name, df))
        return plain(df, name, *rest)

    monkeypatch.setattr(parity_join, "written", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [(i, " ".join(f"w{(i % 20) * 50 + k + (i % 3) * (k == 0) * 1000}" for k in range(40))) for i in range(120)]
        found = linked(spark.createDataFrame(texts, "doc_id long, text string"))
        plans = [df._jdf.queryExecution().executedPlan().toString() for _, df in frames if any("/shared/" in f for f in df.inputFiles())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {i: (36, i % 20) for i, _ in texts}
    assert plans and not any("hashpartitioning(rep" in p for p in plans)
    pairs = [p for p in plans if "hashpartitioning(token" in p and "LeftAnti" in p]
    assert len(pairs) == 1 and "hashpartitioning(doc_id" in pairs[0]
