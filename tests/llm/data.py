"""Small documents with every odd case, and plain versions of the operators' contracts."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def odd_texts():
    long = " ".join(f"x{i % 977}" for i in range(30_000))
    return ["", " \n\t ", "one", "One  TWO\nthree", "ÄÖ ñ 中文 😀 ▁ a▁b", "the same words again and again", "the same words again and again", long, "a\x0bb\x0cc", "x" * 5000]


def odd_documents(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(odd_texts())]
    rows += [(100, None, None, None, None), (None, "no id at all here today", "en", "s", 1), (5, odd_texts()[5], "en", "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return frame.withColumns({"token": F.lit("clash"), "component": F.lit(7), "key": F.lit("k"), "spans": F.lit(1), "n": F.lit(None).cast("string")})


def components(texts):
    """Smallest id of each class by comparing every pair of shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, tokens, share):
    out = list(tokens)
    for _ in range(int(len(out) * share)):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_spans(text):
    out = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def rng(seed):
    return random.Random(seed)
