"""Toxicity by a classifier chain: categories in order, each linear model fed with the earlier categories' probabilities.

The labels give two categories, junk (low quality) and toxic, in this order; the
chain takes any label columns. Each category has a logistic model over hashed
word features and the earlier categories' probabilities. While training, these
probabilities are out-of-fold predictions, so a later model sees them as noisy as
they are on new documents; for scoring each model is fitted on all training rows.

Training takes a bounded sample of labelled rows (TRAIN_ROWS, by a hash of the
id; a documented bound, the only one here). Of near copies among them, told by
two minima over shingle hashes, one is learned from, so that a label on a large
group of copies does not make its words features. Words become features if they
tell some category's rows apart by a chi-square test, counted in Spark over the
sample. Scoring reads every whole text.

Edge cases: a null or empty text has no words and takes the models' base rates;
rows without a label are scored but not learned from; null labels leave a row
out of training; of different labels of one doc_id the greatest of each category
holds; labelled rows without words are all learned from; with no labelled rows, or only one class of a category, its
probability is the share seen (0 without rows); repeated rows and null doc_ids
keep their rows; an empty table gives no rows; extra columns are kept by
``drop_toxic`` and ignored by ``chain_scores``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm.shared import free_name, written
from weftspark.llm.text import mix, raw_bytes, shingle_sets, text_chunks, words

#: Labelled rows learned from, folds of the out-of-fold predictions, and least chi-square of a feature.
TRAIN_ROWS, FOLDS, LEAST_CHI = 20_000, 5, 60.0
#: Most features, strength of the L1 penalty, gradient rounds, and the probability from which a document is toxic.
MOST_FEATURES, PENALTY, ROUNDS, BAR = 4096, 5e-5, 400, 0.5
#: Hash cells of features, and the lengths in bytes of word beginnings that are features too.
CELLS, PREFIXES = 1 << 22, (5, 6, 7, 8, 9)
#: ASCII characters that are no letter or digit become spaces.
_PARTED = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def text_cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hash cells of the words of a column without nulls and of the words' first bytes, with repeats.

    ASCII characters that are no letter or digit part words. Beginnings let a
    model know a stem under endings that it has not seen.
    """
    data, offsets = raw_bytes(column)
    spaced = _PARTED[data]
    plain = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(spaced)])
    hashes, bounds = words(plain)
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    inside = spaced != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(spaced))
    padded = np.concatenate([spaced, np.full(max(PREFIXES) + 1, 32, np.uint8)])
    low = np.where((padded >= 65) & (padded <= 90), padded + 32, padded).astype(np.uint64)
    rows, cells, running, whole = [row], [mix(hashes)], np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
    for k in range(1, max(PREFIXES) + 1):
        c = low[starts + k - 1]
        whole &= (c != 32) & (starts + k - 1 < ends)
        running = running * np.uint64(0x9E3779B97F4A7C15) + c
        if k in PREFIXES:
            rows.append(row[whole])
            cells.append(mix(running[whole] + np.uint64(k)))
    return np.concatenate(rows), (np.concatenate(cells) % np.uint64(CELLS)).astype(np.int64)


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_chunks(batches):
        row, cell = text_cells(part.column("text"))
        pairs = np.unique(row * CELLS + cell)
        bounds = np.searchsorted(pairs, np.arange(part.num_rows + 1) * CELLS)
        cells = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((pairs % CELLS).astype(np.int32)))
        minima = [(int(own.min()), int(mix(own ^ np.uint64(77)).min())) if len(own) else (0, 0) for own in shingle_sets(*words(part.column("text")))]
        low = np.array(minima, np.uint64).reshape(-1, 2).view(np.int64)
        rest = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), cells, pa.array(low[:, 0]), pa.array(low[:, 1])], [*rest, "cells", "low1", "low2"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Training rows as a sparse matrix of 0 and 1, and dense columns beside it."""

    def __init__(self, lists: list[np.ndarray], width: int):
        self.n, self.width = len(lists), width
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.col = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def fit_linear(rows: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights (features, dense columns, constant) of a logistic model with an L1 penalty, by accelerated proximal gradients on the rows in use."""
    share = float(y[use].mean()) if use.any() else 0.0
    k = rows.width + dense.shape[1]
    if share in (0.0, 1.0):
        return np.append(np.zeros(k), -35.0 if share == 0 else 35.0)
    n, keep = use.sum(), use.astype(float)
    w = np.append(np.zeros(k), np.log(share / (1 - share)))
    seen, momentum = w.copy(), 1.0
    # The step follows the largest row: each row's gradient changes by at most a quarter of its squared length.
    length = np.bincount(rows.row, minlength=rows.n) + (dense**2).sum(1) + 1
    step = 4.0 / max(4.0, float(np.quantile(length[use], 0.9)))
    for _ in range(ROUNDS):
        p = _sigmoid(rows.times(seen[: rows.width]) + dense @ seen[rows.width : k] + seen[k])
        g = (p - y) * keep / n
        grad = np.concatenate([rows.back(g), dense.T @ g, [g.sum()]])
        new = seen - step * 8 * grad
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * 8 * PENALTY, 0)
        turn = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        seen = new + (momentum - 1) / turn * (new - w)
        w, momentum = new, turn
    return w


def fit_chain(lists: list[np.ndarray], width: int, labels: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """One weight vector a category, and the out-of-fold probabilities (rows, categories)."""
    rows, out = Rows(lists, width), np.zeros(labels.shape)
    models = []
    for c in range(labels.shape[1]):
        before = out[:, :c].copy()
        for f in range(FOLDS):
            w = fit_linear(rows, before, labels[:, c], folds != f)
            p = _sigmoid(rows.times(w[:width]) + before @ w[width : width + c] + w[-1])
            out[folds == f, c] = p[folds == f]
        models.append(fit_linear(rows, before, labels[:, c], np.ones(len(folds), bool)))
    return models, out


class Chain:
    """A trained chain: its feature cells, sorted, and a weight vector a category."""

    def __init__(self, cells: np.ndarray, models: list[np.ndarray]):
        self.cells, self.models = cells, models

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """(rows, categories) of a text column without nulls."""
        n, width = len(column), len(self.cells)
        row, cell = text_cells(column)
        at = np.searchsorted(self.cells, cell)
        hit = np.zeros(len(cell), bool) if not width else self.cells[np.minimum(at, width - 1)] == cell
        pairs = np.unique(row[hit] * max(1, width) + at[hit])
        row, at = pairs // max(1, width), pairs % max(1, width)
        out = np.zeros((n, len(self.models)))
        for c, w in enumerate(self.models):
            out[:, c] = _sigmoid(np.bincount(row, w[at], n) + out[:, :c] @ w[width : width + c] + w[-1])
        return out


def train_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> Chain:
    """A chain learned from ``docs(doc_id, text)`` and ``labels(doc_id, categories...)``."""
    known = labels.select("doc_id", *(F.col(c).cast("int").alias(c) for c in categories)).dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")
    kinds = ", ".join(f"{c} int" for c in categories)
    sample = joined.select("doc_id", *categories, "text").mapInArrow(_cells_of, f"doc_id long, {kinds}, cells array<int>, low1 long, low2 long")
    for low in ("low1", "low2"):
        # Rows without words have no minima and are no copies of each other.
        sample = sample.withColumn("place", F.row_number().over(Window.partitionBy(low).orderBy("doc_id"))).where("place = 1 or size(cells) = 0").drop("place")
    sample = written(sample, "sample")
    totals = sample.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories)).first()
    n = totals["n"]
    counted = sample.select(*categories, F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories))

    def chi(c: str):
        """Chi-square of the two-by-two table of a cell and a category."""
        a, m, t = F.col(c).cast("double"), F.col("n").cast("double"), float(totals[c])
        below = m * (n - m) * t * (n - t)
        return F.when(below > 0, (a * n - m * t) * (a * n - m * t) * n / below).otherwise(0.0)

    ranked = counted.select("cell", F.greatest(*(chi(c) for c in categories), F.lit(0.0)).alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "cell").limit(MOST_FEATURES)
    cells = np.array(sorted(r["cell"] for r in ranked.collect()), np.int64)
    known_cells = F.array(*(F.lit(int(c)) for c in ())).cast("array<int>") if not len(cells) else F.lit(cells.tolist()).cast("array<int>")
    rows = sample.select("doc_id", *categories, F.array_intersect("cells", known_cells).alias("cells")).orderBy("doc_id").collect()
    lists = [np.searchsorted(cells, np.array(r["cells"], np.int64)) for r in rows]
    y = np.array([[float(r[c] > 0) for c in categories] for r in rows]).reshape(len(rows), len(categories))
    folds = (mix(np.array([r["doc_id"] for r in rows], np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    models, _ = fit_chain(lists, len(cells), y, folds) if rows else ([np.array([*np.zeros(len(cells) + i), -35.0]) for i in range(len(categories))], None)
    return Chain(cells, models)


def chain_scores(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("junk", "toxic")) -> DataFrame:
    """doc_id and a probability column p_<category> for every row of ``docs(doc_id, text)``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chain, names = train_chain(own, labels, categories), [f"p_{c}" for c in categories]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in chain.probabilities(part.column("text")).T)], ["doc_id", *names])

    return own.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} double" for c in names))


def table_categories(labels: DataFrame) -> DataFrame:
    """The labels table as categories: junk (quality 0) and toxic."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("junk"), F.col("toxic").cast("int").alias("toxic"))


def toxic_digest(scores: DataFrame, bar: float = BAR) -> DataFrame:
    """Probabilities to six places and the decision."""
    return scores.select("doc_id", F.round("p_junk", 6).alias("p_junk"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") >= bar).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, bar: float = BAR) -> DataFrame:
    """The documents, all columns kept, whose toxic probability is below the bar. Rows are scored where they are read; nothing is joined."""
    name = free_name(docs, "scored")
    own = docs.withColumn(name, F.col("text").cast("string"))
    chain = train_chain(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, ("junk", "toxic"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, name):
            kept = chain.probabilities(part.column(name))[:, 1] < bar
            yield part.drop_columns([name]).filter(pa.array(kept, pa.bool_()))

    return own.mapInArrow(keep, docs.schema)
