"""Quality score: a generalised additive model with pairwise interactions.

Features are counts and shares of whole texts.  They are cut into bins; cyclic
boosting goes through the features in turn and fits a shallow tree to the
residuals of one of them, adding it to that feature's table of bins.  Pairs that
explain most of what is left get tables on coarser bins the same way.  A score
is the sigmoid of an intercept and one table entry for each feature and pair.

The model is fitted on the driver on at most `FIT_ROWS` labelled documents (those
with the smallest hash of doc_id, so reruns agree); features of all texts are
made, whole, on the executors.  doc_id only deals rows into fitting and held-out.

Defined cases: null and empty texts have all-zero features and a score of their
own; label rows without a document or with a null label aren't used, repeated
ones count once each; without labels, or with one class only, the score is the smoothed rate.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = 0.7
#: Labelled documents used to fit at most.
FIT_ROWS = 8_000
BINS, COARSE, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 100, 60, 0.2, 4

FEATURES = ("log_chars", "log_words", "mean_word", "symbols", "stops", "capitals", "digits", "pipes", "bangs", "marks", "distinct", "top_word", "lines", "repeats", "marked_words", "capital_words", "long_words", "spread")
_MARKS = "*$%&#"
_CLOSED = frozenset("!*$%&#|")


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    text = text or ""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    counts = Counter(words)
    marks = sum(map(text.count, _MARKS))
    pipes, bangs = text.count("|"), text.count("!")
    stops = text.count(".") + text.count(",") + text.count(";") + text.count("?")
    lines = text.count("\n") + 1
    capitals = len(text) - len(text.translate(_NO_CAPITALS))
    digits = len(text) - len(text.translate(_NO_DIGITS))
    marked = sum(c for w, c in counts.items() if w[-1] in _CLOSED)
    capital = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / m
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), mean, (marks + pipes + bangs) / n, stops / m, capitals / n, digits / n, pipes / m, bangs / m, marks / m,
        len(counts) / m, max(counts.values(), default=0) / m, lines / m, repeats / m, marked / m, capital / m, sum(x > 12 for x in lengths) / m, (sum(x * x for x in lengths) / m - mean * mean) ** 0.5 if words else 0.0,
    ]


_NO_CAPITALS = {c: None for c in range(0x250) if chr(c).isupper()}
_NO_DIGITS = {c: None for c in range(48, 58)}


class Model:
    """Lookup tables: one for each feature, and for each chosen pair on coarse bins."""

    def __init__(self):
        self.base, self.edges, self.tables, self.coarse, self.pairs = 0.0, [], [], [], []

    def _bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.edges:
            fine, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
            for j, table in enumerate(self.tables):
                out += table[fine[:, j]]
            for i, j, table in self.pairs:
                out += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Value of each bin of a tree of so many leaves over ordered bins: the best cut of the best leaf, again and again."""
    g, h = np.concatenate([[0.0], np.cumsum(grad)]), np.concatenate([[0.0], np.cumsum(hess)])
    parts = [(0, len(grad))]

    def cut_of(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        a, b = slice(lo + 1, hi), hi
        more = (g[a] - g[lo]) ** 2 / (h[a] - h[lo] + 1.0) + (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
        at = int(np.argmax(more))
        return float(more[at] - (g[b] - g[lo]) ** 2 / (h[b] - h[lo] + 1.0)), lo + 1 + at

    cuts = {part: cut_of(*part) for part in parts}
    while len(parts) < leaves:
        part = max(parts, key=lambda p: cuts[p][0])
        more, cut = cuts[part]
        if more <= 1e-9:
            break
        parts.remove(part)
        for new in ((part[0], cut), (cut, part[1])):
            parts.append(new)
            cuts[new] = cut_of(*new)
    out = np.zeros(len(grad))
    for lo, hi in parts:
        out[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    model = Model()
    rate = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(rate / (1 - rate)))
    if len(set(y.tolist())) < 2:
        return model
    cuts = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(x.shape[1])]
    model.edges, model.coarse = cuts(BINS), cuts(COARSE)
    fine, coarse = model._bins(x, model.edges), model._bins(x, model.coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-margin))
            step = RATE * _tree(np.bincount(fine[:, j], y - p, len(table)), np.bincount(fine[:, j], p * (1 - p), len(table)), LEAVES)
            table += step
            margin += step[fine[:, j]]
    p = 1 / (1 + np.exp(-margin))
    strength = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            cell = coarse[:, i] * BINS + coarse[:, j]
            g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
            strength.append((float((g * g / (h + 1.0)).sum()), i, j))
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for _, i, j in sorted(strength, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            p = 1 / (1 + np.exp(-margin))
            cell = coarse[:, i] * table.shape[1] + coarse[:, j]
            g, h = (np.bincount(cell, w, table.size).reshape(table.shape) for w in (y - p, p * (1 - p)))
            # a tree of two levels: one cut of rows, then one of columns on either side
            top = _tree(g.sum(axis=1), h.sum(axis=1), 2)
            step = np.zeros(table.shape)
            for value in np.unique(top):
                side = top == value
                step[side] = _tree(g[side].sum(axis=0), h[side].sum(axis=0), 2)
            table += RATE * step
            margin += RATE * step.reshape(-1)[cell]
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, held: tuple[int, int], rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, y) of documents outside the held-out share, by at most rows labels, the same ones in every run.

    A label of a doc_id that several rows of docs share counts for each of them, so there may be more than rows.
    """
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(key % held[0] != held[1]).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id").select("doc_id", "text", "y")


def fitting_sample(docs: DataFrame, labels: DataFrame, label: str, held: tuple[int, int], rows: int, most_bytes: int) -> DataFrame:
    """labelled() documents of at most most_bytes bytes, and at most rows of them."""
    short = docs.where(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) <= most_bytes)
    return labelled(short, labels, label, held, rows).orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("text"), "text").limit(rows)


def held_out(held: tuple[int, int]):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held[0] == held[1], F.lit(False))


HELD = (4, 2)


def _rows_of(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = HELD, rows: int = FIT_ROWS) -> Model:
    schema = "id long, f array<double>, y int"

    def made(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": [zlib.crc32(str(i).encode()) for i in pdf["doc_id"]], "f": list(_rows_of(pdf["text"])), "y": pdf["y"]})

    table = labelled(docs, labels, "quality", held, rows).mapInPandas(made, schema).orderBy("id", "y", "f").limit(rows).toPandas()  # FIT_ROWS rows of numbers at most
    if not len(table):
        return Model()
    return fit(np.stack(table["f"].to_numpy()), table["y"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Model, held: tuple[int, int] = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": shared.value.scores(_rows_of(pdf["text"]))})

    texts = docs.select("doc_id", held_out(held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose whole text scores CUT or more; all columns are kept."""
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(_rows_of(text)))

    return docs.where(scored(F.col("text").cast("string")) >= CUT)
