"""Toxicity score: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read as overlapping windows of `SPAN` words.  A word's input joins a
trained vector of its own (known words), the mean of trained vectors of its
hashed character trigrams, and three fixed numbers: how strongly the word, the
most telling six bytes in it, and the most telling beginning of it went with the
label among the training texts.  States of both directions are pooled by a
softmax over a trained direction; a logistic unit gives the window's score.  A
document scores the maximum of all its windows.

The network is trained on the driver on at most `FIT_ROWS` labelled documents of
at most `FIT_BYTES` bytes (those with the smallest hash of doc_id): of each, the
window that holds the most telling word, and of negative ones one further window.
The documents are dealt into `FOLDS` folds, evenly for either label; the fixed
numbers of a fold's words come from the other folds alone, so no text's own label
is in its inputs, neither in the steps nor in early stopping and calibration, which look
at fold 0, left out of the steps.

Defined cases: null, empty and wordless texts score the training rate; labels
that are null, repeated or have no document as for the quality score; without
both classes every text scores the smoothed rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.common import ALNUM, chunks, mix64, spelt, utf8
from rulegrain.llm.quality import fitting_sample, held_out

HELD, CUT = (5, 0), 0.5
#: Labelled documents used for training at most, and bytes of each at most.
FIT_ROWS, FIT_BYTES = 4_000, 1 << 16
SPAN, STEP = 48, 32
HIDDEN, OWN, CHARS, FIXED = 12, 8, 8, 3
BUCKETS, PIECES, KNOWN, LEAST_DOCS, LEAST_SHARE = 4096, 1 << 17, 8192, 3, 0.004
#: Lengths in bytes of the beginnings of words that are looked at.
BEGINS = (4, 7, 8, 9, 10)
STEPS, BATCH, RATE, DECAY = 600, 128, 0.01, 1e-3
#: Vectors of words and letters learn at this part of the rate: with few positive texts they'd learn the texts by heart.
SLOW = {"own": 0.02, "chars": 0.02}
#: Training ends when the log loss of fold 0 hasn't fallen for PATIENCE looks, LOOK steps apart.
FOLDS, LOOK, PATIENCE = 5, 20, 7
#: What a toxic text that isn't found costs, in clean texts flagged.
MISSED = 2.0


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trigrams(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A bucket for each byte of the words end to end: it and its neighbours inside the word."""
    before, after = np.zeros_like(letters), np.zeros_like(letters)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    before[places[:-1]] = 0
    after[places[1:] - 1] = 0
    code = (before.astype(np.uint64) << np.uint64(16)) | (letters.astype(np.uint64) << np.uint64(8)) | after
    return (mix64(code) % np.uint64(BUCKETS)).astype(np.int64)


def sixes(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A bucket for each byte of the words end to end: up to six bytes from it on, and whether it begins the word."""
    code = np.zeros(len(letters), np.uint64)
    code[places[:-1]] = np.uint64(1) << np.uint64(56)
    left = np.repeat(places[1:], np.diff(places)) - np.arange(len(letters))
    for j in range(6):
        code[: len(letters) - j] |= np.where(left[: len(letters) - j] > j, letters[j:], 0).astype(np.uint64) << np.uint64(8 * j)
    return (mix64(code) % np.uint64(PIECES)).astype(np.int64)


def begins(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Buckets of the beginnings of every word, one column for each of BEGINS; PIECES where the word is shorter."""
    lengths = np.diff(places)
    code, out = np.zeros(len(lengths), np.uint64), np.full((len(lengths), len(BEGINS)), PIECES)
    for j in range(BEGINS[-1]):
        on = np.flatnonzero(lengths > j)
        code[on] = mix64(code[on] + letters[places[on] + j] + np.uint64(0x51ED + 256 * j))
        if j + 1 in BEGINS:
            out[on, BEGINS.index(j + 1)] = code[on] % np.uint64(PIECES)
    return out


def _telling(n1: np.ndarray, n: np.ndarray, positive: float, total: float) -> np.ndarray:
    """Standard scores of the labels of n documents with n1 positive ones, cut to 8 and scaled."""
    share, rate = n / max(total, 1), positive / max(total, 1)
    z = (n1 - share * positive) / np.sqrt(np.maximum(share * (1 - share) * positive * (1 - rate), 1e-9) + 0.5)
    return (np.clip(z, -8, 8) / 4).astype(np.float32)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the windows of all rows; together they hold every word."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - SPAN) // STEP) + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = first[row] + k * STEP
    return row, start, np.minimum(SPAN, first[row + 1] - start)


class Network:
    """Parameters by name; words are known by hash."""

    def __init__(self, rate: float, known: np.ndarray, telling: np.ndarray, inner: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.rate, self.known, self.telling, self.inner, self.trained, self.scale = rate, known, telling.astype(np.float32), inner, False, (1.0, 0.0)
        size = OWN + CHARS + FIXED
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"own": 0.1 * draw(len(known) + 1, OWN), "chars": draw(BUCKETS, CHARS) * 2, "wa": np.zeros(2 * HIDDEN, np.float32), "wo": draw(2 * HIDDEN, 1)[:, 0], "bo": np.full(1, np.log(rate / (1 - rate)), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(size, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Index of known words; unknown ones share the last."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, len(self.known))

    def fixed(self, ids: np.ndarray, six: np.ndarray, begin: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The fixed numbers of words: of the word, of its most telling six bytes, of its most telling beginning."""
        return fixed_numbers(np.append(self.telling, np.float32(0)), self.inner, ids, six, begin, places)

    def inputs(self, ids: np.ndarray, grams: np.ndarray, places: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        own = self.p["own"][ids].copy()
        own[ids == len(self.known)] = 0
        lengths = np.diff(places).astype(np.float32)[:, None]
        chars = np.add.reduceat(self.p["chars"][grams], places[:-1], axis=0) / lengths
        return np.concatenate([own, chars, fixed], axis=1)

    def run(self, x: np.ndarray, at: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows; x holds inputs of word types, at (windows, SPAN) their indices."""
        n, live = len(at), np.arange(SPAN)[None] < length[:, None]
        states, saved = np.zeros((n, SPAN, 2 * HIDDEN), np.float32), {}
        for d, steps in (("f", range(SPAN)), ("b", range(SPAN - 1, -1, -1))):
            w, u = x @ self.p[f"W{d}"] + self.p[f"b{d}"], self.p[f"U{d}"]
            side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            h = np.zeros((n, HIDDEN), np.float32)
            for t in steps:
                a = w[at[:, t]]
                r = h @ u
                zr = _fast(a[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
                z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
                new = h + live[:, t : t + 1] * (1 - z) * (c - h)
                if keep:
                    saved[d, t] = (h, z, reset, c, r[:, 2 * HIDDEN :])
                states[:, t, side] = h = new
        e = np.where(live, states @ self.p["wa"], -np.inf)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = (alpha[:, None, :] @ states)[:, 0]
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (states, saved, alpha, pooled, live)) if keep else logit

    def gradients(self, ids, grams, places, fixed, at, length, y):
        """Gradients of the mean log loss by backpropagation through time."""
        x = self.inputs(ids, grams, places, fixed)
        logit, (states, saved, alpha, pooled, live) = self.run(x, at, length, keep=True)
        out = {k: np.zeros_like(v) for k, v in self.p.items()}
        dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        out["wo"], out["bo"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * self.p["wo"]
        dalpha = (states @ dpool[:, :, None])[:, :, 0]
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
        out["wa"] = np.einsum("nt,nth->h", de, states)
        dstates = alpha[:, :, None] * dpool[:, None, :] + de[:, :, None] * self.p["wa"]
        dx = np.zeros_like(x)
        for d, steps in (("f", range(SPAN - 1, -1, -1)), ("b", range(SPAN))):
            u = self.p[f"U{d}"]
            side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            dh = np.zeros((len(y), HIDDEN), np.float32)
            every = np.empty((SPAN, len(y), 3 * HIDDEN), np.float32)
            for t in steps:
                h, z, reset, c, rc = saved[d, t]
                dh = dh + dstates[:, t, side]
                on = live[:, t : t + 1] * dh
                dc = on * (1 - z) * (1 - c * c)
                da = np.concatenate([-on * (c - h) * z * (1 - z), dc * rc * reset * (1 - reset), dc], axis=1)
                dr = da.copy()
                dr[:, 2 * HIDDEN :] *= reset
                every[t] = da
                out[f"U{d}"] += h.T @ dr
                dh = dh - on * (1 - z) + dr @ u.T
            dw = _added(every.reshape(-1, 3 * HIDDEN), at.T.reshape(-1), len(x))
            out[f"W{d}"], out[f"b{d}"] = x.T @ dw, dw.sum(axis=0)
            dx += dw @ self.p[f"W{d}"].T
        out["own"] = _added(dx[:, :OWN], ids, len(out["own"]))
        out["own"][len(self.known)] = 0
        lengths = np.diff(places)
        out["chars"] = _added(np.repeat(dx[:, OWN : OWN + CHARS] / lengths[:, None], lengths, axis=0), grams, BUCKETS)
        return out

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Score of each row: the maximum over all its windows."""
        hashes, first, letters, places = spelt(raw, off, ALNUM)
        out = np.full(len(off) - 1, self.rate)
        if not len(hashes) or not self.trained:
            return out
        types, sample, at = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = np.diff(places)[sample]
        own_places = np.concatenate([[0], np.cumsum(lengths)])
        own_letters = letters[np.repeat(places[sample] - own_places[:-1], lengths) + np.arange(own_places[-1])]
        ids = self.word_ids(types)
        fixed = self.fixed(ids, sixes(own_letters, own_places), begins(own_letters, own_places), own_places)
        x = self.inputs(ids, trigrams(own_letters, own_places), own_places, fixed)
        row, start, length = windows(first)
        best = np.full(len(off) - 1, -np.inf)
        for lo in range(0, len(row), 4096):
            part = slice(lo, lo + 4096)
            where = np.minimum(start[part][:, None] + np.arange(SPAN), len(at) - 1)
            np.maximum.at(best, row[part], self.run(x, at[where], length[part]))
        has = best > -np.inf
        out[has] = _sigmoid(self.scale[0] * best[has] + self.scale[1])
        return out


def fixed_numbers(telling, inner, ids, six, begin, places) -> np.ndarray:
    first = np.append(inner, np.float32(-2))[begin].max(axis=1)
    return np.stack([telling[ids], np.maximum.reduceat(inner[six], places[:-1]), np.where(first > -2, first, np.float32(0))], axis=1)


def _added(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their target, of n targets."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(to, kind="stable")
    at = to[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out[at[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def _fast(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _calibrated(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of y on logit, positive texts weighing MISSED, by damped Newton steps from (1, 0)."""
    x, w, cost = np.stack([logit, np.ones(len(y))], axis=1), np.array([1.0, 0.0]), np.where(y == 1, MISSED, 1.0)
    for _ in range(30):
        p = _sigmoid(x @ w)
        grad = x.T @ (cost * (p - y)) + 0.1 * (w - [1.0, 0.0])
        hess = (x * (cost * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - 0.5 * np.linalg.solve(hess, grad)
    return (float(w[0]), float(w[1])) if w[0] > 0.05 and np.isfinite(w).all() else (1.0, 0.0)


def _dealt(y: np.ndarray, rng) -> np.ndarray:
    """A fold for every document, evenly for either label."""
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        of = rng.permutation(np.flatnonzero(y == label))
        fold[of] = np.arange(len(of)) % FOLDS
    return fold


def _counts(code: np.ndarray, fold: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """For positive and for all documents, and each fold: how many hold a code; code has (document, code) once each."""
    doc = code // size
    cell = fold[doc] * size + code % size
    return np.stack([np.bincount(cell, w, FOLDS * size).reshape(FOLDS, size) for w in (y[doc], None)])


def train(texts: pa.Array, y: np.ndarray, seed: int = 5) -> Network:
    rate = float((y.sum() + 1) / (len(y) + 2))
    nothing = Network(rate, np.empty(0, np.uint64), np.empty(0), np.zeros(PIECES, np.float32))
    if len(set(y.tolist())) < 2:
        return nothing
    raw, off = utf8(texts)
    hashes, first, letters, places = _pieces(raw, off)
    if not len(hashes):
        return nothing
    rng = np.random.default_rng(seed)
    fold = _dealt(y, rng)
    row = np.repeat(np.arange(len(y)), np.diff(first))
    types, sample, at = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = np.diff(places)[sample]
    own = np.concatenate([[0], np.cumsum(lengths)])
    letters = letters[np.repeat(places[sample] - own[:-1], lengths) + np.arange(own[-1])]
    grams, six, begin = trigrams(letters, own), sixes(letters, own), begins(letters, own)
    pair = np.unique(row.astype(np.int64) * len(types) + at)
    prow, ptype = pair // len(types), pair % len(types)
    n = np.bincount(ptype, minlength=len(types))
    common = np.flatnonzero(n >= max(LEAST_DOCS, LEAST_SHARE * len(y)))
    common = np.sort(common[np.argsort(-n[common], kind="stable")[:KNOWN]])
    place = np.full(len(types), len(common))
    place[common] = np.arange(len(common))
    known = place[ptype] < len(common)
    of_words = _counts(prow[known] * max(1, len(common)) + place[ptype[known]], fold, y, max(1, len(common)))[:, :, : len(common)]
    of_pieces = np.zeros((2, FOLDS, PIECES))
    for docs in np.array_split(np.arange(len(y)), max(1, len(y) // 64)):
        part = slice(*np.searchsorted(prow, [docs[0], docs[-1] + 1]))
        of, to = _expand(ptype[part], own)
        head = begin[ptype[part]].reshape(-1)
        on = np.flatnonzero(head < PIECES)
        code = np.concatenate([prow[part][of] * PIECES + six[to], prow[part][on // len(BEGINS)] * PIECES + head[on]])
        of_pieces += _counts(np.unique(code), fold, y, PIECES)
    del pair, prow, ptype, known

    def told(counts: np.ndarray, without: int) -> np.ndarray:
        """Scores from all folds but one (none: -1)."""
        left, docs = np.arange(FOLDS) != without, fold != without
        return _telling(counts[0, left].sum(axis=0), counts[1, left].sum(axis=0), float(y[docs].sum()), float(docs.sum()))

    net = Network(rate, types[common], told(of_words, -1), told(of_pieces, -1), seed)
    net.trained = True
    ids = net.word_ids(types)
    # the fixed numbers of every word for each fold, from the other folds
    apart = np.stack([fixed_numbers(np.append(told(of_words, k), np.float32(0)), told(of_pieces, k), ids, six, begin, own) for k in range(FOLDS)])
    del of_words, of_pieces, six, begin
    strength = apart.max(axis=2)[fold[row], at]
    wrow, start, length = windows(first)
    where = np.minimum(start[:, None] + np.arange(SPAN), len(at) - 1)
    live = np.arange(SPAN)[None] < length[:, None]
    top = np.where(live, strength[where], -np.inf).max(axis=1)
    order = np.lexsort((start, -top, wrow))
    chosen = order[np.unique(wrow[order], return_index=True)[1]]
    more = rng.permutation(len(wrow))
    more = more[np.unique(wrow[more], return_index=True)[1]]
    aside = fold[wrow[chosen]] == 0
    held, used = chosen[aside], np.concatenate([chosen[~aside], more[(y[wrow[more]] == 0) & (fold[wrow[more]] > 0)]])
    if not len(used) or not len(held):
        held = used = chosen

    def batch(part):
        code, idx = np.unique(fold[wrow[part]][:, None] * len(types) + at[where[part]], return_inverse=True)
        of_fold, part_types = code // len(types), code % len(types)
        of, to = _expand(part_types, own)
        ends = np.concatenate([[0], np.cumsum(lengths[part_types])])
        return ids[part_types], grams[to], ends, apart[of_fold, part_types], idx.reshape(len(part), SPAN), length[part], y[wrow[part]].astype(np.float32)

    def logits(part) -> np.ndarray:
        *words_of, idx, size, _ = batch(part)
        return net.run(net.inputs(*words_of), idx, size)

    def loss() -> float:
        p, truth = np.clip(_sigmoid(logits(held)), 1e-6, 1 - 1e-6), y[wrow[held]]
        return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    best, waited = (loss(), {k: v.copy() for k, v in net.p.items()}), 0
    for step in range(1, STEPS + 1):
        part = rng.choice(used, min(BATCH, len(used)), replace=False)
        for k, g in net.gradients(*batch(part)).items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.p[k] = net.p[k] * (1 - RATE * DECAY) - RATE * SLOW.get(k, 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        if step % LOOK == 0:
            now = loss()
            if now < best[0]:
                best, waited = (now, {k: v.copy() for k, v in net.p.items()}), 0
            elif (waited := waited + 1) == PATIENCE:
                break
    net.p = best[1]
    # a maximum over many windows is higher than one window's logit: fit slope and offset on whole texts set aside
    whole = np.flatnonzero(fold[wrow] == 0)
    out = np.full(len(y), -np.inf)
    for lo in range(0, len(whole), 2048):
        np.maximum.at(out, wrow[whole[lo : lo + 2048]], logits(whole[lo : lo + 2048]))
    has = out > -np.inf
    if has.any() and len(set(y[has].tolist())) == 2:
        net.scale = _calibrated(out[has], y[has])
    return net


def _expand(types: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of types, byte) for all bytes of the types."""
    lengths = places[types + 1] - places[types]
    of = np.repeat(np.arange(len(types)), lengths)
    return of, np.repeat(places[types] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(of))


def _pieces(raw, off):
    hashes, first, letters, places = [], [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)]
    n_words = n_letters = 0
    for lo, hi in chunks(off):
        h, f, l, p = spelt(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ALNUM)
        hashes.append(h)
        first.append(f[1:] + n_words)
        letters.append(l)
        places.append(p[1:] + n_letters)
        n_words, n_letters = n_words + len(h), n_letters + len(l)
    return tuple(map(np.concatenate, (hashes, first, letters, places)))


def learn(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = HELD, rows: int = FIT_ROWS) -> Network:
    table = fitting_sample(docs, labels, "toxic", held, rows, FIT_BYTES).toArrow()  # FIT_ROWS rows of FIT_BYTES bytes at most
    y = table.column("y").to_numpy().astype(np.float64)
    if not len(y):
        return Network(0.5, np.empty(0, np.uint64), np.empty(0), np.zeros(PIECES, np.float32))
    return train(table.column("text"), y)


def score(docs: DataFrame, net: Network, held: tuple[int, int] = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(2))
            parts = [shared.value.scores(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in chunks(off)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(parts), pa.float64())], names=["doc_id", "held_out", "score"])

    texts = docs.select("doc_id", held_out(held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))
