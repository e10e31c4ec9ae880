"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters after lower-casing
A-Z.  A window of an item is 13 consecutive words, or the whole item if it has
fewer.  From every nine consecutive 5-grams the smallest hash is kept, on both
sides, so any 13 shared words share a fingerprint: the two windows have the same smallest hash,
wherever it stands.  Fingerprints are joined, and each hit is extended to the windows that
hold it: those starting at most eight words before it.  Such a window counts if it is one of
the items', by its hash and then word for word against one place of it there.  A text costs time in proportion to
its words and to the items found, however often a word or a passage is repeated.

Short items have no such guarantee from 5-grams; for each of their lengths
(at most 12) all n-grams of that length are looked up whole.

The items are handled in blocks of about `BLOCK_WORDS` words and never more than twice that; a block is the
only thing that is broadcast, so its size is bounded whatever the benchmark's.  Equal items are
one, and an item of more than `PIECE_WORDS` words is cut into pieces that overlap by 12 words, so
no item is larger than a block.

Defined cases: null texts have no words; items without words are never found;
rows that share a doc_id keep their own results; equal items are all reported;
item_ids are compared as strings, and an item without one counts for hits but
is not named among the items found; other columns are left alone and may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.common import ALNUM, chunks, gram, materialise, utf8, words

SPAN, GRAM = 13, 5
WINDOW = SPAN - GRAM + 1
#: Words of the items in one broadcast block (hashes of 8 bytes, with an index of about four times the size), and of one piece of a long item.
BLOCK_WORDS, PIECE_WORDS = 2_000_000, 100_000


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the minima (rightmost of equals) of all runs of window grams, ascending."""
    if len(grams) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


class Windows:
    """The distinct windows of n words of a block of items: hash, one place, and the items that have it."""

    def __init__(self, n: int, keys: np.ndarray, places: np.ndarray, items: np.ndarray):
        self.n = n
        order = np.lexsort((items, keys))
        keys, places, items = keys[order], places[order], items[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (items[1:] != items[:-1]))[: len(keys)]
        keys, places, self.items = keys[new], places[new], items[new]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.keys, self.places, self.ends = keys[first], places[first], np.append(first, len(keys))

    def found(self, hashes: np.ndarray, at: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places `at` in a text's words, those that begin a window, and which; mine: the words of the items."""
        keys = gram(hashes, self.n)[at]
        which = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[which] == keys)
        at, which, step = at[hit], which[hit], np.arange(self.n)
        same = np.ones(len(at), bool)
        for lo in range(0, len(at), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            same[part] = (hashes[at[part, None] + step] == mine[self.places[which[part], None] + step]).all(axis=1)
        return at[same], which[same]


class Index:
    """Fingerprints and windows of a block of items."""

    def __init__(self, ids: list[str], hashes: np.ndarray, first: np.ndarray):
        self.ids, self.hashes = ids, hashes
        size = np.diff(first)
        item = np.repeat(np.arange(len(size)), size)
        ahead = np.repeat(first[1:], size) - np.arange(len(hashes))  # words to the end of the item
        self.fingerprints, self.windows = np.empty(0, np.uint64), []
        at = np.flatnonzero((ahead >= SPAN) & (np.repeat(size, size) >= SPAN))
        if len(at):
            self.windows.append(Windows(SPAN, gram(hashes, SPAN)[at], at, item[at]))
            grams, long = gram(hashes, GRAM), np.flatnonzero(size >= SPAN)
            self.fingerprints = np.unique(np.concatenate([(g := grams[first[i] : first[i + 1] - GRAM + 1])[winnow(g)] for i in long]))
        for n in range(1, SPAN):
            short = np.flatnonzero(size == n)
            if len(short):
                self.windows.append(Windows(n, gram(hashes, n)[first[short]], first[short], short))

    def matches(self, hashes: np.ndarray, first: np.ndarray):
        """For each text: (spans as arrays of starts and ends, merged; sorted distinct items)."""
        begins, ends, texts, items = [], [], [], []
        size = np.diff(first)
        ahead = np.repeat(first[1:], size) - np.arange(len(hashes))
        for kind in self.windows:
            if len(hashes) < kind.n:
                continue
            if kind.n == SPAN:
                # grams that span two texts only add candidates; every window inside a text has its minimum among them
                grams = gram(hashes, GRAM)
                at = winnow(grams)
                at = at[np.isin(grams[at], self.fingerprints)]
                near = np.zeros(len(hashes) + 1, np.int32)
                np.add.at(near, np.maximum(at - WINDOW + 1, 0), 1)
                np.add.at(near, at + 1, -1)
                at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (ahead >= SPAN))
            else:
                at = np.flatnonzero(ahead >= kind.n)
            at, which = kind.found(hashes, at, self.hashes)
            row = np.searchsorted(first, at, side="right") - 1
            begins.append(at)
            ends.append(at + kind.n)
            pair = np.unique(row * len(kind.keys) + which)
            row, which = pair // len(kind.keys), pair % len(kind.keys)
            count = kind.ends[which + 1] - kind.ends[which]
            texts.append(np.repeat(row, count))
            items.append(kind.items[np.repeat(kind.ends[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        none = np.empty(0, np.int64)
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, np.concatenate([none, *begins]), 1)
        np.add.at(cover, np.concatenate([none, *ends]), -1)
        hit = np.cumsum(cover[:-1]) > 0
        edge = np.zeros(len(hashes) + 1, bool)
        edge[first] = True
        starts = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
        stops = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False))) + 1
        of = np.searchsorted(starts, first)
        pair = np.unique(np.concatenate([none, *texts]) * max(1, len(self.ids)) + np.concatenate([none, *items]))
        cut = np.searchsorted(pair, np.arange(len(first)) * max(1, len(self.ids)))
        pair %= max(1, len(self.ids))
        return [((starts[of[i] : of[i + 1]] - first[i], stops[of[i] : of[i + 1]] - first[i]), pair[cut[i] : cut[i + 1]]) for i in range(len(size))]


_SPANS = "array<struct<lo:int,hi:int>>"


def _pieces(items: DataFrame) -> DataFrame:
    """Distinct (item_id, text, w): items, and the overlapping pieces of long ones; w: words at most."""
    text = F.col("text").cast("string")
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), text.alias("text"), F.coalesce(F.floor((F.length(text) + 1) / 2), F.lit(0)).alias("w")).distinct()
    short, long = rows.where(F.col("w") <= PIECE_WORDS), rows.where(F.col("w") > PIECE_WORDS)
    split = F.filter(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - SPAN, F.lit(0)), F.lit(PIECE_WORDS))
    cut = long.withColumn("ws", split).withColumn("at", F.explode(starts)).withColumn("part", F.slice("ws", F.col("at") + 1, PIECE_WORDS + SPAN - 1))
    return short.unionByName(cut.select("item_id", F.array_join("part", " ").alias("text"), F.size("part").cast("long").alias("w")))


def _blocks(items: DataFrame, block_words: int):
    """How many blocks of items there are, and a function that gives the index of one."""
    pieces = materialise(_pieces(items), "items")
    n = max(1, -(-pieces.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0] // block_words))
    block = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    while n > 1 and pieces.groupBy(block(n).alias("b")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("c")).where((F.col("w") > 2 * max(block_words, PIECE_WORDS)) & (F.col("c") > 1)).count():
        n *= 2  # dealt unevenly: no block may be larger than twice the aim, one piece apart

    def build(k: int) -> Index:
        table = pieces.where(block(n) == k).select("item_id", "text").toArrow()
        raw, off = utf8(table.column("text"))
        hashes, first = words(raw, off, ALNUM)
        return Index(table.column("item_id").to_pylist(), hashes, first)

    return n, build


def _scan(shared):
    """Batches of (row, ...); gives row, n_words, spans, items for each."""

    def run(batches):
        index = shared.value
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            for lo, hi in chunks(off):
                hashes, first = words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ALNUM)
                found = index.matches(hashes, first)
                spans = [[{"lo": a, "hi": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)] for (begin, end), _ in found]
                names = [sorted({index.ids[i] for i in of.tolist()} - {None}) for _, of in found]
                columns = [batch.column("row").slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "spans", "items"])

    return run


def contamination(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS, columns: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns; doc_id, if not given), n_words, spans (merged word intervals that are hit) and items (item_ids found) of every row of docs."""
    spark = docs.sparkSession
    whole = F.struct(*(F.col(f"`{c}`") for c in columns or ["doc_id"]))
    n, build = _blocks(items, block_words)
    result = f"n_words long, spans {_SPANS}, items array<string>"
    if n == 1:
        texts = docs.select(whole.alias("row"), F.col("text").cast("string").alias("text"))
        return texts.mapInArrow(_scan(spark.sparkContext.broadcast(build(0))), f"row {texts.schema['row'].dataType.simpleString()}, {result}")
    # Several blocks: rows are numbered in a table of their own; spans and items of the blocks are put together.
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("whole"), F.col("text").cast("string").alias("text")), "rows")
    found = None
    for k in range(n):
        one = materialise(rows.select("row", "text").mapInArrow(_scan(spark.sparkContext.broadcast(build(k))), f"row long, {result}").where("size(spans) > 0"), "hits")
        found = one if found is None else found.union(one)
    merged = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    none = F.array().cast(_SPANS)
    start = F.struct(none.alias("done"), F.lit(-1).alias("to"))
    longer = lambda s, x: F.concat(F.slice(s["done"], 1, F.greatest(F.size(s["done"]) - 1, F.lit(0))), F.array(F.struct(F.element_at(s["done"], -1)["lo"].alias("lo"), F.greatest(s["to"], x["hi"]).alias("hi"))))
    union = F.aggregate("spans", start, lambda s, x: F.struct(F.when(x["lo"] > s["to"], F.array_append(s["done"], x)).otherwise(longer(s, x)).alias("done"), F.greatest(s["to"], x["hi"]).alias("to")), lambda s: s["done"])
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    joined = rows.select("row", "whole", n_words.alias("n_words")).join(merged, "row", "left")
    return joined.select(F.col("whole").alias("row"), "n_words", F.coalesce(union, none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def verdict(found: DataFrame) -> DataFrame:
    """Counts, digest of the item_ids and the 5 % rule, from contamination()'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    out = found.select("row", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated rows; each row is judged by its own text, its doc_id may be null or repeated."""
    judged = verdict(contamination(docs, items, columns=docs.columns))
    return judged.where("not contaminated").select("row.*")


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
