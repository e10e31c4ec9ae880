"""Near-duplicate detection with b-bit MinHash.

Every text gives the set of its distinct word shingles, 288 minima and 48 band
keys of six minima each.  The low two bits of the minima are packed as bit
planes; the similarity of a candidate pair is estimated from bit counts and
corrected for chance agreement, and pairs near or above the threshold are
confirmed on their full sets.

Texts with equal sets fall into one class first.  A band bucket is linked by a
star to its smallest member, never by all its pairs.  Buckets whose members
then lie in several components are gone through once more: the rows outside the
bucket's largest component are held against all its rows.  Both sides are dealt into parts
and every two parts are a tile, so a task holds two parts of bounded size.  Within a tile,
signatures choose the pairs whose full sets are
intersected there and then; only links between different components leave it, one for
each row and component, and no pairs are listed.  Components come
from alternating large and small stars.

A pair is found if it shares a band and its estimate isn't far too low.  At a similarity of
exactly 0.75 a band misses 0.01 % of pairs and the estimate fewer than 0.001 %
(10^6 simulated pairs: see the test); both fall quickly above it.

Defined cases: null or blank texts have empty sets and no link; fewer words
than a shingle are one shingle; rows that share a doc_id count as one document, which has
the links of all its texts;
a row without doc_id is compared with nothing and is kept; further columns are
left alone by `keep_one` and not looked at by `components`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.common import SPACED, chunks, discard, give_back, gram, materialise, mix64, salted_join, split_join, utf8, words

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 48, 6
PLANES = 2
K = BANDS * ROWS
LONGS = (K + 63) // 64
#: Lowest estimate that is still confirmed: 0.75 less about 4.8 standard errors (0.031) of 288 two-bit minima.
ESTIMATE = 0.60
#: Rows, and shingles, of one side of a tile in which signatures and sets are compared (on average; one document may be larger).
TILE, TILE_SHINGLES = 512, 500_000
#: Bits of the filter that spares texts without candidates from a second shingling; of fixed size.
FILTER_BITS = 1 << 25

_SEEDS = mix64(np.arange(1, 2 * K + 1, dtype=np.uint64))
_XOR = (_SEEDS[:K] >> np.uint64(32)).astype(np.uint32)[:, None]
_ODD = ((_SEEDS[K:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int = SHINGLE):
    """Sorted distinct shingle hashes of each row."""
    hashes, first = words(raw, off, SPACED)
    grams = gram(hashes, k)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        elif hi > lo:
            yield gram(hashes[lo:hi], hi - lo)
        else:
            yield np.empty(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        np.minimum(out, ((x[None, lo : lo + 1024] ^ _XOR) * _ODD).min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band, of rows of minima."""
    grouped = low.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(77)), grouped.shape[:2]).copy()
    for j in range(ROWS):
        key = mix64(key + grouped[:, :, j])
    return key


def pack(low: np.ndarray) -> np.ndarray:
    """Low bits of the mixed minima as bit planes: rows of PLANES * LONGS words."""
    mixed = mix64(low.astype(np.uint64))
    planes = []
    for b in range(PLANES):
        bits = np.zeros((len(low), LONGS * 64), np.uint8)
        bits[:, :K] = (mixed >> np.uint64(b)) & np.uint64(1)
        planes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(planes, axis=1)


def estimated(disagreeing):
    """Similarity from the count of disagreeing minima, corrected for agreement by chance (number, array or Column)."""
    chance = 2.0**-PLANES
    return (1 - disagreeing / K - chance) / (1 - chance)


def _list_column(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(flat))


def _signatures(batches):
    """doc_id, n_shingles, set_a and set_b (hash of the set), keys, sig."""
    for batch in batches:
        ids = batch.column(0)
        raw, off = utf8(batch.column(1))
        for lo, hi in chunks(off):
            sets = list(shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
            n = np.array([len(s) for s in sets], np.int64)
            low = np.array([minima(s) for s in sets], np.uint32).reshape(-1, K)
            a, b = (np.array([mix64(s ^ np.uint64(seed)).sum(dtype=np.uint64) for s in sets], np.uint64) for seed in (0x1234567, 0xABCDEF01))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _list_column(band_keys(low)), _list_column(pack(low))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "keys", "sig"],
            )
        raw = off = sets = low = None
        give_back()


def signatures(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_signatures, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, sig array<long>")


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter_words(batches):
    for batch in batches:
        slots = np.unique(_slots(batch.column(0).to_numpy()))
        word, at = np.unique(slots >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), at) if len(word) else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents in wanted(node); a filter of fixed size spares most of the others."""
    spark = docs.sparkSession
    found = wanted.mapInArrow(_filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table.tobytes())

    def run(batches):
        bitmap = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            slots = _slots(batch.column(0).to_numpy())
            hit = np.flatnonzero((bitmap[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1))
            part = batch.take(pa.array(hit))
            raw, off = utf8(part.column(1))
            for lo, hi in chunks(off):
                sets = list(shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "shingles"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = texts.mapInArrow(run, "node long, shingles array<long>").join(wanted, "node", "left_semi")
    # repeated rows give equal sets; sets of other texts with the same doc_id stay
    return made.withColumn("as", F.xxhash64("shingles")).dropDuplicates(["node", "as"]).drop("as")


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The distinct pairs (a, b), a table, whose full shingle sets have a Jaccard similarity of percent / 100 or more."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = materialise(_sets_of(docs, ids), "sets")
    per_a = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")), "pairs-of")
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).join(per_a, "a")
    both = salted_join(pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"), of_a, "a", "pairs", "b")
    common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return common.where(F.col("i") * 100 >= percent * (F.col("n") - F.col("i"))).select("a", "b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in edges (a, b): comp is the smallest node reachable.

    Alternating stars: every node hangs its larger neighbours, then its smaller
    ones, under the smallest.  Links are a table of node and parent; nothing
    is gathered in one place, and each round is a table in the shared folder.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = last = None
    while True:
        # large star
        around = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = around.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(low, "u")
        links = materialise(joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct(), "links")
        if last is not None:
            discard(links.sparkSession, last)
        last = links.scratch_path
        now = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node")).distinct().join(links.select(F.col("u").alias("node")), "node", "left_anti")
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))


def _disagreeing(x: str, y: str):
    """Column: how many of the K minima differ in some plane."""
    word = lambda j: reduce(lambda p, q: p.bitwiseOR(q), [F.col(x)[b * LONGS + j].bitwiseXOR(F.col(y)[b * LONGS + j]) for b in range(PLANES)])
    return reduce(lambda p, q: p + q, [F.bit_count(word(j)) for j in range(LONGS)])


def _open_rows(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, comp, main, parts, rest) of the buckets that hold several components; main: of the bucket's largest
    one; parts and rest: into how many parts all its rows, and those outside the largest component, are dealt."""
    placed = members.join(comp, "node", "left").select("key", "node", "n_shingles", F.coalesce("comp", "node").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "comp", "s")).alias("big"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("comps > 1")
    dealt = lambda n, s: F.greatest(F.ceil(n / TILE), F.ceil(s / TILE_SHINGLES), F.lit(1)).cast("int")
    mixed = mixed.select("key", F.col("big.comp").alias("big"), dealt(F.col("n"), F.col("s")).alias("parts"), dealt(F.col("n") - F.col("big.n"), F.col("s") - F.col("big.s")).alias("rest"))
    return materialise(placed.join(mixed, "key").select("key", "node", "comp", (F.col("comp") == F.col("big")).alias("main"), "parts", "rest"), "open")


def _links_of_tile(left, right, percent: int):
    """Confirmed pairs of one tile: for each left row, one with each other component that it has a link to."""

    def arrays(table):
        sig, sets = (table.column(k).combine_chunks() for k in (6, 7))
        bits = np.asarray(sig.flatten()).view(np.uint64).reshape(table.num_rows, PLANES * LONGS)
        return table.column(3).to_numpy(), table.column(4).to_numpy(), bits, np.asarray(sets.value_lengths()), np.asarray(sets.flatten())

    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if left.num_rows and right.num_rows:
        give_back()
        (na, ca, sa, la, ga), (nb, cb, sb, lb, gb) = arrays(left), arrays(right)
        main = right.column(5).to_numpy()
        codes = np.unique(np.concatenate([ga, gb]), return_inverse=True)[1]
        mine, theirs = np.split(codes[: len(ga)], np.cumsum(la)[:-1]), codes[len(ga) :]
        begins, present = np.cumsum(lb) - lb, np.zeros(len(codes), bool)
        for i in range(len(na)):
            x = sb ^ sa[i]
            differ = np.bitwise_count(x[:, :LONGS] | x[:, LONGS:]).sum(axis=1)
            hit = np.flatnonzero((estimated(differ) >= ESTIMATE) & (cb != ca[i]) & (main | (nb > na[i])))
            if not len(hit):
                continue
            present[mine[i]] = True
            common = np.add.reduceat(present[theirs], begins, dtype=np.int64)[hit]
            present[mine[i]] = False
            hit = hit[common * 100 >= percent * (la[i] + lb[hit] - common)]
            hit = hit[np.unique(cb[hit], return_index=True)[1]]
            a.append(np.full(len(hit), na[i]))
            b.append(nb[hit])
    return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})


def _tile_links(docs: DataFrame, rows: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components within the buckets of rows: every part of the rows outside a bucket's
    largest component meets every part of all its rows."""
    wanted = materialise(rows.select("node").distinct(), "wanted")
    full = materialise(_sets_of(docs, wanted).join(sigs, "node"), "sets")

    def side(name: str, chosen: DataFrame, part, other):
        """Names differ by side so that a table can meet itself."""
        put = chosen.withColumns({"part": part, "other": other}).join(full, "node").select("key", "part", "other", "node", "comp", "main", "sig", "shingles")
        named = put.toDF(*[f"{name}_{c}" for c in put.columns])
        return named.groupBy(*named.columns[:3])

    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = side("left", rows.where("not main").withColumn("own", dealt("rest", 1)), F.col("own"), every("parts"))
    right = side("right", rows.withColumn("own", dealt("parts", 2)), every("rest"), F.col("own"))
    return left.cogroup(right).applyInArrow(lambda x, y: _links_of_tile(x, y, percent), "a long, b long").distinct()


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sig = materialise(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # a class is one set; the row with its smallest doc_id stands for it
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.select("set_a", "set_b", F.col("first.doc_id").alias("node"), F.col("first.row").alias("row"), "copies"), "classes")
    nodes = sig.join(classes.select("row"), "row", "left_semi").withColumnRenamed("doc_id", "node")

    rows = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    members = materialise(rows.join(buckets, "key"), "members")
    sigs = materialise(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "sig"), "node-sigs")
    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    # a hub may have very many rows under it
    stars = materialise(stars, "hubs")
    hubs = materialise(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")).join(stars.groupBy("a").agg(F.count(F.lit(1)).alias("rows")), "a"), "hub-sigs")
    stars = salted_join(stars.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b"), hubs, "a", "rows", "b")
    stars = stars.where(estimated(_disagreeing("x", "y")) >= ESTIMATE).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    linked = materialise(confirmed(docs, materialise(stars, "stars"), percent), "linked")
    rows = _open_rows(members, materialise(connected(linked), "components"))
    graph = linked if rows.isEmpty() else materialise(linked.union(_tile_links(docs, rows, sigs, percent)), "graph")
    # texts that share a doc_id are one node, and so are their components
    comp = materialise(connected(graph), "components")

    # copies of a class hang under its node; a class of many copies is joined by broadcast
    named = materialise(classes.join(comp, "node", "left").select("set_a", "set_b", F.coalesce("comp", "node").alias("found"), "copies"), "named")
    out = split_join(sig.select("doc_id", "n_shingles", "set_a", "set_b"), named, ["set_a", "set_b"], "copies", "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near-duplicates: that with the smallest doc_id; rows keep all columns.

    Rows without doc_id are all kept, and so are all rows of a doc_id that is kept.
    """
    gone = components(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
