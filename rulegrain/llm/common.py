"""Shared helpers of the corpus operators: scratch tables and text kernels.

The kernels work on the UTF-8 buffers of Arrow string columns, a bounded
number of bytes at a time, so memory doesn't grow with the number of rows.
Hashes here are position-keyed sums of mixed 64-bit words (a tabulation hash).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: A key is heavy if more than one in so many rows have it; there are fewer such keys than this.
HEAVY = 1000

_SCOPES: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temp folder where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rulegrain-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/rulegrain/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def released(spark: SparkSession):
    """Delete the scratch tables made inside, but for those that keep() was told of, when the block has ended."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            discard(spark, path)


def keep(table: DataFrame) -> DataFrame:
    """Take a scratch table out of the innermost released() block; an outer one gets it."""
    if _SCOPES and table.scratch_path in _SCOPES[-1]:
        _SCOPES[-1].remove(table.scratch_path)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(table.scratch_path)
    return table


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, a scratch table of one row a key that says in `count` how many rows have it.

    Keys with more than 1 / HEAVY of the counted rows are fewer than HEAVY; they are joined by broadcast, so
    no task is given all rows of a frequent key.  The columns but `count` are returned.
    """
    n = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    if not n:
        return rows.join(table.drop(count), keys, how)
    heavy = F.broadcast(table.where(F.col(count) * HEAVY > n).drop(count))
    light = table.where(F.col(count) * HEAVY <= n).drop(count)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(rest.join(light, keys, how))


def salted_join(rows: DataFrame, table: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """rows joined with table, a scratch table of one row a key that says in `count` how many rows have it; for wide tables.

    The rows of a key that more than 1 / HEAVY of the counted rows have are dealt, by a hash of `spread`, into parts of
    about that size, and its table row is copied for each; there are fewer than 2 * HEAVY such copies in all.  Only
    frequent keys and their numbers of parts, fewer than HEAVY rows of two numbers, are broadcast.
    """
    n = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    if not n:
        return rows.join(table.drop(count), key)
    parts = F.ceil(F.col(count) * HEAVY / F.lit(n)).cast("int")
    heavy = F.broadcast(table.where(F.col(count) * HEAVY > n).select(key, parts.alias("__parts")).distinct())
    dealt = rows.join(heavy, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    copies = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.when(F.col(count) * HEAVY > n, parts - 1).otherwise(F.lit(0))))).drop(count)
    return dealt.join(copies, [key, "__part"]).drop("__part")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit avalanche hash (xor-shift-multiply)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_NEAR = 64
_CELL = mix64(np.arange(_NEAR * 256, dtype=np.uint64) + _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words between white space, and bytes of words of letters, digits and non-ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows that hold about limit bytes; a longer text stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def give_back() -> None:
    """Return memory that Arrow holds but doesn't use to the system: workers live on after a stage."""
    pa.default_memory_pool().release_unused()


def words(raw: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each row and the end) after lower-casing A-Z; no word spans rows."""
    return spelt(raw, off, keep)[:2]


def spelt(raw: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), with the lower-cased bytes of all words end to end and each word's place in them (and the end)."""
    n_rows = len(off) - 1
    none = np.empty(0, np.uint64), np.zeros(n_rows + 1, np.int64), np.empty(0, np.uint8), np.zeros(1, np.int64)
    if not len(raw):
        return none
    raw = _LOWER[raw]
    on = keep[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    begins = on.copy()
    begins[1:] &= ~on[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, off)
    if not len(starts):
        return none
    at = np.flatnonzero(on)
    word = np.cumsum(begins[at]) - 1
    pos = at - starts[word]
    heads = np.searchsorted(at, starts)
    letters = raw[at]
    cell = _CELL[(np.minimum(pos, _NEAR - 1) << 8) | letters]
    if (far := np.flatnonzero(pos >= _NEAR)).size:
        cell[far] = mix64((pos[far].astype(np.uint64) << _U(8)) + letters[far] + _U(0x5851F42D4C957F2D))
    places = np.append(heads, len(at))
    return mix64(np.add.reduceat(cell, heads) + np.diff(places).astype(np.uint64)), first, letters, places


_STEP = _U(0x9FB21C651E98DF25)


def gram(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out + hashes[j : j + n]) * _STEP
    return mix64(out + _U(k))
