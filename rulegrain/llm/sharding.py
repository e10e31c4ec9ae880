"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has `CELLS` equal cells; a row's cell comes from a hash of its text, so
equal texts go the same way.  Virtual nodes of every shard sit on cells; a cell
belongs to the first of them clockwise.  A shard takes its own keys up to
the load bound floor(n / shards); keys beyond it continue clockwise to shards
with room, and the last n mod shards keys add one row to a shard each.  Counts
are therefore at most one apart (law "rows").  One more shard takes rows into itself, and
the lower bound makes some more overflow: of 100,000 distinct texts 24 to 25 shards move 6 to 7 %
(4 % must move), a third of them between old shards.

Rows are only counted for each cell; the ring is walked on the driver over those
`CELLS` counts (a fixed number), giving each cell's ranges of ranks for each shard.
Ranks come from counts of (cell, salt), so a group of equal texts, in one cell,
is numbered by many tasks.  Main path: DataFrame functions only.

Defined cases: a null text has size 8, crc null, and a cell of its own hash;
null or repeated doc_ids are rows like others (those without doc_id are spread by their
place in the table); an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.llm.common import materialise

SHARDS, VNODES, CELLS = 24, 64, 4096
#: Salts of a cell: at least so many, and one for each so many rows.
SALTS, ROWS_PER_SALT = 256, 1 << 22


def ring(shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS) -> list[list[int]]:
    """For each cell its shards in clockwise order, the owner first."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") % cells
    points = sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))
    starts = [p for p, _ in points]
    out = []
    for cell in range(cells):
        i = bisect_left(starts, cell)
        seen = dict.fromkeys(points[(i + j) % len(points)][1] for j in range(len(points)))
        out.append(list(seen))
    return out


def quotas(counts: dict[int, int], shards: int = SHARDS, order: list[list[int]] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(cell, lo, hi, shard, slot of lo): ranks lo to hi - 1 of a cell go to a shard; counts are at most one apart."""
    order = order or ring(shards)
    n = sum(counts.values())
    room = [n // shards] * shards
    used, out = [0] * shards, []
    placed = dict.fromkeys(counts, 0)

    def put(cell: int, shard: int, most: int) -> None:
        take = min(most, counts[cell] - placed[cell])
        if take > 0:
            out.append((cell, placed[cell], placed[cell] + take, shard, used[shard]))
            placed[cell] += take
            used[shard] += take

    for cell in sorted(counts):
        put(cell, order[cell][0], room[order[cell][0]] - used[order[cell][0]])
    for extra in (0, 1):
        for cell in sorted(counts):
            for shard in order[cell]:
                if placed[cell] == counts[cell]:
                    break
                put(cell, shard, room[shard] + extra - used[shard])
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    h = F.xxhash64(text)
    rows = materialise(
        docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("h"), F.pmod(F.shiftrightunsigned(h, 20), F.lit(CELLS)).cast("int").alias("cell"), F.xxhash64(F.lit(7), "doc_id", h, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).alias("o")),
        "shard-rows",
    )
    n = rows.count()
    salts = max(SALTS, -(-n // ROWS_PER_SALT))
    rows = rows.withColumn("salt", F.pmod("o", F.lit(salts)))
    tally = materialise(rows.groupBy("cell", "salt").count(), "shard-tally")
    counts = {r["cell"]: r["count"] for r in tally.groupBy("cell").agg(F.sum("count").alias("count")).collect()}  # CELLS rows at most
    plan = spark.createDataFrame(quotas(counts, shards), "cell int, lo long, hi long, shard int, slot0 long")  # CELLS * (shards + 1) rows at most
    plan = plan.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("hi", "lo", "shard", "slot0"))).alias("ranges"))
    before = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select("cell", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")).join(plan, "cell")
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("cell", "salt").orderBy("h", "o", "doc_id")))
    placed = ranked.join(tally, ["cell", "salt"]).withColumn("rank", F.col("base") + F.col("rn") - 1)
    mine = F.filter("ranges", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0]
    placed = placed.withColumn("to", mine)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("to.shard").alias("shard"), (F.col("to.slot0") + F.col("rank") - F.col("to.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
