"""The log and vector store as DataFrames: scans, searches, versions, caches and patches."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.functions.vector import METRICS, literal
from rulegrain.operators.scratch import materialise


# -- scans


def scan(log: DataFrame, limit: int, ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """Newest rows first; ties by the given columns, ascending."""
    return log.orderBy(F.col(ts).desc(), *(tie or [])).limit(limit)


def scan_window(log: DataFrame, lo, hi, limit: int, ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """Newest first in [lo, hi); the range reaches the scan as a filter."""
    return scan(log.where((F.col(ts) >= F.lit(lo)) & (F.col(ts) < F.lit(hi))), limit, ts, tie)


def storage_scan(events: DataFrame, stream: str | None = None, limit: int = 50) -> DataFrame:
    rows = events if stream is None else events.where(F.col("stream") == stream)
    return rows.orderBy(F.col("timestamp_ns").desc(), F.col("instance_id").desc(), F.col("sequence").desc()).limit(limit)


# -- nearest neighbours


def distance(column: Column, query: list[float], metric: str | object = "cosine") -> Column:
    """Column of distances; a metric is a name or a builder (column, query column) -> Column."""
    make = METRICS[metric] if isinstance(metric, str) else metric
    return make(column, literal(query))


def ann(rows: DataFrame, query: list[float], k: int, index: str = "embedding", metric="cosine", tie: list[str] | None = None) -> DataFrame:
    """The k nearest rows, exactly: each task keeps k, so nothing but those moves."""
    near = rows.where(F.size(index) == len(query)).withColumn("distance", distance(F.col(index), query, metric))
    return near.orderBy("distance", *(tie or [])).limit(k)


def ann_window(rows: DataFrame, query: list[float], k: int, lo, hi, ts: str = "ts", **kw) -> DataFrame:
    """As ann() among the rows of [lo, hi); filtered first, so k rows come back where they exist."""
    return ann(rows.where((F.col(ts) >= F.lit(lo)) & (F.col(ts) < F.lit(hi))), query, k, **kw)


def ann_multi(rows: DataFrame, key: str, queries: dict[str, tuple[list[float], int]], mode: str, final_k: int, metric="cosine") -> DataFrame:
    """Several indexes: "intersect" sums the distances of keys found in all, "union" takes the smallest."""
    parts = [ann(rows, q, k, index, metric, [key]).select(key, "distance") for index, (q, k) in queries.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if mode == "intersect":
        out = found.groupBy(key).agg(F.sum("distance").alias("distance"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(parts)).drop("n")
    elif mode == "union":
        out = found.groupBy(key).agg(F.min("distance").alias("distance"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return out.orderBy("distance", key).limit(final_k)


def search(events: DataFrame, stream: str, model: str, query: list[float], k: int, **flags) -> DataFrame:
    """Live events of a stream and model by cosine distance, then newest."""
    rows = live(events, **flags).where((F.col("stream") == stream) & (F.col("embedding_model") == model) & (F.size("vector") == len(query)))
    return rows.withColumn("distance", distance(F.col("vector"), query)).orderBy("distance", F.col("timestamp_ns").desc()).limit(k)


def with_tags(rows: DataFrame, wanted: list[str], tags: str = "tags") -> DataFrame:
    """Rows that carry all the wanted tags."""
    return rows.where(F.size(F.array_except(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"), F.coalesce(F.col(tags), F.array().cast("array<string>")))) == 0)


def memory_search(events: DataFrame, stream: str, model: str, query: list[float], k: int, tags: list[str] | None = None, prefilter: bool = False) -> DataFrame:
    """search(), then the tag filter; prefilter=True filters first."""
    if not tags:
        return search(events, stream, model, query, k)
    return search(with_tags(events, tags), stream, model, query, k) if prefilter else with_tags(search(events, stream, model, query, k), tags)


# -- versions


def live(events: DataFrame, include_superseded: bool = False, include_tombstones: bool = False, id: str = "id") -> DataFrame:
    """Events that no event of any stream supersedes, without tombstones."""
    out = events
    if not include_superseded:
        gone = events.where("supersedes is not null").select(F.col("supersedes").alias(id)).distinct()
        out = out.join(gone, id, "left_anti")
    return out if include_tombstones else out.where(~F.coalesce("tombstone", F.lit(False)))


def lineage(events: DataFrame, start: DataFrame, id: str = "id", rounds: int = 64) -> DataFrame:
    """(root, id, depth): the chain of superseded events of every start id, by doubling.

    Every round joins links of length 2^r with themselves, so a chain of n events takes
    log2(n) rounds; a cycle adds nothing once its events are known.
    """
    links = events.where("supersedes is not null").select(F.col(id).alias("a"), F.col("supersedes").alias("b")).distinct()
    reach = start.select(F.col(id).alias("root"), F.col(id).alias("id"), F.lit(0).cast("long").alias("depth"))
    jump, size, before = links, 1, reach.count()
    for _ in range(rounds):
        more = reach.join(jump, reach["id"] == jump["a"]).select("root", F.col("b").alias("id"), (F.col("depth") + size).alias("depth"))
        reach = reach.unionByName(more).groupBy("root", "id").agg(F.min("depth").alias("depth")).checkpoint()
        now = reach.count()
        if now == before:
            break
        before, size = now, 2 * size
        jump = jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).distinct().checkpoint()
    return reach


def last_writer(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key; rows are compared where they are before they move."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x")).select(key, "x.*")


def cache_live(records: DataFrame) -> DataFrame:
    """Entries of the cache whose generation reaches the current epoch, the latest of each key."""
    epoch = records.where("kind = 'epoch'").agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("now"))
    entries = last_writer(records.where("kind = 'entry'").drop("epoch"), "key", ["created_ts", "generation"])
    return entries.join(F.broadcast(epoch), F.col("generation") >= F.col("now")).drop("now")  # one row


def cache_ttl(events: DataFrame, now_ns: int, ttl_s: int = 3600, key: str = "cache_id") -> DataFrame:
    """The newest event of each cache_id if it is within the time to live; a stale newest hides older ones."""
    return last_writer(events, key, ["timestamp_ns"]).where(F.col("timestamp_ns") >= now_ns - ttl_s * 10**9)


def cache_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def resolve_embeddings(texts: DataFrame, tiers: list[DataFrame], compute, key: str = "text") -> DataFrame:
    """texts with vector and tier: from the first tier that has the key, else computed once for each distinct missing key."""
    out = texts.withColumn("vector", F.lit(None).cast("array<float>")).withColumn("tier", F.lit(None).cast("int"))
    for i, tier in enumerate(tiers):
        known = tier.select(F.col(key).alias("__k"), F.col("vector").alias("__v")).dropDuplicates(["__k"])
        out = out.join(known, F.col(key) == F.col("__k"), "left")
        out = out.withColumn("tier", F.coalesce("tier", F.when(F.col("__v").isNotNull(), F.lit(i)))).withColumn("vector", F.coalesce("vector", "__v")).drop("__k", "__v")
    missing = out.where(F.col("vector").isNull() & F.col(key).isNotNull()).select(key).distinct()
    made = missing.select(F.col(key).alias("__k"), compute(F.col(key)).cast("array<float>").alias("__v"))
    out = out.join(made, F.col(key) == F.col("__k"), "left")
    return out.withColumn("tier", F.coalesce("tier", F.when(F.col("__v").isNotNull(), F.lit(len(tiers))))).withColumn("vector", F.coalesce("vector", "__v")).drop("__k", "__v")


# -- rows and domains


def put(log: DataFrame, rows: DataFrame, dims: dict[str, int]) -> DataFrame:
    """log with rows appended; a row whose vector has the wrong dimension is an error before anything is written."""
    for index, dim in dims.items():
        fits = F.col(index).isNull() | (F.size(index) == dim)
        rows = rows.withColumn(index, F.when(fits, F.col(index)).otherwise(F.raise_error(F.lit(f"index {index} needs dimension {dim}")).cast(rows.schema[index].dataType)))
    return log.unionByName(rows)


def add_vector(log: DataFrame, vectors: DataFrame, key: str, index: str, order: str | None = None) -> DataFrame:
    """log with vectors of existing rows set; a key that the log doesn't have is an error (see orphans).

    Of several vectors for a key the one with the highest `order` counts, without it the largest vector.
    """
    others = [F.col(order)] if order else []
    new = vectors.groupBy(F.col(key)).agg(F.max(F.struct(*others, F.col("vector").alias("__v")))["__v"].alias("__v"))
    both = log.withColumn("__in", F.lit(True)).join(new, key, "full_outer")
    known = F.when(F.col("__in"), F.coalesce("__v", F.col(index))).otherwise(F.raise_error(F.concat(F.lit("no row for key "), F.col(key).cast("string"))).cast(log.schema[index].dataType))
    return both.withColumn(index, known).drop("__v", "__in")


def get(log: DataFrame, value, key: str) -> DataFrame:
    """The row of a key, or none."""
    return log.where(F.col(key) == F.lit(value))


def index_len(log: DataFrame, index: str) -> int:
    """Rows that have a vector in the index."""
    return log.where(F.col(index).isNotNull()).count()


def detail_backfill(log: DataFrame, coarse: str, detail: str, compute, source: str) -> DataFrame:
    """log with the detail vectors that rows with a coarse one lack, made from their source texts.

    One pass over the rows without a detail vector; there is no queue, so none is dropped.
    """
    lacking = F.col(detail).isNull() & F.col(coarse).isNotNull() & F.col(source).isNotNull()
    made = compute(F.when(lacking, F.col(source))).cast(log.schema[detail].dataType)
    return log.withColumn(detail, F.when(lacking, made).otherwise(F.col(detail)))


def dual_search(rows: DataFrame, key: str, field: str, coarse: list[float], detail: list[float], k: int, metric="cosine", oversample: int = 4) -> DataFrame:
    """The k nearest keys by the smaller of the distances in `field`__canon and `field`; rows may lack either vector."""
    return ann_multi(rows, key, {f"{field}__canon": (coarse, k * oversample), field: (detail, k * oversample)}, "union", k, metric)


def resolve(found: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """found (key, distance) with the rows of the log; a key without a row is an error."""
    both = found.join(log.withColumn("__in", F.lit(True)), key, "left")
    good = F.when(F.col("__in"), F.col("distance")).otherwise(F.raise_error(F.concat(F.lit("no row for key "), F.col(key).cast("string"))).cast("double"))
    return both.withColumn("distance", good).drop("__in")


# -- keys


def inverse_time_key(ts_ns: Column, tie: Column | None = None) -> Column:
    """20 digits that sort newest first, and the tie."""
    inverse = F.lpad((F.lit((1 << 63) - 1) - ts_ns).cast("string"), 20, "0")
    return inverse if tie is None else F.concat_ws("-", inverse, tie)


def content_key(*parts: Column) -> Column:
    """32 hex digits of the content: each part with its length, so that parts can't run into one another."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat(*(x for t in texts for x in (F.octet_length(t).cast("string"), F.lit(":"), t))), 256), 1, 32)


KEYS = {"inverse-time": inverse_time_key, "content": content_key}


# -- memory: facts of agents, as events


def memory_event(kind: str, facts: DataFrame, session: str, timestamp_ns: Column, embed=None, model: str | None = None) -> DataFrame:
    """Events for files.append_events: kind "write" (fact, tags), "update" (id, fact, tags) or "delete" (id, reason)."""
    if kind not in ("write", "update", "delete"):
        raise ValueError(f"unknown kind {kind}")
    source = F.lit(f"agent:{session}").alias("source")
    has = lambda c, default: F.col(c) if c in facts.columns else default
    if kind == "delete":
        payload = F.to_json(F.struct(has("reason", F.lit(None).cast("string")).alias("reason"), source))
    else:
        payload = F.to_json(F.struct("fact", F.coalesce(has("tags", F.lit(None).cast("array<string>")), F.array().cast("array<string>")).alias("tags"), source))
    none = F.lit(None)
    vector = embed(F.col("fact")).cast("array<float>") if embed is not None and kind != "delete" else none.cast("array<float>")
    named = F.lit(model) if embed is not None and kind != "delete" else none.cast("string")
    return facts.select(F.lit("memory").alias("stream"), F.lit(kind).alias("kind"), timestamp_ns.alias("timestamp_ns"), payload.alias("payload"), vector.alias("vector"), named.alias("embedding_model"), (F.col("id") if kind != "write" else none.cast("string")).alias("supersedes"), F.lit(kind == "delete").alias("tombstone"))


def memory_history(events: DataFrame, id: str) -> DataFrame:
    """The event and what it supersedes, newest first, whole."""
    start = events.where(F.col("id") == id).select("id")
    return lineage(events, start).join(events, "id").drop("root").orderBy("depth")


def memory_stats(events: DataFrame) -> DataFrame:
    """One row: live facts, all writes, updates and deletes."""
    memory = events.where("stream = 'memory'")
    kinds = memory.agg(F.count_if(F.col("kind") == "write").alias("writes"), F.count_if(F.col("kind") == "update").alias("updates"), F.count_if(F.col("kind") == "delete").alias("deletes"))
    return kinds.crossJoin(F.broadcast(live(memory).agg(F.count(F.lit(1)).alias("facts"))))  # one row each


def session_scan(events: DataFrame, session: str, limit: int, newest: int = 10_000) -> DataFrame:
    """The last events of a session among the newest so many."""
    return storage_scan(storage_scan(events, None, newest).where(F.get_json_object("payload", "$.session") == session), None, limit)


def orphans(log: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    return vectors.join(log, key, "left_anti")


def delete(log: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return log.join(keys, key, "left_anti")


def retain(log: DataFrame, keep: Column | None = None) -> DataFrame:
    """Compaction: rows that the policy keeps (all by default)."""
    return log if keep is None else log.where(keep)


class Store:
    """Logs by domain; a domain is [a-z0-9-]+ and unique."""

    def __init__(self):
        self.logs: dict[str, DataFrame] = {}

    def open(self, domain: str, log: DataFrame) -> None:
        if not re.fullmatch(r"[a-z0-9-]+", domain):
            raise ValueError(f"not a domain: {domain!r}")
        if domain in self.logs:
            raise ValueError(f"domain {domain} is open")
        self.logs[domain] = log


# -- patches


def patch(old: DataFrame, new: DataFrame, id: str = "id") -> DataFrame:
    """(op, id, ord): what turns old into new: deletes before upserts; changed rows are deleted and set anew."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*(c for c in df.columns if c != id))), 256)
    a, b = old.select(F.col(id).alias("a"), digest(old).alias("ha")), new.select(F.col(id).alias("b"), digest(new).alias("hb"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    ops = F.filter(F.array(F.when(F.col("hb").isNull() | (F.col("ha") != F.col("hb")), F.lit("delete")), F.when(F.col("ha").isNull() | (F.col("ha") != F.col("hb")), F.lit("upsert"))), lambda x: x.isNotNull())
    return both.select(F.coalesce("a", "b").alias(id), F.explode(ops).alias("op")).withColumn("ord", F.when(F.col("op") == "delete", 0).otherwise(1))


def apply_patch(old: DataFrame, ops: DataFrame, new: DataFrame, id: str = "id") -> DataFrame:
    gone = old.join(ops.where("op = 'delete'").select(id).distinct(), id, "left_anti")
    return gone.unionByName(new.join(ops.where("op = 'upsert'").select(id).distinct(), id, "left_semi"))


def replay(ops: DataFrame, id: str = "id") -> DataFrame:
    """Rows (id, op, ord, ...) that stand after all operations: the last of each id, unless it deletes."""
    return last_writer(ops, id, ["ord"]).where("op <> 'delete'")


# -- statistics


def tool_stats(activity: DataFrame, newest: int | None = 100_000, tie: list[str] | None = None) -> DataFrame:
    """Calls, errors and the last call of each tool among the newest events (None: all); events without a tool count as such, but aren't shown."""
    rows = activity if newest is None else activity.orderBy(F.col("ts").desc(), *(tie or [])).limit(newest)
    return rows.where("tool is not null").groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("errors"), F.max("ts").alias("last_called"))


def stream_counts(events: DataFrame, stream: str = "stream") -> DataFrame:
    return events.groupBy(stream).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, session: str) -> DataFrame:
    """Distinct sessions, in order."""
    return events.select(session).where(F.col(session).isNotNull()).distinct().orderBy(session)


def timings(samples: DataFrame, by: list[str], value: str, bins: int = 64) -> DataFrame:
    """n, mean, p50, p95, p99 and max of measured values; percentiles are the nearest-rank ones, exact for any number of values.

    A group's distinct values are counted and dealt to bins at approximate percentiles; only the bins that hold a wanted rank are put in order.
    """
    kept = samples.select(F.struct(*by).alias("__key"), F.col(value).alias("__v"))
    cuts = F.percentile_approx("__v", [i / bins for i in range(1, bins)], 1000)
    groups = kept.groupBy("__key").agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.max("__v").alias("max"), cuts.alias("__cuts"))
    groups = materialise(groups, "timings-groups")
    bin_of = F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
    counted = kept.where("__v is not null").groupBy("__key", "__v").agg(F.count(F.lit(1)).alias("__m")).join(groups.select("__key", "__cuts"), "__key")
    counted = materialise(counted.select("__key", "__v", "__m", bin_of.alias("__bin")), "timings-values")
    # at most `bins` rows a group: how many values stand in earlier bins
    upto = F.sum("__size").over(Window.partitionBy("__key").orderBy("__bin"))
    sizes = counted.groupBy("__key", "__bin").agg(F.sum("__m").alias("__size")).withColumn("__upto", upto)
    ranks = F.array(*(F.struct(F.lit(p).alias("p"), F.expr(f"(n * {p} + 99) div 100").alias("r")) for p in (50, 95, 99)))
    wanted = sizes.join(groups.select("__key", "n"), "__key").withColumn("__rank", F.explode(ranks))
    wanted = wanted.where((F.col("__rank.r") > F.col("__upto") - F.col("__size")) & (F.col("__rank.r") <= F.col("__upto")))
    wanted = wanted.groupBy("__key", "__bin").agg(F.first(F.col("__upto") - F.col("__size")).alias("__before"), F.collect_list("__rank").alias("__ranks"))
    place = F.sum("__m").over(Window.partitionBy("__key", "__bin").orderBy("__v"))
    ordered = counted.join(wanted, ["__key", "__bin"]).withColumn("__end", F.col("__before") + place)
    hit = lambda p: F.max(F.when(F.exists("__ranks", lambda x: (x["p"] == p) & (x["r"] <= F.col("__end")) & (x["r"] > F.col("__end") - F.col("__m"))), F.col("__v")))
    found = ordered.groupBy("__key").agg(*(hit(p).alias(f"p{p}") for p in (50, 95, 99)))
    return groups.join(found, "__key", "left").select("__key.*", "n", "mean", "p50", "p95", "p99", "max")


def near_duplicates(rows: DataFrame, id: str, hash: str, threshold: int = 3, blocks: int = 6) -> DataFrame:
    """(id, first): the first earlier row (by id) whose 64-bit hash is within threshold bits.

    The bits are cut into blocks; two hashes within threshold bits agree on all but `threshold` of them, so an
    equi-join on every choice of blocks - threshold blocks finds all pairs (with 6 blocks and 3 bits: 20 keys of about 32 bits).
    Rows of equal hash are one candidate, and a hash only looks for those that stand earlier.
    """
    rows = materialise(rows.select(id, hash), "near-rows")  # hashes may cost much, and are read more than once
    edge = [64 * i // blocks for i in range(blocks + 1)]
    firsts = rows.groupBy(F.col(hash).alias("h")).agg(F.min(id).alias("first"))
    mask = lambda chosen: sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in chosen)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = [F.struct(F.lit(n).alias("choice"), F.col("h").bitwiseAND(F.lit(signed(mask(c))).cast("long")).alias("bits")) for n, c in enumerate(combinations(range(blocks), blocks - threshold))]
    banded = firsts.withColumn("key", F.explode(F.array(*key)))
    a, b = banded.select(F.col("h").alias("ha"), F.col("first").alias("fa"), "key"), banded.select(F.col("h").alias("hb"), F.col("first").alias("fb"), "key")
    near = a.join(b.hint("merge"), "key").where((F.col("fb") < F.col("fa")) & (F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= threshold)).groupBy("ha").agg(F.min("fb").alias("near"))
    known = firsts.join(near, F.col("h") == F.col("ha"), "left").select("h", "first", F.least("first", F.coalesce("near", "first")).alias("least"))
    # a class of equal hashes: its later rows point at its first, and all at an earlier near one.  Rows before the class's first near one don't exist.
    out = rows.select(F.col(id), F.col(hash).alias("h")).join(known, "h")
    return out.select(id, F.when(F.col("least") < F.col(id), F.col("least")).alias("first"))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
