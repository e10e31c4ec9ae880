"""Readers and writers: event and cache segments, address CSV, artifacts, snapshots.

All paths go through Spark's readers or the Hadoop file system, so any store
that Spark knows will do.
"""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "id string, stream string, kind string, timestamp_ns bigint, instance_id string, sequence bigint, payload string, vector array<float>, embedding_model string, supersedes string, tombstone boolean"
CACHE = "kind string, key string, created_ts bigint, generation int, vector array<float>, epoch int"


def _hadoop(spark: SparkSession, root: str):
    """The Hadoop file system of a path, and a function that makes its paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def segment_files(spark: SparkSession, root: str, pattern: str = "events-*.jsonl") -> list[tuple[str, int]]:
    """(path, bytes) of the segments, by name."""
    fs, path = _hadoop(spark, root)
    return sorted((f.getPath().toString(), f.getLen()) for f in fs.globStatus(path(f"{root}/{pattern}")) or [])


def torn_tails(spark: SparkSession, files: list[tuple[str, int]]) -> dict[str, int]:
    """For segments whose last line has no line feed: how many of their bytes are complete lines.  Reads the ends of the files only."""
    out = {}
    for name, size in files:
        fs, path = _hadoop(spark, name)
        stream = fs.open(path(name))
        try:
            at = size
            while at > 0:
                step = min(at, 1 << 16)
                if at == size:
                    step = 1
                stream.seek(at - step)
                block = bytes(stream.readNBytes(step))
                if at == size and block == b"\n":
                    break
                cut = block.rfind(b"\n")
                if cut >= 0:
                    out[name] = at - step + cut + 1
                    break
                at -= step
            else:
                if size:
                    out[name] = 0
        finally:
            stream.close()
    return out


def read_segments(spark: SparkSession, root: str, schema: str = EVENT, pattern: str = "events-*.jsonl") -> DataFrame:
    """Rows of the JSON-lines segments; blank lines are skipped, and a complete line that can't be read is an error.

    What follows the last line feed of a segment is a torn line, whatever it holds, and is left out.
    """
    files = segment_files(spark, root, pattern)
    whole = spark.createDataFrame([], schema)
    if not files:
        return whole
    torn = torn_tails(spark, files)
    shape = f"{schema}, _corrupt string"

    def parsed(lines: DataFrame) -> DataFrame:
        made = lines.where(F.length(F.trim("value")) > 0).select("file", F.from_json("value", shape, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
        bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
        wrong = F.raise_error(F.concat(F.lit("bad line in "), F.col("file"))).cast(made.schema["r"].dataType)
        return made.withColumn("r", F.when(bad, wrong).otherwise(F.col("r"))).select("r.*").drop("_corrupt")

    complete = [name for name, size in files if name not in torn and size]
    out = parsed(spark.read.text(complete).select("value", F.col("_metadata.file_path").alias("file"))) if complete else whole
    for name, size in torn.items():
        if size:  # an open segment: its complete lines are cut off by their number of bytes
            head = spark.read.format("binaryFile").load(name).select(F.col("path").alias("file"), F.explode(F.split(F.substring("content", 1, size).cast("string"), "\n")).alias("value"))
            out = out.unionByName(parsed(head))
    return out


def recover_segments(spark: SparkSession, root: str, pattern: str = "events-*.jsonl") -> list[str]:
    """Cut torn lines off: the complete lines are written beside the segment, which they then replace. Gives the segments cut."""
    fs, path = _hadoop(spark, root)
    torn = torn_tails(spark, segment_files(spark, root, pattern))
    for name, size in torn.items():
        source, copy = fs.open(path(name)), path(f"{name}.recovered")
        sink = fs.create(copy, True)
        try:
            left = size
            while left > 0:
                block = bytes(source.readNBytes(min(left, 1 << 20)))
                sink.write(bytearray(block))
                left -= len(block)
        finally:
            sink.close()
            source.close()
        fs.delete(path(name), False)
        fs.rename(copy, path(name))
    return sorted(torn)


def numbered(rows: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Adds name: start, start + 1, ... in the given order; sorted by ranges, whose counts are added up."""
    from rulegrain.operators.scratch import scratch_path

    spark, to = rows.sparkSession, scratch_path(rows.sparkSession, "numbered")
    rows.orderBy(*order).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).write.parquet(to)
    kept = spark.read.schema(rows.withColumns({"__range": F.lit(0), "__at": F.lit(0).cast("long")}).schema).parquet(to)
    counts = kept.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).orderBy("__range").collect()  # a row for each range
    base, at = [], start
    for r in counts:
        base.append((r["__range"], at - r["first"]))
        at += r["n"]
    known = spark.createDataFrame(base, "__range int, __base long")
    return kept.join(F.broadcast(known), "__range").withColumn(name, F.col("__at") + F.col("__base")).drop("__range", "__at", "__base")


def _append(rows: DataFrame, root: str, prefix: str) -> list[str]:
    """Rows as JSON-lines segments `prefix`-<time>-<part>.jsonl in root; files appear whole or, if the job fails, not at all."""
    spark = rows.sparkSession
    fs, path = _hadoop(spark, root)
    tag = uuid.uuid4().hex
    staged = f"{root}/.staged-{tag}"
    try:
        rows.write.option("ignoreNullFields", True).json(staged)
        parts = sorted(f.getPath().toString() for f in fs.globStatus(path(f"{staged}/part-*")) if f.getLen())
        names = [f"{root}/{prefix}-{time.time_ns():020d}-{tag[:8]}-{i:05d}.jsonl" for i in range(len(parts))]
        for part, name in zip(parts, names, strict=True):
            if not fs.rename(path(part), path(name)):
                raise OSError(f"can't put segment {name}")
        return names
    finally:
        fs.delete(path(staged), True)


def append_events(events: DataFrame, root: str, instance: str) -> DataFrame:
    """Append events to the instance's segments, numbered on from its last one; gives the events as written.

    events: stream, kind, timestamp_ns, payload and, as far as there are, vector, embedding_model, supersedes,
    tombstone.  An event needs a stream, and a vector exactly with its model; a bad one is an error before anything is
    written.  The id comes from instance, number, time, stream and payload.
    """
    if not instance or "/" in instance:
        raise ValueError(f"not an instance: {instance!r}")
    spark = events.sparkSession
    for c, kind in (("vector", "array<float>"), ("embedding_model", "string"), ("supersedes", "string"), ("tombstone", "boolean"), ("kind", "string"), ("payload", "string")):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast(kind))
    named = (F.length(F.coalesce("stream", F.lit(""))) > 0) & (F.col("vector").isNull() == F.col("embedding_model").isNull()) & (F.length(F.trim(F.coalesce("embedding_model", F.lit("x")))) > 0)
    sound = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(True))
    stream = F.when(named & sound, F.col("stream")).otherwise(F.raise_error(F.lit("an event needs a stream, and a sound vector exactly with its model")).cast("string"))
    last = read_segments(spark, root).where(F.col("instance_id") == instance).agg(F.max("sequence")).first()[0]
    rows = numbered(events.withColumn("stream", stream), ["timestamp_ns", "stream", "kind", "payload"], "sequence", 0 if last is None else last + 1)
    id = F.sha2(F.concat_ws("\u0000", F.lit(instance), F.col("sequence").cast("string"), F.col("timestamp_ns").cast("string"), "stream", F.coalesce("payload", F.lit("null"))), 256)
    rows = rows.withColumns({"id": id, "instance_id": F.lit(instance), "tombstone": F.coalesce("tombstone", F.lit(False)), "vector": F.col("vector").cast("array<float>")})
    names = _append(rows.select(*(x.split()[0] for x in EVENT.split(", "))), root, f"events-{instance}")
    return spark.read.schema(EVENT).json(names) if names else spark.createDataFrame([], EVENT)


def storage_stats(spark: SparkSession, root: str) -> dict:
    """Segments, bytes, events and events by stream."""
    files = segment_files(spark, root)
    streams = {r["stream"]: r["count"] for r in read_segments(spark, root).groupBy("stream").count().collect()}  # a row for each stream
    return {"segments": len(files), "bytes": sum(size for _, size in files), "events": sum(streams.values()), "streams": dict(sorted(streams.items()))}


class Cache:
    """A cache of vectors by key in segments cache-*.jsonl: put stamps the epoch, expire begins a new one, and what is older isn't found."""

    def __init__(self, spark: SparkSession, root: str, instance: str = "main"):
        self.spark, self.root, self.instance = spark, root, instance
        fs, path = _hadoop(spark, root)
        fs.mkdirs(path(root))

    def records(self) -> DataFrame:
        return read_segments(self.spark, self.root, CACHE, "cache-*.jsonl")

    def epoch(self) -> int:
        return self.records().where("kind = 'epoch'").agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]

    def put(self, entries: DataFrame, created_ts: int) -> int:
        """Add (key, vector) rows; an empty key or a vector that is empty, zero or not finite is an error."""
        good = (F.length(F.coalesce("key", F.lit(""))) > 0) & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
        key = F.when(good, F.col("key")).otherwise(F.raise_error(F.lit("an entry needs a key and a sound vector")).cast("string"))
        now = self.epoch()
        _append(entries.select(F.lit("entry").alias("kind"), key.alias("key"), F.lit(created_ts).cast("long").alias("created_ts"), F.lit(now).alias("generation"), F.col("vector").cast("array<float>").alias("vector")), self.root, f"cache-{self.instance}")
        return now

    def expire(self, created_ts: int) -> int:
        new = self.epoch() + 1
        _append(self.spark.range(1).select(F.lit("epoch").alias("kind"), F.lit(new).alias("epoch"), F.lit(created_ts).cast("long").alias("created_ts")), self.root, f"cache-{self.instance}")
        return new

    def live(self) -> DataFrame:
        from rulegrain.operators.store import cache_live

        return cache_live(self.records())

    def get(self, keys: DataFrame) -> DataFrame:
        """keys (key) with found, vector, generation and created_ts."""
        held = self.live().select("key", "vector", "generation", "created_ts")
        return keys.join(held, "key", "left").withColumn("found", F.col("generation").isNotNull())

    def stats(self) -> dict:
        files = segment_files(self.spark, self.root, "cache-*.jsonl")
        return {"entries": self.live().count(), "epoch": self.epoch(), "segments": len(files), "bytes": sum(size for _, size in files)}


def read_addresses(spark: SparkSession, path: str, source: str, generation: int = 0) -> DataFrame:
    """Address CSV: upper-case header, trimmed, empties null, SOURCE added, COUNTRY by default US, rows without number or street left out, with a stable id."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip().upper()) for c in raw.columns))
    for c in ("ID", "HASH", "NUMBER", "STREET", "CITY", "REGION", "POSTCODE"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    country = F.coalesce(F.col("COUNTRY"), F.lit("US")) if "COUNTRY" in rows.columns else F.lit("US")
    rows = rows.withColumns({"SOURCE": F.lit(source), "COUNTRY": country}).where("NUMBER is not null and STREET is not null")
    content = F.substring(F.sha2(F.concat_ws("|", "NUMBER", "STREET", "CITY", "REGION", "POSTCODE"), 256), 1, 20)
    return rows.withColumn("id", F.concat(F.lit(f"oa:{source}:"), F.coalesce("ID", "HASH", content))).withColumn("generation", F.lit(generation))


def write_artifact(ops: DataFrame, path: str, manifest: dict) -> None:
    spark = ops.sparkSession
    ops.write.mode("overwrite").json(f"{path}/rows")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_artifact(spark: SparkSession, path: str, schema: str) -> tuple[dict, DataFrame]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return manifest, spark.read.schema(schema).json(f"{path}/rows")


def validate_manifest(manifest: dict, domain: str, dim: int, version: int = 1) -> None:
    for key, wanted in (("schema", version), ("domain", domain), ("dim", dim)):
        if manifest.get(key) != wanted:
            raise ValueError(f"manifest {key}: {manifest.get(key)!r}, expected {wanted!r}")


class Snapshots:
    """Generations of a table: Parquet folders gen=N, and a manifest of those that live, written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """Those of the manifest with the highest number."""
        found = sorted((f.getPath().getName(), f.getPath().toString()) for f in self._fs.globStatus(self._path(f"{self.root}/manifest-*")) or [])
        if not found:
            return []
        return sorted(int(x) for x in self.spark.read.text(found[-1][1]).first()[0].split(",")[1:])

    def _manifest(self, live: list[int]) -> None:
        """A new manifest, made whole and then renamed; older ones go after it."""
        old = sorted(f.getPath().toString() for f in self._fs.globStatus(self._path(f"{self.root}/manifest-*")) or [])
        number = int(old[-1].rsplit("-", 1)[1]) + 1 if old else 0
        staged = self._path(f"{self.root}/.staged-{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(bytearray(",".join(["live", *map(str, live)]).encode()))
        out.close()
        if not self._fs.rename(staged, self._path(f"{self.root}/manifest-{number:012d}")):
            raise OSError("another writer has put this manifest")
        for name in old:
            self._fs.delete(self._path(name), False)

    def publish(self, df: DataFrame) -> int:
        live = self.generations()
        new = max(live, default=-1) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/gen={new}")
        self._manifest([*live, new])
        return new

    def restore(self) -> DataFrame | None:
        """The latest generation; if its folder is gone, the manifest is read again, since a collection may have been at work."""
        while live := self.generations():
            if self._fs.exists(self._path(f"{self.root}/gen={live[-1]}")):
                return self.spark.read.parquet(f"{self.root}/gen={live[-1]}")
            if self.generations() == live:
                raise FileNotFoundError(f"generation {live[-1]} is in the manifest, but not there")
        return None

    def collect_garbage(self, keep: int) -> list[int]:
        """Keep the last generations: the manifest goes first, then the folders."""
        live = self.generations()
        gone = live[: max(0, len(live) - keep)]
        if gone:
            self._manifest(live[len(gone) :])
            for n in gone:
                self._fs.delete(self._path(f"{self.root}/gen={n}"), True)
        return gone


# -- JSON facts


def json_fact(df: DataFrame, text: str, schema: str, name: str) -> DataFrame:
    """df with the fact `name` from a JSON column; a text that isn't a JSON object is an error, a null gives no fact."""
    shape = F.schema_of_variant(F.try_parse_json(F.col(text)))
    wrong = F.raise_error(F.concat(F.lit(f"fact {name} must be a JSON object: "), F.col(text)))
    parsed = F.from_json(F.col(text), schema)
    good = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    return df.withColumn(name, F.when(F.col(text).isNull(), F.lit(None).cast(schema_of(schema))).when(good, parsed).otherwise(wrong.cast(schema_of(schema))))


def schema_of(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def facts_json(df: DataFrame, facts: list[str], out: str = "facts") -> DataFrame:
    """df with one JSON text of the named facts, values by kind; missing facts and fields are left out."""
    return df.withColumn(out, F.to_json(F.struct(*facts)))


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSON file that holds an array of objects."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def little_endian_vector(blob: Column) -> Column:
    """array<float> of little-endian floats; an empty blob, or one that isn't a multiple of 4 bytes long, is an error."""
    @F.pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            if not b or len(b) % 4:
                raise ValueError("a vector needs 4 bytes for each component, and one at least")
            return np.frombuffer(b, "<f4").astype("f4")

        return s.map(one)

    return decode(blob)


def vector_blob(v: Column, big_endian: bool = True) -> Column:
    """The blob of a vector: with its dimension first, big-endian, or as plain little-endian floats."""
    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            return len(x).to_bytes(4, "big") + np.asarray(x, ">f4").tobytes() if big_endian else np.asarray(x, "<f4").tobytes()

        return s.map(one)

    return encode(v.cast("array<float>"))


def big_endian_vector(blob: Column) -> Column:
    """array<float> of a vector blob: a 4-byte big-endian dimension, then as many big-endian floats."""
    @F.pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            n = int.from_bytes(b[:4], "big")
            if len(b) != 4 + 4 * n:
                raise ValueError("vector length doesn't fit its dimension")
            return np.frombuffer(b, ">f4", n, 4).astype("f4")

        return s.map(one)

    return decode(blob)
