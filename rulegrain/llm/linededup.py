"""Line dedup: a suffix order of line sequences by distributed prefix doubling.

A document is the sequence of its lines that hold words.  Suffixes of all
sequences are ordered by their first 1, 2, 4, ... lines.  A doubling step pairs the
name at a line with the name 2^k lines on; the pairs that occur again are sorted, by
ranges, and numbered in that order, so a name is the place of an interval of the
suffix array and its suffixes have a common prefix of 2^k lines or more.  Unique text
leaves at once.  Lines count as equal by two 64-bit hashes; names after that are exact.

A run of `MIN_WORDS` words or more that stands earlier in the corpus (by doc_id,
then line) is a later copy, and its lines are deleted; copies that overlap add
up to the maximal repeated runs.  It is enough to look at the shortest runs of
that size from each line on and up to each line, which have `MIN_WORDS` lines
at most; so doubling ends at that length.  The interval of suffixes with a run of m
lines in common is told by m and the names of its first and its last 2^k lines
(2^k <= m < 2^(k+1)), which overlap or meet; the first position in the interval is the copy that stays.

Keys that many rows share (a very common line) are joined by broadcast, see `split_join`.

Defined cases: null texts have no lines and stay null; blank lines are kept
where they are and count for nothing; the first copy always stays; rows with the
same doc_id and text are one document and share its result; a null doc_id stands last; lines are
compared as they are, but for white space at their ends.  All columns of the input come back; those
called n_lines, n_deleted or deleted give way to the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.llm.common import materialise, split_join

MIN_WORDS = 50
_LAST = (1 << 63) - 1
_ID = ["d", "t"]
_RESULTS = ("n_lines", "n_deleted", "deleted")


def _document(text) -> list:
    """d (doc_id) and t (hash of the text)."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(text).alias("t")]


def _lines(docs: DataFrame) -> DataFrame:
    """d, t, i (number among lines with words), at (number among all lines), h1 and h2 (hashes of the line), w (words)."""
    text = F.col("text").cast("string")
    rows = docs.select(*_document(text), F.split(text, "\n").alias("ls")).where("ls is not null")
    cut = rows.select("d", "t", F.transform("ls", lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(" \t\r")).alias("x"))).alias("ls"))
    words = F.transform(
        F.filter("ls", lambda x: F.length(x["x"]) > 0),
        lambda x, i: F.struct(i.alias("i"), x["at"].alias("at"), F.xxhash64(x["x"], F.length(x["x"])).alias("h1"), F.xxhash64(F.lit(7), x["x"]).alias("h2"), F.regexp_count(x["x"], F.lit(r"[^ \t-\r]++")).alias("w")),
    )
    return cut.select("d", "t", F.explode(words).alias("l")).select("d", "t", "l.*")


def _intervals(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row for each value of the keys at more than one position: name (in the order of the keys), f (the first position), n."""
    at = F.struct("d", "t", "i")
    found = rows.groupBy(*keys).agg(F.min(at).alias("f"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).where("f <> last").drop("last")
    return materialise(found.orderBy(*keys).withColumn("name", F.monotonically_increasing_id()), label)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, lo, hi): lines lo to hi - 1, numbered among all lines, of runs that stand earlier in the corpus."""
    lines = materialise(_lines(docs), "lines")
    doc = Window.partitionBy("d", "t").orderBy("i")
    level = split_join(lines, _intervals(lines, ["h1", "h2"], "intervals-0").drop("f"), ["h1", "h2"], "n").select("d", "t", "i", "at", "w", "name").dropDuplicates(["d", "t", "i"])
    # Stretches of adjacent lines that each occur elsewhere; a run can't leave its stretch.
    level = level.withColumn("stretch", F.col("i") - F.row_number().over(doc))
    part = Window.partitionBy("d", "t", "stretch").orderBy("i")
    level = level.withColumn("ahead", F.sum("w").over(part)).withColumn("all", F.sum("w").over(part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where(F.col("all") >= min_words)
    level = materialise(level.withColumn("start", F.col("ahead") - F.col("w")), "stretches")
    # On the running count of words, the shortest runs of min_words: from a line on, and up to a line.
    near = level.select("d", "t", "i", "at", "start", "ahead", F.collect_list(F.struct("ahead", "i", "at")).over(part.rowsBetween(0, min_words)).alias("next"), F.collect_list(F.struct("start", "i", "at")).over(part.rowsBetween(-min_words, 0)).alias("prev"))
    first = F.array_min(F.filter("next", lambda x: x["ahead"] - F.col("start") >= min_words))
    last = F.array_max(F.filter("prev", lambda x: F.col("ahead") - x["start"] >= min_words))
    run = lambda i, e, lo, hi: F.struct(i.alias("i"), e.alias("e"), lo.alias("lo"), (hi + 1).alias("hi"))
    ends = near.select("d", "t", F.explode(F.array(run(F.col("i"), first["i"], F.col("at"), first["at"]), run(last["i"], F.col("i"), last["at"], F.col("at")))).alias("r")).select("d", "t", "r.*")
    runs = materialise(ends.where("i is not null and e is not null").withColumn("m", F.col("e") - F.col("i") + 1).distinct(), "runs")
    longest = runs.agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]

    names = level.select("d", "t", "i", "name")
    found, k = runs.select("d", "t", "lo", "hi").where("false"), 0
    while 2**k <= longest:
        if k:
            gap = 2 ** (k - 1)
            pairs = materialise(names.withColumnRenamed("name", "first").withColumn("second", F.first("first").over(doc.rangeBetween(gap, gap))).where("second is not null"), f"pairs-{k}")
            names = materialise(split_join(pairs, _intervals(pairs, ["first", "second"], f"intervals-{k}").drop("f"), ["first", "second"], "n").select("d", "t", "i", "name"), f"names-{k}")
        of = runs.where((F.col("m") >= 2**k) & (F.col("m") < 2 ** (k + 1)))
        both = of.join(names.withColumnRenamed("name", "a"), ["d", "t", "i"]).withColumn("j", F.col("e") - 2**k + 1)
        both = materialise(both.join(names.select("d", "t", F.col("i").alias("j"), F.col("name").alias("b")), ["d", "t", "j"]).drop("j", "e"), f"told-{k}")
        common = split_join(both, _intervals(both, ["m", "a", "b"], f"common-{k}").drop("name"), ["m", "a", "b"], "n")
        found = found.union(common.where(F.col("f") < F.struct("d", "t", "i")).select("d", "t", "lo", "hi"))
        k += 1
    return found.distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of runs of lines deleted: all columns, text changed, and n_lines, n_deleted, deleted (spans of lines)."""
    runs = repeated_runs(docs, min_words).groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("gone"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"), *_document(F.col("text").cast("string")))
    joined = keyed.join(runs, ["d", "t"], "left")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x, i: ~F.exists(F.col("gone"), lambda s: (s["lo"] <= i) & (i < s["hi"])))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    n_left = F.when(F.col("gone").isNull(), count).otherwise(F.size(left))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    result = F.struct(clean.alias("text"), count.alias("n_lines"), (count - n_left).alias("n_deleted"), F.coalesce("gone", none).alias("deleted"))
    rest = [F.col("result.text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in _RESULTS]
    return joined.select("row", result.alias("result")).select(*rest, *(F.col(f"result.{c}") for c in _RESULTS))
