"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources, in code point order with null last, weigh 3, 1, 2, repeating.  They
share `SHARE` of all words; a target stops at twice its source's words and the
excess is shared again by weight (water filling).  Targets are turned into
seats of equal blocks of words: seats go to the highest quotients
target / (2 i - 1).  A source's words stand in a seeded order, cut into blocks, and its
blocks into `PARTS` shards of equal length; whole rounds come first, and the seats left are
apportioned to the shards by their blocks, an integer quota each, again by highest
quotients.  Within a shard the quota is a seeded systematic choice of its blocks.
A document's share is what its words have in the chosen blocks; the pipeline's
stage, mixed(), meets the same targets with whole documents.

Words are summed for (source, salt) and those sums added up, so a source with a
third of all rows is ordered by many tasks.  Sources are numbered by ranges, and the
water level and the divisor of the apportionment come from a few sums over the
sources, so there may be very many of them.  Main path: DataFrame functions only.

Defined cases: null and blank texts have size 0 and nothing taken; rows without
a source form one source, which stands last; repeated rows each take their
share; if no row has words, targets and taken are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.llm.common import materialise

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: A block has total / BLOCKS words, and LEAST at least.
BLOCKS, LEAST = 1 << 18, 8
#: Shards of a source's blocks.
PARTS = 16
SALTS, ROWS_PER_SALT = 1024, 1 << 22
SEED = 11
#: Divisors tried in one pass.
TRIED = 32


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds name: 1, 2, ... in the given order; rows are sorted by ranges and the ranges' counts added up."""
    sorted_rows = materialise(rows.orderBy(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    count = sorted_rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = count.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return sorted_rows.withColumn("__at", inside).join(F.broadcast(base), "__range").withColumn(name, (F.col("__base") + F.col("__at")).cast("long")).drop("__range", "__base", "__at")


def targets(sources: DataFrame, share: float = SHARE) -> DataFrame:
    """Adds weight, ord and target to the rows (none, src, z) of sources.

    The level at which weights are served is found from below: sources whose cap lies under it stop
    there, and what is left is shared among the others, until no more of them stop.
    """
    ranked = numbered(sources, ["none", "src"], "ord")
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = materialise(ranked.withColumn("weight", F.element_at(weights, ((F.col("ord") - 1) % len(WEIGHTS) + 1).cast("int"))), "weights")
    total = ranked.agg(F.coalesce(F.sum("z"), F.lit(0))).first()[0]
    aim, level, stopped = share * total, 0.0, -1
    while True:
        stops = (MOST * F.col("z")).cast("double") <= F.lit(level) * F.col("weight")
        n, full, weight = ranked.agg(F.count_if(stops), F.coalesce(F.sum(F.when(stops, F.col("z"))), F.lit(0)), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0))).first()
        if n == stopped or not weight:
            break
        stopped, level = n, (aim - MOST * full) / weight
    return ranked.withColumn("target", F.when(stops, (MOST * F.col("z")).cast("double")).otherwise(F.lit(level) * F.col("weight")))


def apportion(aims: DataFrame, seats: int) -> DataFrame:
    """Adds seats to the rows (ord, target) of aims: the highest quotients target / (2 i - 1), equal ones by ord.

    For a divisor d, round(target / d) counts a source's quotients above d / 2; a few sums
    close in on the d with as many as there are seats.  Where equal quotients leave none, those
    at the edge are numbered by ord.
    """
    total = aims.agg(F.coalesce(F.sum(F.col("target").cast("decimal(38,6)")), F.lit(0))).first()[0]
    if not total or not seats:
        return aims.withColumn("seats", F.lit(0).cast("long"))
    first = materialise(aims, "aims")
    given = lambda d: F.floor(F.col("target") / F.lit(d) + 0.5).cast("long")
    middle = float(total) / seats
    low, high = middle / 2, middle * 2  # grown until low gives too many and high too few
    while True:
        tried = [low + (high - low) * i / (TRIED - 1) for i in range(TRIED)]
        sums = list(first.agg(*(F.sum(given(d)) for d in tried)).first())
        if seats in sums:
            return first.withColumn("seats", given(tried[sums.index(seats)]))
        if sums[0] < seats:
            low /= 4
        elif sums[-1] > seats:
            high *= 4
        else:
            at = next(i for i, n in enumerate(sums) if n < seats)
            narrow = tried[at - 1], tried[at]
            if narrow[1] - narrow[0] <= 1e-13 * narrow[1] or narrow == (low, high):
                low, high = narrow
                break
            low, high = narrow
    edge = numbered(first.select("ord", given(high).alias("n0"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("i"), given(low).alias("n1")).where("n0 + i <= n1"), ["ord", "i"], "place")
    more = edge.where(F.col("place") <= seats - sums[at]).groupBy("ord").agg(F.count(F.lit(1)).alias("more"))
    return first.join(more, "ord", "left").withColumn("seats", given(high) + F.coalesce("more", F.lit(0))).drop("more")


def _before(b: str) -> str:
    """Chosen blocks before block b of a source with nb blocks, q of them to choose: the quotas of the shards before
    its own, and a systematic choice in its own.  Shards have nb div PARTS blocks or one more; with equal
    shares by highest quotients each gets q div PARTS seats, and the rest go first to the longer ones."""
    h = f"(((({b}) + 1) * {PARTS} - 1) div nb)"
    begin = lambda h: f"(({h}) * nb div {PARTS})"
    longer = lambda h: f"({begin(h)} - ({h}) * (nb div {PARTS}))"
    rest = f"(q % {PARTS})"
    seats = lambda h: f"(({h}) * (q div {PARTS}) + least({rest}, {longer(h)}) + least(greatest({rest} - nb % {PARTS}, 0), ({h}) - {longer(h)}))"
    size, quota = f"({begin(f'{h} + 1')} - {begin(h)})", f"({seats(f'{h} + 1')} - {seats(h)})"
    off = f"pmod(xxhash64(seat, {h}), {size})"
    return f"(CASE WHEN ({b}) >= nb THEN q ELSE {seats(h)} + ((({b}) - {begin(h)}) * {quota} + {off}) div {size} - {off} div {size} END)"


def mix(docs: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every row of docs."""
    text = F.col("text").cast("string")
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]++")), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    rows = materialise(docs.select("doc_id", source.isNull().cast("int").alias("none"), F.coalesce(source, F.lit("")).alias("src"), words.alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("o")), "mix-rows")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    salts, block = max(SALTS, -(-n // ROWS_PER_SALT)), max(LEAST, total // BLOCKS)
    rows = rows.withColumn("salt", F.pmod("o", F.lit(salts)))
    cells = materialise(rows.groupBy("none", "src", "salt").agg(F.sum("size").alias("words")), "mix-cells")
    sources = cells.groupBy("none", "src").agg(F.sum("words").alias("z"))
    quota = apportion(targets(sources, share), max(1, round(share * total / block)) if total else 0)
    quota = quota.withColumn("nb", F.greatest(F.lit(1), F.ceil(F.col("z") / block)).cast("long")).withColumn("seat", F.xxhash64(F.lit(seed), "none", "src"))
    quota = materialise(quota.withColumn("rounds", F.least(F.expr("seats div nb"), F.lit(MOST))).withColumn("q", F.when(F.expr(f"seats div nb >= {MOST}"), 0).otherwise(F.col("seats") % F.col("nb"))).drop("ord", "weight", "seats"), "quotas")
    before = Window.partitionBy("none", "src").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(quota, ["none", "src"])
    running = Window.partitionBy("none", "src", "salt").orderBy("o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(running), F.lit(0))).join(cells, ["none", "src", "salt"])
    placed = placed.withColumn("x", F.col("base") + F.col("ahead")).withColumn("y", F.col("x") + F.col("size"))
    # words of chosen blocks before the document, and before its end
    for at in "xy":
        placed = placed.withColumn("b", F.expr(f"{at} div {block}")).withColumn("c", F.expr(_before("b"))).withColumn(f"c{at}", F.expr(f"c * {block} + ({_before('b + 1')} - c) * ({at} - b * {block})"))
    kept = F.when(F.col("none") == 0, F.col("src"))
    return placed.select("doc_id", "size", F.col("z").alias("source_size"), "target", F.expr("rounds * size + cy - cx").cast("long").alias("taken"), kept.alias("source"))


def mixed(docs: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """docs as the mix has them: each row is left out, stands once or is repeated, so a source's words meet its target.

    A row with words gets floor((k + 1) p + u) - floor(k p + u) copies, where p is
    target / words of its source, u a seeded start and k its rank in the source by
    size class (a sixteenth of a doubling) and seeded order.  Neighbours in rank are
    of like size, so a source's words differ from its target by about its longest
    document at most, however many rows there are.  Rows without words get no copy.
    The verdict stays on the row: doc_ids may be null or repeated.
    """
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]++")), F.lit(0)).cast("long")
    salts = max(SALTS, -(-docs.count() // ROWS_PER_SALT))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), source.isNull().cast("int").alias("none"), F.coalesce(source, F.lit("")).alias("src"), words.alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("o"))
    rows = rows.withColumn("class", F.floor(16 * F.log2(F.col("size") + 1))).withColumn("salt", F.pmod("o", F.lit(salts)))
    cell = ["none", "src", "class", "salt"]
    cells = materialise(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")), "mixed-cells")
    aims = materialise(targets(cells.groupBy("none", "src").agg(F.sum("words").alias("z")), share), "mixed-targets")
    aims = aims.where("z > 0").select("none", "src", (F.col("target") / F.col("z")).alias("p"), (F.pmod(F.xxhash64(F.lit(seed), "none", "src"), F.lit(1 << 20)) / (1 << 20)).alias("u"))
    # rows before a cell: those of smaller classes (some hundred a source), and those of smaller salts in its class
    smaller = Window.partitionBy("none", "src").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("none", "src", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("none", "src", "class").agg(F.sum("rows").alias("rows")).withColumn("ahead", F.coalesce(F.sum("rows").over(smaller), F.lit(0))).drop("rows").join(aims, ["none", "src"])
    cells = cells.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows", "words").join(classes, ["none", "src", "class"]).withColumn("base", F.col("base") + F.col("ahead")).drop("ahead")
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy(*cell).orderBy("o"))).join(cells, cell).withColumn("k", F.col("base") + F.col("at"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("k") * F.col("p") + F.col("u")) - F.floor((F.col("k") - 1) * F.col("p") + F.col("u"))).otherwise(0)
    return ranked.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("copy")).select("row.*")
