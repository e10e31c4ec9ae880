"""Chat formatting by perspective rotation.

For every participant of a conversation (every role but "system") the dialogue
is rendered once with that speaker as the assistant and all others as named
users; only the speaker's own words, with their end marker, are trained on.

`segments` gives one row for each turn and perspective, with its place in the
rendered text, so that no conversation is gathered in one task: lengths are
summed for blocks of `BLOCK` turn numbers and those sums added up.  `dialogues`
puts the segments of a perspective together where one row of text is wanted.

Defined cases: rows without conv_id are left out; a null turn stands first; a
null role is "unknown", a null text empty; turns of equal number go by role,
then text; repeated rows are repeated turns; a conversation of system turns only
has no perspective; "<|" in a text is written "<||", which `unescape` undoes; line breaks in
a role are written as one space in the header, so that it stays one line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>\n"


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, seq, turn, role, segment, char_start, char_end, trained, loss_start, loss_end."""
    rows = turns.where("conv_id is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("<||")).alias("body")
    )
    speakers = rows.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    views = rows.join(speakers, F.col("conv_id") == F.col("c")).drop("c")
    mine = F.col("role") == F.col("perspective")
    name = F.regexp_replace(F.replace(F.col("role"), F.lit("<|"), F.lit("<||")), r"[\r\n]+", " ")
    header = F.when(mine, F.lit(f"{START}assistant\n")).when(F.col("role") == "system", F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))
    views = views.withColumns({"head": F.length(header).cast("long"), "segment": F.concat(header, "body", F.lit(END)), "trained": mine, "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))})
    views = views.withColumn("size", F.length("segment").cast("long"))
    one = ["conv_id", "perspective"]
    sums = views.groupBy(*one, "block").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*one).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*one, "block", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq0"))
    inside = Window.partitionBy(*one, "block").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    placed = views.withColumns({"rn": F.row_number().over(inside), "until": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))}).join(sums, [*one, "block"])
    end = F.col("chars0") + F.col("until")
    start = end - F.col("size")
    loss = lambda x: F.when(F.col("trained"), x)
    return placed.select(
        *one, (F.col("seq0") + F.col("rn") - 1).alias("seq"), "turn", "role", "segment", start.alias("char_start"), end.alias("char_end"), "trained", loss(start + F.col("head")).alias("loss_start"), loss(end - 1).alias("loss_end")
    )


def dialogues(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, text, spans (trained characters, without the last line feed): one row each, for conversations that fit a row."""
    parts = segments(turns).groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(F.struct("seq", "segment", "loss_start", "loss_end"))).alias("s"))
    spans = F.transform(F.filter("s", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("lo"), x["loss_end"].alias("hi")))
    return parts.select("conv_id", "perspective", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), spans.alias("spans"))
