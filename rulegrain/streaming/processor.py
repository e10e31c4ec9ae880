"""Rules over event streams: the same plan for a batch and for readStream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.plans.forward import Context, evaluate


def with_defaults(events: DataFrame) -> DataFrame:
    """event_type "Event" and source "stream" where they are missing."""
    out = events
    for name, value in (("event_type", "Event"), ("source", "stream")):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value))
    return out


def pattern(events: DataFrame, stream: str | None = None, event_type: str | None = None) -> DataFrame:
    """Events of a named stream and type."""
    out = events if stream is None else events.where(F.col("source") == stream)
    return out if event_type is None else out.where(F.col("event_type") == event_type)


def one_model(ctx: Context) -> str | None:
    """The model that all artifacts and the embedder of a context were made with; a mixture is an error."""
    models = {a.model for a in ctx.artifacts.values()} | ({ctx.embedder.model} if ctx.embedder is not None else set())
    if len(models) > 1:
        raise ValueError(f"a processor has one model, not {', '.join(sorted(models))}")
    return next(iter(models), None)


def process(events: DataFrame, pack: str, ctx: Context | None = None, cycles: int = 100) -> DataFrame:
    """One row in, one row out: evaluate() has no state, so it runs on streams as it is."""
    if ctx is not None:
        one_model(ctx)
    return evaluate(events, pack, ctx, cycles)


def window_of(ts: str, kind: str, size: str, slide: str | None = None) -> Column:
    """tumbling, sliding or session windows; an unknown kind is sliding."""
    if kind == "tumbling":
        return F.window(ts, size)
    if kind == "session":
        return F.session_window(ts, size)
    return F.window(ts, size, slide or size)


def windowed(events: DataFrame, ts: str, kind: str, size: str, keys: list[str], aggs: list[Column], slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Aggregates by window and keys; with a watermark, late rows are dropped as Spark does."""
    if watermark:
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    out = events.groupBy(window_of(ts, kind, size, slide).alias("w"), *keys).agg(*aggs)
    return out.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def joined(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, watermark: str) -> DataFrame:
    """Pairs of events with equal keys at most `within` apart; both sides have a watermark, so state is bounded."""
    a = left.withWatermark(left_ts, watermark).alias("l")
    b = right.withWatermark(right_ts, watermark).alias("r")
    gap = F.expr(f"r.{right_ts} BETWEEN l.{left_ts} - INTERVAL {within} AND l.{left_ts} + INTERVAL {within}")
    return a.join(b, (F.col(f"l.{key}") == F.col(f"r.{key}")) & gap)


def late_rows(events: DataFrame, ts: str, watermark_ts) -> DataFrame:
    """Rows older than a watermark, for a side output in foreachBatch."""
    return events.where(F.col(ts) < F.lit(watermark_ts))
