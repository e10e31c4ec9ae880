"""Rule governance: packs and revisions, comparison, A/B runs, exposure and promotion."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rulegrain.functions import canon
from rulegrain.plans.backward import prove
from rulegrain.plans.forward import Context, evaluate
from rulegrain.plans.grammar import Path, RuleError, parse_rules, paths_in


def load_pack(spark: SparkSession, folders: list[str]) -> str:
    """All .grl files of the folders, each folder's by path, end to end."""
    out = []
    for folder in folders:
        files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.grl").text(folder).select("value", F.input_file_name().alias("path")).orderBy("path")
        out += [r["value"] for r in files.collect()]
    return "\n".join(out)


def compare(a: str, b: str) -> dict[str, list[str] | int]:
    """Rules by name: only in a, only in b, changed, and how many are the same."""
    said = lambda text: {r.name: {k: v for k, v in asdict(r).items() if k != "order"} for r in parse_rules(text)}
    x, y = said(a), said(b)
    both = sorted(x.keys() & y.keys())
    changed = [n for n in both if x[n] != y[n]]
    return {"only_a": sorted(x.keys() - y.keys()), "only_b": sorted(y.keys() - x.keys()), "changed": changed, "unchanged": len(both) - len(changed)}


def compare_tables(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): only_a, only_b, changed or unchanged, for rules or files held in tables."""
    x, y = a.select(F.col(key).alias("k"), F.col(value).alias("x"), F.lit(1).alias("ina")), b.select(F.col(key).alias("k2"), F.col(value).alias("y"), F.lit(1).alias("inb"))
    both = x.join(y, F.col("k") == F.col("k2"), "full_outer")
    status = F.when(F.col("inb").isNull(), "only_a").when(F.col("ina").isNull(), "only_b").when(F.col("x").eqNullSafe(F.col("y")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("k", "k2").alias(key), status.alias("status"))


def ab_run(facts: DataFrame, a: str, b: str, key: str, ctx: Context | None = None, decision: str = "Decision") -> DataFrame:
    """Both packs on the same facts: key, fired_a, fired_b, fired_only_a, fired_only_b, decision_changed."""
    def said(text: str, side: str) -> DataFrame:
        out = evaluate(facts, text, ctx)
        shown = F.to_json(F.col(decision)) if decision in out.columns else F.lit(None).cast("string")
        return out.select(F.col(key).alias(f"k{side}"), F.array_distinct("fired").alias(f"fired_{side}"), shown.alias(f"decision_{side}"))

    x, y = said(a, "a"), said(b, "b")
    both = x.join(y, x["ka"].eqNullSafe(y["kb"]))
    return both.select(
        F.col("ka").alias(key), "fired_a", "fired_b", F.array_except("fired_a", "fired_b").alias("fired_only_a"), F.array_except("fired_b", "fired_a").alias("fired_only_b"), (~F.col("decision_a").eqNullSafe(F.col("decision_b"))).alias("decision_changed")
    )


def exposed(tools: DataFrame, pack: str, ctx: Context | None = None) -> DataFrame:
    """tools (struct Exposure and others) with `exposed`: true if the pack doesn't speak of exposure, else if any rule fired."""
    rules = parse_rules(pack)
    speaks = any(p.parts[0] == "Exposure" for r in rules for p in paths_in(r.when) if isinstance(p, Path))
    if not speaks:
        return tools.withColumn("exposed", F.lit(True))
    return evaluate(tools, rules, ctx).withColumn("exposed", F.size("fired") > 0)


def tool_group(tool):
    return F.when(tool.startswith("memory_"), "memory").when(tool.startswith("rules_"), "rules").when(tool.startswith("whatif_"), "whatif").otherwise("capability")


def ancestors(revisions: DataFrame, start: str) -> DataFrame:
    """(revision): a revision and all it comes from, by (revision, parent) rows."""
    name = f"__revisions_{uuid.uuid4().hex}"
    revisions.createOrReplaceTempView(name)
    try:
        return revisions.sparkSession.sql(
            f"WITH RECURSIVE up(revision) AS (SELECT :start UNION ALL SELECT r.parent FROM up JOIN {name} r ON r.revision = up.revision WHERE r.parent IS NOT NULL) SELECT DISTINCT revision FROM up",
            args={"start": start},
        )
    finally:
        revisions.sparkSession.catalog.dropTempView(name)


def can_promote(revisions: DataFrame, head: str, target: str, sign_off: str | None) -> bool:
    """Sign-off given, and head is among target's ancestors (a fast-forward)."""
    return bool(sign_off) and not ancestors(revisions, target).where(F.col("revision") == head).isEmpty()


def load_at(sources: DataFrame, revision: str) -> str:
    """The pack at a revision, from (revision, path, source) rows: files by path, each parsed on its own first."""
    out = []
    for r in sources.where((F.col("revision") == revision) & F.col("path").endswith(".grl")).orderBy("path").collect():  # the files of one pack
        try:
            parse_rules(r["source"])
        except RuleError as e:
            raise RuleError(f"{r['path']} at {revision}: {e}") from e
        out.append(r["source"])
    if not out:
        raise RuleError(f"no rules at revision {revision}")
    return "\n".join(out)


def branch_heads(branches: DataFrame) -> DataFrame:
    """(branch, revision): the last revision of each branch, from (branch, revision, moved_at) rows."""
    return branches.groupBy("branch").agg(F.max_by("revision", F.struct("moved_at", "revision")).alias("revision"))


def listing(pack: str, revision: str | None = None) -> dict:
    return {"count": len(parse_rules(pack)), "source": pack, **({"revision": revision} if revision else {})}


def run(facts: DataFrame, pack: str | None = None, inline: str | None = None, sources: DataFrame | None = None, revision: str | None = None, ctx: Context | None = None) -> DataFrame:
    """Evaluate one of: the active pack, rules given inline, or the pack at a revision."""
    if sum(x is not None for x in (inline, revision)) > 1:
        raise ValueError("give rules or a revision, not both")
    if revision is not None and sources is None:
        raise ValueError("a revision needs the sources it is in")
    text = inline if inline is not None else load_at(sources, revision) if revision is not None else pack
    if text is None:
        raise ValueError("there is no active pack")
    if not any(isinstance(f.dataType, StructType) for f in facts.schema.fields):
        raise ValueError("there must be a fact, a struct column, at least")
    return evaluate(facts, text, ctx)


def what_if(facts: DataFrame, pack: str, changes: dict[str, Column], key: str, ctx: Context | None = None) -> DataFrame:
    """(key, fired, fired_if): the rules that fire now, and with fields changed ("Fact.field": Column)."""
    changed = facts
    for target, value in changes.items():
        top, *rest = target.split(".")
        changed = changed.withColumn(top, F.col(top).withField(".".join(f"`{p}`" for p in rest), value))
    now, then = (evaluate(df, pack, ctx).select(F.col(key).alias(k), F.col("fired").alias(name)) for df, k, name in ((facts, "k", "fired"), (changed, "k2", "fired_if")))
    return now.join(then, F.col("k").eqNullSafe(F.col("k2"))).select(F.col("k").alias(key), "fired", "fired_if")


def what_if_proved(facts: DataFrame, pack: str, query: str, changes: dict[str, Column], key: str, ctx: Context | None = None) -> DataFrame:
    """(key, provable, provable_if)."""
    changed = facts
    for target, value in changes.items():
        top, *rest = target.split(".")
        changed = changed.withColumn(top, F.col(top).withField(".".join(f"`{p}`" for p in rest), value))
    now, then = (prove(df, pack, query, ctx).select(F.col(key).alias(k), F.col("proof.provable").alias(name)) for df, k, name in ((facts, "k", "provable"), (changed, "k2", "provable_if")))
    return now.join(then, F.col("k").eqNullSafe(F.col("k2"))).select(F.col("k").alias(key), "provable", "provable_if")


def test_run(cases: DataFrame, pack: str, ctx: Context | None = None, expected: str = "expected") -> DataFrame:
    """Test cases (facts and the rules that should fire, in order) with fired and passed."""
    return evaluate(cases, pack, ctx).withColumn("passed", F.col("fired").eqNullSafe(F.col(expected)))


def audit_events(calls: DataFrame, tool: Column, backend: Column, request: Column, answer: Column, timestamp_ns: Column, embed=None, model: str | None = None) -> DataFrame:
    """Events of stream "audit" for append_events: what was asked and answered, with the vector of its search text."""
    record = F.to_json(F.struct(tool.alias("tool"), backend.alias("backend"), request.alias("request"), answer.alias("answer")))
    vector = embed(canon.search_text(request, answer)).cast("array<float>") if embed is not None else F.lit(None).cast("array<float>")
    return calls.select(F.lit("audit").alias("stream"), F.lit("execution").alias("kind"), timestamp_ns.alias("timestamp_ns"), record.alias("payload"), vector.alias("vector"), F.lit(model if embed is not None else None).cast("string").alias("embedding_model"))


def activity_events(calls: DataFrame, tool: Column, session: Column, ok: Column, timestamp_ns: Column, duration_ms: Column | None = None) -> DataFrame:
    """Events of stream "activity" for append_events, one for each call."""
    record = F.to_json(F.struct(tool.alias("tool"), session.alias("session"), ok.alias("ok"), (duration_ms if duration_ms is not None else F.lit(None).cast("double")).alias("duration_ms")))
    return calls.select(F.lit("activity").alias("stream"), F.lit("call").alias("kind"), timestamp_ns.alias("timestamp_ns"), record.alias("payload"))


def activity(events: DataFrame) -> DataFrame:
    """(tool, session, ok, ts) of activity events, as store.tool_stats takes them."""
    get = lambda name: F.get_json_object("payload", f"$.{name}")
    return events.where("stream = 'activity'").select(get("tool").alias("tool"), get("session").alias("session"), get("ok").cast("boolean").alias("ok"), F.col("timestamp_ns").alias("ts"))


def route(requests: DataFrame, pack: str, ctx: Context | None = None) -> DataFrame:
    """Capability routing: evaluate, require Decision.backend, and take Decision.effort before the request's."""
    out = evaluate(requests, pack, ctx)
    kind = out.schema["Decision"].dataType.fieldNames() if "Decision" in out.columns else []
    backend = F.col("Decision.backend") if "backend" in kind else F.lit(None).cast("string")
    effort = F.coalesce(F.col("Decision.effort"), F.lit("default")) if "effort" in kind else F.lit("default")
    return out.withColumn("backend", backend).withColumn("effort", effort).withColumn("routed", F.col("backend").isNotNull())
