"""Goal-directed proof as columns: a goal holds in the facts or by a rule that concludes it.

Every (field, comparison) goal is derived once, as its own column, in dependency
order; the query is a boolean formula over them.  strategy, memoization and
rule order don't change an answer, so they are accepted and have no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from rulegrain.plans.forward import Compiler, Context
from rulegrain.plans.grammar import Assign, Both, Compare, Lit, Not, Path, Query, Rule, Test, parse_query, parse_rules

MAX_DEPTH = 10


def _text(node) -> str:
    if isinstance(node, Both):
        return (" && " if node.op == "and" else " || ").join(_text(p) for p in node.parts)
    if isinstance(node, Not):
        return f"!({_text(node.part)})"
    if isinstance(node, Compare):
        return f"{_text(node.left)} {node.op} {_text(node.right)}"
    if isinstance(node, Test):
        return _text(node.call)
    if isinstance(node, Lit):
        return {True: "true", False: "false", None: "null"}.get(node.value, str(node.value)) if not isinstance(node.value, str) else f'"{node.value}"'
    return str(node)


def prove(df: DataFrame, rules: str | list[Rule], query: str | Query, ctx: Context | None = None) -> DataFrame:
    """df with `proof` struct<provable, goal, missing_facts, steps> (steps: the rules that concluded the goal).

    Facts are struct columns, or flat columns named by the dotted path ("User.Points").
    """
    ctx = ctx or Context()
    rules = parse_rules(rules) if isinstance(rules, str) else rules
    query = parse_query(query) if isinstance(query, str) else query
    depth = query.options.get("max-depth", MAX_DEPTH)
    flat = set(df.columns)

    def lookup(path: Path):
        if str(path) in flat:
            return F.col(f"`{path}`")
        return F.lit(None) if isinstance(kind_of(path), NullType) else F.col(".".join(f"`{p}`" for p in path.parts))

    def kind_of(path: Path):
        kind = df.schema
        for p in [str(path)] if str(path) in flat else path.parts:
            if not hasattr(kind, "fieldNames") or p not in kind.fieldNames():
                return NullType()
            kind = kind[p].dataType
        return kind

    compiler = Compiler(ctx, lookup, kind_of)
    concluding: dict[Path, list[tuple[Rule, object]]] = {}
    for rule in rules:
        for a in rule.then:
            if isinstance(a, Assign):
                concluding.setdefault(a.target, []).append((rule, a.value))
    out, memo, steps = df, {}, {}

    def column(test) -> str:
        nonlocal out
        name = f"__goal_{len(out.columns)}"
        out = out.withColumn(name, test)
        return name

    def goal(node, left: int):
        """Column that says whether node can be proved with so many more rule steps."""
        if isinstance(node, Both):
            parts = [goal(p, left) for p in node.parts]
            test = parts[0]
            for p in parts[1:]:
                test = (test & p) if node.op == "and" else (test | p)
            return test
        if isinstance(node, Not):
            return ~goal(node.part, left)
        path = node.left if isinstance(node, Compare) and isinstance(node.left, Path) else node.call if isinstance(node, Test) and isinstance(node.call, Path) else None
        key = (_text(node), left)
        if key not in memo:
            test = compiler.condition(node)
            found = []
            if path is not None and left > 0:
                for rule, value in concluding.get(path, ()):
                    agrees = compiler.condition(Compare(node.op, value, node.right)) if isinstance(node, Compare) else compiler.condition(Test(value))
                    by = column(goal(rule.when, left - 1) & agrees)
                    found.append((rule.name, by))
                    test = test | F.col(by)
            memo[key] = column(test)
            steps[key] = found
        return F.col(memo[key])

    gate = compiler.condition(query.options["when"]) if "when" in query.options else F.lit(True)
    proved = column(goal(query.goal, depth) & gate)
    names = [F.when(F.col(by), F.lit(name)) for name, by in steps.get((_text(query.goal), depth), [])]
    step = F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    holds = F.col(proved)
    proof = F.struct(
        holds.alias("provable"),
        F.when(holds, F.lit(_text(query.goal))).otherwise(F.lit("")).alias("goal"),
        F.when(holds | ~gate, none).otherwise(F.array(F.lit(_text(query.goal)))).alias("missing_facts"),
        F.when(holds, step).otherwise(none).alias("steps"),
    )
    out = out.withColumn("proof", proof)
    return out.drop(*(c for c in out.columns if c.startswith("__goal_")))
