"""Forward chaining as a Spark plan: a rule is a boolean column and its writes.

A pass is a left fold over the rules by salience, then source order; later
rules see earlier writes.  There are two plans, chosen by the dependencies
between the rules alone:

* Where no rule without no-loop reads what it or its followers write, the state comes to rest
  after a known number of passes.  These are unrolled; rules without no-loop then fire again
  in every cycle up to the limit, which is counted, not planned.  Working memory is one flat column
  for each field, so plans stay linear in the rules.
* Else (a rule that switches itself off, rules that toggle one another) the state is a struct that is folded over
  the cycles by a higher-order function, in the JVM, until a cycle fires nothing.  Functions
  of fields that no rule writes are made columns beforehand.

Kinds: a text compared with a number is read as a number where it is one, and else compares false; a boolean equals
booleans only.  A field that rules give values of two kinds is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegrain.functions.registry import Registry, standard_registry
from rulegrain.plans.grammar import CYCLES, Accumulate, Action, Arith, Assign, Both, Call, Compare, Items, Lit, Not, Path, Quantified, Rule, RuleError, Test, calls_in, parse_rules, paths_in


@dataclass
class Context:
    """What functions may need: a registry, artifacts by name, an embedder, canon patterns."""

    registry: Registry = field(default_factory=standard_registry)
    artifacts: dict = field(default_factory=dict)
    embedder: object | None = None
    patterns: object | None = None
    missing_ne: bool = False
    #: Columns with index matches, by the text that functions ask about (see functions.address.attach).
    attached: dict = field(default_factory=dict)


def lint(rules: list[Rule], registry: Registry) -> None:
    """Every function registered, and no raw scalar (s_) compared in a condition."""
    for rule in rules:
        for where, node in (("when", rule.when), *(("then", a) for a in rule.then)):
            for call in calls_in(node):
                if isinstance(node, Action) and call is node.call:
                    if call.name not in registry.actions:
                        raise RuleError(f"rule {rule.name}: action {call.name} is not registered")
                    continue
                if call.name not in registry.functions:
                    raise RuleError(f"rule {rule.name}: function {call.name} is not registered")
                if where == "when" and registry.functions[call.name].kind == "s":
                    raise RuleError(f"rule {rule.name}: {call.name} gives a raw scalar; compare a calibrated one (c_...) in conditions")


class Compiler:
    """Trees to Columns over flat working-memory columns."""

    def __init__(self, ctx: Context, lookup, kind_of=lambda path: None):
        self.ctx, self.lookup, self.kind_of = ctx, lookup, kind_of
        self.made: dict[str, Column] = {}
        self.items: list = []  # kinds of `it`, the innermost last

    def kind(self, node):
        """The Spark type of a value as far as it can be told, NullType where nothing is there."""
        if isinstance(node, Lit):
            return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}.get(type(node.value))
        if isinstance(node, Path):
            if self.items and node.parts[0] == "it":
                kind = self.items[-1]
                for p in node.parts[1:]:
                    kind = kind[p].dataType if isinstance(kind, T.StructType) and p in kind.fieldNames() else None
                return kind
            return self.kind_of(node)
        if isinstance(node, Call):
            spec = self.ctx.registry.functions.get(node.name)
            return {"s": T.DoubleType(), "c": T.DoubleType(), "b": T.BooleanType(), "m": T.StringType()}.get(spec.kind) if spec else None
        return T.DoubleType() if isinstance(node, (Arith, Accumulate)) else None

    def _over(self, node):
        """A list and whether there is one; its items are `it` until items.pop()."""
        kind = self.kind(node)
        if isinstance(node, Path) and not isinstance(kind, T.ArrayType):
            return None
        self.items.append(kind.elementType if isinstance(kind, T.ArrayType) else None)
        return node

    def value(self, node, it: Column | None = None):
        if isinstance(node, Lit):
            return F.lit(node.value)
        if isinstance(node, Path):
            if it is not None and node.parts[0] == "it":
                out = it
                for p in node.parts[1:]:
                    out = out[p]
                return out
            return self.lookup(node)
        if isinstance(node, Arith):
            left, right = self.value(node.left, it), self.value(node.right, it)
            return {"+": left + right, "-": left - right, "*": left * right, "/": F.try_divide(left, right)}[node.op]
        if isinstance(node, Call):
            if it is None and repr(node) in self.made:
                return self.made[repr(node)]
            spec = self.ctx.registry.functions[node.name]
            return spec.build(self, list(node.args), it)
        if isinstance(node, Items):
            return F.array(*(self.value(x, it) for x in node.items))
        if isinstance(node, Accumulate):
            return self.accumulate(node, it)
        raise RuleError(f"no value: {node}")

    def accumulate(self, node: Accumulate, it):
        if self._over(node.over) is None:
            return F.lit(None).cast("double")
        try:
            return self._accumulated(node, it)
        finally:
            self.items.pop()

    def _accumulated(self, node: Accumulate, it):
        over = self.value(node.over, it)
        if node.cond is not None and node.fn != "count":
            raise RuleError("only count takes a condition; accumulate other functions over a list of numbers")
        if node.fn == "count":
            return F.size(F.filter(over, lambda x: self.condition(node.cond, x))) if node.cond is not None else F.size(over)
        total = F.aggregate(over, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
        out = {"sum": total, "avg": F.try_divide(total, F.size(over)), "average": F.try_divide(total, F.size(over)), "min": F.array_min(over), "max": F.array_max(over)}
        if node.fn not in out:
            raise RuleError(f"unknown accumulate function {node.fn}")
        return out[node.fn]

    def condition(self, node, it: Column | None = None) -> Column:
        """A boolean column that is never null: what is missing compares false."""
        if isinstance(node, Both):
            parts = [self.condition(p, it) for p in node.parts]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if node.op == "and" else (out | p)
            return out
        if isinstance(node, Not):
            return ~self.condition(node.part, it)
        if isinstance(node, Test):
            return F.coalesce(self.value(node.call, it).cast("boolean"), F.lit(False))
        if isinstance(node, Quantified):
            if self._over(node.over) is None:
                return F.lit(False)  # no such list
            test = (F.exists if node.kind == "exists" else F.forall)(self.value(node.over, it), lambda x: self.condition(node.cond, x))
            self.items.pop()
            return F.coalesce(test, F.lit(False))
        if isinstance(node, Compare):
            left, right = self.value(node.left, it), self.value(node.right, it)
            kinds = [self.kind(node.left), self.kind(node.right)]
            if node.op in ("==", "!=") and Lit(None) in (node.left, node.right):
                test = left.isNull() if node.right == Lit(None) else right.isNull()
                return test if node.op == "==" else ~test
            if node.op in _TEXTUAL:
                if isinstance(kinds[0], T.ArrayType) and node.op == "contains":
                    return F.coalesce(F.array_contains(left, right), F.lit(False))
                left, right = (x if isinstance(k, T.StringType) else x.cast("string") for x, k in zip((left, right), kinds, strict=True))
            elif {_class(k) for k in kinds} == {"number", "text"}:
                left, right = (x.try_cast("double") if _class(k) == "text" else x for x, k in zip((left, right), kinds, strict=True))
            elif "boolean" in (c := {_class(k) for k in kinds}) and c & {"number", "text"}:
                known = left.isNotNull() & right.isNotNull()
                return known if node.op == "!=" else F.lit(False)
            out = {
                "==": lambda: left == right, "!=": lambda: left != right, ">": lambda: left > right, ">=": lambda: left >= right, "<": lambda: left < right, "<=": lambda: left <= right,
                "contains": lambda: left.contains(right), "startsWith": lambda: left.startswith(right), "endsWith": lambda: left.endswith(right), "matches": lambda: F.regexp(left, right),
            }[node.op]()
            return F.coalesce(out, F.lit(self.ctx.missing_ne and node.op == "!="))
        raise RuleError(f"no condition: {node}")


_TEXTUAL = ("contains", "startsWith", "endsWith", "matches")


def _class(kind) -> str | None:
    """number, text, boolean, or None for what can't be told."""
    if isinstance(kind, T.NumericType):
        return "number"
    return {T.StringType: "text", T.BooleanType: "boolean"}.get(type(kind))


def _flat(path: Path) -> str:
    return "__".join(path.parts)


class Dependencies:
    """Which rules, in firing order, read or rewrite what others write."""

    def __init__(self, ordered: list[Rule], then: list[list[Assign]]):
        self.ordered = ordered
        self.writes = [{a.target for a in t} for t in then]
        self.reads = [paths_in(r.when).union(*(paths_in(a.value) for a in t)) for r, t in zip(ordered, then, strict=True)]
        n = range(len(ordered))
        self.follow = [[b for b in n if any(_overlap(p, q) for p in self.writes[a] for q in self.reads[b])] for a in n]

    def settles(self) -> bool:
        """No rule without no-loop reads, itself or through others, what it writes."""
        for a, rule in enumerate(self.ordered):
            if not rule.no_loop:
                seen, todo = set(), list(self.follow[a])
                while todo:
                    b = todo.pop()
                    if b == a:
                        return False
                    if b not in seen:
                        seen.add(b)
                        todo += self.follow[b]
        return True

    def rewritten(self, a: int, b: int | None = None) -> bool:
        """Rule a fires once, and a rule without no-loop writes the same field again (which rule b reads)."""
        others = [p for c, r in enumerate(self.ordered) if c != a and not r.no_loop for p in self.writes[c]]
        fields = [p for p in self.writes[a] if any(_overlap(p, q) for q in others)]
        return self.ordered[a].no_loop and any(b is None or any(_overlap(p, q) for q in self.reads[b]) for p in fields)

    def passes(self, cycles: int) -> int:
        """Passes until a chain of writes has reached every rule: one more for each step against the order, and
        for each write that lasts for one pass only."""
        n = range(len(self.ordered))
        level = [1] * len(self.ordered)
        for _ in range(len(self.ordered) + 1):
            new = [max([level[b], *(level[a] + (a >= b or self.rewritten(a, b)) for a in n if a != b and b in self.follow[a])]) for b in n]
            if new == level:
                break
            level = [min(x, len(self.ordered) + 1) for x in new]
        level += [level[a] + 1 for a in n if self.rewritten(a)]
        return max(1, min(cycles, max(level, default=1)))


def _overlap(p: Path, q: Path) -> bool:
    return p.parts[: len(q.parts)] == q.parts or q.parts[: len(p.parts)] == p.parts


def evaluate(df: DataFrame, rules: str | list[Rule], ctx: Context | None = None, cycles: int = CYCLES, types: dict[str, str] | None = None) -> DataFrame:
    """df with written facts, `fired` (rule names in firing order) and `trace` (cycles, rules_evaluated, rules_fired).

    Fact types are struct columns of df; types that rules write to and df lacks
    start as nulls and come out as struct columns.  types: Spark types of written fields that
    can't be told from the values.
    """
    ctx = ctx or Context()
    rules = parse_rules(rules) if isinstance(rules, str) else rules
    lint(rules, ctx.registry)
    ordered = sorted(rules, key=lambda r: (-r.salience, r.order))
    rules_then = [[s for a in r.then for s in (ctx.registry.actions[a.call.name](a.call) if isinstance(a, Action) else [a])] for r in ordered]
    targets = list(dict.fromkeys(a.target for then in rules_then for a in then))
    schema = df.schema

    def existing(path: Path):
        kind = schema
        for p in path.parts:
            if not isinstance(kind, T.StructType) or p not in kind.fieldNames():
                return None
            kind = kind[p].dataType
        return kind

    def lookup(path: Path) -> Column:
        if path in flat:
            return F.col(flat[path])
        if existing(path) is not None:
            return F.col(".".join(f"`{p}`" for p in path.parts))
        return F.lit(None)

    flat = {t: _flat(t) for t in targets}
    kinds = {}
    out = df
    for t in targets:
        if existing(t) is not None:
            kinds[t] = existing(t)
            out = out.withColumn(flat[t], F.col(".".join(f"`{p}`" for p in t.parts)))
    compiler = Compiler(ctx, lookup, lambda path: kinds[path] if path in kinds else existing(path) or T.NullType())
    for t in targets:
        if existing(t) is None:
            kinds[t] = T.DataType.fromDDL(types[str(t)]) if types and str(t) in types else _kind_of([a.value for then in rules_then for a in then if a.target == t], compiler, out, t)
            out = out.withColumn(flat[t], F.lit(None).cast(kinds[t]))
        for a in (a for then in rules_then for a in then if a.target == t):
            given, wanted = _class(compiler.kind(a.value)), _class(kinds[t])
            if given and wanted and given != wanted:
                raise RuleError(f"{t} is {wanted}, but a rule gives it a {given}")
    if not ordered:
        return df.withColumns({"fired": F.array().cast("array<string>"), "trace": F.struct(F.lit(0).alias("cycles"), F.lit(0).alias("rules_evaluated"), F.lit(0).alias("rules_fired"))})

    depend = Dependencies(ordered, rules_then)
    if depend.settles():
        out, extra = _unrolled(out, compiler, ordered, rules_then, flat, kinds, depend.passes(cycles), cycles)
    else:
        out, extra = _folded(out, compiler, ordered, rules_then, flat, kinds, cycles)

    for top in dict.fromkeys(t.parts[0] for t in targets):
        mine = [t for t in targets if t.parts[0] == top]
        if top in schema.fieldNames():
            fact = F.col(f"`{top}`")
            for t in mine:
                fact = fact.withField(".".join(f"`{p}`" for p in t.parts[1:]), F.col(flat[t]))
        else:
            fact = _struct({t.parts[1:]: F.col(flat[t]) for t in mine})
        out = out.withColumn(top, fact)
    return out.drop(*flat.values(), *extra)


def _unrolled(out: DataFrame, compiler: Compiler, ordered: list[Rule], rules_then, flat, kinds, n: int, cycles: int):
    """n passes as columns; adds fired and trace.  Also the columns to drop."""
    flags: list[list[str]] = []
    done: dict[int, list[str]] = {}
    for p in range(n):
        row = []
        for k, rule in enumerate(ordered):
            test = compiler.condition(rule.when)
            if rule.no_loop:
                for earlier in done.get(k, ()):
                    test = test & ~F.col(earlier)
            name = f"__fired_{p}_{k}"
            out = out.withColumn(name, test)
            done.setdefault(k, []).append(name)
            row.append(name)
            writes = {}
            for a in rules_then[k]:
                old = writes.get(flat[a.target], F.col(flat[a.target]))
                writes[flat[a.target]] = F.when(F.col(name), compiler.value(a.value).cast(kinds[a.target])).otherwise(old)
            if writes:
                out = out.withColumns(writes)
        flags.append(row)

    names = lambda row: F.filter(F.array(*(F.when(F.col(f), F.lit(r.name)) for f, r in zip(row, ordered, strict=True))), lambda x: x.isNotNull())
    # The state rests after n passes; rules that may fire again do so in each further cycle.
    again = [f if not r.no_loop else None for f, r in zip(flags[-1], ordered, strict=True)]
    repeat = F.filter(F.array(*(F.when(F.col(f), F.lit(r.name)) if f else F.lit(None).cast("string") for f, r in zip(again, ordered, strict=True))), lambda x: x.isNotNull())
    fired = F.concat(*(names(row) for row in flags), F.flatten(F.array_repeat(repeat, cycles - n))) if cycles > n else F.concat(*(names(row) for row in flags))
    n_live = sum(((F.size(names(row)) > 0).cast("int") for row in flags), F.lit(0))
    count = F.when(F.size(repeat) > 0, F.lit(cycles)).otherwise(F.least(n_live + 1, F.lit(cycles)))
    return _traced(out.withColumn("fired", fired), count, len(ordered)), [f for row in flags for f in row]


def _traced(out: DataFrame, count: Column, n_rules: int) -> DataFrame:
    return out.withColumn("trace", F.struct(count.alias("cycles"), (count * n_rules).alias("rules_evaluated"), F.size("fired").alias("rules_fired")))


def _with(state: Column, make) -> Column:
    """make(state), with state worked out once."""
    return F.transform(F.array(state), make)[0]


def _folded(out: DataFrame, compiler: Compiler, ordered: list[Rule], rules_then, flat, kinds, cycles: int):
    """Cycles as a fold over a struct: the written fields, `done` of every rule, `names` fired, `n` cycles, `any` fired in this one, `rest`."""
    written = set(flat)
    for node in (x for r, then in zip(ordered, rules_then, strict=True) for x in (r.when, *(a.value for a in then))):
        for call in calls_in(node):
            if repr(call) not in compiler.made and not any(_overlap(p, t) or p.parts[0] == "it" for p in paths_in(call) for t in written):
                name = f"__made_{len(compiler.made)}"
                out = out.withColumn(name, compiler.value(call))
                compiler.made[repr(call)] = F.col(name)
    made = [f"__made_{i}" for i in range(len(compiler.made))]
    plain = compiler.lookup
    fields = list(flat.values())

    def packed(values: dict[str, Column]) -> Column:
        return F.struct(*(values[f].alias(f) for f in (*fields, "done", "names", "n", "any", "rest")))

    def fire(k: int, rule: Rule):
        def step(state: Column) -> Column:
            compiler.lookup = lambda path: state[flat[path]] if path in flat else plain(path)
            test = compiler.condition(rule.when)
            if rule.no_loop:
                test = test & ~state["done"][k]

            def after(on: Column) -> Column:
                values = {f: state[f] for f in (*fields, "done", "names", "n", "any", "rest")}
                new = {}
                for a in rules_then[k]:
                    new[flat[a.target]] = F.when(on, compiler.value(a.value).cast(kinds[a.target])).otherwise(new.get(flat[a.target], state[flat[a.target]]))
                values |= new
                values["done"] = F.transform(state["done"], lambda d, i: d | (on & (i == k)))
                values["names"] = F.when(on, F.array_append(state["names"], F.lit(rule.name))).otherwise(state["names"])
                values["any"] = state["any"] | on
                return packed(values)

            return _with(test, after)

        return step

    def cycle(state: Column, _: Column) -> Column:
        now = packed({**{f: state[f] for f in (*fields, "done", "names", "rest")}, "n": state["n"] + 1, "any": F.lit(False)})
        for k, rule in enumerate(ordered):
            now = _with(now, fire(k, rule))
        ended = _with(now, lambda s: packed({**{f: s[f] for f in (*fields, "done", "names", "n", "any")}, "rest": ~s["any"]}))
        return F.when(state["rest"], state).otherwise(ended)

    start = packed({**{f: F.col(f) for f in fields}, "done": F.array(*(F.lit(False) for _ in ordered)), "names": F.array().cast("array<string>"), "n": F.lit(0), "any": F.lit(False), "rest": F.lit(False)})
    out = out.withColumn("__end", F.aggregate(F.sequence(F.lit(1), F.lit(cycles)), start, cycle))
    compiler.lookup = plain
    out = out.withColumns({**{f: F.col("__end")[f] for f in fields}, "fired": F.col("__end")["names"]})
    return _traced(out, F.col("__end")["n"], len(ordered)), ["__end", *made]


def _struct(fields: dict[tuple[str, ...], Column]) -> Column:
    heads = dict.fromkeys(path[0] for path in fields)
    return F.struct(*((_struct({p[1:]: c for p, c in fields.items() if p[0] == h and len(p) > 1}) if (h,) not in fields else fields[(h,)]).alias(h) for h in heads))


def _kind_of(values: list, compiler: Compiler, df: DataFrame, target: Path):
    """The type of a field from the values that rules give it: the widest of numbers."""
    kinds = []
    for value in values:
        kind = compiler.kind(value) if isinstance(value, Lit) else df.select(compiler.value(value).alias("x")).schema["x"].dataType
        if kind is not None and not isinstance(kind, T.NullType):
            kinds.append(kind)
    if len({_class(k) or str(k) for k in kinds}) > 1:
        raise RuleError(f"rules give {target} values of several kinds: {', '.join(sorted({k.simpleString() for k in kinds}))}")
    if kinds and _class(kinds[0]) == "number":
        return kinds[0] if len(set(kinds)) == 1 else T.DoubleType()
    return kinds[0] if kinds else T.StringType()
