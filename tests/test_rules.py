import random

import pytest
from pyspark.sql import functions as F

from rulegrain.functions import vector
from rulegrain.operators.geometry import Artifacts, Axis
from rulegrain.operators.governance import can_promote, compare
from rulegrain.plans.backward import prove
from rulegrain.plans.forward import Context, Dependencies, evaluate
from rulegrain.plans.grammar import Lit, RuleError, parse_query, parse_rules, validate


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(1, ("gold", 250)), (2, (None, 5)), (3, None)], "id int, Request struct<tier:string,len:int>")


def rows(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_later_rules_see_earlier_writes_and_salience_orders(facts):
    pack = 'rule "Low" salience 1 no-loop { when Decision.route == "first" then Decision.route = "second"; } rule "High" salience 9 no-loop { when Request.tier == "gold" then Decision.route = "first"; }'
    out = evaluate(facts, pack)
    assert rows(out, "fired") == {1: ["High", "Low"], 2: [], 3: []}
    assert out.where("id = 1").select("Decision.route").first()[0] == "second"


def test_firings_with_and_without_no_loop(facts):
    rule = 'rule "A" %s { when Request.len > 1 then X.a = 1; } rule "B" %s { when X.a == 1 then X.b = 1; }'
    assert len(rows(evaluate(facts, rule % ("", "")), "fired")[1]) == 200
    once = evaluate(facts, rule % ("no-loop", "no-loop"))
    assert rows(once, "fired")[1] == ["A", "B"]
    assert once.where("id = 1").select("trace.cycles").first()[0] == 2


def test_rule_that_counts_stops_at_the_cycle_limit(facts):
    out = evaluate(facts.withColumn("N", F.struct(F.lit(0).alias("v"))), 'rule "Up" { when N.v < 3 then N.v = N.v + 1; }', cycles=5)
    assert {r[0] for r in out.select("N.v").collect()} == {3}


def test_a_rule_that_switches_itself_off_fires_once(facts):
    out = evaluate(facts, 'rule "Down" { when Request.len > 100 then Request.len = 50; }')
    got = {r["id"]: (r["fired"], r["trace"]["cycles"], r["Request"] and r["Request"]["len"]) for r in out.collect()}
    assert got[1] == (["Down"], 2, 50) and got[2] == ([], 1, 5)
    pair = 'rule "A" salience 2 { when X.a == 1 then X.a = 2; } rule "I" no-loop { when Request.len > 100 then X.a = 1; }'
    assert rows(evaluate(facts, pair), "fired")[1] == ["I", "A"]


def _interpreted(pack, state, cycles):
    """Rules (name, salience, no_loop, field, value, target, add, constant) run one by one."""
    state, done, fired = dict(state), set(), []
    ordered = sorted(enumerate(pack), key=lambda r: (-r[1][1], r[0]))
    for n in range(1, cycles + 1):
        some = False
        for k, (name, _, once, seen, value, target, add, constant) in ordered:
            if state.get(seen) == value and not (once and k in done):
                done.add(k)
                fired.append(name)
                some = True
                state[target] = constant if add is None else None if state.get(add) is None else state[add] + constant
        if not some:
            break
    return fired, state, n


def test_random_packs_against_an_interpreter(spark):
    rng = random.Random(12)
    packs = []
    for _ in range(45):
        packs.append([(f"r{i}", rng.randrange(3), rng.random() < 0.6, rng.choice("abc"), rng.randrange(3), rng.choice("abc"), rng.choice([None, None, None, "a", "b"]), rng.randrange(3)) for i in range(rng.randrange(1, 5))])
    starts = [(i, (rng.choice([None, 0, 1, 2]), rng.choice([0, 1, 2]), 0)) for i in range(6)]
    df = spark.createDataFrame(starts, "id int, X struct<a:long,b:long,c:long>")
    plans = set()
    for pack in packs:
        text = " ".join(f'rule "{n}" salience {s} {"no-loop" if once else ""} {{ when X.{seen} == {v} then X.{t} = {f"X.{add} + {c}" if add else c}; }}' for n, s, once, seen, v, t, add, c in pack)
        rules = parse_rules(text)
        ordered = sorted(rules, key=lambda r: (-r.salience, r.order))
        plans.add(Dependencies(ordered, [list(r.then) for r in ordered]).settles())
        for r in evaluate(df, text, cycles=9).collect():
            fired, state, n = _interpreted(pack, dict(zip("abc", dict(starts)[r["id"]], strict=True)), 9)
            assert (r["fired"], r["X"].asDict(), r["trace"]["cycles"]) == (fired, state, n), text
    assert plans == {True, False}


def test_lists_and_kinds(facts, spark):
    pack = 'rule "S" no-loop { when exists(Absent.lines, it.q > 1) || forall(Request.nothing, it > 1) then D.a = true; } rule "N" no-loop { when accumulate(sum, Absent.q) > 1 then D.b = true; } rule "Kind" no-loop { when exists(Request.tier, it > 1) then D.c = true; }'
    assert rows(evaluate(facts, pack), "fired") == {1: [], 2: [], 3: []}
    odd = spark.createDataFrame([(1, ("12", True, ["a", "b"])), (2, ("x", False, [])), (3, (None, None, None))], "id int, R struct<t:string,b:boolean,l:array<string>>")
    fired = lambda test: [i for i, f in sorted(rows(evaluate(odd, f'rule "T" no-loop {{ when {test} then D.a = 1; }}'), "fired").items()) if f]
    assert fired("R.t > 5") == [1] and fired("R.t == 12") == [1] and fired("R.t != 12") == []
    assert fired('R.b == "true"') == [] and fired("R.b == true") == [1] and fired('R.l contains "b"') == [1]
    assert fired("len(R.l) == 2") == [1] and fired("len(R.t) == 1") == [2]
    with pytest.raises(RuleError, match="several kinds"):
        evaluate(odd, 'rule "A" { when R.b == true then O.x = true; } rule "B" { when R.b == false then O.x = "yes"; }')
    with pytest.raises(RuleError, match="gives it a text"):
        evaluate(odd, 'rule "B" { when R.b == false then R.b = "yes"; }')


def test_missing_facts_compare_false(facts):
    out = evaluate(facts, 'rule "Ne" no-loop { when Absent.x != 1 then D.a = true; } rule "Not" no-loop { when !(Absent.x == 1) then D.b = true; }')
    assert rows(out, "fired") == {i: ["Not"] for i in (1, 2, 3)}
    assert rows(evaluate(facts, 'rule "Ne" no-loop { when Absent.x != 1 then D.a = true; }', Context(missing_ne=True)), "fired")[1] == ["Ne"]


def test_lint_kinds_and_registration(facts):
    with pytest.raises(RuleError, match="raw scalar"):
        evaluate(facts, 'rule "R" { when s_cosine(Request.tier, Request.tier) > 0.5 then D.a = 1; }')
    with pytest.raises(RuleError, match="not registered"):
        evaluate(facts, 'rule "R" { when c_nothing(Request.tier) > 0.5 then D.a = 1; }')
    with pytest.raises(RuleError, match="calibration"):
        ctx = Context(artifacts=Artifacts(a=Axis("a", [1.0, 0.0], "m", 2)))
        evaluate(facts.withColumn("V", F.struct(F.array(F.lit(1.0), F.lit(0.0)).alias("v"))), 'rule "R" { when c_project(V.v, "a") > 5 then D.a = 1; }', ctx)


def test_artifacts_of_another_model_are_refused(facts):
    ctx = Context(artifacts=Artifacts(a=Axis("a", [1.0] * 4, "other", 4, [0.0, 1.0])), embedder=vector.HashingEmbedder(4))
    with pytest.raises(RuleError, match="fitted with"):
        evaluate(facts, 'rule "R" { when c_project(Request.tier, "a") > 5 then D.a = 1; }', ctx)


def test_grammar():
    rule = parse_rules('rule "Q \\"x\\"" salience -3 { // note\n when (A.b == 1 || A.c >= 2.5) && A.d contains "f(x)" then A.e = -1; LogMessage("hi"); }')[0]
    assert (rule.name, rule.salience, rule.no_loop) == ('Q "x"', -3, False)
    assert rule.then[0].value == Lit(-1)
    assert validate("rule { when")["ok"] is False
    with pytest.raises(RuleError):
        parse_rules('rule "N" { when !A.b then A.c = 1; }')
    with pytest.raises(RuleError):
        parse_query('query "Q" { strategy: depth-first }')


CHAIN = 'rule "B" { when A.x > 1 then B.y = true; } rule "C" { when B.y == true then C.z = true; } rule "Alt" { when A.x < 0 then C.z = true; }'


def test_proofs(spark):
    f = spark.createDataFrame([(1, 5), (2, 1), (3, -1), (4, None)], ["id", "A.x"])
    ask = lambda body: {r["id"]: r["proof"] for r in prove(f, CHAIN, f'query "Q" {{\n{body}\n}}').collect()}
    out = ask("goal: C.z == true\nstrategy: breadth-first")
    assert {i: p.provable for i, p in out.items()} == {1: True, 2: False, 3: True, 4: False}
    assert (out[1].steps, out[3].steps, out[2].steps, out[2].goal) == (["C"], ["Alt"], [], "")
    assert out[2].missing_facts == ["C.z == true"]
    assert not ask("goal: C.z == true\nmax-depth: 1")[1].provable and ask("goal: C.z == true\nmax-depth: 1")[3].provable
    assert not ask("goal: C.z == true\nwhen: A.x > 9")[1].provable
    assert ask("goal: (A.x == 1 || A.x == 5) && A.x < 4")[2].provable


def test_compare_and_promotion(spark):
    a, b = 'rule "X" { when A.b == 1 then A.c = 1; } rule "Y" { when A.b == 1 then A.c = 1; }', 'rule "Y" { when A.b == 2 then A.c = 1; } rule "Z" { when A.b == 1 then A.c = 1; }'
    assert compare(a, b) == {"only_a": ["X"], "only_b": ["Z"], "changed": ["Y"], "unchanged": 0}
    revisions = spark.createDataFrame([("r1", None), ("r2", "r1"), ("r3", "r1")], "revision string, parent string")
    assert can_promote(revisions, "r1", "r2", "ok") and not can_promote(revisions, "r2", "r3", "ok") and not can_promote(revisions, "r1", "r2", None)
