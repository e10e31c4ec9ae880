import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulegrain.functions import address, canon, fields, patterns, vector
from rulegrain.operators import geometry, store

MASKED = {
    # fixed values: forms that every implementation must agree on
    "latency=123ms": "latency=<*>",
    "ratio 1:2": "ratio 1:2",
    "localhost:8080": "localhost:<*>",
    # inputs of our own
    "Pump 17 lost contact with 172.16.4.9": "Pump <*> lost contact with <*>",
    "order=98765 state=open": "order=<*> state=open",
    "probe (8.8.4.4) late": "probe (<*>) late",
    "shelf [7]": "shelf [<*>]",
    "0xCAFE01 /srv/data/a.bin 2024-02-29T08:15:30": "<*> <*> <*>",
    "ü7 y": "ü7 y",
    "": "",
}


def test_masks(spark):
    df = spark.createDataFrame([(k,) for k in MASKED], "t string")
    assert {r[0]: r[1] for r in df.select("t", canon.log_mask(F.col("t"))).collect()} == MASKED


@pytest.mark.parametrize(
    "make, text, want",
    [
        (canon.json_hybrid, '{"state":"open","amount":75,"note":"call back"}', '{"amount":"<*>","note":"call back","state":"open"}'),
        (canon.json_hybrid, '{"outer":{"k":3,"list":["b",4]}}', '{"outer":{"k":"<*>","list":["b","<*>"]}}'),
        (canon.json_hybrid, "no record 19", "no record <*>"),
        (canon.json_hybrid, '{"a":NaN}', '{"a":NaN}'),
        (canon.json_schema, '{"state":"open","amount":75,"done":false}', '{"amount":"<num>","done":"<bool>","state":"<str>"}'),
        (canon.fnv1a_hex, "", "cbf29ce484222325"),
        (canon.fnv1a_hex, "a", "af63dc4c8601ec8c"),
    ],
)
def test_canonical_values(spark, make, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(make(F.col("t"))).first()[0] == want


def test_simhash_matches_plain_counting(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h

    text = "the disk of the node is full"
    ones = [sum(fnv(t) >> i & 1 for t in text.split()) for i in range(64)]
    want = sum(1 << i for i in range(64) if 2 * ones[i] > len(text.split()))
    got = spark.createDataFrame([(text,)], "t string").select(canon.simhash(F.col("t"))).first()[0]
    assert got % 2**64 == want


def test_simhash_of_odd_texts_and_long_ones(spark):
    texts = ["", " \u2003\t", None, "a", "a\x1cb a\u3000b ü漢字 😀", "x" * 70_000 + " y", " ".join(f"w{i % 977}" for i in range(70_000)), *(f"number {i} of {i * i} and so on" for i in range(40))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    rows = df.select("t", canon.simhash(F.col("t")).alias("a"), canon.simhash_inline(F.when(F.length("t") < 100, F.col("t"))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows if r["t"] is None or len(r["t"]) < 100) and len(rows) == len(texts)
    counts = [0] * 64
    for word in texts[6].split():
        h = 0xCBF29CE484222325
        for b in word.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        counts = [c + (h >> i & 1) for i, c in enumerate(counts)]
    assert next(r["a"] for r in rows if r["t"] == texts[6]) % 2**64 == sum(1 << i for i in range(64) if counts[i] > 35_000)


def test_similarity_hashes_of_documents_are_made_in_batches(spark, sf):
    from rulegrain.queries import queries

    plans = {name: queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString() for name in ("canon_route", "simhash", "near_dup_first")}
    assert all("zip_with" not in p for p in plans.values())
    assert ["ArrowEvalPython" in p for p in plans.values()] == [True, True, False]  # the last reads hashes that are made once


def test_near_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(12)]
    hashes = [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(5))) for b in base * 5]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    want = {i: next((j for j in range(i) if (hashes[j] ^ h).bit_count() <= 3), None) for i, h in enumerate(hashes)}
    assert {r["id"]: r["first"] for r in store.near_duplicates(df, "id", "h").collect()} == want


def test_pattern_sets_score_and_route(spark):
    def simhash(text):
        def fnv(s):
            h = 0xCBF29CE484222325
            for b in s.encode():
                h = ((h ^ b) * 0x100000001B3) % 2**64
            return h

        words = text.split()
        return sum(1 << i for i in range(64) if 2 * sum(fnv(t) >> i & 1 for t in words) > len(words))

    sets = {"disk": (["the disk of node 7 is full"], 20), "login": (["user bob logged in", "user has gone"], 6), "empty": ([], 64), "also": (["the disk of node 8 is full"], 6)}
    router = patterns.Router()
    for label, (examples, threshold) in sets.items():
        assert router.add(spark, label, examples, "log", threshold) == len(examples)
    texts = ["the disk of node 99 is full", "the disk of node 5 is now full", "user bob logged in", "user bob logged out", "", "something else altogether", None]
    masked = lambda t: " ".join("<*>" if w.isdigit() else w for w in t.split())

    def score(text, label):
        examples, threshold = sets.get(label, ([], 0))
        if text is None or not examples:
            return None
        best = min((simhash(masked(text)) ^ simhash(masked(e))).bit_count() for e in examples)
        return 1.0 if masked(text) in map(masked, examples) else 1 - best / 64 if best <= threshold else None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *(router.score(F.col("t"), F.lit(x)).alias(x) for x in [*sets, "unknown"]), router.classify(F.col("t")).alias("best")).collect()
    for row in got:
        want = {x: score(row["t"], x) for x in [*sets, "unknown"]}
        assert {x: row[x] for x in want} == want
        top = max(((s, x) for x, s in want.items() if s is not None), key=lambda p: p[0], default=None)
        named = top and (min(x for x, s in want.items() if s == top[0]), top[0])
        assert (row["best"] and tuple(row["best"])) == named
    assert got[0]["best"]["label"] == "also" and got[6]["best"] is None


def test_vectors_of_different_length_are_an_error(spark):
    v = vector.literal
    for make in (vector.dot, vector.cosine, vector.add, vector.l2_squared):
        with pytest.raises(Exception, match="vectors of dimensions 2 and 3"):
            spark.range(1).select(make(v([1, 0]), v([1, 0, 0]))).collect()
    none = F.lit(None).cast("array<double>")
    assert spark.range(1).select(vector.dot(v([1]), none), vector.cosine(none, v([1]))).first() == (None, None)


def test_vectors_by_join_and_by_canonical_text(spark):
    vectors = spark.createDataFrame([("pump 17", [1.0, 0.0]), ("door", [0.0, 1.0])], "text string, vector array<double>")
    rows = spark.createDataFrame([(1, "pump 99"), (2, "door"), (3, None)], "id int, t string")
    got = {r["id"]: r["vector"] for r in vector.with_vectors(rows, "t", vectors, canon.log_mask).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: None}
    with pytest.raises(Exception, match="no vector for text: pump 99"):
        vector.with_vectors(rows, "t", vectors).collect()
    wrapped = vector.CanonicalEmbedder(vector.HashingEmbedder(8), F.lower, str.lower, "lower/v1")
    assert wrapped.embed("A b") == wrapped.embed("a B") and wrapped.key("A") == wrapped.key("a") != vector.text_key("hashing", "", "a")
    same = rows.select(vector.text_key_column(F.lit("m"), F.lit("n"), F.col("t"))).first()[0]
    assert same == vector.text_key("m", "n", "pump 99")


def test_vectors(spark):
    v = vector.literal
    got = spark.range(1).select(vector.cosine(v([1, 0]), v([3, 0])), vector.dot(v([1, 0]), v([3, 0])), vector.cosine(v([0, 0]), v([1, 1])), vector.normalize(v([0, 0])), vector.percentile(F.lit(2.0), v([1, 2, 2, 3])), vector.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()
    assert (got[0], got[1], got[2], got[3], got[4]) == (1.0, 3.0, 0.0, None, 50.0)
    assert math.isclose(got[5], math.pi * 6371)


def test_hashing_embedder_is_the_same_on_both_sides(spark):
    words = vector.HashingEmbedder(8)
    texts = ["Buy two, get TWO", "", "plain é under_score 7"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words.column(F.col("t")).alias("v")).collect()
    for r in got:
        assert r["v"] == pytest.approx(words.embed(r["t"]))


def test_axis_region_and_artifacts(spark):
    df = spark.createDataFrame([([float(i % 3), float(i % 5) + 1, 0.1 * i],) for i in range(30)], "embedding array<double>")
    region = geometry.fit_region("r", df, 2, 0.9, "m")
    inside = df.where(vector.depth(F.col("embedding"), region) <= 1.0000001).count()
    assert inside == 27
    axis = geometry.calibrate(geometry.fit_axis("a", df.limit(3), df.where("embedding[0] = 2"), "m"), df)
    assert axis.calibration == sorted(axis.calibration) and len(axis.calibration) == 30
    store_ = geometry.Artifacts()
    store_.add(axis)
    store_.add(region)
    assert geometry.Artifacts.loads(store_.dumps()) == store_
    with pytest.raises(ValueError):
        store_.add(axis)


def test_patch_round_trip(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "id int, v string")
    ops = store.patch(old, new)
    assert sorted((r["id"], r["op"]) for r in ops.collect()) == [(1, "delete"), (3, "delete"), (3, "upsert"), (4, "upsert")]
    assert sorted(map(tuple, store.apply_patch(old, ops, new).collect())) == sorted(map(tuple, new.collect()))


def test_address(spark):
    texts = ["kindly send to 27 West Birch Lane Riverton IL 60999 soon", "Harbour Road, Riverton IL 60999", "nothing here", "ship to 12 Main Plaza Austin TX 78701", "at 4b elm road, reno nv 89501 thanks", "the Elm Street", "60999", "", None, "is The Tall Oak Ave"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(address.standardize(F.col("t"))).collect()]
    assert got[0].canonical == "27 west birch ln riverton il 60999" and got[0].valid and got[0].score == 1.0
    assert got[1].address == "Harbour Road, Riverton IL 60999" and got[1].parts.house_number is None
    assert not got[2].valid
    assert got[3].address == "12 Main Plaza Austin TX 78701" and tuple(got[3].parts) == ("12", "Main Plaza Austin", "Austin", "TX", "78701")
    assert got[4].address == "4b elm road, reno nv 89501" and tuple(got[4].parts) == ("4b", "Elm Road", "Reno", "NV", "89501")
    assert got[5].address == "Elm Street" and got[9].address == "Tall Oak Ave"
    assert got[6].parts.postal_code == "60999" and got[7].parts.road is None and got[8].address is None


def test_structured_address_evidence(spark):
    import json

    record = {"client": "Acme Company", "shipAddr": "500 oak street", "town": "austin", "state": "tx", "zip": "78701", "nation": "usa", "kind": {"purpose": ["ship to"]}, "none": " "}
    named = {"street": "main avenue", "house_number": "#12", "x": {"city": "new york", "n": None}}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, json.dumps(named)), (3, "{broken"), (4, None)], "id int, j string")
    rows = {r["id"]: r for r in df.select("id", fields.standardize(F.col("j")).alias("s"), fields.hints(F.col("j")).alias("h")).collect()}
    first = rows[1]["s"]["parts"].asDict()
    assert first == {"customer": "Acme Company", "address_role": "ship_to", "house_number": "500", "road": "Oak Street", "city": "Austin", "region": "TX", "postal_code": "78701", "country": "USA"}
    assert rows[1]["s"]["display"] == "500 Oak Street, Austin TX 78701, USA"
    assert rows[1]["s"]["canonical"] == "500 oak st austin tx 78701 us"
    assert rows[1]["s"]["valid"] and rows[1]["s"]["score"] == 1.0
    found = {(e["path"], e["role"]): (e["name_score"], e["content_score"], round(e["score"], 4)) for e in rows[1]["s"]["evidence"]}
    assert found[("$.zip", "postal_code")] == (1.0, 1.0, 1.0) and found[("$.town", "city")] == (1.0, 0.65, 0.8075)
    assert ("$.zip", "city") not in found and not any(p == "$.none" for p, _ in found)
    assert ("$.kind.purpose[0]", "address_role") in found
    second = rows[2]["s"]["parts"]
    assert (second["house_number"], second["road"], second["city"]) == ("12", "Main Avenue", "New York")
    assert [h["field"] for h in rows[2]["h"]] == ["$.house_number", "$.street", "$.x", "$.x.city", "$.x.n"]
    assert rows[2]["h"][0]["embedding_text"] == "address field meaning: housenumber"
    for bad in (3, 4):
        assert rows[bad]["s"]["evidence"] == [] and rows[bad]["s"]["score"] == 0.0 and rows[bad]["h"] == []


def test_house_numbers_of_five_digits_beside_a_postal_code(spark):
    records = ['{"addr": "10001 oak street", "zip": "78701"}', '{"addr": "10001 oak street"}', '{"addr": "78701 austin", "zip": "78701"}']
    rows = spark.createDataFrame(list(enumerate(records)), "i int, j string").select("i", fields.standardize(F.col("j"))["parts"].alias("p")).orderBy("i").collect()
    assert [(r["p"]["house_number"], r["p"]["road"]) for r in rows] == [("10001", "Oak Street"), (None, "10001 Oak Street"), (None, "78701 Austin")]


def test_embedding_evidence_reweighs(spark):
    df = spark.createDataFrame([('{"zip": "78701"}', [("$.zip", "postal_code", 7.0), ("$.zip", "postal_code", 0.1), ("$.other", "city", 1.0)])], "j string, e array<struct<path:string,role:string,score:double>>")
    got = df.select(F.explode(fields.evidence(F.col("j"), F.col("e"))).alias("x")).select("x.*").where("role = 'postal_code'").first()
    assert got["embedding_score"] == 1.0 and math.isclose(got["score"], 0.30 + 0.35 + 0.35)
    plain = df.select(F.explode(fields.evidence(F.col("j"), F.col("e"))).alias("x")).select("x.*").where("role = 'address_role'").first()
    assert plain["embedding_score"] is None and math.isclose(plain["score"], 0.55)


def test_address_rule_functions(spark):
    from rulegrain.plans.forward import evaluate

    df = spark.createDataFrame([("500 Oak Street, Austin TX 78701",), ("no address here",)], "text string").select(F.struct("text").alias("M"))
    rules = 'rule "A" no-loop { when b_addr_has_component(M.text, "road") && c_addr_confidence(M.text) > 0.9 then M.line = m_addr_standardize(M.text); M.code = m_addr_component(M.text, "postal_code"); }'
    got = evaluate(df, rules).select("M.line", "M.code").collect()
    assert [tuple(r) for r in got] == [("500 oak st austin tx 78701", "78701"), (None, None)]


def test_match_index_against_all_pairs(spark, monkeypatch):
    from rulegrain.functions import address

    monkeypatch.setattr(address, "HOT", 6)
    streets, towns = ["Birch", "Oak", "West Elm", "King"], ["Springfield IL 62701", "Austin TX 78701", "Austin TX", "Reno NV 89501"]
    texts = [f"{1 + i % 11} {streets[i % 4]} {('Road', 'Street')[i % 2]} {towns[i * 7 // 5 % 4]}{' x' * (i % 3)}" for i in range(60)] + [f"{i} Birch S#{i:04} Road Springfield IL 62701" for i in range(30)] + ["unlike", ""]
    index = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = index.withColumn("s", address.standardize(F.col("text"))).select("id", "s.canonical", F.when(F.col("id") % 9 == 0, F.col("s.parts").withField("region", F.lit(None).cast("string"))).otherwise(F.col("s.parts")).alias("parts"))
    norm = lambda t: " ".join(address.FORMS.get(w.lower(), w.lower()) for w in t.split())
    rows = [(r["id"], set(r["canonical"].split()), {k: norm(v) for k, v in r["parts"].asDict().items() if v is not None}) for r in index.collect()]
    want = []
    for a, ta, pa in rows:
        found = []
        for b, tb, pb in rows:
            if ta & tb and (s := round(0.55 * len(ta & tb) / len(ta | tb) + 0.45 * (sum(pb.get(k) == v for k, v in pa.items()) / len(pa.keys() | pb.keys()) if pa or pb else 0), 6)) >= 0.5:
                found.append((-s, b))
        want += [(a, b, -s, n + 1) for n, (s, b) in enumerate(sorted(found)[:3])]
    got = sorted(tuple(r) for r in address.match_index(index, index, 3).collect())
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in sorted(want)]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, sorted(want), strict=True))


def test_reference_match_against_all_pairs(spark):
    import random
    import re

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    refs = [(f"r{i}", ("customer", "brand")[i % 2], " ".join(word() for _ in range(rng.randrange(1, 4))), [" ".join(word() for _ in range(2))] if i % 3 else []) for i in range(30)]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 9))) for _ in range(60)] + [r[2].replace(" ", "") for r in refs[:9]] + [f"to {r[2].upper()}!" for r in refs[:9]] + ["", "?"]

    def feats(t):
        w = re.sub("[^a-z0-9]+", " ", t.lower()).split()
        return {("1", x) for x in w} | {("3", x[i : i + 3]) for x in w for i in range(len(x) - 2)} | {("2", *p) for p in zip(w, w[1:], strict=False)}, w

    want = set()
    for i, t in enumerate(texts):
        tf, tw = feats(t)
        for rid, kind, name, aliases in refs:
            best = None
            for alias in [*aliases, name]:
                rf, rw = feats(alias)
                if not rw or not tw:
                    continue
                exact = 1.0 if any(tw[a : a + len(rw)] == rw for a in range(len(tw) - len(rw) + 1)) else 0.92 if len(tw) >= len(rw) and "".join(rw) in "".join(tw) else 0.0
                lexical = round(len(rf & tf) / len(rf), 6)
                if exact or lexical >= 0.45:
                    best = max(best or (0, 0, ""), (exact, lexical, alias))
            if best and round(0.65 * best[0] + 0.35 * best[1], 6) >= 0.42:
                want.add((i, rid, kind, name, *best))
    ref = address.read_reference(spark.createDataFrame(refs, "id string, type string, customer_name string, aliases array<string>"))
    got = address.reference_match(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), ref).collect()
    assert {(r["id"], r["ref_id"], r["kind"], r["name"], round(r["exact"], 2), round(r["lexical"], 6)) for r in got} == {x[:6] for x in want} and len(got) == len(want)


def test_reference_match_keeps_to_alike_names_and_shuffles_texts(spark):
    names = [f"Supplier#{i:09d}" for i in range(40)] + ["Oak", "oak tree works", "a"]
    ref = address.read_reference(spark.createDataFrame([(n, n) for n in names], "id string, name string"))
    said = [f"ship to {n} road" for n in names[:20]] * 2 + ["an oak", "the tree works of oaks", None]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(said)] + [(None, "an oak")], "id long, text string")
    found = address.reference_match(texts, ref)
    exact = {(r["id"], r["name"]) for r in found.collect()}
    assert exact == {(i, t[8:-5]) for i, t in enumerate(said[:40])} | {(40, "Oak")} | {(i, "a") for i, t in enumerate(said) if t and "a" in t} | {(41, "Oak")}
    alike = {(r["id"], r["name"]) for r in address.reference_match(texts, ref, least=0.2).collect() if r["exact"] == 0}
    assert {n for i, n in alike if i == 0} == set(names[1:40]) and (41, "oak tree works") in alike
    # a table of texts that repeat looks small when it is written: it must never be broadcast
    assert "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()


def test_names_with_common_words_meet_few_texts(spark, monkeypatch):
    met, plain = [], address._meetings

    def told(*args):
        met.append(plain(*args).count())
        return plain(*args)

    monkeypatch.setattr(address, "_meetings", told)
    s = spark.range(300).select("id", F.format_string("Supplier#%09d", "id").alias("name"))
    text = F.concat(F.lit("Please ship to "), F.col("id").cast("string"), F.lit(" Birch "), F.col("name"), F.lit(" Road Springfield IL 62701"))
    rows = s.select("id", text.alias("text"))
    index = address.index_records(rows.withColumn("id", F.col("id").cast("string")), "id", "text")
    out = address.verify(rows, "text", "", index, address.read_reference(s))
    assert out.where(F.size("reference_matches") == 1).where(F.col("reference_matches")[0]["name"] == F.format_string("Supplier#%09d", "id")).count() == 300
    assert met and all(n <= 2 * 300 for n in met)  # not 300 * 300


def test_index_functions_in_rules(spark):
    from rulegrain.plans.forward import Context, evaluate

    places = spark.createDataFrame([("p1", "27 Birch Lane Riverton IL 60999"), (None, "9 Oak Road Reno NV 89501")], "id string, text string").withColumn("ord", F.lit(1))
    index = address.index_records(places, "id", "text")
    ref = address.read_reference(spark.createDataFrame([("c1", "customer", "Harbour Tools"), (None, None, "Birch")], "id string, kind string, name string").withColumn("ord", F.lit(7)))
    facts = spark.createDataFrame([(1, "Harbour Tools ship to 27 Birch Lane Riverton IL 60999"), (2, "9 Oak Road"), (3, None)], "id int, text string").select("id", F.struct("text").alias("M"))
    pack = 'rule "A" no-loop { when b_addr_index_match(M.text) == true then M.id = m_addr_index_match_id(M.text); M.score = c_addr_index_score(M.text); } rule "R" no-loop { when c_ref_match_count(M.text, "customer") > 0 && b_ref_match(M.text, "customer", "Harbour Tools") == true then M.name = m_ref_match_name(M.text, "customer"); M.rid = m_ref_match_id(M.text, "customer"); M.exact = c_ref_exact_score(M.text, "customer"); M.lex = c_ref_lexical_score(M.text, "customer"); M.all = c_ref_match_score(M.text, "customer"); } rule "S" no-loop { when M.text != null then standardize_address(M.text, "Out.line"); }'
    ctx = Context()
    got = {r["id"]: r for r in evaluate(address.attach(facts, ctx, pack, index, ref), pack, ctx).collect()}
    assert got[1]["fired"] == ["A", "R", "S"] and got[2]["fired"] == ["S"] and got[3]["fired"] == []
    assert got[1]["M"].asDict() == {"text": facts.first()["M"]["text"], "id": "p1", "score": 1000, "name": "Harbour Tools", "rid": "c1", "exact": 1000, "lex": 1000, "all": 1000}
    assert got[2]["Out"]["line"] == "9 oak rd"
    with pytest.raises(ValueError, match="attach"):
        evaluate(facts, pack)


def test_lexical_vectors(spark):
    df = spark.createDataFrame([(1, "Oak Tools"), (2, "oak  tools"), (3, "?")], "id int, t string")
    got = {r["id"]: r["vector"] for r in address.lexical_vector(df, "id", "t").collect()}
    assert got[1] == got[2] and len(got[1]) == 128 and math.isclose(sum(x * x for x in got[1]), 1) and got[3] is None


def test_keys_and_backfill(spark):
    log = spark.createDataFrame([("a", "x", [1.0], None), ("b", "y", None, None), ("c", "z", [1.0], [5.0])], "k string, t string, v array<double>, w array<double>")
    new = spark.createDataFrame([("a", [2.0], 1), ("a", [3.0], 2)], "k string, vector array<double>, at int")
    assert {r["k"]: r["v"] for r in store.add_vector(log, new, "k", "v", "at").collect()} == {"a": [3.0], "b": None, "c": [1.0]}
    with pytest.raises(Exception, match="no row for key q"):
        store.add_vector(log, new.withColumn("k", F.lit("q")), "k", "v").collect()
    assert store.index_len(log, "v") == 2 and store.get(log, "b", "k").first()["t"] == "y"
    filled = store.detail_backfill(log, "v", "w", lambda t: F.array(F.length(t).cast("double")), "t")
    assert {r["k"]: r["w"] for r in filled.collect()} == {"a": [1.0], "b": None, "c": [5.0]}
    found = spark.createDataFrame([("a", 0.5)], "k string, distance double")
    assert store.resolve(found, log, "k").first()["t"] == "x"
    with pytest.raises(Exception, match="no row for key"):
        store.resolve(found.withColumn("k", F.lit("q")), log, "k").collect()
    keys = [r[0] for r in spark.createDataFrame([(5,), (70,), (6,)], "t long").select("t", store.inverse_time_key(F.col("t")).alias("k")).orderBy("k").collect()]
    assert keys == [70, 6, 5]


def test_canonical_strategies(spark):
    assert canon.namespace("log-mask") == "log-mask/v1" and canon.STRATEGIES["identity"][0](F.col("x")) is not None
    df = spark.createDataFrame([('{"query":"q","content":"c"}', "a"), ('{"content":"c"}', None), ("plain", "b")], "r string, a string")
    assert [r[0] for r in df.select(canon.search_text(F.col("r"), F.col("a"))).collect()] == ["q\na", "c\n", "plain\nb"]
    with pytest.raises(ValueError, match="0 to 64"):
        patterns.Router().add(spark, "x", ["y"], "log", 65)
    with pytest.raises(ValueError, match="label"):
        patterns.Router().add(spark, " ", ["y"])


def test_address_match_searches_every_supplier(spark, sf, tmp_path):
    from rulegrain.queries import queries

    base = spark.read.parquet(f"{sf}/supplier.parquet").limit(1)
    base.drop("s_suppkey").crossJoin(spark.range(1, 91).select(F.col("id").alias("s_suppkey"))).withColumn("s_name", F.format_string("Supplier#%09d", "s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = queries()["address_match"](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == set(range(1, 91)) and all(r["rank"] > 1 or r["query_id"] == r["id"] for r in got)


def test_percentile_works_a_score_out_once(spark):
    score = vector.project(F.array("s", F.lit(1.0)), vector.literal([1.0, 0.0]))
    df = spark.range(20).select((F.col("id") / 20.0).alias("s")).select(vector.percentile_among(score, [i / 3000 for i in range(3000)]).alias("p"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == 1 and plan.count("SQRT") == 1  # in a lambda it would be worked out for every score it meets


def test_percentile_is_exact_among_many_scores(spark):
    angle = F.pmod(F.col("id") * 7919, F.lit(12000)) / 8000.0
    df = spark.range(24001).select("id", F.array(F.cos(angle), F.sin(angle)).alias("embedding"))
    axis = geometry.calibrate(geometry.Axis("a", [1.0, 0.0], "m", 2), df)
    scores = np.array(axis.calibration)
    assert len(scores) == 24001
    raw = df.select(vector.project(F.col("embedding"), vector.literal(axis.direction)).alias("s")).limit(300).union(spark.createDataFrame([(-2.0,), (2.0,), (0.5,), (float(scores[-1]),)], "s double"))
    for known in (scores, scores[:2], scores[:7], np.full(5, 0.5)):
        got = raw.select("s", vector.percentile_among(F.col("s"), known.tolist()).alias("p")).collect()
        assert all(abs(r["p"] - 100.0 * ((known < r["s"]).sum() + (known == r["s"]).sum() / 2) / len(known)) < 1e-9 for r in got)
