"""Addresses and reference names as built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.functions.canon import SPACE, fnv1a_hex
from rulegrain.operators.scratch import materialise

# fixed values: token forms, and the weights of the validity score
FORMS = {"street": "st", "avenue": "ave", "road": "rd", "lane": "ln", "drive": "dr", "boulevard": "blvd", "usa": "us"}
SUFFIXES = "street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|way"
STOP_WORDS = "is|to|for|the|a|an|requested|bill-to|ship-to"
STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
WEIGHTS = {"house_number": 0.22, "road": 0.30, "city": 0.18, "region": 0.15, "postal_code": 0.15}
VALID = 0.72
PARTS = tuple(WEIGHTS)
#: Tokens and components of more index rows than this are met as profiles.
HOT = 64
#: Weight of resemblance in a reference match; lengths of the pieces by which names are looked up; so many aliases are broadcast.
LEXICAL, GRAMS, FEW = 0.35, (1, 2, 3, 6, 12, 24), 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bare(x: Column) -> Column:
    """Without punctuation at its ends, hyphens excepted."""
    return F.regexp_replace(x, r"^[\p{Punct}&&[^-]]+|[\p{Punct}&&[^-]]+$", "")


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens in their short forms."""
    forms = F.create_map(*(F.lit(x) for kv in FORMS.items() for x in kv))
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda x: F.length(x) > 0)
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(forms, w), w))


def bound(x: Column, make) -> Column:
    """make(x), with x worked out once."""
    return F.transform(F.array(x), make)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: F.length(w) > 0)


def _zip(w: Column) -> Column:
    return bare(w).rlike(r"^[0-9]{5}\z")


def _state(w: Column) -> Column:
    return F.translate(bare(w), LOWER, UPPER).isin(*STATES.split("|"))


def _suffix(w: Column) -> Column:
    return F.translate(bare(w), UPPER, LOWER).isin(*SUFFIXES.split("|"))


def _number(w: Column) -> Column:
    return w.rlike("[0-9]") & ~_zip(w)


def _places(words: Column, test) -> Column:
    """Indexes, from 0, of the words that test holds for; null elsewhere."""
    return F.transform(words, lambda w, i: F.when(test(w), i))


def title(text: Column) -> Column:
    """Words without punctuation at their ends, with a capital first letter."""
    cased = lambda w: F.concat(F.translate(F.substring(w, 1, 1), LOWER, UPPER), F.translate(F.substring(w, 2, 1 << 30), UPPER, LOWER))
    return F.array_join(F.transform(_words(text), lambda w: cased(bare(w))), " ")


def span(text: Column) -> Column:
    """The words of a text that are an address, or null.

    It begins at the first word with a digit that isn't a postal code, or else at the capitalised words
    before the first street suffix (back to a stop word); it ends after a state and a postal code next to it, after a
    postal code, or with the text.
    """

    def begin(words: Column) -> Column:
        suffix = F.array_min(_places(words, _suffix))
        breaks = lambda w: (F.length(bare(w)) == 0) | F.translate(bare(w), UPPER, LOWER).isin(*STOP_WORDS.split("|")) | ~bare(w).rlike(r"^\p{Lu}")
        back = lambda s: F.coalesce(F.array_max(F.filter(_places(words, breaks), lambda i: i < s)) + 1, F.lit(0))
        walked = bound(suffix, lambda s: bound(back(s), lambda at: F.when(at < s, at)))
        return F.coalesce(F.array_min(_places(words, _number)), walked)

    def cut(words: Column) -> Column:
        def until(at: Column) -> Column:
            state, code = (F.array_min(F.filter(_places(words, test), lambda i: i > at)) for test in (_state, _zip))
            by_state = F.when(_zip(F.get(words, state + 1)), state + 2).otherwise(state + 1)
            end = F.when(state < F.coalesce(code, F.lit(1 << 30)), by_state).otherwise(F.coalesce(code + 1, F.size(words)))
            return F.when(at.isNotNull(), F.array_join(F.slice(words, at + 1, F.greatest(end - at, F.lit(0))), " "))

        return bound(begin(words), until)

    return bound(_words(text), cut)


def components(text: Column, coded: Column | None = None) -> Column:
    """struct of house_number, road, city, region and postal_code found in an address.

    The road goes to the first street suffix, or over four words; the city is the word before the last state.
    Five digits are a postal code; where coded holds (the code is known to stand elsewhere), they're a house number at the beginning of a road.
    """

    def found(words: Column) -> Column:
        first = F.get(words, F.lit(0))
        plain = ~_zip(first) if coded is None else ~_zip(first) | F.coalesce(coded & (F.array_min(_places(words, _suffix)) > 0), F.lit(False))
        house = F.when(first.rlike("[0-9]") & plain, bare(first))
        state = F.array_max(_places(words, _state))
        end = F.coalesce(F.array_min(_places(words, _suffix)) + 1, F.least(F.size(words), F.lit(4)))
        begin = F.when(house.isNotNull(), 1).otherwise(0)
        road = F.when(end > begin, title(F.array_join(F.slice(words, begin + 1, F.greatest(end - begin, F.lit(0))), " ")))
        code = F.get(words, F.array_max(_places(words, _zip)))
        region = F.translate(bare(F.get(words, state)), LOWER, UPPER)
        city = F.when(state > 0, title(F.get(words, F.greatest(state - 1, F.lit(0)))))
        return F.struct(house.alias("house_number"), road.alias("road"), city.alias("city"), region.alias("region"), bare(code).alias("postal_code"))

    return bound(_words(text), found)


def normal(text: Column) -> Column:
    """Words in lower case and short forms, without punctuation at their ends."""
    forms = F.create_map(*(F.lit(x) for kv in FORMS.items() for x in kv))
    words = F.transform(_words(text), lambda w: F.translate(bare(w), UPPER, LOWER))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(forms, w), w)), " ")


def line_tokens(canonical: Column) -> Column:
    """Distinct tokens of a canonical line."""
    return F.array_distinct(_words(canonical))


def score(parts: Column) -> Column:
    """Sum of the weights of the components that are there."""
    return F.round(sum((F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0)), 6)


def has_minimum_shape(parts: Column) -> Column:
    return parts["road"].isNotNull() & (parts["house_number"].isNotNull() | parts["postal_code"].isNotNull() | parts["city"].isNotNull())


def display(parts: Column, country: Column | None = None) -> Column:
    """"number road, city region code, country", as far as they are known; no number without a road."""
    street = F.concat_ws(" ", F.when(parts["road"].isNotNull(), parts["house_number"]), parts["road"])
    pieces = F.array(street, F.concat_ws(" ", parts["city"], parts["region"], parts["postal_code"]), F.lit(None).cast("string") if country is None else country)
    return F.array_join(F.filter(pieces, lambda x: F.length(x) > 0), ", ")


def canonical(parts: Column, country: Column | None = None) -> Column:
    """The displayed line's words in lower case and short forms, without punctuation at their ends."""
    return normal(display(parts, country))


def standardize(text: Column) -> Column:
    """struct<address, parts, display, canonical, key, score, valid> of a text."""
    def told(address: Column) -> Column:
        return bound(components(address), lambda parts: bound(canonical(parts), lambda line: F.struct(address.alias("address"), parts.alias("parts"), display(parts).alias("display"), line.alias("canonical"), fnv1a_hex(line).alias("key"), score(parts).alias("score"), (score(parts) >= VALID).alias("valid"))))

    return bound(F.coalesce(span(text), F.btrim(text)), told)


def match_index(queries: DataFrame, index: DataFrame, limit: int = 5, least: float = 0.5) -> DataFrame:
    """(query_id, id, score, rank): 0.55 Jaccard of tokens and 0.45 the share of equal components among those either side has.

    queries and index: id, canonical, parts.  Exact, without meeting every pair: rows that
    share a token or component of at most HOT index rows meet; what others score
    follows from their common features (profile), their number of tokens and which components they have, so a
    profile of queries needs only the first `limit` ids by that score.  A pair of both kinds scores more than its
    profile says, so none of the best is lost.  Work grows with the pairs of profiles.
    """
    def part(rows: DataFrame) -> tuple[Column, Column]:
        """Components as texts, and as bits which there are."""
        names = [k for k in (*PARTS, "country") if k in rows.schema["parts"].dataType.fieldNames()]
        held = F.filter(F.array(*(F.concat(F.lit(f"{k} "), normal(F.col(f"parts.{k}"))) for k in names)), lambda x: x.isNotNull())
        return held, sum((F.when(F.col(f"parts.{k}").isNotNull(), 1 << i).otherwise(0) for i, k in enumerate((*PARTS, "country")) if k in names), F.lit(0))

    token = lambda t: F.transform(t, lambda x: F.concat(F.lit("t "), x))
    (q_parts, q_bits), (x_parts, x_bits) = part(queries), part(index)
    q = materialise(queries.select(F.col("id").alias("query_id"), line_tokens(F.col("canonical")).alias("qt"), q_parts.alias("qp"), q_bits.alias("qb")), "match-queries")
    x = materialise(index.select("id", line_tokens(F.col("canonical")).alias("xt"), x_parts.alias("xp"), x_bits.alias("xb")), "match-index")

    def score(common, equal, nq, nx, bits) -> Column:
        return F.round(0.55 * (common / (nq + nx - common)) + 0.45 * F.when(bits > 0, equal / F.bit_count(bits)).otherwise(0.0), 6)

    qf = q.select("query_id", F.explode(F.concat(token(F.col("qt")), "qp")).alias("f"))
    xf = x.select("id", F.explode(F.concat(token(F.col("xt")), "xp")).alias("f"))
    hot = xf.groupBy("f").count().where(F.col("count") > HOT).select("f")
    near = qf.join(hot, "f", "left_anti").join(xf.join(hot, "f", "left_anti"), "f").select("query_id", "id").distinct()
    held = lambda rows, by, to: rows.join(hot, "f", "left_semi").groupBy(by).agg(F.sort_array(F.collect_list("f")).alias(to))
    qs = q.join(held(qf, "query_id", "qh"), "query_id").select("query_id", "qh", F.size("qt").alias("nq"), "qb")
    xs = x.join(held(xf, "id", "xh"), "id").select("id", "xh", F.size("xt").alias("nx"), "xb")
    first = xs.withColumn("n", F.row_number().over(Window.partitionBy("xh", "nx", "xb").orderBy("id"))).where(F.col("n") <= limit).drop("n")
    words = lambda h: F.filter(h, lambda f: F.startswith(f, F.lit("t ")))
    qk, xk = qs.select("qh", "nq", "qb").distinct(), first.select("xh", "nx", "xb").distinct()
    met = qk.withColumn("f", F.explode(words(F.col("qh")))).join(xk.withColumn("f", F.explode(words(F.col("xh")))), "f").groupBy("qh", "nq", "qb", "xh", "nx", "xb").agg(F.count(F.lit(1)).alias("common"))
    met = met.withColumn("s", score(F.col("common"), F.size(F.array_intersect("qh", "xh")) - F.col("common"), F.col("nq"), F.col("nx"), F.col("qb").bitwiseOR(F.col("xb")))).where(F.col("s") >= least)
    top = Window.partitionBy("qh", "nq", "qb").orderBy(F.col("s").desc(), "id")
    heads = met.join(first, ["xh", "nx", "xb"]).withColumn("n", F.row_number().over(top)).where(F.col("n") <= limit).select("qh", "nq", "qb", "id")
    both = near.union(qs.join(heads, ["qh", "nq", "qb"]).select("query_id", "id")).distinct().join(q, "query_id").join(x, "id")
    common = F.size(F.array_intersect("qt", "xt"))
    best = both.withColumn("score", score(common, F.size(F.array_intersect("qp", "xp")), F.size("qt"), F.size("xt"), F.col("qb").bitwiseOR(F.col("xb")))).where((common > 0) & (F.col("score") >= least))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def select_address(candidates: DataFrame, group: str, weights: dict[str, int], penalty: int = 10, bonus: Column | None = None) -> DataFrame:
    """The best candidate of each group: role weight + floor(confidence * weight) - depth * penalty + bonus; ties to the larger id."""
    role = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    w = F.coalesce(F.try_element_at(role, F.col("role")), F.lit(0))
    total = w + F.floor(F.col("confidence") * w) - F.col("hierarchy_depth") * penalty + (bonus if bonus is not None else F.lit(0))
    scored = candidates.withColumn("score", total.cast("long"))
    others = [c for c in scored.columns if c != group]
    return scored.groupBy(group).agg(F.max_by(F.struct(*others), F.struct("score", "id")).alias("x")).select(group, "x.*")


def reference_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda x: F.length(x) > 0)


def features(text: Column) -> Column:
    """Distinct words, trigrams of each word, and pairs of adjacent words of a name."""

    def made(words: Column) -> Column:
        spans = lambda n: F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n)
        tri = F.flatten(F.transform(words, lambda w: F.transform(spans(F.length(w) - 2), lambda i: F.concat(F.lit("3:"), F.substring(w, i, F.lit(3))))))
        bi = F.transform(spans(F.size(words) - 1), lambda i: F.concat(F.lit("2:"), F.get(words, i - 1), F.lit(" "), F.get(words, i)))
        return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("1:"), w)), tri, bi))

    return bound(reference_words(text), made)


def read_reference(records: DataFrame) -> DataFrame:
    """(ref_id, kind, name, aliases) of records with id, kind or type, name or customer_name, aliases, as far as they have
    them; ord numbers records for the id where there is none.  Records without a name are left out; the name is an alias."""
    col = lambda *names: F.coalesce(*(F.col(f"`{n}`").cast("string") for n in names if n in records.columns), F.lit(None).cast("string"))
    kind, name = F.coalesce(col("kind", "type"), F.lit("reference")), F.coalesce(col("name", "customer_name"), F.lit(""))
    given = F.coalesce(F.col("aliases"), F.array().cast("array<string>")) if "aliases" in records.columns else F.array().cast("array<string>")
    aliases = F.filter(F.concat(given, F.array(name)), lambda a: F.length(F.trim(a)) > 0)
    place = F.col("ord") if "ord" in records.columns else F.monotonically_increasing_id()
    return records.select(F.coalesce(col("id"), F.concat(kind, F.lit(":"), place.cast("string"))).alias("ref_id"), kind.alias("kind"), name.alias("name"), aliases.alias("aliases")).where("name <> ''")


def _meetings(t: DataFrame, r: DataFrame, beside, alike: bool, similar: float) -> DataFrame:
    """(tid, rid) of the texts and aliases that may match; alike: also those that only resemble one another."""
    hashed = lambda x: F.transform(x, lambda f: F.xxhash64(f))  # noqa: E731  equal hashes only propose a pair
    spans = lambda x, n: F.filter(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.length(x))
    grams = lambda x, n: F.array_distinct(F.transform(spans(x, n), lambda i: F.xxhash64(F.concat(F.lit("c:"), F.substring(x, i, n)))))
    sizes = sorted(x[0] for x in r.select("size").distinct().collect())  # of GRAMS
    pieces = [grams(F.col("tc"), F.lit(n)) for n in sizes] + ([hashed("tf")] if alike else [])
    emitted = t.select("tid", F.explode(F.concat(F.array().cast("array<bigint>"), *pieces)).alias("f"))
    one = lambda letters, f: F.struct(F.lit(letters).alias("letters"), f.alias("f"))
    own = [F.transform(grams(F.col("rc"), F.col("size")), lambda f: one(True, f))] + ([F.transform(hashed("rf"), lambda f: one(False, f))] if alike else [])
    wanted = r.select("rid", F.size("rf").alias("n"), F.explode(F.concat(*own)).alias("w")).select("rid", "n", "w.*")
    known = emitted.join(beside(wanted.select("f").distinct()), "f", "left_semi")
    often = known.groupBy("f").count()
    rank = F.row_number().over(Window.partitionBy("rid", "letters").orderBy(F.coalesce("count", F.lit(0)), "f"))
    probes = wanted.join(often, "f", "left").withColumn("rank", rank)
    probes = probes.where(F.when(F.col("letters"), F.col("rank") == 1).otherwise(F.col("rank") <= F.col("n") - F.ceil(F.lit(similar) * F.col("n") - 1e-9) + 1)).select("rid", "f")
    return known.join(beside(probes), "f").select("tid", "rid").distinct()


def reference_match(texts: DataFrame, reference: DataFrame, least: float = 0.42, similar: float = 0.45) -> DataFrame:
    """(id, ref_id, kind, name, alias, exact, lexical, score): names and aliases that a text holds or resembles.

    texts: id, text; reference: ref_id, kind, name, aliases.  exact: 1 if the alias's words stand in the text one after
    another, 0.92 if its letters do, without spaces; lexical: the share of its features the text has.  Of a record the
    alias of the highest exact, then lexical score counts.

    An alias meets a text by its rarest piece of letters without spaces, pieces being as long as fits of GRAMS; and, where
    resemblance alone can reach `least`, by its rarest features, as many as one must be among for the share
    `similar` to be reached.  What all texts have in common pairs nothing.  Equal texts are matched once.
    """
    alike = least <= LEXICAL  # else only what stands in the text scores enough
    r = reference.select("ref_id", "kind", "name", F.posexplode(F.array_distinct("aliases")).alias("a", "alias"))
    r = r.withColumns({"rf": features(F.col("alias")), "rn": F.array_join(reference_words(F.col("alias")), " ")}).where("rn <> ''").withColumn("rc", F.replace("rn", F.lit(" ")))
    r = r.withColumn("size", reduce(lambda out, n: F.when(F.length("rc") >= n, n).otherwise(out), GRAMS, F.lit(1))).withColumn("rid", F.monotonically_increasing_id())
    r = materialise(r, "match-reference")
    t = texts.select("text").distinct().withColumns({"tf": features(F.col("text")), "tn": F.array_join(reference_words(F.col("text")), " ")}).where("tn <> ''")
    t = materialise(t.withColumns({"tc": F.replace("tn", F.lit(" ")), "tid": F.monotonically_increasing_id()}), "match-texts")
    # Written tables look small to the planner where their rows repeat, so it is told which to broadcast
    beside = F.broadcast if r.count() <= FEW else lambda rows: rows.hint("merge")
    met = _meetings(t, r, beside, alike, similar)
    both = met.join(t.hint("merge"), "tid").join(beside(r), "rid")
    phrase = F.contains(F.concat(F.lit(" "), "tn", F.lit(" ")), F.concat(F.lit(" "), "rn", F.lit(" ")))
    enough = F.size(F.split("tn", " ")) >= F.size(F.split("rn", " "))
    exact = F.when(phrase, 1.0).when(enough & F.contains("tc", F.col("rc")), 0.92).otherwise(0.0)
    both = both.withColumn("exact", exact).where(F.lit(alike) | (F.col("exact") > 0))
    both = both.withColumn("lexical", F.round(F.size(F.array_intersect("rf", "tf")) / F.size("rf"), 6)).where((F.col("exact") > 0) | (F.col("lexical") >= similar))
    best = lambda rows, key, *of: rows.groupBy(key, "ref_id", "kind", "name").agg(F.max(F.struct(*of)).alias("b"))
    found = best(both, "text", "exact", "lexical", "alias")
    found = best(texts.where("id is not null").select("id", "text").join(found, "text"), "id", "b.exact", "b.lexical", "b.alias")
    out = found.select("id", "ref_id", "kind", "name", "b.alias", "b.exact", "b.lexical")
    return out.withColumn("score", F.round((1 - LEXICAL) * F.col("exact") + LEXICAL * F.col("lexical"), 6)).where(F.col("score") >= least)


def lexical_vector(rows: DataFrame, id: str, text: str, dim: int = 128) -> DataFrame:
    """(id, vector): signed feature hashing of a text's features, L2 normalised; null for a text without features."""
    codes = F.transform(features(F.col(text)), lambda f: F.xxhash64(f))
    sign = lambda h: F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = F.aggregate(codes, F.array_repeat(F.lit(0.0), dim), lambda v, h: F.transform(v, lambda x, i: x + F.when(i == F.pmod(h, F.lit(dim)), sign(h)).otherwise(0.0)))
    return rows.select(id, bound(sums, lambda v: bound(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))).alias("vector"))


def component(text: Column, name: Column) -> Column:
    """The named component of a text's address; null if it has none."""
    parts = standardize(text)["parts"]
    known = F.create_map(*(x for k in PARTS for x in (F.lit(k), parts[k])))
    return F.try_element_at(known, name)


# -- rule functions on indexes


INDEXED = {
    "c_addr_index_score": ("c", 1), "b_addr_index_match": ("b", 1), "m_addr_index_match_id": ("m", 1),
    "c_ref_match_count": ("c", 2), "m_ref_match_name": ("m", 2), "m_ref_match_id": ("m", 2),
    "c_ref_exact_score": ("c", 2), "c_ref_lexical_score": ("c", 2), "c_ref_match_score": ("c", 2), "b_ref_match": ("b", 3),
}
MATCHED = 0.85
_NO_MATCH = "struct<id:string,score:double>"
_FOUND = "array<struct<ord:double,kind:string,name:string,ref_id:string,exact:double,lexical:double,score:double>>"


def attach(df: DataFrame, ctx, rules, index: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """df with the best index record and the reference matches of every text that the rules ask an index function about.

    index: id, canonical, parts (see index_records); reference: see read_reference; both best a table, not a plan.  Each distinct text is matched
    once, by joins, and ctx is told in which columns the results stand; evaluate(df, rules, ctx) then finds them.
    """
    from rulegrain.plans.grammar import calls_in, parse_rules

    parsed = parse_rules(rules) if isinstance(rules, str) else rules
    calls = [c for r in parsed for node in (r.when, *r.then) for c in calls_in(node) if c.name in INDEXED]
    for node in {repr(c.args[0]): c.args[0] for c in calls}.values():
        text = F.lit(node.value) if hasattr(node, "value") else F.col(str(node))
        name = f"__match_{len(ctx.attached)}"
        texts = df.select(text.alias("text")).where("text is not null").distinct()
        joined, at = df.withColumn("__text", text), {}
        uses = {c.name[:6] for c in calls if repr(c.args[0]) == repr(node)}
        if uses & {"c_addr", "b_addr", "m_addr"}:
            if index is None:
                raise ValueError("the rules ask an address index, and none is given")
            queries = texts.select(F.col("text").alias("id"), standardize(F.col("text")).alias("s")).select("id", "s.canonical", "s.parts")
            best = match_index(queries, index, 1).select(F.col("query_id").alias("__text"), F.struct(F.col("id").cast("string").alias("id"), "score").alias(f"{name}a"))
            joined, at["a"] = joined.join(best, "__text", "left"), f"{name}a"
        if any(c.name.split("_")[1] == "ref" for c in calls if repr(c.args[0]) == repr(node)):
            if reference is None:
                raise ValueError("the rules ask a reference, and none is given")
            found = reference_match(texts.select(F.col("text").alias("id"), "text"), reference)
            row = F.struct((-F.col("score")).alias("ord"), "kind", "name", "ref_id", "exact", "lexical", "score")
            found = found.groupBy(F.col("id").alias("__text")).agg(F.sort_array(F.collect_list(row)).alias(f"{name}r"))
            joined, at["r"] = joined.join(found, "__text", "left"), f"{name}r"
        df = joined.drop("__text")
        ctx.attached[repr(node)] = at
    return df


def index_records(records: DataFrame, id: str, text: str) -> DataFrame:
    """An address index (id, canonical, parts, display) of a table of texts; records without an id are named by `ord`, their number."""
    place = F.col("ord") if "ord" in records.columns else F.monotonically_increasing_id()
    made = records.select(F.coalesce(F.col(id).cast("string"), F.concat(F.lit("record:"), place.cast("string"))).alias("id"), standardize(F.col(text)).alias("s"))
    return made.select("id", "s.canonical", "s.parts", "s.display")


def _indexed(name: str):
    kind, arity = INDEXED[name]

    def build(compiler, args, it):
        if len(args) != arity:
            raise ValueError(f"{name} requires {arity} arguments, got {len(args)}")
        at = compiler.ctx.attached.get(repr(args[0]))
        if at is None:
            raise ValueError(f"{name}: attach() the index to the facts first")
        if "addr" in name:
            best = F.col(at["a"])
            thousandths = F.floor(F.coalesce(best["score"], F.lit(0.0)) * 1000 + 1e-9)
            return {"c": thousandths, "b": F.coalesce(best["score"] >= MATCHED, F.lit(False)), "m": F.coalesce(best["id"], F.lit(""))}[kind]
        wanted = compiler.value(args[1], it)
        of_kind = F.filter(F.coalesce(F.col(at["r"]), F.array().cast(_FOUND)), lambda m: m["kind"] == wanted)
        first = F.get(of_kind, F.lit(0))
        score = lambda field: F.floor(F.coalesce(first[field], F.lit(0.0)) * 1000 + 1e-9)
        if name == "b_ref_match":
            known = compiler.value(args[2], it)
            return F.exists(of_kind, lambda m: m["name"] == known)
        return {
            "c_ref_match_count": lambda: F.size(of_kind).cast("long"), "m_ref_match_name": lambda: F.coalesce(first["name"], F.lit("")), "m_ref_match_id": lambda: F.coalesce(first["ref_id"], F.lit("")),
            "c_ref_exact_score": lambda: score("exact"), "c_ref_lexical_score": lambda: score("lexical"), "c_ref_match_score": lambda: score("score"),
        }[name]()

    return build


# -- policy facts and verification


def role_from_context(text: Column) -> Column:
    low = F.translate(text, UPPER, LOWER)
    has = lambda *words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return F.when(has("ship-to", "ship to", "shipto"), "ship_to").when(has("bill-to", "bill to", "billto"), "bill_to")


def policy_fact(text: Column, standardized: Column, customer: Column | None = None, role: Column | None = None) -> Column:
    """The fact that address rules decide on; customer and role: as the record's own fields give them."""
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.coalesce(customer if customer is not None else nothing, F.lit("")).alias("customer"),
        F.coalesce(role if role is not None else nothing, role_from_context(text), F.lit("bill_to")).alias("role"),
        standardized["valid"].alias("address_valid"), standardized["display"].alias("standardized"), text.alias("source_text"),
        F.lit("unmatched").alias("reference_status"), F.lit("").alias("reference_name"), F.lit("pending").alias("policy_status"), F.lit("awaiting policy evaluation").alias("policy_reason"),
    )


def standardize_with_index(rows: DataFrame, text: str, index: DataFrame, limit: int = 5) -> DataFrame:
    """rows with `native`: the standardised text, its matches in the index, and a score and validity that the best match may raise."""
    texts = rows.select(F.col(text).alias("id")).where("id is not null").distinct().select("id", standardize(F.col("id")).alias("s"))
    found = match_index(texts.select("id", "s.canonical", "s.parts"), index, limit)
    found = found.groupBy(F.col("query_id").alias("__text")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("__found"))
    joined = rows.withColumn("__text", F.col(text)).join(found, "__text", "left").withColumn("__s", standardize(F.col(text)))
    matches = F.coalesce("__found", F.array().cast(found.schema["__found"].dataType))
    best = F.coalesce(F.get(matches, F.lit(0))["score"], F.lit(0.0))
    native = F.struct(F.col("__s.address").alias("address"), F.col("__s.parts").alias("parts"), F.col("__s.display").alias("display"), F.col("__s.canonical").alias("canonical"), F.col("__s.key").alias("key"), F.greatest(F.col("__s.score"), best).alias("score"), (F.col("__s.valid") | (best >= MATCHED)).alias("valid"), matches.alias("matches"))
    return joined.withColumn("native", native).drop("__text", "__found", "__s")


def verify(rows: DataFrame, text: str, rules: str, index: DataFrame, reference: DataFrame, ctx=None) -> DataFrame:
    """rows with native, AddressDecision (as the rules left it), reference_matches, fired and trace.

    A text is standardised against the index, its customer is the best reference of kind "customer", and the rules decide on
    the fact AddressDecision; they may ask the index functions about AddressDecision.source_text or .standardized.
    """
    from rulegrain.plans.forward import Context, evaluate

    ctx = ctx or Context()
    index, reference = materialise(index, "index"), materialise(reference, "reference")
    out = standardize_with_index(rows, text, index).withColumn("AddressDecision", policy_fact(F.coalesce(F.col(text), F.lit("")), F.col("native")))
    texts = rows.select(F.col(text).alias("id"), F.col(text).alias("text")).where("id is not null").distinct()
    row = F.struct((-F.col("score")).alias("ord"), "kind", "name", "ref_id", "exact", "lexical", "score")
    found = reference_match(texts, reference).groupBy(F.col("id").alias("__text")).agg(F.sort_array(F.collect_list(row)).alias("reference_matches"))
    out = out.withColumn("__text", F.col(text)).join(found, "__text", "left").drop("__text").withColumn("reference_matches", F.coalesce("reference_matches", F.array().cast(_FOUND)))
    out = materialise(out, "standardized")
    customer = F.get(F.filter("reference_matches", lambda m: m["kind"] == "customer"), F.lit(0))["name"]
    fact = F.col("AddressDecision")
    for field, value in (("customer", customer), ("reference_status", F.when(customer.isNotNull(), "matched")), ("reference_name", customer)):
        fact = fact.withField(field, F.coalesce(value, F.col(f"AddressDecision.{field}")))
    out = out.withColumn("AddressDecision", fact)
    done = evaluate(attach(out, ctx, rules, index, reference), rules, ctx)
    return done.drop(*(c for c in done.columns if c.startswith("__match_")))


def _standardize_action(call):
    """standardize_address(text, "Target.path"): writes the standardised line."""
    from rulegrain.plans.grammar import Assign, Call, Lit, Path, RuleError

    if len(call.args) != 2 or not (isinstance(call.args[1], Lit) and isinstance(call.args[1].value, str)):
        raise RuleError('standardize_address takes a text and a target, "Fact.field"')
    return [Assign(Path(tuple(call.args[1].value.split("."))), Call("m_addr_standardize", (call.args[0],)))]


def register(registry) -> None:
    """The built-in analyser and the indexes as rule functions; the analyser's confidence is its validity score."""
    from rulegrain.functions.registry import Spec

    registry.register("c_addr_confidence", "c", lambda text: standardize(text)["score"], 1)
    registry.register("m_addr_standardize", "m", lambda text: standardize(text)["canonical"], 1)
    registry.register("m_addr_component", "m", lambda text, name: F.coalesce(component(text, name), F.lit("")), 2)
    registry.register("b_addr_has_component", "b", lambda text, name: component(text, name).isNotNull(), 2)
    registry.register_action("standardize_address", _standardize_action)
    for name, (kind, _) in INDEXED.items():
        registry.functions[name] = Spec(kind, _indexed(name))
