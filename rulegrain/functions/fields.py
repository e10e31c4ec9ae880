"""Structured addresses: evidence for address roles in the fields of any JSON record.

Only the walk over the record is Python (a pandas UDF over whole batches, since
JSON of unknown shape has no built-in walk); roles, scores and components are
built-in expressions over the record's own fields, so nothing is shuffled.

Defined cases: a null or broken record has no fields; blank values are no
evidence; keys are walked in sorted order, and of equal scores the first field wins.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rulegrain.functions import address
from rulegrain.functions.address import LOWER, UPPER, bare
from rulegrain.functions.canon import SPACE, fnv1a_hex

# fixed values: roles with the words that field names have, texts that values have, weights, threshold
ROLES = {
    "customer": ("customer", "client", "account", "brand", "company"),
    "address_line1": ("address", "addr", "street", "line1", "shipaddr", "billaddr"),
    "city": ("city", "town", "municipality", "locality"),
    "region": ("state", "province", "region", "territory"),
    "postal_code": ("zip", "zipcode", "postal", "postcode", "postalish"),
    "country": ("country", "nation"),
    "address_role": ("role", "type", "purpose", "billto", "shipto"),
}
FIRMS = "cola|company|distributor|inc"
COUNTRIES = ("US", "USA", "UNITED STATES")
NAME, CONTENT = 0.45, 0.55
WITH_EMBEDDING = (0.30, 0.35, 0.35)
LEAST = 0.35
NAMESPACE = "structured-address:1"


def _fields(value, path: str, inner: bool):
    """(path, key, value) of each scalar; with inner, of each key instead."""
    if isinstance(value, dict):
        for key in sorted(value):
            if inner:
                yield f"{path}.{key}", key, None
            yield from _fields(value[key], f"{path}.{key}", inner)
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from _fields(item, f"{path}[{i}]", inner)
    elif not inner:
        yield path, path.rsplit(".", 1)[-1], value if isinstance(value, str) else json.dumps(value)


def _walk(inner: bool):
    @F.pandas_udf("array<struct<path:string,key:string,value:string>>")
    def walk(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return [{"path": p, "key": k, "value": v} for p, k, v in _fields(json.loads(text), "$", inner)]
            except (TypeError, ValueError, RecursionError):
                return []

        return texts.map(one)

    return walk


def _plain(x: Column) -> Column:
    return F.translate(F.regexp_replace(x, "[^A-Za-z0-9]", ""), UPPER, LOWER)


def _title(x: Column) -> Column:
    words = F.filter(F.split(x, SPACE), lambda w: F.length(w) > 0)
    cased = lambda w: F.concat(F.translate(F.substring(w, 1, 1), LOWER, UPPER), F.translate(F.substring(w, 2, 1 << 30), UPPER, LOWER))
    return F.array_join(F.transform(words, lambda w: cased(bare(w))), " ")


def _role_name(value: Column) -> Column:
    text = _plain(value)
    return F.when(text.contains("ship"), "ship_to").when(text.contains("brand"), "brand_owner").otherwise("bill_to")


def content_score(value: Column, role: str) -> Column:
    digit, low, trimmed = value.rlike("[0-9]"), F.translate(value, UPPER, LOWER), F.trim(value)
    n_words = F.size(F.filter(F.split(value, SPACE), lambda w: F.length(w) > 0))
    upper = F.translate(trimmed, LOWER, UPPER)
    found = {
        "customer": F.when(low.rlike(FIRMS), 1.0),
        "address_line1": F.when(digit & low.rlike(address.SUFFIXES), 1.0).when(digit, 0.55),
        "city": F.when(~digit & (n_words <= 3), 0.65),
        "region": F.when(upper.isin(*address.STATES.split("|")), 1.0),
        "postal_code": F.when(bare(trimmed).rlike(r"^[0-9]{5}\z"), 1.0),
        "country": F.when(upper.isin(*COUNTRIES), 1.0),
        "address_role": F.lit(1.0),  # every text names some role
    }[role]
    return F.coalesce(found, F.lit(0.0))


def evidence(record: Column, embeddings: Column | None = None) -> Column:
    """array<struct<path, value, role, name_score, content_score, embedding_score, score>> of a JSON text.

    embeddings: array<struct<path, role, score>>; the best score for a path and role joins in.
    """

    def scored(leaf: Column, role: str) -> Column:
        key = _plain(leaf["key"])
        name = F.when(key.rlike("|".join(ROLES[role])), 1.0).otherwise(0.0)
        return F.struct(leaf["path"].alias("path"), leaf["value"].alias("value"), F.lit(role).alias("role"), name.alias("name_score"), content_score(leaf["value"], role).alias("content_score"))

    def weighed(e: Column) -> Column:
        given = F.lit(None).cast("double")
        if embeddings is not None:
            same = F.filter(embeddings, lambda x: (x["path"] == e["path"]) & (x["role"] == e["role"]))
            given = F.array_max(F.transform(same, lambda x: x["score"].cast("double")))
            given = F.when(given.isNotNull(), F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0)))
        n, c, s = WITH_EMBEDDING
        plain = NAME * e["name_score"] + CONTENT * e["content_score"]
        return F.struct(*(e[k].alias(k) for k in ("path", "value", "role", "name_score", "content_score")), given.alias("embedding_score"), F.coalesce(n * e["name_score"] + c * e["content_score"] + s * given, plain).alias("score"))

    leaves = F.filter(_walk(False)(record), lambda x: F.length(F.regexp_replace(x["value"], SPACE, "")) > 0)
    all_roles = F.flatten(F.transform(leaves, lambda x: F.array(*(scored(x, role) for role in ROLES))))
    kept = F.filter(all_roles, lambda e: NAME * e["name_score"] + CONTENT * e["content_score"] >= LEAST)
    return F.transform(kept, weighed)


def parts_of(found: Column) -> Column:
    """Components by the best evidence for each role; fields named number or street take precedence.

    A line's first five digits before a road are its house number if the postal code has a field of its own.
    """

    def best(role: str) -> Column:
        ranked = F.transform(F.filter(found, lambda e: e["role"] == role), lambda e, i: F.struct(e["score"].alias("score"), (-i).alias("place"), e["value"].alias("value")))
        return F.array_max(F.filter(ranked, lambda e: e["score"] > 0))["value"]

    def last(word: str, digit: bool) -> Column:
        return F.try_element_at(F.filter(found, lambda e: _plain(e["path"]).contains(word) & (e["value"].rlike("[0-9]") == F.lit(digit))), F.lit(-1))["value"]

    number, street, role = last("number", True), last("street", False), best("address_role")
    upper = lambda x: F.translate(x, LOWER, UPPER)

    def made(line: Column, code: Column, parsed: Column) -> Column:
        return F.struct(
            best("customer").alias("customer"),
            F.when(role.isNotNull(), _role_name(role)).alias("address_role"),
            F.coalesce(bare(number), parsed["house_number"]).alias("house_number"),
            F.coalesce(_title(street), parsed["road"], _title(line)).alias("road"),
            _title(best("city")).alias("city"),
            upper(best("region")).alias("region"),
            code.alias("postal_code"),
            upper(best("country")).alias("country"),
        )

    held = F.struct(best("address_line1").alias("line"), best("postal_code").alias("code"))
    return address.bound(held, lambda h: address.bound(address.components(h["line"], h["code"] != h["line"]), lambda parsed: made(h["line"], h["code"], parsed)))


def standardize(record: Column, embeddings: Column | None = None) -> Column:
    """struct<parts, display, canonical, key, score, valid, evidence> of a JSON record."""

    def made(found: Column, parts: Column, shown: Column) -> Column:
        told = lambda line, score: F.struct(parts.alias("parts"), shown.alias("display"), line.alias("canonical"), fnv1a_hex(line).alias("key"), score.alias("score"), (score >= address.VALID).alias("valid"), found.alias("evidence"))
        return address.bound(address.normal(shown), lambda line: told(line, address.score(parts)))

    shown = lambda parts: address.display(parts, parts["country"])
    return address.bound(evidence(record, embeddings), lambda found: address.bound(parts_of(found), lambda parts: address.bound(shown(parts), lambda line: made(found, parts, line))))


def hints(record: Column) -> Column:
    """array<struct<field, embedding_text, cache_namespace>>: what to embed for each key of a record, by path."""
    each = F.transform(_walk(True)(record), lambda x: F.struct(x["path"].alias("field"), F.concat(F.lit("address field meaning: "), _plain(x["key"])).alias("embedding_text"), F.lit(NAMESPACE).alias("cache_namespace")))
    return F.array_sort(F.array_distinct(each))
