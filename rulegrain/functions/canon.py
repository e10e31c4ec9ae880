"""Deterministic canonical forms, template ids and similarity hashes as columns.

Log masking, template ids and Hamming distances are built-in expressions.
Canonical JSON (sorted keys, masked values) has no built-in form and is a pandas
UDF over whole batches; so is SimHash, whose built-in form (simhash_inline, for rules)
looks at every bit of every token by itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MASK = "<*>"
SPACE = r"[\p{IsWhite_Space}]+"

# fixed values: shapes of masked tokens
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]*)"
_VARIABLE = [
    _NUMBER,
    r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]*)[A-Za-z]+",
    r"0[xX][0-9A-Fa-f]+",
    r"(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{8,}",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"(?:(?:0{0,2}[0-9]|0?[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}(?:0{0,2}[0-9]|0?[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])",
    r"(?=[^:]*:[^:]*:)(?=.*[0-9A-Fa-f])[0-9A-Fa-f:]+",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ].*)?",
    r"/(?=.*[/.]).+",
]
_IS_VARIABLE = "^(?:" + "|".join(_VARIABLE) + ")$"
#: Every masked shape, and key=value and key:value, has one of these; most words have none, and one test spares them the rest.
_MAY_VARY = r"[0-9=:./]|[A-Fa-f]{8}"
_EDGE = r"""()\[\]{}<>"'`,;"""
_LABEL = r"[A-Za-z_][A-Za-z0-9_.\-]*"


def _is_variable(x: Column) -> Column:
    return F.regexp(x, F.lit(_IS_VARIABLE))


def _token(x: Column) -> Column:
    """struct<text, var> of a token: key=value and key:value mask the value, else what is inside edge marks."""
    equal = F.regexp(x, F.lit(rf"^{_LABEL}=[^=]+$"))
    colon = ~F.contains(x, F.lit("=")) & F.regexp(x, F.lit(rf"^{_LABEL}:[^:]+$"))
    split = F.when(equal, F.lit("=")).otherwise(F.lit(":"))
    key, value = F.split_part(x, split, F.lit(1)), F.split_part(x, split, F.lit(2))
    core = F.regexp_extract(x, rf"^[{_EDGE}]*(.*?)[{_EDGE}]*$", 1)
    value_core = F.regexp_extract(value, rf"^[{_EDGE}]*(.*?)[{_EDGE}]*$", 1)

    def masked(whole: Column, inner: Column, head: Column) -> Column:
        pre = F.regexp_extract(whole, rf"^([{_EDGE}]*)", 1)
        post = F.substring(whole, F.length(pre) + F.length(inner) + 1, F.length(whole))
        hit = (F.length(inner) > 0) & _is_variable(inner)
        return F.when(hit, F.struct(F.concat(head, pre, F.lit(MASK), post).alias("text"), inner.alias("var"))).otherwise(F.struct(F.concat(head, whole).alias("text"), F.lit(None).cast("string").alias("var")))

    fixed = F.struct(x.alias("text"), F.lit(None).cast("string").alias("var"))
    return F.when(~F.regexp(x, F.lit(_MAY_VARY)), fixed).when(equal | colon, masked(value, value_core, F.concat(key, split))).otherwise(masked(x, core, F.lit("")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda x: F.length(x) > 0)


def log_masked(text: Column) -> Column:
    """struct<canonical, vars>: the canonical log line and what was masked, each token looked at once."""

    def both(t: Column) -> Column:
        vars = F.filter(F.transform(t, lambda x: x["var"]), lambda x: x.isNotNull())
        return F.struct(F.array_join(F.transform(t, lambda x: x["text"]), " ").alias("canonical"), vars.alias("vars"))

    return F.transform(F.array(F.transform(tokens(text), _token)), both)[0]


def log_mask(text: Column) -> Column:
    """Canonical log line: white space made single, variable tokens masked."""
    return F.array_join(F.transform(tokens(text), lambda x: _token(x)["text"]), " ")


def log_vars(text: Column) -> Column:
    return log_masked(text)["vars"]


def identity(text: Column) -> Column:
    return text


def squeeze(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def exec_key(tool: Column, backend: Column, effort: Column, text: Column) -> Column:
    return squeeze(F.concat_ws("\u001f", tool, backend, effort, squeeze(text)))


_VARIABLE_PY = re.compile(_IS_VARIABLE.replace(r"\-", "-"))


_BEGINS = tuple('{["-0123456789tfn')  # what a JSON text may begin with


def _canonical_json(value, schema: bool):
    if isinstance(value, dict):
        return {k: _canonical_json(value[k], schema) for k in sorted(value)}
    if isinstance(value, list):
        return [_canonical_json(x, schema) for x in value]
    if isinstance(value, bool):
        return "<bool>" if schema else value
    if value is None:
        return "<null>" if schema else None
    if isinstance(value, (int, float)):
        return "<num>" if schema else MASK
    if schema:
        return "<str>"
    return MASK if _VARIABLE_PY.match(value) else value


def _refused(name: str):
    raise ValueError(f"{name} is no JSON")


def _printed(text: str | None, schema: bool) -> str | None:
    if not text or text.lstrip(" \t\r\n")[:1] not in _BEGINS:
        return None
    try:
        value = json.loads(text, parse_constant=_refused)
    except (ValueError, RecursionError):
        return None
    return json.dumps(_canonical_json(value, schema), ensure_ascii=False, separators=(",", ":"))


def _json_udf(schema: bool):
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _printed(t, schema))

    return F.pandas_udf(run, "string")


def json_masked(text: Column) -> Column:
    """Canonical JSON with numbers and id-like strings masked; null where it isn't JSON."""
    return _json_udf(False)(text)


def json_hybrid(text: Column) -> Column:
    """Canonical JSON with numbers and id-like strings masked; log masking where it isn't JSON."""
    return F.coalesce(json_masked(text), log_mask(text))


def json_schema(text: Column) -> Column:
    """JSON with values named by type; the text itself where it isn't JSON."""
    return F.coalesce(_json_udf(True)(text), text)


def looks_json(text: Column) -> Column:
    return F.regexp(text, F.lit(r"^\s*[{\[]"))


def canonical(text: Column) -> Column:
    """Auto mode: JSON if it looks like it and parses, else a log line."""
    return F.when(looks_json(text), json_hybrid(text)).otherwise(log_mask(text))


#: Strategies by name, each with the version that cache namespaces carry.
STRATEGIES = {"log-mask": (log_mask, 1), "json-hybrid": (json_hybrid, 1), "json-schema": (json_schema, 1), "auto": (canonical, 1), "identity": (identity, 1)}


def namespace(strategy: str) -> str:
    """Of the cache of canonical texts: strategy and version."""
    return f"{strategy}/v{STRATEGIES[strategy][1]}"


def search_text(request: Column, answer: Column) -> Column:
    """What an execution record is searched by: the request's query or content, or the whole request, a line feed, and the answer."""
    part = lambda name: F.get_json_object(request, f"$.{name}")
    return F.concat(F.coalesce(part("query"), part("content"), request, F.lit("")), F.lit("\n"), F.coalesce(answer, F.lit("")))


_LOW, _HIGH = 0x84222325, 0xCBF29CE4  # fixed values: FNV-1a offset basis
_PRIME_LOW = 0x1B3


def fnv1a(text: Column) -> Column:
    """FNV-1a 64 of the UTF-8 bytes, as a wrapped long; two 32-bit words, since 64-bit products overflow in ANSI mode."""
    mask = F.lit(0xFFFFFFFF)
    start = F.struct(F.lit(_HIGH).cast("long").alias("hi"), F.lit(_LOW).cast("long").alias("lo"))

    def step(s, b):
        x = s["lo"].bitwiseXOR(b)
        y = x * _PRIME_LOW
        hi = (s["hi"] * _PRIME_LOW + F.shiftrightunsigned(y, 32) + x * 256).bitwiseAND(mask)
        return F.struct(hi.alias("hi"), y.bitwiseAND(mask).alias("lo"))

    hexed = F.hex(text.cast("binary"))
    count = F.octet_length(text)
    data = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.conv(F.substring(hexed, 2 * i + 1, 2), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when(text.isNotNull(), F.aggregate(data, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"])))


def fnv1a_hex(text: Column) -> Column:
    return F.lower(F.lpad(F.hex(fnv1a(text)), 16, "0"))


#: Tokens are hashed and counted in runs of so many, whatever texts they come from.
_RUN = 1 << 16
_TOKEN_PY = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _fnv_of(tokens: list[bytes]) -> np.ndarray:
    """FNV-1a 64 of each, one byte of all at a time; the last few long ones by themselves."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    order = np.argsort(sizes, kind="stable")
    ordered, starts, data = sizes[order], np.cumsum(sizes) - sizes, np.frombuffer(b"".join(tokens), np.uint8)
    out, prime = np.full(len(tokens), (_HIGH << 32) | _LOW, np.uint64), (1 << 40) + _PRIME_LOW
    at = 0
    while len(left := order[np.searchsorted(ordered, at, "right") :]) > 16:
        out[left] = (out[left] ^ data[starts[left] + at]) * np.uint64(prime)
        at += 1
    for i in left.tolist():
        h = int(out[i])
        for b in tokens[i][at:]:
            h = (h ^ b) * prime & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


def _runs(texts: pa.Array) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Numbers of texts with their tokens, about _RUN tokens at once; a long text goes on in the next run."""
    at, held, n = [], [], 0
    for i, text in enumerate(texts):
        found = (m.group() for m in _TOKEN_PY.finditer(text.as_py() or ""))
        while part := list(islice(found, _RUN - n)):
            at.append(i)
            held.append(part)
            n += len(part)
            if n >= _RUN:
                yield at, held
                at, held, n = [], [], 0
    if at:
        yield at, held


@F.arrow_udf(LongType())
def _simhash(texts: pa.Array) -> pa.Array:
    ones, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    for at, held in _runs(texts):
        places: dict[str, int] = {}
        index = np.fromiter((places.setdefault(t, len(places)) for part in held for t in part), np.int64)
        bits = np.unpackbits(_fnv_of([t.encode("utf-8", "surrogatepass") for t in places]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sizes = np.fromiter(map(len, held), np.int64)
        ones[at] += np.add.reduceat(bits[index], np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)  # a text comes once in a run
        n[at] += sizes
    words = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8").reshape(-1)
    return pa.array(words, pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def simhash(text: Column) -> Column:
    """SimHash-64 over the tokens' FNV-1a: bit i is set if more tokens have it than not."""
    return _simhash(text)


def simhash_inline(text: Column) -> Column:
    """simhash() as a built-in expression, which may stand anywhere in a plan."""
    places = F.sequence(F.lit(0), F.lit(63))
    none = F.struct(F.array_repeat(F.lit(0), 64).alias("ones"), F.lit(0).alias("n"))

    def count(s, token):
        hash = F.array(fnv1a(token))  # bound once, read 64 times
        bits = F.flatten(F.transform(hash, lambda h: F.transform(places, lambda i: F.call_function("shiftright", h, i).bitwiseAND(F.lit(1)).cast("int"))))
        return F.struct(F.zip_with(s["ones"], bits, lambda x, y: x + y).alias("ones"), (s["n"] + 1).alias("n"))

    def word(s):
        bits = F.transform(s["ones"], lambda x, i: F.when(2 * x > s["n"], F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return F.aggregate(tokens(text), none, count, word)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near(a: Column, b: Column) -> Column:
    """1 - Hamming distance / 64 of two similarity hashes."""
    return 1 - hamming(a, b) / 64


def register(registry) -> None:
    registry.register("m_canonical", "m", canonical, 1)
    registry.register("m_canon_id", "m", lambda x: fnv1a(canonical(x)), 1)
    registry.register("s_canon_near", "s", lambda a, b: near(simhash_inline(canonical(a)), simhash_inline(canonical(b))), 2)
