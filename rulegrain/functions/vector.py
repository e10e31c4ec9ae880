"""Vector geometry as built-in column expressions; sums are made in double."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.plans.grammar import Items, Lit, RuleError


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def bound(x: Column, make) -> Column:
    """make(x), with x worked out once; what a lambda names is worked out anew for each element."""
    return F.transform(F.array(x), make)[0]


def zipped(a: Column, b: Column, make) -> Column:
    """make of the components, pair by pair; vectors of different lengths are an error, a null vector gives null."""
    wrong = F.raise_error(F.concat(F.lit("vectors of dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(F.size(a) == F.size(b), F.zip_with(doubles(a), doubles(b), make)).when(a.isNotNull() & b.isNotNull(), wrong.cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(zipped(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size))


def contrast(x: Column, pos: Column, neg: Column) -> Column:
    return cosine(x, pos) - cosine(x, neg)


def add(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x * y)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(doubles(a), lambda x: x * k)


def normalize(a: Column) -> Column:
    """Unit vector; null for a zero or non-finite norm."""
    return bound(norm(a), lambda n: F.when((n > 0) & (n < float("inf")), F.transform(doubles(a), lambda x: x / n)))


def valid(v: Column, dim: int | None = None) -> Column:
    """Non-empty, finite, not all zero, and of the model's dimension."""
    test = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(test & (F.size(v) == dim) if dim else test, F.lit(False))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(zipped(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; infinite where a norm is 0."""
    return F.when(norm(a) * norm(b) == 0, F.lit(float("inf"))).otherwise(1 - cosine(a, b))


def inner_product_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in km."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


METRICS = {"cosine": cosine_distance, "l2": l2_squared, "ip": inner_product_distance}


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def percentile(raw: Column, reference: Column) -> Column:
    """Midpoint rank of raw among reference scores, 0 to 100."""
    below = F.size(F.filter(reference, lambda x: x < raw))
    equal = F.size(F.filter(reference, lambda x: x == raw))
    return 100.0 * (below + equal / 2) / F.size(reference)


def percentile_among(raw: Column, scores: list[float]) -> Column:
    """percentile() among ascending scores of any number, kept as distinct scores with the counts below them.

    A score is looked up in its block alone: about two square roots of the distinct scores are compared.
    """
    points, below = np.unique(np.asarray(scores, dtype=np.float64), return_index=True)
    size = max(1, math.isqrt(len(points)))
    # One text literal, folded to an array once; repr gives back the same double.
    array = lambda xs, kind: F.split(F.lit(",".join(repr(x) for x in xs)), ",").cast(f"array<{kind}>")
    lasts = array(points[size - 1 :: size].tolist(), "double")
    values, counts = array(points.tolist(), "double"), array([*below.tolist(), len(scores)], "bigint")

    def found(s: Column, ahead: Column) -> Column:
        block = F.slice(values, ahead + 1, size)
        at = ahead + F.size(F.filter(block, lambda x: x < s))
        held = F.size(F.filter(block, lambda x: x == s))
        return bound(F.struct(F.element_at(counts, at + 1).alias("lower"), F.element_at(counts, at + 1 + held).alias("upper")), lambda c: 100.0 * (c["lower"] + (c["upper"] - c["lower"]) / 2) / len(scores))

    return bound(raw, lambda s: bound(F.size(F.filter(lasts, lambda x: x < s)) * size, lambda ahead: found(s, ahead)))


def project(v: Column, direction: Column) -> Column:
    return bound(normalize(v), lambda u: dot(u, direction))


def depth(v: Column, region) -> Column:
    """Distance from the region's centre in units of its spread, over tau: 1 is the boundary."""
    x = normalize(v)
    diff = sub(x, literal(region.center))
    scores = [dot(diff, literal(b)) for b in region.basis]
    inside = sum((F.pow(s / float(max(k, 1e-12)), 2) for s, k in zip(scores, region.scales, strict=True)), F.lit(0.0))
    left = F.greatest(dot(diff, diff) - sum((s * s for s in scores), F.lit(0.0)), F.lit(0.0))
    rest = left / float(max(region.residual_scale, 1e-12)) ** 2
    return F.sqrt(inside + rest) / float(region.tau)


# -- embedders: a text to a vector, as a Column and in Python


class HashingEmbedder:
    """Signed feature hashing of lower-case words into `dim` slots: needs no model, for tests and examples.

    A word's slot and sign come from its CRC-32, which Spark and Python agree on.
    """

    def __init__(self, dim: int = 64, model: str = "hashing"):
        self.dim, self.model = dim, model

    def column(self, text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        codes = F.transform(words, lambda w: F.crc32(w.cast("binary")))
        signed = lambda c: F.when(F.shiftright(c, 31) == 0, 1.0).otherwise(-1.0)
        zero = F.array_repeat(F.lit(0.0), self.dim)
        return F.aggregate(codes, zero, lambda v, c: F.transform(v, lambda x, i: x + F.when(i == c % self.dim, signed(c)).otherwise(0.0)))

    def embed(self, text: str) -> list[float]:
        out = [0.0] * self.dim
        for word in re.split(r"[\W_]+", text.lower()):
            if word:
                code = zlib.crc32(word.encode())
                out[code % self.dim] += -1.0 if code >> 31 else 1.0
        return out


class TableEmbedder:
    """Vectors of known texts; a text that isn't known is an error that names it."""

    def __init__(self, vectors: dict[str, list[float]], model: str = "table"):
        self.vectors, self.model = vectors, model
        self.dim = len(next(iter(vectors.values()))) if vectors else 0

    def column(self, text: Column) -> Column:
        """For a handful of texts; a table of vectors is joined by with_vectors()."""
        pairs = [x for k, v in self.vectors.items() for x in (F.lit(k), literal(v))]
        found = F.try_element_at(F.create_map(*pairs), text) if pairs else F.lit(None).cast("array<double>")
        return F.when(text.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no vector for text: "), text)).cast("array<double>"))

    def embed(self, text: str) -> list[float]:
        if text not in self.vectors:
            raise KeyError(f"no vector for text: {text}")
        return self.vectors[text]


class CanonicalEmbedder:
    """Another embedder over canonical texts: texts with one canonical form share a vector and a cache entry.

    strategy: a builder of Columns, and the same in Python; namespace: names strategy and version.
    """

    def __init__(self, inner, strategy, plain, namespace: str):
        self.inner, self.strategy, self.plain, self.namespace = inner, strategy, plain, namespace
        self.model, self.dim = inner.model, inner.dim

    def column(self, text: Column) -> Column:
        return self.inner.column(self.strategy(text))

    def embed(self, text: str) -> list[float]:
        return self.inner.embed(self.plain(text))

    def key(self, text: str) -> str:
        return text_key(self.model, self.namespace, self.plain(text))


def with_vectors(rows: DataFrame, text: str, vectors: DataFrame, strategy=None, out: str = "vector") -> DataFrame:
    """rows with the vector of their text (its canonical form, if strategy is given) from vectors(text, vector), by a join.

    A text without a vector is an error that names it; a null text has none.
    """
    form = strategy or (lambda x: x)
    known = vectors.select(form(F.col("text")).alias("__form"), F.col("vector").alias("__vector")).dropDuplicates(["__form"])
    joined = rows.withColumn("__form", form(F.col(text))).join(known, "__form", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for text: "), F.col(text))).cast(known.schema["__vector"].dataType)
    return joined.withColumn(out, F.when(F.col("__vector").isNotNull() | F.col(text).isNull(), F.col("__vector")).otherwise(missing)).drop("__form", "__vector")


def model_id(name: str, digest: str, dim: int) -> dict:
    """Checked identity of a model; token is name and the first 8 bytes of the digest."""
    if not name or name in ("placeholder", "model", "unknown"):
        raise ValueError(f"not a model name: {name!r}")
    if len(digest) != 64 or set(digest) - set("0123456789abcdef") or set(digest) == {"0"}:
        raise ValueError("the digest must be 64 hex digits and not zero")
    if dim <= 0:
        raise ValueError("the dimension must be positive")
    return {"name": name, "digest": digest, "dim": dim, "token": f"{name}-{digest[:16]}"}


def text_key_column(model: Column, namespace: Column, text: Column) -> Column:
    """text_key() of columns."""
    part = lambda x, n: F.substring(F.sha2(x.cast("binary"), 256), 1, 2 * n)
    return F.concat(part(model, 8), part(namespace, 8), part(text, 16))


def text_key(model: str, namespace: str, text: str) -> str:
    part = lambda x, n: hashlib.sha256(x.encode()).hexdigest()[: 2 * n]
    return part(model, 8) + part(namespace, 8) + part(text, 16)


# -- rule functions


def operand(compiler, node, it=None) -> Column:
    """A vector: an array column, a vector expression, or an embedded text."""
    if isinstance(node, Items):
        return _algebra(compiler, node, it)
    embedder = compiler.ctx.embedder
    if isinstance(node, Lit) and isinstance(node.value, str):
        if embedder is None:
            raise RuleError("a text operand needs an embedder")
        return literal(embedder.embed(node.value))  # embedded once, on the driver
    column = compiler.value(node, it)
    if embedder is not None and not getattr(node, "name", "").startswith("v"):
        return embedder.column(column)
    return column


def _algebra(compiler, node: Items, it) -> Column:
    items = node.items
    if not items:
        raise RuleError("empty vector expression")
    if all(isinstance(x, Lit) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool) for x in items):
        return literal([x.value for x in items])
    if not (isinstance(items[0], Lit) and isinstance(items[0].value, str)):
        raise RuleError("a vector expression begins with its operation")
    op, args = items[0].value.strip().lower().removeprefix("v:"), items[1:]
    number = lambda x: isinstance(x, Lit) and isinstance(x.value, (int, float))
    if op == "" and len(args) == 1:
        return operand(compiler, args[0], it)
    if op in ("add", "sub") and len(args) >= 2:
        out = operand(compiler, args[0], it)
        for x in args[1:]:
            out = (add if op == "add" else sub)(out, operand(compiler, x, it))
        return out
    if op in ("scale", "mul") and len(args) >= 2:
        a, b = args[:2]
        if number(a) or number(b):
            k, v = (a, b) if number(a) else (b, a)
            return scale(operand(compiler, v, it), float(k.value))
        return mul(operand(compiler, a, it), operand(compiler, b, it))
    raise RuleError(f"unknown vector operation {op!r} with {len(args)} operands")


def _artifact(compiler, node, kind: str):
    name = node.value if isinstance(node, Lit) else str(node)
    found = compiler.ctx.artifacts.get(name)
    if found is None or found.kind != kind:
        raise RuleError(f"no {kind} named {name}")
    embedder = compiler.ctx.embedder
    if embedder is not None and (found.model, found.dim) != (embedder.model, embedder.dim):
        raise RuleError(f"{kind} {name} was fitted with {found.model}/{found.dim}, not {embedder.model}/{embedder.dim}")
    return found


def register(registry) -> None:
    from rulegrain.functions.registry import Spec

    def vectors(name: str, kind: str, n: int, make):
        def build(compiler, args, it):
            if len(args) != n:
                raise RuleError(f"{name} requires {n} arguments, got {len(args)}")
            return make(*(operand(compiler, a, it) for a in args))

        registry.functions[name] = Spec(kind, build)

    def measured(name: str, kind: str, artifact: str, make):
        def build(compiler, args, it):
            if len(args) != 2:
                raise RuleError(f"{name} requires 2 arguments, got {len(args)}")
            return make(operand(compiler, args[0], it), _artifact(compiler, args[1], artifact))

        registry.functions[name] = Spec(kind, build)

    def calibrated(v, axis):
        if not axis.calibration:
            raise RuleError(f"axis {axis.name} has no calibration")
        return percentile_among(project(v, literal(axis.direction)), axis.calibration)

    vectors("s_cosine", "s", 2, cosine)
    vectors("s_dot", "s", 2, dot)
    vectors("s_contrast", "s", 3, contrast)
    measured("s_project", "s", "axis", lambda v, a: project(v, literal(a.direction)))
    measured("c_project", "c", "axis", calibrated)
    measured("s_depth", "s", "region", depth)
    measured("b_member", "b", "region", lambda v, r: depth(v, r) <= 1.0)
    registry.functions["v"] = Spec("v", lambda compiler, args, it: operand(compiler, args[0], it))


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    if not n or not np.isfinite(n):
        raise ValueError("no direction: the norm is zero or not finite")
    return v / n
