"""Labelled pattern sets over canonical forms, and routing of texts to the best label.

A set keeps its examples' template ids and similarity hashes.  They come from the
caller, so they're a small dimension: scores are built-in expressions over
literals, without a join or a shuffle.  A text scores 1 if its template is an
example's, else 1 - h / 64 for the nearest example within the set's Hamming threshold.

Defined cases: a null text, an unknown label or a set without examples match
nothing; registering a label again replaces its set; labels with equal scores go
to the smaller one.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rulegrain.functions import canon

#: Hamming distance (of 64 bits) up to which a text is near an example.
THRESHOLD = 6
_KINDS = {"log": canon.log_mask, "json": canon.json_hybrid}


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


@dataclass(frozen=True)
class PatternSet:
    label: str
    kind: str
    threshold: int
    ids: tuple[int, ...]
    hashes: tuple[int, ...]

    def form(self, text: Column) -> Column:
        return _KINDS.get(self.kind, canon.canonical)(text)

    def score(self, text: Column) -> Column:
        """Score of a match, else null; built-in expressions, so that rules may ask for it."""
        return _bound(self.form(text), lambda form: _bound(canon.simhash_inline(form), lambda h: self.scored(form, h)))

    def scored(self, form: Column, hash: Column) -> Column:
        """Score of a form with its similarity hash; its id is only made where the hash is an example's, as that of an equal form is."""
        if not self.ids:
            return F.lit(None).cast("double")
        known = F.array(*(F.lit(h).cast("long") for h in self.hashes))
        near = _bound(F.array_min(F.transform(known, lambda k: canon.hamming(k, hash))), lambda d: F.when(d <= self.threshold, 1 - d / 64))
        return F.when(hash.isin(*self.hashes) & canon.fnv1a(form).isin(*self.ids), F.lit(1.0)).otherwise(near)


@dataclass
class Router:
    sets: dict[str, PatternSet] = field(default_factory=dict)

    def add(self, spark: SparkSession, label: str, examples: Iterable[str], kind: str = "auto", threshold: int = THRESHOLD) -> int:
        """Registers (or replaces) a set; gives the number of its examples. A kind other than "log" and "json" is automatic."""
        kind, examples = kind.strip().lower(), list(examples)
        if not label.strip():
            raise ValueError("a pattern set needs a label")
        if not 0 <= threshold <= 64:
            raise ValueError(f"a threshold is 0 to 64 bits, not {threshold}")
        made = PatternSet(label, kind, threshold, (), ())
        rows = spark.createDataFrame([(e,) for e in examples], "text string").select(made.form(F.col("text")).alias("form"))
        found = rows.select(canon.fnv1a(F.col("form")), canon.simhash(F.col("form"))).collect()
        self.sets[label] = PatternSet(label, kind, threshold, tuple(r[0] for r in found), tuple(r[1] for r in found))
        return len(examples)

    def score(self, text: Column, label: Column) -> Column:
        """Score of text against the set named by label, else null."""
        out = F.lit(None).cast("double")
        for name, held in self.sets.items():
            out = F.when(label == name, held.score(text)).otherwise(out)
        return out

    def _scores(self, text: Column, labels: list[str]) -> Column:
        """Scores of all sets, from the hashes of the log line and the JSON form, each made once."""
        sets, made = [self.sets[x] for x in labels], {"log": canon.simhash(canon.log_mask(text))}
        if any(s.kind != "log" for s in sets):
            made |= {"form": canon.json_masked(text), "json": canon.simhash(canon.json_masked(text))}

        def scored(held: PatternSet, of: Column) -> Column:
            line, log = canon.log_mask(text), of["log"]
            if held.kind == "log":
                return held.scored(line, log)
            form, hash = F.coalesce(of["form"], line), F.coalesce(of["json"], log)
            if held.kind == "json":
                return held.scored(form, hash)
            looks = canon.looks_json(text)
            return held.scored(F.when(looks, form).otherwise(line), F.when(looks, hash).otherwise(log))

        return _bound(F.struct(*(c.alias(k) for k, c in made.items())), lambda of: F.array(*(scored(s, of) for s in sets)))

    def classify(self, text: Column, inline: bool = False) -> Column:
        """Struct of label and score of the best set; null if none matches.  inline: the similarity hashes are built-in expressions."""
        if not self.sets:
            return F.lit(None).cast("struct<label:string,score:double>")
        labels = sorted(self.sets)
        names, scores = F.array(*(F.lit(x) for x in labels)), F.array(*(self.sets[x].score(text) for x in labels)) if inline else self._scores(text, labels)

        def best(s: Column) -> Column:
            top = F.array_max(s)
            return F.when(top.isNotNull(), F.struct(F.get(names, F.array_position(s, top).cast("int") - 1).alias("label"), top.alias("score")))

        return _bound(scores, best)

    def register(self, registry) -> None:
        """Makes the sets known to rules; sets added later aren't seen by plans that are already made."""
        registry.register("s_canon_match", "s", lambda text, label: F.coalesce(self.score(text, label), F.lit(0.0)), 2)
        registry.register("b_canon_matches", "b", lambda text, label: self.score(text, label).isNotNull(), 2)
        registry.register("m_canon_label", "m", lambda text: F.coalesce(self.classify(text, inline=True)["label"], F.lit("")), 1)
