"""Functions and actions that rules may call, by kind of result.

Kinds: "s" raw scalar, "c" calibrated scalar, "b" boolean, "m" text, "v" vector.
A function is a builder of Columns: build(compiler, argument trees, it).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


@dataclass(frozen=True)
class Spec:
    kind: str
    build: Callable


@dataclass
class Registry:
    functions: dict[str, Spec] = field(default_factory=dict)
    actions: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, kind: str, column: Callable, arity: int | None = None) -> None:
        """column(*Columns) -> Column (a built-in expression, or a pandas UDF)."""

        def build(compiler, args, it):
            if arity is not None and len(args) != arity:
                raise ValueError(f"{name} requires {arity} arguments, got {len(args)}")
            return column(*(compiler.value(a, it) for a in args))

        self.functions[name] = Spec(kind, build)

    def register_action(self, name: str, expand: Callable) -> None:
        """expand(Call) -> assignments that the call stands for."""
        self.actions[name] = expand


def standard_registry(router=None) -> Registry:
    """router: the patterns.Router whose sets rules may name; without one they match nothing."""
    from rulegrain.functions import address, canon, patterns, vector

    registry = Registry()

    def length(compiler, args, it):
        if len(args) != 1:
            raise ValueError(f"len requires 1 arguments, got {len(args)}")
        x = compiler.value(args[0], it)
        return F.array_size(x) if isinstance(compiler.kind(args[0]), ArrayType) else F.length(x.cast("string"))

    registry.functions["len"] = Spec("c", length)
    registry.register_action("LogMessage", lambda call: [])
    vector.register(registry)
    canon.register(registry)
    address.register(registry)
    (router or patterns.Router()).register(registry)
    return registry
