"""Values as functions of one's own see and make them: asked by kind, absent apart from null."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from nodeloom.functions.registry import Function
from nodeloom.functions.values import NOTHING, equal, exact, kind
from nodeloom.plans import ast as A


@dataclass(frozen=True, eq=False)
class Value:
    """A JSON value or nothing. An accessor of another kind than the value's gives None."""

    raw: object = NOTHING

    @classmethod
    def of(cls, raw) -> Value:
        """Raises TypeError for what is no JSON value."""
        if raw is not NOTHING:
            kind(raw)
        return cls(raw)

    @property
    def present(self) -> bool:
        return self.raw is not NOTHING

    @property
    def kind(self) -> str | None:
        return kind(self.raw) if self.present else None

    @property
    def is_null(self) -> bool:
        return self.raw is None

    def text(self) -> str | None:
        return self.raw if self.kind == "string" else None

    def truth(self) -> bool | None:
        return self.raw if self.kind == "boolean" else None

    def number(self) -> Decimal | None:
        """The exact value; None for NaN and infinities too."""
        x = exact(self.raw) if self.kind == "number" else None
        return None if x is None else Decimal(x)

    def elements(self) -> list[Value] | None:
        return [Value(x) for x in self.raw] if self.kind == "array" else None

    def members(self) -> dict[str, Value] | None:
        return {k: Value(x) for k, x in self.raw.items()} if self.kind == "object" else None

    def __eq__(self, other) -> bool:
        return isinstance(other, Value) and (self.present == other.present) and (not self.present or equal(self.raw, other.raw))

    __hash__ = None


#: The absent value.
ABSENT = Value()


def function(name: str, params: tuple[str, ...], result: str, body: Callable) -> Function:
    """A function whose body gets and gives Value (or lists of Value, for nodes) where Function has bare ones."""

    def bare(*args):
        out = body(*[Value(a) if p == A.VALUE else [Value(x) for x in a] if p == A.NODES else a for p, a in zip(params, args, strict=True)])
        if result == A.LOGICAL:
            return out
        if result == A.NODES:
            return [Value.of(v.raw).raw for v in out]
        if not isinstance(out, Value):
            raise TypeError(f"{name} gave no Value")
        return Value.of(out.raw).raw

    return Function(name, params, result, bare)
