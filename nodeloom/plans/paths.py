"""Normalized paths: the canonical place of a node, as steps of names and indexes."""

from __future__ import annotations

import re
from functools import total_ordering

_ESCAPED = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "'": "\\'", "\\": "\\\\"}
_STEP = re.compile(r"\[(?:(0|[1-9][0-9]*)|'((?:[^'\\\x00-\x1f\ud800-\udfff]|\\[bfnrt'\\]|\\u00[01][0-9a-f])*)')\]")
_UNESCAPE = re.compile(r"\\(?:u([0-9a-f]{4})|(.))")
_BACK = {v[1]: k for k, v in _ESCAPED.items()}
_SHORT = {"\b", "\f", "\n", "\r", "\t"}


def step_text(step: str | int) -> str:
    if isinstance(step, int):
        return f"[{step}]"
    return "['" + "".join(_ESCAPED.get(c) or (c if c >= " " else f"\\u{ord(c):04x}") for c in step) + "']"


@total_ordering
class NormalizedPath:
    """An immutable path; paths are ordered as a document lists its nodes, indexes before names, names by code point."""

    __slots__ = ("steps",)

    def __init__(self, steps=()):
        self.steps: tuple[str | int, ...] = tuple(steps)
        for s in self.steps:
            if isinstance(s, bool) or not isinstance(s, (str, int)) or isinstance(s, int) and s < 0:
                raise ValueError(f"{s!r} is no step")

    @classmethod
    def root(cls) -> NormalizedPath:
        return cls()

    @classmethod
    def parse(cls, text: str) -> NormalizedPath:
        """The path of a canonical text; anything else is an error."""
        if not text.startswith("$"):
            raise ValueError("a path starts with '$'")
        at, steps = 1, []
        while at < len(text):
            m = _STEP.match(text, at)
            if not m:
                raise ValueError(f"no canonical step at position {at} of {text[:60]!r}")
            if m[1] is not None:
                if len(m[1]) > 16 or int(m[1]) > (1 << 53) - 1:
                    raise ValueError("index out of range")
                steps.append(int(m[1]))
            else:
                name = _UNESCAPE.sub(lambda e: chr(int(e[1], 16)) if e[1] else _BACK[e[2]], m[2])
                if step_text(name) != m[0]:
                    raise ValueError(f"step at position {at} is not canonical")
                steps.append(name)
            at = m.end()
        return cls(steps)

    def __str__(self) -> str:
        return "$" + "".join(map(step_text, self.steps))

    def __repr__(self) -> str:
        return f"NormalizedPath({self})"

    def pointer(self) -> str:
        """The JSON Pointer of the same place."""
        return "".join("/" + str(s).replace("~", "~0").replace("/", "~1") for s in self.steps)

    def child(self, step: str | int) -> NormalizedPath:
        return NormalizedPath((*self.steps, step))

    def parent(self) -> NormalizedPath | None:
        return NormalizedPath(self.steps[:-1]) if self.steps else None

    def last_step(self) -> str | int | None:
        return self.steps[-1] if self.steps else None

    def is_root(self) -> bool:
        return not self.steps

    def starts_with(self, other: NormalizedPath) -> bool:
        return self.steps[: len(other.steps)] == other.steps

    def _key(self):
        return [(isinstance(s, str), s) for s in self.steps]

    def __eq__(self, other) -> bool:
        return isinstance(other, NormalizedPath) and self.steps == other.steps

    def __lt__(self, other) -> bool:
        for a, b in zip(self._key(), other._key()):
            if a != b:
                return a < b
        return len(self.steps) < len(other.steps)

    def __hash__(self) -> int:
        return hash(self.steps)

    def resolve(self, document):
        """(True, value) of the node at this place in a document of dicts and lists, else (False, None)."""
        now = document
        for s in self.steps:
            if isinstance(s, str) and isinstance(now, dict) and s in now or isinstance(s, int) and isinstance(now, (list, tuple)) and s < len(now):
                now = now[s]
            else:
                return False, None
        return True, now
