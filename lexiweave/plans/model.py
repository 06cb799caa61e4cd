"""The plan tree, built on the driver and shipped to executors once."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import InvalidFormat
from ..functions.text import CodePointSet, utf16_length

SHORT_CIRCUIT, UNION = "short_circuit", "union"


class Leaf:
    """A lexicon: unique non-empty keys, each with ordered candidates."""

    def __init__(self, entries: dict[str, list[str]], name: str | None = None):
        for key, values in entries.items():
            if not key:
                raise InvalidFormat("empty key")
            if not values:
                raise InvalidFormat(f"no candidates for key '{key}'")
        self.entries = {k: tuple(entries[k]) for k in sorted(entries)}
        self.name = name
        self.default = {k: v[0] for k, v in self.entries.items()}
        self.lengths: dict[str, tuple[int, ...]] = {}
        by_first: dict[str, set[int]] = {}
        for k in self.entries:
            by_first.setdefault(k[0], set()).add(len(k))
        self.lengths = {c: tuple(sorted(n, reverse=True)) for c, n in by_first.items()}

    @classmethod
    def of(cls, pairs, name: str | None = None) -> Leaf:
        """From (key, candidates) pairs; a repeated key is an error."""
        entries: dict[str, list[str]] = {}
        for key, values in pairs:
            if key in entries:
                raise InvalidFormat(f"duplicate key '{key}'")
            entries[key] = [values] if isinstance(values, str) else list(values)
        return cls(entries, name)

    def match(self, text: str, at: int) -> tuple[int, str] | None:
        """Length and value of the longest key at ``at``."""
        lengths = self.lengths.get(text[at])
        if lengths:
            default = self.default
            for n in lengths:
                value = default.get(text[at : at + n])
                if value is not None and at + n <= len(text):
                    return n, value
        return None

    def exact(self, key: str) -> tuple[str, ...] | None:
        """All candidates of a key."""
        return self.entries.get(key)

    def starts(self) -> set[str]:
        """First characters of the keys."""
        return set(self.lengths)

    @property
    def max_key_length(self) -> int:
        """The longest key in UTF-16 code units."""
        return max(map(utf16_length, self.entries), default=0)

    def leaves(self) -> list[Leaf]:
        return [self]


class Group:
    """Plans tried together: the first child that matches at all, or the longest match."""

    def __init__(self, children, policy: str):
        self.children, self.policy = list(children), policy

    def match(self, text: str, at: int) -> tuple[int, str] | None:
        best = None
        for child in self.children:
            hit = child.match(text, at)
            if hit is None:
                continue
            if self.policy == SHORT_CIRCUIT:
                return hit
            if best is None or hit[0] > best[0]:
                best = hit
        return best

    def exact(self, key: str) -> tuple[str, ...] | None:
        return next((v for c in self.children if (v := c.exact(key)) is not None), None)

    def starts(self) -> set[str]:
        return set().union(*(c.starts() for c in self.children))

    @property
    def max_key_length(self) -> int:
        return max((c.max_key_length for c in self.children), default=0)

    def leaves(self) -> list[Leaf]:
        return [x for c in self.children for x in c.leaves()]


def key_starts(plan) -> CodePointSet:
    """First code points of a plan's keys."""
    return CodePointSet(map(ord, plan.starts()))


def match_length(plan, text: str, at: int = 0) -> int:
    """Length of the longest-prefix match in UTF-16 code units, -1 if none."""
    hit = plan.match(text, at) if at < len(text) else None
    return -1 if hit is None else utf16_length(text[at : at + hit[0]])


def same_matches(a, b) -> bool:
    """Whether two plans are the same leaves under the same groups."""
    if isinstance(a, Leaf) or isinstance(b, Leaf):
        return a is b
    return a.policy == b.policy and len(a.children) == len(b.children) and all(map(same_matches, a.children, b.children))


@dataclass(frozen=True)
class Converter:
    """Normalisation chain (None: not configured), segmentation, conversion chain."""

    chain: tuple
    segmentation: object | None = None
    normalization: tuple | None = None

    def plans(self) -> list:
        out = [*(self.normalization or ()), *self.chain]
        return out + ([self.segmentation] if self.segmentation else [])
