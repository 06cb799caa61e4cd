"""Text primitives of the scanner, over Python strings (code points)."""

from __future__ import annotations

#: Budgets of one ideographic description sequence.
IDS_DEPTH, IDS_POINTS = 16, 64
IDS_FIRST, IDS_LAST = 0x2FF0, 0x2FFF
_FNV_START, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def utf16_length(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) + sum(c > "￿" for c in text)


def char_count(point: int) -> int:
    """UTF-16 code units of a code point."""
    return 2 if point > 0xFFFF else 1


def ids_arity(point: int) -> int:
    """Operands of an ideographic description operator, 0 for other code points."""
    if not IDS_FIRST <= point <= IDS_LAST:
        return 0
    return 3 if point in (0x2FF2, 0x2FF3) else 1 if point >= 0x2FFE else 2


def ids_length(text: str, start: int = 0) -> int:
    """Code points of the complete description sequence at ``start``; 0 if there
    is none within the budgets for depth and size."""
    if start >= len(text) or not ids_arity(ord(text[start])):
        return 0
    # Operands still owed at each open level; the sequence ends when none is.
    owed, at = [1], start
    while owed:
        if at >= len(text) or at - start >= IDS_POINTS:
            return 0
        if len(owed) >= IDS_DEPTH + 1:
            return 0
        arity = ids_arity(ord(text[at]))
        at += 1
        owed[-1] -= 1
        if arity:
            owed.append(arity)
        while owed and owed[-1] == 0:
            owed.pop()
    return at - start


def is_well_formed(data: bytes) -> bool:
    """Whether bytes are well-formed UTF-8."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def decode_lenient(data: bytes) -> str:
    """UTF-8 with each byte that begins no well-formed code point as U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def fnv1a64(data: bytes) -> int:
    """FNV-1a hash, 64 bits."""
    h = _FNV_START
    for b in data:
        h = (h ^ b) * _FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def hex64(value: int) -> str:
    """Sixteen lowercase hexadecimal digits."""
    return f"{value:016x}"


def escape(text: str) -> str:
    """One printable line: tab, line ends and backslash escaped, other controls as \\u{...}."""
    named = {"\t": "\\t", "\n": "\\n", "\r": "\\r", "\\": "\\\\"}
    return "".join(named.get(c) or (f"\\u{{{ord(c):x}}}" if ord(c) < 0x20 or 0x7F <= ord(c) < 0xA0 else c) for c in text)


class CodePointSet:
    """Immutable sorted set of code points with rank."""

    def __init__(self, points=()):
        self.points = tuple(sorted(set(points)))
        self._rank = {p: k for k, p in enumerate(self.points)}

    def __contains__(self, point: int) -> bool:
        return point in self._rank

    def __eq__(self, other) -> bool:
        return isinstance(other, CodePointSet) and self.points == other.points

    def __hash__(self) -> int:
        return hash(self.points)

    def __len__(self) -> int:
        return len(self.points)

    def index_of(self, point: int) -> int:
        """Rank of a member, -1 for others."""
        return self._rank.get(point, -1)

    def union(self, other: CodePointSet) -> CodePointSet:
        return CodePointSet(self.points + other.points)
