"""Configuration documents: JSON with comments, the first of repeated members wins."""

from __future__ import annotations

import json
import re

from ..errors import InvalidConfig, InvalidFormat, Unsupported
from .model import SHORT_CIRCUIT, UNION, Converter, Group, Leaf

#: Fixed values of the configuration format.
CONTAINER, TEXT, INLINE, GROUP, OTHER = "sok", "text", "inline", "group", ("ocd", "ocd2")

_STRIP = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)


def strip_comments(text: str) -> str:
    """Without // and /* */ comments outside of strings; line ends stay."""
    return _STRIP.sub(lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0]), text)


_TRAILING = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=\s*[\]}])', re.S)


def parse_json(text: str, **options):
    """JSON that may hold comments and a comma behind the last item."""
    return json.loads(_TRAILING.sub(lambda m: m[0] if m[0][0] == '"' else " ", strip_comments(text)), **options)


class _Members(dict):
    """An object that keeps first occurrences and remembers a repeated key."""

    def __init__(self, pairs):
        super().__init__()
        self.repeated = None
        for k, v in pairs:
            if k in self:
                self.repeated = self.repeated or k
            else:
                self[k] = v


def read(text: str) -> dict:
    """The document as nested objects."""
    try:
        got = parse_json(text, object_pairs_hook=_Members)
    except json.JSONDecodeError as e:
        raise InvalidConfig(str(e)) from e
    if not isinstance(got, dict):
        raise InvalidConfig("a configuration must be an object")
    return got


def _list(document: dict, member: str) -> list[dict]:
    got = document.get(member, [])
    if not isinstance(got, list):
        raise InvalidConfig(f"Property must be an array: {member}")
    return [x for x in got if isinstance(x, dict)]


def _flag(document: dict) -> bool:
    flag = document.get("may_output_tofu", False)
    if not isinstance(flag, bool):
        raise InvalidConfig("may_output_tofu must be a boolean")
    return flag


def referenced(document: dict) -> list[tuple[str, str]]:
    """(type, file) of every lexicon a document names, in order."""
    out: list[tuple[str, str]] = []

    def walk(node):
        if isinstance(node, dict):
            if isinstance(node.get("file"), str) and isinstance(node.get("type"), str):
                out.append((node["type"], node["file"]))
            for v in node.values():
                walk(v)
        elif isinstance(node, list):
            for v in node:
                walk(v)

    walk(document)
    return out


class Planner:
    """Builds converters; ``open_lexicon(type, file)`` supplies the leaves."""

    def __init__(self, open_lexicon, include_tofu: bool = False):
        self.open_lexicon, self.include_tofu = open_lexicon, include_tofu

    def parse(self, text: str) -> Converter:
        document = read(text)
        segmentation = None
        if document.get("segmentation") is not None:
            segmentation = self._segmentation(document["segmentation"])
        if "conversion_chain" not in document:
            raise InvalidConfig("conversion_chain is missing")
        chain = self._chain(_list(document, "conversion_chain"))
        stages = _list(document, "normalization")
        return Converter(chain, segmentation, self._chain(stages) if stages else None)

    def _segmentation(self, node):
        if not isinstance(node, dict):
            raise InvalidConfig("segmentation must be an object")
        if node.get("type") != "mmseg":
            raise Unsupported(f"segmentation type '{node.get('type')}'")
        if not isinstance(node.get("dict"), dict):
            raise InvalidConfig("mmseg segmentation requires a dict")
        # Segmentation always sees the tofu-risk lexicons.
        plan = self._dict(node["dict"], True)
        if plan is None:
            raise InvalidConfig("mmseg segmentation dictionary unavailable")
        return plan

    def _chain(self, stages: list[dict]) -> tuple:
        out = []
        for stage in stages:
            if not isinstance(stage.get("dict"), dict):
                raise InvalidConfig("a conversion requires a dict")
            out.append(self._dict(stage["dict"], self.include_tofu))
        return tuple(p for p in out if p is not None)

    def _dict(self, node: dict, include_tofu: bool):
        kind = node.get("type")
        if kind is None:
            raise InvalidConfig("dictionary entry has no 'type' field")
        if kind == INLINE:
            return self._inline(node)
        if kind == GROUP:
            if _flag(node) and not include_tofu:
                return None
            policy = node.get("match_policy", SHORT_CIRCUIT)
            if policy not in (SHORT_CIRCUIT, UNION):
                raise InvalidConfig(f"unknown match_policy: {policy}")
            members = node.get("dicts")
            if not isinstance(members, list) or not all(isinstance(m, dict) for m in members):
                raise InvalidConfig("a group requires dicts")
            children = [p for m in members if (p := self._dict(m, include_tofu)) is not None]
            return Group(children, policy) if children else None
        if kind not in (TEXT, CONTAINER, *OTHER):
            raise InvalidConfig(f"unknown dictionary type '{kind}'")
        if not isinstance(node.get("file"), str):
            raise InvalidConfig("a dictionary requires a file")
        if _flag(node) and not include_tofu:
            return None
        return self.open_lexicon(kind, node["file"])

    def _inline(self, node: dict) -> Leaf:
        if "may_output_tofu" in node:
            raise InvalidFormat("inline dictionary does not support may_output_tofu")
        entries = node.get("entries")
        if not isinstance(entries, dict):
            raise InvalidConfig("an inline dictionary requires entries")
        if entries.repeated is not None:
            raise InvalidConfig(f"inline dictionary contains duplicate key: {entries.repeated}")
        for k, v in entries.items():
            if not isinstance(v, str):
                raise InvalidConfig("inline dictionary values must be strings")
            if not k or not v:
                raise InvalidConfig("inline dictionary entries must be non-empty")
        return Leaf({k: [v] for k, v in entries.items()})


def rewrite(text: str) -> str:
    """The document as strict JSON with foreign binary lexicons renamed to containers."""

    def walk(node):
        if isinstance(node, dict):
            out = {k: walk(v) for k, v in node.items()}
            if out.get("type") in OTHER and isinstance(out.get("file"), str):
                base = re.sub(r"\.[^./]*$", "", out["file"].rpartition("/")[2])
                out["type"], out["file"] = CONTAINER, f"dictionary/{base}.{CONTAINER}"
            return out
        return [walk(v) for v in node] if isinstance(node, list) else node

    return json.dumps(walk(read(text)), ensure_ascii=False, indent=2) + "\n"
