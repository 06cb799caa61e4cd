"""The scanner: conversion, segmentation and inspection of one text.

At each position the longest-prefix match comes first; else a complete
description sequence or one character passes through.  Characters that begin no
key and no description sequence are passed in runs, found by one regular
expression.
"""

from __future__ import annotations

import re

from ..functions.text import ids_length
from .model import Converter

_IDS = "⿰-⿿"


class Scanner:
    """A plan ready to scan."""

    def __init__(self, plan):
        self.match = plan.match
        members = "".join(re.escape(c) for c in sorted(plan.starts()))
        self.skip = re.compile(f"[^{members}{_IDS}]+").match

    def convert(self, text: str) -> str:
        """The text with every match replaced by its value."""
        out, at, n = [], 0, len(text)
        while at < n:
            run = self.skip(text, at)
            if run:
                out.append(run[0])
                at = run.end()
                continue
            hit = self.match(text, at)
            if hit:
                at += hit[0]
                out.append(hit[1])
            else:
                size = ids_length(text, at) or 1
                out.append(text[at : at + size])
                at += size
        return "".join(out)

    def segment(self, text: str) -> list[str]:
        """Matches as segments of their own, what lies between as one segment each."""
        out, at, start, n = [], 0, 0, len(text)
        while at < n:
            run = self.skip(text, at)
            if run:
                at = run.end()
                continue
            hit = self.match(text, at)
            if hit:
                if start < at:
                    out.append(text[start:at])
                out.append(text[at : at + hit[0]])
                at = start = at + hit[0]
            else:
                at += ids_length(text, at) or 1
        if start < n:
            out.append(text[start:])
        return out


class Program:
    """A converter ready to run.

    A segment is converted alone in every stage, so its result depends on its
    text only; results of short segments are kept and used again."""

    KEEP, SHORT = 100_000, 32

    def __init__(self, converter: Converter):
        self.normalization = None if converter.normalization is None else [Scanner(p) for p in converter.normalization]
        self.segmentation = Scanner(converter.segmentation) if converter.segmentation is not None else None
        self.chain = [Scanner(p) for p in converter.chain]
        self.known: dict[str, str] = {}

    def _stages(self, text: str, chain) -> str:
        for stage in chain:
            text = stage.convert(text)
        return text

    def _segment(self, text: str) -> str:
        got = self.known.get(text)
        if got is None:
            got = self._stages(text, self.chain)
            if len(text) <= self.SHORT:
                if len(self.known) >= self.KEEP:
                    self.known.clear()
                self.known[text] = got
        return got

    def convert(self, text: str) -> str:
        if self.normalization:
            text = self._stages(text, self.normalization)
        if self.segmentation is None:
            return self._stages(text, self.chain)
        return "".join(map(self._segment, self.segmentation.segment(text)))

    def inspect(self, text: str) -> dict:
        """Every stage's segments, with stages numbered from one."""
        source, normal = text, []
        if self.normalization is not None:
            for k, stage in enumerate(self.normalization, 1):
                text = stage.convert(text)
                normal.append({"index": k, "segments": [text]})
        segments = [text] if self.segmentation is None else self.segmentation.segment(text)
        stages, now = [], segments
        for k, stage in enumerate(self.chain, 1):
            now = [stage.convert(s) for s in now]
            stages.append({"index": k, "segments": now})
        return {"input": source, "normalization_stages": normal, "segments": segments, "stages": stages, "output": "".join(now)}
