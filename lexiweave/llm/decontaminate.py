"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's normalised word sequences go into one suffix automaton.  Each
document streams its words through it and tracks the longest suffix that some
item contains; once that length reaches the window, the last ``window`` words
are a window of an item.  Items shorter than the window match as a whole.

Results for odd input: null text has no words; an item with no words matches
nothing; items with a null id still hit words but are not listed; repeated
items and documents are each handled as they come; extra columns are ignored
by :func:`contamination` and kept by :func:`decontaminate`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, own_names, texts

WINDOW = 10
#: Item words in one broadcast automaton; a larger benchmark takes several, all held by each worker.
BLOCK_WORDS = 250_000
#: A document whose hit words exceed this share goes as a whole; else only its spans go.
MAX_COVERAGE = 0.5

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the items of each window."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: state -> [(length, item ids)]: a window of that length ends here.
        self.marks: dict[int, dict[int, set]] = {}
        for item, seq in coded:
            need = min(window, len(seq))
            state = matched = 0
            for c in seq:
                state, matched = self.step(state, matched, c)
                if matched >= need:
                    at = state
                    while self.length[self.link[at]] >= need:
                        at = self.link[at]
                    self.marks.setdefault(at, {}).setdefault(need, set()).add(item)
        self.least = min((min(window, len(s)) for _, s in coded), default=window)
        self._ends: dict[int, list] = {}

    def _extend(self, last: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        if c in go[last]:
            q = go[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return cur

    def _split(self, p: int, q: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        clone = len(go)
        go.append(dict(go[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and go[p].get(c) == q:
            go[p][c] = clone
            p = link[p]
        return clone

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """One word on: the new state and the longest matching length."""
        go, link = self.go, self.link
        while c not in go[state]:
            state = link[state]
            if state == -1:
                return 0, 0
            matched = self.length[state]
        return go[state][c], matched + 1

    def ends(self, state: int) -> list[tuple[int, set]]:
        """The marked (length, items) of a state and all its suffixes."""
        got = self._ends.get(state)
        if got is None:
            got, at = [], state
            while at > 0:
                got += self.marks.get(at, {}).items()
                at = self.link[at]
            self._ends[state] = got
        return got

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit runs [start, end) in words, and the items that occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, iter(lambda: -1, 0)), np.int64, len(words)) if words else np.empty(0, np.int64)
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        runs: list[tuple[int, int]] = []
        items: set = set()
        for a, b in known.reshape(-1, 2):
            if b - a < self.least:
                continue
            state = matched = 0
            for at, c in enumerate(ids[a:b].tolist(), int(a) + 1):
                state, matched = self.step(state, matched, c)
                if matched < self.least:
                    continue
                longest = 0
                for need, found in self.ends(state):
                    if need <= matched:
                        longest = max(longest, need)
                        items |= found
                if longest:
                    start = at - longest
                    while runs and runs[-1][1] >= start:
                        start = min(start, runs.pop()[0])
                    runs.append((start, at))
        return runs, items


def _blocks(benchmark: DataFrame, window: int):
    """Automata of the benchmark, each over at most BLOCK_WORDS words (or one item)."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        ws = words_of(row.t)
        if held and size + len(ws) > BLOCK_WORDS:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((row.i, ws))
        size += len(ws)
    yield Automaton(held, window)


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _streamed(docs: DataFrame, benchmark: DataFrame, window: int, schema: T.StructType, finish) -> DataFrame:
    """``docs`` in one narrow pass: ``finish`` makes of each batch and its hits, (words,
    flat runs of word positions, item ids as strings) by row, a batch of ``schema``.
    A document is cut into words once, whatever the number of blocks."""
    spark = docs.sparkSession
    arrow_rows(spark)
    shared = [spark.sparkContext.broadcast(a) for a in _blocks(benchmark, window)]

    def run(batches):
        models = [b.value for b in shared]
        for batch in batches:
            hits = []
            for text in batch.column("text"):
                ws = words_of(text.as_py())
                found = [m.scan(ws) for m in models]
                runs = _merge([r for rs, _ in found for r in rs])
                items = set().union(*(i for _, i in found)) - {None}
                hits.append((len(ws), [x for r in runs for x in r], sorted(items)))
            yield finish(batch, hits)

    return docs.mapInArrow(run, schema)


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` and its hit runs: ``__n_words``, ``__runs`` (flat word positions) and
    ``__items`` (ids as strings)."""
    schema = docs.select("*", F.lit(None).cast("long").alias("__n_words"), F.array().cast("array<long>").alias("__runs"), F.array().cast("array<string>").alias("__items")).schema

    def add(batch, hits):
        n_words, runs, items = zip(*hits) if hits else ([], [], [])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return _streamed(docs, benchmark, window, schema, add)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    got = scanned(texts(docs), benchmark, window)
    hit = F.expr("aggregate(transform(__runs, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")
    return got.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"), (F.size("__runs") > 0).alias("contaminated"))


def cut_words(text: str, runs: list[int]) -> str:
    """``text`` without the words of the flat ``runs`` and what stands between them."""
    spots = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2]):
        out.append(text[at : spots[a][0]])
        at = spots[b - 1][1]
    out.append(text[at:])
    return "".join(out)


@own_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without benchmark spans: a document whose hit words exceed
    ``max_coverage`` of its words goes; of the rest only the hit runs are cut."""
    at = docs.columns.index("text")

    def cut(batch, hits):
        text = batch.column("text")
        arrays = list(batch.columns)
        arrays[at] = pa.array([cut_words(text[k].as_py(), runs) if runs else text[k].as_py() for k, (_, runs, _) in enumerate(hits)], text.type)
        keep = [k for k, (n, runs, _) in enumerate(hits) if sum(runs[1::2]) - sum(runs[::2]) <= max_coverage * n]
        return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names).take(pa.array(keep, pa.int64()))

    return _streamed(docs, benchmark, window, docs.schema, cut)
