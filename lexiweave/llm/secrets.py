"""Secret scan: fixed rules, then formats learned by grammar inference.

The rules' own hits are labelled credentials.  A bounded sample of each kind
goes into a prefix tree whose statistically compatible states are merged
(Hoeffding bound on every outgoing and final frequency), which leaves a
probabilistic automaton per kind.  Every token of the corpus that could
be a credential, the rules' own hits included, is scored by its mean log likelihood
under each automaton less that under an automaton of a sample of all unlabelled
tokens; scores of a kind with few labels shrink toward zero.  An unlabelled token
that scores above what the labelled credentials themselves score is added as
kind ``format``.  Repeated tokens score alike, ties are on the side of the format.

Results for odd input: null text counts as empty and has no span; repeated rows
are scanned each; with no labelled credential no automaton is built and only
the rules apply.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, texts

#: Distinct labelled credentials per kind, and ordinary tokens, that training reads at most.
SAMPLE = 3000
#: Labelled credentials of a kind at which its scores count by half: fewer shrink
#: them toward those of ordinary tokens.
SHRINK = 20
#: Log likelihood of each symbol that no state explains; scores that a format has at least.
UNSEEN, FLOOR = math.log(1e-3), 0.05
#: Confidence of the compatibility test.
ALPHA = 0.01
#: Labelled credentials that score below the threshold, as a share.
MISS = 0.02
KINDS = ("assign", "access", "hex", "format")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What could be a credential: a token as long and of the signs that a labelled one may have.
LEAST_LENGTH = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
PART = re.compile(r"[A-Za-z0-9+/_=-]{12,}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, labelled value) of the rules, in the order of the digest."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of the tokens that no rule's span meets, without full stops at
    their end; of a token that one meets, the parts between dots."""
    apart = lambda a, b: not any(s < b and a < e for s, _, e, _ in base)
    out = []
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.start() + len(m[0].rstrip("."))
        if end - start < LEAST_LENGTH:
            continue
        if apart(start, end):
            out.append((start, end))
        else:
            out += [p.span() for p in PART.finditer(text, start, end) if apart(*p.span())]
    return out


def shape(token: str) -> str:
    """A token over the automata's alphabet: hex letter, other lower, upper, digit, sign."""
    return "".join("d" if c.isdigit() else "x" if c in "abcdef" else "l" if c.islower() else "U" if c.isupper() else c for c in token)


class Automaton:
    """Probabilistic automaton by state merging over a prefix tree."""

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        self.go: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.final = [0]
        self.total = [0]
        for s in samples:
            at = 0
            for c in s:
                self.total[at] += 1
                self.count[at][c] += 1
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                    self.count.append(defaultdict(int))
                    self.final.append(0)
                    self.total.append(0)
                at = self.go[at][c]
            self.total[at] += 1
            self.final[at] += 1
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.alpha * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.final[a], self.total[a], self.final[b], self.total[b]):
                return False
            for c in {*self.go[a], *self.go[b]}:
                if self._differ(self.count[a].get(c, 0), self.total[a], self.count[b].get(c, 0), self.total[b]):
                    return False
                if c in self.go[a] and c in self.go[b]:
                    todo.append((self.go[a][c], self.go[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.final[a] += self.final[b]
            self.total[a] += self.total[b]
            for c, t in self.go[b].items():
                self.count[a][c] += self.count[b][c]
                if c in self.go[a]:
                    todo.append((self.go[a][c], t))
                else:
                    self.go[a][c] = t

    def _infer(self) -> None:
        red, blue = [0], [(0, c, t) for c, t in sorted(self.go[0].items())]
        while blue:
            p, c, b = blue.pop(0)
            for r in red:
                if self._compatible(r, b):
                    self.go[p][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            known = set(red)
            blue = [(q, x, t) for q in red for x, t in sorted(self.go[q].items()) if t not in known]
        self.states = red

    def likelihood(self, s: str) -> float:
        """Mean log probability of a string's symbols and its end."""
        at, total = 0, 0.0
        for k, c in enumerate(s):
            n = self.total[at] + 0.5 * (len(self.go[at]) + 2)
            total += math.log((self.count[at].get(c, 0) + 0.5) / n)
            nxt = self.go[at].get(c)
            if nxt is None:
                # No state explains what follows, the end included.
                return (total + UNSEEN * (len(s) - k)) / (len(s) + 1)
            at = nxt
        total += math.log((self.final[at] + 0.5) / (self.total[at] + 0.5 * (len(self.go[at]) + 2)))
        return total / (len(s) + 1)


class Formats:
    """Automata of the labelled kinds and of ordinary tokens, with thresholds."""

    def __init__(self, labelled: dict[int, list[str]], ordinary: list[str]):
        self.ordinary = Automaton([shape(t) for t in ordinary]) if ordinary else None
        self.kinds: list[tuple[Automaton, float, float]] = []
        for kind in sorted(labelled):
            tokens = labelled[kind]
            if tokens:
                model, weight = Automaton([shape(t) for t in tokens]), len(tokens) / (len(tokens) + SHRINK)
                scores = sorted(weight * self._ratio(model, t) for t in tokens)
                self.kinds.append((model, weight, max(FLOOR, scores[int(MISS * len(scores))])))

    def _ratio(self, model: Automaton, token: str) -> float:
        s = shape(token)
        return model.likelihood(s) - (self.ordinary.likelihood(s) if self.ordinary else UNSEEN / 2)

    def score(self, token: str) -> float:
        """How far the best format's score is above its threshold; 0 or more is a credential."""
        return max((w * self._ratio(m, token) - t for m, w, t in self.kinds), default=-math.inf)

    def accepts(self, token: str) -> bool:
        return self.score(token) >= 0


def _scan(docs: DataFrame) -> DataFrame:
    """One pass of the rules: doc_id, base spans, labelled values and candidates."""
    arrow_rows(docs.sparkSession)
    kind = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            spans, values, spots, tokens = [], [], [], []
            for cell in batch.column("text"):
                text = cell.as_py()
                base = base_spans(text)
                spans.append([x for s, k, e, _ in base for x in (k, s, e)])
                values.append([f"{k}{v}" for _, k, _, v in base])
                free = candidates(text, base)
                spots.append([x for span in free for x in span])
                tokens.append([text[s:e] for s, e in free])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind), pa.array(values, pa.list_(pa.string())), pa.array(spots, kind), pa.array(tokens, pa.list_(pa.string()))], names=["doc_id", "base", "labelled", "spots", "tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, base array<long>, labelled array<string>, spots array<long>, tokens array<string>")


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format, n_spans, n_scored
    (tokens scored) and top_score (the highest; null if none) for each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    found = scratch.write(_scan(docs), "found")
    first = lambda df, n: [r.v for r in df.distinct().orderBy(F.xxhash64("v"), "v").limit(n).collect()]
    values = found.select(F.explode("labelled").alias("v"))
    labelled = {k: [v[1:] for v in first(values.where(F.col("v").startswith(str(k))), sample)] for k in range(3)}
    tokens = found.select(F.explode("tokens").alias("v"))
    formats = spark.sparkContext.broadcast(Formats(labelled, first(tokens, sample)))

    def run(batches):
        model, known = formats.value, {}

        def score(token: str) -> float:
            if token not in known:
                if len(known) > 100_000:
                    known.clear()
                known[token] = model.score(token)
            return known[token]

        kind = {"base_sha256": pa.string(), "spans": pa.string(), "top_score": pa.float64()}
        for batch in batches:
            out = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format", "n_spans", "n_scored", "top_score")}
            for flat, values, spots, toks in zip(*[batch.column(c).to_pylist() for c in ("base", "labelled", "spots", "tokens")]):
                base = [(s, k, e) for k, s, e in zip(flat[::3], flat[1::3], flat[2::3])]
                scores = [score(t) for t in toks]
                added = [(s, 3, e) for s, e, x in zip(spots[::2], spots[1::2], scores) if x >= 0]
                scores += [score(v[1:]) for v in values]
                for k, n in enumerate(("n_assign", "n_access", "n_hex")):
                    out[n].append(sum(1 for x in base if x[1] == k))
                out["base_sha256"].append(hashlib.sha256(_digest(base).encode()).hexdigest())
                out["spans"].append(_digest(base + added))
                out["n_format"].append(len(added))
                out["n_spans"].append(len(base) + len(added))
                out["n_scored"].append(len(scores))
                out["top_score"].append(max((x for x in scores if x > -math.inf), default=None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, kind.get(n, pa.int64())) for n, v in out.items()]], names=["doc_id", *out])

    return found.select("doc_id", "base", "labelled", "spots", "tokens").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, n_spans long, n_scored long, top_score double")
