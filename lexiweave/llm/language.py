"""Language identification by words first, backing off to shorter n-grams.

Training counts the words of a bounded sample of labelled documents.  A word
seen in training scores by its log frequency in each language.  An unseen word
takes its longest known character n-grams, from ``ORDER`` down to one, each
scored by its log frequency among the training words' n-grams with a fixed
discount for every order given up.  A document's language is the one with the
highest mean word score.

Results for odd input: null text and text without a letter give ``und`` with
score 0; rows without a label are not learned from; ties go to the label first
in order; an empty training set gives ``und`` for all.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, own_names

#: Expected labelled documents per language in the training sample.
SAMPLE_DOCS = 1500
#: A word must be seen so often in the sample to count as known.
KNOWN = 2
#: Longest n-gram of the back-off, and the cost of each shorter order.
ORDER = 4
DISCOUNT = math.log(0.4)
#: Documents whose best language scores less are rejected by the filter.
MIN_SCORE = 0.3
#: Unseen words whose scores a worker keeps.
CACHE_WORDS = 200_000


def letters(text: str | None) -> list[str]:
    """Case-folded runs of letters."""
    import regex

    return regex.findall(r"\p{L}+", text.lower()) if text else []


class Model:
    """Word and n-gram log frequencies by language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        self.words: dict[str, np.ndarray] = {}
        self.grams: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER + 1)]
        every = {w for c in counts.values() for w, n in c.items()}
        grams = [defaultdict(lambda: np.zeros(len(self.langs))) for _ in range(ORDER + 1)]
        words = {w: np.zeros(len(self.langs)) for w in every}
        for k, lang in enumerate(self.langs):
            for w, n in counts[lang].items():
                words[w][k] += n
                for g in self._grams(w):
                    grams[len(g)][g][k] += n
        self.words = self._logs({w: x for w, x in words.items() if x.sum() >= KNOWN}, np.array([max(1, sum(counts[x].values())) for x in self.langs]))
        for n in range(1, ORDER + 1):
            kept = {g: x for g, x in grams[n].items() if x.sum() >= KNOWN}
            self.grams[n] = self._logs(kept, np.maximum(1, sum(grams[n].values(), np.zeros(len(self.langs)))))

    @staticmethod
    def _logs(table: dict[str, np.ndarray], totals: np.ndarray) -> dict[str, np.ndarray]:
        return {k: np.log((x + 0.1) / (totals + 0.1 * (len(table) + 1))) for k, x in table.items()}

    @staticmethod
    def _grams(word: str):
        w = f"^{word}$"
        for n in range(1, ORDER + 1):
            for i in range(len(w) - n + 1):
                yield w[i : i + n]

    def score(self, word: str) -> np.ndarray:
        """Log score of a word in each language, up to a constant for the word."""
        found = self.words.get(word)
        if found is not None:
            return found
        w = f"^{word}$"
        for n in range(ORDER, 0, -1):
            hits = [x for i in range(len(w) - n + 1) if (x := self.grams[n].get(w[i : i + n])) is not None]
            if hits:
                return np.mean(hits, axis=0) + DISCOUNT * (ORDER - n)
        return np.zeros(len(self.langs))


class Predictor:
    """Scores of words as rows of one matrix, so a document is a gather and a sum."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows = np.zeros((CACHE_WORDS, max(1, len(model.langs))))

    def predict(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.model.langs:
            return "und", 0.0
        at, total = self.at, np.zeros(self.rows.shape[1])
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            ids = list(map(at.get, part))
            if None in ids:
                new = {w for w, i in zip(part, ids) if i is None}
                if len(at) + len(new) > CACHE_WORDS:
                    at.clear()
                    new = set(part)
                for w in new:
                    self.rows[len(at)] = self.model.score(w)
                    at[w] = len(at)
                ids = list(map(at.get, part))
            total += self.rows[ids].sum(axis=0)
        mean = total / len(words)
        best = int(np.argmax(mean))
        return self.model.langs[best], float(1 / np.exp(mean - mean[best]).sum())


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from (doc_id, text, lang): about ``sample_docs`` documents of each
    language, chosen by a hash of doc_id, whole texts."""
    labelled = labelled.where("lang is not null and text is not null")
    share = {r.lang: min(1.0, sample_docs / r.n) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model({})
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    wanted = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(v * (1 << 30)))) for k, v in share.items()])
    arrow_rows(labelled.sparkSession)

    def count(batches):
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                seen[lang].update(letters(text.as_py()))
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    sample = labelled.where(place < wanted).select("lang", "text")
    got = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= KNOWN)
    counts: dict[str, dict[str, int]] = {k: {} for k in share}
    for part in got.toPandas().itertuples():
        counts[part.lang][part.word] = part.n
    return Model(counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_lang`` and ``_score`` from the text alone; a narrow pass."""
    spark = docs.sparkSession
    arrow_rows(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias("__lang"), F.lit(0.0).alias("__score")).schema

    def run(batches):
        predictor = Predictor(shared.value)
        for batch in batches:
            got = [predictor.predict(letters(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*batch.schema.names, "__lang", "__score"])

    return docs.mapInArrow(run, schema)


def fold(doc_id="doc_id"):
    """The fold of a document: crc32 of its id as text, modulo four."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents not held out."""
    held = F.coalesce(fold() == 2, F.lit(False))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(base.where(~held & F.col("doc_id").isNotNull()))
    got = identify(base.select("doc_id", "text"), model)
    return got.select("doc_id", held.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


@own_names
def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that have no letter or no language above ``min_score``."""
    names = docs.columns
    model = train(docs.select("doc_id", "text", "lang"))
    return identify(docs, model).where((F.col("__lang") != "und") & (F.col("__score") >= min_score)).select(*[F.col(f"`{c}`") for c in names])
