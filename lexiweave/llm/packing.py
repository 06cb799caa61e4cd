"""Concatenate-and-cut packing.

Pass one tokenises every document once and writes its ids with the running
total inside its partition.  Pass two adds the prefix sums of the partition
totals (one number per partition, the only thing the driver sees), which gives
each document its place in the global stream, and cuts the stream into fixed
windows.  A document that crosses a boundary has one record in each window.
All sequences but the last are full.

Results for odd input: null text counts as empty, and an empty text is the end
token alone; repeated rows and ids are separate documents, and the order of the
stream, ties included, is that of the input's partitions; a very long text is
cut at every window; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, texts

SEQUENCE = 4096
END_ID = 2
#: Entries of each half of a task's table of ids; the older half goes when the newer is full.
CACHE_WORDS = 200_000


#: The vocabulary's words in printable lower-case ASCII (a fixed value).
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class _Halves:
    """A table that forgets what was not asked for lately."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= CACHE_WORDS:
            self.old, self.new = self.new, {}
        self.new[key] = value


class WordCache:
    """Ids of a batch of texts from cached ids of their white-space separated parts.

    The vocabulary's normaliser and splitter never join across white space, so
    the parts can be encoded alone; the ids equal those of the whole text.  A
    batch looks each different part up once.  Parts of Latin letters, with one
    comma or full stop behind them, and printable ASCII parts split into the
    model's words without the normaliser."""

    def __init__(self, model: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.words = _Halves()
        # The byte-level alphabet: printable bytes stand for themselves, others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}

    def _known(self, word: str) -> bytes:
        """Ids of one word of the model: lower-case Latin-1 letters, one digit or a run of marks."""
        got = self.words.get(word)
        if got is None:
            raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            got = array("I", [t.id for t in self.tokenizer.model.tokenize(raw)]).tobytes()
            if len(word) <= 64:
                self.words.put(word, got)
        return got

    def _part(self, part: str) -> bytes:
        """Ids of a part that is not a word of the table as it stands."""
        if not part:
            return b""
        stem = part[:-1] if part[-1] in ".," else part
        # Latin letters have one composed form and one lower case.
        if stem.isalpha() and (stem.isascii() or max(stem) <= "\xff"):
            got = self._known(stem.lower())
            return got if stem is part else got + self._known(part[-1])
        if part.isascii() and part.isprintable():
            return b"".join(map(self._known, WORD.findall(part.lower())))
        got = self.words.get(part)
        if got is None:
            got = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
            if len(part) <= 64:
                self.words.put(part, got)
        return got

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end`` behind it; where each text ends)."""
        lists = pc.ascii_split_whitespace(texts)
        cut = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(cut[0], cut[-1] - cut[0]).dictionary_encode()
        runs = list(map(self.words.new.get, parts := coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        if None in runs:
            found = self._part
            runs = [found(p) if r is None else r for p, r in zip(parts, runs)]
        runs.append(np.array([end], "<u4").tobytes())
        size = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        ids = np.frombuffer(b"".join(runs), "<u4")
        start = np.cumsum(size) - size
        word = np.insert(coded.indices.to_numpy().astype(np.int64), cut[1:] - cut[0], len(runs) - 1)
        n = size[word]
        done = np.cumsum(n)
        at = np.repeat(start[word] - (done - n), n) + np.arange(int(n.sum()))
        return ids[at], done[cut[1:] - cut[0] + np.arange(len(texts))]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, start (tokens before it in its partition), n, ids (binary)."""
    spark = docs.sparkSession
    arrow_rows(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches):
        cache, part, start = WordCache(model.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, ends = cache.encode(batch.column("text"), end_id)
            n = np.diff(ends, prepend=0)
            held = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(4 * np.concatenate([[0], ends])), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), held], names=["doc_id", "part", "start", "n", "ids"])
            start += int(n.sum())

    return texts(docs).mapInArrow(run, "doc_id long, part int, start long, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ``ids`` (binary) if asked for."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    coded = scratch.write(tokenise(docs, tokenizer_path, end_id), "ids")
    totals = sorted((r.part, r.n) for r in coded.groupBy("part").agg(F.sum("n").alias("n")).collect())
    sums = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    offsets = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(totals, sums)] or [(0, 0)], "part int, base long")
    at = F.col("base") + F.col("start")
    placed = coded.join(F.broadcast(offsets), "part").select("doc_id", at.alias("g"), "n", "ids")
    piece = f"""transform(sequence(g div {sequence}, (g + n - 1) div {sequence}), s -> named_struct(
        's', s, 'a', greatest(s * {sequence}, g) - g, 'z', least((s + 1) * {sequence}, g + n) - g))"""
    cut = "substring(ids, cast(4 * p.a as int) + 1, cast(4 * (p.z - p.a) as int))"
    pieces = placed.withColumn("pieces", F.expr(piece)).select("doc_id", "n", "g", F.expr(f"transform(pieces, p -> named_struct('s', p.s, 'a', p.a, 'z', p.z, 'crc', crc32({cut})" + (f", 'ids', {cut}" if with_ids else "") + "))").alias("pieces"))
    out = pieces.select("doc_id", "n", "g", F.explode("pieces").alias("p"))
    return out.select("doc_id", F.col("p.a").alias("start"), (F.col("p.z") - F.col("p.a")).alias("length"), F.col("p.crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("p.s").alias("sequence_id"), (F.col("g") + F.col("p.a") - F.col("p.s") * sequence).alias("offset"), *([F.col("p.ids").alias("ids")] if with_ids else []))
