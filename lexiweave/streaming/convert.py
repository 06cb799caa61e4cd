"""Conversion over streams: whole texts, and texts that arrive in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import IDS_FIRST, IDS_LAST, ids_length
from ..operators.convert import as_converter, convert
from ..plans.kernel import Scanner


def convert_stream(stream: DataFrame, column: str, plan, out: str = "output") -> DataFrame:
    """A stream of whole texts with its converted column; stateless and narrow."""
    return stream.withColumn(out, convert(column, plan))


class ChunkedScanner:
    """Converts one text that arrives in pieces by a plan of one stage.

    Output is held back from where more input could still change it: within the
    longest key of the end, or inside a description sequence that is not over."""

    def __init__(self, plan):
        converter = as_converter(plan)
        if converter.segmentation is not None or converter.normalization or len(converter.chain) != 1:
            raise ValueError("chunks need a plan of one stage")
        self.scanner, self.plan = Scanner(converter.chain[0]), converter.chain[0]
        self.reach = max((len(k) for leaf in self.plan.leaves() for k in leaf.entries), default=1)
        self.tail = ""

    def push(self, chunk: str) -> str:
        """Output that is certain after one more piece."""
        text, at, out = self.tail + chunk, 0, []
        while at < len(text) and len(text) - at >= self.reach:
            hit = self.plan.match(text, at)
            if hit:
                out.append(hit[1])
                at += hit[0]
                continue
            size = ids_length(text, at)
            if not size and IDS_FIRST <= ord(text[at]) <= IDS_LAST and len(text) - at <= 64:
                break
            size = size or 1
            out.append(text[at : at + size])
            at += size
        self.tail = text[at:]
        return "".join(out)

    def finish(self) -> str:
        """What is left once no piece follows."""
        text, self.tail = self.tail, ""
        return self.scanner.convert(text)


def convert_chunks(stream: DataFrame, plan) -> DataFrame:
    """(key, output) of a stream of (key, seq, chunk, last) rows: each key's text is
    converted as it arrives; state per key is the short tail that is held back.
    Within a micro-batch pieces are taken in order of ``seq``."""
    import pandas as pd

    def run(key, frames, state):
        scanner = ChunkedScanner(plan)
        scanner.tail = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("seq")
        out = "".join(scanner.push(c or "") for c in rows["chunk"])
        if bool(rows["last"].any()):
            out += scanner.finish()
            state.remove()
        else:
            state.update((scanner.tail,))
        yield pd.DataFrame({"key": [key[0]], "output": [out]})

    return stream.groupBy("key").applyInPandasWithState(run, "key string, output string", "tail string", "append", "NoTimeout")
