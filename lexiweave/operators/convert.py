"""Conversion, segmentation and inspection as columns.

Three tiers give the same text.  Single-character lexicons become ``translate``;
small lexicons one regular expression whose matches are looked up; everything
else, and every row with a description operator, goes through one Arrow UDF
that holds the whole plan.  All are narrow: no conversion shuffles.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import has_ids
from ..plans.kernel import Program, Scanner
from ..plans.model import SHORT_CIRCUIT, UNION, Converter, Group, Leaf

#: Keys up to which one regular expression is the faster tier.
REGEX_KEYS = 20

_STAGE = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("segments", T.ArrayType(T.StringType()))]))
INSPECTION = T.StructType([T.StructField("input", T.StringType()), T.StructField("normalization_stages", _STAGE), T.StructField("segments", T.ArrayType(T.StringType())), T.StructField("stages", _STAGE), T.StructField("output", T.StringType())])


def as_converter(plan) -> Converter:
    """A plan as a converter of one stage; converters as they are."""
    return plan if isinstance(plan, Converter) else Converter((plan,))


def flattened(plan) -> list[tuple[str, str]] | None:
    """Keys and values in the order in which a plan tries them, None where no
    single order can say it (a short-circuit group inside a union)."""
    if isinstance(plan, Leaf):
        return sorted(plan.default.items(), key=lambda x: (-len(x[0]), x[0]))
    if plan.policy == SHORT_CIRCUIT:
        parts = [flattened(c) for c in plan.children]
        return None if None in parts else _first_of([x for p in parts for x in p])
    if all(isinstance(x, Leaf) or x.policy == UNION for x in _inside(plan)):
        return sorted(_first_of([x for leaf in plan.leaves() for x in leaf.default.items()]), key=lambda x: (-len(x[0]), x[0]))
    return None


def _inside(plan) -> list:
    return [plan] + ([x for c in plan.children for x in _inside(c)] if isinstance(plan, Group) else [])


def _first_of(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return list(out.items())


def tier(plan) -> str:
    """``translate``, ``regex`` or ``udf``."""
    flat = flattened(plan)
    if flat is None:
        return "udf"
    if flat and all(len(k) == 1 and len(v) <= 1 for k, v in flat) and not any("⿰" <= k <= "⿿" for k, _ in flat):
        return "translate"
    return "regex" if flat and len(flat) <= REGEX_KEYS else "udf"


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", text) if text.isascii() else "".join(_quoted(c) if c.isascii() else c for c in text)


def _native(c: Column, plan, which: str) -> Column:
    flat = flattened(plan)
    if which == "translate":
        pairs = sorted(flat, key=lambda x: (x[1] == "", x[0]))
        return F.translate(c, "".join(k for k, _ in pairs), "".join(v for _, v in pairs))
    starts = "".join(_quoted(s) for s in sorted(plan.starts()))
    pattern = f"(?s)[^{starts}]+|" + "|".join(_quoted(k) for k, _ in flat) + "|."
    values = F.create_map(*[F.lit(x) for pair in flat for x in pair])
    tokens = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(values, t), t)), "")


def _program_udf(converter: Converter, method: str, kind) -> Column:
    held: list = []

    def program() -> Program:
        if not held:
            held.append(Program(converter))
        return held[0]

    if method == "convert":

        def run(texts: pd.Series) -> pd.Series:
            f = program().convert
            return pd.Series([None if t is None else f(t) for t in texts], dtype=object)

        return F.pandas_udf(run, kind)

    def rows(texts: pd.Series) -> pd.DataFrame:
        f = program().inspect
        none = dict.fromkeys(INSPECTION.names)
        return pd.DataFrame([none if t is None else f(t) for t in texts], columns=INSPECTION.names)

    return F.pandas_udf(rows, kind)


def convert(c: str | Column, plan, force: str | None = None) -> Column:
    """``c`` converted; NULL stays NULL.  ``force`` names a tier."""
    c = F.col(c) if isinstance(c, str) else c
    converter = as_converter(plan)
    stages = [*(converter.normalization or ()), *converter.chain]
    tiers = [tier(p) for p in stages] if converter.segmentation is None else ["udf"]
    if force == "udf" or "udf" in tiers:
        return _program_udf(converter, "convert", T.StringType())(c)
    native = c
    for p, t in zip(stages, tiers):
        native = _native(native, p, t)
    if force == "native":
        return native
    # A stage can write an operator itself, so values count as texts do.
    risky = any("⿰" <= x <= "⿿" for p in stages for leaf in p.leaves() for v in leaf.default.values() for x in v)
    if risky:
        return _program_udf(converter, "convert", T.StringType())(c)
    return F.coalesce(_program_udf(converter, "convert", T.StringType())(F.when(has_ids(c), c)), native)


def segment(c: str | Column, plan) -> Column:
    """Array of segments of ``c``: maximal forward matches and what lies between."""
    c = F.col(c) if isinstance(c, str) else c
    held: list = []

    def run(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Scanner(plan))
        return pd.Series([None if t is None else held[0].segment(t) for t in texts], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(c)


def inspect(c: str | Column, plan) -> Column:
    """Struct of the input, the segments after every stage, and the output; NULL for NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), _program_udf(as_converter(plan), "inspect", INSPECTION)(c))


def candidates(c: str | Column, plan) -> Column:
    """All candidates of a text that is a key as a whole, NULL for others."""
    c = F.col(c) if isinstance(c, str) else c

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or (v := plan.exact(t)) is None else list(v) for t in texts], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(c)


def register(spark, name: str, plan) -> None:
    """A converter as a SQL function."""
    spark.udf.register(name, _program_udf(as_converter(plan), "convert", T.StringType()))
