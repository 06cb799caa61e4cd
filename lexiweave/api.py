"""Facade: converters by profile or configuration, as Spark columns.

The lexicons of the profiles are the caller's to supply, through
:class:`~lexiweave.sources.lexicon.Resources`; none is part of this library.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession

from .errors import InvalidConfig, LexiconError
from .operators import convert as _convert
from .plans.config import CONTAINER, Planner
from .plans.kernel import Program
from .plans.model import SHORT_CIRCUIT, UNION, Converter
from .sources.lexicon import Lexicons, Resources

#: Lexicon groups of the profiles; ``*`` marks a tofu-risk lexicon.
_SEG_S = (UNION, "STPhrases", "STPhrases_GeneratedFromRegionalPhrases")
_ST = (SHORT_CIRCUIT, _SEG_S, "STCharacters")
_TS = (SHORT_CIRCUIT, "TSPhrases", "*TSCharactersExt", "TSCharacters")
_TW, _HK = (SHORT_CIRCUIT, "TWVariantsPhrases", "TWVariants"), (SHORT_CIRCUIT, "HKVariantsPhrases", "HKVariants")
_TWP, _HKP = (SHORT_CIRCUIT, "TWPhrases", *_TW[1:]), (SHORT_CIRCUIT, "HKPhrases", *_HK[1:])
_TWR, _HKR = (SHORT_CIRCUIT, "TWVariantsRevPhrases", "TWVariantsRev"), (SHORT_CIRCUIT, "HKVariantsRevPhrases", "HKVariantsRev")
_TWPR, _HKPR = (SHORT_CIRCUIT, "TWPhrasesRev", *_TWR[1:]), (SHORT_CIRCUIT, "HKPhrasesRev", *_HKR[1:])
NORMALIZATION = "CJK_Compatibility_Ideographs"
#: Profile -> (segmentation, conversion chain).
PROFILES = {
    "s2t": (None, [_ST]),
    "t2s": (None, [_TS]),
    "s2tw": (_SEG_S, [_ST, _TW]),
    "s2twp": (_SEG_S, [_ST, _TWP]),
    "tw2s": ("TSPhrases", [_TWR, _TS]),
    "tw2sp": ("TSPhrases", [_TWPR, _TS]),
    "t2tw": (None, [_TW]),
    "tw2t": (None, [_TWR]),
    "s2hk": (_SEG_S, [_ST, _HK]),
    "s2hkp": (_SEG_S, [_ST, _HKP]),
    "hk2s": ("TSPhrases", [_HKR, _TS]),
    "hk2sp": ("TSPhrases", [_HKPR, _TS]),
    "t2hk": (None, [_HK]),
    "hk2t": (None, [_HKR]),
    "jp2t": (None, [(SHORT_CIRCUIT, "JPShinjitaiPhrases", "JPShinjitaiCharacters")]),
    "t2jp": (None, ["JPShinjitaiCharactersRev"]),
}


@dataclass(frozen=True)
class Options:
    """Choices of a conversion."""

    include_tofu_risk_dictionaries: bool = False


@dataclass(frozen=True)
class Result:
    """A converter or the error that creating it met."""

    value: Conversion | None = None
    error: LexiconError | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


@dataclass
class Conversion:
    """A converter: on one text, on a column, or as a SQL function."""

    converter: Converter
    program: Program = field(init=False, repr=False)

    def __post_init__(self):
        self.program = Program(self.converter)

    def convert(self, text: str) -> str:
        return self.program.convert(text)

    def inspect(self, text: str) -> dict:
        return self.program.inspect(text)

    def column(self, c: str | Column) -> Column:
        return _convert.convert(c, self.converter)

    def inspect_column(self, c: str | Column) -> Column:
        return _convert.inspect(c, self.converter)

    def register(self, spark: SparkSession, name: str) -> None:
        _convert.register(spark, name, self.converter)


def from_stem(stem: str) -> str:
    """The profile of a stem, in any case, with or without ``.json``."""
    name = stem.removesuffix(".json").lower()
    if name not in PROFILES:
        raise InvalidConfig(f"unknown profile '{stem}'")
    return name


def _node(plan, folder: str, kind: str) -> dict:
    if isinstance(plan, str):
        return {"type": kind, "file": f"{folder}/{plan.removeprefix('*')}.{kind if kind == CONTAINER else 'txt'}", "may_output_tofu": plan.startswith("*")}
    return {"type": "group", "match_policy": plan[0], "dicts": [_node(p, folder, kind) for p in plan[1:]]}


def profile_config(stem: str, folder: str = "dictionary", kind: str = CONTAINER) -> str:
    """The configuration document of a profile over lexicons of one type."""
    segmentation, chain = PROFILES[from_stem(stem)]
    doc = {"name": stem, "normalization": [{"dict": _node(NORMALIZATION, folder, kind)}]}
    if segmentation:
        doc["segmentation"] = {"type": "mmseg", "dict": _node(segmentation, folder, kind)}
    doc["conversion_chain"] = [{"dict": _node(p, folder, kind)} for p in chain]
    return json.dumps(doc, ensure_ascii=False)


def create_from_config(text: str, resources: Resources | Lexicons, options: Options = Options()) -> Conversion:
    """A converter of a configuration document."""
    lexicons = resources if isinstance(resources, Lexicons) else Lexicons(resources)
    return Conversion(Planner(lexicons.open, options.include_tofu_risk_dictionaries).parse(text))


def create(profile: str, resources: Resources | Lexicons, options: Options = Options(), kind: str = CONTAINER) -> Conversion:
    """A converter of a profile; raises what goes wrong."""
    return create_from_config(profile_config(profile, kind=kind), resources, options)


def create_result(profile: str, resources: Resources | Lexicons, options: Options = Options(), kind: str = CONTAINER) -> Result:
    """As :func:`create`, with this library's errors as values."""
    try:
        return Result(value=create(profile, resources, options, kind))
    except LexiconError as e:
        return Result(error=e)
