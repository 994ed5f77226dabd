"""What a column name says: metadata only, never rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

# Substrings of lower-cased column names.
MEASURE_WORDS = (
    "площад", "area", "sqm", "кв.м", "кв м", "м.кв", "м кв", "метраж",
    "price", "цен", "плат", "rent", "cost", "amount", "сумм", "доход",
    "выруч", "вес", "weight", "объем", "volume", "score", "rating",
    "оценк", "возраст", "age", "salary", "зарплат", "тариф", "ставк",
    "width", "height", "depth", "temp", "duration", "длител",
)
ID_WORDS = ("id", "index", "idx", "key", "номер", "код")
GEO_WORDS = (
    "город", "city", "town", "населен", "регион", "region", "област",
    "district", "country", "страна", "адрес", "address", "localit",
    "location", "поселок", "посёлок", "деревн", "район", "округ", "state",
    "province", "municip", "zip", "индекс",
)
MONEY_WORDS = (
    "цена", "плат", "price", "rent", "cost", "amount", "сумм", "доход",
    "выруч", "revenue", "profit", "тариф", "ставк", "fee", "оплат", "зарплат",
    "salary",
)
CURRENCY_WORDS = ("валют", "currency", "ccy", "curr")
AREA_WORDS = (
    "площад", "area", "sqm", "кв.м", "кв м", "м.кв", "м кв", "метраж",
    "кв. м", "м2", "m2",
)
BUSINESS_WORDS = (
    "revenue", "profit", "margin", "price", "cost", "sales", "amount",
    "quantity", "score", "rating", "nps", "total", "sum", "avg", "mean",
    "доход", "выруч", "прибыл", "марж", "цена", "сумм", "колич", "оценк",
    "плат", "аренд", "площад",
)
UNCHARTED_WORDS = (
    "id", "index", "idx", "key", "sku", "uuid", "hash", "код", "номер",
)
KEY_WORDS = ("id", "код", "номер", "key", "uuid", "guid", "инн", "унп", "idx")
KEY_MEASURE_WORDS = (
    "площад", "area", "sqm", "price", "цен", "плат", "rent", "cost", "amount",
    "сумм", "доход", "выруч", "вес", "weight", "объем", "volume", "score",
    "rating", "оценк", "возраст", "age", "salary", "зарплат", "тариф", "ставк",
)
KEY_SUFFIXES = ("identifier", "uuid", "guid", "id", "код", "key", "номер", "no")
KEY_PREFIXES = ("id", "код")

def mentions(name: str, words: Iterable[str]) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in words)


def tidy_header(name: object) -> str:
    return " ".join(str(name).split())


def tidy_headers(names: Sequence[object]) -> list[str]:
    """Whitespace-normalised headers; repeats get ``.1``, ``.2`` so that Spark can resolve them."""
    taken: set[str] = set()
    out = []
    for raw in names:
        clean = tidy_header(raw)
        candidate, n = clean, 0
        while candidate.lower() in taken:
            n += 1
            candidate = f"{clean}.{n}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def table_id(label: str, taken: set[str]) -> str:
    """A word-character id for a table, unique among ``taken``."""
    base = re.sub(r"\W+", "_", label).strip("_") or "table"
    candidate, n = base, 2
    while candidate in taken:
        candidate, n = f"{base}_{n}", n + 1
    return candidate


SEPARATORS = re.compile(r"[\s_.\-]+")


def bare(name: str) -> str:
    """A name in lower case without separators."""
    return SEPARATORS.sub("", name.lower())


def core(name: str) -> str:
    """A bare name without the longest key word at its end, or else at its beginning; something always stays."""
    ends = [len(w) for w in KEY_SUFFIXES if len(w) < len(name) and name.endswith(w)]
    if ends:
        return name[:-max(ends)]
    starts = [len(w) for w in KEY_PREFIXES if len(w) < len(name) and name.startswith(w)]
    return name[max(starts, default=0):]


@dataclass(frozen=True)
class ColumnName:
    """A column name in the context of its table."""

    table: str
    column: str

    @cached_property
    def parts(self) -> dict[str, frozenset[str]]:
        """What the name may be matched by: the bare name, its core, its table's core, and keys named after the table."""
        whole, owner = bare(self.column), core(bare(self.table))
        named = {"whole": {whole}, "core": {core(whole)}, "owner": {owner}, "owner_key": {owner, owner + "id", "id" + owner}}
        return {part: frozenset(values) - {""} for part, values in named.items()}


@dataclass(frozen=True)
class NameRule:
    """The grade of two names of which ``part`` of one and ``other`` of the other agree: are equal, or, if ``within``,
    hold one another; both have ``least`` signs or more."""

    grade: float
    part: str
    other: str
    within: bool = False
    least: int = 1

    def holds(self, a: ColumnName, b: ColumnName) -> bool:
        return any(min(len(x), len(y)) >= self.least and (x == y or self.within and (x in y or y in x))
                   for x in a.parts[self.part] for y in b.parts[self.other])


# Grades of agreeing names.
NAME_RULES = (
    NameRule(1.0, "whole", "whole"),
    NameRule(0.94, "core", "core"),
    NameRule(0.86, "core", "owner", within=True),
    NameRule(0.84, "whole", "owner_key"),
    NameRule(0.62, "core", "core", within=True, least=3),
)


def name_similarity(a: ColumnName, b: ColumnName) -> float:
    """How strongly two column names suggest the same key (0 to 1): the best grade of the rules that hold either way."""
    if not (a.parts["whole"] and b.parts["whole"]):
        return 0.0
    return max((r.grade for r in NAME_RULES if r.holds(a, b) or r.holds(b, a)), default=0.0)
