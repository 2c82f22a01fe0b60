"""The search query language: text, key:value filters and NOT; compiled to column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Only A-Z: terms of other scripts are folded when they are analysed.
_LOWER = {i: i + 32 for i in range(65, 91)}
KINDS = ("content_type", "domain", "size", "intitle")
# fixed values: bytes of a size unit
UNITS = {"": 1, "b": 1, "byte": 1, "k": 1000, "ki": 1024, "m": 1000**2, "mi": 1024**2, "g": 1000**3, "gi": 1024**3}
_SIZE = re.compile(r"([><])([.0-9]+)([GBKMibyte]+)?", re.I)


@dataclass
class Filter:
    kind: str
    value: str
    negate: bool = False


@dataclass
class Query:
    text: str = ""
    filters: list[Filter] = field(default_factory=list)

    @property
    def titles(self) -> list[Filter]:
        return [f for f in self.filters if f.kind == "intitle"]


def unit_bytes(unit: str) -> int | None:
    unit = unit.lower()
    if len(unit) > 1 and unit.endswith("b"):
        unit = unit[:-1]
    return UNITS.get(unit)


def parse_size(value: str) -> tuple[str, float] | None:
    """('<' or '>', bytes), or None for what is not a size."""
    m = _SIZE.fullmatch(value)
    unit = unit_bytes(m[3] or "") if m else None
    try:
        return (m[1], float(m[2]) * unit) if unit else None
    except ValueError:
        return None


def parse_query(query: str) -> Query:
    """NOT negates a filter right after it and is text elsewhere; bad sizes are dropped."""
    out, words = Query(), []
    negate = None
    for token in query.split(" "):
        if not token:
            continue
        kind, colon, value = token.partition(":")
        if colon and kind in KINDS and value:
            if kind != "size" or parse_size(value):
                out.filters.append(Filter(kind, value, negate is not None))
            negate = None
            continue
        if negate is not None:
            words.append(negate)
            negate = None
        if token in ("NOT", "not"):
            negate = token
        else:
            words.append(token)
    if negate is not None:
        words.append(negate)
    out.text = " ".join(words).translate(_LOWER)
    return out


def filter_column(filters: list[Filter], title_match=None) -> Column:
    """Filters of one kind are alternatives, kinds must all hold. Sizes need a size above 0; a negated size flips its sign."""

    def one(f: Filter) -> Column:
        if f.kind == "size":
            sign, size = parse_size(f.value)
            above = (sign == ">") != f.negate
            return (F.col("size") > 0) & (F.col("size") > size if above else F.col("size") < size)
        if f.kind == "domain":
            hit = F.col("domain_name") == f.value
        elif f.kind == "content_type":
            hit = (F.coalesce("content_type", F.lit("")) != "") & F.startswith(F.col("content_type"), F.lit(f.value))
        else:
            hit = title_match(f.value) if title_match else F.array_contains(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), f.value.lower())
        return ~hit if f.negate else hit

    groups = [reduce(or_, [one(f) for f in filters if f.kind == k]) for k in KINDS if any(f.kind == k for f in filters)]
    return reduce(and_, groups) if groups else F.lit(True)


def page_number(segment: str | None) -> int:
    """The page that a path's last part names; 1 for anything else and for 0."""
    return max(1, int(segment)) if segment and segment.isdigit() else 1
