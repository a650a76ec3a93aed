"""The `es` collation: texts that differ in case or accents only are equal."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case letters of all scripts that are one letter with combining marks, and those letters."""
    marked: dict[str, str] = {}
    for code in range(0xC0, 0x20000):
        if unicodedata.decomposition(chr(code))[:1] in ("", "<"):
            continue
        for low in {chr(code), chr(code).lower()}:
            base = "".join(c for c in unicodedata.normalize("NFD", low.lower()) if not unicodedata.category(c).startswith("M"))
            if len(low) == len(base) == 1 and base != low == low.lower():
                marked[low] = base
    return "".join(marked), "".join(marked.values())


MARKED, PLAIN = _accents()


def fold_sql(expression: str) -> str:
    """SQL of the folded text: lower case, no combining marks, no accents. Built-in functions only."""
    return f"translate(regexp_replace(lower({expression}), '\\\\p{{M}}+', ''), '{MARKED}', '{PLAIN}')"


def fold(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.translate(F.regexp_replace(F.lower(column), r"\p{M}+", ""), MARKED, PLAIN)
