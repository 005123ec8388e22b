"""Words `[^\\x20\\x09-\\x0D]+` as columns and in tasks; small binding helper for column lambdas."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

BLANK = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE = 5


def bind(value: Column, use) -> Column:
    """use(value) with value computed once per row; a plain reference inside a lambda is computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_array(text: Column) -> Column:
    """Words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []
