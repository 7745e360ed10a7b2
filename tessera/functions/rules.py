"""Rule tables as column expressions: ordered cascades, named signals, additive scores."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def phrase_pattern(phrases: Iterable[str]) -> str:
    """A case-insensitive pattern for any of the phrases; one of letters and digits alone counts as a whole word."""
    return "(?i)" + "|".join(rf"\b{re.escape(p)}\b" if re.fullmatch(r"\w+", p) else re.escape(p) for p in phrases)


def has_any(text: Column, phrases: Iterable[str]) -> Column:
    return F.coalesce(text.rlike(phrase_pattern(phrases)), F.lit(False))


def first_match(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """The label of the first rule that holds."""
    found = F.lit(default)
    for name, condition in reversed(rules):
        found = F.when(condition, F.lit(name)).otherwise(found)
    return found


def signals(named: Mapping[str, Column]) -> Column:
    """The names whose condition holds, in order, as array<string>."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))


def weighted(weights: Sequence[tuple[Column, float]]) -> Column:
    """The weights whose condition holds, added in order."""
    total = F.lit(0.0)
    for condition, weight in weights:
        total = total + F.when(condition, F.lit(float(weight))).otherwise(F.lit(0.0))
    return total


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords that occur in the text, in their order."""
    return signals({k: has_any(text, (k,)) for k in keywords})


def keyword_score(text: Column, keywords: Sequence[str], strong: Iterable[str] = ()) -> Column:
    """2 for each strong keyword that occurs, 1 for each other."""
    strong = set(strong)
    return sum((F.when(has_any(text, (k,)), F.lit(2 if k in strong else 1)).otherwise(F.lit(0)) for k in keywords), F.lit(0))
