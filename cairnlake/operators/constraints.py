"""Search constraints in free text: years, genres and reference titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What genre words stand for, when excluded and when required.
EXCLUDED = {"horror": "Horror", "sci-fi": "Science Fiction", "science fiction": "Science Fiction", "animation": "Animation", "animated": "Animation", "musical": "Music", "western": "Western", "documentary": "Documentary", "romance": "Romance", "comedy": "Comedy", "drama": "Drama", "thriller": "Thriller", "action": "Action", "fantasy": "Fantasy", "family": "Family"}
REQUIRED = {k: v for k, v in EXCLUDED.items() if k != "musical"} | {"adventure": "Adventure", "crime": "Crime", "mystery": "Mystery"}
#: The patterns of each constraint.
DECADE = r"(?i)\b(?:19)?([4-9]0)s\b"
YEAR = r"\b(19[5-9]\d|20[0-2]\d)\b"
SHORT_YEAR = r"'([5-9]\d|[01]\d)\b"
NEGATIVE = r"(?i)\b(?:no|not|without|avoid|don'?t want|except|rather not)\s+([\w\s\-]+?)(?:\s*,|\s+or\b|\s+and\b|\.|\!|\?|$)"
POSITIVE = r"\bin\s+((?:[A-Z][a-z]+(?:,\s*)?)+)"
REFERENCE = r"""(?m)\b(?:like|similar to|in the style of|reminiscent of)\s+["']?([A-Z][A-Za-z0-9 ':,\-]+?)["']?(?:\s*[\.,\?!]|\s+but\b|\s+or\b|\s*$)"""


def year_range(text: Column) -> tuple[Column, Column]:
    """(low, high): the decade if one is named, else two years about a year, else about a short year; null without either."""
    decade, year, short = (F.regexp_extract(text, p, 1).try_cast("int") for p in (DECADE, YEAR, SHORT_YEAR))
    middle = F.coalesce(year, F.when(short >= 30, 1900 + short).otherwise(2000 + short))
    return F.when(decade.isNotNull(), 1900 + decade).otherwise(middle - 2), F.when(decade.isNotNull(), 1909 + decade).otherwise(middle + 2)


def _named(phrases: Column, table: dict[str, str]) -> Column:
    names = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in table.items()))
    held = lambda ps: F.filter(names, lambda e: F.exists(ps, lambda p: F.contains(p, e["key"])))
    found = F.get(F.transform(F.array(phrases), held), 0)  # bound as a variable, so that the phrases are cut once, not once a name
    return F.array_sort(F.array_distinct(F.transform(found, lambda e: e["value"])))


def excluded_genres(text: Column) -> Column:
    """Sorted genres whose word occurs in a phrase after a negation."""
    return _named(F.transform(F.regexp_extract_all(text, F.lit(NEGATIVE), 1), lambda p: F.lower(F.trim(p))), EXCLUDED)


def required_genres(text: Column) -> Column:
    """Sorted genres of the first capitalised list after ``in``."""
    return _named(F.array(F.lower(F.regexp_extract(text, POSITIVE, 1))), REQUIRED)


def reference_titles(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 1), F.trim)
