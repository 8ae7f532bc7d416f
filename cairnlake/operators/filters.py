"""Structural filters on items, applied before any ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import category_tokens


def not_excluded(item_id: Column, excluded: Column) -> Column:
    """Ids are compared as text; a null list excludes nothing, and the empty id is an id."""
    return ~F.coalesce(F.array_contains(excluded, item_id.cast("string")), F.lit(False))


def no_excluded_genre(category: Column, genres: Column) -> Column:
    """False if any word of any listed genre is a word of the category."""
    listed = F.flatten(F.transform(F.coalesce(genres, F.array().cast("array<string>")), category_tokens))
    return ~F.coalesce(F.arrays_overlap(category_tokens(category), listed), F.lit(False))


def any_required_genre(category: Column, genres: Column) -> Column:
    """True if the words of one genre stand in the category one after the other, or no list is given."""
    tokens = F.concat(F.lit(" "), F.array_join(category_tokens(category), " "), F.lit(" "))
    phrase = lambda g: F.array_join(category_tokens(g), " ")
    return genres.isNull() | F.exists(F.coalesce(genres, F.array().cast("array<string>")), lambda g: (phrase(g) != "") & F.contains(tokens, F.concat(F.lit(" "), phrase(g), F.lit(" "))))


def in_years(year: Column, low: Column, high: Column) -> Column:
    """A null bound is open; a null year is in no range unless both bounds are null."""
    bounded = year.isNotNull() & (low.isNull() | (year >= low)) & (high.isNull() | (year <= high))
    return (low.isNull() & high.isNull()) | F.coalesce(bounded, F.lit(False))


def admitted(items: DataFrame, item_id: str = "item_id", category: str = "category", year: str = "year", **given: Column) -> Column:
    """All filters on ``items``; ``given`` holds excluded, genres, required, low and high as columns.

    Without a year column nothing lies in a year range; without a category column the genre filters do nothing.
    """
    null = F.lit(None)
    out = not_excluded(F.col(item_id), given.get("excluded", null.cast("array<string>")))
    if category in items.columns:
        out &= no_excluded_genre(F.col(category), given.get("genres", null.cast("array<string>")))
        out &= any_required_genre(F.col(category), given.get("required", null.cast("array<string>")))
    low, high = given.get("low", null), given.get("high", null)
    return out & (in_years(F.col(year), low, high) if year in items.columns else low.isNull() & high.isNull())


def empty_reasons(items: DataFrame, low: int | None, high: int | None, required: list[str] | None) -> DataFrame:
    """(reason, hits) of the year and genre filters, each tested by itself; 0 hits explain an empty result."""
    years = F.count_if(in_years(F.col("year"), F.lit(low).cast("double"), F.lit(high).cast("double")))
    genres = F.count_if(any_required_genre(F.col("category"), F.array(*map(F.lit, required)) if required is not None else F.lit(None).cast("array<string>")))
    seen = items.agg(years.alias("year_range"), genres.alias("require_any_genre"))
    return seen.unpivot([], ["year_range", "require_any_genre"], "reason", "hits")


def liked(ratings: DataFrame, threshold: float = 3) -> DataFrame:
    return ratings.where(F.col("rating") > threshold)


def recent(ratings: DataFrame, asof: Column, days: int = 30) -> DataFrame:
    return ratings.where(F.col("ts") >= asof - F.make_interval(days=F.lit(days)))


def usable_ids(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose id is neither null nor blank nor ``nan``."""
    return rows.where(F.col(column).isNotNull() & ~F.lower(F.trim(F.col(column).cast("string"))).isin("", "nan"))


def near_length(rows: DataFrame, column: str, low: int, high: int, least_rows: int, slack: int = 2, cap: int | None = None) -> DataFrame:
    """Rows within the range widened by ``slack`` (from 1 on, up to ``cap``); if these are under ``least_rows``, all up to the cap.

    Without a cap, and if even those are under ``least_rows``, all rows. Rows with a null are in none but the last.
    """
    top = high + slack if cap is None else min(high + slack, cap)
    inside = F.col(column).between(max(1, low - slack), top)
    below = F.col(column).isNotNull() if cap is None else F.col(column) <= cap
    n = rows.agg(F.count_if(inside).alias("inside"), F.count_if(below).alias("below")).first()
    return rows.where(inside) if n["inside"] >= least_rows else rows.where(below) if n["below"] >= least_rows else rows


def empty_filters(items: DataFrame, low: Column, high: Column, required: Column) -> DataFrame:
    """(reason, value, column) of the filters that no item can pass whatever the others do: a missing column or no hit.

    The genre reason looks at the filter's own hits, not at those that the years leave.
    """
    null = F.lit(None).cast("string")
    have_year, have_category = "year" in items.columns, "category" in items.columns
    years = F.count_if(in_years(F.col("year"), low, high)) if have_year else F.lit(0)
    genres = F.count_if(any_required_genre(F.col("category"), required)) if have_category else F.lit(1)
    value = F.concat_ws("-", F.coalesce(low.cast("int").cast("string"), F.lit("")), F.coalesce(high.cast("int").cast("string"), F.lit("")))
    seen = items.agg(years.alias("__y"), genres.alias("__g"), F.count("*").alias("__n"))
    year = F.when((low.isNotNull() | high.isNotNull()) & (F.col("__y") == 0), F.struct(F.lit("year_range").alias("reason"), value.alias("value"), F.lit("year").alias("column")))
    genre = F.when(required.isNotNull() & (F.col("__g") == 0), F.struct(F.lit("require_any_genre").alias("reason"), F.coalesce(F.array_join(required, ","), null).alias("value"), F.lit("category").alias("column")))
    return seen.select(F.explode(F.filter(F.array(year, genre), lambda x: x.isNotNull())).alias("r")).select("r.*")
