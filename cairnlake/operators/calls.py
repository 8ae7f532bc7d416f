"""Call sites of a text model over columns: a prompt from each row, the reply read, and a fallback where a call fails."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import attribute_list, distinct_by_name, json_scores, nested_scores, present, quality_band, visible_reply
from cairnlake.operators.providers import TextProvider, with_text


@dataclass(frozen=True)
class Site:
    """A place that asks the model: its name, and a prompt with ``{column}`` where a column's text goes."""

    name: str
    prompt: str


EXPAND = Site("expand_query", "Expand this wish into 15 to 20 search keywords, parted by commas: {text}")
DESCRIBE = Site("describe_chat", "Describe in a sentence what the user of this chat wants: {chat}")
TITLE = Site("title_of_chat", "Name the item that this chat is about, the title only: {chat}")
ATTRIBUTES = Site("propose_attributes", "Which attributes of {category} should one ask about? Answer with a JSON array of names.")
VALUE = Site("attribute_value", 'What is the {attribute} in this description? Answer {{"value": ...}}. {details}')
SUMMARY = Site("profile_summary", "Summarise the taste behind these ratings in a paragraph: {ratings}")
JUDGE = Site("judge", "Grade this dialogue from 1 to 5 for fluency, informativeness and coherence, as JSON. {dialogue}")


def ask(rows: DataFrame, site: Site, make: Callable[[], TextProvider], name: str = "reply", on_error: str = "fallback") -> DataFrame:
    """``rows`` with the reply of each row's prompt, and ``<name>_call``: (site, error_type, used_fallback).

    A null column counts as empty in the prompt. The reply is null where the call failed, was blank or never closed its thinking.
    """
    pieces = re.split(r"(\{\w+\})", site.prompt)
    parts = [F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if re.fullmatch(r"\{\w+\}", p) else F.lit(p.replace("{{", "{").replace("}}", "}")) for p in pieces if p]
    asked = with_text(rows.withColumn("__prompt", F.concat(*parts)), "__prompt", "__answer", make, on_error)
    shown = F.trim(visible_reply(F.col("__answer.value")))
    call = F.struct(F.lit(site.name).alias("site"), F.col("__answer.error_type").alias("error_type"), F.col("__answer.used_fallback").alias("used_fallback"))
    reply = F.when(~F.col("__answer.used_fallback") & (shown != ""), shown)
    return asked.withColumns({name: reply, f"{name}_call": call}).drop("__prompt", "__answer")


def call_log(*asked: DataFrame) -> DataFrame:
    """(site, error_type, used_fallback), a row for each call of several tables of :func:`ask`."""
    logs = [d.select(F.col(f"`{c}`.*")) for d in asked for c in d.columns if c.endswith("_call")]
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more)
    return out


def expanded_query(rows: DataFrame, make: Callable[[], TextProvider]) -> DataFrame:
    """``rows`` (text, ...) with query: the text and the keywords behind it, or the text alone."""
    return ask(rows, EXPAND, make).withColumn("query", F.concat_ws(" ", "text", "reply")).drop("reply")


def described_chat(rows: DataFrame, make: Callable[[], TextProvider]) -> DataFrame:
    """``rows`` (chat, user_text, ...) with description: the model's, or what the user has said."""
    return ask(rows, DESCRIBE, make).withColumn("description", F.coalesce("reply", "user_text")).drop("reply")


def titled_chat(rows: DataFrame, make: Callable[[], TextProvider], unknown: str = "item") -> DataFrame:
    """``rows`` (chat, ...) with title: the reply without quotes, or ``unknown``."""
    return ask(rows, TITLE, make).withColumn("title", F.coalesce(F.regexp_replace("reply", r"^[\"']+|[\"']+$", ""), F.lit(unknown))).drop("reply")


def proposed_attributes(rows: DataFrame, configured: list[str], default: list[str], make: Callable[[], TextProvider]) -> DataFrame:
    """``rows`` (category, ...) with asks: the proposals (``default`` if there are none), then the configured ones, once each.

    ``details`` is never among them; names that differ only in case, ``_`` and ``-`` are one.
    """
    strings = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    asked = ask(rows, ATTRIBUTES, make)
    proposed = F.coalesce(F.when(F.size(attribute_list(F.col("reply"))) > 0, attribute_list(F.col("reply"))), strings(default))
    every = distinct_by_name(F.concat(proposed, strings(configured)))
    return asked.withColumn("asks", F.filter(every, lambda a: ~F.lower(F.replace(a, F.lit("_"), F.lit(" "))).isin("detail", "details"))).drop("reply")


def attribute_value(rows: DataFrame, known: Column, make: Callable[[], TextProvider]) -> DataFrame:
    """``rows`` (attribute, details, ...) with value: the structured one where it is present, else the model's, else null.

    Only rows without a structured value are asked; a reply that is no JSON and holds none gives no value.
    """
    own = rows.withColumn("__known", F.when(present(known), F.trim(known.cast("string"))))
    asked = ask(own.where("__known IS NULL"), VALUE, make)
    found = json_scores(F.col("reply"), {"value": "string"})["value"]
    read = F.when(~F.lower(F.trim(found)).isin("none", "null", "not mentioned", ""), F.trim(found))
    told = own.where("__known IS NOT NULL").select(*rows.columns, F.col("__known").alias("value"))
    return told.unionByName(asked.select(*rows.columns, read.alias("value")))


def summarised_profiles(rows: DataFrame, make: Callable[[], TextProvider]) -> DataFrame:
    """``rows`` (user, ratings, ...) with summary and failed; a profile without ratings is empty and asks nothing."""
    some = ask(rows.where("ratings <> ''"), SUMMARY, make)
    done = some.select(*rows.columns, F.col("reply").alias("summary"), F.col("reply").isNull().alias("failed"))
    return done.unionByName(rows.where("ratings IS NULL OR ratings = ''").select(*rows.columns, F.lit("").alias("summary"), F.lit(False).alias("failed")))


def overall(scores: list[Column], digits: int = 2) -> Column:
    """Mean of the scores, rounded."""
    total = scores[0]
    for more in scores[1:]:
        total = total + more
    return F.round(total / len(scores), digits)


def judged(rows: DataFrame, make: Callable[[], TextProvider], digits: int = 2) -> DataFrame:
    """``rows`` (dialogue, ...) with fluency, informativeness, coherence, overall_score and overall_quality; null where unreadable."""
    names = ("fluency", "informativeness", "coherence")
    read = ask(rows, JUDGE, make).withColumn("__s", json_scores(F.col("reply"), dict.fromkeys(names, "double")))
    out = read.withColumns({n: F.col(f"__s.{n}") for n in names}).drop("__s", "reply")
    score = overall([F.col(n) for n in names], digits)
    return out.withColumn("overall_score", score).withColumn("overall_quality", F.when(F.col("overall_score").isNotNull(), quality_band(F.col("overall_score"))))


ASPECTS = ("fluency", "informativeness", "coherence")


def evaluated(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """``rows`` with the evaluator's three aspects from its nested reply, their mean to one digit and its band.

    A reply in which any aspect can't be read has neither mean nor band.
    """
    read = rows.withColumn("__s", nested_scores(F.col(reply), ASPECTS))
    out = read.withColumns({n: F.col(f"__s.{n}") for n in ASPECTS}).drop("__s")
    return out.withColumn("overall_score", overall([F.col(n) for n in ASPECTS], 1)).withColumn("overall_quality", quality_band(F.col("overall_score")))
