"""Transcripts of dialogues: turns, utterances, outcomes and what aborted ones show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closing lines of a dialogue, by outcome.
ENDINGS = {
    "success": r"^System: <END> Session ended successfully\. The target item '(.*)' \((.*)\) was accepted",
    "max_rec_attempts": r"^System: <FAILED> Session ended\. The target item '(.*)' \((.*)\) was not found within the maximum recommendation attempts\.",
    "max_total_rounds": r"^System: <FAILED> Session ended\. The target item '(.*)' \((.*)\) was not found before the dialogue round limit \(max_total_rounds\) was reached\.",
}


def closing_line(outcome: str, title: Column, item_id: Column) -> Column:
    """The System line that ends a dialogue with this outcome."""
    item = F.concat(F.lit("The target item '"), title, F.lit("' ("), item_id.cast("string"), F.lit(") was "))
    if outcome == "success":
        return F.concat(F.lit("System: <END> Session ended successfully. "), item, F.lit("accepted by the user."))
    rest = "within the maximum recommendation attempts." if outcome == "max_rec_attempts" else "before the dialogue round limit (max_total_rounds) was reached."
    return F.concat(F.lit("System: <FAILED> Session ended. "), item, F.lit("not found "), F.lit(rest))


def bot_turns(text: Column) -> Column:
    """The bot's turns, each with the lines that go on from it up to the next speaker, joined by spaces."""
    turns = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^Bot:([^\n]*(?:\n(?!Bot:|User:|System:)[^\n]*)*)"), 1)
    return F.transform(turns, lambda t: F.array_join(F.transform(F.split(t, "\n"), F.trim), " "))


def outcome(text: Column) -> Column:
    """success, max_rec_attempts:target_rejected or :target_not_shown, max_total_rounds, or incomplete.

    The first closing line decides; a failed target counts as rejected if its title stands in a turn of the bot, in any case.
    A null text is incomplete.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.startswith("System:"))
    first = F.get(F.filter(lines, lambda x: x.rlike("|".join(ENDINGS.values()))), 0)
    title = F.lower(F.regexp_extract(first, ENDINGS["max_rec_attempts"], 1))
    shown = F.exists(bot_turns(text), lambda t: F.contains(F.lower(t), title))
    failed = F.when(shown, "max_rec_attempts:target_rejected").otherwise("max_rec_attempts:target_not_shown")
    return F.when(first.rlike(ENDINGS["success"]), "success").when(first.rlike(ENDINGS["max_rec_attempts"]), failed).when(first.isNotNull(), "max_total_rounds").otherwise("incomplete")


def closing_title(text: Column) -> Column:
    """The target's title in the first closing line; null without one."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("|".join(ENDINGS.values())))
    return F.regexp_extract(F.get(lines, 0), r"The target item '(.*)' \(", 1)


def aborted_evidence(text: Column) -> Column:
    """bot_turns, user_turns, turns_with_quoted_title and trailing_bot_turns_without_title of a transcript."""
    turns = bot_turns(text)
    quoted = F.transform(turns, lambda t: t.rlike('"[^"]+"'))
    trailing = F.size(quoted) - F.coalesce(F.array_max(F.transform(quoted, lambda q, i: F.when(q, i + 1))), F.lit(0))
    users = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.startswith("User:")))
    return F.struct(F.size(turns).alias("bot_turns"), users.alias("user_turns"), F.size(F.filter(quoted, lambda q: q)).alias("turns_with_quoted_title"), trailing.alias("trailing_bot_turns_without_title"))


def utterances(dialogues: DataFrame, key: str = "dialogue_id", text: str = "transcript", speakers: tuple[str, ...] | None = None) -> DataFrame:
    """(key, line, speaker, said, word_count) of the lines that hold ``speaker: text``, parted at the first colon and space.

    Blank lines, list items (``- ``) and lines that report replaced calls are left out, as are lines without a speaker;
    ``speakers`` keeps those alone. Rows are independent; a null text has no lines.
    """
    each = dialogues.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    each = each.where("raw <> '' AND raw NOT LIKE '- %' AND raw NOT LIKE 'System: <FALLBACK>%' AND contains(raw, ': ')")
    at = F.locate(": ", F.col("raw"))
    out = each.select(key, "line", F.trim(F.substring("raw", F.lit(1), at - 1)).alias("speaker"), F.trim(F.substring("raw", at + 2, F.length("raw"))).alias("said"))
    out = out.withColumn("word_count", F.size(F.filter(F.split("said", r"\s+"), lambda w: w != "")))
    return out if speakers is None else out.where(F.col("speaker").isin(*speakers))


def prefixed_lines(dialogues: DataFrame, key: str = "dialogue_id", text: str = "transcript") -> DataFrame:
    """(key, line, said) of the lines that begin with ``Bot:`` or ``User:``; what stands behind the colon, where it is not blank."""
    each = dialogues.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    return each.select(key, "line", F.trim(F.regexp_extract("raw", r"^(?:Bot|User):(.*)", 1)).alias("said")).where("said <> ''")


def last_messages(rows: DataFrame, key: str, order: list[str], text: str, n: int) -> DataFrame:
    """``rows`` with context: the ``n`` messages of the key up to and with each row, oldest first.

    A window of ``n`` rows; keys are split over tasks by the window's partitioning only.
    """
    from pyspark.sql import Window

    span = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)
    return rows.withColumn("context", F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(span))
