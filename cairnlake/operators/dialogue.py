"""Recommendation dialogues as rounds over a table of states: one batched retrieval a round for all open dialogues."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import category_tokens, present
from cairnlake.operators import bm25, constraints, hybrid, knn, sampling
from cairnlake.operators.providers import with_embedding
from cairnlake.operators.transcripts import closing_line
from cairnlake.session import discard, durable

#: Phrases of both sides; one is drawn for each turn by the dialogue and the round.
GREETINGS = ["Hello! What are you looking for?", "Hi, what can I find for you?", "Welcome. What shall it be today?"]
QUESTIONS = ["Could you tell me more about what you want?", "What else should it be like?", "Any other details?", "What matters most to you?"]
OFFERS = ["How about \"{}\"?", "You might like \"{}\".", "My choice for you is \"{}\"."]
REFUSALS = ["No, that is not it.", "Not what I had in mind.", "I would rather see another one."]
SMALL_TALK = ["Nice talking to you!", "Good to know.", "That sounds lovely."]
NO_PREFERENCE = "I have no preference."


@dataclass(frozen=True)
class Rules:
    """Limits and manners of a dialogue.

    ``mode`` is free (open questions, the user tells words of the target's text), static (questions about ``attributes`` in
    their order) or adaptive (about the attributes that each dialogue's column ``asks`` lists, then those of ``attributes``
    that it lacks). ``attributes`` maps columns of the items to the labels they are asked by.
    """

    mode: str = "free"
    max_questions: int = 3
    max_shown: int = 6
    max_rounds: int = 30
    words_per_answer: int = 4
    shown_at_once: int = 1
    small_talk: float = 0.0
    attributes: dict[str, str] = field(default_factory=dict)
    seed: int = 2025


def tasks(users: DataFrame, items: DataFrame, per_user: int, seed: int) -> DataFrame:
    """(dialogue_id, user_id, target_id): ``per_user`` random items of each user's own (user_id, item_id)."""
    own = users.select("user_id", "item_id").join(items.select("item_id"), "item_id", "left_semi").repartition("user_id")
    order = Window.partitionBy("user_id").orderBy(sampling.ticket(seed, F.col("user_id"), F.col("item_id")), "item_id")
    # a pair that repeats has one rank, so only the chosen ones are made distinct
    chosen = own.withColumn("__n", F.dense_rank().over(order)).where(F.col("__n") <= per_user).select("user_id", "item_id").distinct()
    return chosen.select(F.md5(F.concat_ws(":", "user_id", "item_id")).alias("dialogue_id"), "user_id", F.col("item_id").alias("target_id"))


def answer(target_text: Column, round_no: int, rules: Rules) -> Column:
    """The next few words of the target's description."""
    words = F.split(target_text, r"\s+")
    return F.array_join(F.slice(words, 1 + (round_no - 1) * rules.words_per_answer, rules.words_per_answer), " ")


def admits(queries: pd.DataFrame, items: pd.DataFrame) -> np.ndarray:
    """Pairs that the constraints of a query allow, for :func:`cairnlake.operators.knn.nearest`.

    queries: low, high (years), excluded (genre words), required (genre phrases) and excluded_ids; items: year, genre_words.
    A genre is required as consecutive words, excluded by any word; an item without a year is in no range.
    """
    year = items["year"].to_numpy(float)
    ids = items["item_id"].to_numpy()
    spelt: list[str] = []
    holding: dict[str, np.ndarray] = {}

    def holds(phrase: str) -> np.ndarray:
        if phrase not in holding:
            if not spelt:
                spelt.extend(" " + " ".join(w if w is not None else ()) + " " for w in items["genre_words"])
            holding[phrase] = np.fromiter((f" {phrase} " in s for s in spelt), bool, len(spelt))
        return holding[phrase]

    out = np.ones((len(queries), len(items)), bool)
    for row, (low, high, excluded, required, gone) in enumerate(zip(*(queries[c] for c in ("low", "high", "excluded", "required", "excluded_ids")), strict=True)):
        if low == low and low is not None:
            out[row] &= (year >= low) & (year <= high)
        for word in excluded if excluded is not None else ():
            out[row] &= ~holds(word)
        if required is not None and len(required):
            out[row] &= np.logical_or.reduce([holds(p) for p in required])
        if gone is not None and len(gone):
            out[row] &= ~np.isin(ids, gone)
    return out


def _asked(state: DataFrame, round_no: int, rules: Rules) -> DataFrame:
    """The question of this round and its answer, for dialogues that have one left; a question and answer is one turn."""
    if round_no > rules.max_questions:
        return state
    pick = lambda pool: sampling.picked(pool, rules.seed, F.col("dialogue_id"), F.lit(round_no))
    if rules.mode == "free":
        ask, question, reply, fact = F.lit(True), pick(QUESTIONS), answer(F.col("target_text"), round_no, rules), F.lit(None).cast("string")
    else:
        attribute = F.get("asks", round_no - 1)
        labels = F.create_map(*(F.lit(x) for pair in rules.attributes.items() for x in pair)) if rules.attributes else F.create_map().cast("map<string,string>")
        label, value = F.coalesce(labels[attribute], attribute), F.try_element_at("target_facts", attribute)
        ask, question = attribute.isNotNull(), F.concat(F.lit("What is your preference for "), label, F.lit("?"))
        reply = F.when(value.isNull(), NO_PREFERENCE).otherwise(F.concat(F.lit("I would like "), value, F.lit(" for "), label, F.lit(".")))
        fact = F.when(value.isNotNull(), F.concat_ws(" ", label, value))
    small = F.when(sampling.happens(rules.small_talk, rules.seed + 1, F.col("dialogue_id"), F.lit(round_no)), F.concat(F.lit("[chit-chat] "), pick(SMALL_TALK), F.lit(" "))).otherwise("")
    lines = F.concat(F.lit("Bot: "), small, question, F.lit("\nUser: "), reply, F.lit("\n"))
    return state.withColumns({
        "facts": F.when(ask & fact.isNotNull(), F.array_append("facts", fact)).otherwise(F.col("facts")),
        "said": F.when(ask, F.array_append("said", reply)).otherwise(F.col("said")),
        "turns": F.col("turns") + ask.cast("int"),
        "transcript": F.when(ask, F.concat("transcript", lines)).otherwise(F.col("transcript")),
    })


def _spoken(rules: Rules) -> dict[str, Column]:
    """What the search of an open dialogue follows from: its text, the text that is parsed, exclusions and profiles.

    Free dialogues search by all the user has said, with the refusals once more behind it, and parse the same text; the
    others search by the facts collected and the refusals, and parse what the user has said.
    """
    said = F.array_join("said", " ")
    refused = F.array_join(F.transform("refusals", lambda r: F.concat(F.lit(" I do not want: "), r)), "")
    text = F.concat(said, refused) if rules.mode == "free" else F.concat(F.array_join("facts", " "), refused)
    return {"text": text, "parsed": text if rules.mode == "free" else said} | {c: F.col(c) for c in ("excluded_ids", "long_profile", "short_profile")}


def _identity(columns: dict[str, Column]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())), {"ignoreNullFields": "false"}))


def _searches(spoken: DataFrame, whole_words: bool) -> DataFrame:
    """search_id and query_id of different ``spoken``, and the search that it comes to: text, constraints, exclusions, profiles.

    Embeddings and scores are sums over words, so with ``whole_words`` (the index keeps words apart) their order is given up
    after parsing: the search is the same in whatever order the user refused.
    """
    low, high = constraints.year_range(F.col("parsed"))
    words = F.array_distinct(F.flatten(F.transform(constraints.excluded_genres(F.col("parsed")), category_tokens)))
    phrases = F.transform(constraints.required_genres(F.col("parsed")), lambda g: F.array_join(category_tokens(g), " "))
    text = F.array_join(F.array_sort(F.split("text", r"\s+")), " ") if whole_words else F.col("text")
    known = spoken.withColumn("search_id", _identity({c: F.col(c) for c in spoken.columns})).dropDuplicates(["search_id"])
    known = known.withColumns({"text": text, "low": low.cast("double"), "high": high.cast("double"), "excluded": words, "required": phrases})
    own = {c: F.col(c) for c in ("text", "low", "high", "excluded", "required", "excluded_ids", "long_profile", "short_profile")}
    return known.select("search_id", _identity(own).alias("query_id"), *own)


def simulate(dialogues: DataFrame, items: DataFrame, index: bm25.TextIndex, weights: hybrid.Weights = hybrid.Weights(threshold=0.0), rules: Rules = Rules()) -> DataFrame:
    """(dialogue_id, user_id, target_id, status, succeed, turns, shown, rounds, transcript) of each dialogue.

    dialogues: (dialogue_id, user_id, target_id), and if wanted excluded_ids (never shown), asks (attributes, adaptive mode),
    long_profile and short_profile (vectors that join the score). items: (item_id, title, text, vector), and if wanted year,
    category and the columns of ``rules.attributes``. The index must be durable: it is read in every round.

    In each round the user of every open dialogue answers a question while there are any left, the items that its
    constraints admit are searched, and the best that were not refused are shown. The user accepts if one of them bears
    the target's title and refuses otherwise. Texts are parsed once for all dialogues that have come to the same, and dialogues
    whose search is the same share one. A dialogue ends when accepted (success), after ``max_shown`` rounds that
    showed something (max_shown), or after ``max_rounds`` rounds (max_rounds); one whose target is not in the catalogue
    ends at once (target_not_found). The greeting is the first turn, each answer, each round that shows items and the
    closing of a failure are one more. A round writes the dialogues once, and those that it ends once more while others go on.
    """
    facts = F.map_filter(F.create_map(*(x for c in rules.attributes for x in (F.lit(c), F.when(present(F.col(c)), F.trim(F.col(c).cast("string")))))) if rules.attributes else F.create_map().cast("map<string,string>"), lambda _, v: v.isNotNull())
    targets = items.select(F.col("item_id").alias("target_id"), F.col("title").alias("target_title"), F.col("text").alias("target_text"), facts.alias("target_facts"))
    year = F.col("year").cast("double") if "year" in items.columns else F.lit(None).cast("double")
    genres = category_tokens(F.col("category")) if "category" in items.columns else F.array().cast("array<string>")
    catalogue = items.select("item_id", "vector", year.alias("year"), genres.alias("genre_words"))
    if "excluded_ids" not in dialogues.columns:
        catalogue = knn.alike(catalogue, 3 * weights.k)
    id_type = items.schema["item_id"].dataType.simpleString()
    none = F.array().cast("array<string>")
    listed = F.array(*map(F.lit, rules.attributes)) if rules.attributes else none
    asks = F.array_union("asks", listed) if rules.mode == "adaptive" and "asks" in dialogues.columns else listed
    given = F.col("excluded_ids") if "excluded_ids" in dialogues.columns else F.lit(None).cast(f"array<{id_type}>")
    profiles = [F.col(c) if c in dialogues.columns else F.lit(None).cast("array<double>").alias(c) for c in ("long_profile", "short_profile")]
    begun = dialogues.select("dialogue_id", "user_id", "target_id", given.alias("excluded_ids"), asks.alias("asks"), *profiles).join(targets, "target_id", "left")
    greeting = F.concat(F.lit("Bot: "), sampling.picked(GREETINGS, rules.seed, F.col("dialogue_id"), F.lit(0)), F.lit("\n"))
    begun = begun.withColumns({"said": none, "facts": none, "refusals": none, "shown": F.lit(0), "turns": F.lit(1), "rejected": F.array().cast(f"array<{id_type}>"), "transcript": greeting})
    begun = durable(begun.drop("asks", "target_facts") if rules.mode == "free" else begun.drop("target_text"))
    kept = ["dialogue_id", "user_id", "target_id", "target_title", "turns", "shown", "transcript", "status", "rounds"]
    finished = [durable(begun.where("target_title IS NULL").withColumns({"status": F.lit("target_not_found"), "rounds": F.lit(0)}).select(*kept))]
    held, round_no = begun, 0
    state = begun.where("target_title IS NOT NULL")
    spoken, whole_words = _spoken(rules), index.tokenizer != "trigram"
    counted = durable(index.term_df), durable(index.corpus)
    index = replace(index, term_df=counted[0], corpus=counted[1])
    going = not state.isEmpty()
    while going:
        round_no += 1
        asked = _asked(state, round_no, rules).withColumn("search_id", _identity(spoken))
        searches = durable(_searches(asked.select(*(c.alias(n) for n, c in spoken.items())).distinct(), whole_words))
        queries = durable(with_embedding(searches.drop("search_id").dropDuplicates(["query_id"]), "text", "vector"))
        near = hybrid.neighbours(queries, catalogue, weights, admits)
        found = hybrid.gated(hybrid.rated(index.of(near), queries, near, weights), weights.threshold)
        found = hybrid.with_profiles(found, queries, catalogue, weights) if "long_profile" in dialogues.columns else found.withColumn("score", F.col("base_score"))
        found = hybrid.ranked(found, weights.k).join(items.select("item_id", "title"), "item_id")
        lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "title"))).alias("listed"))
        listed = durable(searches.select("search_id", "query_id").join(lists, "query_id").select("search_id", "listed"))
        met = asked.join(listed, "search_id", "left")
        offer = F.slice(F.filter("listed", lambda o: ~F.array_contains("rejected", o["item_id"])), 1, rules.shown_at_once)
        met = met.withColumn("offer", offer).drop("listed", "search_id")
        seen, titles = F.coalesce(F.size("offer") > 0, F.lit(False)), F.transform("offer", lambda o: o["title"])
        met = met.withColumns({"seen": seen, "accepted": seen & F.coalesce(F.array_contains(titles, F.col("target_title")), F.lit(False))})
        seen, accepted = F.col("seen"), F.col("accepted")
        pick = lambda pool: sampling.picked(pool, rules.seed, F.col("dialogue_id"), F.lit(round_no), F.lit("offer"))  # noqa: B023, E731
        offer = F.replace(pick(OFFERS), F.lit("{}"), F.get(titles, 0)) if rules.shown_at_once == 1 else F.concat(F.lit("Here is what I found:\n"), F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), t)), "\n"))
        met = met.withColumn("reply", F.when(accepted, F.concat(F.lit("Yes, \""), "target_title", F.lit("\" is what I want."))).otherwise(pick(REFUSALS)))
        met = met.withColumns({
            "shown": F.col("shown") + seen.cast("int"),
            "turns": F.col("turns") + seen.cast("int"),
            "transcript": F.when(seen, F.concat("transcript", F.lit("Bot: "), offer, F.lit("\nUser: "), "reply", F.lit("\n"))).otherwise(F.col("transcript")),
            "said": F.when(seen, F.array_append("said", F.col("reply"))).otherwise(F.col("said")),
            "refusals": F.when(seen & ~accepted, F.array_append("refusals", F.col("reply"))).otherwise(F.col("refusals")),
            "rejected": F.when(seen & ~accepted, F.concat("rejected", F.transform("offer", lambda o: o["item_id"]))).otherwise(F.col("rejected")),
        })
        status = F.when(F.col("accepted"), "success").when(F.col("shown") >= rules.max_shown, "max_shown").when(F.lit(round_no >= rules.max_rounds), "max_rounds")
        before, held = held, durable(met.withColumns({"status": status, "rounds": F.lit(round_no)}).drop("offer", "seen", "accepted", "reply"))
        discard(before, searches, queries, near, listed)
        state = held.where("status IS NULL").drop("status", "rounds")
        ended = held.where("status IS NOT NULL").select(*kept)
        going = not state.isEmpty()
        finished.append(durable(ended) if going else ended)
    discard(catalogue, *counted)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    won, title = F.col("status") == "success", F.coalesce("target_title", F.lit(""))
    ending = F.when(won, closing_line("success", title, F.col("target_id"))).when(F.col("status") == "max_rounds", closing_line("max_total_rounds", title, F.col("target_id"))).otherwise(closing_line("max_rec_attempts", title, F.col("target_id")))
    return out.select("dialogue_id", "user_id", "target_id", "status", won.cast("int").alias("succeed"), (F.col("turns") + (~won).cast("int")).alias("turns"), "shown", "rounds", F.concat("transcript", ending).alias("transcript"))


def spoken_lines(dialogues: DataFrame, dialogue_id: str = "dialogue_id", text: str = "transcript") -> DataFrame:
    """(dialogue_id, line, speaker, said) of the lines ``Speaker: said``; blank lines, bullets and fallback marks are left out.

    Lines without a speaker go on with the one before them.
    """
    each = dialogues.select(dialogue_id, F.posexplode(F.split(text, "\n")).alias("line", "raw")).where("trim(raw) <> '' AND raw NOT LIKE '- %' AND ltrim(raw) NOT LIKE 'System: <FALLBACK>%'")
    speaker = F.regexp_extract("raw", r"^(\w+): ", 1)
    marked = each.withColumn("own", F.when(speaker != "", speaker)).withColumn("said", F.regexp_replace("raw", r"^\w+: ", ""))
    return marked.selectExpr(dialogue_id, "line", f"last_value(own, true) OVER (PARTITION BY {dialogue_id} ORDER BY line) AS speaker", "said")
