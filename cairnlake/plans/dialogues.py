"""Registered queries on simulated dialogues, transcripts and model replies, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import text as T
from cairnlake.operators import bm25, dialogue, transcripts
from cairnlake.operators import constraints as C
from cairnlake.operators.providers import with_embedding
from cairnlake.session import durable, table


def _simulated(spark, sf_dir, rules: dialogue.Rules) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_name", "p_type", F.regexp_replace("p_brand", "#", " "), F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("text"),
        "p_type",
        "p_brand",
        F.col("p_type").alias("category"),
    )
    items = durable(with_embedding(parts.repartition("item_id"), "text", "vector"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = lines.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
    index = bm25.build_index(items.select(F.col("item_id").alias("doc_id"), "text"))
    done = dialogue.simulate(dialogue.tasks(own, items, 1, rules.seed), items, index, rules=rules)
    return done.select("dialogue_id", "user_id", "target_id", "status", "succeed", "turns", "shown", "rounds", F.md5("transcript").alias("transcript_md5"))


def dialogue_simulation(spark, sf_dir) -> DataFrame:
    """One free dialogue of every customer about a part of theirs."""
    return _simulated(spark, sf_dir, dialogue.Rules())


def dialogue_static(spark, sf_dir) -> DataFrame:
    """The same with questions about the parts' own attributes."""
    return _simulated(spark, sf_dir, dialogue.Rules(mode="static", attributes={"p_type": "type", "p_brand": "brand"}))


def spoken(spark, sf_dir) -> DataFrame:
    """(dialogue_id, transcript) of every conversation, closed in one of six ways."""
    lines = table(spark, sf_dir, "conversations")
    said = F.concat(F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Bot: ").otherwise("System: "), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("said"))))
    title = F.coalesce(F.max(F.when(F.col("turn") == F.col("conv_id") % 2, F.regexp_extract("text", r"^(\S+ \S+)", 1))), F.lit("none"))
    held = lines.groupBy(F.col("conv_id").alias("dialogue_id")).agg(F.array_join(F.transform(ordered, lambda x: x["said"]), "\n").alias("body"), title.alias("title"))
    kind, title, item = F.col("dialogue_id") % 6, F.col("title"), F.col("dialogue_id")
    fallback = F.concat(F.lit("  System: <FALLBACK> fallbacks="), (item % 4).cast("string"), F.lit(" sites=x:1\nSystem: <FALLBACK>\n"))
    closing = (
        F.when(kind == 0, transcripts.closing_line("success", title, item))
        .when(kind == 1, transcripts.closing_line("max_rec_attempts", title, item))
        .when(kind == 2, transcripts.closing_line("max_rec_attempts", F.lit("Zq Unheard"), item))
        .when(kind == 3, transcripts.closing_line("max_total_rounds", title, item))
        .when(kind == 4, F.lit('Bot: Try "This One"\nBot: or another\nUser: no\nBot: bye'))
        .otherwise(F.concat(fallback, transcripts.closing_line("success", title, item)))
    )
    return held.select("dialogue_id", F.concat_ws("\n", "body", closing).alias("transcript"))


def outcome_classify(spark, sf_dir) -> DataFrame:
    text = F.col("transcript")
    return spoken(spark, sf_dir).select("dialogue_id", transcripts.outcome(text).alias("outcome"), F.coalesce(transcripts.closing_title(text), F.lit("")).alias("title"))


def aborted_evidence(spark, sf_dir) -> DataFrame:
    return spoken(spark, sf_dir).select("dialogue_id", transcripts.aborted_evidence(F.col("transcript")).alias("e")).select("dialogue_id", "e.*")


def transcript_lines(spark, sf_dir) -> DataFrame:
    """Lines with their speaker, who goes on speaking over lines without one."""
    return dialogue.spoken_lines(spoken(spark, sf_dir)).select("dialogue_id", F.col("line").cast("long").alias("line"), "speaker", F.md5("said").alias("said_md5"))


def parsed_utterances(spark, sf_dir) -> DataFrame:
    found = transcripts.utterances(spoken(spark, sf_dir))
    return found.select("dialogue_id", F.col("line").cast("long").alias("line"), "speaker", F.md5("said").alias("said_md5"), F.col("word_count").cast("long").alias("word_count"))


def utterances_of_sides(spark, sf_dir) -> DataFrame:
    """Utterances and words of user and bot, by the parse at the colon and by the line's beginning."""
    own = spoken(spark, sf_dir)
    parsed = transcripts.utterances(own, speakers=("Bot", "User")).select(F.lit("parsed").alias("rule"), "said")
    begun = transcripts.prefixed_lines(own).select(F.lit("prefixed").alias("rule"), "said")
    return parsed.unionAll(begun).groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.char_length("said")).alias("chars"))


def fallback_lines(spark, sf_dir) -> DataFrame:
    text = F.col("transcript")
    return spoken(spark, sf_dir).select("dialogue_id", T.fallback_count(text).cast("long").alias("fallbacks"), F.md5(T.without_fallback(text)).alias("text_md5"))


def clean_output(spark, sf_dir) -> DataFrame:
    """Lines with notes and tags put on by rule, and taken off by role."""
    noted = F.concat(F.when(F.col("turn") % 2 == 0, "[chit-chat] ").otherwise(""), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, "  (Note: likes old things) ").otherwise(" [chit-chat]"))
    role = F.when(F.col("role") == "assistant", "bot").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(T.clean_line(noted, role)).alias("clean_md5"))


def masked_documents(spark, sf_dir) -> DataFrame:
    """Every document without its credentials, whole and as a line of a log."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_secrets(text)).alias("text_md5"), T.masked(text).alias("line"))


def visible_replies(spark, sf_dir) -> DataFrame:
    """Replies with a thinking block, closed, left open or none."""
    text = F.coalesce("text", F.lit(""))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>"), text, F.lit("</think>\n "), text)).when(F.col("turn") % 3 == 1, F.concat(F.lit(" <think>"), text)).otherwise(text)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(T.visible_reply(reply)).alias("reply_md5"))


def attribute_lists(spark, sf_dir) -> DataFrame:
    """The parts' names, types and brands as replies of four shapes, read and merged by name."""
    key, name, kind = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_type")
    reply = (
        F.when(key == 0, F.concat(F.lit('["'), name, F.lit('", "'), kind, F.lit('", "'), F.regexp_replace(name, " ", "_"), F.lit('"]')))
        .when(key == 1, F.concat(F.lit("['"), name, F.lit("', '"), kind, F.lit("']")))
        .when(key == 2, F.concat(F.lit("```json\n[\""), name, F.lit('"]\n```')))
        .otherwise(F.concat(F.lit("- "), name, F.lit("\n- "), kind, F.lit("; "), F.upper(name)))
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.distinct_by_name(T.attribute_list(reply)), "|").alias("names"))


def json_replies(spark, sf_dir) -> DataFrame:
    """Judge scores from fenced, chatty and spoilt replies."""
    label = table(spark, sf_dir, "labels")
    body = F.concat(F.lit('{"Fluency": '), F.col("quality").cast("string"), F.lit(', "NOTE": "x", "content": '), F.col("toxic").cast("string"), F.lit("}"))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Sure: "), body)).otherwise("no scores")
    return label.select("doc_id", T.json_scores(reply, {"fluency": "int", "content": "int"}).alias("s")).select("doc_id", "s.fluency", "s.content")


NAMES = {"release_year": "year of release", "p_type": "kind", "genres": "movie genres", "the": "le", "original language": "x"}


def column_repair(spark, sf_dir) -> DataFrame:
    """Lines with raw column names and labels replaced too often, put right."""
    spoilt = F.concat_ws(" ", F.lit("Release_Year of the P_TYPE; movie Movie genres, average rating of the movie of the movie, year of the movie."), F.coalesce("text", F.lit("")))
    fixed = T.renamed_columns(T.repaired_labels(spoilt), T.safe_names(NAMES))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(fixed).alias("fixed_md5"), F.substring(fixed, 1, 60).alias("begin"))


def message_contexts(spark, sf_dir) -> DataFrame:
    """The last six messages up to each line, as a prompt takes them."""
    seen = transcripts.last_messages(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"], "text", 6)
    return seen.select("conv_id", "turn", "role", F.size("context").cast("long").alias("n"), F.md5(F.array_join("context", "\n")).alias("context_md5"))


def _wishes(spark, sf_dir) -> DataFrame:
    """Every line of a user, with a wish put before it by rule."""
    wishes = ["something from the 80s please, no horror.", "made in 1999 in Action, Thriller", "around 2015 but not animation or comedy. Similar to Dark City!", "from '76, something like Alien, but without romance", "nothing special", "in the style of Blade Runner or avoid sci-fi and fantasy."]
    wish = F.element_at(F.array(*map(F.lit, wishes)), (1 + F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(wishes)))).cast("int"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat_ws(" ", wish, F.coalesce("text", F.lit(""))).alias("text"))


def constraint_years(spark, sf_dir) -> DataFrame:
    low, high = C.year_range(F.col("text"))
    return _wishes(spark, sf_dir).select("conv_id", "turn", low.alias("low"), high.alias("high"))


def constraint_genres(spark, sf_dir) -> DataFrame:
    text = F.col("text")
    return _wishes(spark, sf_dir).select("conv_id", "turn", F.array_join(C.excluded_genres(text), ",").alias("excluded"), F.array_join(C.required_genres(text), ",").alias("required"))


def constraint_ref_titles(spark, sf_dir) -> DataFrame:
    return _wishes(spark, sf_dir).select("conv_id", "turn", F.array_join(C.reference_titles(F.col("text")), ";").alias("titles"))


_closing = lambda kind, title: f"'System: <{kind}> Session ended{' successfully' if kind == 'END' else ''}. The target item ''' || {title} || ''' (' || conv_id || ') was "
_FAILED = "not found within the maximum recommendation attempts.'"
SPOKEN = f"""
    g AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Bot: ' ELSE 'System: ' END || coalesce(text, ''), chr(10) ORDER BY turn, role) AS body,
                 coalesce(max(CASE WHEN turn = conv_id % 2 THEN regexp_extract(text, '^(\\S+ \\S+)', 1) END), 'none') AS title FROM conversations GROUP BY conv_id),
    t AS (SELECT conv_id AS dialogue_id, body || chr(10) || CASE conv_id % 6
            WHEN 0 THEN {_closing('END', 'title')}accepted by the user.'
            WHEN 1 THEN {_closing('FAILED', 'title')}{_FAILED}
            WHEN 2 THEN {_closing('FAILED', "'Zq Unheard'")}{_FAILED}
            WHEN 3 THEN {_closing('FAILED', 'title')}not found before the dialogue round limit (max_total_rounds) was reached.'
            WHEN 4 THEN 'Bot: Try "This One"' || chr(10) || 'Bot: or another' || chr(10) || 'User: no' || chr(10) || 'Bot: bye'
            ELSE '  System: <FALLBACK> fallbacks=' || conv_id % 4 || ' sites=x:1' || chr(10) || 'System: <FALLBACK>' || chr(10) || {_closing('END', 'title')}accepted by the user.' END AS transcript FROM g),
    e AS (SELECT dialogue_id, unnest(string_split(transcript, chr(10))) AS raw, generate_subscripts(string_split(transcript, chr(10)), 1) - 1 AS line FROM t),
    b AS (SELECT *, regexp_matches(raw, '^(Bot|User|System):') AS begins FROM e),
    p AS (SELECT *, sum(begins::INT) OVER (PARTITION BY dialogue_id ORDER BY line) AS part FROM b),
    bots AS (SELECT dialogue_id, part, string_agg(trim(CASE WHEN begins THEN raw[5:] ELSE raw END), ' ' ORDER BY line) AS said FROM p GROUP BY dialogue_id, part HAVING bool_or(begins AND starts_with(raw, 'Bot:')))"""
_any = "|".join(transcripts.ENDINGS.values()).replace("'", "''")
_ends = {k: v.replace("'", "''") for k, v in transcripts.ENDINGS.items()}
_negative, _reference = (p.replace("'", "''") for p in (C.NEGATIVE, C.REFERENCE))
_vocab = lambda names: ", ".join(f"('{k}', '{v}')" for k, v in names.items())
WISHES = """w AS (SELECT conv_id, turn, ['something from the 80s please, no horror.', 'made in 1999 in Action, Thriller', 'around 2015 but not animation or comedy. Similar to Dark City!', 'from ''76, something like Alien, but without romance', 'nothing special', 'in the style of Blade Runner or avoid sci-fi and fantasy.'][1 + (conv_id + turn) % 6] || ' ' || coalesce(text, '') AS text FROM conversations WHERE role = 'user')"""
_mask = "regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\\bbearer\\s+[^\\s''\",;]+', 'Bearer ***', 'g'), '(?i)\\b(api[-_]?key|access[-_]?token|token|authorization|key)\\b(\\s*[=:]\\s*)[^\\s''\",;&]+', '\\1\\2***', 'g'), '\\bsk-[A-Za-z0-9_\\-]{{6,}}', 'sk-***', 'g')"
_line = _mask.format("trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))")
_spoilt = "'Release_Year of the P_TYPE; movie Movie genres, average rating of the movie of the movie, year of the movie. ' || coalesce(text, '')"

QUERIES = {
    "dialogue_simulation": (dialogue_simulation, None),
    "dialogue_static": (dialogue_static, None),
    "outcome_classify": (outcome_classify, f"WITH {SPOKEN}, c AS (SELECT dialogue_id, arg_min(raw, line) AS last FROM e WHERE starts_with(raw, 'System:') AND regexp_matches(raw, '{_any}') GROUP BY dialogue_id), x AS (SELECT t.dialogue_id, last, coalesce(regexp_extract(last, 'The target item ''(.*)'' \\(', 1), '') AS title FROM t LEFT JOIN c USING (dialogue_id)), s AS (SELECT x.dialogue_id, bool_or(contains(lower(said), lower(title))) AS shown FROM x JOIN bots USING (dialogue_id) GROUP BY ALL) SELECT dialogue_id, CASE WHEN last IS NULL THEN 'incomplete' WHEN regexp_matches(last, '{_ends['success']}') THEN 'success' WHEN regexp_matches(last, '{_ends['max_total_rounds']}') THEN 'max_total_rounds' WHEN shown THEN 'max_rec_attempts:target_rejected' ELSE 'max_rec_attempts:target_not_shown' END AS outcome, title FROM x LEFT JOIN s USING (dialogue_id)"),
    "aborted_evidence": (aborted_evidence, f"WITH {SPOKEN}, q AS (SELECT dialogue_id, regexp_matches(said, '\"[^\"]+\"') AS q, row_number() OVER (PARTITION BY dialogue_id ORDER BY part) AS i, count(*) OVER (PARTITION BY dialogue_id) AS n FROM bots), a AS (SELECT dialogue_id, max(n) AS n, count_if(q) AS quoted, max(n) - coalesce(max(CASE WHEN q THEN i END), 0) AS behind FROM q GROUP BY dialogue_id), u AS (SELECT dialogue_id, count_if(starts_with(raw, 'User:')) AS users FROM e GROUP BY dialogue_id) SELECT dialogue_id, coalesce(n, 0)::INT AS bot_turns, users::INT AS user_turns, coalesce(quoted, 0)::INT AS turns_with_quoted_title, coalesce(behind, 0)::INT AS trailing_bot_turns_without_title FROM u LEFT JOIN a USING (dialogue_id)"),
    "transcript_lines": (transcript_lines, f"WITH {SPOKEN}, k AS (SELECT * FROM e WHERE trim(raw) <> '' AND raw NOT LIKE '- %' AND ltrim(raw) NOT LIKE 'System: <FALLBACK>%') SELECT dialogue_id, line::BIGINT AS line, last_value(nullif(regexp_extract(raw, '^(\\w+): ', 1), '') IGNORE NULLS) OVER (PARTITION BY dialogue_id ORDER BY line) AS speaker, md5(regexp_replace(raw, '^\\w+: ', '')) AS said_md5 FROM k"),
    "parsed_utterances": (parsed_utterances, f"WITH {SPOKEN}, k AS (SELECT dialogue_id, line, trim(raw) AS raw FROM e), m AS (SELECT dialogue_id, line, trim(raw[:position(': ' IN raw) - 1]) AS speaker, trim(raw[position(': ' IN raw) + 2:]) AS said FROM k WHERE raw <> '' AND raw NOT LIKE '- %' AND raw NOT LIKE 'System: <FALLBACK>%' AND contains(raw, ': ')) SELECT dialogue_id, line::BIGINT AS line, speaker, md5(said) AS said_md5, len(regexp_extract_all(said, '\\S+')) AS word_count FROM m"),
    "utterances_of_sides": (utterances_of_sides, f"WITH {SPOKEN}, k AS (SELECT trim(raw) AS raw FROM e), m AS (SELECT 'parsed' AS rule, trim(raw[position(': ' IN raw) + 2:]) AS said FROM k WHERE raw <> '' AND raw NOT LIKE '- %' AND raw NOT LIKE 'System: <FALLBACK>%' AND contains(raw, ': ') AND trim(raw[:position(': ' IN raw) - 1]) IN ('Bot', 'User') UNION ALL SELECT 'prefixed', trim(regexp_extract(raw, '^(?:Bot|User):(.*)', 1)) FROM k WHERE trim(regexp_extract(raw, '^(?:Bot|User):(.*)', 1)) <> '') SELECT rule, count(*) AS n, sum(length(said))::BIGINT AS chars FROM m GROUP BY rule"),
    "fallback_lines": (fallback_lines, f"WITH {SPOKEN}, f AS (SELECT dialogue_id, sum(CASE WHEN ltrim(raw) LIKE 'System: <FALLBACK>%' THEN coalesce(try_cast(nullif(regexp_extract(raw, '\\bfallbacks=(\\d+)', 1), '') AS BIGINT), 1) ELSE 0 END)::BIGINT AS fallbacks, string_agg(raw, chr(10) ORDER BY line) FILTER (ltrim(raw) NOT LIKE 'System: <FALLBACK>%') AS kept FROM e GROUP BY dialogue_id) SELECT dialogue_id, fallbacks, md5(kept) AS text_md5 FROM f"),
    "clean_output": (clean_output, r"WITH n AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN '[chit-chat] ' ELSE '' END || coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN '  (Note: likes old things) ' ELSE ' [chit-chat]' END AS x FROM conversations) SELECT conv_id, turn, role, md5(CASE role WHEN 'user' THEN regexp_replace(regexp_replace(x, '\s*\(Note:[^)]*\)', '', 'g'), '^\s+|\s+$', '', 'g') WHEN 'assistant' THEN regexp_replace(x, '^\[chit-chat\]\s*', '') ELSE x END) AS clean_md5 FROM n"),
    "masked_documents": (masked_documents, f"SELECT doc_id, md5({_mask.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS text_md5, CASE WHEN length(m) <= 300 THEN m ELSE substr(m, 1, 297) || '...' END AS line FROM (SELECT doc_id, text, {_line} AS m FROM documents)"),
    "visible_replies": (visible_replies, "SELECT conv_id, turn, role, md5(CASE turn % 3 WHEN 1 THEN NULL ELSE trim(regexp_replace(coalesce(text, ''), '^\\s+', '')) END) AS reply_md5 FROM conversations"),
    "attribute_lists": (attribute_lists, "SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN p_name ELSE p_name || CASE WHEN lower(p_name) = lower(p_type) THEN '' ELSE '|' || p_type END END AS names FROM part"),
    "json_replies": (json_replies, "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN quality END::INT AS fluency, CASE WHEN doc_id % 3 < 2 THEN toxic END::INT AS content FROM labels"),
    "column_repair": (column_repair, f"WITH s AS (SELECT conv_id, turn, role, {_spoilt} AS x FROM conversations), r AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(regexp_replace(x, '(?i)\\b(?:movie\\s+){{1,}}genres\\b', 'genres', 'g'), '(?i)\\baverage\\s+rating(?:\\s+of\\s+the\\s+movie)+\\b', 'rating', 'g'), '(?i)\\byear(?:\\s+of\\s+the\\s+movie)+\\b', 'release year', 'g') AS x FROM s), f AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(x, '(?i)\\brelease_year\\b', 'year of release', 'g'), '(?i)\\bp_type\\b', 'kind', 'g') AS x FROM r), l AS (SELECT conv_id, turn, role, regexp_replace(x, '(?i)\\bthe\\b', 'le', 'g') AS x FROM f) SELECT conv_id, turn, role, md5(x) AS fixed_md5, substr(x, 1, 60) AS begin FROM l"),
    "message_contexts": (message_contexts, "SELECT conv_id, turn, role, count(*) OVER w AS n, md5(string_agg(coalesce(text, ''), chr(10)) OVER w) AS context_md5 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"),
    "constraint_years": (constraint_years, f"WITH {WISHES}, m AS (SELECT conv_id, turn, try_cast(nullif(regexp_extract(text, '{C.DECADE}', 1), '') AS INT) AS d, try_cast(nullif(regexp_extract(text, '{C.YEAR}', 1), '') AS INT) AS y, try_cast(nullif(regexp_extract(text, '{C.SHORT_YEAR.replace(chr(39), chr(39) * 2)}', 1), '') AS INT) AS h FROM w), c AS (SELECT *, coalesce(y, CASE WHEN h >= 30 THEN 1900 + h ELSE 2000 + h END) AS mid FROM m) SELECT conv_id, turn, CASE WHEN d IS NOT NULL THEN 1900 + d ELSE mid - 2 END AS low, CASE WHEN d IS NOT NULL THEN 1909 + d ELSE mid + 2 END AS high FROM c"),
    "constraint_genres": (constraint_genres, f"WITH {WISHES}, n AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{_negative}', 1)) AS p FROM w), ex AS (SELECT conv_id, turn, string_agg(DISTINCT v, ',' ORDER BY v) AS excluded FROM n, (VALUES {_vocab(C.EXCLUDED)}) t(k, v) WHERE contains(lower(trim(p)), k) GROUP BY ALL), re AS (SELECT conv_id, turn, string_agg(DISTINCT v, ',' ORDER BY v) AS required FROM w, (VALUES {_vocab(C.REQUIRED)}) t(k, v) WHERE contains(lower(regexp_extract(text, '{C.POSITIVE}', 1)), k) GROUP BY ALL) SELECT conv_id, turn, coalesce(excluded, '') AS excluded, coalesce(required, '') AS required FROM w LEFT JOIN ex USING (conv_id, turn) LEFT JOIN re USING (conv_id, turn)"),
    "constraint_ref_titles": (constraint_ref_titles, f"WITH {WISHES} SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '{_reference}', 1), lambda x: trim(x)), ';') AS titles FROM w"),
}
