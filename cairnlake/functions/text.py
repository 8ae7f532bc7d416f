"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from cairnlake.functions.porter import stem


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


# --- tokenizers -------------------------------------------------------------------------------------------------------


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, numbers and private-use characters; underscores and marks split, accents stay."""
    return F.regexp_extract_all(F.lower(_blank(text)), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits (folded) and of characters beyond ASCII (as they are)."""
    folded = F.translate(_blank(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(r"([a-z0-9\x{80}-\x{10FFFF}]+)"), 1)


def trigram_tokens(text: Column) -> Column:
    """Every three consecutive characters, lower-cased; shorter texts have none."""
    return F.regexp_extract_all(F.lower(_blank(text)), F.lit("(?s)(?=(...))"), 1)


@F.arrow_udf(ArrayType(StringType()))
def _stems(tokens: pa.Array) -> pa.Array:
    """Porter stems of arrays of tokens. Only the distinct tokens of a batch become Python strings, and each is stemmed once."""
    coded = tokens.flatten().dictionary_encode()
    stems = pa.array([None if t is None else stem(t) for t in coded.dictionary.to_pylist()], pa.string())
    sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
    starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(starts, stems.take(coded.indices), mask=tokens.is_null())


def porter_tokens(text: Column) -> Column:
    """The default tokens, stemmed by Porter's algorithm."""
    return _stems(search_tokens(text))


#: Fixed values of Unicode word boundaries: what may stand between two letters, between two digits, and pictographs.
MID_LETTER = r":·\x{387}\x{55F}\x{5F4}\x{2027}\x{FE13}\x{FE55}\x{FF1A}"
MID_NUMBER = r",;\x{37E}\x{589}\x{60C}\x{60D}\x{66C}\x{7F8}\x{2044}\x{FE10}\x{FE14}\x{FE50}\x{FE54}\x{FF0C}\x{FF1B}"
MID_BOTH = r"'.\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"
PICTOGRAPH = (
    r"©®\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}-\x{21AA}\x{231A}-\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}-\x{25AB}\x{25B6}\x{25C0}"
    r"\x{25FB}-\x{25FE}\x{2600}-\x{27BF}\x{2934}-\x{2935}\x{2B05}-\x{2B07}\x{2B1B}-\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}"
)
KATAKANA = r"\x{30A0}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}"
IDEOGRAPH = r"\x{3040}-\x{309F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}"
LONGEST_TOKEN = 255


def word_pattern(keep: str = "+") -> str:
    """A pattern of words by Unicode's word boundaries; ``keep`` makes its repeats possessive where a dialect has that.

    Letters and digits stay together, with one mark between two letters or two digits; a connector such as ``_`` joins what
    touches it; katakana stays together; ideographs, hiragana and pictographs stand alone. Marks and format characters go with
    what they follow. A run of connectors alone is no word.
    """
    extend = rf"[\p{{M}}\p{{Cf}}]*{keep}"
    letter, digit = rf"(?:[^\P{{L}}{KATAKANA}{IDEOGRAPH}]|[^\P{{Nl}}{IDEOGRAPH}]){extend}", rf"\p{{Nd}}{extend}"
    letters = rf"{letter}(?:[{MID_LETTER}{MID_BOTH}]?{extend}{letter})*{keep}"
    digits = rf"{digit}(?:[{MID_NUMBER}{MID_BOTH}]?{extend}{digit})*{keep}"
    kana, joint = rf"(?:[{KATAKANA}]{extend})+{keep}", rf"[\p{{Pc}}\x{{202F}}]{extend}"
    body = rf"(?:(?:{letters}|{digits})+{keep}|{kana})"
    return rf"(?:{joint})*{keep}{body}(?:(?:{joint})+{keep}{body})*{keep}(?:{joint})*{keep}|[{IDEOGRAPH}{PICTOGRAPH}]{extend}"


def standard_tokens(text: Column) -> Column:
    """Lower-cased words by Unicode's word boundaries, longer ones cut every 255 characters."""
    found = F.regexp_extract_all(_blank(text), F.lit(word_pattern()), F.lit(0))
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(t) - 1) / LONGEST_TOKEN).cast("int")), lambda k: F.lower(F.substring(t, k * LONGEST_TOKEN + 1, F.lit(LONGEST_TOKEN))))
    return F.flatten(F.transform(found, cut))


#: Tokenizers by the name an index stores.
TOKENIZERS = {"unicode61": search_tokens, "ascii": ascii_tokens, "porter": porter_tokens, "trigram": trigram_tokens, "standard": standard_tokens}


def token_counts(tokens: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Equal tokens of each array, counted: parts of about ``most`` tokens as the place of their first array, the arrays' sizes, the
    different tokens, and array (in the part), token (its place among them) and number, ascending by array."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
    part = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(sizes) else np.zeros(0, int)
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)], strict=False):
        coded = tokens.slice(at, end - at).flatten().dictionary_encode()
        n = max(1, len(coded.dictionary))
        pairs, number = np.unique(np.repeat(np.arange(end - at), sizes[at:end]) * n + np.asarray(coded.indices), return_counts=True)
        yield at, sizes[at:end], coded.dictionary, pairs // n, pairs % n, number


def category_tokens(text: Column) -> Column:
    """Lower-cased words in the Unicode sense; underscores stay, apostrophes split."""
    return F.regexp_extract_all(F.lower(_blank(text)), F.lit(r"((?U)\w+)"), 1)


def metric_tokens(text: Column) -> Column:
    """Lower-cased ASCII words that no other word character touches."""
    return F.regexp_extract_all(F.lower(_blank(text)), F.lit(r"(?<![\p{L}\p{N}_])([a-z]+)(?![\p{L}\p{N}_])"), 1)


def words(text: Column) -> Column:
    """White-space separated words; a blank text has none."""
    clean = F.trim(F.regexp_replace(_blank(text), r"\s+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def contains_sequence(tokens: Column, wanted: Column) -> Column:
    """Whether ``wanted`` occurs in ``tokens`` as consecutive elements; an empty ``wanted`` never does."""
    starts = F.when((F.size(wanted) == 0) | (F.size(wanted) > F.size(tokens)), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(tokens) - F.size(wanted) + 1))
    return F.exists(starts, lambda i: F.slice(tokens, i, F.size(wanted)) == wanted)


def ngrams(tokens: Column, n: int) -> Column:
    """Consecutive ``n`` tokens, joined by spaces."""
    starts = F.when(F.size(tokens) < n, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(tokens) - n + 1))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


# --- dialogue text ----------------------------------------------------------------------------------------------------


def cut_message(text: Column, limit: int = 250) -> Column:
    """A message of at most ``limit`` characters: up to the last sentence end, else to the last space with an ellipsis."""
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    word = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.char_length(text) <= limit, text).when(sentence != "", sentence).when(word != "", F.concat(word, F.lit("…"))).otherwise(head)


def complete_sentences(text: Column) -> Column:
    """The text without its trailing ellipses, up to its last sentence end; empty if it has none."""
    clean = F.regexp_replace(_blank(text), r"(?U)\s+\z", "")
    for mark in (r"\.\.\.", "…"):
        clean = F.regexp_replace(clean, rf"(?U)\s*(?:{mark}\s*)+\z", "")
    return F.regexp_extract(clean, r"(?s)^(.*[.!?])", 1)


def visible_reply(text: Column) -> Column:
    """A reply without its leading thinking block; null if that block is never closed."""
    closed = F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>\s*", "")
    tail = F.regexp_replace(closed, r"(?s)^.*</think>\s*", "")
    return F.when(closed.rlike(r"^\s*<think>"), F.lit(None)).otherwise(F.trim(tail))


def clean_line(text: Column, role: Column, show_note: bool = False, show_tag: bool = False) -> Column:
    """A spoken line without the notes of the user's side, and without the small-talk tag that begins the bot's.

    ``show_note`` and ``show_tag`` leave them where they are.
    """
    user = text if show_note else F.regexp_replace(F.regexp_replace(text, r"(?U)\s*\(Note:[^)]*\)", ""), r"(?U)^\s+|\s+\z", "")
    bot = text if show_tag else F.regexp_replace(text, r"(?U)^\[chit-chat\]\s*", "")
    return F.when(F.lower(role) == "user", user).when(F.lower(role) == "bot", bot).otherwise(text)


#: A text in single or double quotes with backslash escapes, and a list of such texts.
QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
QUOTED_LIST = rf"(?s)^\[\s*(?:(?:{QUOTED})\s*(?:,\s*(?:{QUOTED})\s*)*,?)?\s*\]$"


def attribute_list(text: Column) -> Column:
    """Names from a reply that is a JSON array, a quoted list, or plain text parted by commas, semicolons or lines."""
    bare = F.trim(F.regexp_replace(text, r"(?is)^\s*```(?:json)?|```\s*$", ""))
    parsed = F.from_json(bare, ArrayType(StringType()))
    each = F.regexp_extract_all(bare, F.lit(f"(?s){QUOTED}"), F.lit(0))
    quoted = F.when(bare.rlike(QUOTED_LIST), F.transform(each, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.char_length(x) - 2), r"\\(.)", "$1")))
    plain = F.filter(F.transform(F.split(bare, r"[,;\n]"), lambda x: F.regexp_replace(x, r"^[\s\-•]+|\s+$", "")), lambda x: x != "")
    return F.coalesce(parsed, F.when(bare.startswith("["), quoted), plain)


def distinct_by_name(names: Column) -> Column:
    """Names without those that equal an earlier one when lower-cased and with ``_`` and ``-`` as spaces."""
    key = lambda x: F.trim(F.lower(F.regexp_replace(x, "[_-]+", " ")))
    keys = F.transform(names, key)
    return F.filter(names, lambda x, i: F.array_position(keys, key(x)) == i + 1)


#: A line that reports replaced calls, indented or not.
FALLBACK_LINE = r"(?m)^[^\S\n]*System: <FALLBACK>([^\n]*)"


def fallback_count(text: Column) -> Column:
    """Sum of ``fallbacks=N`` over the lines that report replaced calls; a line without the number counts 1."""
    lines = F.regexp_extract_all(_blank(text), F.lit(FALLBACK_LINE), 1)
    numbers = F.transform(lines, lambda x: F.coalesce(F.regexp_extract(x, r"\bfallbacks=(\d+)", 1).try_cast("int"), F.lit(1)))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def without_fallback(text: Column) -> Column:
    return F.regexp_replace(_blank(text), FALLBACK_LINE + r"(?:\n|\z)", "")


#: Credentials in running text and what is shown of them, in the order in which they are applied.
SECRETS = [
    (r"(?i)\bbearer\s+[^\s'\",;]+", "Bearer ***"),
    (r"(?i)\b(api[-_]?key|access[-_]?token|token|authorization|key)\b(\s*[=:]\s*)[^\s'\",;&]+", "$1$2***"),
    (r"\bsk-[A-Za-z0-9_\-]{6,}", "sk-***"),
]


def without_secrets(text: Column) -> Column:
    """The text with bearer tokens, the values of keys and tokens, and ``sk-`` keys masked; line ends stay."""
    for pattern, mark in SECRETS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def masked(text: Column, limit: int = 300) -> Column:
    """One line of at most ``limit`` characters without secrets; a cut line ends in three dots."""
    line = without_secrets(F.regexp_replace(F.regexp_replace(_blank(text), r"(?U)\s+", " "), r"^ | \z", ""))
    return F.when(F.char_length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 3), F.lit("...")))


def json_scores(text: Column, fields: dict[str, str]) -> Column:
    """A struct of the fields (name: type) from a reply that holds one JSON object, fenced or not, its keys in any case."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    pairs = F.map_entries(F.from_json(body, "map<string,string>"))
    value = lambda name: F.get(F.filter(pairs, lambda p: F.lower(p["key"]) == name.lower()), 0)["value"]
    return F.struct(*(value(n).try_cast(kind).alias(n) for n, kind in fields.items()))


def nested_scores(text: Column, names: tuple[str, ...]) -> Column:
    """A struct of doubles from a reply ``{name: {"score": x, ...}, ...}``, fenced or not; null where a score can't be read."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    held = F.from_json(body, "map<string,string>")
    return F.struct(*(F.get_json_object(F.try_element_at(held, F.lit(n)), "$.score").try_cast("double").alias(n) for n in names))


# --- catalogue text ---------------------------------------------------------------------------------------------------


def title_without_year(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s*\(\d{4}\)\s*$", ""))


def field_text(columns: list[Column]) -> Column:
    """All fields joined by one space; a null field leaves its place empty."""
    return F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def labelled(pairs: dict[str, Column], rest: Column | None = None) -> Column:
    """``label: value`` of the fields that are not blank, parted by bars, then ``rest``."""
    shown = [F.when(present(c), F.concat(F.lit(f"{label}: "), F.trim(c.cast("string")))) for label, c in pairs.items()]
    return F.concat_ws(" | ", *shown, *([] if rest is None else [F.when(present(rest), rest)]))


def present(value: Column) -> Column:
    """False for null and for texts that are blank or spell a missing value."""
    text = F.trim(value.cast("string"))
    return value.isNotNull() & ~text.isin("", "nan", "NaN", "None")


#: Wearers by the first part of a category code.
WEARERS = {"ladies": "Women", "men": "Men", "kids": "Kids", "divided": "Divided", "newborn": "Newborn", "baby": "Baby"}


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, whatever stands before it."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1), F.initcap), "")


def category_parts(code: Column) -> tuple[Column, Column]:
    """(wearer, kind) of a code such as ``men_shirts_slim``: the first part mapped or in title case, the rest in title case."""
    parts = F.split(F.lower(_blank(code)), "_")
    table = F.create_map(*(F.lit(x) for pair in WEARERS.items() for x in pair))
    first = F.get(parts, 0)
    return F.coalesce(table[first], title_case(first)), F.array_join(F.transform(F.slice(parts, 2, 1000), title_case), " ")


def price_text(price: Column) -> Column:
    return F.when(price.isNotNull(), F.format_string("$%.2f", price))


def demographic_text(year: Column, gender: Column, job: Column, country: Column, asof: Column) -> Column:
    """``N years old, gender, job, from country`` without the parts that are missing."""
    age = F.when(year.isNotNull(), F.concat((F.year(asof) - year).cast("int").cast("string"), F.lit(" years old")))
    return F.concat_ws(", ", age, F.when(present(gender), gender), F.when(present(job), job), F.when(present(country), F.concat(F.lit("from "), country)))


#: Labels that were replaced over and over, and the short ones that repair them.
REPAIRS = [
    (r"\b(?:movie\s+){1,}genres\b", "genres"),
    (r"\b(?:movie\s+){1,}production\s+companies\b", "production companies"),
    (r"\b(?:movie\s+){1,}description\b", "overview"),
    (r"\badult(?:\s+only)+\b", "adult-only content"),
    (r"\boriginal\s+language(?:\s+of\s+the\s+movie)+\b", "original language"),
    (r"\blanguages\s+spoken(?:\s+in\s+the\s+movie)+\b", "spoken languages"),
    (r"\baverage\s+rating(?:\s+of\s+the\s+movie)+\b", "rating"),
    (r"\byear(?:\s+of\s+the\s+movie)+\b", "release year"),
    (r"\bcountries\s+where\s+the\s+movie\s+was\s+produced\b", "production countries"),
    (r"\bwas\s+produced(?:\s+was\s+produced)+\b", "was produced"),
]


def repaired_labels(text: Column) -> Column:
    for pattern, label in REPAIRS:
        text = F.regexp_replace(text, "(?i)" + pattern, label)
    return text


def safe_names(names: dict[str, str]) -> dict[str, str]:
    """The names whose label does not hold them, so that replacing twice changes nothing; names with a space are left out."""
    return {k: v for k, v in names.items() if k.lower() not in v.lower() and ("_" in k or " " not in k)}


def renamed_columns(text: Column, names: dict[str, str]) -> Column:
    """Column names in running text replaced by readable ones: whole words in any case, longest first."""
    for name in sorted(names, key=lambda n: -len(n)):
        text = F.regexp_replace(text, rf"(?i)\b{re.escape(name)}\b", names[name].replace("\\", "\\\\").replace("$", "\\$"))
    return text


def quality_band(score: Column) -> Column:
    """The band of a score from 1 to 5; null without one."""
    return F.when(score.isNull(), F.lit(None).cast("string")).when(score >= 4.5, "excellent").when(score >= 3.5, "good").when(score >= 2.5, "average").when(score >= 1.5, "bad").otherwise("very_bad")


def unset(value: Column) -> Column:
    """Whether a setting spells nothing: null, blank, ``none``, ``null`` or ``~``."""
    return value.isNull() | F.lower(F.trim(value.cast("string"))).isin("", "none", "null", "~")
