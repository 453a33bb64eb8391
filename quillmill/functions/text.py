"""String operators as Columns. White space and word characters are spelt out so that the JVM, Arrow
workers and an SQL oracle read texts alike."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str methods see it.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDCH = r"[\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once: inside array functions an outer expression is evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"\A[{WS}]+|[{WS}]+\z", "")


def words(text: Column) -> Column:
    """Words between white space; null stays null."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(words(text)))


def token_estimate(text: Column) -> Column:
    """floor(words x 1.3), per text; 0 for null."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("bigint")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; texts that are normal already are passed through."""
    return text.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def dehyphenate(text: Column) -> Column:
    """Joins words cut at a line end by a hyphen, with or without a blank after it; matches do not overlap."""
    once = F.regexp_replace(text, rf"({WORDCH})-\n({WORDCH})", "$1$2")
    return F.regexp_replace(once, rf"({WORDCH})- \n({WORDCH})", "$1$2")


def strip_repeated_lines(text: Column, times: int = 3, longest: int = 100) -> Column:
    """Drops every line whose stripped form is not blank, shorter than `longest` and occurs more than `times` times.

    Counting within one document is linear in a worker; as nested array functions it would be quadratic.
    """

    @F.pandas_udf(T.StringType())
    def drop(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            lines = t.split("\n")
            if len(lines) <= times:
                return t
            bare = [x.strip() for x in lines]
            gone = {x for x, n in Counter(bare).items() if n > times and 0 < len(x) < longest}
            return "\n".join(x for x, y in zip(lines, bare) if y not in gone) if gone else t

        return texts.map(one)

    return drop(text)


def reconnect(text: Column) -> Column:
    """Strips lines and joins a line to the one before where that has no final stop and this starts in lower
    case, with a bracket or a quote. Whether two lines join depends on these two only, so it is one replacement."""
    stripped = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    return F.regexp_replace(stripped, r"(?<=[^.!?:;\n])\n(?=[\p{Ll}(\"'])", " ")


def squeeze(text: Column) -> Column:
    """Blank lines, spaces, form feeds and control characters, in this order, then strip."""
    t = F.regexp_replace(text, r"\n{4,}", "\n\n\n")
    t = F.regexp_replace(t, r" {2,}", " ")
    t = F.regexp_replace(t, r"\f", "\n")
    return strip(F.regexp_replace(t, r"[\x00-\x08\x0b\x0e-\x1f]", ""))


def clean(text: Column, normalise: bool = True) -> Column:
    """The full chain: NFC, hyphens, repeated lines, paragraphs, white space."""
    t = nfc(text) if normalise else text
    return squeeze(reconnect(strip_repeated_lines(dehyphenate(t))))


def book_clean(text: Column) -> Column:
    """The chain for books: odd spaces, page-number and DOI lines, dashes, hyphens between a-z, blanks."""
    t = F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    t = F.regexp_replace(t, rf"\n[{WS}]*\d{{1,4}}[{WS}]*\n", "\n")
    t = F.regexp_replace(t, rf"\n[{WS}]*(?:doi|DOI|https?://doi\.org)[^\n]*\n", "\n")
    t = F.replace(F.replace(t, F.lit("–"), F.lit("-")), F.lit("—"), F.lit(" - "))
    t = F.regexp_replace(t, r"(?<=[a-z])-\n(?=[a-z])", "")
    return strip(F.regexp_replace(t, r"  +", " "))


def argument_density(text: Column, phrases: list[str], least_words: int = 100) -> Column:
    """1000 x phrases / words of the lower-cased text; 0.0 below `least_words` words, null for null.

    Occurrences do not overlap; a phrase listed twice counts twice, one with capitals never matches.
    A hundred string replacements per row cost far more in the JVM than as counts in a worker.
    """

    @F.pandas_udf(T.DoubleType())
    def density(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            low = t.lower()
            n = len(low.split())
            return 0.0 if n < least_words else sum(map(low.count, phrases)) / n * 1000

        return texts.map(one).astype("float64")

    return density(text)


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space."""
    return F.split(text, rf"(?<=[.!?])[{WS}]+")


def claim_sentences(text: Column) -> Column:
    """Split after . ! ? and white space where a capital A-Z follows; blank ones dropped."""
    return F.filter(F.split(text, rf"(?<=[.!?])[{WS}]+(?=[A-Z])"), lambda s: strip(s) != "")


def signal_sentences(text: Column) -> Column:
    """Split at runs of . ! ?, stripped; empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: s != "")


def keyword_tokens(text: Column, stop: list[str]) -> Column:
    """Lower-case a-z words (inner ' and - allowed) of more than two characters that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-z][a-z'\-]*[a-z]|[a-z])\b"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def query_tokens(text: Column, stop: list[str]) -> Column:
    """Distinct a-z words that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-z]+)\b"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)))


def normalise_claim(text: Column) -> Column:
    """Lower case, one blank between words."""
    return F.array_join(lower_words(text), " ")


def parse_confidence(text: Column) -> Column:
    """The number in [CONFIDENCE: x], null if absent or no number."""
    return F.regexp_extract(text, r"\[CONFIDENCE:\s*([0-9.]+)\]", 1).try_cast("double")


def parse_request(text: Column) -> Column:
    """The reason in [ORACLE_REQUEST: ...], null if absent."""
    found = F.regexp_extract(text, r"(?s)\[ORACLE_REQUEST:\s*(.*?)\]", 1)
    return F.when(text.rlike(r"(?s)\[ORACLE_REQUEST:\s*(.*?)\]"), strip(found))


def drop_tags(text: Column) -> Column:
    t = F.regexp_replace(text, r"\[CONFIDENCE:\s*[0-9.]+\]", "")
    return strip(F.regexp_replace(t, r"(?s)\[ORACLE_REQUEST:\s*.*?\]", ""))


def strip_fences(code: Column) -> Column:
    """Code without fences, with the solver import in front if no line has one."""
    bare = strip(F.replace(F.replace(code, F.lit("```python"), F.lit("")), F.lit("```"), F.lit("")))
    return F.when(bare.contains("from z3") | bare.contains("import z3"), bare).otherwise(F.concat(F.lit("from z3 import *\n"), bare))


def chat_text(messages: Column, rejected: Column) -> Column:
    """<|role|> and content, line by line, then <|end|>; empty for rejected examples."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"]))
    return F.when(F.coalesce(rejected, F.lit(False)), "").otherwise(F.array_join(F.concat(parts, F.array(F.lit("<|end|>"))), "\n"))


def fill_slots(template: Column, bindings: Column) -> Column:
    """Each {key} of a template replaced by its binding."""
    return F.aggregate(F.map_entries(bindings), template, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def code_prompt(error_type: Column, query: Column, draft: Column) -> Column:
    """Prompt to an oracle by error type, with the first 500 characters of the draft."""
    head = F.substring(draft, 1, 500)
    return (
        F.when(error_type == 1, F.format_string("Check the facts.\nQuestion: %s\nDraft: %s", query, head))
        .when(error_type == 2, F.format_string("Check the reasoning.\nQuestion: %s\nDraft: %s", query, head))
        .when(error_type == 3, F.format_string("Check the formalization.\nQuestion: %s\nDraft: %s", query, head))
        .when(error_type == 4, F.format_string("Answer the question.\nQuestion: %s", query))
        .otherwise(F.format_string("Review the draft.\nQuestion: %s\nDraft: %s", query, head))
    )


def oracle_message(request: Column, context: Column, error: Column) -> Column:
    """What an oracle is sent: the draft as context where there is one, the question, and a note of the error (1-4) in small letters."""
    kind = F.when(error == 1, "factual gap").when(error == 2, "reasoning error").when(error == 3, "formalization error").when(error == 4, "scope exceeded")
    body = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), request)).otherwise(request)
    return F.concat(body, F.coalesce(F.concat(F.lit("\n\nNOTE: this was marked as a "), kind, F.lit(" issue.")), F.lit("")))


def feedback_text(errors: Column, core: Column, suggestion: Column) -> Column:
    """Lines of errors, the unsatisfiable core and the suggestion; null parts are left out."""
    return F.concat_ws("\n", F.transform(errors, lambda e: F.concat(F.lit("- "), e)), F.when(F.size(core) > 0, F.concat(F.lit("Unsat core: "), F.array_join(core, ", "))), F.concat(F.lit("Suggestion: "), suggestion))
