"""Text expressions.

Everything is JVM-side except Unicode compatibility folding, HTML entities and
the sequence-matcher ratio, which have no built-in and run as Arrow UDFs.
"""

from __future__ import annotations

import html
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The token and sentence patterns that decide results.
TOKEN_PATTERN = "[a-zA-Z0-9_]++|[\\u3400-\\u9fff]"
BIGRAM_PATTERN = "(?=([\\u3400-\\u9fff]{2}))"
SENTENCE_END_PATTERN = "[.!?。！？；;][\"'”’）)]?$"
MARKUP_PATTERN = "<[^>]+>"

_TOKEN = re.compile(TOKEN_PATTERN)


def tokenize(text: Column) -> Column:
    """ASCII words and single CJK characters, then CJK bigrams at the end.

    Non-ASCII Latin letters separate words.  Bigrams pair neighbours in the
    sequence of CJK characters, ignoring words in between.
    """
    units = F.transform(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)
    characters = F.regexp_replace(text, "[^\\u3400-\\u9fff]", "")
    bigrams = F.regexp_extract_all(characters, F.lit(BIGRAM_PATTERN), F.lit(1))
    # byte and character counts agree for ASCII texts, which need no further look
    has_cjk = (F.octet_length(text) != F.length(text)) & text.rlike("[\\u3400-\\u9fff]")
    return F.when(has_cjk, F.concat(units, bigrams)).otherwise(units)


def query_terms(query: str) -> list[str]:
    """What :func:`tokenize` gives for a search string, on the driver."""
    words: list[str] = []
    pairs: list[str] = []
    before = ""
    for found in _TOKEN.finditer(query):
        word = found.group().lower()
        words.append(word)
        if not word.isascii():
            if before:
                pairs.append(before + word)
            before = word
    return words + pairs


def collapse_whitespace(text: Column) -> Column:
    """Runs of Unicode white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]+", " "))


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_END_PATTERN)


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; a cut text ends in three dots."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    )


@F.pandas_udf(T.StringType())
def normalize_compat(text: pd.Series) -> pd.Series:
    """NFKC, then white space collapsed."""
    return text.map(
        lambda value: None if value is None else " ".join(unicodedata.normalize("NFKC", value).split())
    )


@F.pandas_udf(T.StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    return text.map(lambda value: None if value is None else html.unescape(value))


def plain_text(markup: Column) -> Column:
    """Tags removed, entities decoded, white space collapsed.

    The Python step is skipped for rows that hold no ampersand.
    """
    stripped = F.regexp_replace(markup, MARKUP_PATTERN, "")
    decoded = F.when(stripped.contains("&"), unescape_entities(stripped)).otherwise(stripped)
    return collapse_whitespace(decoded)


def text_ratio(first: str, second: str) -> float:
    return SequenceMatcher(None, first.casefold(), second.casefold()).ratio()


@F.pandas_udf(T.DoubleType())
def text_similarity(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([text_ratio(a, b) for a, b in zip(first, second)], dtype="float64")
