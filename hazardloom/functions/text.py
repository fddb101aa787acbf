"""Text functions on columns."""

from __future__ import annotations

import html
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from .values import as_column

# workers receive the two Arrow functions with the job and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The characters that count as white space, as text and as a regex class body.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\t\n\x0B\f\r\x1C-\x1F\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
KEPT_PUNCTUATION = r""".,;:!?\-_/()\[\]{}'\""""

# The words that decide the sentiment label.
POSITIVE_WORDS = ["good", "safe", "improved", "better", "success"]
NEGATIVE_WORDS = ["bad", "dangerous", "failed", "worse", "accident"]


def strip(c) -> Column:
    return F.btrim(as_column(c), F.lit(WHITE_SPACE))


def squeeze(c) -> Column:
    return F.regexp_replace(as_column(c), f"[{SPACE_CLASS}]+", " ")


def is_blank(c) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def normalize_text(c) -> Column:
    return F.lower(squeeze(strip(F.coalesce(as_column(c).cast("string"), F.lit("")))))


def tokens(c) -> Column:
    """Runs of ASCII letters and digits in the lower-cased text."""
    return F.regexp_extract_all(F.lower(as_column(c)), F.lit("[a-z0-9]+"), F.lit(0))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _compatibility_form(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _where_needed(udf, needed: Column, c: Column) -> Column:
    """Send only the rows that can change to the Python worker; the others travel as null."""
    return F.coalesce(udf(F.when(needed, c)), c)


def clean_text(
    c,
    *,
    to_lower: bool = True,
    remove_html: bool = True,
    unescape_entities: bool = True,
    normalize_unicode: bool = True,
    remove_urls: bool = True,
    remove_emails: bool = True,
    remove_control_chars: bool = True,
    keep_basic_punct: bool = True,
    collapse_whitespace: bool = True,
    strip_edges: bool = True,
    digits_to_placeholder: bool = False,
    placeholder_digit: str = "0",
) -> Column:
    """Cleaning chain with switches; null gives ''.

    Only entity unescaping and the Unicode compatibility form leave the JVM, in Arrow batches.
    """
    s = F.coalesce(as_column(c).cast("string"), F.lit(""))
    if remove_html:
        if unescape_entities:
            s = _where_needed(_unescape, F.contains(s, F.lit("&")), s)
        s = F.regexp_replace(s, "<[^>]+>", " ")
    if remove_urls:
        s = F.regexp_replace(s, f"(?iu)https?://[^{SPACE_CLASS}]+|www\\.[^{SPACE_CLASS}]+", " ")
    if remove_emails:
        s = F.regexp_replace(s, r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", " ")
    if normalize_unicode:
        s = _where_needed(_compatibility_form, F.rlike(s, F.lit(r"[^\x00-\x7F]")), s)
    if remove_control_chars:
        s = F.regexp_replace(s, r"[\p{C}&&[^\t\n\r]]", "")
    if digits_to_placeholder:
        literal = placeholder_digit.replace("\\", "\\\\").replace("$", "\\$")
        s = F.regexp_replace(s, r"\p{Nd}", literal)
    kept = KEPT_PUNCTUATION if keep_basic_punct else "_"
    s = F.regexp_replace(s, rf"[^\p{{L}}\p{{N}}{SPACE_CLASS}{kept}]", " ")
    if strip_edges:
        s = strip(s)
    if collapse_whitespace:
        s = squeeze(s)
    return F.lower(s) if to_lower else s


def found_words(c, words: list[str]) -> Column:
    """The listed words that occur in the text (case-insensitive, list order); [] for null."""
    lowered = F.lower(F.coalesce(as_column(c), F.lit("")))
    if not words:
        return F.array().cast("array<string>")
    return F.filter(
        F.array(*[F.when(F.contains(lowered, F.lit(w.lower())), F.lit(w)) for w in words]),
        lambda w: w.isNotNull(),
    )


def word_hits(c, words: list[str]) -> Column:
    """How many of the listed words occur in the text."""
    lowered = F.lower(F.coalesce(as_column(c), F.lit("")))
    hits = [F.contains(lowered, F.lit(w)).cast("int") for w in words]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def sentiment_label(positive: Column, negative: Column) -> Column:
    return (
        F.when(positive > negative, "positive").when(negative > positive, "negative").otherwise("neutral")
    )


def shorten(c, limit: int = 30) -> Column:
    s = as_column(c)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)
