"""Comparison views of free text.

All are column expressions. With ``strict`` the case step is NFKC and case folding
(an Arrow UDF, as Spark has neither); without, it is ``lower``, which stays in the
JVM and differs for few characters. ``[\\p{L}\\p{N}_]`` stands for word characters:
unlike Java's ``\\w`` it leaves combining marks out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Literals that stand for a missing value, control characters, and terminal company designators.
NULL_LIKE = ("null", "none", "nan", "n/a", "na", "nil", "<null>", "missing")
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+"
LEGAL_SUFFIX = r"(?i)(?:\s|,)+(?:inc(?:orporated)?|corp(?:oration)?|co(?:mpany)?|llc|ltd|limited|llp|plc|pvt(?:\s+ltd)?|private\s+limited)\.?$"
POSTAL = r"(?<!\p{Nd})(\p{Nd}{5}(?:[- ]?\p{Nd}{4})?)\s*$"

SPACES = r"(?U)\s+"
NOT_WORD_OR_SPACE = r"(?U)[^\p{L}\p{N}_\s]"


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold() if isinstance(x, str) else x)


@F.pandas_udf(T.StringType())
def drop_marks(s: pd.Series) -> pd.Series:
    """NFKD without combining characters."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) if isinstance(x, str) else x)


def _kinds(text: str) -> list[str]:
    """First words of the Unicode names of the letters."""
    return sorted({unicodedata.name(c, "UNKNOWN").split()[0] for c in text if c.isalpha()})


@F.pandas_udf(T.ArrayType(T.StringType()))
def scripts(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _kinds(x) if isinstance(x, str) else [])


def script(c: Column) -> Column:
    """Latin, Devanagari, OtherLetter, Mixed or NoLetters."""
    kinds = F.transform(scripts(raw(c)), lambda x: F.when(x == "LATIN", "Latin").when(x == "DEVANAGARI", "Devanagari").otherwise("OtherLetter"))
    distinct = F.array_distinct(kinds)
    return F.when(F.size(distinct) == 0, "NoLetters").when(F.size(distinct) > 1, "Mixed").otherwise(F.element_at(distinct, 1))


def raw(c: Column) -> Column:
    """Missing values are empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def lowered(c: Column, strict: bool = True) -> Column:
    """Control characters as spaces, then the case step."""
    spaced = F.regexp_replace(raw(c), CONTROL, " ")
    return nfkc_casefold(spaced) if strict else F.lower(spaced)


def whitespace(c: Column, strict: bool = True) -> Column:
    return squeezed(lowered(c, strict))


def punctuation(c: Column, strict: bool = True) -> Column:
    """Punctuation as spaces; letters and digits stay."""
    return squeezed(F.regexp_replace(whitespace(c, strict), NOT_WORD_OR_SPACE, " "))


def vector_normal(c: Column) -> Column:
    """As punctuation, but without the control step."""
    return squeezed(F.regexp_replace(squeezed(nfkc_casefold(raw(c))), NOT_WORD_OR_SPACE, " "))


def folded(c: Column, strict: bool = True) -> Column:
    return drop_marks(punctuation(c, strict))


def compact(f: Column) -> Column:
    """A folded view without separators; the underscore stays."""
    return F.regexp_replace(f, r"[^\p{L}\p{N}_]", "")


def tokens(f: Column) -> Column:
    return F.regexp_extract_all(f, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def digits(lowered_text: Column) -> Column:
    """Runs of decimal digits, in order."""
    return F.regexp_extract_all(lowered_text, F.lit(r"(\p{Nd}+)"), F.lit(1))


def without_suffix(punctuated: Column) -> Column:
    """One terminal company designator removed, then spaces, commas and full stops at the ends."""
    return F.regexp_replace(F.regexp_replace(punctuated, LEGAL_SUFFIX, ""), r"^[ ,.]+|[ ,.]+$", "")


def terminal_postal(address: Column) -> Column:
    """Five digits (and four) at the end of the raw text, if a letter stands before them; else empty."""
    code = F.regexp_extract(raw(address), POSTAL, 1)
    before = F.regexp_replace(raw(address), POSTAL, "")
    return F.when((code != "") & before.rlike(r"\p{L}"), code).otherwise("")


def is_missing(c: Column) -> Column:
    return squeezed(F.regexp_replace(raw(c), CONTROL, " ")) == ""


def is_null_like(c: Column, strict: bool = True) -> Column:
    return ~is_missing(c) & whitespace(c, strict).isin(*NULL_LIKE)


def initials(t: Column) -> Column:
    return F.array_join(F.transform(t, lambda x: F.left(x, F.lit(1))), "")


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct windows of n characters; none for shorter texts."""
    none = F.array().cast("array<string>")
    return F.when(F.length(c) < n, none).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, n))))


def padded_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, each word padded by a space on both sides; repeats stay."""
    words = F.filter(F.split(c, " "), lambda w: w != "")

    def of_word(w):
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.flatten(F.array(*[_windows(p, n) for n in range(low, high + 1)]))

    return F.flatten(F.transform(words, of_word))


def _windows(p: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.length(p) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - (n - 1), F.lit(1))), lambda i: F.substring(p, i, n)))


def word_ngrams(t: Column) -> Column:
    """Words, then pairs of neighbours."""
    none = F.array().cast("array<string>")
    pairs = F.when(F.size(t) < 2, none).otherwise(F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(1))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(t, pairs)


def field(c: Column, strict: bool = True) -> Column:
    """The field's struct: raw, unicode, folded, compact, tokens, digits, missing, null_like. Missing and null-like values have empty views."""
    missing, null_like = is_missing(c), is_null_like(c, strict)
    gone = missing | null_like
    blank = lambda x: F.when(gone, F.lit("")).otherwise(x)
    none = F.array().cast("array<string>")
    f = folded(c, strict)
    return F.struct(
        raw(c).alias("raw"), blank(punctuation(c, strict)).alias("unicode"), blank(f).alias("folded"), blank(compact(f)).alias("compact"),
        F.when(gone, none).otherwise(tokens(f)).alias("tokens"), F.when(gone, none).otherwise(digits(lowered(c, strict))).alias("digits"), missing.alias("missing"), null_like.alias("null_like"),
    )


def comparison_views(c: Column, is_name: bool = True, strict: bool = True) -> Column:
    """All ten views in one struct; only names lose a company designator."""
    p = punctuation(c, strict)
    f = folded(c, strict)
    return F.struct(
        raw(c).alias("raw"), lowered(c, strict).alias("unicode_lower"), whitespace(c, strict).alias("whitespace_normalized"), p.alias("punctuation_normalized"), f.alias("accent_folded"),
        compact(f).alias("alphanumeric_compact"), tokens(f).alias("word_tokens"), F.array_sort(tokens(f)).alias("sorted_tokens"), digits(lowered(c, strict)).alias("digit_sequence"),
        (without_suffix(p) if is_name else p).alias("legal_suffix_stripped"),
    )


#: View names of keys, and the struct fields they read.
VIEWS = {"unicode_preserving": "unicode", "accent_folded": "folded"}


def key(f: Column, view: str) -> Column:
    """The blocking key of a field struct: empty if missing, null-like or without a word character."""
    if view not in VIEWS:
        raise ValueError(f"unknown view: {view}")
    return f[VIEWS[view]]
