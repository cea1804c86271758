"""Scalar text functions as Columns; all of them stay in generated code but NFKD."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: what the line cleaner strips: a closing bracket stays
PUNCTUATION_KEEP_BRACKET = PUNCTUATION.replace(")", "")
BLANKS = " \t\n\r\x0b\x0c"


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def stripped(c: Column) -> Column:
    """Without Unicode white space and separator controls at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_line(c: Column) -> Column:
    """Punctuation but ')' off both ends, then runs of white space to single blanks, trimmed."""
    return strip_chars(F.regexp_replace(strip_chars(c, PUNCTUATION_KEEP_BRACKET), r"[\t\n\x0b\f\r ]+", " "), BLANKS)


def full_clean(c: Column) -> Column:
    """Punctuation off both ends; blanks stay."""
    return strip_chars(c, PUNCTUATION)


def clean_for_model(c: Column) -> Column:
    """Punctuation off, tabs, line ends and brackets to blanks, blanks collapsed and trimmed."""
    return strip_chars(F.regexp_replace(F.regexp_replace(strip_chars(c, PUNCTUATION), r"[\t\r\n()]", " "), " +", " "), " ")


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def clean_for_tagger(c: Column) -> Column:
    return nfkd(clean_for_model(c))


def clean_name(c: Column) -> Column:
    """For names to match: decomposed, quotes and brackets to blanks."""
    return strip_chars(F.regexp_replace(F.regexp_replace(nfkd(strip_chars(c, PUNCTUATION)), r"[\t\r\n()\"']", " "), " +", " "), " ")


def space_markup(c: Column) -> Column:
    """Blanks around tags, commas and colons, then one pass over double blanks."""
    for a, b in (("<", " <"), (">", "> "), (",", " ,"), (":", " : "), ("  ", " ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def year_of(c: Column) -> Column:
    """First year of the form 19xx or 20xx at a word start, else -1."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"\b(19|20)\d{2}", 0)
    return F.when(found == "", F.lit(-1)).otherwise(found.cast("int"))


def num_tokens(c: Column) -> Column:
    """Pieces between single blanks, empty ones included."""
    return F.size(F.split(c, " ", -1))


def percent_cap(c: Column) -> Column:
    """Share of non-empty tokens that start with a capital; 0 without tokens."""
    words = F.filter(F.split(c, " ", -1), lambda w: w != "")
    caps = F.size(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}"))))
    return F.when(F.size(words) > 0, caps / F.size(words)).otherwise(F.lit(0.0))


def has_letter(c: Column) -> Column:
    return F.rlike(c, F.lit("[a-zA-Z]"))


def is_alpha(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^\p{L}+$"))


def split_line(c: Column, literal: bool = False) -> Column:
    """Entity phrases of a line: brackets and commas separate, pieces trimmed, empty ones dropped.

    ``literal`` repeats a known fault: text behind the last bracket loses as many
    characters from its start as the last bracket's end counted in its own rest.
    """
    if literal:
        return _split_line_literal(c)
    # a bracket pair cuts; an unpaired one is text
    flat = F.regexp_replace(c, r"\((.*?)\)", ",$1,")
    return F.filter(F.transform(F.split(flat, ",", -1), lambda s: strip_chars(s, BLANKS)), lambda s: s != "")


@F.pandas_udf(ArrayType(StringType()))
def _split_line_literal(s: pd.Series) -> pd.Series:
    import re

    pair = re.compile(r"\((.*?)\)")

    def one(text):
        if text is None:
            return None
        pieces, end = [], 0
        while m := pair.search(text):
            pieces += text[: m.start()].split(",") + m[1].split(",")
            end = m.end()
            text = text[end:]
        pieces += text[end:].split(",")
        return [p.strip() for p in pieces if p.strip()]

    return s.map(one)


def interleaved(tokens: Column, parity: int) -> Column:
    """Every second element, from ``parity``."""
    return F.filter(tokens, lambda x, i: i % 2 == parity)
