"""Text expressions: token flags, keyed score lists and URL slugs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import as_column

# The slug rules.
# A host with one bracket only is no URL: no path, as the standard parser rejects it.
PATH_OF_URL = (
    r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?+"
    r"(?://[^/?#\[\]]*(?:\[[^/?#\[\]]*\][^/?#\[\]]*)?(?=[/?#]|$)|(?!//))([^?#]*)"
)
PAGE_EXTENSION = r"(?i)\.(html?|php|aspx)$"
DATE_PIECES = r"(?U)(?=\d)\b(20\d{2}|0?[1-9]|1[0-2]|[12]\d|3[01])\b"
NUMBER = r"(-?[\d.]+)"


def contains_flag(text: Column | str, token: str) -> Column:
    """1 when the token occurs anywhere, also inside a longer token; else 0."""
    return F.when(as_column(text).contains(token), 1).otherwise(0)


def exact_token_flag(text: Column | str, token: str, sep: str = ";") -> Column:
    """1 when the token is one whole element of a delimited list; else 0."""
    parts = F.split(as_column(text), re.escape(sep))
    return F.when(F.array_contains(parts, token), 1).otherwise(0)


def keyed_values(text: Column | str, keys) -> tuple[Column, Column]:
    """All ``key:number`` hits for the wanted keys, as parallel arrays (keys, numbers).

    Two scans of the string serve any number of keys. Like a search for each key, the match
    is unanchored; take the first hit per key with ``first_value``.
    """
    # longest first: with the colon in the pattern the order only saves backtracking
    wanted = "|".join(re.escape(key) for key in sorted(keys, key=len, reverse=True))
    pattern = F.lit(f"({wanted}):{NUMBER}")
    text = as_column(text)
    return F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(
        text, pattern, F.lit(2)
    )


def first_value(keys: Column | str, values: Column | str, key: str) -> Column:
    """Number of the first hit of ``key``; NULL if there is none or it is no number."""
    position = F.array_position(as_column(keys), key)
    return F.get(as_column(values), position.cast("int") - 1).try_cast("double")


def slug(url: Column | str) -> Column:
    """Last path segment of a URL as plain words; '' when there is none.

    The extension goes, percent escapes are decoded, hyphens and underscores become spaces,
    stand-alone years and day or month numbers go, spaces are squeezed.
    """
    # each step reads the one before it once: a filter on the slug then runs every step once
    path = F.regexp_extract(as_column(url), PATH_OF_URL, 1)
    path = F.regexp_replace(path, ";[^/]*$", "")
    last = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    last = F.regexp_replace(last, PAGE_EXTENSION, "")
    # a form decoder reads '+' as a space and fails on a lone '%': escape both first
    last = F.replace(last, F.lit("+"), F.lit("%2B"))
    last = F.try_url_decode(F.regexp_replace(last, "%(?![0-9A-Fa-f]{2})", "%25"))
    last = F.regexp_replace(last, "[-_]+", " ")
    last = F.regexp_replace(last, DATE_PIECES, " ")
    last = F.regexp_replace(last, r"(?U)\s+", " ")
    return F.coalesce(F.trim(last), F.lit(""))
