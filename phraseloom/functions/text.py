"""Scalar functions: tokens, n-grams, phrases. All are built-in expressions, so they run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A token is a run of ASCII letters and digits and of all characters beyond ASCII.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(text: Column | str) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(_column(text), _UPPER, _LOWER)


def tokenize(text: Column | str) -> Column:
    """array<string> of the lower-cased tokens; a null text has none. Case folds before the split: no separator is a letter."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(_column(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def decode_bytes(content: Column | str) -> Column:
    """Text of a file: UTF-16 where it starts with that byte order mark (an odd last byte is dropped), else UTF-8.

    A UTF-8 mark stays in the text; bytes that aren't UTF-8 become U+FFFD.
    """
    c = _column(content)
    mark = F.hex(F.substring(c, 1, 2))
    body = F.substring(c, F.lit(3), F.greatest(F.lit(0), (F.octet_length(c) - 2).cast("int")))
    even = F.substring(body, F.lit(1), (F.octet_length(body) - F.octet_length(body) % 2).cast("int"))
    return F.when(mark == "FFFE", F.decode(even, "UTF-16LE")).when(mark == "FEFF", F.decode(even, "UTF-16BE")).otherwise(c.cast("string"))


def starts(tokens: Column | str, n: int) -> Column:
    """1-based starts of all n-grams; empty for a shorter document."""
    size = F.size(_column(tokens))
    return F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))


def ngrams(tokens: str, n: int) -> Column:
    """array of the space-joined n-grams of a column, repeats included."""
    return F.transform(starts(tokens, n), lambda i: F.array_join(F.slice(F.col(tokens), i, F.lit(n)), " "))


def normalize_phrase(phrase: Column | str) -> Column:
    """Unicode lower case, trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(_column(phrase)), r"\s+", " "))


def display_phrase(phrase: Column | str, parent: Column | str) -> Column:
    """The phrase with every occurrence of its parent's text as <PARENT>; without a parent that occurs, the phrase."""
    p, q = _column(phrase), _column(parent)
    shown = F.trim(F.regexp_replace(F.replace(p, q, F.lit(" <PARENT> ")), r"\s+", " "))
    return F.when(q.isNotNull() & (q != "") & F.contains(p, q), shown).otherwise(p)


def pareto_score(length: Column | str, freq: Column | str, max_length: Column | str, max_freq: Column | str) -> Column:
    """Distance from the point of greatest length and greatest frequency; smaller is better."""
    a, b = _column(length) / _column(max_length), F.log1p(_column(freq)) / F.log1p(_column(max_freq))
    return F.sqrt(F.pow(1 - a, F.lit(2.0)) + F.pow(1 - b, F.lit(2.0)))


def sequence_text(ids: Column | str) -> Column:
    """One document as text of the sequence format: each id followed by -1, and -2 at the end."""
    parts = F.transform(_column(ids), lambda x: F.concat(x.cast("string"), F.lit(" -1 ")))
    return F.concat(F.array_join(parts, ""), F.lit("-2"))
