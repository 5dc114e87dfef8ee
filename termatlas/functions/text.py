"""Scalar text functions; offsets are code points, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SPACE_CLASS, prefilter, to_java

SPACES = f"[{SPACE_CLASS}]+"


def collapse_spaces(text: Column) -> Column:
    """Strip, and turn every run of (Unicode) white space into one space."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip(text: Column) -> Column:
    # a run is read once: it starts where no white space stands before it, and gives nothing back
    return F.regexp_replace(text, f"^{SPACES}|(?<![{SPACE_CLASS}]){SPACES}+$", "")


def first_split(text: Column, pattern: str) -> Column:
    """[before, after] of the first match, null without one; the prefilter spares most texts the boundaries."""
    parts = F.split(text, to_java(pattern), 2)
    return F.when(text.rlike(prefilter(pattern)), parts)


def window_text(text: Column, start: Column, end: Column, size: int) -> Column:
    """The text from size before start to size after end, clamped."""
    a = F.greatest(start - size, F.lit(0))
    b = F.least(F.length(text), end + size)
    return F.substring(text, a + 1, b - a)


def snippet(text: Column, start: Column, end: Column, size: int) -> Column:
    return collapse_spaces(window_text(text, start, end, size))


def near(text: Column, start: Column, end: Column, size: int, needle: str) -> Column:
    """Whether the lower-cased window holds the needle."""
    return F.contains(F.lower(window_text(text, start, end, size)), F.lit(needle))


def file_crawl(source: Column) -> Column:
    """The crawl a file name starts with."""
    return F.split_part(source, F.lit("_"), F.lit(1))


def stable_seed(crawl: Column, base: int) -> Column:
    """base xor the first 32 bits of the crawl name's SHA-256."""
    return F.conv(F.substring(F.sha2(crawl, 256), 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(base).cast("long"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """Rate to four decimals, halves to even."""
    return F.rint(rate(part, whole) * 10000) / 10000
