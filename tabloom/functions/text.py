"""Text expressions: tokens, lengths, log line cleaning and classes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.fixed import GLYPHS, LINE_CLASSES, PLAIN

TOKEN = r"[\p{L}\p{N}_]+"
BLANK = " \t\n\r\f\x0b"


def word_count(c: Column) -> Column:
    """Words separated by white space; null and blank text have none."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    return F.size(words).cast("long")


def text_length(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))).cast("long")


def tokens(c: Column, stop_words: list[str]) -> Column:
    """Lower-case word tokens without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stop_words)) if stop_words else found


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of `low` to `high` neighbouring tokens, joined by a blank."""

    def runs(w: Column) -> Column:
        parts = [w] if low == 1 else []
        joined = w
        for n in range(2, high + 1):
            # Runs of n are runs of n - 1, each with the token that follows it.
            room = F.greatest(F.size(w) - (n - 1), F.lit(0))
            joined = F.zip_with(F.slice(joined, F.lit(1), room), F.slice(w, F.lit(n), room), lambda a, b: F.concat_ws(" ", a, b))
            if n >= low:
                parts.append(joined)
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    # The lambda variable holds the tokens, so they are computed once per row.
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def any_word(c: Column, words: list[str]) -> Column:
    """True when lower-case text contains one of the words."""
    return has_word(F.lower(c), words)


def has_word(lower: Column, words: list[str]) -> Column:
    """True when the (already lower-case) text contains one of the words; plain scans stay in generated code."""
    return reduce(or_, [F.contains(lower, F.lit(w)) for w in words])


def line_class(line: Column) -> Column:
    """Class of a log line; the first class with a matching word wins."""
    result = None
    for name, words in LINE_CLASSES.items():
        hit = any_word(line, words)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise("normal")


def clean_line(line: Column) -> Column:
    """Plain glyphs instead of progress blocks, trimmed."""
    return F.btrim(F.translate(line, GLYPHS, PLAIN), F.lit(BLANK))


def escape_markup(line: Column) -> Column:
    escaped = F.replace(line, F.lit("&"), F.lit("&amp;"))
    escaped = F.replace(escaped, F.lit("<"), F.lit("&lt;"))
    return F.replace(escaped, F.lit(">"), F.lit("&gt;"))
