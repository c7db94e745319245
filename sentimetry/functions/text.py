"""Column-level text functions (O21–O27, O37–O39).  All JVM built-ins, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.  `\z` (not `$`) marks the true end of the text so Java and
# RE2 agree; `\p{L}` is any letter in both engines.
CLEAN_PATTERN = r"(^')|('s\z)|[^\p{L}+ \t]"
TOKEN_SPLIT = r"[ \t+]+"
SENTENCE_SPLIT = r"[.!?]+\s+"
ASCII_PUNCT = r"[!-/:-@\[-`{-~]"
NON_ASCII = r"[^\x00-\x7F]"
WHITESPACE_RUN = r"[ \t\n\r\f]+"
DIGITS = r"[0-9]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_lower(c) -> Column:
    """O21."""
    return F.lower(_c(c))


POSSESSIVE_END = r"'s\z"
NOT_LETTER = r"[^\p{L}+ \t]"


def text_clean(c) -> Column:
    """Blank out a leading quote, a final possessive and every character
    that is not a letter, ``+`` or a blank; then lower-case.

    Same result as one pass with ``CLEAN_PATTERN``, in two cheaper passes: a
    quote is never a letter, so the leading-quote branch is covered by the
    character class and only the final ``'s`` needs its own pattern (a single
    character class scans several times faster than the alternation)."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(c), POSSESSIVE_END, " "), NOT_LETTER, " "))


def text_to_ascii(c) -> Column:
    """Drop non-ASCII characters."""
    return F.regexp_replace(_c(c), NON_ASCII, "")


# Fixed value: the 32 ASCII punctuation characters (POSIX [:punct:]).
ASCII_PUNCT_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip_punctuation(c) -> Column:
    """Delete ASCII punctuation (a character map, no regex)."""
    return F.translate(_c(c), ASCII_PUNCT_CHARS, "")


def collapse_whitespace(c) -> Column:
    """Runs of whitespace become one blank."""
    return F.regexp_replace(_c(c), WHITESPACE_RUN, " ")


def remove_numbers(c) -> Column:
    """O27 (first half): delete digits (a character map, no regex)."""
    return F.translate(_c(c), "0123456789", "")


def split_tokens(c, pattern: str = TOKEN_SPLIT) -> Column:
    """Split on the token separator and drop empty strings (array<string>)."""
    return F.filter(F.split(_c(c), pattern), lambda t: t != "")


def drop_words(arr, words: list[str]) -> Column:
    """O26 on a token array: remove every element found in ``words``."""
    if not words:
        return _c(arr)
    return F.filter(_c(arr), lambda t: ~t.isin(list(words)))


def remove_words(c, words: list[str]) -> Column:
    """O26 on a text: split on blanks, drop listed words, join again."""
    return F.array_join(drop_words(F.split(_c(c), " "), words), " ")


def nonblank_runs(c) -> Column:
    """Number of ``\\S+`` runs (document length)."""
    return F.regexp_count(_c(c), F.lit(r"\S+"))


def month_key(c) -> Column:
    """``yyyy-MM`` text of a date."""
    return F.date_format(_c(c), "yyyy-MM")


def month_start(c) -> Column:
    """First day of the month."""
    return F.trunc(_c(c), "month")


def nth_word(c, n: int) -> Column:
    """N-th blank-separated word cast to int (NULL when not a number)."""
    return F.try_element_at(F.split(_c(c), " "), F.lit(n)).try_cast("int")


def period_bucket(c, by: str) -> Column:
    """Day / week / month / year period of a date (first day)."""
    by = by.lower()
    if by == "day":
        return _c(c).cast("date")
    if by in ("week", "month", "year"):
        return F.date_trunc(by, _c(c)).cast("date")
    raise ValueError(f"unknown period {by!r}; use day, week, month or year")


def period_index(c, by: str) -> Column:
    """Integer index of a period; consecutive periods differ by one."""
    by = by.lower()
    d = _c(c)
    if by == "day":
        return F.datediff(d, F.lit("1970-01-01").cast("date"))
    if by == "week":
        return F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7).cast("int")
    if by == "month":
        return F.year(d) * 12 + F.month(d) - 1
    if by == "year":
        return F.year(d)
    raise ValueError(f"unknown period {by!r}")


def period_from_index(idx, by: str) -> Column:
    """Inverse of :func:`period_index`."""
    by = by.lower()
    i = _c(idx)
    if by == "day":
        return F.date_add(F.lit("1970-01-01").cast("date"), i.cast("int"))
    if by == "week":
        return F.date_add(F.lit("1970-01-05").cast("date"), (i * 7).cast("int"))
    if by == "month":
        return F.make_date(F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"), F.lit(1))
    if by == "year":
        return F.make_date(i.cast("int"), F.lit(1), F.lit(1))
    raise ValueError(f"unknown period {by!r}")
