"""Text Column builders: keyword containment, term lists, redaction."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def article_text(title="title", summary="summary") -> Column:
    """Lower-cased ``"title summary"`` with missing parts as empty strings."""
    return F.lower(F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(summary), F.lit(""))))


def has(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word))


def any_of(text: Column, words: Iterable[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | has(text, w)
    return cond


def count_of(text: Column, words: Sequence[str]) -> Column:
    """Number of list entries found in ``text`` (a multiset counts twice)."""
    total = F.lit(0)
    for w in words:
        total = total + has(text, w).cast("int")
    return total


def redact(text) -> Column:
    """Replace CPF, phone and e-mail patterns."""
    out = _c(text)
    out = F.regexp_replace(out, P.CPF_PATTERN, P.CPF_REPLACEMENT)
    out = F.regexp_replace(out, P.PHONE_PATTERN, P.PHONE_REPLACEMENT)
    out = F.regexp_replace(out, P.EMAIL_PATTERN, P.EMAIL_REPLACEMENT)
    return out


def mask(text, terms: Sequence[str] = P.PROHIBITED_TERMS, replacement: str = P.MASK_TEXT) -> Column:
    """Case-insensitive literal replacement of every term."""
    out = _c(text)
    for t in terms:
        out = F.regexp_replace(out, "(?i)\\Q" + t + "\\E", replacement)
    return out


def truncate(text, max_chars: int = P.SUMMARY_MAX_CHARS) -> Column:
    t = _c(text)
    return F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit("..."))).otherwise(t)


def pii_hit(text) -> Column:
    t = _c(text)
    return t.rlike(P.CPF_PATTERN) | t.rlike(P.PHONE_PATTERN) | t.rlike(P.EMAIL_PATTERN)
