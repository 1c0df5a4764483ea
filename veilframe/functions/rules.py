"""Pattern rules for e-mail addresses and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns whose matches are entities.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
EMAIL_AT = r"(?i)\b[A-Za-z0-9._%+-]+\.at\.[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)(?:(?:\+?\d{1,3}[\s().-]*)?(?:\(?\d{3}\)?[\s().-]*)?\d{3}[\s.-]?\d{4})"
MIN_PHONE_DIGITS = 7


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def emails(text: Column) -> Column:
    """Matches in order; texts without @ skip the pattern."""
    return F.when(F.contains(text, F.lit("@")), _all(text, EMAIL)).otherwise(F.array().cast("array<string>"))


def emails_at(text: Column) -> Column:
    """Addresses written with .at. for @."""
    return F.when(F.contains(F.lower(text), F.lit(".at.")), _all(text, EMAIL_AT)).otherwise(F.array().cast("array<string>"))


def phones(text: Column) -> Column:
    trimmed = F.transform(_all(text, PHONE), lambda m: F.btrim(m))
    return F.filter(trimmed, lambda m: F.length(F.regexp_replace(m, r"(?U)\D", "")) >= MIN_PHONE_DIGITS)


def looks_like_email(text: Column) -> Column:
    t = F.btrim(text)
    return t.rlike(f"^(?:{EMAIL})\\z") | t.rlike(f"^(?:{EMAIL_AT})\\z")


def noise(entity_id: Column, text: Column) -> Column:
    """Structured entities that are none: a bare top-level domain, a malformed address."""
    bare = F.upper(entity_id).rlike("LINK|URL") & F.btrim(text).rlike("(?i)^[a-z]{2,6}\\z")
    return bare | ((F.upper(entity_id) == "EMAIL") & ~looks_like_email(text))
