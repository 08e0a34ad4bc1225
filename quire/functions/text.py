"""Scalar column helpers (all JVM-side built-ins, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the studied application's behaviour.
ROLES = ("editor", "leitor")          # closed role list, editor first = default
DEFAULT_ROLE = "editor"
READER_ROLE = "leitor"
UNKNOWN_AUTHOR = "desconhecido"       # author when the actor has no profile
FALLBACK_LOCAL = "pessoa"             # name source when a user has no e-mail
BLANK_LABEL = "(vazio)"               # label shown for an empty field
LOAD_LABEL = "carga inicial"          # author stamped by a full reload
EMAIL_PATTERN = r"^[^@\s]+@[^@\s.]+\.[^@\s]+$"     # as written for JavaScript
# JavaScript's \s (and String.prototype.trim) covers every Unicode space; the
# JVM's \s only ASCII ones, so JS patterns are run with this class instead.
JS_S = r"\s\p{Z}\x{FEFF}"
JS_SPACE = rf"[{JS_S}]"
EMAIL_REGEX = EMAIL_PATTERN.replace(r"\s", JS_S)
WORD_PIECES = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """JS ``trim()``: strips all leading/trailing white space."""
    return F.regexp_replace(col(c), rf"^{JS_SPACE}+|{JS_SPACE}+$", "")


def sql_trim(c) -> Column:
    """SQL ``trim()``: strips spaces only."""
    return F.trim(col(c))


def pg_initcap(c) -> Column:
    """Postgres ``initcap``: a word starts after any non-alphanumeric char.

    Spark's ``initcap`` splits on white space only; this splits the lower-cased
    text into alternating alphanumeric / other runs and upper-cases the first
    character of each run.
    """
    pieces = F.regexp_extract_all(F.lower(col(c)), F.lit(WORD_PIECES), 1)
    caps = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.array_join(caps, "")


def blank_label(c, label: str = BLANK_LABEL) -> Column:
    """``coalesce(nullif(x, ''), label)``; a numeric 0 stays '0'."""
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit(label))


def normalise_email(c) -> Column:
    return F.lower(js_trim(c))


def email_is_valid(c) -> Column:
    """The admin API's e-mail test on the JS-trimmed value; NULL is invalid."""
    return F.coalesce(js_trim(c).rlike(EMAIL_REGEX), F.lit(False))


def local_part(c) -> Column:
    """JS ``email.split('@')[0]`` / SQL ``split_part(email, '@', 1)``."""
    return F.split_part(col(c), F.lit("@"), F.lit(1))


def role_or_default(c) -> Column:
    """Exact, case-sensitive membership; anything else becomes editor."""
    return F.when(col(c).isin(*ROLES), col(c)).otherwise(F.lit(DEFAULT_ROLE))


def role_from_meta(c) -> Column:
    """Trigger rule: reader iff lower(trim(role)) = 'leitor', else editor."""
    return F.when(F.lower(F.trim(F.coalesce(col(c), F.lit("")))) == READER_ROLE,
                  F.lit(READER_ROLE)).otherwise(F.lit(DEFAULT_ROLE))


def date_text(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def iso_text(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def distinct_from(a, b) -> Column:
    """``a IS DISTINCT FROM b``."""
    return ~col(a).eqNullSafe(col(b))
