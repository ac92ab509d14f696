"""Text normalisers as Column expressions.

Everything here compiles to JVM regex expressions inside whole-stage codegen;
no Python runs per row.  The character classes are spelled out explicitly so
that the Java engine, DuckDB's RE2 oracle and Python's ``str`` semantics agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinterra.functions._cols import as_col

# --- fixed values (must equal the reference for identical results) ---------
# Characters that the name normaliser turns into a space, besides "-":
#   " ' ’ ` ( ) [ ] , . ; : ! ?
PUNCT_TO_SPACE = "\"'’`()[],.;:!?"
# A four-digit year starting with 19 or 20, as a whole word, is removed from names.
YEAR_PREFIXES = ("19", "20")
# ---------------------------------------------------------------------------

# Exactly the characters for which Python's ``str.isspace()`` is true.
WS_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Python's ``\w`` for str patterns: letters, numbers and underscore.
WORD_CLASS = r"\p{L}\p{N}_"


def _regex_escape_class(chars: str) -> str:
    return "".join("\\" + ch if ch in r"\[]^-" else ch for ch in chars)


_NORMALIZE_RUN = "[" + "\\-" + _regex_escape_class(PUNCT_TO_SPACE) + WS_CLASS + "]+"
_YEAR_WORD = (
    "(?<![" + WORD_CLASS + "])(?:" + "|".join(YEAR_PREFIXES) + r")\p{Nd}{2}(?![" + WORD_CLASS + "])"
)
_EDGE_WS = "^[" + WS_CLASS + "]+|[" + WS_CLASS + "]+$"


def normalize_text(c, null_as_empty: bool = True) -> Column:
    """Lower-case, hyphen and punctuation to space, collapse whitespace, trim.

    ``null_as_empty=True`` mirrors a direct call on a missing value (``""``);
    ``False`` keeps NULL, as a column map that skips nulls does.
    """
    col = as_col(c)
    out = F.trim(F.regexp_replace(F.lower(col), _NORMALIZE_RUN, " "))
    return F.coalesce(out, F.lit("")) if null_as_empty else out


def clean_name(c, null_as_empty: bool = True) -> Column:
    """Lower-case, remove whole-word years 19xx/20xx, then P1."""
    col = as_col(c)
    return normalize_text(F.regexp_replace(F.lower(col), _YEAR_WORD, ""), null_as_empty)


def light_key(c) -> Column:
    """Strip surrounding whitespace, lower-case, '-' to space (punctuation kept)."""
    col = as_col(c)
    return F.regexp_replace(F.lower(F.regexp_replace(col, _EDGE_WS, "")), "-", " ")


def slugify(c) -> Column:
    """Strip, lower-case, spaces to '-'."""
    col = as_col(c)
    return F.regexp_replace(F.lower(F.regexp_replace(col, _EDGE_WS, "")), " ", "-")


def strip_ws(c) -> Column:
    """Python ``str.strip()`` on a column."""
    return F.regexp_replace(as_col(c), _EDGE_WS, "")


def title_case(c) -> Column:
    """Python ``str.title()``: upper-case a letter following a non-letter, lower the rest.

    Spark's ``initcap`` only splits on spaces (``haut-médoc`` -> ``Haut-médoc``);
    ``str.title`` splits on every non-letter (``Haut-Médoc``).  Words are split on
    letter runs with ``regexp_extract_all`` and rebuilt, all JVM-side.
    """
    col = as_col(c)
    pieces = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    titled = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"^\p{L}"),
            F.concat(F.upper(p.substr(F.lit(1), F.lit(1))), F.lower(p.substr(F.lit(2), F.length(p)))),
        ).otherwise(p),
    )
    return F.when(col.isNull(), None).otherwise(F.array_join(titled, ""))
