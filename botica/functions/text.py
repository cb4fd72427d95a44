from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how the price list writes "no value" (with blanks around it).
PLACEHOLDER = "-"


# White space of any script, and the separators that text tools strip with it.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
_PLAIN = r"(?s)\A[!-~](?:.*[!-~])?\z"


def trimmed(column: Column) -> Column:
    """Without white space at either end: blanks, tabs, line ends, no-break spaces.

    Most texts begin and end with a visible ASCII character, which is soon seen.
    """
    return F.when(F.rlike(column, F.lit(_PLAIN)), column).otherwise(F.btrim(column, F.lit(_WHITE)))


def contains_ignoring_case(column: Column, term: str) -> Column:
    """Literal, case-insensitive 'contains': no wildcards, no quoting problems."""
    return F.contains(F.lower(column), F.lower(F.lit(term)))


def like_ignoring_case(column: Column, term: str) -> Column:
    """As above, but ``%`` and ``_`` in the term act as SQL wildcards; a backslash is itself."""
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    return F.like(F.lower(column), F.lower(F.lit(pattern)))


def is_blank(column: Column) -> Column:
    return F.coalesce(trimmed(column) == "", F.lit(True))


def blank_to_null(column: Column) -> Column:
    """Trimmed text, NULL where nothing is left."""
    return F.nullif(trimmed(column), F.lit(""))


def placeholder_to_null(column: Column) -> Column:
    """``blank_to_null`` that also reads a lone dash as missing."""
    return F.nullif(blank_to_null(column), F.lit(PLACEHOLDER))


def display_name(name: Column, presentation: Column) -> Column:
    """Name and presentation with one blank; NULL if either is NULL."""
    return F.concat(name, F.lit(" "), presentation)
