"""String tidying shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as blank at the ends of a cell.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def tidy(c: Column) -> Column:
    """Lower case without blanks at the ends: operations, sides, digest spellings."""
    return F.lower(trimmed(c))


def digest_bytes(c: Column) -> Column:
    """The 32 bytes a digest cell names, null if it isn't 64 hex digits."""
    t = trimmed(c)
    return F.when((F.length(t) == 64) & t.rlike("^[0-9a-fA-F]+$"), F.unhex(t))


def whole_division(a: Column, b: Column) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, b)
