"""Spelling-insensitive identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space around an id.
BLANKS = " \t\n\x0b\f\r"


def uuid_hex(c: Column) -> Column:
    """32 lower-case hex digits of a freely spelled UUID; NULL for anything that is not one.

    Outer white space, letter case, hyphens, one pair of braces and a leading ``urn:uuid:`` are ignored.
    """
    s = F.trim(F.lower(c), F.lit(BLANKS))
    s = F.when(s.startswith("urn:uuid:"), F.substring(s, 10, 1000)).otherwise(s)
    s = F.when(s.startswith("{") & s.endswith("}"), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    s = F.translate(F.when(s.startswith("urn:uuid:"), F.substring(s, 10, 1000)).otherwise(s), "-", "")
    return F.when((F.length(s) == 32) & (F.translate(s, "0123456789abcdef", "") == ""), s)


def canonical_uuid(c: Column) -> Column:
    """The id in lower case with hyphens, NULL if the text is not a UUID."""
    h = uuid_hex(c)
    parts = (F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return F.when(h.isNotNull(), F.concat_ws("-", *parts))


def refers_to_something(c: Column) -> Column:
    """False for NULL and for text of white space only."""
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def hex_to_long(h: Column) -> Column:
    """16 hex digits as a BIGINT whose signed order equals the unsigned order of the digits."""
    top = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(top, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(2**63)).cast("bigint"))
