"""Reading the ledger's text fields: addresses, integer texts, resource types, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v"
#: From here on an epoch value is taken as milliseconds (in seconds it would lie beyond the year 5000).
MILLISECONDS_FROM = 100_000_000_000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def address(c: Column | str) -> Column:
    """Upper case, without surrounding blanks. NULL stays NULL, an undecodable address stays ''."""
    return F.upper(F.trim(_c(c), F.lit(BLANKS)))


def resource(c: Column | str) -> Column:
    """Upper case, words joined by '_'. NULL, blank and 'UNKNOWN' all give 'UNKNOWN'."""
    s = F.regexp_replace(F.upper(F.trim(_c(c), F.lit(BLANKS))), r"[\s\-_]+", "_")
    return F.when(s.isNull() | (s == ""), F.lit("UNKNOWN")).otherwise(s)


def integer_text(c: Column | str, blank: int | None = None) -> Column:
    """DECIMAL(38,0) of a base-10 or 0x text, surrounding blanks and a sign allowed.

    Anything else is unreadable and gives NULL: fractions, exponents, thousands separators, words, more than 38 digits,
    more than 15 hexadecimal digits. ``blank`` is the value of an empty text (NULL by default).
    """
    s = F.trim(_c(c), F.lit(BLANKS))
    dec = s.rlike(r"^[+-]?[0-9]+$")
    hexa = s.rlike(r"^0[xX][0-9a-fA-F]{1,15}$")
    out = F.when(dec, s.try_cast("decimal(38,0)")).when(hexa, F.conv(F.substring(s, 3, 15), 16, 10).try_cast("decimal(38,0)"))
    return out if blank is None else out.when(s == "", F.lit(blank).cast("decimal(38,0)"))


def integer64(c: Column | str) -> Column:
    """As :func:`integer_text`, as BIGINT; values outside 64 bits count as unreadable."""
    s = F.trim(_c(c), F.lit(BLANKS))
    dec = s.rlike(r"^[+-]?[0-9]+$")
    hexa = s.rlike(r"^0[xX][0-9a-fA-F]{1,15}$")
    return F.when(dec, s.try_cast("bigint")).when(hexa, F.conv(F.substring(s, 3, 15), 16, 10).try_cast("bigint"))


def integer_prefix(c: Column | str) -> Column:
    """BIGINT of the integer a text begins with, as an untyped store casts texts: the longest prefix of sign and digits, 0 without one, the nearest value beyond 64 bits. NULL stays NULL."""
    s = F.regexp_extract(F.ltrim(_c(c), F.lit(BLANKS)), r"^[+-]?[0-9]+", 0)
    digits = F.regexp_replace(s, r"^[+-]?0*", "")
    negative = s.startswith("-")
    fits = F.length(digits) <= 19
    value = F.coalesce(F.when(fits, F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits).try_cast("bigint")), F.when(digits == "", F.lit(0)).when(negative, F.lit(-(2**63))).otherwise(F.lit(2**63 - 1)))
    return F.when(_c(c).isNotNull(), value.cast("bigint"))


def epoch_seconds(c: Column | str) -> Column:
    """Epoch seconds; milliseconds are recognised by size, zero, negative and NULL give NULL."""
    t = _c(c)
    return F.when(t >= MILLISECONDS_FROM, F.floor(t / 1000).cast("bigint")).when(t > 0, t)


def epoch_day(c: Column | str) -> Column:
    """Days since 1970-01-01 (UTC) of a valid epoch-seconds column, as INT."""
    return F.floor(_c(c) / 86400).cast("int")
