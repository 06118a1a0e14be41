"""Coercions of loosely typed wire values, over VARIANT and STRING columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.normalize import BLANKS
from gridloom.schemas import HISTORY_CAP, HISTORY_DEFAULT


def field(v: Column, path: str) -> Column:
    """The VARIANT at ``path``; SQL NULL if absent, a variant null if the JSON value is null."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON null), NUMBER; NULL if absent."""
    head = F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    return F.when(head.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN", "VOID"), head).when(v.isNotNull(), F.lit("NUMBER"))


def text_of(v: Column) -> Column:
    """String form of a scalar; NULL for JSON null and absent values."""
    return F.try_variant_get(v, "$", "string")


def unwrap(v: Column) -> Column:
    """One level of {value: ...} removed from an object that has that key."""
    inner = F.try_variant_get(v, "$.value", "variant")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object & inner.isNotNull(), inner).otherwise(v)


def hex_text(h: Column) -> Column:
    """Hexadecimal text to UTF-8 text: decoding stops at the first pair that is not hexadecimal, trailing NULs go."""
    good = F.regexp_extract(h, r"^(?:[0-9a-fA-F]{2})*", 0)
    return F.regexp_replace(F.decode(F.unhex(good), "UTF-8"), r"\x00+$", "")


def symbol(raw: Column) -> Column:
    """A symbol, already unwrapped: plain text or {sym: hex}; anything else ''. ``raw`` should be a plain column."""
    k = F.regexp_extract(F.schema_of_variant(raw), r"^[A-Z]+", 0)
    return F.when(k == "STRING", text_of(raw)).when(k == "OBJECT", F.coalesce(hex_text(F.try_variant_get(raw, "$.sym", "string")), F.lit(""))).otherwise(F.lit(""))


def address_of(raw: Column) -> Column:
    """An address, already unwrapped: plain text or {address: text}; anything else ''. ``raw`` should be a plain column."""
    k = F.regexp_extract(F.schema_of_variant(raw), r"^[A-Z]+", 0)
    return F.when(k == "STRING", text_of(raw)).when(k == "OBJECT", F.coalesce(F.try_variant_get(raw, "$.address", "string"), F.lit(""))).otherwise(F.lit(""))


def number_text(s: Column) -> Column:
    """DOUBLE of a text as a lenient script language reads it: blank is 0, exponents and 0x are read, junk is NULL."""
    t = F.trim(s, F.lit(BLANKS))
    dec = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    hexa = t.rlike(r"^0[xX][0-9a-fA-F]{1,15}$")
    return F.when(t == "", F.lit(0.0)).when(dec, t.try_cast("double")).when(hexa, F.conv(F.substring(t, 3, 15), 16, 10).try_cast("double"))


def number(v: Column) -> Column:
    """DOUBLE of a wire value: null is 0, booleans are 0 and 1, texts as :func:`number_text`; NULL where it isn't a number (absent, objects, arrays).

    ``v`` should be a plain column: it is used several times.
    """
    k = F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    text = F.try_variant_get(v, "$", "string")
    # a number's own text is read like any other; true and false are no numbers as texts
    read = number_text(F.when(k == "BOOLEAN", F.when(text == "true", "1").otherwise("0")).otherwise(text))
    return F.when(k == "VOID", F.lit(0.0)).when(~k.isin("OBJECT", "ARRAY"), read)


def whole(x: Column, clamp: bool = False) -> Column:
    """BIGINT of a DOUBLE that is integral, else NULL. Beyond 64 bits it is NULL too, or with ``clamp`` the nearest there is."""
    integral = x == F.floor(x)
    out = F.when(integral & (F.abs(x) < 9.2e18), x.try_cast("bigint"))
    return out.when((x >= 9.2e18) & (x < float("inf")), F.lit(2**63 - 1)).when((x <= -9.2e18) & (x > float("-inf")), F.lit(-(2**63))) if clamp else out


def integral(x: Column) -> Column:
    """DECIMAL(38,0) of a DOUBLE that is integral and fits, else NULL."""
    return F.when((F.abs(x) >= 2.0**53) | (x == F.floor(x)), x.try_cast("decimal(38,0)"))


def truthy(v: Column) -> Column:
    """False for absent values, null, false, zero and the empty text, as a lenient script language has it."""
    k = kind(v)
    text = text_of(v)
    number = text.try_cast("double")
    return F.coalesce(F.when(k == "VOID", F.lit(False)).when(k == "STRING", text != "").when(k == "BOOLEAN", text == "true").when(k == "NUMBER", number != 0).otherwise(k.isNotNull()), F.lit(False))


def history_limit(raw: str | None) -> int | None:
    """Rows of a history page from a query text: leading integer, 0 and junk give the default, at most the cap; None = unlimited (a negative number)."""
    m = re.match(r"\s*([+-]?\d+)", raw or "")
    n = min((int(m.group(1)) if m else 0) or HISTORY_DEFAULT, HISTORY_CAP)
    return None if n < 0 else n
