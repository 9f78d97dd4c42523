"""Column helpers shared by the operators. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as white space around a field value (U+0000 to U+0020).
CONTROL_CHARS = "".join(chr(code) for code in range(0x21))


def strip_control(text: Column) -> Column:
    """Trim every character up to U+0020 (plain ``trim`` takes spaces only).

    Trimming a set of characters on the right walks the whole text, so it is done only
    where the last byte calls for it.
    """
    chars = F.lit(CONTROL_CHARS)
    left = F.ltrim(text, chars)
    last = F.substring(left.cast("binary"), -1, 1)
    return F.when(last <= F.lit(bytearray(b" ")), F.rtrim(left, chars)).otherwise(left)


def is_blank(text: Column) -> Column:
    """Nothing but characters up to U+0020."""
    return F.ltrim(text, F.lit(CONTROL_CHARS)) == ""


def int_div(num: Column, den: Column) -> Column:
    """Integer division that truncates towards zero; both sides must be whole."""
    return F.call_function("div", num, den)


def int_mean(values: Column) -> Column:
    """Truncated integer mean of a whole-number column within a group, nulls left out."""
    return int_div(F.sum(values), F.count(values))


def half_up_2dp(value: Column) -> Column:
    """Round half up to two places on the binary value, unlike decimal ``round``."""
    return F.floor(value * 100 + 0.5) / 100


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; ``length`` counts code points. All-ASCII texts, one byte
    per character, need no re-encoding."""
    chars = F.length(text).cast("bigint")
    units = int_div(F.length(F.encode(text, "UTF-16BE")).cast("bigint"), F.lit(2).cast("bigint"))
    return F.when(F.octet_length(text) == chars, chars).otherwise(units)


def year_text(epoch_seconds: Column) -> Column:
    """Calendar year in the session time zone as text of at least four digits."""
    year = F.year(F.timestamp_seconds(epoch_seconds))
    text = year.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
