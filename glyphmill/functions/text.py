"""Scalar text and array expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a quoted label, and as a blank.
LABEL_PATTERN = '"([^"]*)"'
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Text without blanks of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def stripped_equal(a: Column, b: Column) -> Column:
    return stripped(a) == stripped(b)


def preview(text: Column, width: int = 70) -> Column:
    return F.left(F.replace(text, F.lit("\n"), F.lit(" \\n ")), F.lit(width))


def labels_of(code: Column) -> Column:
    """All quoted labels in order."""
    return F.regexp_extract_all(code, F.lit(LABEL_PATTERN), F.lit(1))


def structure_of(code: Column) -> Column:
    """Text with its labels blanked."""
    return F.regexp_replace(code, LABEL_PATTERN, '""')


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def class_of(path: Column) -> Column:
    """Class folder of a file."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def split_of(path: Column) -> Column:
    """Split folder above the class folder."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1)


def clock(seconds: Column) -> Column:
    """``h:mm:ss`` or ``m:ss`` of whole seconds; negative time counts as none."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0).cast("bigint"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def png_header(content: Column) -> dict[str, Column]:
    """Width, height and wholeness of a PNG, read from its bytes.

    Signature and end marker are fixed values of the format.
    """
    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")

    signed = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    ended = F.hex(F.substring(content, -8, 8)) == "49454E44AE426082"
    whole = F.coalesce(signed & ended, F.lit(False))
    return {"width": F.when(signed, number(17)), "height": F.when(signed, number(21)), "whole": whole}
