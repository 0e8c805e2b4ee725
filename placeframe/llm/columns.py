"""Column expressions shared by the text operators; all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every operator here: blank and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The maximal runs of other characters than white space."""
    return F.array_remove(F.split(text, SPACES), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text, F.lit(SPACE))


def digest(text: Column) -> Column:
    """SHA-256 in 32 bytes: texts and lines with one digest are taken for the same, and nobody can make two that have one."""
    return F.unhex(F.sha2(text, 256))


def hashes(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with fixed seeds, where a key is to be short and equal ones by design do no harm."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]
