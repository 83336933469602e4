"""Hashes of text that other systems make as well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The start and the factor of the 32-bit hash.
START, FACTOR = 2166136261, 16777619


def fnv1a(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes, 32 bits; null for null."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.filter(F.sequence(F.lit(1), F.length(digits) + 1, F.lit(2)), lambda i: i < F.length(digits))
    step = lambda h, i: F.pmod(h.bitwiseXOR(F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("long")) * FACTOR, F.lit(2**32))
    return F.when(text.isNotNull(), F.aggregate(places, F.lit(START).cast("long"), step))
