"""Hashes as column expressions over the UTF-8 bytes of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 32 bits.
OFFSET32, PRIME32 = 0x811C9DC5, 0x01000193


def byte_values(text: Column) -> Column:
    """The bytes of a text as an array of long."""
    digits = F.hex(F.encode(text, "UTF-8"))
    size = F.octet_length(text)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a, 32 bits, as a long; products stay below 2^57, so nothing overflows."""
    return F.aggregate(byte_values(text), F.lit(OFFSET32).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(PRIME32)) % F.lit(2**32))


def token_hash16(text: Column) -> Column:
    """FNV-1a folded to 16 bits."""
    h = fnv1a32(text)
    return h.bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(F.lit(0xFFFF))
