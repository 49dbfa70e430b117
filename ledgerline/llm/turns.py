"""Turns of conversations: the order of rows that the conversation operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: str) -> Column:
    """16 bytes of a SHA-256 over columns, told apart by their lengths; NULL counts as empty text."""
    texts = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    sized = F.concat_ws(":", *[F.char_length(t).cast("string") for t in texts], *texts)
    return F.substring(F.unhex(F.sha2(sized, 256)), 1, 16)


def decimal_crc(*parts: Column) -> Column:
    """Unsigned CRC-32 of columns as text joined by a colon; NULL is one space."""
    return F.crc32(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit(" ")) for p in parts]))
