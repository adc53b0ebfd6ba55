"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 4122 namespace for URLs.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a string column."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant_bits = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant_bits)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
