"""JSON-in-text fields.

``json_str`` returns the unquoted text of a path (NULL for a JSON null or a missing path).
``json_present`` tells a JSON null (present) from a missing key, as the source's
``JSON_EXTRACT(...) IS NOT NULL`` does; it uses Spark's Variant type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_str(col: Column, path: str) -> Column:
    return F.get_json_object(col, path)


def json_decimal(col: Column, path: str, precision: int = 10, scale: int = 0) -> Column:
    """CAST(JSON_EXTRACT(...) AS DECIMAL(p, s)); unparsable text gives NULL."""
    return F.get_json_object(col, path).try_cast(f"decimal({precision},{scale})")


def json_present(col: Column, path: str) -> Column:
    """True when the path exists in the document, even if its value is JSON null."""
    return F.try_variant_get(F.try_parse_json(col), path, "variant").isNotNull()


def parse(col: Column) -> Column:
    """Parse JSON text once into a Variant (NULL when the text is not JSON); read fields from it
    with :func:`field` instead of re-parsing the text for every path."""
    return F.try_parse_json(col)


def field(variant: Column, path: str, kind: str = "string") -> Column:
    """Field of a parsed document as ``kind`` (unquoted text by default); NULL when missing or
    JSON null."""
    return F.try_variant_get(variant, path, kind)


def field_present(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "variant").isNotNull()
