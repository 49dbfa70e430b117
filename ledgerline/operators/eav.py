"""Entity-attribute-value lookups: all wanted attributes of a value table in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attribute_ids(attributes: DataFrame, wanted: Mapping[str, tuple[str, int]]) -> DataFrame:
    """``(attribute_id, attribute)`` of each wanted ``name -> (code, entity type)`` that exists: at most one row a name.

    The source looks an attribute up with a scalar subquery, so a code and type that two attributes share are an error.
    """
    rows = attributes.select("attribute_id", F.explode(F.array(*[
        F.when((F.col("attribute_code") == code) & (F.col("entity_type_id") == kind), F.lit(name)) for name, (code, kind) in wanted.items()
    ])).alias("attribute")).where(F.col("attribute").isNotNull())
    one = rows.groupBy("attribute").agg(F.min("attribute_id").alias("attribute_id"), F.count(F.lit(1)).alias("_n"))
    several = F.raise_error(F.concat(F.lit("more than one attribute for "), F.col("attribute")))
    return one.select(F.when(F.col("_n") > 1, several.cast(rows.schema["attribute_id"].dataType)).otherwise(F.col("attribute_id")).alias("attribute_id"), "attribute")


def eav_values(values: DataFrame, ids: DataFrame, names: Sequence[str], *, store: int = 0, key: str = "row_id") -> DataFrame:
    """``(key, *names)``: one row for each entity that has any of the attributes, NULL where it lacks one.

    ``ids``: the result of :func:`attribute_ids`, which may hold other attributes too; its rows are as few as its wanted names, so
    it is broadcast (once for all value tables of a report). One scan of ``values``, one aggregate with a map-side step.
    """
    mine = values.where(F.col("store_id") == store).join(F.broadcast(ids), "attribute_id").where(F.col("attribute").isin(*names))
    return mine.groupBy(key).agg(*[F.max(F.when(F.col("attribute") == n, F.col("value"))).alias(n) for n in names])
