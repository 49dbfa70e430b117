"""Best row per key by one fixed-width sort value, so that the aggregate hashes instead of sorting its input."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import wall_micros

# Decimal digits that hold every value of a type.
DIGITS = {T.BooleanType: 1, T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19, T.DateType: 7,
          T.TimestampType: 18, T.TimestampNTZType: 18}
_FIXED = (*DIGITS, T.FloatType, T.DoubleType, T.DecimalType)
Part = Column | tuple[Column, int]


def _number(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return wall_micros(col)
    return col.cast("int") if isinstance(kind, T.BooleanType) else col


def packed_order(df: DataFrame, order: Sequence[Part]) -> Column:
    """The ``order`` tuple as one number that sorts like it; NULL sorts first, as in a struct.

    A part is a column (whole number, boolean, date or timestamp), or (column, digits) where fewer digits than its type's are known to
    do: a longer value is then an error, never a wrong order. The number is a BIGINT where the tuple fits, else DECIMAL(38,0);
    a tuple that fits neither is an error.
    """
    parts = [p if isinstance(p, tuple) else (p, None) for p in order]
    schema = df.select(*[c.alias(f"_{i}") for i, (c, _) in enumerate(parts)]).schema
    wide = [next((d for t, d in DIGITS.items() if isinstance(f.dataType, t)), None) for f in schema]
    if None in wide:
        raise TypeError(f"cannot pack a part of type {schema[wide.index(None)].dataType.simpleString()}")
    digits = [min(w, given or w) for w, (_, given) in zip(wide, parts)]
    size = 1
    for d in digits:
        size *= 2 * 10 ** d
    if size >= 10 ** 38:
        raise ValueError(f"{digits} digits do not fit one value; state fewer for some part")
    kind = "bigint" if size < 2 ** 63 else "decimal(38,0)"
    literal = (lambda n: F.lit(n).cast("bigint")) if kind == "bigint" else (lambda n: F.lit(Decimal(n)).cast(kind))
    packed = None
    for (col, _), field, d, w in zip(parts, schema, digits, wide):
        value = _number(col, field.dataType).cast(kind if kind != "bigint" or d == w else "decimal(38,0)")
        if d < w:
            fits = (value > -F.lit(Decimal(10 ** d))) & (value < F.lit(Decimal(10 ** d)))
            value = F.when(fits | value.isNull(), value).otherwise(F.raise_error(F.lit(f"order value has more than {d} digits"))).cast(kind)
        digit = F.coalesce(value + literal(10 ** d), literal(0))      # 0 is NULL, the values are 1 to 2 * 10^d - 1
        packed = digit if packed is None else packed * literal(2 * 10 ** d) + digit
        packed = packed.cast(kind)
    return packed


def latest_per_key_packed(df: DataFrame, keys: Sequence[str], order: Sequence[Part], row_id: str,
                          payload: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys``: the row whose ``order`` tuple is greatest, as ``latest_per_key`` gives it.

    The tuple becomes one fixed-width value (:func:`packed_order`), and payload columns of fixed width are taken by it in the same
    aggregate: all buffers have a fixed width, so Spark hashes where ``latest_per_key`` sorts its input. Text and nested payload
    is fetched afterwards by ``row_id``, a never-null column that is unique in ``df``: the winners' ids meet ``df`` in a join that reads only
    those columns, broadcast by adaptive execution where the winners are few. Use it where such payload is wide or absent; with a
    narrow text and about as many keys as rows, ``latest_per_key`` shuffles less. Give a unique column last in ``order``; NULL keys
    are a key.
    """
    payload = list(payload) if payload is not None else [c for c in df.columns if c not in keys]
    fixed = [c for c in payload if isinstance(df.schema[c].dataType, _FIXED)]
    far = [c for c in payload if c not in fixed]
    got = {c: f"_p{i}" for i, c in enumerate(dict.fromkeys([*fixed, *([row_id] if far else [])]))}
    value = df.select(*[F.col(k) for k in keys], *[F.col(c).alias(a) for c, a in got.items()], packed_order(df, order).alias("_order"))
    best = value.groupBy(*keys).agg(F.max("_order").alias("_top"), *[F.max_by(a, "_order").alias(a) for a in got.values()])
    if not far:
        return best.select(*keys, *[F.col(got[c]).alias(c) for c in payload])
    text = {c: f"_t{i}" for i, c in enumerate(far)}
    rest = df.select(F.col(row_id).alias("_row"), *[F.col(c).alias(a) for c, a in text.items()])
    return best.join(rest, F.col(got[row_id]) == F.col("_row")) \
        .select(*keys, *[F.col({**got, **text}[c]).alias(c) for c in payload])
