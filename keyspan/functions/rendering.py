"""Text forms of values: grid text (search), flat text (CSV, XML) and wire text (JSON)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType)


def number_text(c: Column) -> Column:
    """A double as the shortest decimal text without exponent between 1e-6 and 1e21."""
    raw = c.cast("string")
    size = F.abs(c)

    def trim(text: Column) -> Column:
        return F.regexp_replace(text, r"\.?0+$", "")

    return (
        F.when(size == 0, F.lit("0"))
        .when((size >= 1e-3) & (size < 1e7), F.regexp_replace(raw, r"\.0$", ""))
        .when((size >= 1e7) & (size < 1e21), trim(raw.try_cast("decimal(38,17)").cast("string")))
        .when((size >= 1e-6) & (size < 1e-3), trim(raw.try_cast("decimal(38,30)").cast("string")))
        .otherwise(
            F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit(".0E"), F.lit("E")), r"E(?=\d)", "e+"), "E-", "e-")
        )
    )


def grid_text(c: Column, dtype: T.DataType) -> Column:
    """The text a person sees in a result grid. Null shows as ``null``."""
    if isinstance(dtype, T.StringType):
        body = c
    elif isinstance(dtype, T.BinaryType):
        body = blob_text(c)
    elif isinstance(dtype, _FRACTION):
        body = number_text(c)
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x: grid_text(x, dtype.elementType))
        body = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        pairs = F.transform(
            F.map_entries(c),
            lambda e: F.concat(
                grid_text(e["key"], dtype.keyType), F.lit(": "), grid_text(e["value"], dtype.valueType)
            ),
        )
        body = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(dtype, T.StructType):
        parts = [
            F.concat(F.lit(f.name + ": "), grid_text(c[f.name], f.dataType)) for f in dtype.fields
        ]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
        if is_tuple(dtype):
            items = [grid_text(c[f.name], f.dataType) for f in dtype.fields]
            body = F.concat(F.lit("["), F.concat_ws(", ", *items), F.lit("]"))
        body = F.when(c.isNotNull(), body)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        body = timestamp_text(c)
    else:
        body = c.cast("string")
    return F.coalesce(body, F.lit("null"))


def timestamp_text(c: Column) -> Column:
    """ISO-8601 with as many fraction digits as the value has, in the session zone (UTC)."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(
        F.concat(
            F.lit("."),
            F.when(F.substring(micros, 4, 3) == "000", F.substring(micros, 1, 3)).otherwise(micros),
        )
    )
    return F.concat(whole, fraction, F.lit("Z"))


def blob_text(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def _json_ready(c: Column, dtype: T.DataType, wire: bool) -> Column:
    """A value reshaped so that ``to_json`` writes the wanted form of it."""
    if isinstance(dtype, T.BinaryType):
        return F.base64(c) if wire else blob_text(c)
    if wire and isinstance(dtype, (T.LongType, T.DecimalType)):
        return c.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _json_ready(x, dtype.elementType, wire))
    if isinstance(dtype, T.MapType):
        entries = F.map_entries(c)
        if isinstance(dtype.keyType, T.StringType):
            return F.map_from_entries(
                F.transform(
                    entries,
                    lambda e: F.struct(e["key"], _json_ready(e["value"], dtype.valueType, wire)),
                )
            )
        if wire:
            return F.transform(
                entries,
                lambda e: F.struct(
                    _json_ready(e["key"], dtype.keyType, wire).alias("key"),
                    _json_ready(e["value"], dtype.valueType, wire).alias("value"),
                ),
            )
        return F.map_from_entries(
            F.transform(
                entries,
                lambda e: F.struct(
                    _json_ready(e["key"], dtype.keyType, wire).cast("string"),
                    _json_ready(e["value"], dtype.valueType, wire),
                ),
            )
        )
    if isinstance(dtype, T.StructType):
        return F.when(
            c.isNotNull(),
            F.struct(*[_json_ready(c[f.name], f.dataType, wire).alias(f.name) for f in dtype.fields]),
        )
    return c


_KEEP_NULLS = {"ignoreNullFields": "false"}


def is_tuple(dtype: T.DataType) -> bool:
    """A struct with fields ``_1``, ``_2``, .. stands for a tuple."""
    if not isinstance(dtype, T.StructType) or not dtype.fields:
        return False
    return [f.name for f in dtype.fields] == [f"_{i + 1}" for i in range(len(dtype.fields))]


def _holds_tuple(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_tuple(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_tuple(dtype.keyType) or _holds_tuple(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return is_tuple(dtype) or any(_holds_tuple(f.dataType) for f in dtype.fields)
    return False


def json_text(c: Column, dtype: T.DataType, wire: bool) -> Column:
    """A value as JSON text. Tuples are arrays of mixed types, which ``to_json`` cannot write, so
    values that hold one are put together from the texts of their parts."""
    if not _holds_tuple(dtype):
        # The text of a list of one, without its brackets, is the text of any value.
        listed = F.to_json(F.array(_json_ready(c, dtype, wire)), _KEEP_NULLS)
        return F.substr(listed, F.lit(2), F.length(listed) - 2)
    if isinstance(dtype, T.ArrayType):
        parts = F.array_join(F.transform(c, lambda x: json_text(x, dtype.elementType, wire)), ",")
        body = F.concat(F.lit("["), parts, F.lit("]"))
    elif isinstance(dtype, T.MapType):
        pairs = F.transform(
            F.map_entries(c),
            lambda e: F.concat(
                json_text(e["key"].cast("string"), T.StringType(), wire), F.lit(":"),
                json_text(e["value"], dtype.valueType, wire),
            ),
        )
        body = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    else:
        fields = [json_text(c[f.name], f.dataType, wire) for f in dtype.fields]
        if is_tuple(dtype):
            body = F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]"))
        else:
            body = _object_text([f.name for f in dtype.fields], fields)
    return F.when(c.isNull(), F.lit("null")).otherwise(body)


def _object_text(names: list[str], values: list[Column]) -> Column:
    members = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), v) for n, v in zip(names, values)]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def flat_text(c: Column, dtype: T.DataType) -> Column:
    """Flat text of one cell for text formats. Null stays null; nested values become JSON."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BinaryType):
        return blob_text(c)
    if _holds_tuple(dtype):
        return F.when(c.isNotNull(), json_text(c, dtype, wire=False))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(_json_ready(c, dtype, wire=False), _KEEP_NULLS)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c)
    return c.cast("string")


def render_text(df: DataFrame) -> DataFrame:
    """Every column as flat text."""
    return df.select([flat_text(F.col(_q(f.name)), f.dataType).alias(f.name) for f in df.schema])


def render_wire(df: DataFrame) -> DataFrame:
    """Every column in wire form: 64-bit and larger numbers as text, blobs as base64, maps with
    other than text keys as lists of pairs."""
    return df.select(
        [_json_ready(F.col(_q(f.name)), f.dataType, wire=True).alias(f.name) for f in df.schema]
    )


def row_json(df: DataFrame, wire: bool = True, pretty: bool = False) -> Column:
    """One JSON document per row, columns in order, nulls written out."""
    if any(_holds_tuple(f.dataType) for f in df.schema):
        texts = [json_text(F.col(_q(f.name)), f.dataType, wire) for f in df.schema]
        return _object_text(df.columns, texts)
    options = dict(_KEEP_NULLS, **({"pretty": "true"} if pretty else {}))
    fields = [_json_ready(F.col(_q(f.name)), f.dataType, wire).alias(f.name) for f in df.schema]
    return F.to_json(F.struct(*fields), options)


def key_text(keys: list[str]) -> Column:
    """Text of a partition key: the value itself, or ``(a, b)`` for several columns."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]
    if len(parts) == 1:
        return parts[0]
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
