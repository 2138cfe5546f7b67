"""Text to typed values: one expression per column, null where the text is no such value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.model import Codec, KeyspanError

# Scalar type names and the Spark type each one is held in.
SCALARS = {
    "text": "string", "varchar": "string", "ascii": "string",
    "int": "int", "smallint": "smallint", "tinyint": "tinyint", "bigint": "bigint", "counter": "bigint",
    "varint": "string", "decimal": "decimal(38,10)", "float": "float", "double": "double",
    "boolean": "boolean", "timestamp": "timestamp", "date": "date", "time": "bigint",
    "duration": "struct<months:int,days:int,nanos:bigint>",
    "uuid": "string", "timeuuid": "string", "inet": "string", "blob": "binary",
}

_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_IPV4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"


def _ipv6() -> str:
    """The IPv6address rule of RFC 3986: eight groups, of which one run may be left out, the last two perhaps an IPv4 address."""
    group, four = "[0-9a-fA-F]{1,4}", _IPV4[1:-1]
    tail = f"({group}:{group}|{four})"
    forms = [f"({group}:){{6}}{tail}", f"::({group}:){{5}}{tail}"]
    forms += [f"(({group}:){{0,{n}}}{group})?::({group}:){{{4 - n}}}{tail}" for n in range(5)]
    forms += [f"(({group}:){{0,5}}{group})?::{group}", f"(({group}:){{0,6}}{group})?::"]
    return "^(" + "|".join(forms) + ")$"


_IPV6 = _ipv6()
_TIME = r"^([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:\.(\d{1,9}))?)?$"
_FLOAT = r"(?i)^([+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|[+-]?inf(inity)?)$"
_GROUPED = r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$"
_RANGES = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63, "counter": 63}


def spark_type(name: str) -> str:
    """Spark type of a declared type; nested ones are taken apart from the outside."""
    head, inner = _split_type(name)
    if head in SCALARS:
        return f"decimal({inner})" if head == "decimal" and inner else SCALARS[head]
    if head == "frozen":
        return spark_type(inner)
    if head in ("list", "set"):
        return f"array<{spark_type(inner)}>"
    if head == "vector":
        return f"array<{spark_type(inner.rsplit(',', 1)[0])}>"
    if head == "map":
        key, value = _top_level(inner)
        return f"map<{spark_type(key)},{spark_type(value)}>"
    if head == "udt":
        return "struct<" + ",".join(f"{f}:{spark_type(t)}" for f, t in map(_field, _top_level(inner))) + ">"
    if head == "tuple":
        return "struct<" + ",".join(f"_{i + 1}:{spark_type(t)}" for i, t in enumerate(_top_level(inner))) + ">"
    raise KeyspanError(f"unknown type {name}")


# The declared type of a Spark type, for tables made from another source.
_DECLARED = {
    T.StringType: "text", T.IntegerType: "int", T.ShortType: "smallint", T.ByteType: "tinyint", T.LongType: "bigint",
    T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean", T.TimestampType: "timestamp",
    T.TimestampNTZType: "timestamp", T.DateType: "date", T.BinaryType: "blob", T.VarcharType: "text", T.CharType: "text",
}


def declared_type(dtype: T.DataType) -> str:
    """Declared type for a Spark type, the way back from ``spark_type``."""
    if type(dtype) in _DECLARED:
        return _DECLARED[type(dtype)]
    if isinstance(dtype, T.DecimalType):
        return "varint" if dtype.scale == 0 else f"decimal({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.ArrayType):
        return f"list<{declared_type(dtype.elementType)}>"
    if isinstance(dtype, T.MapType):
        return f"map<{declared_type(dtype.keyType)},{declared_type(dtype.valueType)}>"
    if isinstance(dtype, T.StructType):
        return "tuple<" + ",".join(declared_type(f.dataType) for f in dtype.fields) + ">"
    raise KeyspanError(f"no declared type for {dtype.simpleString()}")


def _split_type(name: str) -> tuple[str, str]:
    text = name.strip()
    for left, right in (("<", ">"), ("(", ")")):
        if left in text and text.endswith(right):
            at = text.index(left)
            return text[:at].strip().lower(), text[at + 1 : -1]
    return text.lower(), ""


def _top_level(text: str) -> list[str]:
    out, depth, current = [], 0, ""
    for ch in text:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += ch
    return [*out, current]


def clean(text: Column, codec: Codec) -> Column:
    """The text with the configured null words turned into null."""
    if not codec.null_strings:
        return text
    return F.when(~F.trim(text).isin(list(codec.null_strings)), text)


def _plain_number(text: Column, codec: Codec) -> Column:
    trimmed = F.trim(text)
    if not codec.format_numbers:
        return trimmed
    return F.when(trimmed.rlike(_GROUPED), F.regexp_replace(trimmed, ",", ""))


def _rounded(value: Column, mode: str) -> Column:
    """A decimal brought to a whole number; UNNECESSARY refuses one that has a fraction."""
    whole = F.floor(value)
    if mode == "UNNECESSARY":
        return F.when(value == whole, whole)
    if mode == "FLOOR":
        return whole
    if mode == "CEILING":
        return F.ceil(value)
    if mode == "DOWN":
        return F.when(value < 0, F.ceil(value)).otherwise(whole)
    if mode == "UP":
        return F.when(value < 0, whole).otherwise(F.ceil(value))
    if mode == "HALF_UP":
        return F.round(value, 0)
    if mode == "HALF_EVEN":
        return F.bround(value, 0)
    if mode == "HALF_DOWN":
        size = F.abs(value)
        near = F.when(size - F.floor(size) > 0.5, F.ceil(size)).otherwise(F.floor(size))
        return F.when(value < 0, -near).otherwise(near)
    raise KeyspanError(f"unknown rounding {mode}")


def _integer(text: Column, name: str, codec: Codec) -> Column:
    number = _plain_number(text, codec)
    target = SCALARS[name]
    direct = number.try_cast(target)
    exact = _rounded(number.try_cast("decimal(38,10)"), codec.rounding)
    limit = 2 ** _RANGES[name]
    if codec.overflow == "TRUNCATE":
        # Only a number has bounds: a text that is none, or a fraction that may not be rounded, stays unread.
        exact = F.coalesce(exact.cast("decimal(38,0)"), _huge(number))
        bounded = F.greatest(F.lit(-limit).cast("decimal(38,0)"), F.least(F.lit(limit - 1).cast("decimal(38,0)"), exact.cast("decimal(38,0)")))
        return F.coalesce(direct, F.when(exact.isNotNull(), bounded.cast(target)))
    if codec.rounding == "UNNECESSARY":
        return direct
    return F.coalesce(direct, exact.cast("decimal(38,0)").cast("string").try_cast(target))


def _huge(number: Column) -> Column:
    """A number beyond every bound, with the sign of a whole number of more digits than a decimal holds."""
    beyond = F.when(number.startswith("-"), F.lit("-1" + "0" * 30)).otherwise(F.lit("1" + "0" * 30)).cast("decimal(38,0)")
    return F.when(number.rlike(r"^[+-]?0*[1-9]\d{28,}(\.0*)?$"), beyond)


def _decimal(text: Column, name: str, codec: Codec) -> Column:
    """A decimal that keeps every digit of the text; a rounding mode allows fewer."""
    number, target = _plain_number(text, codec), spark_type(name)
    value = number.try_cast(target)
    if codec.rounding == "HALF_UP":
        return value
    scale = int(target[:-1].split(",")[1]) if "," in target else 0
    if codec.rounding == "UNNECESSARY":
        mantissa = F.regexp_extract(number, r"^[+-]?\d*\.?(\d*?)0*(?:[eE][+-]?\d+)?$", 1)
        exponent = F.coalesce(F.regexp_extract(number, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
        zero = number.rlike(r"^[+-]?[0.]*([eE].*)?$")
        trailing = F.length(F.regexp_extract(number, r"^[+-]?\d*?(0*)(?:\.0*)?(?:[eE]|$)", 1))
        places = F.when(mantissa == "", -trailing).otherwise(F.length(mantissa)) - exponent
        return F.when(zero | (places <= scale), value)
    if scale > 18:
        raise KeyspanError("a rounding mode needs a decimal of at most 18 places")
    wide = number.try_cast("decimal(38,18)") * F.lit(10**scale).cast("decimal(19,0)")
    return (_rounded(wide.cast("decimal(38,10)"), codec.rounding) / F.lit(10**scale).cast("decimal(19,0)")).try_cast(target)


def _boolean(text: Column, codec: Codec) -> Column:
    pairs = [p.split(":") for p in codec.boolean_strings]
    word = F.upper(F.trim(text))
    number = F.trim(text).try_cast("double")
    yes, no = codec.boolean_numbers
    return (
        F.when(word.isin([a.upper() for a, _ in pairs]), True)
        .when(word.isin([b.upper() for _, b in pairs]), False)
        .when(number == yes, True)
        .when(number == no, False)
    )


# Units of a numeric time, in microseconds.
UNITS = {
    "DAYS": 86_400_000_000, "HOURS": 3_600_000_000, "MINUTES": 60_000_000, "SECONDS": 1_000_000,
    "MILLISECONDS": 1_000, "MICROSECONDS": 1,
}


def _timestamp(text: Column, codec: Codec) -> Column:
    trimmed = F.trim(text)
    if codec.timestamp:
        written = F.try_to_timestamp(trimmed, F.lit(codec.timestamp))
    else:
        written = F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}"), trimmed.try_cast("timestamp"))
    if codec.time_zone != "UTC":
        zoned = trimmed.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
        written = F.when(zoned, written).otherwise(F.to_utc_timestamp(written, codec.time_zone))
    count = F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("bigint"))
    epoch = F.unix_micros(F.lit(codec.epoch).cast("timestamp"))
    if codec.unit == "NANOSECONDS":
        micros = F.floor(count / F.lit(1000).cast("decimal(20,0)")).cast("bigint")
    else:
        micros = F.try_multiply(count, F.lit(UNITS[codec.unit]).cast("bigint"))
    return F.coalesce(written, F.timestamp_micros(F.try_add(epoch, micros)))


def _time(text: Column, codec: Codec) -> Column:
    trimmed = F.trim(text)
    if codec.time:
        at = F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), trimmed), F.lit("yyyy-MM-dd " + codec.time))
        return F.unix_micros(at) * 1000
    group = lambda i: F.regexp_extract(trimmed, _TIME, i)
    part = lambda i: F.coalesce(group(i).try_cast("bigint"), F.lit(0))
    nanos = F.rpad(group(4), 9, "0").cast("bigint")
    return F.when(
        trimmed.rlike(_TIME), (part(1) * 3600 + part(2) * 60 + part(3)) * 1_000_000_000 + nanos
    )


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# What a unit of a duration is worth.
_MONTHS = {"y": 12, "mo": 1}
_DAYS = {"w": 7, "d": 1}
_NANOS = {
    "h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "µs": 1_000, "ns": 1,
}


def _duration(text: Column) -> Column:
    """Durations as ``1y2mo3w4d5h6m7s8ms9us10ns`` or ISO ``P1Y2M3DT4H5M6S``."""
    units = r"^-?(\d+y)?(\d+mo)?(\d+w)?(\d+d)?(\d+h)?(\d+m)?(\d+s)?(\d+ms)?(\d+(us|µs))?(\d+ns)?$"
    iso = r"^-?p(\d+y)?(\d+m)?(\d+w)?(\d+d)?(t(\d+h)?(\d+m)?(\d+(\.\d{1,9})?s)?)?$"

    def from_text(low: Column) -> Column:
        # The ISO form is spelled like the other one: its month becomes ``mo``.
        is_iso = low.rlike(iso)
        date_part = F.regexp_replace(F.regexp_replace(low, "t.*$", ""), r"(\d)m", "$1mo")
        respelled = F.when(is_iso, F.concat(date_part, F.regexp_extract(low, "t(.*)$", 1))).otherwise(low)
        listed = F.regexp_replace(F.regexp_replace(respelled, "[-p]", ""), r"([0-9.]+)([a-zµ]+)", "$2:$1,")
        ok = (is_iso | low.rlike(units)) & low.rlike(r"\d")
        sign = F.when(F.startswith(low, F.lit("-")), -1).otherwise(1)
        parts = _bound(
            F.str_to_map(listed, F.lit(","), F.lit(":")),
            lambda m: F.struct(
                _worth(m, _MONTHS).cast("int").alias("months"),
                _worth(m, _DAYS).cast("int").alias("days"),
                _worth(m, _NANOS).cast("bigint").alias("nanos"),
            ),
        )
        signed = _bound(
            parts,
            lambda v: F.struct(
                (v["months"] * sign).alias("months"), (v["days"] * sign).alias("days"), (v["nanos"] * sign).alias("nanos")
            ),
        )
        return F.when(ok, signed)

    return _bound(F.lower(F.trim(text)), from_text)


def _worth(units: Column, worth: dict[str, int]) -> Column:
    total = F.lit(0).cast("decimal(38,9)")
    for unit, value in worth.items():
        found = F.coalesce(F.try_element_at(units, F.lit(unit)).try_cast("decimal(18,9)"), F.lit(0))
        total = (total + found * F.lit(value)).cast("decimal(38,9)")
    return total


def _blob(text: Column, codec: Codec) -> Column:
    trimmed = F.trim(text)
    hexed = trimmed.rlike(r"^0[xX]([0-9a-fA-F]{2})*$")
    if codec.binary == "HEX":
        hexed = trimmed.rlike(r"^(0[xX])?([0-9a-fA-F]{2})*$")
    from_hex = F.unhex(F.regexp_replace(trimmed, "^0[xX]", ""))
    return F.when(hexed, from_hex).otherwise(F.try_to_binary(trimmed, F.lit("base64")))


def parse(text: Column, name: str, codec: Codec = Codec()) -> Column:
    """``text`` as a value of the declared type, or null."""
    head, inner = _split_type(name)
    text = clean(text, codec)
    trimmed = F.trim(text)
    if head in ("text", "varchar", "ascii"):
        return text if head != "ascii" else F.when(text.rlike(r"^\p{ASCII}*$"), text)
    if head in _RANGES:
        return _integer(text, head, codec)
    if head == "varint":
        number = _plain_number(text, codec)
        return F.when(number.rlike(r"^[+-]?\d+$"), F.regexp_replace(number, r"^\+?(-?)0*(?=\d)", "$1"))
    if head == "decimal":
        return _decimal(text, name, codec)
    if head in ("float", "double"):
        # The cast alone would read Java's 1d and 1f.
        number = _plain_number(text, codec)
        return F.when(number.rlike(_FLOAT), number.try_cast(head))
    if head == "boolean":
        return _boolean(text, codec)
    if head == "timestamp":
        return _timestamp(text, codec)
    if head == "date":
        if codec.date:
            return F.try_to_timestamp(trimmed, F.lit(codec.date)).cast("date")
        return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), trimmed.try_cast("date"))
    if head == "time":
        return _time(text, codec)
    if head == "duration":
        return _duration(text)
    if head in ("uuid", "timeuuid"):
        ok = trimmed.rlike(_UUID)
        if head == "timeuuid":
            ok = ok & (F.substring(trimmed, 15, 1) == "1")
        return F.when(ok, F.lower(trimmed))
    if head == "inet":
        return F.when(trimmed.rlike(_IPV4) | trimmed.rlike(_IPV6), trimmed)
    if head == "blob":
        return _blob(text, codec)
    if head == "frozen":
        return parse(text, inner, codec)
    if head in ("list", "set"):
        good = _bound(
            F.when(trimmed.rlike(r"^\["), F.from_json(trimmed, "array<string>")),
            lambda raw: _all_read(raw, F.transform(raw, lambda x: parse(x, inner, codec))),
        )
        return F.array_sort(F.array_distinct(good)) if head == "set" else good
    if head == "vector":
        held = F.from_json(trimmed, spark_type(name))
        size = int(inner.rsplit(",", 1)[1])
        whole = (F.size(held) == size) & ~F.exists(held, lambda x: x.isNull())
        return F.when(trimmed.rlike(r"^\[") & whole, held)
    if head == "map":
        return _map(trimmed, inner, codec)
    if head == "tuple":
        types = _top_level(inner)
        raw = F.when(trimmed.rlike(r"^\["), F.from_json(trimmed, "array<string>"))

        def items(raw: Column) -> Column:
            texts = [F.get(raw, F.lit(i)) for i in range(len(types))]
            values = [parse(x, t, codec) for x, t in zip(texts, types)]
            made = F.struct(*[v.alias(f"_{i + 1}") for i, v in enumerate(values)])
            return F.when((F.size(raw) <= len(types)) & _none_failed(texts, values), made)

        return _bound(raw, items)
    if head == "udt":
        fields = [_field(f) for f in _top_level(inner)]
        raw = F.when(trimmed.rlike(r"^\{"), F.from_json(trimmed, "map<string,string>"))

        def members(raw: Column) -> Column:
            texts = [F.try_element_at(raw, F.lit(f)) for f, _ in fields]
            values = [parse(x, t, codec) for x, (_, t) in zip(texts, fields)]
            made = F.struct(*[v.alias(f) for v, (f, _) in zip(values, fields)])
            return F.when(raw.isNotNull() & _none_failed(texts, values), made)

        return _bound(raw, members)
    raise KeyspanError(f"unknown type {name}")


def _field(text: str) -> tuple[str, str]:
    name, _, kind = text.partition(":")
    return name.strip(), kind.strip()


def _none_failed(texts: list[Column], values: list[Column]) -> Column:
    ok = F.lit(True)
    for text, value in zip(texts, values):
        ok = ok & (text.isNull() | value.isNotNull())
    return ok


def _all_read(texts: Column, values: Column) -> Column:
    """The values, unless one of them is missing though its text is there."""
    counts = F.size(F.array_compact(texts)) == F.size(F.array_compact(values))
    return F.when(counts, values)


def _map(text: Column, inner: str, codec: Codec) -> Column:
    """A map from a JSON object, or from a list of key and value pairs."""
    key, value = _top_level(inner)
    pairs = "array<struct<key:string,value:string>>"
    listed = F.when(text.rlike(r"^\["), F.from_json(text, pairs)).otherwise(
        F.map_entries(F.when(text.rlike(r"^\{"), F.from_json(text, "map<string,string>")))
    )

    def read(raw: Column) -> Column:
        keys = F.transform(raw, lambda e: parse(e["key"], key, codec))
        values = _all_read(F.transform(raw, lambda e: e["value"]), F.transform(raw, lambda e: parse(e["value"], value, codec)))
        # A key that is there twice (also as 1 and 01) would end the job, so it is an error of this row.
        once = F.size(F.array_distinct(keys)) == F.size(keys)
        return F.when(once & ~F.exists(keys, lambda k: k.isNull()), F.map_from_arrays(keys, values))

    return _bound(listed, read)


def timeuuid_ts(c: Column) -> Column:
    """Time inside a version 1 uuid; null for any other text. Milliseconds, as the clock has it."""
    bare = F.regexp_replace(c, "-", "")
    ok = bare.rlike(r"^[0-9a-fA-F]{12}1[0-9a-fA-F]{19}$")
    word = F.concat(F.substring(bare, 14, 3), F.substring(bare, 9, 4), F.substring(bare, 1, 8))
    # 100 ns steps between 1582-10-15 and 1970-01-01.
    ticks = F.conv(word, 16, 10).cast("decimal(20,0)") - F.lit(122192928000000000).cast("decimal(20,0)")
    quotient = ticks / F.lit(10000).cast("decimal(20,0)")
    # Whole milliseconds are taken toward zero.
    millis = F.when(ticks < 0, F.ceil(quotient)).otherwise(F.floor(quotient))
    return F.when(ok, F.timestamp_millis(millis.cast("bigint")))
