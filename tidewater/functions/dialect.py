"""Scalar functions of the warehouse dialect as compositions of Spark's own, so that plans stay in the JVM.

Each function takes and returns columns. Where Spark has a function of the same meaning, use that one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = Column | str


def _c(x: Cols) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- strings ---------------------------------------------------------------------------------------------------


def concat_skip(*parts: Cols) -> Column:
    """Concatenation that takes nulls as empty."""
    return F.concat_ws("", *map(_c, parts))


def split(text: Cols, delimiter: str) -> Column:
    """Parts between a literal delimiter."""
    return F.split(_c(text), re.escape(delimiter)) if delimiter else F.array(_c(text))


def split_part(text: Cols, delimiter: str, n: int) -> Column:
    """The n-th part from the left, or from the right if n is negative; empty if there is none; 0 counts as none."""
    return F.lit("") if n == 0 else F.split_part(_c(text), F.lit(delimiter), F.lit(n))


def strtok(text: Cols, delimiter: str, n: int = 1) -> Column:
    return split_part(text, delimiter, n)


def substr(text: Cols, start: int, length: int | None = None) -> Column:
    """From a place that counts from 1; place 0 stands before the first character."""
    if start == 0 and length is not None:
        start, length = 1, max(0, length - 1)
    return F.substring(_c(text), start, (1 << 31) - 1 if length is None else length)


def left(text: Cols, n: int) -> Column:
    """The first n characters; a negative n leaves out so many at the end."""
    text = _c(text)
    return F.left(text, F.lit(n)) if n >= 0 else F.left(text, F.greatest(F.length(text) + n, F.lit(0)))


def right(text: Cols, n: int) -> Column:
    text = _c(text)
    return F.right(text, F.lit(n)) if n >= 0 else F.right(text, F.greatest(F.length(text) + n, F.lit(0)))


def charindex(part: Cols | Column, text: Cols, start: int = 1) -> Column:
    """Where a part begins, from 1; 0 if it doesn't stand there."""
    return F.call_function("locate", part if isinstance(part, Column) else F.lit(part), _c(text), F.lit(start))


def regexp_like(text: Cols, pattern: str) -> Column:
    """Whether the whole text matches."""
    return _c(text).rlike(rf"\A(?:{pattern})\z")


def regexp_substr(text: Cols, pattern: str) -> Column:
    """The first match, empty if there is none."""
    return F.regexp_extract(_c(text), pattern, 0)


def regexp_replace(text: Cols, pattern: str, new: str, flags: str = "") -> Column:
    """Replaces the first match, or all with the flag g."""
    if "g" in flags:
        return F.regexp_replace(_c(text), pattern, new)
    shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}", new)
    return F.regexp_replace(_c(text), rf"(?s)\A(.*?)(?:{pattern})", f"$1{shifted}")


def unicode(text: Cols) -> Column:
    """The code point of the first character."""
    return F.ascii(_c(text))


# --- dates and times -------------------------------------------------------------------------------------------

#: Units and their other names.
UNITS = {
    "year": "years year yy yyyy y yr", "quarter": "quarters qtr q", "month": "months mon mm", "week": "weeks w wk", "day": "days d dd",
    "hour": "hours h hh hr", "minute": "minutes m mi min", "second": "seconds s sec",
}
SECONDS = {"hour": 3600, "minute": 60, "second": 1}


def unit_of(name: str) -> str:
    """The unit that a name in any case and number means."""
    low = name.lower()
    for unit, others in UNITS.items():
        if low == unit or low in others.split():
            return unit
    raise ValueError(f"no unit of time: {name}")


def dateadd(unit: str, n: int | Column, when: Cols) -> Column:
    """A time moved by n units; months are cut at their last day."""
    n = n if isinstance(n, Column) else F.lit(n)
    unit = unit_of(unit)
    if unit == "quarter":
        unit, n = "month", n * 3
    return _c(when).cast("timestamp_ntz") + F.make_interval(**{f"{unit}s" if unit not in ("minute", "second") else {"minute": "mins", "second": "secs"}[unit]: n})


def _microseconds(when: Column) -> Column:
    return F.unix_micros(when.cast("timestamp"))


def datediff(unit: str, first: Cols, last: Cols) -> Column:
    """How many borders of a unit lie between two times; weeks are days divided by 7, cut off."""
    a, b, unit = _c(first).cast("timestamp_ntz"), _c(last).cast("timestamp_ntz"), unit_of(unit)
    years = F.year(b) - F.year(a)
    if unit == "year":
        return years.cast("long")
    if unit in ("month", "quarter"):
        of = F.month if unit == "month" else F.quarter
        return (years * (12 if unit == "month" else 4) + of(b) - of(a)).cast("long")
    if unit in ("day", "week"):
        days = F.datediff(b.cast("date"), a.cast("date")).cast("long")
        return days if unit == "day" else F.when(days < 0, -F.floor(-days / 7)).otherwise(F.floor(days / 7))
    size = SECONDS[unit] * 1_000_000
    return (F.floor(_microseconds(b) / size) - F.floor(_microseconds(a) / size)).cast("long")


def dayofweek(day: Cols) -> Column:
    """Sunday is 0."""
    return F.dayofweek(_c(day)) - 1


def dayname(day: Cols) -> Column:
    return F.date_format(_c(day), "EEEE")


def monthname(day: Cols) -> Column:
    return F.date_format(_c(day), "MMMM")


def previous_day(day: Cols, name: str) -> Column:
    """The last day of that name before a day."""
    return F.next_day(F.date_sub(_c(day).cast("date"), 8), name)


def time_slice(when: Cols, n: int, unit: str) -> Column:
    """The beginning of the slice of n units that a time is in, counted from 1970."""
    when, unit = _c(when).cast("timestamp_ntz"), unit_of(unit)
    if unit in SECONDS or unit in ("day", "week"):
        size = n * (SECONDS.get(unit) or {"day": 86_400, "week": 604_800}[unit]) * 1_000_000
        shift = 3 * 86_400_000_000 if unit == "week" else 0  # 1970 began on a Thursday
        return F.timestamp_micros((F.floor((_microseconds(when) + shift) / size) * size - shift).cast("long")).cast("timestamp_ntz")
    size = n * {"month": 1, "quarter": 3, "year": 12}[unit]
    months = F.floor(((F.year(when) - 1970) * 12 + F.month(when) - 1) / size) * size
    return F.add_months(F.lit("1970-01-01").cast("date"), months.cast("int")).cast("timestamp_ntz")


def convert_timezone(source: str, target: str, when: Cols) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), _c(when))


# --- numbers ---------------------------------------------------------------------------------------------------


def trunc(x: Cols, digits: int = 0) -> Column:
    """Cut off towards zero. Without digits behind the point integers and decimals stay exact and keep their kind."""
    x = _c(x)
    if digits <= 0:
        return x - x % F.lit(10**-digits)
    moved = x * F.lit(10**digits)
    return (moved - moved % F.lit(1)) / F.lit(10**digits)


def sign(x: Cols) -> Column:
    return F.signum(_c(x).cast("double")).cast("int")


def mod(x: Cols, y: Cols) -> Column:
    """The rest with the sign of x; null where y is 0."""
    return F.try_mod(_c(x), _c(y))


def div0(x: Cols, y: Cols) -> Column:
    x, y = _c(x).cast("double"), _c(y).cast("double")
    return F.when(y == 0, 0.0).otherwise(x / F.when(y != 0, y))


def div0null(x: Cols, y: Cols) -> Column:
    return F.try_divide(_c(x).cast("double"), _c(y).cast("double"))


def uniform(low: int, high: int, seed: int | None = None) -> Column:
    """Whole random numbers from low to high, both included."""
    return (F.floor((F.rand(seed) if seed is not None else F.rand()) * (high - low + 1)) + low).cast("int")


# --- conditions ------------------------------------------------------------------------------------------------


def iff(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def decode(x: Cols, *pairs) -> Column:
    """The value after the first equal key, nulls being equal; then the default, or null."""
    x, out = _c(x), None
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    for key, value in zip(pairs[::2], pairs[1::2]):
        test = x.eqNullSafe(as_column(key))
        out = F.when(test, as_column(value)) if out is None else out.when(test, as_column(value))
    return out.otherwise(as_column(pairs[-1])) if len(pairs) % 2 else out


def booland(a: Cols, b: Cols) -> Column:
    return (_c(a) != 0) & (_c(b) != 0)


def boolor(a: Cols, b: Cols) -> Column:
    return (_c(a) != 0) | (_c(b) != 0)


def boolxor(a: Cols, b: Cols) -> Column:
    return (_c(a) != 0) != (_c(b) != 0)


def boolnot(a: Cols) -> Column:
    return _c(a) == 0


# --- conversions -----------------------------------------------------------------------------------------------


def to_integer(x: Cols) -> Column:
    """Rounded, not cut off; a half goes to the even number."""
    return F.bround(_c(x).cast("double"), 0).cast("long")


def to_number(x: Cols, precision: int = 38, scale: int = 0) -> Column:
    return _c(x).cast(f"decimal({precision},{scale})")


def try_to_number(x: Cols) -> Column:
    return _c(x).try_cast("double")


def try_to_decimal(x: Cols, precision: int = 38, scale: int = 0) -> Column:
    return _c(x).try_cast(f"decimal({precision},{scale})")


#: Names of types as the dialect gives them.
TYPE_NAMES = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB"}


def typeof(x: Cols) -> Column:
    name = F.typeof(_c(x))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in TYPE_NAMES.items() for v in kv]), name), F.upper(name))


# --- arrays ----------------------------------------------------------------------------------------------------


def array_contains(value, array: Cols) -> Column:
    return F.array_contains(_c(array), value)


def array_position(value, array: Cols) -> Column:
    """From 0; null if the value isn't there."""
    return F.nullif(F.array_position(_c(array), value), F.lit(0)) - 1


def array_slice(array: Cols, first: int, last: int) -> Column:
    """Elements from place first to place last, both counted from 0 and both included."""
    return F.slice(_c(array), first + 1, last - first + 1)


def array_sum(array: Cols) -> Column:
    return F.aggregate(_c(array), F.lit(0).cast("double"), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def array_avg(array: Cols) -> Column:
    return array_sum(array) / F.nullif(F.size(F.array_compact(_c(array))), F.lit(0))


def arrays_overlap(a: Cols, b: Cols) -> Column:
    return F.coalesce(F.arrays_overlap(F.array_compact(_c(a)), F.array_compact(_c(b))), F.lit(False))


def array_distinct(array: Cols) -> Column:
    return F.array_distinct(F.array_compact(_c(array)))


def array_intersection(a: Cols, b: Cols) -> Column:
    """Elements of a that b has, as often as a has them."""
    return F.filter(_c(a), lambda x: F.array_contains(_c(b), x))


def array_except(a: Cols, b: Cols) -> Column:
    return F.filter(_c(a), lambda x: ~F.array_contains(_c(b), x))


# --- JSON ------------------------------------------------------------------------------------------------------


def get_path(text: Cols, path: str) -> Column:
    """What a path such as a.b[1].c leads to, as text."""
    return F.get_json_object(_c(text), f"$.{path}" if not path.startswith("[") else f"${path}")


def json_extract_path_text(text: Cols, *keys: str) -> Column:
    return F.get_json_object(_c(text), "$" + "".join(f"['{k}']" for k in keys))


def object_construct(**values: Cols) -> Column:
    """A JSON object with its nulls."""
    return F.to_json(F.struct(*[_c(v).alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def _object(text: Cols) -> Column:
    return F.parse_json(_c(text)).cast("map<string,variant>")


def object_insert(text: Cols, key: str, value: Column) -> Column:
    """The object with a key set; a null value takes the key away."""
    rest = F.map_filter(_object(text), lambda k, _: k != key)
    full = F.map_concat(rest, F.create_map(F.lit(key), value.cast("variant")))
    return F.to_json(F.when(value.isNull(), rest).otherwise(full))


def object_delete(text: Cols, *keys: str) -> Column:
    return F.to_json(F.map_filter(_object(text), lambda k, _: ~k.isin(*keys)))


def object_keys(text: Cols) -> Column:
    return F.json_object_keys(_c(text))


def is_json(text: Cols) -> Column:
    """Whether a text is one JSON value and nothing else; null for null.

    Spark's parser leaves what follows a value unread, so the text is tried inside an array and inside an object.
    """
    text = _c(text)
    inside = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"x":', "}"))]
    return F.when(text.isNotNull(), inside[0] & inside[1])


def try_parse_json(text: Cols) -> Column:
    """A variant, null if the text isn't JSON."""
    return F.when(is_json(text), F.try_parse_json(_c(text)))


def check_json(text: Cols) -> Column:
    """Null for valid JSON and for null, else a message."""
    text = _c(text)
    return F.when(~is_json(text), "Invalid JSON")


# --- hashes and encodings --------------------------------------------------------------------------------------


def md5_number_lower64(text: Cols) -> Column:
    return F.conv(F.substring(F.md5(_c(text)), 17, 16), 16, 10).cast("decimal(20,0)")


def md5_number_upper64(text: Cols) -> Column:
    return F.conv(F.substring(F.md5(_c(text)), 1, 16), 16, 10).cast("decimal(20,0)")


def base64_decode_string(text: Cols) -> Column:
    return F.unbase64(_c(text)).cast("string")


def try_base64_decode_string(text: Cols) -> Column:
    return F.try_to_binary(_c(text), F.lit("base64")).cast("string")


def hex_decode_string(text: Cols) -> Column:
    return F.unhex(_c(text)).cast("string")


def time_from_parts(hour: Cols, minute: Cols, second: Cols) -> Column:
    """A time of day; needs spark.sql.timeType.enabled."""
    return F.make_time(_c(hour), _c(minute), _c(second))
