"""Hive scalar functions as Spark columns, in a lenient and a strict form.

Lenient follows Hive: bad input gives NULL, NULL parts are skipped.  Strict
follows the target warehouse, which is stricter or returns NULL where Hive
returns an empty value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshift import fixed


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# --- time -----------------------------------------------------------------


def now_timestamp() -> Column:
    return F.current_timestamp()


def now_epoch() -> Column:
    return F.unix_timestamp()


def from_unixtime(seconds, strict: bool = True) -> Column:
    """Strict: a timestamp.  Lenient: Hive's 'yyyy-MM-dd HH:mm:ss' text."""
    stamp = F.timestamp_seconds(_c(seconds))
    return stamp if strict else F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")


def date_text(col, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(_c(col), pattern)


def date_add(col, days) -> Column:
    return F.date_add(_c(col), days)


def datediff(end, start) -> Column:
    """Calendar days, whatever the time of day."""
    return F.datediff(_c(end), _c(start)).cast("bigint")


def to_date(col, strict: bool = False) -> Column:
    return F.to_date(_c(col)) if strict else F.try_to_date(_c(col))


def year(col) -> Column:
    return F.year(_c(col)).cast("bigint")


def month(col) -> Column:
    return F.month(_c(col)).cast("bigint")


def day(col) -> Column:
    return F.dayofmonth(_c(col)).cast("bigint")


def default_run_date(today) -> Column:
    """The day before the given day, as text."""
    return F.date_format(F.date_sub(_c(today), 1), "yyyy-MM-dd")


# --- nulls ------------------------------------------------------------------


def nvl(a, b) -> Column:
    return F.coalesce(_c(a), _c(b))


def nvl2(a, b, c) -> Column:
    return F.when(_c(a).isNotNull(), _c(b)).otherwise(_c(c))


# --- strings, arrays, JSON --------------------------------------------------


def concat_ws(sep: str, *cols, strict: bool = False) -> Column:
    """Lenient skips NULL parts; strict gives NULL when any part is NULL."""
    if not strict:
        return F.concat_ws(sep, *[_c(c) for c in cols])
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit(sep), _c(c)]
    return F.concat(*parts[1:])


def regexp_extract(col, pattern: str, group: int = 1, strict: bool = False) -> Column:
    """Without a match: '' when lenient, NULL when strict."""
    found = F.regexp_extract(_c(col), pattern, group)
    return F.when(_c(col).rlike(pattern), found) if strict else found


def split_at(col, delimiter: str, index: int) -> Column:
    """An index past the end gives NULL."""
    return F.get(F.split(_c(col), delimiter), F.lit(index))


def size(col, strict: bool = True) -> Column:
    n = F.size(_c(col)).cast("bigint")
    null = F.lit(None).cast("bigint") if strict else F.lit(-1).cast("bigint")
    return F.when(_c(col).isNull(), null).otherwise(n)


def json_value(col, path: str, strict: bool = False) -> Column:
    """Strict gives NULL where the path leads to an object or array, told by the type of the node."""
    value = F.get_json_object(_c(col), path)
    if not strict:
        return value
    if "*" in path:  # leads to many nodes
        return F.lit(None).cast("string")
    # only a value that begins like one can be an object or array; text that does is told apart by its type
    node = F.schema_of_variant(F.try_variant_get(F.try_parse_json(_c(col)), path, "variant"))
    nested = value.rlike(r"^\s*[\[{]") & F.coalesce(node.rlike("^(?:OBJECT|ARRAY)"), F.lit(True))
    return F.when(~nested, value)


# --- casts ------------------------------------------------------------------


def to_bigint(col, strict: bool = False) -> Column:
    return _c(col).cast("bigint") if strict else _c(col).try_cast("bigint")


def to_double(col, strict: bool = False) -> Column:
    """Target of both FLOAT and DOUBLE."""
    return _c(col).cast("double") if strict else _c(col).try_cast("double")


# --- type map ---------------------------------------------------------------


def target_type_name(hive_type: str) -> str:
    """Name of the target type for one Hive type text, nested types included."""
    text = hive_type.strip()
    upper = text.upper()
    if upper.startswith("DECIMAL"):
        digits = upper[len("DECIMAL"):].strip("() ").split(",")[0].strip()
        precision = int(digits) if digits else 10
        return "NUMERIC" if precision <= fixed.NUMERIC_MAX_PRECISION else "BIGNUMERIC"
    if upper.startswith("MAP<"):
        return "JSON"
    if upper.startswith("ARRAY<"):
        return f"ARRAY<{target_type_name(text[6:-1])}>"
    if upper.startswith("STRUCT<"):
        return text
    return fixed.TYPE_NAMES.get(upper, "STRING")


def target_type(col) -> Column:
    """`target_type_name` for a column of Hive type texts."""
    text = F.trim(_c(col))
    arrays = F.regexp_extract(text, r"(?i)^((?:array<\s*)*)", 1)
    depth = F.regexp_count(arrays, F.lit("<"))
    inner = F.trim(F.regexp_replace(F.substr(text, F.length(arrays) + 1), r"^(.*?)((?:\s*>)*)$", "$1"))
    closing = F.regexp_count(F.regexp_extract(text, r"((?:\s*>)*)$", 1), F.lit(">")) - depth
    inner = F.concat(inner, F.repeat(F.lit(">"), F.greatest(closing, F.lit(0))))
    upper = F.upper(inner)
    digits = F.coalesce(F.regexp_extract(upper, r"^DECIMAL\s*\(\s*(\d+)", 1).try_cast("int"), F.lit(10))
    names = F.create_map(*[F.lit(x) for pair in fixed.TYPE_NAMES.items() for x in pair])
    base = (
        F.when(F.startswith(upper, F.lit("DECIMAL")), F.when(digits <= fixed.NUMERIC_MAX_PRECISION, "NUMERIC").otherwise("BIGNUMERIC"))
        .when(F.startswith(upper, F.lit("MAP<")), "JSON")
        .when(F.startswith(upper, F.lit("STRUCT<")), inner)
        .otherwise(F.coalesce(F.try_element_at(names, upper), F.lit("STRING")))
    )
    return F.concat(F.repeat(F.lit("ARRAY<"), depth), base, F.repeat(F.lit(">"), depth))


def widened(dtype: T.DataType) -> T.DataType:
    """Spark type that holds the target type of a Hive column."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(widened(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, widened(f.dataType), f.nullable) for f in dtype])
    if isinstance(dtype, T.MapType):
        # the target has no map: JSON text
        return T.StringType()
    return dtype


def to_target(name: str, dtype: T.DataType) -> Column:
    """A column as its target type; maps, at any depth of arrays and structs, as JSON text."""
    return _converted(F.col(name), dtype).alias(name)


def _converted(value: Column, dtype: T.DataType) -> Column:
    target = widened(dtype)
    if target == dtype:
        return value
    if isinstance(dtype, T.MapType):
        return F.to_json(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _converted(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        built = F.struct(*[_converted(value[f.name], f.dataType).alias(f.name) for f in dtype])
        return F.when(value.isNotNull(), built)
    return value.cast(target)
