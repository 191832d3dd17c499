"""Column expressions of the log model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strptime directives and their Spark pattern letters; fixed values.
DIRECTIVES = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS",
    "%y": "yy", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh", "%j": "DDD", "%z": "xx",
}
SCALES = {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9, "seconds": 1.0, "milliseconds": 1e3, "microseconds": 1e6, "nanoseconds": 1e9}
UNITS = {"second": 1.0, "minute": 60.0, "hour": 3600.0}


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    days = F.unix_date(F.to_date(ts)).cast("long")
    whole = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return (whole * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")) / 1e6


def spark_pattern(strptime: str) -> str:
    for a, b in DIRECTIVES.items():
        strptime = strptime.replace(a, b)
    if "%" in strptime:
        raise ValueError(f"no pattern for {strptime!r}")
    return strptime


def to_seconds_col(c: Column | None, kind: str, fmt: str | None = None) -> Column:
    """Seconds from a number (``fmt``: s, ms, us or ns, or their full names), a string (a strptime format) or a timestamp;
    without a column, processing time."""
    if c is None:
        return F.unix_micros(F.current_timestamp()) / 1e6
    if kind == "number":
        if fmt not in SCALES:
            raise ValueError(f"numbers need one of {sorted(SCALES)}, not {fmt!r}")
        return c.cast("double") / SCALES[fmt]
    if kind == "string":
        if not fmt:
            raise ValueError("strings need a format")
        return seconds_of(F.to_timestamp_ntz(c, F.lit(spark_pattern(fmt))))
    if kind == "timestamp":
        return seconds_of(c)
    raise ValueError(f"no rule for timestamps of kind {kind!r}")


def to_seconds(value: float, unit: str) -> float:
    if unit not in UNITS:
        raise ValueError(f"{unit!r} can't be turned into seconds")
    return value * UNITS[unit]


def fixed8(c: Column) -> Column:
    """The double's exact value with eight decimals, as C's %.8f writes it."""
    size = F.abs(c)
    whole = F.floor(size).cast("long")
    bits = ((size - whole) * float(1 << 52)).cast("long").cast("decimal(20,0)")
    part = F.round(bits * F.lit(10**8).cast("decimal(9,0)") / F.lit(1 << 52).cast("decimal(16,0)"), 0).cast("long")
    carried = whole + F.when(part == 10**8, 1).otherwise(0)
    digits = F.lpad(F.when(part == 10**8, 0).otherwise(part).cast("string"), 8, "0")
    return F.concat(F.when(c < 0, "-").otherwise(""), carried.cast("string"), F.lit("."), digits)


def split_type(topic: Column) -> tuple[Column, Column]:
    """Type and multi id of a topic named type_id, split at the last underscore."""
    return F.regexp_extract(topic, r"^(.*)_([^_]*)$", 1), F.regexp_extract(topic, r"^(.*)_([^_]*)$", 2)


def name_and_index(field: Column) -> tuple[Column, Column]:
    """``xyz[4]`` → xyz and 4; no index → NULL."""
    index = F.regexp_extract(field, r"^(.*)\[(\d+)\]$", 2)
    return F.regexp_replace(field, r"\[\d+\]$", ""), F.when(index != "", index.cast("int"))


def text_to_codes(text: Column) -> Column:
    """Code points of a text given where a list of integers is wanted."""
    return F.transform(F.split(text, ""), lambda x: F.ascii(x))


def positional(values: Column, names: list[str]) -> Column:
    """A record's values as a struct: extra values are dropped, missing ones are NULL."""
    return F.struct(*(F.try_element_at(values, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def short_digest(*seeds: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("_", *(s.cast("string") for s in seeds)), 256), F.lit(8))


def snake_case(text: Column) -> Column:
    """lower_snake_case: runs of anything but letters and digits are one underscore."""
    return F.btrim(F.lower(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_")), F.lit("_"))


def severity(value: Column) -> Column:
    """INFO / WARN / ERROR by bands of a value."""
    return F.when(value < 20, "INFO").when(value < 60, "WARN").otherwise("ERROR")
