"""JSON text in one fixed form, built by column functions: ASCII only, members as given, no space but what is asked for.

Used for what must be equal byte by byte, such as keys by content and sizes of requests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with a short escape.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(text: Column) -> Column:
    """A JSON string; all but printable ASCII as escapes, by UTF-16 units in lower case.  Null stays null."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = F.create_map(*[F.lit(x) for pair in _SHORT.items() for x in pair])
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    one = lambda c: F.when(c.rlike("[^ -~]"), F.coalesce(F.try_element_at(short, c), units(c))).otherwise(c)
    safe = F.when(plain.rlike("[^ -~]"), F.array_join(F.transform(F.split(plain, ""), one), "")).otherwise(plain)
    return F.concat(F.lit('"'), safe, F.lit('"'))


def members(comma: str = ",", colon: str = ":", **values: Column) -> Column:
    """A JSON object of the members that are not null, in the order given; values are JSON text."""
    pairs = [F.concat(F.lit(f'"{name}"{colon}'), v) for name, v in values.items()]
    return F.concat(F.lit("{"), F.concat_ws(comma, *pairs), F.lit("}"))


def items(values: Column, comma: str = ",") -> Column:
    """A JSON array of an array of JSON texts; null stays null."""
    return F.concat(F.lit("["), F.array_join(values, comma), F.lit("]"))


def some(values: Column) -> Column:
    """The array, null if it is empty."""
    return F.when(F.size(values) > 0, values)
