"""Text, time, JSON and collection helpers as column expressions. A null text gives null, but for tests, which give false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit of time, and the unit's letter.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
INT_MOST = 2**31 - 1


def bytes_to_short_text(size: Column) -> Column:
    """Two decimals (halves to even) and the largest unit from B to PB that gives 1 or more."""
    out = F.format_string("%.2fB", size.cast("double"))
    for k, unit in enumerate(("kB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(size >= F.lit(1024**k), F.format_string(f"%.2f{unit}", F.bround(size / F.lit(float(1024**k)), 2))).otherwise(out)
    return out


def starts_with(text: Column, part: str) -> Column:
    return F.coalesce(text.startswith(part), F.lit(False))


def ends_with(text: Column, part: str) -> Column:
    return F.coalesce(text.endswith(part), F.lit(False))


def contains(text: Column, part: str) -> Column:
    return F.coalesce(text.contains(part), F.lit(False))


def remove_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, INT_MOST)).otherwise(text)


def remove_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.left(text, F.char_length(text) - len(suffix))).otherwise(text)


def remove_first(text: Column) -> Column:
    return F.substring(text, 2, INT_MOST)


def remove_last(text: Column) -> Column:
    return F.left(text, F.char_length(text) - 1)


def remove_whitespace(text: Column) -> Column:
    """Without spaces, tabs and line ends."""
    return F.translate(text, " \t\r\n", "")


def split_parts(text: Column, delimiter: str) -> Column:
    """Parts between delimiters, empty ones left out."""
    return F.filter(F.split(text, f"\\Q{delimiter}\\E", -1), lambda p: p != "")


def is_number(text: Column, base: int = 10) -> Column:
    """Digits of base 10 or 16, a minus before them allowed, line ends anywhere."""
    digits = "0-9" if base == 10 else "0-9A-Fa-f"
    return F.coalesce(text.rlike(rf"\A(-(?=[{digits}\r\n]))?[{digits}\r\n]+\z"), F.lit(False))


def to_int(text: Column) -> Column:
    """The whole number that a text starts with; 0 where there is none, or none of 32 bits."""
    digits = F.regexp_extract(text, r"\A[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
    value = digits.try_cast("decimal(38,0)")
    return F.coalesce(F.when(value.between(-(2**31), INT_MOST), value.cast("int")), F.lit(0))


def escape(text: Column) -> Column:
    """Backslashes before quotes and backslashes; line ends and tabs as letters."""
    out = F.regexp_replace(text, r"([\\'\"])", r"\\$1")
    for c, letter in (("\n", "n"), ("\t", "t"), ("\r", "r")):
        out = F.replace(out, F.lit(c), F.lit("\\" + letter))
    return out


def indent(tag: Column, spaces: int) -> Column:
    return F.concat(F.lit(" " * spaces), F.coalesce(tag, F.lit("")))


def same(a: Column, b: Column) -> Column:
    """Equal, or both null."""
    return a.eqNullSafe(b)


def from_base64(text: Column) -> Column:
    """Bytes; null where the text is no base64."""
    return F.try_to_binary(text, F.lit("base64"))


def is_utf8(content: Column) -> Column:
    return F.coalesce(F.is_valid_utf8(content.cast("string")), F.lit(False))


def is_ascii(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[\x00-\x7F]*\z"), F.lit(False))


def time_convert(seconds: Column, unit: str) -> Column:
    """Whole units, rounded towards 0."""
    return (seconds / UNITS[unit]).cast("long")


def time_is_valid(seconds: Column) -> Column:
    return F.coalesce(seconds > 0, F.lit(False))


def time_text(seconds: Column, unit: str) -> Column:
    """Whole units with their letter; unit timestamp: the moment in UTC."""
    if unit == "timestamp":
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
        rest = F.pmod(seconds, F.lit(86400))
        return F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60))
    return F.concat(time_convert(seconds, unit).cast("string"), F.lit(unit))


def json_items(text: Column) -> Column:
    """A JSON object as a map of variants; null where it is none."""
    return F.from_json(text, "map<string,variant>")


def json_has(text: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(json_items(text), key), F.lit(False))


def json_put(text: Column, key: str, value: Column) -> Column:
    """The object with key set to value (a JSON text), in place of what it had."""
    rest = F.map_filter(json_items(text), lambda k, _: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(value))))


def json_remove(text: Column, key: str) -> Column:
    return F.to_json(F.map_filter(json_items(text), lambda k, _: k != key))


def json_length(text: Column) -> Column:
    """Items of a JSON array; null for anything else."""
    return F.json_array_length(text)


def prefix_search(items: Column, prefix: str) -> Column:
    """Entries of a map whose keys start with prefix, in order of keys."""
    return F.array_sort(F.map_entries(F.map_filter(items, lambda k, _: k.startswith(prefix))))
