"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def translate(text: Column, source: str, target: str) -> Column:
    """Characters of source to those of target; those without a partner go."""
    return F.translate(text, source, target)


def substitute(text: Column, pattern: str, replacement: str, every: bool = True, ignore_case: bool = False) -> Column:
    """struct(text, matches): a regex replaced once or everywhere, and one more than the number of replacements."""
    flags = "(?i)" if ignore_case else ""
    found = F.regexp_count(text, F.lit(flags + pattern))
    if every:
        return F.struct(F.regexp_replace(text, flags + pattern, replacement).alias("text"), (1 + found).alias("matches"))
    # A look-ahead would not stop later matches: the lazy prefix takes all up to the first, the rest follows as it is.
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", replacement)
    groups = re.compile(pattern).groups
    once = F.regexp_replace(text, f"(?s){flags}^(.*?){pattern}(.*)$", "$1" + shifted + f"${groups + 2}")
    return F.struct(once.alias("text"), (1 + F.least(found, F.lit(1))).alias("matches"))


def trim_end(text: Column, chars: str) -> Column:
    return F.rtrim(text, F.lit(chars))


def trim_start(text: Column, chars: str) -> Column:
    return F.ltrim(text, F.lit(chars))


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def tokens(text: Column, delimiters: str) -> Column:
    """Parts between runs of delimiter characters."""
    return F.filter(F.split(text, "[" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in delimiters) + "]+"), lambda t: t != "")


def suffix_key(text: Column) -> Column:
    """Orders texts by their ends."""
    return F.reverse(text)


def to_time(text: Column) -> Column:
    return F.to_timestamp(text, "MM/dd/yyyy HH:mm:ss")


def from_time(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy HH:mm:ss")


def id_of(name: Column, ids: dict[str, int], default: int = -1) -> Column:
    """The number of a name in a small fixed map."""
    if not ids:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in ids.items() for v in kv]), name), F.lit(default))


def assignment(line: Column) -> Column:
    """struct(name, value) of 'name = value' or 'name <- value' with # and // comments cut off; null where there is none."""
    code = F.trim(F.regexp_replace(line, r"(#|//).*$", ""))
    name, value = F.regexp_extract(code, r"^([A-Za-z_]\w*)\s*(?:=|<-)\s*(.+)$", 1), F.regexp_extract(code, r"^([A-Za-z_]\w*)\s*(?:=|<-)\s*(.+)$", 2)
    return F.when(name != "", F.struct(name.alias("name"), F.trim(value).alias("value")))
