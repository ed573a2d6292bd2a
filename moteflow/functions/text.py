"""Text and number conventions of simulation files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)$"


def strict_double(text: Column) -> Column:
    """A number only if the whole text is one: suffixes such as 12d, which a plain cast accepts, give null."""
    t = F.trim(text)
    return F.when(F.lower(t).rlike(NUMBER), t.try_cast("double"))


def lenient_double(text: Column) -> Column:
    """The number that the text begins with, as C's reader takes it; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).try_cast("double")


def element_name(symbol: Column) -> Column:
    """Trimmed, first letter upper, rest lower."""
    t = F.trim(symbol)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1000)))


def residue_key(chain: Column, resname: Column, resid: Column) -> Column:
    """chain:RESNAME resid; without the chain where it is blank."""
    name = F.concat(F.upper(F.trim(resname)), F.lit(" "), F.trim(resid))
    return F.when(F.coalesce(F.trim(chain), F.lit("")) == "", name).otherwise(F.concat(F.trim(chain), F.lit(":"), name))


def unix_lines(text: Column) -> Column:
    """The text's lines, whichever newline it uses."""
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9-]", "-")


def key_token(text: Column, prefix: str) -> Column:
    """The first key in a pasted text: prefix and 32 lowercase hex digits, set off by blanks or quotes; null if there is none."""
    edge = " \t\n\"'`"
    return F.nullif(F.regexp_extract(text, rf"(?:^|[{edge}])({re.escape(prefix)}[0-9a-f]{{32}})(?=$|[{edge}])", 1), F.lit(""))


BRACKET = re.compile(r"\[([!^]?)(\]?[^\]]*)\]")


def glob_regex(pattern: str) -> str:
    """A file name pattern of *, ?, [...], [!...] and backslashes as a regular expression of the whole name; * goes past slashes."""
    out, k = "", 0
    while k < len(pattern):
        c, k = pattern[k], k + 1
        if c == "[" and (m := BRACKET.match(pattern, k - 1)):
            out += "[" + ("^" if m[1] else "") + re.sub(r"([\\\[\]&^])", r"\\\1", m[2]) + "]"
            k = m.end()
        elif c in "*?":
            out += ".*" if c == "*" else "."
        else:
            if c == "\\" and k < len(pattern):
                c, k = pattern[k], k + 1
            out += c if c.isalnum() or ord(c) > 127 else "\\" + c
    return rf"^(?s:{out})\z"


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a pattern fits the path or one of its parts between slashes."""
    parts = F.split(path, "/")
    fits = lambda p: path.rlike(p) | F.exists(parts, lambda x: (x != "") & x.rlike(p))
    return F.coalesce(reduce(lambda a, b: a | b, map(fits, map(glob_regex, patterns)), F.lit(False)), F.lit(False))


def duration_text(seconds: Column) -> Column:
    """2m 18s or 1h 1m."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%dh %dm", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60))).otherwise(F.format_string("%dm %ds", F.floor(s / 60), F.pmod(s, F.lit(60))))


def format_number(value: float | None, spec: str = "%.4g") -> str:
    """C-style text of one number, on the driver; a dash for none."""
    import math

    return "–" if value is None or not math.isfinite(value) else spec % value
