"""Character references of HTML (named, decimal and hexadecimal) as column functions, with the rules of the standard."""

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
OFTEN = ("amp;", "lt;", "gt;", "quot;", "nbsp;")  # looked up before the table


@cache
def _open() -> list[str]:
    """Names that also stand without a semicolon, longest first."""
    return sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


@cache
def _windows() -> dict[str, str]:
    """References to 0x80 .. 0x9f mean the characters of code page 1252 where it has one."""
    out = {}
    for n in range(0x80, 0xA0):
        try:
            out[str(n)] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[str(n)] = chr(n)
    return out | {"0": "�", "13": "\r"}


def _table(of: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(of)), "map<string,string>")  # folded to a constant


def _char(n: Column) -> Column:
    """The character of a code point; none for control characters and noncharacters, the replacement character beyond all."""
    whole = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    unused = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | ((n % 65536) >= 65534)
    return (F.when(n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "�")
            .when(n.between(0x80, 0x9F) | n.isin(0, 13), F.try_element_at(_table(_windows()), n.cast("string"))).when(unused, "").otherwise(whole))


def _number(digits: Column, base: int) -> Column:
    """NULL beyond 12 digits."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) <= 12, F.conv(short, base, 10).cast("bigint"))


def _decoded(part: Column) -> Column:
    """A piece of text that stood behind ``&``."""
    ref = F.regexp_extract(part, REFERENCE, 1)
    rest = F.substr(part, F.length(ref) + 1)
    number = F.when(F.lower(F.substring(ref, 2, 1)) == "x", _number(F.regexp_extract(ref, "([0-9a-fA-F]+);?$", 1), 16)).otherwise(_number(F.regexp_extract(ref, "([0-9]+)", 1), 10))
    often = F.when(ref == OFTEN[0], html5[OFTEN[0]])
    for name in OFTEN[1:]:
        often = often.when(ref == name, html5[name])
    start = F.regexp_extract(ref, "^(" + "|".join(_open()) + ")", 1)
    opened = F.when(start != "", F.concat(F.try_element_at(_table({n: html5[n] for n in _open()}), start), F.substr(ref, F.length(start) + 1)))
    named = F.coalesce(often, F.try_element_at(_table(dict(html5)), ref), opened, F.concat(F.lit("&"), ref))
    return F.concat(F.when(ref == "", "&").when(ref.startswith("#"), _char(number)).otherwise(named), rest)


def unescape(text: Column) -> Column:
    """``text`` with its character references decoded, once."""
    pieces = F.split(text, "&")
    decoded = F.concat(F.slice(pieces, 1, 1), F.transform(F.slice(pieces, 2, 1 << 30), _decoded))
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)
