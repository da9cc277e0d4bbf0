"""Character references of web pages as expressions: numeric ones by arithmetic, named ones by the standard's table."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.functions.text import let

_CLOSED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
#: Names that may stand without a semicolon, longest first: the first that a text begins with is meant.
_OPEN = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
#: What the numbers 128 to 159 stand for: the characters of the old Windows code page where it has one.
_WINDOWS = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)]


def character(code: Column) -> Column:
    """The text of a character number: U+FFFD for none, surrogates and numbers out of range, nothing for noncharacters."""
    plane = F.pmod(code, F.lit(0x10000))
    dropped = code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (plane >= 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
    return (F.when(code.between(0x80, 0x9F), F.get(F.array(*map(F.lit, _WINDOWS)), (code - 0x80).cast("int")))
            .when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("�")).when(dropped, F.lit("")).otherwise(plain))


def _reference(piece: Column) -> Column:
    """A piece of text that stood behind an ampersand, with the reference at its beginning replaced."""
    closed = F.from_json(F.lit(json.dumps(_CLOSED)), "map<string,string>")  # folded once when the query is planned
    short = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(html5[k]).alias("v")) for k in _OPEN])
    number = r"^#(?:([0-9]+)|[xX]([0-9a-fA-F]+));?"
    digits = F.nullif(F.regexp_extract(piece, number, 1), F.lit(""))
    hexed = F.nullif(F.ltrim(F.regexp_extract(piece, number, 2), F.lit("0")), F.lit(""))
    code = F.when(digits.isNotNull(), F.coalesce(F.when(F.length(digits) < 30, digits.cast("decimal(38,0)")), F.lit(0x110000))).when(
        F.length(hexed) > 8, F.lit(0x110000)).otherwise(F.conv(F.coalesce(hexed, F.lit("0")), 16, 10).cast("decimal(38,0)")).cast("decimal(38,0)")
    named = F.try_element_at(closed, F.regexp_extract(piece, "^([a-zA-Z][a-zA-Z0-9]*);", 1))
    open_ = F.get(F.filter(short, lambda s: F.startswith(piece, s["k"])), F.lit(0))
    behind = F.regexp_replace(piece, number, "")
    return (F.when(piece.rlike(number), F.concat(character(code), behind)).when(~piece.rlike("^[a-zA-Z]"), F.concat(F.lit("&"), piece))
            .otherwise(F.coalesce(F.concat(named, F.regexp_replace(piece, "^[a-zA-Z0-9]+;", "")),
                                  let(open_, lambda s: F.concat(s["v"], F.substring(piece, F.length(s["k"]) + 1, F.length(piece)))), F.concat(F.lit("&"), piece))))


def unescape(c: Column) -> Column:
    """All character references of a text, each read once; what is none stays as it is."""
    def whole(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(_reference(p))), "")
    return F.when(c.contains("&"), let(F.split(c, "&"), whole)).otherwise(c)
