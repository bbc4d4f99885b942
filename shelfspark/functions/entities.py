"""Character references, decoded as browsers do, in expressions that stay in the JVM.

Named references are those of the HTML standard, from the table of Python's own library;
some count without a semicolon, the longest first. Numbers name code points; those of
0x80 to 0x9F mean Windows-1252, and impossible ones the replacement character.
"""

from __future__ import annotations

import html.entities
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHORT = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
_ANY_SHORT = "|".join(_SHORT)
_PIECE = f"(&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;|&(?:{_ANY_SHORT})|[^&]+|&)"


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, str], dict[str, str]]:
    old = {}
    for code in range(0x80, 0xA0):
        try:
            old[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            pass  # those five stand for themselves
    return {f"&{k}": v for k, v in html.entities.html5.items()}, old


def _map(table: dict[str, str]) -> Column:
    """A table as one literal, which the optimizer folds into a map."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))


def _character(code: Column) -> Column:
    bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    raw = F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0"))
    return F.when(bad, "\ufffd").otherwise(F.coalesce(F.try_element_at(_map(_tables()[1]), code.cast("string")), F.decode(raw, "UTF-32")))


def _decoded(piece: Column) -> Column:
    hexadecimal = F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]*);?$", 1)
    decimal = F.regexp_extract(piece, "^&#0*([0-9]*);?$", 1)
    number = lambda digits, base: F.when(F.length(digits) <= 8, F.conv(F.when(digits == "", "0").otherwise(digits), base, 10).cast("long"))
    named = F.try_element_at(_map(_tables()[0]), piece)
    short = F.regexp_extract(piece, f"^&({_ANY_SHORT})", 1)
    shortened = F.when(short != "", F.concat(F.try_element_at(_map(_tables()[0]), F.concat(F.lit("&"), short)), F.substring(piece, F.length(short) + 2, F.lit(1 << 30))))
    return (
        F.when(~F.startswith(piece, F.lit("&")) | (piece == "&"), piece)
        .when(piece.rlike("^&#[xX]"), _character(number(hexadecimal, 16)))
        .when(F.startswith(piece, F.lit("&#")), _character(number(decimal, 10)))
        .otherwise(F.coalesce(named, shortened, piece))
    )


def unescape(c: Column) -> Column:
    """All character references of a text decoded, once."""
    pieces = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(1))
    return F.when(~F.contains(c, F.lit("&")), c).otherwise(F.array_join(F.transform(pieces, _decoded), ""))
