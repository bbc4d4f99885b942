"""Path templates, compiled once into a Column.

A template's levels are parted by '/'. ``{text name:00 text}`` stands for a variable with
conditional text and zero padding; a level whose variables are all unknown goes, as does a
bracketed group inside a level. Values are never looked at as template text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

VARIABLES = ("author", "narrator", "title", "subtitle", "series_name", "series_position", "year", "asin")
_NAME = "|".join(VARIABLES)
_TOKEN = re.compile(r"\{([^{}/]*?)(?<![A-Za-z0-9_])(" + _NAME + r")(?![A-Za-z0-9_])(?::(0+))?([^{}/]*)\}")
_BRACES = re.compile(r"\{[^{}]*\}?")
_GROUP = re.compile(r"[ \t\n\f\r]*(\[[^\[\]]*\]|\([^()]*\))")
_PARTS = re.compile(r"\{[^{}]*\}")


def problem(template: str) -> str | None:
    """What is wrong with a template; None for nothing."""
    if not template.strip():
        return "template is empty"
    for b in _BRACES.findall(template):
        if not b.endswith("}"):
            return f"{b} has no closing brace"
        if not _TOKEN.fullmatch(b):
            return f"{b} names no variable"
    return None if _TOKEN.search(template) else "template has no variables"


_TOKEN_JAVA = r"\{[^{}/]*?(?<![A-Za-z0-9_])(?:" + _NAME + r")(?![A-Za-z0-9_])(?::0+)?[^{}/]*\}"


def problem_of(template: Column) -> Column:
    """The same for templates in a column; ''. Names the first bad brace as ``problem`` does."""
    opened = F.regexp_extract_all(template, F.lit(r"(\{[^{}]*\}?)"), F.lit(1))
    bad = F.filter(opened, lambda b: ~b.rlike("^" + _TOKEN_JAVA + "\\z"))
    first = F.try_element_at(bad, F.lit(1))
    return (
        F.when(text.trimmed(template) == "", "template is empty")
        .when(first.isNotNull() & ~F.endswith(first, F.lit("}")), F.concat(first, F.lit(" has no closing brace")))
        .when(first.isNotNull(), F.concat(first, F.lit(" names no variable")))
        .when(~template.rlike(_TOKEN_JAVA), "template has no variables")
        .otherwise("")
    )


def padded(value: Column, width: int) -> Column:
    """Leading digits filled up with zeros; never shortened."""
    digits = F.regexp_extract(value, "^[0-9]+", 0)
    fill = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(digits))), value)
    return F.when(digits == "", value).otherwise(fill)


def sanitized(segment: Column) -> Column:
    """A level as file systems take it: no reserved characters, single spaces, no dangling or repeated separators."""
    s = F.regexp_replace(segment, '[<>:"/\\\\|?*\\x00-\\x1f]', "")
    s = text.squeezed(s)
    s = F.regexp_replace(s, f"({text.WS}[-–—]{text.WS}?){{2,}}", " - ")
    s = F.regexp_replace(s, "^[\\t\\n\\f\\r \\-–—ـ,.]+|[\\t\\n\\f\\r \\-–—ـ,]+$", "")
    return text.trimmed(F.regexp_replace(s, "[. ]+$", ""))


def _level(segment: str, v: dict[str, Column]) -> Column:
    known = lambda names: _any([v[n] != "" for n in names])

    def render(piece: str) -> Column:
        out, at = [], 0
        for m in _PARTS.finditer(piece):
            out.append(F.lit(piece[at : m.start()]))
            if t := _TOKEN.fullmatch(m[0]):
                value = v[t[2]]
                out.append(F.when(value != "", F.concat(F.lit(t[1]), padded(value, len(t[3] or "")), F.lit(t[4]))).otherwise(""))
            at = m.end()
        return F.concat(*out, F.lit(piece[at:]))

    pieces, at = [], 0
    for g in _GROUP.finditer(segment):
        names = [t[2] for t in _TOKEN.finditer(g[0])]
        if names:
            pieces += [render(segment[at : g.start()]), F.when(known(names), render(g[0])).otherwise("")]
            at = g.end()
    pieces.append(render(segment[at:]))
    level = sanitized(F.concat(*pieces))
    tokens = _PARTS.findall(segment)
    names = [t[2] for t in _TOKEN.finditer(segment)]
    if tokens:
        level = F.when(known(names) if names else F.lit(False), level)
    return F.when(level != "", level)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def rendered(template: str, variables: dict[str, Column]) -> Column:
    """The path a template gives; null where nothing is left."""
    v = {n: F.coalesce(variables.get(n, F.lit("")), F.lit("")) for n in VARIABLES}
    levels = F.array_compact(F.array(*[_level(s, v) for s in template.split("/")]))
    return F.when(F.size(levels) > 0, F.array_join(levels, "/"))


def book_variables(b: Column) -> dict[str, Column]:
    """A record's variables: its first author and narrator."""
    return {n: b[n] for n in VARIABLES if n not in ("author", "narrator")} | {"author": F.try_element_at(b["authors"], F.lit(1)), "narrator": F.try_element_at(b["narrators"], F.lit(1))}


def targets(files, template: str, variables: dict[str, Column], root: str, existing):
    """Adds target and action to files (path): same, move, or a reason to skip; ``existing`` has the paths there are.

    A target that differs in case alone is the file itself. Two files of one batch with the same target are both
    skipped, which the plan can see before anything moves.
    """
    from pyspark.sql.window import Window

    rel = rendered(template, variables)
    out = files.withColumn("target", F.concat(F.lit(root.rstrip("/") + "/"), rel, F.lit(".m4b")))
    there = existing.select(F.col("path").alias("_there"), F.lower("path").alias("_low"))
    out = out.join(there, F.lower("target") == F.col("_low"), "left")
    clash = F.count("*").over(Window.partitionBy(F.lower("target"))) > 1
    action = (
        F.when(F.col("target").isNull(), "skip: no path")
        .when(F.col("target") == F.col("path"), "same")
        .when(clash, "skip: two files, one target")
        .when(F.col("_low") == F.lower("path"), "move")
        .when(F.col("_there").isNotNull(), "skip: another file is there")
        .otherwise("move")
    )
    return out.withColumn("action", action).drop("_there", "_low")
