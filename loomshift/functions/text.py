"""Text helpers as Spark columns: lines, regex substitution, cuts, fences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomshift import fixed


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def lines(col) -> Column:
    """Lines of a text, without an empty piece after the last line break."""
    text = _c(col)
    # the last line break is cut off first, so the text is split once
    cut = F.when(F.endswith(text, F.lit("\r\n")), 2).when(F.right(text, F.lit(1)).rlike(fixed.LINE_BREAK), 1).otherwise(0)
    body = F.when(cut > 0, F.left(text, F.length(text) - cut)).otherwise(text)
    # most texts break at \n only, which splits without a pattern
    others = reduce(or_, [text.contains(c) for c in fixed.OTHER_BREAKS])
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(others, F.split(body, fixed.LINE_BREAK, -1))
        .otherwise(F.split(body, "\n", -1))
    )


def substitute(col, pattern: str | Column, replacement: Callable[[Column], Column], needs: str = "") -> Column:
    """Replace every match of a pattern by a column computed from the match.

    One pass whatever the number of rules behind `replacement`, and replaced
    text is never matched again.  The pattern, which a column may give per row, must not match an empty text.
    `needs` is plain text in every match: texts without it skip the pattern.
    """

    wanted = pattern if isinstance(pattern, Column) else F.lit(pattern)

    def rebuilt(text: Column) -> Column:
        between = F.split(text, wanted, F.lit(-1))
        hits = F.transform(F.regexp_extract_all(text, wanted, F.lit(0)), replacement)
        pieces = F.array_join(F.zip_with(between, hits, lambda piece, hit: F.concat(piece, F.coalesce(hit, F.lit("")))), "")
        matched = F.rlike(text, wanted)
        hit = text.contains(needs) & matched if needs else matched
        return F.when(hit, pieces).otherwise(text)

    # the input is named by a function argument, so nested rewrites work out each text once
    return F.get(F.transform(F.array(_c(col)), rebuilt), F.lit(0))


def strip(col) -> Column:
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def truncate(col, limit: int = fixed.RESULT_CHARS) -> Column:
    text = _c(col)
    over = F.length(text) - F.lit(limit)
    marker = F.concat(F.lit("\n... [truncated "), over.cast("string"), F.lit(" chars]"))
    return F.when(over > 0, F.concat(F.substring(text, 1, limit), marker)).otherwise(text)


def label(col, limit: int = fixed.LABEL_CHARS) -> Column:
    """One line, at most `limit` characters, the last three dots when cut."""
    text = F.replace(_c(col), F.lit("\n"), F.lit(" "))
    cut = F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def call_label(name, arguments) -> Column:
    """One line for a call: name(key=value, ...), from a map of text arguments."""
    shown = F.transform(F.map_entries(_c(arguments)), lambda e: F.concat(e["key"], F.lit("="), label(e["value"])))
    return F.concat(_c(name), F.lit("("), F.array_join(shown, ", "), F.lit(")"))


def first_line(col, limit: int) -> Column:
    line = F.get(lines(col), F.lit(0))
    return F.coalesce(F.substring(line, 1, limit), F.lit(""))


def strip_fence(col) -> Column:
    """Content of one code fence around the whole text, else the text itself."""
    text = _c(col)
    fenced = text.rlike(fixed.CODE_FENCE)
    return F.when(fenced, F.regexp_extract(text, fixed.CODE_FENCE, 1)).otherwise(text)


def occurrences(col, part) -> Column:
    """Number of non-overlapping occurrences of a text in another."""
    text, part = _c(col), _c(part)
    removed = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (removed / F.length(part)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def glob_pattern(pattern: str) -> str:
    """Regular expression for a glob over relative paths, `**` included."""
    special = ".^$+{}[]|()\\"
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            # a class never matches the separator
            inner = pattern[i + 1:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            body = "^" + inner[1:] if inner.startswith("!") else inner
            out, i = out + f"(?!/)[{body}]", end + 1
        else:
            out, i = out + ("\\" + pattern[i] if pattern[i] in special else pattern[i]), i + 1
    return f"^{out}$"


def suffix(path) -> Column:
    """Lower-cased suffix of the last path part; '' for none or a leading dot only."""
    name = F.substring_index(_c(path), "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def with_suffix(path, new: str | Column) -> Column:
    """The path with the suffix of its last part replaced or added."""
    new = F.lit(new) if isinstance(new, str) else new
    return F.concat(F.regexp_replace(_c(path), r"(?<=[^/])\.[^./]+$", ""), new)


def stem(path) -> Column:
    return F.regexp_replace(F.substring_index(_c(path), "/", -1), r"(?<=.)\.[^.]+$", "")
