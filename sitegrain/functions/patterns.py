r"""Turns rule patterns into guarded column predicates.

A rule set of a hundred regular expressions is far too slow when every one scans every page. Each pattern here is
guarded by ``contains(literal)`` with a text every match must hold, so the expression engine only starts where a hit
is likely; a pattern that is plain text needs no expression at all.
"""

from __future__ import annotations

import json
import re
import re._constants as codes
import re._parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.markup import let

# Case-blind with Unicode word boundaries, so that "\b" next to an accented letter is judged by letters.
FLAGS = "(?iU)"


def branches(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 1
        elif char in "([":
            depth += 1
        elif char in ")]":
            depth -= 1
        elif char == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def fixed_text(pattern: str) -> tuple[str, bool]:
    """Longest text that every match holds, in lower case, and whether the pattern is nothing but that text."""
    runs, current, plain = [], "", True
    for code, value in parser.parse(pattern):
        if code is codes.LITERAL:
            current += chr(value)
        else:
            plain = False
            runs.append(current)
            current = ""
    runs.append(current)
    return max(runs, key=len).lower(), plain


def constant(rows, schema: str) -> Column:
    """A fixed rule table as one literal: parsed once by the optimizer, however long it is."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


def constant_map(pairs) -> Column:
    return constant(dict(pairs), "map<string,string>")


def branch_rows(patterns: list[str]) -> list[dict]:
    """Alternatives of the patterns as (literal, dotted, pattern); the pattern is left out where the literal says it all."""
    rows = []
    for branch in (b for p in patterns for b in branches(p)):
        literal, plain = fixed_text(branch)
        dotted = re.fullmatch(r"[a-z0-9_-]*(\.[a-z0-9_-]+)+", literal) is not None
        rows.append({"literal": literal, "dotted": dotted, "pattern": None if plain else FLAGS + branch})
    return rows


BRANCHES = "branches: array<struct<literal: string, dotted: boolean, pattern: string>>"


def dotted_words(low: Column) -> Column:
    """All dotted words of a page (hosts, file names, object paths), which is where most literals can stand at all."""
    words = F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9_-])[a-z0-9_-]*+(?:\.[a-z0-9_-]+)+"), F.lit(0))
    return F.array_join(F.array_distinct(words), " ")


def rules_hit(table: Column, low: Column, text: Column, dots: Column) -> Column:
    """Rows of a rule table with any branch found; ``dots`` holds the dotted words of ``low``."""

    def over(page: Column) -> Column:
        def hit(branch: Column) -> Column:
            place = F.when(branch["dotted"], page["dots"]).otherwise(page["low"])
            return F.contains(place, branch["literal"]) & (
                branch["pattern"].isNull() | F.rlike(page["text"], F.coalesce(branch["pattern"], F.lit("")))
            )

        return F.filter(table, lambda rule: F.exists(rule["branches"], hit))

    return let(F.struct(low.alias("low"), text.alias("text"), dots.alias("dots")), over)


def labels_found(low: Column, text: Column, rules: list[tuple[str, str]], dots: Column | None = None) -> Column:
    """Labels of the rules (label, pattern) that hit, in rule order."""
    rows = [{"label": label, "branches": branch_rows([p])} for label, p in rules]
    table = constant(rows, f"array<struct<label: string, {BRANCHES}>>")
    return F.transform(rules_hit(table, low, text, low if dots is None else dots), lambda r: r["label"])


def found_any(low: Column, text: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs in ``text`` ignoring case; ``low`` is the lower-case text."""
    table = constant([{"branches": branch_rows(patterns)}], f"array<struct<{BRANCHES}>>")
    return F.size(rules_hit(table, low, text, low)) > 0


def count_found(low: Column, text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    table = constant([{"branches": branch_rows([p])} for p in patterns], f"array<struct<{BRANCHES}>>")
    return F.size(rules_hit(table, low, text, low))


def points_found(low: Column, rows: list[tuple[str, int]]) -> Column:
    """Sum of the points of the patterns (pattern, points) that occur in a lower-case text."""
    table = constant([{"points": w, "branches": branch_rows([p])} for p, w in rows], f"array<struct<points: int, {BRANCHES}>>")
    return F.aggregate(rules_hit(table, low, low, low), F.lit(0), lambda total, r: total + r["points"])


def contains_any(low: Column, words: list[str]) -> Column:
    return let(low, lambda t: F.exists(constant(words, "array<string>"), lambda w: F.contains(t, w)))


def words_in(low: Column, words: list[str]) -> Column:
    """The words that the text holds."""
    return let(low, lambda t: F.filter(constant(words, "array<string>"), lambda w: F.contains(t, w)))
