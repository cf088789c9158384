"""Column expressions that read structure out of an HTML string.

All of them are narrow: they look at one page and never shuffle. Tags are found with linear patterns; scripts,
styles and comments are emptied first (see ``skeleton``) so that markup inside them is not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The entities decoded in text and attributes; "&amp;" comes last so that nothing is decoded twice.
ENTITIES = [
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
]


def rx(column: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` or null."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def rx_all(column: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def unescape(column: Column) -> Column:
    for entity, char in ENTITIES:
        column = F.replace(column, F.lit(entity), F.lit(char))
    return column


def squeeze(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def text_of(fragment: Column) -> Column:
    """Visible text of a fragment: tags become blanks, entities are decoded, blanks are collapsed."""
    return squeeze(unescape(F.regexp_replace(fragment, "<[^>]*>", " ")))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body names it in several branches."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def cut_at_space(text: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters that does not end inside a word."""
    return let(
        text,
        lambda t: F.when(F.length(t) > limit, F.regexp_replace(F.left(t, F.lit(limit)), " [^ ]*$", "")).otherwise(t),
    )


def skeleton(html: Column) -> Column:
    """The page without comments and without what stands inside script and style elements."""
    return F.regexp_replace(
        html,
        r"(?is)<!--.*?-->|(<script(?:\s[^>]*)?>).*?</script\s*>|(<style(?:\s[^>]*)?>).*?</style\s*>",
        "$1$2",
    )


def open_tags(markup: Column, name: str) -> Column:
    return rx_all(markup, rf"(?is)<{name}(?:\s[^>]*)?>")


def elements(markup: Column, name: str) -> Column:
    return rx_all(markup, rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>")


def first_element(markup: Column, name: str) -> Column:
    return rx(markup, rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>", 0)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the first tag of the fragment; empty when absent."""
    raw = F.regexp_extract(tag, rf"(?is)^<[a-z0-9]+(?:\s[^>]*?)?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.trim(unescape(F.regexp_replace(raw, "^[\"']|[\"']$", "")))


def texts_of(fragments: Column) -> Column:
    return F.transform(fragments, text_of)


def non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: F.length(v) > 0)


def distinct_by(values: Column, key) -> Column:
    """Keep the first element per key, in order. ``key`` maps an element to a string column; null keys are dropped.

    Keys are sorted with their positions, so that the work grows with n log n.
    """

    def firsts(vs: Column) -> Column:
        placed = F.array_sort(F.transform(vs, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"))))
        new = let(placed, lambda ps: F.filter(ps, lambda p, j: p["k"].isNotNull() & ~F.get(ps, j - 1)["k"].eqNullSafe(p["k"])))
        return F.transform(F.array_sort(F.transform(new, lambda p: p["i"])), lambda i: F.get(vs, i))

    return let(values, firsts)


def rows_of(df: DataFrame, array: Column | str, *keep: str, pos: str | None = None, item: str = "item") -> DataFrame:
    """One row per array element, with the columns to keep and, if named, the element's position.

    Written as an outer explode and a filter: for a plain explode Spark infers a filter on the array and pushes it
    down, which would compute an expensive array twice.
    """
    if pos:
        exploded = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    else:
        exploded = df.select(*keep, F.explode_outer(array).alias(item))
    return exploded.filter(F.col(item).isNotNull())


def distinct_ignoring_case(values: Column) -> Column:
    return distinct_by(values, F.lower)
