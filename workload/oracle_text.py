"""SQL text helpers for the oracle queries: HTML reading spelled in DuckDB functions and relational steps."""

from __future__ import annotations

from sitegrain.functions.markup import ENTITIES
from workload.seeded import PAGES_SEEDED_SQL, quote


def text_of(fragment: str) -> str:
    out = f"regexp_replace({fragment}, '<[^>]*>', ' ', 'g')"
    out = unescape(out)
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def unescape(out: str) -> str:
    for entity, char in ENTITIES:
        out = f"replace({out}, {quote(entity)}, {quote(char)})"
    return out


def attribute(tag: str, name: str) -> str:
    pattern = rf"""(?is)^<[a-z0-9]+(?:\s[^>]*?)?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    raw = f"regexp_extract({tag}, {quote(pattern)}, 1)"
    return f"trim({unescape(f'trim({raw}, {quote(chr(34) + chr(39))})')})"


def element_pattern(name: str) -> str:
    return rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>"


def elements(markup: str, name: str) -> str:
    return f"regexp_extract_all({markup}, {quote(element_pattern(name))})"


def first_element(markup: str, name: str) -> str:
    return f"nullif(regexp_extract({markup}, {quote(element_pattern(name))}), '')"


def open_tags(markup: str, name: str) -> str:
    return f"regexp_extract_all({markup}, {quote(rf'(?is)<{name}(?:\s[^>]*)?>')})"


def cut(text: str, limit: int) -> str:
    return f"CASE WHEN length({text}) > {limit} THEN regexp_replace(left({text}, {limit}), ' [^ ]*$', '') ELSE {text} END"


def unnest_list(source: str, expression: str, item: str = "v", keep: str = "page_id") -> str:
    """SELECT with one row per list item and its 1-based position ``n``."""
    return (
        f"SELECT {keep}, unnest({expression}) AS {item}, generate_subscripts({expression}, 1) AS n FROM {source}"
    )


_SKELETON = (
    "markup AS MATERIALIZED (SELECT page_id, url, domain, html, regexp_replace(regexp_replace(regexp_replace(html, "
    r"'(?is)<!--.*?-->', '', 'g'), '(?is)(<script(?:\s[^>]*)?>).*?</script\s*>', '\1', 'g'), "
    r"'(?is)(<style(?:\s[^>]*)?>).*?</style\s*>', '\1', 'g') AS markup FROM pages_seeded)"
)

_METAS = f"""
meta_tags AS (SELECT page_id, n, t FROM ({unnest_list('markup', open_tags('markup', 'meta'), 't')})),
metas AS MATERIALIZED (SELECT page_id, n, lower(coalesce(nullif({attribute('t', 'name')}, ''), nullif({attribute('t', 'property')}, ''),
  nullif({attribute('t', 'http-equiv')}, ''))) AS key, {attribute('t', 'content')} AS content FROM meta_tags)
""".strip()

_LINKS = rf"""
link_parts AS (SELECT page_id, url, domain, n AS part_no, part FROM (
  SELECT page_id, url, domain, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM (
    SELECT page_id, url, domain, string_split(regexp_replace(regexp_replace(markup, '(?i)(<(?:nav|footer)[\s>])', chr(1) || '\1', 'g'),
      '(?i)(</(?:nav|footer)>)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM markup))),
link_items AS (SELECT page_id, url, domain, part_no, part, unnest({elements('part', 'a')}) AS a,
  generate_subscripts({elements('part', 'a')}, 1) AS k FROM link_parts),
links AS MATERIALIZED (SELECT page_id, url, domain, row_number() OVER (PARTITION BY page_id ORDER BY part_no, k) - 1 AS pos,
  {attribute('a', 'href')} AS href, {text_of('a')} AS text,
  CASE WHEN regexp_matches(part, '(?i)^<nav[\s>]') THEN 'nav' WHEN regexp_matches(part, '(?i)^<footer[\s>]') THEN 'footer'
    ELSE 'body' END AS region FROM link_items)
""".strip()

PARTS = {"markup": _SKELETON, "metas": _METAS, "links": _LINKS}


def with_pages(body: str, *parts: str, ctes: str = "") -> str:
    """A full statement: seeded pages, the named shared steps, own steps, then the query."""
    steps = [PAGES_SEEDED_SQL]
    wanted = ["markup", *parts] if parts else []
    for part in dict.fromkeys(wanted):
        steps.append(PARTS[part])
    if ctes:
        steps.append(ctes.strip().rstrip(","))
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n" + body


def absolutize(base: str, href: str) -> str:
    origin = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
    scheme = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*:')"
    path = path_of(base)
    return f"""CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href}
      WHEN {href} LIKE '//%' THEN {scheme} || {href}
      WHEN {href} LIKE '/%' THEN {origin} || {href}
      WHEN {href} LIKE '#%' THEN split_part({base}, '#', 1) || {href}
      WHEN {href} LIKE '?%' THEN {origin} || {path} || {href}
      WHEN {href} = '' THEN split_part({base}, '#', 1)
      ELSE {origin} || regexp_replace({path}, '[^/]*$', '') || {href} END"""


def path_of(url: str) -> str:
    path = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"coalesce(nullif({path}, ''), '/')"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, (int, float)) else quote(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def boundary(pattern: str) -> str:
    r"""Spell word boundaries out: ``\b`` before a word becomes "start or non-word", after it "end or non-word"."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            nxt = pattern[i + 2 : i + 3]
            before_word = bool(nxt) and (nxt.isalnum() or nxt in "_(<" or pattern.startswith(r"\d", i + 2))
            out += r"(?:^|[^\p{L}\p{N}_])" if before_word else r"(?:[^\p{L}\p{N}_]|$)"
            i += 2
        else:
            out += pattern[i]
            i += 1
    return out
