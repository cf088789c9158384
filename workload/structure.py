"""Registered queries and oracle SQL for page structure (relations a page yields)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.functions.urls import absolutize, asset_host, domain_matches
from sitegrain.operators import structure as st
from sitegrain.rules import page as rules
from sitegrain.sources.pages import pages_per_domain, read_pages
from workload.oracle_text import (
    absolutize as abs_sql,
    attribute,
    cut,
    elements,
    first_element,
    open_tags,
    text_of,
    unnest_list,
    values,
    with_pages,
)
from workload.seeded import domain_sql, pages_seeded, quote

SEP = " | "


def joined(df, *names):
    """Lists as text, so that every compared column is a scalar."""
    for name in names:
        df = df.withColumn(name, F.array_join(name, SEP))
    return df


def _stored_pages(spark, d):
    pages = read_pages(spark, d)
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("html_length"))


def _same_site(spark, d):
    links = st.page_links(pages_seeded(spark, d))
    hosts = links.withColumn("host", asset_host(F.col("href"))).filter("host IS NOT NULL")
    return hosts.groupBy("domain").agg(
        F.count_if(domain_matches(F.col("host"), F.col("domain"))).alias("own_links"),
        F.count_if(~domain_matches(F.col("host"), F.col("domain"))).alias("foreign_links"),
    )


def _absolute(spark, d):
    links = st.page_links(pages_seeded(spark, d))
    return links.select("page_id", "pos", absolutize(F.col("url"), F.col("href")).alias("target"))


QUERIES = {
    "src1_pages": _stored_pages,
    "u1_pages_per_domain": lambda s, d: pages_per_domain(read_pages(s, d)),
    "u2_same_site_links": _same_site,
    "u3_absolute_links": _absolute,
    "st1_page_identity": lambda s, d: st.page_identity(pages_seeded(s, d)),
    "st2_page_meta": lambda s, d: st.page_meta(pages_seeded(s, d)),
    "st2_meta_summary": lambda s, d: joined(st.meta_summary(pages_seeded(s, d)), "keywords"),
    "st3_page_headings": lambda s, d: st.page_headings(pages_seeded(s, d)),
    "st3_heading_summary": lambda s, d: joined(st.heading_summary(pages_seeded(s, d)), "h1_all"),
    "st4_page_links": lambda s, d: st.page_links(pages_seeded(s, d)),
    "st4_nav_links": lambda s, d: st.nav_links(pages_seeded(s, d)),
    "st5_page_ctas": lambda s, d: st.page_ctas(pages_seeded(s, d)),
    "st6_page_footer": lambda s, d: st.page_footer(pages_seeded(s, d)),
    "st7_page_body": lambda s, d: st.page_body(pages_seeded(s, d)),
    "st7_page_body_whole": lambda s, d: st.page_body(pages_seeded(s, d), limit=None),
    "st9_page_assets": lambda s, d: st.page_assets(pages_seeded(s, d)),
    "st10_page_inline": lambda s, d: st.page_inline(pages_seeded(s, d)),
    "st11_page_context": lambda s, d: joined(
        st.page_context(pages_seeded(s, d)), "nav_links", "h1", "h2", "schema_types", "cta_texts"
    ),
    "st11_context_markdown": lambda s, d: st.context_markdown(st.page_context(pages_seeded(s, d))),
    "st12_important_pages": lambda s, d: st.important_pages(pages_seeded(s, d)),
    "st12_important_pages_bulk": lambda s, d: st.important_pages(pages_seeded(s, d), "bulk"),
    "st13_lead_magnets": lambda s, d: joined(st.lead_magnets(pages_seeded(s, d)), "lead_magnets"),
    "st14_blog_facts": lambda s, d: st.blog_facts(_blog_pages(s, d)),
}


def _blog_pages(spark, d):
    """The seeded pages, each second one stored under a blog path of its site."""
    paths = F.array(*[F.lit(p) for p in rules.BLOG_PATHS])
    path = F.get(paths, F.pmod(F.col("page_id"), F.lit(len(rules.BLOG_PATHS))).cast("int"))
    url = F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), path)
    return pages_seeded(spark, d).withColumn("url", F.when(F.col("page_id") % 2 == 1, url).otherwise(F.col("url")))


# --- oracle -----------------------------------------------------------------------------------------------------

TITLE = text_of(r"regexp_extract(markup, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)")
LANG = attribute(r"regexp_extract(markup, '(?is)<html(?:\s[^>]*)?>')", "lang")
_noise = "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in rules.NOISE_TAGS)
_bare = f"regexp_replace(markup, {quote('(?is)' + _noise)}, ' ', 'g')"
BODY = (
    f"coalesce({text_of('coalesce(' + first_element('bare', 'main') + ', ' + first_element('bare', 'article') + ', nullif(regexp_extract(bare, ' + quote(r'(?is)<body(?:\s[^>]*)?>.*?(?:</body\s*>|\z)') + '), chr(0)))')}, '')"
)
BODIES = f"bodies AS MATERIALIZED (SELECT page_id, {BODY} AS body FROM (SELECT page_id, {_bare} AS bare FROM markup))"


def _first_meta(key: str, alias: str) -> str:
    return f"(SELECT arg_min(content, n) FROM metas t WHERE t.page_id = m.page_id AND key = '{key}' AND content <> '') AS {alias}"


_heads = "\nUNION ALL\n".join(
    f"SELECT page_id, {lv} AS level, n, {text_of('v')} AS text FROM ({unnest_list('markup', elements('markup', f'h{lv}'))})"
    for lv in (1, 2)
)
HEADS = f"heads AS MATERIALIZED (SELECT page_id, level, row_number() OVER (PARTITION BY page_id, level ORDER BY n) - 1 AS pos, text FROM ({_heads}) WHERE text <> '')"


def nav_sql(limit=None, text_max=None):
    return f"""
nav_first AS (SELECT page_id, text, pos, row_number() OVER (PARTITION BY page_id, lower(text) ORDER BY pos) AS seen
  FROM links WHERE region = 'nav' AND length(text) BETWEEN 1 AND {text_max or 1000000000}),
nav AS (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos FROM nav_first WHERE seen = 1
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY nav_first.pos) <= {limit or 1000000000})
""".strip()


_cta_hit = " OR ".join(f"contains(lower(text), {quote(w)})" for w in rules.CTA_WORDS)


def ctas_sql(limit=None, text_max=None):
    return f"""
cta_all AS (
  SELECT page_id, 0 AS src, n AS k, {text_of('v')} AS text FROM ({unnest_list('markup', elements('markup', 'button'))})
  UNION ALL SELECT page_id, 1, pos, text FROM links WHERE {_cta_hit}),
cta_first AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(text) ORDER BY src, k) AS seen FROM cta_all
  WHERE length(text) BETWEEN 1 AND {text_max or 1000000000}),
ctas AS (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY src, k) - 1 AS pos FROM cta_first WHERE seen = 1
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY src, k) <= {limit or 1000000000})
""".strip()


FOOTER_WHOLE = text_of(first_element("markup", "footer"))
FOOTER_TEXT = cut(text_of(first_element("markup", "footer")), 500)
_named = "|".join(rf"""<{t}\s[^>]*(?:class|id)=["'][^"']*footer[^"']*["'][^>]*>.*?</{t}>""" for t in ("div", "section"))
CONTACT_FOOTER = f"coalesce({first_element('html', 'footer')}, nullif(regexp_extract(html, {quote('(?is)' + _named)}), ''), right(html, 2000))"

_action = attribute("t", "action")
_data = rf"""trim(regexp_extract(t, '(?is)\sdata-[a-zA-Z0-9_-]+\s*=\s*["'']([^"'']*://[^"'']*)["'']', 1))"""
ASSETS = f"""
asset_tags AS (
  SELECT page_id, domain, 'script' AS kind, 1 AS k, n, t FROM ({unnest_list('markup', open_tags('markup', 'script'), 't', 'page_id, domain')})
  UNION ALL SELECT page_id, domain, 'iframe', 2, n, t FROM ({unnest_list('markup', open_tags('markup', 'iframe'), 't', 'page_id, domain')})
  UNION ALL SELECT page_id, domain, 'form', 3, n, t FROM ({unnest_list('markup', open_tags('markup', 'form'), 't', 'page_id, domain')})),
asset_urls AS (SELECT page_id, domain, kind, k, n, CASE WHEN kind <> 'form' THEN {attribute('t', 'src')}
    WHEN contains(coalesce(nullif({_action}, ''), {_data}), '://') THEN coalesce(nullif({_action}, ''), {_data}) ELSE '' END AS url FROM asset_tags),
asset_hosts AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:;\\s]+)', 1)), '^www[.]', '') AS host
  FROM asset_urls),
asset_first AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind, split_part(url, '?', 1) ORDER BY n) AS seen FROM asset_hosts
  WHERE host <> '' AND host <> domain AND NOT suffix(host, '.' || domain)),
assets AS MATERIALIZED (SELECT page_id, domain, kind, row_number() OVER (PARTITION BY page_id ORDER BY k, n) - 1 AS pos, url, host
  FROM asset_first WHERE seen = 1)
""".strip()

INLINE = f"""
inline_tags AS (
  SELECT page_id, n, v FROM ({unnest_list('pages_seeded', 'regexp_extract_all(html, ' + quote(r'(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>') + ')')})),
inline_all AS (
  SELECT page_id, 'js' AS kind, n, regexp_replace(regexp_replace(v, '(?is)^<script(?:\\s[^>]*)?>', ''), '(?is)</script\\s*>$', '') AS text
  FROM inline_tags WHERE regexp_matches(v, '(?i)^<script') AND {attribute('v', 'src')} = ''
  UNION ALL SELECT page_id, 'comment', n, trim(v)
  FROM ({unnest_list('pages_seeded', "regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)")})),
inline AS MATERIALIZED (SELECT page_id, kind, row_number() OVER (PARTITION BY page_id, kind ORDER BY n) - 1 AS pos, text FROM inline_all WHERE text <> '')
""".strip()

LD = rf"""
ld_raw AS (SELECT page_id, n AS block, regexp_replace(trim(regexp_replace(v, '(?s)<!--.*?-->|\s+', ' ', 'g')), '[;\s]+$', '') AS j
  FROM ({unnest_list('pages_seeded', "regexp_extract_all(html, " + quote(r'(?is)<script[^>]*type=["' + "'" + r']application/ld\+json["' + "'" + r'][^>]*>(.*?)</script>') + ", 1)")})),
ld AS MATERIALIZED (SELECT page_id, block, CAST(j AS JSON) AS j FROM ld_raw WHERE json_valid(j)),
ld_tree AS MATERIALIZED (SELECT ld.page_id, ld.block, t.* FROM ld, json_tree(ld.j) t)
""".strip()
LD_TYPES = """
ld_type_rows AS (
  SELECT page_id, block, id, trim(json_extract_string(value, '$')) AS type FROM ld_tree WHERE key = '@type' AND type = 'VARCHAR'
  UNION ALL SELECT c.page_id, c.block, c.id, trim(json_extract_string(c.value, '$')) FROM ld_tree c JOIN ld_tree p
    ON p.page_id = c.page_id AND p.block = c.block AND p.id = c.parent AND p.key = '@type' AND p.type = 'ARRAY'),
ld_first AS (SELECT page_id, type, min(block * 1000000 + id) AS o FROM ld_type_rows WHERE type <> '' GROUP BY ALL),
ld_types AS (SELECT page_id, string_agg(type, ' | ' ORDER BY o) AS schema_types, string_agg(type, ', ' ORDER BY o) AS shown FROM ld_first GROUP BY page_id)
""".strip()
CONTEXT = ",\n".join([HEADS, nav_sql(15, 60), ctas_sql(10, 80), LD, LD_TYPES, BODIES]) + f""",
context AS MATERIALIZED (SELECT m.page_id, m.url, m.domain, {LANG} AS lang, left({TITLE}, 300) AS title,
  {_first_meta('description', 'md')}, {_first_meta('og:type', 'ot')}, {_first_meta('og:description', 'od')},
  (SELECT string_agg(text, chr(2) ORDER BY pos) FROM nav WHERE nav.page_id = m.page_id) AS nv,
  (SELECT string_agg(text, chr(2) ORDER BY pos) FROM heads WHERE heads.page_id = m.page_id AND level = 1) AS hh1,
  (SELECT string_agg(text, chr(2) ORDER BY pos) FROM heads WHERE heads.page_id = m.page_id AND level = 2) AS hh2,
  (SELECT replace(schema_types, ' | ', chr(2)) FROM ld_types WHERE ld_types.page_id = m.page_id) AS st,
  (SELECT string_agg(text, chr(2) ORDER BY pos) FROM ctas WHERE ctas.page_id = m.page_id) AS ct,
  {FOOTER_TEXT} AS ft, (SELECT {cut('body', 3000)} FROM bodies WHERE bodies.page_id = m.page_id) AS bt, length(html) AS hl FROM markup m)
"""
_ctx = {"lang": "lang", "title": "title", "meta_description": "left(md, 500)", "og_type": "left(ot, 80)", "og_description": "left(od, 500)",
        "nav_links": "nv", "h1": "hh1", "h2": "hh2", "schema_types": "st", "cta_texts": "ct", "footer_text": "ft", "body_text": "bt"}
_sheet = []
for _section, _lines in rules.SHEET:
    _sheet.append(f"'[{_section}]' || chr(10)")
    for _label, _name, _list in _lines:
        _v = "domain" if _name == "domain" else _ctx[_name]
        _sheet.append(f"{quote(_label)} || coalesce(nullif(replace({_v}, chr(2), ', '), ''), '—') || chr(10)")
    if _section != rules.SHEET[-1][0]:
        _sheet.append("chr(10)")


def _important(variant: str) -> str:
    paths = rules.IMPORTANT_PATHS[variant]
    table = values("paths", ["ord", "path", "title"], [(i, p, t) for i, (p, t) in enumerate(paths)])
    return with_pages(
        f"SELECT page_id, CAST(ord AS INTEGER) AS ord, path, title, {abs_sql('url', 'href')} AS target FROM (SELECT l.*, p.* , row_number() OVER "
        f"(PARTITION BY page_id, path ORDER BY pos) AS rn FROM links l JOIN paths p ON contains(lower(href), path)) WHERE rn = 1",
        "links",
        ctes=table,
    )


_words = values("words", ["wn", "w"], list(enumerate(rules.LEAD_WORDS)))
LEADS = f"""
{_words},
forms AS (SELECT page_id, url, n, {attribute('t', 'action')} AS action FROM ({unnest_list('markup', open_tags('markup', 'form'), 't', 'page_id, url')})),
page_words AS (SELECT page_id, wn, w FROM pages_seeded JOIN words ON contains(lower(html), w)),
magnets AS (
  SELECT page_id, 0 AS a, n AS b, {abs_sql('url', 'action')} AS target FROM forms WHERE action NOT IN ('', '#')
  UNION ALL SELECT l.page_id, 1 + wn, pos, {abs_sql('url', 'href')} FROM links l JOIN page_words p ON p.page_id = l.page_id
    WHERE href <> '' AND (contains(lower(text), w) OR contains(lower(href), w))),
magnet_first AS (SELECT page_id, target, min(a * 1000000 + b) AS o FROM magnets
  WHERE a = 0 OR NOT (suffix(target, '#') OR suffix(target, 'javascript:void(0)')) GROUP BY ALL),
magnet_top AS (SELECT page_id, string_agg(target, ' | ' ORDER BY o) AS t FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o) AS rn
  FROM magnet_first) GROUP BY page_id)
"""

_blog_rows = values("blog_paths", ["priority", "path"], list(enumerate(rules.BLOG_PATHS)))
_cont = quote(r"(?is)<article(?:\s[^>]*)?>.*?</article\s*>|<li(?:\s[^>]*)?>.*?</li\s*>")
_first_time = first_element("markup", "time")
BLOG = f"""
{_blog_rows},
blogs AS (SELECT m.page_id, m.domain, b.priority, regexp_extract(m.url, '^([a-z]+://[^/]+)', 1) || b.path AS url, m.markup, m.html
  FROM markup m JOIN blog_paths b ON b.priority = m.page_id % 9 WHERE m.page_id % 2 = 1 AND length(m.html) >= 300),
blog_items AS (SELECT page_id, url, unnest(regexp_extract_all(markup, {_cont})) AS c,
  generate_subscripts(regexp_extract_all(markup, {_cont}), 1) AS n FROM blogs),
blog_dated AS (SELECT page_id, url, arg_min({first_element('c', 'a')}, n) AS a FROM blog_items
  WHERE regexp_matches({text_of('c')}, {quote(rules.DATE_PATTERN)}) AND regexp_matches(c, '(?is)<a\\s[^>]*href') GROUP BY ALL),
blog_rows AS (SELECT b.domain, b.priority, b.page_id, b.url AS blog_url,
  left(coalesce(nullif(regexp_extract(html, '(?i)<pubDate>\\s*([^<]+?)\\s*</pubDate>', 1), ''), nullif(regexp_extract({text_of('markup')}, {quote(rules.DATE_PATTERN)}, 1), ''),
    nullif({attribute(_first_time, 'datetime')}, ''), nullif({text_of(_first_time)}, '')), 30) AS last_post_date,
  {abs_sql('b.url', attribute('d.a', 'href'))} AS last_post_url, left({text_of('d.a')}, 100) AS last_post_title
  FROM blogs b LEFT JOIN blog_dated d ON d.page_id = b.page_id)
"""

ORACLE = {
    "src1_pages": "SELECT page_id, url, length(html) AS html_length FROM pages",
    "u1_pages_per_domain": f"SELECT {domain_sql('url')} AS domain, count(*) AS pages, min(page_id) AS first_page_id FROM pages GROUP BY 1",
    "u2_same_site_links": with_pages(
        "SELECT domain, sum(CASE WHEN own THEN 1 ELSE 0 END)::BIGINT AS own_links, sum(CASE WHEN own THEN 0 ELSE 1 END)::BIGINT AS foreign_links FROM ("
        "SELECT domain, host = domain OR suffix(host, '.' || domain) OR suffix(domain, '.' || host) AS own FROM ("
        r"SELECT domain, regexp_replace(lower(regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:;\s]+)', 1)), '^www[.]', '') AS host FROM links) WHERE host <> '') GROUP BY domain",
        "links",
    ),
    "u3_absolute_links": with_pages(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, {abs_sql('url', 'href')} AS target FROM links", "links"),
    "st1_page_identity": with_pages(
        f"""SELECT page_id, domain, left({TITLE}, 300) AS title, nullif({LANG}, '') AS lang,
        lower(trim(split_part(coalesce(nullif({LANG}, ''), (SELECT arg_min(content, n) FROM metas t WHERE t.page_id = m.page_id
          AND key = 'content-language' AND content <> '')), '-', 1))) AS language,
        (SELECT arg_min({attribute('t', 'href')}, n) FROM ({unnest_list('markup', open_tags('markup', 'link'), 't')}) k
          WHERE k.page_id = m.page_id AND lower({attribute('t', 'rel')}) = 'canonical') AS canonical FROM markup m""",
        "metas",
    ),
    "st2_page_meta": with_pages(
        "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS pos, key, content FROM metas WHERE key IS NOT NULL", "metas"
    ),
    "st2_meta_summary": with_pages(
        f"""SELECT page_id, coalesce(d, od) AS description, (SELECT string_agg(w, ' | ' ORDER BY k) FROM (SELECT trim(w) AS w, k,
          row_number() OVER (ORDER BY k) AS rn FROM (SELECT unnest(string_split(kw, ',')) AS w, generate_subscripts(string_split(kw, ','), 1) AS k)
          WHERE trim(w) <> '')) AS keywords, ot AS og_type, oti AS og_title, od AS og_description, title = '' AS missing_title,
          coalesce(d, od) IS NULL AS missing_description FROM (SELECT page_id, {TITLE} AS title, {_first_meta('description', 'd')},
          {_first_meta('og:description', 'od')}, {_first_meta('keywords', 'kw')}, {_first_meta('og:type', 'ot')}, {_first_meta('og:title', 'oti')} FROM markup m)""",
        "metas",
    ),
    "st3_page_headings": with_pages("SELECT page_id, CAST(level AS INTEGER) AS level, CAST(pos AS INTEGER) AS pos, text FROM heads", "markup", ctes=HEADS),
    "st3_heading_summary": with_pages(
        "SELECT m.page_id, (SELECT left(text, 150) FROM heads h WHERE h.page_id = m.page_id AND level = 1 AND pos = 0) AS h1, coalesce((SELECT "
        "string_agg(left(text, 80), ' | ' ORDER BY pos) FROM heads h WHERE h.page_id = m.page_id AND level = 1 AND pos < 3), '') AS h1_all FROM markup m",
        "markup",
        ctes=HEADS,
    ),
    "st4_page_links": with_pages("SELECT page_id, url, domain, CAST(pos AS INTEGER) AS pos, href, text, region FROM links", "links"),
    "st4_nav_links": with_pages("SELECT page_id, CAST(pos AS INTEGER) AS pos, text FROM nav", "links", ctes=nav_sql()),
    "st5_page_ctas": with_pages("SELECT page_id, CAST(pos AS INTEGER) AS pos, text FROM ctas", "links", ctes=ctas_sql()),
    "st6_page_footer": with_pages(f"SELECT page_id, {FOOTER_WHOLE} AS footer_text, {CONTACT_FOOTER} AS contact_footer FROM markup", "markup"),
    "st7_page_body": with_pages(f"SELECT page_id, {cut('body', 3000)} AS body_text FROM bodies", "markup", ctes=BODIES),
    "st7_page_body_whole": with_pages("SELECT page_id, body AS body_text FROM bodies", "markup", ctes=BODIES),
    "st9_page_assets": with_pages("SELECT page_id, domain, kind, CAST(pos AS INTEGER) AS pos, url, host FROM assets", "markup", ctes=ASSETS),
    "st10_page_inline": with_pages("SELECT page_id, kind, CAST(pos AS INTEGER) AS pos, text FROM inline", ctes=INLINE),
    "st11_page_context": with_pages(
        "SELECT page_id, url, domain, "
        + ", ".join(f"coalesce(replace({v}, chr(2), ' | '), '') AS {k}" for k, v in _ctx.items())
        + ", CAST(hl AS INTEGER) AS html_length FROM context",
        "metas",
        "links",
        ctes=CONTEXT,
    ),
    "st11_context_markdown": with_pages(f"SELECT page_id, domain, {' || '.join(_sheet)} AS markdown FROM context", "metas", "links", ctes=CONTEXT),
    "st12_important_pages": _important("full"),
    "st12_important_pages_bulk": _important("bulk"),
    "st13_lead_magnets": with_pages(
        """SELECT m.page_id, CAST((SELECT count(*) FROM forms f WHERE f.page_id = m.page_id) AS INTEGER) AS forms_found,
        coalesce((SELECT t FROM magnet_top t WHERE t.page_id = m.page_id), (SELECT 'keyword: ' || arg_min(w, wn) FROM page_words w WHERE w.page_id = m.page_id), '')
        AS lead_magnets FROM markup m""",
        "links",
        ctes=LEADS,
    ),
    "st14_blog_facts": with_pages(
        "SELECT domain, blog_url, last_post_date, last_post_url, last_post_title FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority, page_id) AS rn FROM blog_rows) WHERE rn = 1",
        "markup",
        ctes=BLOG,
    ),
}
