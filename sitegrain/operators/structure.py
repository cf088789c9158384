"""Page-to-relation jobs: what a page says about itself, as long relations.

Every function reads pages(page_id, url, html) and works row by row inside the JVM: no shuffle, no Python worker,
and ``html`` never leaves the scan stage. Within-page distinct and caps are array expressions for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import markup as m
from sitegrain.functions.patterns import constant, contains_any, words_in
from sitegrain.functions.urls import absolutize, asset_host, is_under, path_of
from sitegrain.rules import page as rules
from sitegrain.sources.pages import with_domain, with_skeleton

MISSING = "—"


# --- expressions over the skeleton ------------------------------------------------------------------------------


def _metas(markup: Column) -> Column:
    """Meta tags as (key, content): the key is the name, property or http-equiv in lower case."""

    def pair(tag: Column) -> Column:
        names = [F.nullif(m.attribute(tag, a), F.lit("")) for a in ("name", "property", "http-equiv")]
        return F.struct(F.lower(F.coalesce(*names)).alias("key"), m.attribute(tag, "content").alias("content"))

    return F.filter(F.transform(m.open_tags(markup, "meta"), pair), lambda t: t["key"].isNotNull())


def _meta(metas: Column, key: str) -> Column:
    hit = F.filter(metas, lambda t: (t["key"] == key) & (t["content"] != ""))
    return F.get(hit, F.lit(0))["content"]


def _title(markup: Column) -> Column:
    return m.text_of(F.regexp_extract(markup, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1))


def _html_lang(markup: Column) -> Column:
    return m.attribute(F.regexp_extract(markup, r"(?is)<html(?:\s[^>]*)?>", 0), "lang")


def _headings(markup: Column, level: int) -> Column:
    return m.non_empty(m.texts_of(m.elements(markup, f"h{level}")))


def _links(markup: Column) -> Column:
    """Anchors in document order with the region they stand in."""
    parts = F.split(markup, r"(?i)(?=<nav[\s>])|(?=<footer[\s>])|(?<=</nav>)|(?<=</footer>)")

    def anchors(part: Column) -> Column:
        region = (
            F.when(part.rlike(r"(?i)^<nav[\s>]"), "nav").when(part.rlike(r"(?i)^<footer[\s>]"), "footer").otherwise("body")
        )
        return F.transform(
            m.elements(part, "a"),
            lambda a: F.struct(m.attribute(a, "href").alias("href"), m.text_of(a).alias("text"), region.alias("region")),
        )

    return F.flatten(F.transform(parts, anchors))


def _listed(texts: Column, limit: int | None, text_max: int | None) -> Column:
    """Distinct non-empty texts; a limit on their number and length only where one is asked for."""
    kept = m.non_empty(texts)
    if text_max:
        kept = F.filter(kept, lambda t: F.length(t) <= text_max)
    return _first(m.distinct_ignoring_case(kept), limit)


def _first(values: Column, limit: int | None) -> Column:
    return F.slice(values, 1, limit) if limit else values


def _nav_texts(links: Column, limit: int | None = None, text_max: int | None = None) -> Column:
    texts = F.transform(F.filter(links, lambda a: a["region"] == "nav"), lambda a: a["text"])
    return _listed(texts, limit, text_max)


def _ctas(markup: Column, links: Column, limit: int | None = None, text_max: int | None = None) -> Column:
    buttons = m.texts_of(m.elements(markup, "button"))
    anchors = F.filter(F.transform(links, lambda a: a["text"]), lambda t: contains_any(F.lower(t), rules.CTA_WORDS))
    return _listed(F.concat(buttons, anchors), limit, text_max)


def _footer_text(markup: Column, limit: int | None = None) -> Column:
    text = m.text_of(m.first_element(markup, "footer"))
    return m.cut_at_space(text, limit) if limit else text


def contact_footer(html: Column) -> Column:
    """Footer fragment for contact search: the footer element, else a block named footer, else the page's end."""
    named = "|".join(
        rf"<{tag}\s[^>]*(?:class|id)=[\"'][^\"']*footer[^\"']*[\"'][^>]*>.*?</{tag}>" for tag in ("div", "section")
    )
    return F.coalesce(
        m.first_element(html, "footer"), m.rx(html, f"(?is){named}", 0), F.right(html, F.lit(rules.FOOTER_FALLBACK_CHARS))
    )


def _body(markup: Column, limit: int | None = None) -> Column:
    noise = rf"(?is)<({'|'.join(rules.NOISE_TAGS)})(?:\s[^>]*)?>.*?</\1\s*>"
    content = F.regexp_replace(markup, noise, " ")
    part = F.coalesce(
        m.first_element(content, "main"),
        m.first_element(content, "article"),
        m.rx(content, r"(?is)<body(?:\s[^>]*)?>.*?(?:</body\s*>|\z)", 0),
    )
    text = F.coalesce(m.text_of(part), F.lit(""))
    return m.cut_at_space(text, limit) if limit else text


def body_text(html: Column) -> Column:
    """Whole clean body text of a page."""
    return _body(m.skeleton(html))


def ld_blocks(html: Column) -> Column:
    """JSON-LD script bodies with HTML comments and a trailing semicolon removed."""
    raw = m.rx_all(html, r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", 1)
    return F.transform(
        raw, lambda b: F.regexp_replace(F.trim(F.regexp_replace(b, r"(?s)<!--.*?-->|\s+", " ")), r"[;\s]+$", "")
    )


def _ld_types(html: Column) -> Column:
    """Distinct JSON-LD types in document order. A quoted "@type" before a colon can only be a key in valid JSON."""
    valid = F.filter(ld_blocks(html), lambda b: F.try_parse_json(b).isNotNull())
    values = F.flatten(F.transform(valid, lambda b: m.rx_all(b, r'"@type"\s*:\s*("[^"]*"|\[[^\]]*\])', 1)))
    names = F.flatten(F.transform(values, lambda v: m.rx_all(v, r'"\s*([^"]*?)\s*"', 1)))
    return F.array_distinct(m.non_empty(names))


# --- relations --------------------------------------------------------------------------------------------------


def page_identity(pages: DataFrame) -> DataFrame:
    base = with_skeleton(pages).withColumn("metas", _metas(F.col("markup")))
    declared = F.nullif(_html_lang(F.col("markup")), F.lit(""))
    language = F.lower(F.trim(F.substring_index(F.coalesce(declared, _meta(F.col("metas"), "content-language")), "-", 1)))
    links = F.transform(
        m.open_tags(F.col("markup"), "link"),
        lambda t: F.struct(F.lower(m.attribute(t, "rel")).alias("rel"), m.attribute(t, "href").alias("href")),
    )
    canonical = F.get(F.filter(links, lambda t: t["rel"] == "canonical"), F.lit(0))["href"]
    return base.select(
        "page_id",
        "domain",
        F.left(_title(F.col("markup")), F.lit(rules.TITLE_MAX)).alias("title"),
        declared.alias("lang"),
        language.alias("language"),
        canonical.alias("canonical"),
    )


def page_meta(pages: DataFrame) -> DataFrame:
    """Long relation of meta tags."""
    rows = m.rows_of(with_skeleton(pages), _metas(F.col("markup")), "page_id", pos="pos")
    return rows.select("page_id", "pos", "item.key", "item.content")


def meta_summary(pages: DataFrame, keywords: int | None = None) -> DataFrame:
    """Metadata of a page in one row, with all keywords or the first few."""
    base = with_skeleton(pages).withColumn("metas", _metas(F.col("markup")))
    metas = F.col("metas")
    description = F.coalesce(_meta(metas, "description"), _meta(metas, "og:description"))
    words = m.non_empty(F.transform(F.split(_meta(metas, "keywords"), ","), lambda w: F.trim(w)))
    return base.select(
        "page_id",
        description.alias("description"),
        _first(words, keywords).alias("keywords"),
        _meta(metas, "og:type").alias("og_type"),
        _meta(metas, "og:title").alias("og_title"),
        _meta(metas, "og:description").alias("og_description"),
        (_title(F.col("markup")) == "").alias("missing_title"),
        description.isNull().alias("missing_description"),
    )


def with_meta_words(pages: DataFrame) -> DataFrame:
    """Adds the meta keywords (null without any) and og:type of a page."""
    staged = pages.withColumn("_metas", _metas(m.skeleton(F.col("html"))))
    words = m.non_empty(F.transform(F.split(_meta(F.col("_metas"), "keywords"), ","), lambda w: F.trim(w)))
    return staged.withColumns(
        {"meta_keywords": words, "og_type": _meta(F.col("_metas"), "og:type")}
    ).drop("_metas")


def page_headings(pages: DataFrame) -> DataFrame:
    def rows(level: int) -> Column:
        return F.transform(
            _headings(F.col("markup"), level),
            lambda text, i: F.struct(F.lit(level).alias("level"), i.alias("pos"), text.alias("text")),
        )

    levels = F.concat(rows(1), rows(2))
    return m.rows_of(with_skeleton(pages), levels, "page_id").select("page_id", "item.*")


def heading_summary(pages: DataFrame) -> DataFrame:
    """First main heading (at most 150 characters) and the first three (80 each)."""
    base = with_skeleton(pages).withColumn("h1", _headings(F.col("markup"), 1))
    return base.select(
        "page_id",
        F.left(F.get("h1", F.lit(0)), F.lit(150)).alias("h1"),
        F.transform(F.slice("h1", 1, 3), lambda t: F.left(t, F.lit(80))).alias("h1_all"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    rows = m.rows_of(with_skeleton(pages), _links(F.col("markup")), "page_id", "url", "domain", pos="pos")
    return rows.select("page_id", "url", "domain", "pos", "item.*")


def nav_links(pages: DataFrame, limit: int | None = None, text_max: int | None = None) -> DataFrame:
    texts = _nav_texts(_links(F.col("markup")), limit, text_max)
    return m.rows_of(with_skeleton(pages), texts, "page_id", pos="pos", item="text")


def page_ctas(pages: DataFrame, limit: int | None = None, text_max: int | None = None) -> DataFrame:
    texts = _ctas(F.col("markup"), _links(F.col("markup")), limit, text_max)
    return m.rows_of(with_skeleton(pages), texts, "page_id", pos="pos", item="text")


def page_footer(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """The footer's text and the fragment searched for contacts."""
    return with_skeleton(pages).select(
        "page_id",
        _footer_text(F.col("markup"), limit).alias("footer_text"),
        contact_footer(F.col("html")).alias("contact_footer"),
    )


def page_body(pages: DataFrame, limit: int | None = rules.BODY_TEXT_MAX) -> DataFrame:
    return with_skeleton(pages).select("page_id", _body(F.col("markup"), limit).alias("body_text"))


def with_assets(staged: DataFrame) -> DataFrame:
    """Adds ``assets``: third-party references (kind, url, host), each URL once per kind without its query.

    Needs ``markup`` and ``domain`` (see ``with_skeleton``).
    """

    def form_action(tag: Column) -> Column:
        data = F.trim(m.unescape(F.regexp_extract(tag, r"(?is)\sdata-[\w-]+\s*=\s*[\"']([^\"']*://[^\"']*)[\"']", 1)))
        action = m.attribute(tag, "action")
        target = F.when(action == "", data).otherwise(action)
        return F.when(F.contains(target, F.lit("://")), target).otherwise(F.lit(""))

    urls = {
        "script": F.transform(m.open_tags(F.col("markup"), "script"), lambda t: m.attribute(t, "src")),
        "iframe": F.transform(m.open_tags(F.col("markup"), "iframe"), lambda t: m.attribute(t, "src")),
        "form": F.transform(m.open_tags(F.col("markup"), "form"), form_action),
    }

    def foreign(kind: str, found: Column) -> Column:
        assets = F.transform(
            found, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url"), asset_host(u).alias("host"))
        )
        kept = F.filter(assets, lambda a: a["host"].isNotNull() & ~is_under(a["host"], F.col("domain")))
        return m.distinct_by(kept, lambda a: F.substring_index(a["url"], "?", 1))

    return staged.withColumn("assets", F.concat(*[foreign(kind, found) for kind, found in urls.items()]))


def page_assets(pages: DataFrame) -> DataFrame:
    """Third-party references as rows: (page_id, domain, kind, pos, url, host)."""
    rows = m.rows_of(with_assets(with_skeleton(pages)), "assets", "page_id", "domain", pos="pos")
    return rows.select("page_id", "domain", "item.kind", "pos", "item.url", "item.host")


def inline_of(html: Column) -> Column:
    """Inline scripts and comments as (kind, pos, text), both whole."""
    scripts = F.filter(
        m.rx_all(html, r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>"),
        lambda s: s.rlike("(?i)^<script") & (m.attribute(s, "src") == ""),
    )
    bodies = F.transform(scripts, lambda s: F.regexp_replace(s, r"(?is)^<script(?:\s[^>]*)?>|</script\s*>$", ""))
    comments = F.transform(m.rx_all(html, "(?s)<!--(.*?)-->", 1), lambda c: F.trim(c))

    def rows(kind: str, texts: Column) -> Column:
        return F.transform(
            m.non_empty(texts), lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), t.alias("text"))
        )

    return F.concat(rows("js", bodies), rows("comment", comments))


def page_inline(pages: DataFrame) -> DataFrame:
    """Inline scripts and comments as rows: (page_id, kind, pos, text)."""
    return m.rows_of(pages, inline_of(F.col("html")), "page_id").select("page_id", "item.*")


def page_context(pages: DataFrame) -> DataFrame:
    """One row per page with all layers of its context, cut to the sizes of the text sheet. One narrow pass, nothing is joined."""
    staged = with_skeleton(pages)
    staged = staged.withColumn("metas", _metas(F.col("markup"))).withColumn("links", _links(F.col("markup")))
    markup, metas, links = F.col("markup"), F.col("metas"), F.col("links")
    return staged.select(
        "page_id",
        "url",
        "domain",
        _html_lang(markup).alias("lang"),
        F.left(_title(markup), F.lit(rules.TITLE_MAX)).alias("title"),
        F.left(F.coalesce(_meta(metas, "description"), F.lit("")), F.lit(500)).alias("meta_description"),
        F.left(F.coalesce(_meta(metas, "og:type"), F.lit("")), F.lit(80)).alias("og_type"),
        F.left(F.coalesce(_meta(metas, "og:description"), F.lit("")), F.lit(500)).alias("og_description"),
        _nav_texts(links, rules.NAV_LINKS_MAX, rules.NAV_TEXT_MAX).alias("nav_links"),
        _headings(markup, 1).alias("h1"),
        _headings(markup, 2).alias("h2"),
        _ld_types(F.col("html")).alias("schema_types"),
        _ctas(markup, links, rules.CTA_MAX, rules.CTA_TEXT_MAX).alias("cta_texts"),
        F.coalesce(_footer_text(markup, rules.FOOTER_TEXT_MAX), F.lit("")).alias("footer_text"),
        _body(markup, rules.BODY_TEXT_MAX).alias("body_text"),
        F.length("html").alias("html_length"),
    )


def context_markdown(context: DataFrame) -> DataFrame:
    """The context as the fixed text sheet; a dash stands for anything missing."""

    def shown(name: str, is_list: bool = False) -> Column:
        value = F.array_join(name, ", ") if is_list else F.col(name)
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(MISSING))

    pieces: list[Column] = []
    for section, lines in rules.SHEET:
        pieces.append(F.lit(f"[{section}]\n"))
        for label, name, is_list in lines:
            pieces.append(F.concat(F.lit(label), shown(name, is_list), F.lit("\n")))
        if section != rules.SHEET[-1][0]:
            pieces.append(F.lit("\n"))
    return context.select("page_id", "domain", F.concat(*pieces).alias("markdown"))


def important_links(links: Column, url: Column, variant: str = "full") -> Column:
    """First link per known path among all links of a page, as (ord, path, title, target) in path order."""
    paths = rules.IMPORTANT_PATHS[variant]
    table = constant(
        [{"path": p, "title": t, "ord": i} for i, (p, t) in enumerate(paths)],
        "array<struct<path: string, title: string, ord: int>>",
    )
    near = F.filter(links, lambda a: a["href"].isNotNull())

    def row(rule: Column) -> Column:
        hit = F.get(F.filter(near, lambda a: F.contains(F.lower(a["href"]), rule["path"])), F.lit(0))["href"]
        return F.struct(
            rule["ord"].alias("ord"), rule["path"].alias("path"), rule["title"].alias("title"), absolutize(url, hit).alias("target")
        )

    return F.filter(F.transform(table, row), lambda r: r["target"].isNotNull())


def important_pages(pages: DataFrame, variant: str = "full") -> DataFrame:
    """Important pages a page links to: (page_id, ord, path, title, target)."""
    staged = with_skeleton(pages).select("page_id", "url", _links(F.col("markup")).alias("links"))
    return m.rows_of(staged, important_links(F.col("links"), F.col("url"), variant), "page_id").select("page_id", "item.*")


def with_page_facts(staged: DataFrame) -> DataFrame:
    """Adds links, title, language, description and h1 to pages that carry ``markup``."""
    staged = staged.withColumn("_metas", _metas(F.col("markup"))).withColumn("links", _links(F.col("markup")))
    metas, markup = F.col("_metas"), F.col("markup")
    declared = F.coalesce(F.nullif(_html_lang(markup), F.lit("")), _meta(metas, "content-language"))
    return staged.withColumns(
        {
            "title": F.left(_title(markup), F.lit(150)),
            "language": F.lower(F.trim(F.substring_index(declared, "-", 1))),
            "description": F.left(F.coalesce(_meta(metas, "description"), _meta(metas, "og:description")), F.lit(250)),
            "h1": F.left(F.get(_headings(markup, 1), F.lit(0)), F.lit(150)),
        }
    ).drop("_metas")


def lead_magnets(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Forms and sign-up links of a page: the form count and the distinct targets."""
    base = with_skeleton(pages).withColumn("links", _links(F.col("markup"))).withColumn(
        "actions", F.transform(m.open_tags(F.col("markup"), "form"), lambda t: m.attribute(t, "action"))
    )
    low = F.lower("html")
    url = F.col("url")
    words = words_in(low, rules.LEAD_WORDS)
    forms = F.transform(F.filter("actions", lambda a: ~a.isin("", "#")), lambda a: absolutize(url, a))

    def targets(word: Column) -> Column:
        hit = F.filter(
            "links",
            lambda a: (a["href"] != "") & (F.contains(F.lower(a["text"]), word) | F.contains(F.lower(a["href"]), word)),
        )
        full = F.transform(hit, lambda a: absolutize(url, a["href"]))
        return F.filter(full, lambda t: ~(F.endswith(t, F.lit("#")) | F.endswith(t, F.lit("javascript:void(0)"))))

    found = F.array_distinct(F.concat(forms, F.flatten(F.transform(words, targets))))
    spoken = F.transform(F.slice(words, 1, 1), lambda w: F.concat(F.lit("keyword: "), w))
    return base.select(
        "page_id",
        F.size("actions").alias("forms_found"),
        _first(F.when(F.size(found) > 0, found).otherwise(spoken), limit).alias("lead_magnets"),
    )


def blog_facts(pages: DataFrame) -> DataFrame:
    """The blog page of a site by path priority, its last post date and first dated link.

    Facts are computed page by page; only short columns meet the per-site minimum.
    """
    table = constant({p: i for i, p in enumerate(rules.BLOG_PATHS)}, "map<string, int>")
    path = F.lower(F.regexp_replace(path_of(F.col("url")), "/+$", ""))
    blogs = (
        with_domain(pages)
        .withColumn("priority", F.try_element_at(table, path))
        .filter(F.col("priority").isNotNull() & (F.length("html") >= rules.BLOG_MIN_CHARS))
    )
    markup = m.skeleton(F.col("html"))
    text = m.text_of(markup)
    time_tag = m.first_element(markup, "time")
    date = F.coalesce(
        m.rx(F.col("html"), r"(?i)<pubDate>\s*([^<]+?)\s*</pubDate>"),
        m.rx(text, rules.DATE_PATTERN),
        F.nullif(m.attribute(time_tag, "datetime"), F.lit("")),
        F.nullif(m.text_of(time_tag), F.lit("")),
    )
    containers = m.rx_all(markup, r"(?is)<article(?:\s[^>]*)?>.*?</article\s*>|<li(?:\s[^>]*)?>.*?</li\s*>")
    dated = F.filter(containers, lambda c: m.text_of(c).rlike(rules.DATE_PATTERN) & c.rlike(r"(?is)<a\s[^>]*href"))
    link = m.first_element(F.get(dated, F.lit(0)), "a")
    facts = blogs.select(
        "domain",
        "priority",
        "page_id",
        F.col("url").alias("blog_url"),
        F.left(date, F.lit(30)).alias("last_post_date"),
        absolutize(F.col("url"), m.attribute(link, "href")).alias("last_post_url"),
        F.left(m.text_of(link), F.lit(100)).alias("last_post_title"),
    )
    best = F.min_by(
        F.struct("blog_url", "last_post_date", "last_post_url", "last_post_title"), F.struct("priority", "page_id")
    )
    return facts.groupBy("domain").agg(best.alias("b")).select("domain", "b.*")
