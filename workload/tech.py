"""Registered queries and oracle SQL for technology detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.operators import structure as st
from sitegrain.operators import tech
from sitegrain.rules import tech as rules
from sitegrain.sources.pages import with_domain
from workload.oracle_text import boundary, values, with_pages
from workload.seeded import pages_seeded, quote
from workload.structure import ASSETS, INLINE, LD, joined

TARGETS = [(0, 0, "Shopify"), (0, 1, "payment"), (0, 2, "yoast"), (1, 0, "HubSpot"), (1, 1, "calendly"), (2, 0, "stripe.com"), (2, 1, "fbq")]
REQUIREMENTS = [(0, ["shopify"], ["crm"]), (1, ["crm"], ["Calendly", "payment"]), (2, [], ["ecommerce", "hubspot"])]


def detections(spark, d):
    """Technologies of the seeded pages as (page_id, domain, tech, category)."""
    return tech.page_detections(pages_seeded(spark, d))


def category_table(spark):
    rows = [(name, category) for category, names in rules.CATEGORY_NAMES for name in names]
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(rows)], "ord int, name string, category string")


def sites(spark, d):
    pages = with_domain(pages_seeded(spark, d).select("page_id", "url"))
    return pages.select((F.col("page_id") % 3).alias("intent_id"), "domain").distinct()


def _targets(spark):
    return spark.createDataFrame(TARGETS, "intent_id bigint, ord int, target string")


def _intents(spark):
    return spark.createDataFrame(REQUIREMENTS, "intent_id bigint, must_have array<string>, must_not array<string>")


def _found(s, d):
    return tech.target_evidence(_targets(s), sites(s, d), detections(s, d), tech.evidence(pages_seeded(s, d)))


def _signals(s, d):
    signals = tech.marketing_signals(pages_seeded(s, d))
    found = F.map_keys(F.map_filter("pixels", lambda k, v: v))
    return joined(
        signals.withColumn("pixels", found), "pixels", "missing_pixels", "support_widgets", "email_tools"
    )


QUERIES = {
    "t1_fingerprints": lambda s, d: tech.detect_fingerprints(pages_seeded(s, d)),
    "t1_fingerprints_table": lambda s, d: tech.detect_fingerprints(pages_seeded(s, d), tech.fingerprint_rules(s)),
    "t2_hosts_table": lambda s, d: tech.detect_hosts(
        st.page_assets(pages_seeded(s, d)), s.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rules.HOST_TECH)], "ord int, host string, tech string")
    ),
    "t7_categorize_table": lambda s, d: tech.categorize(detections(s, d), category_table(s)),
    "t8_multi_table": lambda s, d: tech.categorize_multi(
        detections(s, d), s.createDataFrame([(n.lower(), c) for c, names in rules.MULTI_CATEGORIES for n in names], "name string, category string")
    ),
    "t2_hosts": lambda s, d: tech.detect_hosts(st.page_assets(pages_seeded(s, d))),
    "t3_inline": lambda s, d: tech.detect_inline(pages_seeded(s, d)),
    "t4_marketing_signals": _signals,
    "t5_shop_reviews": lambda s, d: tech.shop_reviews(pages_seeded(s, d)),
    "t6_sample_review": lambda s, d: tech.sample_review(pages_seeded(s, d)),
    "t7_categorize": lambda s, d: tech.categorize(detections(s, d)),
    "t8_categorize_multi": lambda s, d: tech.categorize_multi(detections(s, d)),
    "t8_type_flags": lambda s, d: tech.type_flags(detections(s, d)),
    "t9_tech_profile": lambda s, d: joined(tech.tech_profile(detections(s, d)), "techs", *tech.CATEGORIES),
    "t10_footprint": lambda s, d: tech.footprint(st.page_assets(pages_seeded(s, d))),
    "t10_host_popularity": lambda s, d: tech.host_popularity(st.page_assets(pages_seeded(s, d))),
    "t11_target_evidence": _found,
    "t11_all_targets_met": lambda s, d: tech.all_targets_met(_found(s, d)),
    "t12_social_anchors": lambda s, d: tech.social_anchors(st.page_links(pages_seeded(s, d))),
    "j4_tech_filter": lambda s, d: tech.tech_filter(sites(s, d), detections(s, d), _intents(s)),
}

# --- oracle -----------------------------------------------------------------------------------------------------


def rlike(text: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({text}, {quote(flags + boundary(pattern))})"


def _alternation(patterns):
    return "|".join(patterns)


_print_rows = "\nUNION ALL ".join(
    f"SELECT page_id, domain, '{name}' AS rule_set, {quote(t)} AS tech, '{c}' AS category FROM pages_seeded WHERE {rlike('html', _alternation(p))}"
    for name, table in (("page", rules.FINGERPRINTS), ("tools", rules.TOOL_FINGERPRINTS), ("words", rules.PLATFORM_WORDS))
    for t, c, p in table
)
_page_rows = "\nUNION ALL ".join(
    f"SELECT page_id, domain, {quote(t)} AS tech, '{c}' AS category FROM pages_seeded WHERE {rlike('html', _alternation(p))}"
    for t, c, p in rules.FINGERPRINTS
)
HOSTS = f"""
{values('host_tech', ['ord', 'known', 'tech'], [(i, h, t) for i, (h, t) in enumerate(rules.HOST_TECH)])},
asset_tech AS MATERIALIZED (SELECT a.page_id, a.pos, arg_min(h.tech, CASE WHEN a.host = h.known THEN -1 ELSE h.ord END) AS tech
  FROM assets a JOIN host_tech h ON a.host = h.known OR suffix(a.host, '.' || h.known) GROUP BY ALL)
""".strip()
_names = [(n, c) for c, names in rules.CATEGORY_NAMES for n in names]
NAMES = f"""
{values('cat_names', ['ord', 'name', 'category'], [(i, n, c) for i, (n, c) in enumerate(_names)])},
known_names(name, category) AS (VALUES ('sugar crm', 'crm'))
""".strip()


def category_sql(source: str) -> str:
    """(tech, category) of the distinct names in a source."""
    return f"""SELECT t.tech, coalesce(
      (SELECT arg_min(category, ord) FROM cat_names c WHERE c.name = lower(t.tech)),
      (SELECT arg_min(category, ord) FROM cat_names c WHERE contains(lower(t.tech), c.name) OR contains(c.name, lower(t.tech))),
      (SELECT max(category) FROM known_names k WHERE contains(lower(t.tech), k.name))) AS category FROM (SELECT DISTINCT tech FROM {source}) t"""


DETECTIONS = f"""
{ASSETS},
{HOSTS},
{NAMES},
host_cats AS ({category_sql('asset_tech')}),
detections AS MATERIALIZED (SELECT page_id, domain, tech, category FROM ({_page_rows})
  UNION SELECT a.page_id, a.domain, t.tech, c.category FROM assets a JOIN asset_tech t ON t.page_id = a.page_id AND t.pos = a.pos
    JOIN host_cats c ON c.tech = t.tech),
site_tech AS MATERIALIZED (SELECT domain, min(tech) AS tech, arg_min(category, tech || coalesce(category, '')) AS category FROM detections GROUP BY domain, lower(tech))
""".strip()


def _inline_hits() -> str:
    rows = []
    for label, pattern in rules.INLINE_GLOBALS:
        bare = pattern[2:] if pattern.startswith(r"\b") else pattern
        lead = r"[\p{L}\p{N}_]" if label == "Crisp" else (r"(?:^|[^\p{L}\p{N}_])" if pattern.startswith(r"\b") else "")
        rx = f"(?is)^(.*?{lead})(?:{boundary(bare)})"
        rows.append(
            f"SELECT page_id, kind, pos, {quote(label)} AS label, length(regexp_extract(text, {quote(rx)}, 1)) AS off, text FROM inline "
            f"WHERE kind = 'js' AND regexp_matches(text, {quote(rx)})"
        )
    for label, pattern in rules.COMMENT_SIGNATURES:
        rows.append(f"SELECT page_id, kind, pos, {quote(label)}, -1, text FROM inline WHERE kind = 'comment' AND {rlike('text', pattern)}")
    return " UNION ALL ".join(rows)


HITS = f"""
inline_hits AS (SELECT page_id, kind, pos, label, CASE WHEN off < 0 THEN text
  ELSE trim(substring(text, greatest(off - 20, 0) + 1, off + 120 - greatest(off - 20, 0))) END AS snippet FROM ({_inline_hits()})),
inline_found AS MATERIALIZED (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY page_id, kind, label,
  snippet ORDER BY pos) AS rn FROM inline_hits) WHERE rn = 1)
""".strip()


def _names_list(table, want=True):
    parts = [f"CASE WHEN {'' if want else 'NOT '}{rlike('html', p)} THEN {quote(n)} END" for n, p in table]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ' | ')"


def _first(table):
    whens = " ".join(f"WHEN {rlike('html', p)} THEN {quote(n)}" for n, p in table)
    return f"CASE {whens} END"


_share = " OR ".join(f"contains(lower(href), {quote(p)})" for p in rules.SHARE_PARTS)
_multi = values("multi", ["name", "category"], [(n.lower(), c) for c, names in rules.MULTI_CATEGORIES for n in names])


def _type(kind):
    return "bool_or(" + " OR ".join(f"contains(lower(tech), {quote(n)})" for n in rules.TYPE_NAMES[kind]) + ")"


_target_cats = values("target_cats", ["word", "category"], [(w, c) for w, cs in rules.TARGET_CATEGORIES.items() for c in cs])
TARGET_STEPS = f"""
{DETECTIONS},
{INLINE},
{HITS},
{values('targets', ['intent_id', 'ord', 'target'], TARGETS)},
{_target_cats},
wanted AS (SELECT DISTINCT p.page_id % 3 AS intent_id, p.domain, t.ord, t.target FROM pages_seeded p JOIN targets t ON t.intent_id = p.page_id % 3),
by_name AS (SELECT w.domain, w.target, min(s.tech) AS tech FROM wanted w JOIN site_tech s ON s.domain = w.domain
  AND (contains(lower(s.tech), lower(w.target)) OR contains(lower(w.target), lower(s.tech))) GROUP BY ALL),
by_cat AS (SELECT domain, target, lower(target) || ': ' || string_agg(tech, ', ' ORDER BY tech) AS shown FROM (
  SELECT w.domain, w.target, s.tech, row_number() OVER (PARTITION BY w.domain, w.target ORDER BY s.tech) AS rn FROM (SELECT DISTINCT domain, target FROM wanted) w
  JOIN target_cats c ON c.word = lower(w.target) JOIN site_tech s ON s.domain = w.domain AND s.category = c.category) WHERE rn <= 3 GROUP BY domain, target),
decided AS (SELECT w.*, coalesce(n.tech, c.shown) AS detected FROM wanted w LEFT JOIN by_name n ON n.domain = w.domain AND n.target = w.target
  LEFT JOIN by_cat c ON c.domain = w.domain AND c.target = w.target),
evidence AS (
  SELECT a.page_id, a.domain, CASE WHEN kind = 'form' THEN 'dna_form' ELSE 'dna_script' END AS source, CASE WHEN kind = 'form' THEN 1 ELSE 0 END AS rank,
    lower(a.host || ' ' || a.url || ' ' || coalesce(t.tech, '')) AS blob, a.url AS shown FROM assets a LEFT JOIN asset_tech t ON t.page_id = a.page_id AND t.pos = a.pos
  UNION ALL SELECT i.page_id, p.domain, CASE WHEN kind = 'js' THEN 'dna_global' ELSE 'dna_comment' END, CASE WHEN kind = 'js' THEN 2 ELSE 3 END,
    lower(label || ' ' || snippet), snippet FROM inline_found i JOIN pages_seeded p ON p.page_id = i.page_id),
evidence_hits AS (SELECT d.intent_id, d.domain, d.ord, e.page_id, e.source, e.rank, e.shown,
  row_number() OVER (PARTITION BY d.intent_id, d.domain, e.page_id, e.source, e.shown, e.blob ORDER BY d.ord) AS k
  FROM decided d JOIN evidence e ON e.domain = d.domain AND contains(e.blob, lower(d.target)) WHERE d.detected IS NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY intent_id, domain, ord ORDER BY rank, page_id, shown) AS rn FROM evidence_hits WHERE k = 1) WHERE rn = 1),
found AS (SELECT d.intent_id, d.domain, CAST(d.ord AS INTEGER) AS ord, d.target, d.detected IS NOT NULL OR b.shown IS NOT NULL AS found,
  CASE WHEN d.detected IS NOT NULL THEN 'detector' ELSE b.source END AS source, coalesce(d.detected, b.shown) AS evidence
  FROM decided d LEFT JOIN best b ON b.intent_id = d.intent_id AND b.domain = d.domain AND b.ord = d.ord)
"""
_req_rows = [(i, kind, n, w) for i, have, have_not in REQUIREMENTS for kind, ws in ((0, have), (1, have_not)) for n, w in enumerate(ws)]
_req_cats = values("req_cats", ["word", "category"], [(w, c) for w, cs in rules.REQUIREMENT_CATEGORIES.items() for c in cs])
FILTER = f"""
{DETECTIONS},
{values('reqs', ['intent_id', 'kind', 'n', 'word'], _req_rows)},
{_req_cats},
intent_sites AS (SELECT DISTINCT page_id % 3 AS intent_id, domain FROM pages_seeded),
all_tech AS (SELECT DISTINCT domain, tech, category FROM detections),
checks AS (SELECT s.intent_id, s.domain, r.kind, r.n, r.word,
  (SELECT min(tech) FROM all_tech t WHERE t.domain = s.domain AND contains(lower(t.tech), lower(r.word))) AS by_name,
  (SELECT array_to_string(list_slice(list(t.tech ORDER BY t.tech), 1, 2), ', ') FROM all_tech t JOIN req_cats c ON c.category = t.category
    WHERE t.domain = s.domain AND c.word = lower(r.word)) AS by_cat
  FROM intent_sites s JOIN reqs r ON r.intent_id = s.intent_id),
failed AS (SELECT intent_id, domain, arg_min(CASE WHEN kind = 0 THEN 'No tiene: ' || word WHEN by_name IS NOT NULL THEN 'Tiene ' || by_name || ' (excluido)'
    ELSE 'Tiene ' || word || ': ' || by_cat END, kind * 100 + n) AS reason FROM checks
  WHERE (kind = 0 AND by_name IS NULL AND by_cat IS NULL) OR (kind = 1 AND (by_name IS NOT NULL OR by_cat IS NOT NULL)) GROUP BY ALL)
"""
SOCIALS = f"""
{values('networks', ['host'], [(h,) for h in rules.SOCIAL_HOSTS])},
social_links AS (SELECT l.page_id, l.domain, l.href AS url, min(pos) AS pos, replace(any_value(n.host), '.com', '') AS platform FROM links l JOIN networks n
  ON regexp_replace(lower(regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:\\s]+)', 1)), '^www[.]', '') = n.host
  OR suffix(lower(regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:\\s]+)', 1)), '.' || n.host)
  WHERE NOT ({_share}) AND trim(regexp_extract(href, '//[^/?#]*([^?#]*)', 1), '/') <> '' GROUP BY ALL)
"""
_cat_cols = ", ".join(f"coalesce(string_agg(tech, ' | ' ORDER BY tech) FILTER (category = '{c}'), '') AS {c}" for c in tech.CATEGORIES)


def _has(*cats):
    return "coalesce(bool_or(category IN (" + ", ".join(quote(c) for c in cats) + ")), FALSE)"


ORACLE = {
    "t1_fingerprints": with_pages(_print_rows),
    "t2_hosts": with_pages(
        "SELECT a.page_id, a.domain, a.kind, CAST(a.pos AS INTEGER) AS pos, a.url, a.host, t.tech FROM assets a JOIN asset_tech t ON t.page_id = a.page_id AND t.pos = a.pos",
        "markup", ctes=ASSETS + ",\n" + HOSTS,
    ),
    "t3_inline": with_pages("SELECT page_id, kind, label, CAST(pos AS INTEGER) AS pos, snippet FROM inline_found", ctes=INLINE + ",\n" + HITS),
    "t4_marketing_signals": with_pages(
        f"SELECT page_id, domain, {_names_list(rules.PIXELS)} AS pixels, {_names_list(rules.PIXELS, False)} AS missing_pixels, "
        f"{' OR '.join(rlike('html', p) for _, p in rules.PIXELS)} AS has_pixel, {_names_list(rules.SUPPORT_WIDGETS)} AS support_widgets, "
        f"{_names_list(rules.EMAIL_TOOLS)} AS email_tools, {rlike('html', rules.POPUPS)} AS has_popups FROM pages_seeded"
    ),
    "t5_shop_reviews": with_pages(
        f"""SELECT page_id, domain, platform IS NOT NULL AS is_ecommerce, platform, platform IS NOT NULL AND review IS NOT NULL AS has_reviews,
        CASE WHEN platform IS NOT NULL THEN review END AS review_platform, platform IS NOT NULL AND review IS NULL AS upsell_opportunity FROM (
        SELECT page_id, domain, coalesce((SELECT min(tech) FROM detections d WHERE d.page_id = p.page_id AND d.category = 'ecommerce'), {_first(rules.SHOP_PLATFORMS)}) AS platform,
        {_first(rules.REVIEW_PLATFORMS)} AS review FROM pages_seeded p)""",
        "markup", ctes=DETECTIONS,
    ),
    "t6_sample_review": with_pages(
        """SELECT page_id, left(body, 250) AS sample_review, rating AS sample_rating FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY block, id) AS rn FROM (
          SELECT page_id, block, id, coalesce(nullif(json_extract_string(value, '$.reviewBody'), ''), json_extract_string(value, '$.description')) AS body,
            json_extract_string(value, '$.reviewRating.ratingValue') AS rating FROM ld_tree
          WHERE type = 'OBJECT' AND ((json_extract_string(value, '$."@type"') = 'Review' AND (fullkey = '$' OR regexp_matches(fullkey, '^\\$\\[\\d+\\]$')))
            OR regexp_matches(fullkey, '^\\$(\\[\\d+\\])?\\.review(\\[\\d+\\])?$'))) WHERE body <> '') WHERE rn = 1""".replace("\\\\", "\\"),
        ctes=LD,
    ),
    "t7_categorize": with_pages(
        "SELECT d.page_id, d.domain, d.tech, c.category FROM detections d JOIN tech_cats c ON c.tech = d.tech",
        "markup", ctes=DETECTIONS + f",\ntech_cats AS ({category_sql('detections')})",
    ),
    "t8_categorize_multi": with_pages(
        "SELECT DISTINCT d.tech, m.category FROM detections d JOIN multi m ON contains(lower(d.tech), m.name) OR contains(m.name, lower(d.tech))",
        "markup", ctes=DETECTIONS + ",\n" + _multi,
    ),
    "t8_type_flags": with_pages(
        f"SELECT *, NOT is_cms AND NOT is_ecommerce AS is_custom FROM (SELECT domain, {_type('ecommerce')} OR {_type('payment')} AS is_ecommerce, "
        f"{_type('cms')} AS is_cms, {_type('saas')} AS is_saas FROM detections GROUP BY domain)",
        "markup", ctes=DETECTIONS,
    ),
    "t9_tech_profile": with_pages(
        f"""SELECT domain, string_agg(tech, ' | ' ORDER BY tech) AS techs, {_cat_cols}, {_has('crm')} AS has_crm,
        {_has('email_marketing', 'marketing_automation')} AS has_email_marketing, {_has('live_chat')} AS has_live_chat, {_has('analytics')} AS has_analytics,
        {_has('ecommerce')} AS has_ecommerce, {_has('cms')} AS has_cms, {_has('payment')} AS has_payment FROM site_tech GROUP BY domain""",
        "markup", ctes=DETECTIONS,
    ),
    "t10_footprint": with_pages("SELECT domain, host, count(DISTINCT page_id) AS pages FROM assets GROUP BY ALL", "markup", ctes=ASSETS),
    "t10_host_popularity": with_pages("SELECT host, count(DISTINCT domain) AS sites FROM assets GROUP BY host", "markup", ctes=ASSETS),
    "t11_target_evidence": with_pages("SELECT * FROM found", "markup", ctes=TARGET_STEPS),
    "t11_all_targets_met": with_pages(
        "SELECT intent_id, domain, bool_and(found) AS all_targets_met FROM found GROUP BY ALL", "markup", ctes=TARGET_STEPS
    ),
    "t12_social_anchors": with_pages("SELECT page_id, domain, url, CAST(pos AS INTEGER) AS pos, platform FROM social_links", "links", ctes=SOCIALS),
    "j4_tech_filter": with_pages(
        "SELECT s.intent_id, s.domain, f.reason IS NULL AS passed, coalesce(f.reason, '') AS reason FROM intent_sites s LEFT JOIN failed f "
        "ON f.intent_id = s.intent_id AND f.domain = s.domain",
        "markup", ctes=FILTER,
    ),
}
# the same rules given as a table must find the same
ORACLE |= {"t1_fingerprints_table": ORACLE["t1_fingerprints"], "t2_hosts_table": ORACLE["t2_hosts"], "t7_categorize_table": ORACLE["t7_categorize"], "t8_multi_table": ORACLE["t8_categorize_multi"]}
