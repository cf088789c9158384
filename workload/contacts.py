"""Registered queries and oracle SQL for contact extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.operators import contacts
from sitegrain.operators import structure as st
from sitegrain.rules import contact as rules
from workload.oracle_text import element_pattern, path_of, unnest_list, with_pages
from workload.seeded import pages_seeded, quote
from workload.structure import CONTACT_FOOTER, TITLE, joined


def site_pages(s, d):
    """The seeded pages, some of them stored at the site's contact paths, as a crawl would find them."""
    i = F.col("page_id")
    origin = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    path = F.when(i % 4 == 1, "/contacto").when(i % 4 == 2, "/contact").when(i % 8 == 3, "/about/").when(i % 16 == 4, "/").when(i % 32 == 12, "/kontakt").when(i % 32 == 28, "/aviso-legal")
    return pages_seeded(s, d).withColumn("url", F.when(path.isNotNull(), F.concat(origin, path)).otherwise(F.col("url")))


def cascade(s, d):
    pages = site_pages(s, d)
    return contacts.contact_cascade(pages, contacts.contact_sources(pages))


def shown(df):
    urls = F.transform("social", lambda x: F.concat(x["platform"], F.lit("="), x["url"]))
    return joined(df.withColumn("social", urls), "social", "all_emails", "all_phones")


def _merged(s, d):
    pages = site_pages(s, d)
    sites = st.page_identity(pages).groupBy("domain").agg(F.min("title").alias("title"))
    titles = st.page_identity(pages).groupBy("domain").agg(F.max("title").alias("title"))
    found = cascade(s, d).select("domain", "email", "phone", "success").filter("success").join(titles, "domain")
    return contacts.merge_contact(sites, found)


def _outreach(s, d):
    links = contacts.outreach(pages_seeded(s, d))
    return links.select("page_id", "domain", F.explode("social_links").alias("platform", "link"))


QUERIES = {
    "c1_email_candidates": lambda s, d: contacts.email_candidates(pages_seeded(s, d)),
    "c1_document_emails": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", F.posexplode(contacts.emails_in(F.col("text"))).alias("ord", "email")
    ),
    "c2_email_quality": lambda s, d: contacts.email_quality(contacts.email_candidates(pages_seeded(s, d))),
    "c3_best_email": lambda s, d: contacts.best_email(contacts.email_candidates(pages_seeded(s, d))),
    "c3_valid_emails": lambda s, d: contacts.valid_emails(contacts.email_candidates(pages_seeded(s, d))),
    "c4_phones": lambda s, d: contacts.phones(pages_seeded(s, d)),
    "c4_phones_international": lambda s, d: contacts.phones(pages_seeded(s, d), international=True),
    "c5_socials": lambda s, d: contacts.socials(pages_seeded(s, d)),
    "c5_socials_basic": lambda s, d: contacts.socials(pages_seeded(s, d), full=False),
    "c6_outreach": _outreach,
    "c7_contact_cascade": lambda s, d: shown(cascade(s, d)),
    "c7_contact_cascade_few": lambda s, d: shown(
        contacts.contact_cascade(site_pages(s, d), contacts.contact_sources(site_pages(s, d)), few=True)
    ),
    "c8_merge_contact": _merged,
    "j6_completeness": lambda s, d: joined(
        contacts.completeness(cascade(s, d), ["email", "phone", "social"]).select("domain", "missing"), "missing"
    ),
    "j6_complete_only": lambda s, d: contacts.complete_only(cascade(s, d), ["email", "phone"]).select("domain", "email", "phone"),
}

# --- oracle -----------------------------------------------------------------------------------------------------

_refused = " OR ".join(f"contains(local, {quote(w)})" for w in rules.REFUSED_WORDS)
_providers = ", ".join(quote(p) for p in rules.GENERIC_PROVIDERS)
REASON = f"""CASE WHEN length(local) > 25 THEN 'local_part_too_long (' || length(local) || ' > 25)' WHEN {_refused} THEN 'forbidden_keyword'
  WHEN NOT regexp_matches(local, '[._+-]') AND (regexp_matches(local, '^[0-9a-f]{{16,}}$') OR (length(local) >= 10 AND regexp_matches(local, '^[a-z0-9]+$')
    AND regexp_matches(local, '[0-9]') AND regexp_matches(local, '[a-z]'))) THEN 'random_string' ELSE 'ok' END"""


def emails_sql(name, source, text, keys):
    """CTE chain: distinct addresses of a text in order, numbered from 0."""
    mailto = f"regexp_extract_all({text}, {quote('(?i)' + rules.MAILTO)}, 1)"
    found = f"regexp_extract_all({text}, {quote(rules.EMAIL)})"
    return f"""{name}_all AS ({unnest_list(source, mailto, 'e', keys + ', 0 AS src')} UNION ALL {unnest_list(source, found, 'e', keys + ', 1 AS src')}),
{name}_first AS (SELECT {keys}, lower(trim(e)) AS email, min(src * 1000000 + n) AS o FROM {name}_all
  WHERE regexp_matches(trim(e), '^.+@[^@]*[.][^@]*$') GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, email, row_number() OVER (PARTITION BY {keys} ORDER BY o) - 1 AS ord, regexp_replace(email, '@[^@]*$', '') AS local,
  regexp_extract(email, '@([^@]*)$', 1) AS host FROM {name}_first)"""


def phones_sql(name, source, text, keys, international=False):
    tel = f"regexp_extract_all({text}, {quote('(?i)' + rules.TEL)}, 1)"
    pattern = rules.PHONE_INTERNATIONAL if international else rules.PHONE_NATIONAL
    found = f"regexp_extract_all({text}, {quote(pattern)})"
    digits = "length(regexp_replace(phone, '[^0-9]', '', 'g'))"
    extra = f" AND {digits} <= 15 AND regexp_replace(phone, '[^0-9]', '', 'g') NOT IN ({', '.join(quote(x) for x in rules.DUMMY_PHONES)})" if international else ""
    return f"""{name}_all AS ({unnest_list(source, tel, 'p', keys + ', 0 AS src')} UNION ALL {unnest_list(source, found, 'p', keys + ', 1 AS src')}),
{name}_first AS (SELECT {keys}, phone, min(src * 1000000 + n) AS o FROM (SELECT *, regexp_replace(trim(p), '[\\s.-]+', ' ', 'g') AS phone FROM {name}_all)
  WHERE {digits} >= 9{extra} GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, phone, row_number() OVER (PARTITION BY {keys} ORDER BY o) - 1 AS ord FROM {name}_first)"""


def socials_sql(name, source, text, keys, full=True):
    table = rules.SOCIAL_URLS if full else rules.SOCIAL_URLS[:4]
    refused = rules.SOCIAL_REFUSED_FULL if full else rules.SOCIAL_REFUSED_BASIC
    parts = " UNION ALL ".join(
        unnest_list(source, f"regexp_extract_all({text}, {quote('(?i)' + p)})", "url", f"{keys}, {i} AS src, '{label}' AS platform")
        for i, (label, p) in enumerate(table)
    )
    bad = " OR ".join(f"contains(lower(url), {quote(w)})" for w in refused)
    return f"""{name}_all AS ({parts}),
{name}_first AS (SELECT {keys}, platform, url, min(src * 1000000 + n) AS o FROM {name}_all WHERE NOT ({bad}) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, platform, url, row_number() OVER (PARTITION BY {keys} ORDER BY o) - 1 AS ord FROM {name}_first)"""


EMAILS = emails_sql("emails", "pages_seeded", "html", "page_id, domain")
TIERED = f"""
tiered AS MATERIALIZED (SELECT *, CASE WHEN h = domain OR suffix(h, '.' || domain) OR suffix(domain, '.' || h) THEN 0
  WHEN host IN ({_providers}) AND ({REASON}) = 'ok' THEN 1 END AS tier FROM (SELECT *, regexp_replace(host, '^www[.]', '') AS h FROM emails))
""".strip()
_handles = " UNION ALL ".join(
    f"SELECT page_id, domain, place, '{n}' AS platform, '{prefix}' || list_filter(regexp_extract_all(x, {quote('(?i)' + p)}, 1), "
    f"lambda h: NOT regexp_matches(h, {quote('(?i)' + rules.HANDLE_SKIP)}))[1] AS link FROM places"
    for n, p, prefix in rules.HANDLES
)
OUTREACH = f"""
places AS (SELECT page_id, domain, 0 AS place, regexp_extract(html, {quote(element_pattern('footer'))}) AS x FROM pages_seeded UNION ALL
  SELECT page_id, domain, 1, html FROM pages_seeded),
handles AS (SELECT * FROM ({_handles}) WHERE link IS NOT NULL),
chosen AS (SELECT page_id, min(place) AS place FROM handles GROUP BY page_id)
""".strip()
LOCATED = f"""
located AS (SELECT page_id, domain, html, CASE WHEN page_id % 4 = 1 THEN '/contacto' WHEN page_id % 4 = 2 THEN '/contact' WHEN page_id % 8 = 3 THEN '/about'
  WHEN page_id % 16 = 4 THEN '/' WHEN page_id % 32 = 12 THEN '/kontakt' WHEN page_id % 32 = 28 THEN '/aviso-legal' ELSE lower(coalesce(nullif(rtrim({path_of('url')}, '/'), ''), '/')) END AS path FROM pages_seeded),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY path <> '/', page_id) AS home_rn FROM located),
source_pages AS (SELECT *, CASE WHEN home_rn = 1 THEN 0 WHEN path = '/contacto' THEN 1 WHEN path = '/contact' THEN 2 WHEN path = '/about' THEN 3
  WHEN path = '/legal' THEN 4 WHEN path = '/aviso-legal' THEN 5 WHEN path = '/kontakt' THEN 6 WHEN path = '/quienes-somos' THEN 7 END AS sr FROM ranked),
one_each AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, sr ORDER BY page_id) AS rn FROM source_pages WHERE sr IS NOT NULL) WHERE rn = 1)
""".strip()
# "domain" is the site's key here; "7 shop.example" stands for the site shop.example of intent 7.
_own = "regexp_replace(domain, '^[0-9]+ ', '')"
CASCADE_STEPS = f"""
steps AS MATERIALIZED (SELECT domain, sr * 2 AS step, CASE WHEN sr = 0 THEN 'footer' ELSE path || '/footer' END AS label, {CONTACT_FOOTER} AS x FROM one_each
  UNION ALL SELECT domain, sr * 2 + 1, CASE WHEN sr = 0 THEN 'home' ELSE path END, html FROM one_each),
{emails_sql('semails', 'steps', 'x', 'domain, step')},
{phones_sql('sphones', 'steps', 'x', 'domain, step')},
{socials_sql('ssocials', 'steps', 'x', 'domain, step', full=False)},
stier AS (SELECT *, CASE WHEN host = {_own} OR suffix(host, '.' || {_own}) OR suffix({_own}, '.' || host) THEN 0
  WHEN host IN ({_providers}) AND ({REASON}) = 'ok' THEN 1 END AS tier FROM semails),
stops AS (SELECT domain, coalesce((SELECT min(step) FROM stier t WHERE t.domain = d.domain AND tier = 0), 99) AS stop FROM (SELECT DISTINCT domain FROM steps) d),
remail AS (SELECT t.domain, email, min(tier) AS tier, min(step * 1000 + ord) AS o FROM stier t JOIN stops s ON s.domain = t.domain AND t.step <= s.stop WHERE tier IS NOT NULL GROUP BY ALL),
rphone AS (SELECT t.domain, phone, min(step * 1000 + ord) AS o FROM sphones t JOIN stops s ON s.domain = t.domain AND t.step <= s.stop GROUP BY ALL),
rsocial AS (SELECT t.domain, platform, url, min(step * 1000 + ord) AS o FROM ssocials t JOIN stops s ON s.domain = t.domain AND t.step <= s.stop GROUP BY ALL),
used AS (SELECT domain, step FROM stops s JOIN (SELECT DISTINCT domain AS d, step FROM stier WHERE tier = 0) x ON x.d = s.domain AND x.step = s.stop
  UNION SELECT domain, min(o) // 1000 FROM rphone GROUP BY domain UNION SELECT domain, o // 1000 FROM rsocial),
sources AS (SELECT u.domain, string_agg(label, ' + ' ORDER BY u.step) AS source FROM used u JOIN steps s ON s.domain = u.domain AND s.step = u.step GROUP BY u.domain),
cascade AS MATERIALIZED (SELECT domain, (SELECT arg_min(email, tier * 1000000 + o) FROM remail r WHERE r.domain = d.domain) AS email,
  coalesce((SELECT string_agg(email, ' | ' ORDER BY o) FROM remail r WHERE r.domain = d.domain), '') AS all_emails,
  (SELECT arg_min(phone, o) FROM rphone r WHERE r.domain = d.domain) AS phone, coalesce((SELECT string_agg(phone, ' | ' ORDER BY o) FROM rphone r WHERE r.domain = d.domain), '') AS all_phones,
  coalesce((SELECT string_agg(platform || '=' || url, ' | ' ORDER BY o) FROM rsocial r WHERE r.domain = d.domain), '') AS social,
  coalesce((SELECT source FROM sources r WHERE r.domain = d.domain), '{rules.NO_SOURCE}') AS source FROM stops d)
""".strip()
CASCADE = LOCATED + ",\n" + CASCADE_STEPS
_success = "email IS NOT NULL OR phone IS NOT NULL OR social <> ''"

ORACLE = {
    "c1_email_candidates": with_pages("SELECT page_id, domain, CAST(ord AS INTEGER) AS ord, email FROM emails", ctes=EMAILS),
    "c1_document_emails": "WITH " + emails_sql("emails", "documents", "text", "doc_id") + " SELECT doc_id, CAST(ord AS INTEGER) AS ord, email FROM emails",
    "c2_email_quality": with_pages(
        f"SELECT page_id, domain, CAST(ord AS INTEGER) AS ord, email, {REASON} AS reason, ({REASON}) = 'ok' AS ok FROM emails", ctes=EMAILS
    ),
    "c3_best_email": with_pages(
        "SELECT domain, arg_min(email, CASE WHEN tier IS NOT NULL THEN tier * 1000000000 + page_id * 1000 + ord END) AS email, count(tier) AS usable FROM tiered GROUP BY domain",
        ctes=EMAILS + ",\n" + TIERED,
    ),
    "c3_valid_emails": with_pages(
        "SELECT domain, email, CAST(tier AS INTEGER) AS tier, page_id, CAST(ord AS INTEGER) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY domain, email, tier ORDER BY page_id, ord) AS rn "
        "FROM tiered WHERE tier IS NOT NULL) WHERE rn = 1",
        ctes=EMAILS + ",\n" + TIERED,
    ),
    "c4_phones": with_pages("SELECT page_id, domain, CAST(ord AS INTEGER) AS ord, phone FROM p", ctes=phones_sql("p", "pages_seeded", "html", "page_id, domain")),
    "c4_phones_international": with_pages(
        "SELECT page_id, domain, CAST(ord AS INTEGER) AS ord, phone FROM p", ctes=phones_sql("p", "pages_seeded", "html", "page_id, domain", True)
    ),
    "c5_socials": with_pages(
        "SELECT page_id, domain, CAST(ord AS INTEGER) AS ord, platform, url FROM s", ctes=socials_sql("s", "pages_seeded", "html", "page_id, domain")
    ),
    "c5_socials_basic": with_pages(
        "SELECT page_id, domain, CAST(ord AS INTEGER) AS ord, platform, url FROM s", ctes=socials_sql("s", "pages_seeded", "html", "page_id, domain", False)
    ),
    "c6_outreach": with_pages("SELECT h.page_id, domain, platform, link FROM handles h JOIN chosen c ON c.page_id = h.page_id AND c.place = h.place", ctes=OUTREACH),
    "c7_contact_cascade": with_pages(f"SELECT domain, email, all_emails, phone, all_phones, social, source, {_success} AS success FROM cascade", ctes=CASCADE),
    "c8_merge_contact": with_pages(
        f"""SELECT domain, CASE WHEN ok AND length(hi) > length(lo) THEN hi ELSE lo END AS title, email, phone, ok AS success FROM (
        SELECT t.domain, lo, hi, CASE WHEN {_success} THEN email END AS email, CASE WHEN {_success} THEN phone END AS phone, coalesce({_success}, FALSE) AS ok
        FROM (SELECT domain, min(left({TITLE}, 300)) AS lo, max(left({TITLE}, 300)) AS hi FROM markup GROUP BY domain) t LEFT JOIN cascade c ON c.domain = t.domain)""",
        "markup", ctes=CASCADE,
    ),
    "j6_completeness": with_pages(
        "SELECT domain, array_to_string(list_filter([CASE WHEN coalesce(trim(email), '') = '' THEN 'email' END, CASE WHEN coalesce(trim(phone), '') = '' THEN 'phone' END, "
        "CASE WHEN social = '' THEN 'social' END], lambda x: x IS NOT NULL), ' | ') AS missing FROM cascade",
        ctes=CASCADE,
    ),
    "j6_complete_only": with_pages("SELECT domain, email, phone FROM cascade WHERE email IS NOT NULL AND phone IS NOT NULL", ctes=CASCADE),
}
ORACLE["c7_contact_cascade_few"] = ORACLE["c7_contact_cascade"]
