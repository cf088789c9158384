"""Registered queries and oracle SQL for record sources, metric scores, alerts, sinks and the end-to-end plans.

JSON records are derived from the pages: one record per page, its shape and numbers chosen by the page id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.functions.patterns import constant
from sitegrain.operators import score, tech, verdicts
from sitegrain.plans import audit as audit_plan
from sitegrain.plans import leads
from sitegrain.rules import page as page_rules
from sitegrain.rules import records as rules
from sitegrain.rules import tech as tech_rules
from sitegrain.sources import records, sinks
from sitegrain.sources.pages import read_pages, with_domain
from workload.contacts import CASCADE, CASCADE_STEPS, _success, cascade, site_pages
from workload.funnel import BLOCKED, INTENTS_SQL, LIVENESS, SCORES, _info_hit, candidates, intents, scores
from workload.oracle_text import text_of, values, with_pages
from workload.seeded import by_page_id, domain_sql, pages_seeded, quote
from workload.structure import LANG, TITLE, joined
from workload.tech import DETECTIONS, HITS, INLINE, NAMES, _first, _names_list, category_sql

AS_OF = "2026-01-31"
# JSON texts per shape; {i} is the page id, {u} its url.
SERP = '{"organic":[{"link":"{u}","title":"T {i}","snippet":"s {i}"},{"title":"no link"},{"link":"https://www.shop{i}.example.com:8080/x","sitelinks":[{"title":"a","link":"b"}]}]}'
DETECTOR = [
    '{"url":"{u}","tech":["Shopify"," PayPal ","","T{i}"]}',
    '{"technologies":[{"name":"HubSpot","categories":["CRM","Tag managers"],"version":"{i}","confidence":90},{"app":"Legacy","categories":"Blogs"}]}',
    '{"apps":["Crisp",{"name":"Heat {i}","categories":["Heatmaps"]}]}',
    '["Stripe","Vue.js"]',
    '{"tech":["Broken"',
    'started\n{"tech":["Wix","Sugar CRM pro"]}\n{"tech":["Second line"]}',
]
REPORT = (
    '{"lighthouseResult":{"categories":{"performance":{"score":{p}},"seo":{"score":0.5},"best-practices":{"score":null}},"audits":{'
    '"largest-contentful-paint":{"title":"LCP","description":"d {i}","score":0.5,"displayValue":"2 s","numericValue":{i}04,"numericUnit":"millisecond"},'
    '"cumulative-layout-shift":{"title":"CLS","numericValue":0.1234},"server-response-time":{"numericValue":{i}.4},"viewport":{"title":"VP","score":1},'
    '"tap-targets":{"title":"Tap","score":{p}},"document-title":{"title":"Doc","score":1},"structured-data":{"title":"SD","score":null},'
    '"third-party-summary":{"title":"3P","details":{"items":[{"entity":{"text":"Ent {i}"},"transferSize":{i},"blockingTime":1.5},{"entity":"Plain","mainThreadTime":2}]}}}},'
    '"loadingExperience":{"overall_category":"FAST","metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":{i},"category":"SLOW"},"OTHER_METRIC":{"percentile":3,"category":"FAST"}}}}'
)
ASKED = [None, ["A11Y", "seo"], ["ALL"], ["speed", "core web vitals", "nothing"], ["best-practices", "third_party", "mobile"]]


def _filled(template):
    out = F.lit(template)
    share = F.format_string("0.%02d", (F.col("page_id") % 100).cast("int"))
    for mark, value in (("{i}", F.col("page_id").cast("string")), ("{u}", F.col("url")), ("{p}", share)):
        out = F.replace(out, F.lit(mark), value)
    return out


def _pages(s, d):
    return read_pages(s, d).select("page_id", "url")


def serp_raw(s, d):
    return _pages(s, d).select(F.col("page_id").alias("id"), F.concat(F.lit("query "), F.col("page_id") % 5).alias("query"), _filled(SERP).alias("json"))


def detections_raw(s, d):
    shape = F.get(F.array(*[_filled(t) for t in DETECTOR]), (F.col("page_id") % len(DETECTOR)).cast("int"))
    return _pages(s, d).select(F.col("page_id").alias("id"), shape.alias("json"))


def reports(s, d):
    asked = F.get(F.array(*[F.array(*[F.lit(c) for c in a]) if a else F.array().cast("array<string>") for a in ASKED]), (F.col("page_id") % len(ASKED)).cast("int"))
    text = F.when(F.col("page_id") % 13 == 0, F.lit('{"lighthouse')).otherwise(_filled(REPORT))
    return _pages(s, d).select(F.col("page_id").alias("id"), text.alias("json"), asked.alias("categories"))


FILE_ROWS = [
    ("/sitemap_index.xml", 200, "<x><loc>https://{d}/1</loc><loc>b</loc></x>", 0),
    ("/sitemap.xml", 404, "<loc>a</loc>", 0),
    ("/sitemap.xml", 200, "<urlset></urlset>", 1),
    ("/sitemap/", 200, "<loc>q{i}</loc>", 1),
    ("/ads.txt", 200, "Google.com, pub-{i}, DIRECT", 2),
    ("/ads.txt", 200, "short", 3),
    ("/ads.txt", 200, "other.example, {i}, RESELLER", 4),
    ("/robots.txt", 200, "User-agent: *", 0),
    ("/robots.txt", 500, "User-agent: *", 1),
]
INFRA_ROWS = [
    ("whois", "2010-05-{i}", 0, 0), ("whois", "14-Mar-2019", 0, 1), ("whois", "2021-01-02T03:04:05Z", 0, 2), ("whois", "unknown", 0, 3),
    ("registrar", "Registrar {i}", 0, 0),
    ("mx", "MX2.{d}.", 20, 0), ("mx", "aspmx.l.GOOGLE.com.", 30, 0), ("mx", "mail.{d}.", 10, 1), ("mx", "eu.zoho.com", 5, 2), ("mx", "x.mail.protection.outlook.com", 9, 2),
    ("ssl", "2026-02-{i}", 0, 0), ("ssl", "Feb 10 12:00:00 2026 GMT", 0, 1), ("ssl", "2026-01-30", 0, 2), ("ssl", "2027-01-30", 0, 3),
    ("issuer", "Let's Encrypt", 0, 0),
    ("ip", "35.1.2.3", 0, 0), ("ip", "104.21.3.{i}", 0, 1), ("ip", "10.0.0.1", 0, 2), ("ip", "52.174.9.9", 0, 3),
]


def _by_domain(s, d):
    sites = with_domain(_pages(s, d)).groupBy("domain").agg(F.min("page_id").alias("i"))
    return sites.withColumn("two", F.format_string("%02d", (F.col("i") % 28 + 1).cast("int")))


def _rows(s, d, rows, schema):
    """Rows of a template table for every site whose number fits; "{d}" is the domain, "{i}" two digits."""
    table = constant(rows, f"array<struct<{schema}>>")
    out = _by_domain(s, d).select("domain", "i", "two", F.explode(table).alias("r")).filter(F.col("i") % 5 == F.col("r.m"))
    fill = lambda c: F.replace(F.replace(c, F.lit("{d}"), F.col("domain")), F.lit("{i}"), F.col("two"))
    return out, fill


def files(s, d):
    out, fill = _rows(s, d, [dict(zip(("path", "status", "body", "m"), r)) for r in FILE_ROWS], "path: string, status: int, body: string, m: int")
    return out.select("domain", "r.path", "r.status", fill(F.col("r.body")).alias("body"))


def observations(s, d):
    out, fill = _rows(s, d, [dict(zip(("kind", "value", "pref", "m"), r)) for r in INFRA_ROWS], "kind: string, value: string, pref: int, m: int")
    return out.select("domain", "r.kind", fill(F.col("r.value")).alias("value"), "r.pref")


def _performance(s, d):
    metrics = records.lighthouse_metrics(reports(s, d)).withColumn("intent_id", F.col("id") % 3)
    return score.performance_score(metrics, intents(s))


def lead_pages(s, d):
    """The seeded pages and, for every seventh, a contact page of the same site with the same content."""
    pages = pages_seeded(s, d)
    origin = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    extra = pages.filter("page_id % 7 = 0").select((F.col("page_id") + 1000000).alias("page_id"), F.concat(origin, F.lit("/contacto")).alias("url"), "html")
    return pages.unionByName(extra)


def verdict_rows(s, d):
    """One verdict per (intent, site), its text chosen by the site's first page."""
    sites = with_domain(_pages(s, d)).groupBy((F.col("page_id") % 3).alias("intent_id"), "domain").agg(F.min("page_id").alias("i"))
    texts = F.array(*[F.lit(t) for t in ("SI", "No, no encaja.", "quizás", "Sí, claro", "Creo que no", "diría que sí", "")])
    pick = (F.col("i") % 8).cast("int")
    return sites.select(
        "intent_id", "domain", F.coalesce(F.get(texts, pick), F.lit("")).alias("raw"), F.when(F.col("i") % 8 == 7, "timeout").alias("error")
    )


def fast(s, d):
    return leads.fast_leads(candidates(s, d).drop("page_id"), lead_pages(s, d), intents(s))


def precise(s, d):
    return leads.precise_leads(candidates(s, d).drop("page_id"), lead_pages(s, d), intents(s), verdict_rows(s, d), ["email"], 2)


def audited(s, d, pages=None):
    return audit_plan.site_audit(pages or site_pages(s, d), records.infra_facts(observations(s, d), AS_OF), records.site_files(files(s, d)))


def _flat(df):
    urls = F.transform("social", lambda x: F.concat(x["platform"], F.lit("="), x["url"]))
    return joined(df.withColumn("social", urls), "social", "reasons", "all_emails", "all_phones")


def _alerts(s, d):
    return audited(s, d).select("domain", F.array_join("alerts", " | ").alias("alerts"))


def _audit(s, d, pages=None):
    wide = joined(audited(s, d, pages), "technologies", "missing_pixels", "support_widgets", "email_tools", "alerts")
    return wide.drop("social", "registrar", "ssl_issuer")


def _contacts(s, d):
    sites = with_domain(site_pages(s, d)).groupBy("domain").agg(F.min("url").alias("url"), F.lit(1.5).alias("confidence"))
    return cascade(s, d).join(sites, "domain").withColumn("title", F.col("domain"))


QUERIES = {
    "src2_serp_candidates": lambda s, d: records.serp_candidates(serp_raw(s, d)).withColumn("sitelinks", F.size("sitelinks")),
    "src3_tech_detections": lambda s, d: joined(records.tech_detections(detections_raw(s, d)), "categories"),
    "t7_detector_categories": lambda s, d: tech.categories_of_detection(records.tech_detections(detections_raw(s, d))),
    "src4_lighthouse_metrics": lambda s, d: records.lighthouse_metrics(reports(s, d)),
    "src4_lighthouse_scores": lambda s, d: records.lighthouse_scores(reports(s, d)),
    "src5_lighthouse_audits": lambda s, d: records.lighthouse_audits(reports(s, d)),
    "src5_third_party_items": lambda s, d: records.third_party_items(reports(s, d)),
    "src5_field_metrics": lambda s, d: records.field_metrics(reports(s, d)),
    "src7_site_files": lambda s, d: records.site_files(files(s, d)),
    "src8_infra_facts": lambda s, d: records.infra_facts(observations(s, d), AS_OF),
    "j5_meets_criteria": lambda s, d: records.meets_criteria(
        records.lighthouse_metrics(reports(s, d)), {"performance": "average", "max_lcp": 90.0, "min_seo_score": 50}
    ).select("id"),
    "j8_apply_verdicts": lambda s, d: verdicts.apply_verdicts(verdict_rows(s, d).select("intent_id", "domain"), verdict_rows(s, d), 2),
    "x8_performance_score": _performance,
    "x9_alerts": _alerts,
    "snk1_json_envelope": lambda s, d: sinks.json_envelope(scores(s, d)),
    "snk2_results_csv": lambda s, d: sinks.results_csv(scores(s, d)),
    "snk3_contacts_wide": lambda s, d: sinks.contacts_wide(_contacts(s, d), ["email", "phone", "social"]),
    "snk3_contacts_flat": lambda s, d: sinks.contacts_flat(_contacts(s, d)),
    "snk4_marketing_wide": lambda s, d: sinks.marketing_wide(_contacts(s, d), ["domain", "email", "social"]),
    "snk5_audit_wide": lambda s, d: sinks.audit_wide(audited(s, d)),
    "e1_fast_leads": lambda s, d: _flat(fast(s, d)),
    "e2_precise_leads": lambda s, d: _flat(precise(s, d)),
    "e3_site_audit": _audit,
    "e3_site_audit_by_id": lambda s, d: _audit(s, d, by_page_id(s, site_pages(s, d))),
}

# --- oracle -----------------------------------------------------------------------------------------------------


def _fill(template):
    out = quote(template)
    if "\n" in template:
        out = "replace(" + quote(template.replace("\n", "~")) + ", '~', chr(10))"
    for mark, value in (("{i}", "CAST(page_id AS VARCHAR)"), ("{u}", "url"), ("{p}", "'0.' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0')")):
        out = f"replace({out}, '{mark}', {value})"
    return out


_shapes = " ".join(f"WHEN {n} THEN {_fill(t)}" for n, t in enumerate(DETECTOR))
DETECTED = f"""
raw AS (SELECT page_id AS id, CASE page_id % {len(DETECTOR)} {_shapes} END AS txt FROM pages),
lines AS (SELECT id, unnest(string_split(txt, chr(10))) AS line, generate_subscripts(string_split(txt, chr(10)), 1) AS n FROM raw),
first_line AS (SELECT id, arg_min(trim(line), n) AS line FROM lines WHERE trim(line) LIKE '{{%' AND json_valid(trim(line)) GROUP BY id),
parsed AS (SELECT r.id, CAST(coalesce(f.line, CASE WHEN json_valid(r.txt) THEN r.txt END) AS JSON) AS j FROM raw r LEFT JOIN first_line f ON f.id = r.id),
lists AS (SELECT id, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j, '$.tech') IS NOT NULL THEN json_extract(j, '$.tech')
  ELSE coalesce(json_extract(j, '$.technologies'), json_extract(j, '$.apps')) END AS l FROM parsed WHERE j IS NOT NULL),
items AS (SELECT id, CAST(k AS INTEGER) AS pos, json_extract(l, '$[' || k || ']') AS x FROM (SELECT id, l, unnest(range(json_array_length(l)::INT)) AS k FROM lists WHERE json_type(l) = 'ARRAY')),
detected AS MATERIALIZED (SELECT * FROM (SELECT id, pos, CASE json_type(x) WHEN 'VARCHAR' THEN trim(json_extract_string(x, '$'))
  ELSE coalesce(json_extract_string(x, '$.name'), json_extract_string(x, '$.app')) END AS tech,
  CASE json_type(x, '$.categories') WHEN 'ARRAY' THEN array_to_string(json_extract_string(x, '$.categories[*]'), ' | ') WHEN 'VARCHAR' THEN json_extract_string(x, '$.categories') ELSE '' END AS categories,
  json_extract_string(x, '$.version') AS version, coalesce(CAST(json_extract_string(x, '$.confidence') AS INTEGER), 100) AS confidence FROM items) WHERE tech <> '')
""".strip()
REPORTS = f"reports AS MATERIALIZED (SELECT page_id AS id, CASE WHEN page_id % 13 <> 0 THEN CAST({_fill(REPORT)} AS JSON) END AS j FROM pages)"


def _num(path):
    return f"CAST(json_extract_string(j, '{path}') AS DOUBLE)"


def _audit_num(name):
    return _num(f'$.lighthouseResult.audits."{name}".numericValue')


def _audit_ok(name, least):
    return f"""(coalesce({_num(f'$.lighthouseResult.audits."{name}".score')} >= {least}, FALSE))::INT"""


METRICS = f"""
{REPORTS},
metrics AS MATERIALIZED (SELECT *, CASE WHEN performance_score IS NULL THEN 'unknown' WHEN performance_score >= 90 THEN 'fast' WHEN performance_score >= 50 THEN 'average' ELSE 'slow' END
  AS performance_category FROM (SELECT id, round_even({_num('$.lighthouseResult.categories.performance.score')} * 100, 1) AS performance_score,
  round_even({_num('$.lighthouseResult.categories.seo.score')} * 100, 1) AS seo_score, CAST(NULL AS DOUBLE) AS accessibility_score, CAST(NULL AS DOUBLE) AS best_practices_score,
  round_even({_audit_num('largest-contentful-paint')} / 1000, 2) AS lcp, CAST(NULL AS DOUBLE) AS fcp, round_even({_audit_num('cumulative-layout-shift')}, 3) AS cls,
  CAST(NULL AS DOUBLE) AS total_blocking_time, CAST(NULL AS DOUBLE) AS speed_index, CAST(NULL AS DOUBLE) AS time_to_interactive,
  round_even({_audit_num('server-response-time')}, 0) AS ttfb, {_audit_ok('viewport', 1)} + {_audit_ok('tap-targets', 0.9)} >= 2 AS is_mobile_friendly, j IS NOT NULL AS analysis_success FROM reports))
""".strip()
_wanted = {0: list(rules.AUDITS), 1: ["accessibility", "seo"], 2: list(rules.AUDITS), 3: ["performance", "core_web_vitals"], 4: ["best_practices", "third_party", "mobile"]}
_audit_rows = values("asked", ["m", "category", "audit"], [(m, c, a) for m, cats in _wanted.items() for c in cats if c != "third_party" for a in rules.AUDITS[c]])


def _template(name, rows, columns):
    return values(name, columns, rows)


SITES = f"sites0 AS (SELECT {domain_sql('url')} AS domain, min(page_id) AS i FROM pages GROUP BY 1), sites AS (SELECT *, lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') AS two FROM sites0)"
_fill_site = lambda c: f"replace(replace({c}, '{{d}}', s.domain), '{{i}}', s.two)"
FILES = f"""
{SITES},
{values('file_rows', ['path', 'status', 'body', 'm'], FILE_ROWS)},
files AS (SELECT s.domain, path, status, {_fill_site('body')} AS body FROM sites s JOIN file_rows r ON s.i % 5 = r.m),
{values('sitemaps', ['priority', 'path'], list(enumerate(rules.SITEMAP_PATHS)))},
maps AS (SELECT f.domain, f.path, p.priority, len(regexp_extract_all(body, '<loc>[^<]+</loc>')) AS urls FROM files f JOIN sitemaps p ON p.path = f.path WHERE status BETWEEN 200 AND 399),
site_files AS MATERIALIZED (SELECT f.domain, (SELECT arg_min(path, priority) FROM maps m WHERE m.domain = f.domain AND urls > 0) AS sitemap_path,
  CAST((SELECT arg_min(urls, priority) FROM maps m WHERE m.domain = f.domain AND urls > 0) AS INTEGER) AS sitemap_urls,
  bool_or(path = '/ads.txt' AND length(body) > 10) AS has_ads_txt, bool_or(path = '/ads.txt' AND length(body) > 10 AND contains(lower(body), 'google.com')) AS has_google_ads_txt,
  bool_or(path = '/robots.txt' AND length(body) > 5) AS has_robots_txt FROM files f WHERE status BETWEEN 200 AND 399 GROUP BY f.domain)
""".strip()
_mail = "CASE " + " ".join(f"WHEN bool_or(kind = 'mx' AND contains(host, '{p}')) THEN '{label}'" for p, label in rules.MAIL_PROVIDERS) + " END"
_hosting = "CASE " + " ".join(f"WHEN starts_with(value, '{p}') THEN '{label}'" for label, ps in rules.HOSTING_PREFIXES for p in ps) + " END"
_date = "coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(value, '%d-%b-%Y'), try_strptime(value, '%b %d %H:%M:%S %Y GMT'))::DATE"
INFRA = f"""
{values('infra_rows', ['kind', 'value', 'pref', 'm'], INFRA_ROWS)},
obs AS (SELECT s.domain, kind, {_fill_site('value')} AS value, pref FROM sites s JOIN infra_rows r ON s.i % 5 = r.m),
obs2 AS (SELECT *, {_date} AS day, regexp_replace(lower(value), '[.]$', '') AS host, {_hosting} AS hosting FROM obs),
infra AS MATERIALIZED (SELECT domain, CAST(reg AS VARCHAR) AS registered_date, round_even(date_diff('day', reg, DATE '{AS_OF}') / 365.25, 1) AS domain_age_years, registrar, mx_provider,
  date_diff('day', DATE '{AS_OF}', ex) > 0 AS ssl_valid, CAST(ex AS VARCHAR) AS ssl_expires, CAST(date_diff('day', DATE '{AS_OF}', ex) AS INTEGER) AS ssl_days_remaining, ssl_issuer, hosting_ip, hosting_provider FROM (
  SELECT domain, min(day) FILTER (kind = 'whois') AS reg, min(value) FILTER (kind = 'registrar') AS registrar, coalesce({_mail}, arg_min(host, pref) FILTER (kind = 'mx')) AS mx_provider,
    max(day) FILTER (kind = 'ssl') AS ex, min(value) FILTER (kind = 'issuer') AS ssl_issuer, min(value) FILTER (kind = 'ip') AS hosting_ip, min(hosting) FILTER (kind = 'ip') AS hosting_provider
  FROM obs2 GROUP BY domain))
""".strip()
_yes, _no = r"(^|[^\p{L}\p{N}_])(s[ií]|yes)([^\p{L}\p{N}_]|$)", r"(^|[^\p{L}\p{N}_])no([^\p{L}\p{N}_]|$)"
VERDICTS = f"""
verdict0 AS (SELECT page_id % 3 AS intent_id, {domain_sql('url')} AS domain, min(page_id) % 8 AS m FROM pages GROUP BY ALL),
verdict1 AS (SELECT *, coalesce(['SI', 'No, no encaja.', 'quizás', 'Sí, claro', 'Creo que no', 'diría que sí', ''][m::INT + 1], '') AS raw, m = 7 AS failed FROM verdict0),
verdict2 AS (SELECT *, lower(regexp_extract(raw, '[\\p{{L}}\\p{{N}}_]+')) AS w, regexp_matches(lower(raw), '{_yes}') AS y, regexp_matches(lower(raw), '{_no}') AS n FROM verdict1),
verdicts AS MATERIALIZED (SELECT intent_id, domain, raw AS verdict, failed, CASE WHEN w IN ('si', 'sí', 'yes') THEN TRUE WHEN w = 'no' THEN FALSE WHEN y AND NOT n THEN TRUE
  WHEN n AND NOT y THEN FALSE END AS answer FROM verdict2)
""".strip()
_passed = "CASE WHEN failed THEN TRUE ELSE coalesce(answer, FALSE) END AS passed, CASE WHEN failed THEN 0 WHEN answer IS NULL THEN 1 WHEN answer THEN 3 ELSE 0 END AS verdict_score"

LEADS = f"""
{SCORES},
{BLOCKED},
{LIVENESS},
e_kept AS (SELECT c.* FROM (SELECT *, lower(title || ' ' || snippet) AS text FROM candidates) c JOIN intents i ON i.intent_id = c.intent_id WHERE position <= 20
  AND NOT EXISTS (SELECT 1 FROM blocked b WHERE c.domain = b.host OR suffix(c.domain, '.' || b.host)) AND NOT ({_info_hit}) AND len(list_filter(i.bad, lambda w: contains(text, lower(w)))) = 0),
e_first AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY intent_id, domain ORDER BY query_ord, position, url) AS rn FROM e_kept) WHERE rn = 1),
e_budget AS (SELECT * FROM (SELECT f.*, i.max_results, row_number() OVER (PARTITION BY f.intent_id ORDER BY query_ord, position, url) AS arrival FROM e_first f JOIN intents i ON i.intent_id = f.intent_id)
  WHERE arrival <= greatest(6 * max_results, 60)),
e_scored AS MATERIALIZED (SELECT b.intent_id, b.domain, b.page_id, b.url, b.title, b.max_results, s.snippet_score, x.content_score, x.is_ecommerce, x.is_software, x.is_service_business, i.business_type, l.reason,
  CAST(round(0.3 * s.snippet_score + 0.4 * x.content_score + 15, 6) AS DOUBLE) AS confidence
  FROM e_budget b JOIN snippet_scores s ON s.intent_id = b.intent_id AND s.page_id = b.page_id JOIN contents x ON x.intent_id = b.intent_id AND x.page_id = b.page_id
  JOIN liveness l ON l.page_id = b.page_id JOIN intents i ON i.intent_id = b.intent_id)
""".strip()
LEAD_STEPS = f"""
lead_pages AS (SELECT page_id, domain, html, '' AS path FROM pages_seeded UNION ALL SELECT page_id + 1000000, domain, html, '/contacto' FROM pages_seeded WHERE page_id % 7 = 0),
one_each AS (SELECT k.intent_id || ' ' || k.domain AS domain, 0 AS sr, '' AS path, p.html FROM e_sites k JOIN pages_seeded p ON p.page_id = k.page_id
  UNION ALL SELECT domain, 1, path, html FROM (SELECT k.intent_id || ' ' || k.domain AS domain, p.path, p.html, row_number() OVER (PARTITION BY k.intent_id, k.domain ORDER BY p.page_id) AS rn
    FROM e_sites k JOIN lead_pages p ON p.domain = k.domain AND p.path = '/contacto') WHERE rn = 1),
{CASCADE_STEPS},
e_found AS (SELECT e.*, c.email, c.all_emails, c.phone, c.all_phones, c.social, c.source FROM e_sites e JOIN cascade c ON c.domain = e.intent_id || ' ' || e.domain)
""".strip()
_lead_columns = f"""intent_id, CAST(rank AS INTEGER) AS rank, domain, url, confidence, CASE WHEN length(title) > 60 THEN left(title, 60) || '...' ELSE title END AS title,
  array_to_string(list_filter([CASE WHEN snippet_score > 50 THEN 'Snippet relevante (score: ' || snippet_score || ')' END, CASE WHEN content_score > 50 THEN 'Contenido relevante (score: ' || content_score || ')' END,
    CASE WHEN is_ecommerce AND business_type = 'ecommerce' THEN 'Schema.org confirma ecommerce' WHEN is_software AND business_type = 'saas' THEN 'Schema.org confirma software'
      WHEN is_service_business AND business_type = 'agencia' THEN 'Schema.org confirma servicios' END], lambda x: x IS NOT NULL), ' | ') AS reasons,
  email, all_emails, phone, all_phones, social, source, {_success} AS success"""
_cats = values("req_cats", ["word", "category"], [(w, c) for w, cs in tech_rules.REQUIREMENT_CATEGORIES.items() for c in cs])
_tcats = values("target_cats", ["word", "category"], [(w, c) for w, cs in tech_rules.TARGET_CATEGORIES.items() for c in cs])
PRECISE = f"""
{DETECTIONS},
{INLINE},
{HITS},
{_cats},
{_tcats},
{VERDICTS},
blobs AS (SELECT a.page_id, lower(a.host || ' ' || a.url || ' ' || coalesce(t.tech, '')) AS blob FROM assets a LEFT JOIN asset_tech t ON t.page_id = a.page_id AND t.pos = a.pos
  UNION ALL SELECT page_id, lower(label || ' ' || snippet) FROM inline_found),
wanted AS (SELECT e.intent_id, e.domain, e.page_id, lower(unnest(i.must_have)) AS w FROM e_scored e JOIN intents i ON i.intent_id = e.intent_id),
unmet AS (SELECT DISTINCT intent_id, domain FROM wanted q WHERE NOT EXISTS (SELECT 1 FROM detections t WHERE t.page_id = q.page_id AND (contains(lower(t.tech), w) OR contains(w, lower(t.tech))))
  AND NOT EXISTS (SELECT 1 FROM detections t JOIN target_cats c ON c.category = t.category WHERE t.page_id = q.page_id AND c.word = w)
  AND NOT EXISTS (SELECT 1 FROM blobs b WHERE b.page_id = q.page_id AND contains(b.blob, w))),
refused AS (SELECT DISTINCT e.intent_id, e.domain FROM (SELECT e.*, lower(unnest(i.must_not)) AS w FROM e_scored e JOIN intents i ON i.intent_id = e.intent_id) e
  JOIN detections t ON t.page_id = e.page_id AND (contains(lower(t.tech), w) OR EXISTS (SELECT 1 FROM req_cats c WHERE c.word = w AND c.category = t.category))),
e_sites AS MATERIALIZED (SELECT e.*, v.passed, v.verdict_score FROM e_scored e JOIN (SELECT intent_id, domain, {_passed} FROM verdicts) v ON v.intent_id = e.intent_id AND v.domain = e.domain
  WHERE confidence >= 60 AND v.passed AND NOT EXISTS (SELECT 1 FROM unmet u WHERE u.intent_id = e.intent_id AND u.domain = e.domain)
  AND NOT EXISTS (SELECT 1 FROM refused u WHERE u.intent_id = e.intent_id AND u.domain = e.domain))
""".strip()
_days, _miss = "ssl_days_remaining", "missing_pixels"
_key = f"len(list_filter({sorted(rules.KEY_PIXELS)!r}, lambda k: contains(' | ' || {_miss} || ' |', ' | ' || k || ' |')))"
_keys_shown = f"array_to_string(list_filter(string_split({_miss}, ' | '), lambda k: k IN ({', '.join(quote(k) for k in rules.KEY_PIXELS)})), ', ')"
_alert_sql = f"""array_to_string(list_filter([
  CASE WHEN {_days} <= 0 THEN {quote(rules.ALERT_EXPIRED)} WHEN {_days} <= 14 THEN {quote(rules.ALERT_EXPIRES[0])} || {_days} || {quote(rules.ALERT_EXPIRES[1])}
    WHEN {_days} <= 30 THEN {quote(rules.ALERT_EXPIRES_SOON[0])} || {_days} || {quote(rules.ALERT_EXPIRES_SOON[1])} WHEN {_days} IS NULL AND NOT ssl_valid THEN {quote(rules.ALERT_INVALID)} END,
  CASE WHEN {_key} = 3 THEN {quote(rules.ALERT_NO_PIXEL)} WHEN {_key} > 0 THEN {quote(rules.ALERT_PIXELS)} || {_keys_shown} END,
  CASE WHEN upsell_opportunity THEN {quote(rules.ALERT_REVIEWS[0])} || platform || {quote(rules.ALERT_REVIEWS[1])} END,
  CASE WHEN missing_title THEN {quote(rules.ALERT_TITLE)} END, CASE WHEN missing_description THEN {quote(rules.ALERT_DESCRIPTION)} END], lambda x: x IS NOT NULL), ' | ')"""


def _meta1(key):
    return f"(SELECT arg_min(content, n) FROM metas t WHERE t.page_id = m.page_id AND key = '{key}' AND content <> '')"


_paths = values("paths", ["path"], [(p,) for p, _ in page_rules.IMPORTANT_PATHS["full"]])
_site_url = """CASE WHEN m.page_id % 4 = 1 THEN o || '/contacto' WHEN m.page_id % 4 = 2 THEN o || '/contact' WHEN m.page_id % 8 = 3 THEN o || '/about/' WHEN m.page_id % 16 = 4 THEN o || '/'
  WHEN m.page_id % 32 = 12 THEN o || '/kontakt' WHEN m.page_id % 32 = 28 THEN o || '/aviso-legal' ELSE m.url END"""
AUDIT = f"""
{DETECTIONS},
{CASCADE},
{FILES},
{INFRA},
{_paths},
homes AS (SELECT page_id, domain FROM source_pages WHERE sr = 0),
home_facts AS MATERIALIZED (SELECT m.domain, m.page_id, {_site_url} AS url, left({TITLE}, 150) AS title,
  lower(trim(split_part(coalesce(nullif({LANG}, ''), {_meta1('content-language')}), '-', 1))) AS language, left(coalesce({_meta1('description')}, {_meta1('og:description')}), 250) AS description,
  (SELECT left(arg_min({text_of('v')}, n), 150) FROM (SELECT unnest(regexp_extract_all(m.markup, '(?is)<h1(?:\\s[^>]*)?>.*?</h1\\s*>')) AS v,
    generate_subscripts(regexp_extract_all(m.markup, '(?is)<h1(?:\\s[^>]*)?>.*?</h1\\s*>'), 1) AS n) WHERE {text_of('v')} <> '') AS h1,
  coalesce((SELECT string_agg(DISTINCT tech, ' | ' ORDER BY tech) FROM detections d WHERE d.page_id = m.page_id), '') AS technologies, {_names_list(tech_rules.PIXELS, False)} AS missing_pixels,
  {_names_list(tech_rules.SUPPORT_WIDGETS)} AS support_widgets, {_names_list(tech_rules.EMAIL_TOOLS)} AS email_tools, regexp_matches(html, '(?i){tech_rules.POPUPS}') AS has_popups,
  coalesce((SELECT min(tech) FROM detections d WHERE d.page_id = m.page_id AND d.category = 'ecommerce'), {_first(tech_rules.SHOP_PLATFORMS)}) AS platform0, {_first(tech_rules.REVIEW_PLATFORMS)} AS review0,
  CAST((SELECT count(DISTINCT path) FROM links l JOIN paths p ON contains(lower(l.href), p.path) WHERE l.page_id = m.page_id) AS INTEGER) AS important_pages
  FROM (SELECT *, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS o FROM markup) m JOIN homes h ON h.page_id = m.page_id),
audit0 AS (SELECT f.*, platform0 IS NOT NULL AS is_ecommerce, platform0 AS platform, platform0 IS NOT NULL AND review0 IS NOT NULL AS has_reviews,
  CASE WHEN platform0 IS NOT NULL THEN review0 END AS review_platform, platform0 IS NOT NULL AND review0 IS NULL AS upsell_opportunity, coalesce(title, '') = '' AS missing_title, description IS NULL AS missing_description,
  c.email, c.phone, c.source AS contact_source, i.* EXCLUDE (domain, registrar, ssl_issuer), s.* EXCLUDE (domain)
  FROM home_facts f LEFT JOIN cascade c ON c.domain = f.domain LEFT JOIN infra i ON i.domain = f.domain LEFT JOIN site_files s ON s.domain = f.domain),
audits AS MATERIALIZED (SELECT * EXCLUDE (platform0, review0), {_alert_sql} AS alerts FROM audit0)
""".strip()


def _last(platform):
    return f"coalesce((SELECT arg_max(url, o) FROM rsocial r WHERE r.domain = c.domain AND platform = '{platform}'), '')"


_wide_social = ", ".join(f'{_last(p)} AS "{t}"' for p, t in zip(sinks.PLATFORMS, sinks.PLATFORM_TITLES))


def _extra(table, col):
    return f"coalesce((SELECT string_agg({col}, '; ' ORDER BY o) FROM {table} r WHERE r.domain = c.domain AND r.{col} IS DISTINCT FROM c.{col}), '')"


_site_urls = f"site_urls AS (SELECT domain, min({_site_url}) AS url FROM (SELECT *, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS o FROM pages_seeded) m GROUP BY domain)"
_metric_cols = "id, performance_score, seo_score, accessibility_score, best_practices_score, lcp, fcp, cls, total_blocking_time, speed_index, time_to_interactive, ttfb, is_mobile_friendly, analysis_success, performance_category"
ORACLE = {
    "src2_serp_candidates": f"""SELECT page_id AS id, 'query ' || page_id % 5 AS query, 1 AS position, url, {domain_sql('url')} AS domain, 'T ' || page_id AS title, 's ' || page_id AS snippet, 0 AS sitelinks FROM pages
        UNION ALL SELECT page_id, 'query ' || page_id % 5, 3, 'https://www.shop' || page_id || '.example.com:8080/x', 'shop' || page_id || '.example.com', '', '', 1 FROM pages""",
    "src3_tech_detections": "WITH " + DETECTED + " SELECT * FROM detected",
    "t7_detector_categories": "WITH " + DETECTED + ",\n" + NAMES + f""",
 by_name AS ({category_sql('detected')}), {values('mapped', ['name', 'category'], list(tech_rules.DETECTOR_CATEGORIES.items()))},
 own AS (SELECT id, tech, unnest(string_split(categories, ' | ')) AS c FROM detected WHERE categories <> '')
 SELECT id, tech, m.category FROM own JOIN mapped m ON m.name = lower(c) UNION SELECT d.id, d.tech, n.category FROM detected d JOIN by_name n ON n.tech = d.tech WHERE n.category IS NOT NULL""",
    "src4_lighthouse_metrics": "WITH " + METRICS + f" SELECT {_metric_cols} FROM metrics",
    "src4_lighthouse_scores": "WITH " + METRICS + " SELECT id, performance_score, seo_score, is_mobile_friendly, performance_category, analysis_success FROM metrics",
    "src5_lighthouse_audits": "WITH " + REPORTS + ", " + _audit_rows + """ SELECT r.id, category, audit, json_extract_string(a, '$.title') AS title, left(coalesce(json_extract_string(a, '$.description'), ''), 300) AS description,
        CAST(json_extract_string(a, '$.score') AS DOUBLE) AS score, json_extract_string(a, '$.displayValue') AS display, CAST(json_extract_string(a, '$.numericValue') AS DOUBLE) AS value,
        json_extract_string(a, '$.numericUnit') AS unit FROM (SELECT r.id, q.category, q.audit, json_extract(j, '$.lighthouseResult.audits."' || q.audit || '"') AS a FROM reports r JOIN asked q ON q.m = r.id % 5) r WHERE a IS NOT NULL""",
    "src5_third_party_items": "WITH " + REPORTS + """ SELECT id, 0 AS pos, 'Ent ' || id AS entity, CAST(id AS DOUBLE) AS transfer_size, 1.5::DOUBLE AS blocking_time, NULL::DOUBLE AS main_thread_time FROM reports WHERE j IS NOT NULL
        UNION ALL SELECT id, 1, 'Plain', NULL, NULL, 2.0 FROM reports WHERE j IS NOT NULL""",
    "src5_field_metrics": "WITH " + REPORTS + """ SELECT id, 'lcp_ms' AS metric, CAST(json_extract_string(j, '$.loadingExperience.metrics.LARGEST_CONTENTFUL_PAINT_MS.percentile') AS DOUBLE) AS percentile, 'SLOW' AS category
        FROM reports WHERE j IS NOT NULL UNION ALL SELECT id, 'other_metric', 3.0, 'FAST' FROM reports WHERE j IS NOT NULL""",
    "src7_site_files": "WITH " + FILES + " SELECT * FROM site_files",
    "src8_infra_facts": "WITH " + SITES + ",\n" + INFRA + " SELECT * FROM infra",
    "j5_meets_criteria": "WITH " + METRICS + " SELECT id FROM metrics WHERE analysis_success AND performance_category = 'average' AND lcp <= 90 AND seo_score >= 50",
    "j8_apply_verdicts": "WITH " + VERDICTS + f" SELECT intent_id, domain, {_passed}, verdict FROM verdicts",
    "x8_performance_score": "WITH " + METRICS + ", " + INTENTS_SQL + """ SELECT intent_id, id, CAST(CASE WHEN NOT analysis_success THEN 50 ELSE greatest(0, least(100, 50
        + CASE WHEN wanted_speed = 'lenta' THEN CASE performance_category WHEN 'slow' THEN 40 WHEN 'average' THEN 20 ELSE 0 END WHEN wanted_speed = 'fast' THEN CASE performance_category WHEN 'fast' THEN 40 WHEN 'average' THEN 20 ELSE 0 END ELSE 0 END
        + CASE WHEN check_mobile THEN CASE WHEN is_mobile_friendly THEN 20 ELSE -10 END ELSE 0 END)) END AS INTEGER) AS performance_score FROM metrics JOIN intents ON intent_id = id % 3""",
    "x9_alerts": with_pages("SELECT domain, alerts FROM audits", "metas", "links", ctes=AUDIT),
    "snk1_json_envelope": with_pages("SELECT count(*) AS total_results, count(*) FILTER (is_valid) AS valid_count FROM scores", "metas", ctes=SCORES),
    "snk2_results_csv": with_pages(
        """SELECT domain AS "Domain", url AS "URL", CASE WHEN is_valid THEN 'True' ELSE 'False' END AS "Is Valid", CAST(CAST(round_even(confidence, 1) AS DECIMAL(6,1)) AS VARCHAR) AS "Confidence Score",
        title AS "Page Title", array_to_string(list_slice(string_split(keywords, ' | '), 1, 5), ', ') AS "Keywords", replace(reasons, ' | ', ', ') AS "Validation Reasons", replace(rejections, ' | ', ', ') AS "Rejection Reasons" FROM scores""",
        "metas", ctes=SCORES,
    ),
    "snk3_contacts_wide": with_pages(
        f"""SELECT c.domain AS "Dominio", u.url AS "URL", 1.5 AS "Confianza", c.domain AS "Título", coalesce(email, 'N/A') AS "Email", {_extra('remail', 'email')} AS "Emails_Adicionales",
        coalesce(phone, 'N/A') AS "Teléfono", {_extra('rphone', 'phone')} AS "Teléfonos_Adicionales", {_wide_social}, '' AS "Otras_RRSS" FROM cascade c JOIN site_urls u ON u.domain = c.domain""".replace("1.5 AS", "1.5::DOUBLE AS"),
        ctes=CASCADE + ",\n" + _site_urls,
    ),
    "snk3_contacts_flat": with_pages(
        """SELECT c.domain, u.url, c.domain AS title, coalesce(email, 'N/A') AS email, coalesce(phone, 'N/A') AS phone,
        coalesce((SELECT string_agg(url, '; ' ORDER BY o) FROM rsocial r WHERE r.domain = c.domain), 'N/A') AS social_media FROM cascade c JOIN site_urls u ON u.domain = c.domain""",
        ctes=CASCADE + ",\n" + _site_urls,
    ),
    "snk4_marketing_wide": with_pages(f'SELECT domain AS "Domain", coalesce(email, \'\') AS "Email", {_wide_social} FROM cascade c', ctes=CASCADE),
    "snk5_audit_wide": with_pages(
        """SELECT domain AS "Domain", url AS "URL", '' AS "HTTP", CASE WHEN ssl_valid THEN 'Valid' ELSE 'Invalid' END AS "SSL", coalesce(email, '') AS "Email", coalesce(phone, '') AS "Phone",
        replace(technologies, ' | ', '; ') AS "Technologies", coalesce(language, '') AS "Language" FROM audits""",
        "metas", "links", ctes=AUDIT,
    ),
    "e1_fast_leads": with_pages(
        f"SELECT {_lead_columns} FROM (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY confidence DESC, domain) AS rank FROM e_found) WHERE rank <= max_results",
        "metas", ctes=LEADS + ",\ne_sites AS MATERIALIZED (SELECT * FROM e_scored WHERE confidence >= 60 AND reason = 'ok'),\n" + LEAD_STEPS,
    ),
    "e2_precise_leads": with_pages(
        f"SELECT {_lead_columns}, verdict_score FROM (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY confidence DESC, domain) AS rank FROM e_found WHERE email IS NOT NULL) WHERE rank <= max_results",
        "metas", ctes=LEADS + ",\n" + PRECISE + ",\n" + LEAD_STEPS,
    ),
    "e3_site_audit": with_pages("SELECT * FROM audits", "metas", "links", ctes=AUDIT),
}

ORACLE["e3_site_audit_by_id"] = ORACLE["e3_site_audit"]
