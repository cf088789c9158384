"""Registered queries and oracle SQL for redirect chains, domain lists over many files, and leads by URL variants."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitegrain.operators.redirects import redirect_ends
from sitegrain.plans import audit as audit_plan
from sitegrain.plans import leads
from sitegrain.session import scratch_folder
from sitegrain.sources import records, sinks
from workload import records as base
from workload.funnel import candidates, intents
from workload.oracle_text import with_pages
from workload.seeded import domain_sql


def hop_pages(s, d):
    """The audit's pages with an answer each: chains of up to six hops, circles of two that others lead into, ends that failed."""
    pages = base.site_pages(s, d)
    i = F.col("page_id")
    to = F.when(i % 50 == 49, i - 1).when((i % 50).isin(47, 48) | (i % 10).between(1, 6), i + 1)
    far = base.site_pages(s, d).select(F.col("page_id").alias("to"), F.regexp_replace("url", "^https?:", "HTTP:").alias("far"))
    led = pages.withColumn("to", to).join(far, "to", "left")
    status = F.when(F.col("far").isNotNull(), 301).when(i % 10 == 7, 404).otherwise(200)
    return led.withColumn("status", status).withColumn("final_url", F.when(F.col("far").isNotNull(), F.concat("far", F.lit("#moved")))).drop("to", "far")


def _audited(s, d):
    return audit_plan.site_audit(hop_pages(s, d), records.infra_facts(base.observations(s, d), base.AS_OF), records.site_files(base.files(s, d)))


def _domain_list(s, d):
    """Three folders of lines, as the pages' hosts come: padded, with blanks and a header; every line is written out first."""
    folder = f"{scratch_folder(s)}/lines-{uuid.uuid4().hex}"
    i = F.col("page_id")
    line = F.when(i % 11 == 0, "   ").when(i % 13 == 0, "domain,note").otherwise(F.concat(F.lit("  "), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit(" ,x"), i.cast("string")))
    pages = s.read.parquet(f"{d}/pages.parquet").select("page_id", line.alias("value"))
    paths = [f"{folder}/{part}" for part in ("b", "a", "c")]
    for n, path in enumerate(paths):
        pages.filter(i % 3 == n).coalesce(1).sortWithinPartitions("page_id").select("value").write.text(path)
    return records.read_domain_list(s, paths, cap=1_000_000, csv=True)


def _variant_leads(s, d):
    """The fast search, its candidates' URLs written in other ways than the stored ones."""
    i = F.col("page_id")
    host = F.regexp_replace("url", "^https?://", "HTTPS://")
    other = F.when(i % 4 == 0, host).when(i % 4 == 1, F.concat("url", F.when(F.contains("url", F.lit("?")), "#part").otherwise("/#part"))).when(
        i % 4 == 2, F.regexp_replace("url", "^http(s?)://([^/]+)/", "http$1://$2/up/.././")
    ).otherwise(F.col("url"))
    other = F.when(F.contains("url", F.lit("#")) | F.contains("url", F.lit("amazon")), F.col("url")).otherwise(other)
    found = leads.fast_leads(candidates(s, d).withColumn("url", other).drop("page_id"), base.lead_pages(s, d), intents(s))
    return base._flat(found).drop("url")


QUERIES = {
    "a5_redirect_ends": lambda s, d: redirect_ends(hop_pages(s, d)),
    "a5_site_audit_http": lambda s, d: _audited(s, d).select("domain", "url", "http_status", "final_url", "redirects", "redirects_in_circle"),
    "snk5_audit_wide_http": lambda s, d: sinks.audit_wide(_audited(s, d)),
    "src6_domain_list": _domain_list,
    "e1_url_variants": _variant_leads,
}

# --- oracle -----------------------------------------------------------------------------------------------------

def _key(url):
    bare = f"regexp_replace({url}, '#.*$', '')"
    path = f"regexp_extract({bare}, '^[A-Za-z]+://[^/?]*([^?]*)', 1)"
    query = f"regexp_extract({bare}, '[?](.*)$', 1)"
    return f"{domain_sql(url)} || CASE WHEN trim({path}, '/') = '' THEN '/' ELSE rtrim({path}, '/') END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


def _hops(pages):
    return f"""
hop0 AS (SELECT p.page_id, p.url, p.page_id % 10 = 7 AS gone, regexp_replace(f.url, '^https?:', 'HTTP:') || '#moved' AS final_url FROM ({pages}) p
  LEFT JOIN ({pages}) f ON f.page_id = CASE WHEN p.page_id % 50 = 49 THEN p.page_id - 1 WHEN p.page_id % 50 IN (47, 48) OR p.page_id % 10 BETWEEN 1 AND 6 THEN p.page_id + 1 END),
hop1 AS (SELECT *, {_key('url')} AS k, nullif({_key('final_url')}, {_key('url')}) AS nk, CASE WHEN final_url IS NOT NULL THEN 301 WHEN gone THEN 404 ELSE 200 END AS status FROM hop0),
hops AS MATERIALIZED (SELECT * FROM hop1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id) = 1),
walk AS (SELECT k, k AS at, url AS final_url, 0 AS n, [k] AS path, FALSE AS circle FROM hops
  UNION ALL SELECT w.k, h.nk, h.final_url, w.n + 1, list_append(w.path, h.nk), list_contains(w.path, h.nk) FROM walk w JOIN hops h ON h.k = w.at AND h.nk IS NOT NULL WHERE NOT w.circle),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1),
least AS (SELECT k, min(x) AS low FROM (SELECT k, unnest(list_slice(path, list_position(path, last.at), len(path))) AS x FROM last WHERE circle) GROUP BY k),
ends AS MATERIALIZED (SELECT l.k AS url_key, CASE WHEN l.circle THEN (SELECT min(h.final_url) FROM hops h WHERE h.nk = c.low) ELSE l.final_url END AS final_url,
  CASE WHEN NOT l.circle THEN e.status END AS http_status, CASE WHEN NOT l.circle THEN l.n END::BIGINT AS redirects, l.circle AS cyclic FROM last l LEFT JOIN least c ON c.k = l.k LEFT JOIN hops e ON e.k = l.at)
""".strip()


AUDIT_PAGES = f"SELECT m.page_id, {base._site_url} AS url FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS o FROM pages) m"
_ends = "SELECT a.domain, a.url, e.http_status, e.final_url, e.redirects, e.cyclic AS redirects_in_circle FROM audits a LEFT JOIN ends e ON e.url_key = " + _key("a.url")
ORACLE = {
    "a5_redirect_ends": "WITH RECURSIVE " + _hops(AUDIT_PAGES) + " SELECT * FROM ends",
    "src6_domain_list": """SELECT row_number() OVER (ORDER BY page_id % 3, page_id) AS place, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS domain FROM pages WHERE page_id % 11 <> 0 AND page_id % 13 <> 0 AND NOT contains(regexp_extract(url, '^[a-z]+://([^/]+)', 1), 'domain')""",
    "e1_url_variants": "SELECT * EXCLUDE (url) FROM (" + base.ORACLE["e1_fast_leads"] + ")",
    "a5_site_audit_http": with_pages(_ends, "metas", "links", ctes=base.AUDIT + ",\n" + _hops(AUDIT_PAGES)),
    "snk5_audit_wide_http": with_pages(
        """SELECT a.domain AS "Domain", a.url AS "URL", coalesce(CAST(e.http_status AS VARCHAR), '') AS "HTTP", CASE WHEN ssl_valid THEN 'Valid' ELSE 'Invalid' END AS "SSL", coalesce(email, '') AS "Email", coalesce(phone, '') AS "Phone",
        replace(technologies, ' | ', '; ') AS "Technologies", coalesce(language, '') AS "Language" FROM audits a LEFT JOIN ends e ON e.url_key = """ + _key("a.url"),
        "metas", "links", ctes=base.AUDIT + ",\n" + _hops(AUDIT_PAGES),
    ),
}
