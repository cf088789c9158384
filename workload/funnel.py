"""Registered queries and oracle SQL for the search funnel, JSON-LD facts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.functions.urls import host_of
from sitegrain.operators import funnel, jsonld, score
from sitegrain.operators import structure as st
from sitegrain.operators import tech as techs
from sitegrain.rules import funnel as rules
from sitegrain.rules import score as weights
from sitegrain.session import checkpointed
from workload.oracle_text import values, with_pages
from workload.seeded import by_page_id, domain_sql, pages_seeded, quote
from workload.structure import BODIES, LD, TITLE, joined
from workload.tech import DETECTIONS, detections, rlike

INTENT_SCHEMA = (
    "intent_id bigint, business_type string, product_category string, service_type string, niche string, must_have array<string>, "
    "must_not array<string>, validation_indicators array<string>, exclusion_indicators array<string>, "
    "location struct<country:string,region:string,city:string>, wanted_speed string, check_mobile boolean, max_results int"
)
INTENTS = [
    (0, "ecommerce", "serum", None, "cosmética", ["shopify"], ["crm"], ["add to cart", "The", "envío", "comprar"], ["foro"],
     ("España", "Madrid", "Madrid"), "fast", True, 7),
    (1, "saas", None, "dashboard", None, ["crm"], ["calendly"], ["pricing", "free trial", "de"], ["wiki", "ouier"],
     ("France", None, None), "lenta", False, 25),
    (2, "agencia", None, "seo", "b2b", [], ["ecommerce"], ["portfolio", "services", "en"], ["empleo"],
     (None, None, None), None, False, 3),
]


def intents(spark):
    return spark.createDataFrame(INTENTS, INTENT_SCHEMA)


def candidates(spark, d):
    """Search answers derived from the pages: three intents, five queries each, in page order."""
    pages = pages_seeded(spark, d)
    i = F.col("page_id")
    title = F.when(i % 12 == 1, F.concat(F.lit("Contacto y precio: "), F.col("title"))).otherwise(F.col("title"))
    lead = F.when(i % 12 == 5, "Tutorial: ").when(i % 12 == 9, "Comprar servicios, nuestra empresa ").otherwise("")
    url = F.when(i % 24 == 9, F.concat(F.lit("https://shop.amazon.es/"), i.cast("string"))).otherwise(F.col("url"))
    rows = st.page_context(pages).select("page_id", "url", "title", "body_text")
    return rows.select(
        (i % 3).alias("intent_id"),
        (i % 5).cast("int").alias("query_ord"),
        (F.floor(i / 15) + 1).cast("int").alias("position"),
        url.alias("url"),
        host_of(url).alias("domain"),
        title.alias("title"),
        F.concat(lead, F.left("body_text", F.lit(160))).alias("snippet"),
        "page_id",
    )


def scores(s, d, pages=None):
    """Scored candidates of the seeded pages (or of those given, the same ones laid out), one per intent and site."""
    kept = checkpointed(funnel.first_per_domain(candidates(s, d)))
    return score.score_candidates(kept, pages or pages_seeded(s, d), intents(s))


def _facts(s, d):
    return joined(jsonld.schema_facts(pages_seeded(s, d)), "types", "types_lower", "product_names", "service_types")


def _schema_score(s, d):
    pages = jsonld.with_schema_facts(pages_seeded(s, d)).filter("facts IS NOT NULL")
    kinds = ["ecommerce", "saas", "agency", "local", "blog", "other"]
    rows = pages.select("page_id", "facts", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("business_type"))
    return rows.select("page_id", "business_type", jsonld.schema_score(F.col("business_type")).alias("schema_score"))


def _coerced(s, d):
    i = F.col("page_id")
    cases = F.array(*[F.lit(x) for x in ("7", "abc", " 12 ", "0", "-3", "250", "20.5", "", "99999999999999999999", "+5")])
    text = F.get(cases, (i % 11).cast("int"))
    return pages_seeded(s, d).select("page_id", funnel.coerce_max_results(F.coalesce(text, F.lit("none"))).alias("max_results"))


def _best(s, d):
    rows = scores(s, d)
    return funnel.best_page(rows.select("domain", "page_id", "confidence", "url"), ["domain"])


def _stats(s, d):
    return funnel.run_stats(scores(s, d), techs.type_flags(detections(s, d)))


def phase_events(s, d):
    events = s.read.parquet(f"{d}/events.parquet")
    kind = F.col("event_type")
    phase = F.when(kind == "error", "phase1").when(kind == "click", "phase2").when(kind == "purchase", "done").otherwise("phase3")
    reason = F.when(phase == "done", "").otherwise(F.concat(F.lit("reason "), (F.col("event_id") % 4).cast("string")))
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), phase.alias("phase"), reason.alias("reason"))


def _supplement(s, d):
    main = funnel.first_per_domain(candidates(s, d).filter("query_ord = 0 AND position <= intent_id + 1"))
    extra = candidates(s, d).filter("query_ord > 0")
    return funnel.supplement(main, extra, intents(s)).select("intent_id", "domain", "source", "rank", "url")


QUERIES = {
    "j1_drop_blocked": lambda s, d: funnel.drop_blocked(candidates(s, d)),
    "j1_drop_blocked_table": lambda s, d: funnel.drop_blocked(
        candidates(s, d), s.createDataFrame([(h,) for h in rules.BLOCKED_HOSTS], "host string")
    ),
    "j2_drop_informational": lambda s, d: funnel.drop_informational(candidates(s, d), intents(s)),
    "j3_page_liveness": lambda s, d: funnel.page_liveness(pages_seeded(s, d)),
    "j7_qualify": lambda s, d: funnel.qualify(scores(s, d)).select("intent_id", "domain", "confidence"),
    "j7_qualify_valid": lambda s, d: funnel.qualify_valid(scores(s, d), 55).select("intent_id", "domain", "confidence"),
    "w1_first_per_domain": lambda s, d: funnel.first_per_domain(funnel.within_query_cap(candidates(s, d))),
    "w4_best_page": _best,
    "l1_top_sites": lambda s, d: funnel.top_sites(scores(s, d), 10).select("intent_id", "domain", "confidence"),
    "l1_top_sites_per_intent": lambda s, d: funnel.top_sites_per_intent(scores(s, d), intents(s)).select(
        "intent_id", "domain", "confidence", "rank"
    ),
    "l2_candidate_budget": lambda s, d: funnel.candidate_budget(candidates(s, d), intents(s)).select(
        "intent_id", "domain", "url", "arrival"
    ),
    "l2_coerce_max_results": _coerced,
    "l4_supplement": _supplement,
    "st8_jsonld_nodes": lambda s, d: joined(
        jsonld.jsonld_nodes(pages_seeded(s, d)).select("page_id", "block", "path", "depth", "types"), "types"
    ),
    "x1_snippet_score": lambda s, d: score.snippet_score(candidates(s, d), intents(s)).select(
        "intent_id", "page_id", "snippet_score"
    ),
    "x2_schema_facts": _facts,
    "x3_schema_score": _schema_score,
    "x4_type_scores": lambda s, d: score.type_scores(pages_seeded(s, d)).drop("info_penalty"),
    "x5_info_penalty": lambda s, d: score.type_scores(pages_seeded(s, d)).select("page_id", "info_penalty"),
    "x6_content_score": lambda s, d: joined(
        score.content_score(candidates(s, d), pages_seeded(s, d), intents(s)).drop("alive_reason"), "keywords"
    ),
    "x7_confidence": lambda s, d: joined(scores(s, d).drop("alive_reason"), "reasons", "rejections", "keywords"),
    "x6_content_score_by_id": lambda s, d: joined(
        score.content_score(candidates(s, d), by_page_id(s, pages_seeded(s, d)), intents(s)).drop("alive_reason"), "keywords"
    ),
    "x7_confidence_by_id": lambda s, d: joined(scores(s, d, by_page_id(s, pages_seeded(s, d))).drop("alive_reason"), "reasons", "rejections", "keywords"),
    "a1_run_stats": _stats,
    "a2_tech_frequency": lambda s, d: funnel.tech_frequency(scores(s, d), detections(s, d)),
    "a3_domains_only": lambda s, d: funnel.domains_only(scores(s, d)),
    "a4_rejection_funnel": lambda s, d: funnel.rejection_funnel(phase_events(s, d)),
}

# --- oracle -----------------------------------------------------------------------------------------------------


def sql_list(items):
    return "[" + ", ".join(quote(x) for x in items) + "]::VARCHAR[]"


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, list):
        return sql_list(v)
    if isinstance(v, tuple):
        return "{'country': " + f"{_cell(v[0])}, 'region': {_cell(v[1])}, 'city': {_cell(v[2])}" + "}"
    return str(v) if isinstance(v, int) else quote(v)


INTENTS_SQL = (
    "intents(intent_id, business_type, product_category, service_type, niche, must_have, must_not, good, bad, location, wanted_speed, check_mobile, "
    "max_results) AS (VALUES " + ", ".join("(" + ", ".join(_cell(v) for v in row) + ")" for row in INTENTS) + ")"
)
CANDIDATES = f"""
{BODIES},
{INTENTS_SQL},
candidate_urls AS (SELECT page_id, CASE WHEN page_id % 24 = 9 THEN 'https://shop.amazon.es/' || page_id ELSE url END AS url FROM pages_seeded),
candidates AS MATERIALIZED (SELECT m.page_id % 3 AS intent_id, CAST(m.page_id % 5 AS INTEGER) AS query_ord, CAST(m.page_id // 15 + 1 AS INTEGER) AS position, u.url,
  {domain_sql('u.url')} AS domain, CASE WHEN m.page_id % 12 = 1 THEN 'Contacto y precio: ' ELSE '' END || left({TITLE}, 300) AS title,
  CASE m.page_id % 12 WHEN 5 THEN 'Tutorial: ' WHEN 9 THEN 'Comprar servicios, nuestra empresa ' ELSE '' END || left(b.body, 160) AS snippet, m.page_id
  FROM markup m JOIN bodies b ON b.page_id = m.page_id JOIN candidate_urls u ON u.page_id = m.page_id)
""".strip()
FIRSTS = """
firsts AS MATERIALIZED (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY intent_id, domain ORDER BY query_ord, position, url) AS rn FROM candidates) WHERE rn = 1)
""".strip()
BLOCKED = values("blocked", ["host"], [(h,) for h in rules.BLOCKED_HOSTS])
_info_hit = " OR ".join(f"contains(text, {quote(w)})" for w in rules.INFORMATIONAL_WORDS)


def count_sql(text, patterns):
    return " + ".join(f"{rlike(text, p)}::INT" for p in patterns)


def clamp(x):
    return f"greatest(0, least(100, {x}))"


SNIPPETS = f"""
snippet_scores AS MATERIALIZED (SELECT intent_id, page_id, CAST({clamp(
    "50 + 10 * len(list_filter(good, lambda w: contains(text, lower(w)))) - 15 * len(list_filter(bad, lambda w: contains(text, lower(w)))) - 20 * ("
    + count_sql('text', weights.SNIPPET_INFORMATIONAL[1]) + ") + 5 * (" + count_sql('text', weights.SNIPPET_BUSINESS[1]) + ")"
)} AS INTEGER) AS snippet_score FROM (SELECT c.*, i.good, i.bad, lower(coalesce(title, '') || ' ' || coalesce(snippet, '')) AS text
  FROM candidates c JOIN intents i ON i.intent_id = c.intent_id))
""".strip()


def _points(low, kind):
    weight, words = weights.TYPE_WORDS[kind]
    hits = " + ".join(f"contains({low}, {quote(w)})::INT" for w in words)
    extra = "".join(f" + {w} * {rlike(low, p)}::INT" for p, w in weights.TYPE_PATTERNS[kind])
    return f"({weight} * ({hits}){extra})"


_penalty = "least(40, " + " + ".join(f"{w} * {rlike('low', p)}::INT" for p, w in weights.INFO_PENALTIES) + ")"
POINTS = f"""
points AS MATERIALIZED (SELECT page_id, low, CAST({_points('low', 'ecommerce')} AS INTEGER) AS ecommerce, CAST({_points('low', 'saas')} AS INTEGER) AS saas,
  CAST({_points('low', 'agencia')} AS INTEGER) AS agencia, CAST({_points('low', 'other')} AS INTEGER) AS other, CAST({_penalty} AS INTEGER) AS info_penalty
  FROM (SELECT page_id, lower(html) AS low FROM pages_seeded))
""".strip()


def _in(kind, names):
    return f"{kind} IN ({', '.join(quote(n) for n in names)})"


_name = "coalesce(json_extract_string(value, '$.name'), '')"
_price = "coalesce(nullif(json_extract_string(value, '$.offers.price'), ''), nullif(json_extract_string(value, '$.offers.lowPrice'), ''))"
_cur = "coalesce(json_extract_string(value, '$.offers.priceCurrency'), '')"
FACTS = rf"""
ld_reach AS (SELECT page_id, block, id, parent, fullkey, value, type, key FROM ld_tree WHERE type = 'OBJECT'
  AND regexp_matches(fullkey, '^\$(\[\d+\])?(\."@graph"\[\d+\]|\.@graph\[\d+\]|\.mainEntity(\[\d+\])?)*$')),
ld_kinds AS (
  SELECT n.*, 0 AS t, trim(json_extract_string(value, '$."@type"')) AS label FROM ld_reach n WHERE json_type(value, '$."@type"') = 'VARCHAR'
  UNION ALL SELECT n.*, unnest(range(json_array_length(value, '$."@type"')::INT)), trim(unnest(json_extract_string(value, '$."@type"[*]'))) FROM ld_reach n
    WHERE json_type(value, '$."@type"') = 'ARRAY'
  UNION ALL SELECT n.*, 0, '' FROM ld_reach n WHERE json_type(value, '$."@type"') IS NULL AND json_type(value, '$.aggregateRating') IS NOT NULL),
fact_rows AS (SELECT page_id, block * 1000000 + id * 10 + t AS o, label, lower(label) AS kind, value,
  {_in('lower(label)', weights.LD_PRODUCT)} AS product, {_in('lower(label)', weights.LD_SERVICE)} AS service,
  {_in('lower(label)', weights.LD_LOCAL)} AS loc, {_in('lower(label)', weights.LD_LOCAL_SERVICE)} AS loc_service,
  json_type(value, '$.aggregateRating') IS NOT NULL AS rated FROM ld_kinds),
facts AS MATERIALIZED (SELECT page_id,
  list_filter(list(label ORDER BY o), lambda x: x <> '') AS type_list,
  bool_or(product) AS has_products, CAST(count(*) FILTER (product) AS INTEGER) AS product_count,
  coalesce(list({_name} ORDER BY o) FILTER (product AND {_name} <> ''), []) AS product_list,
  bool_or((product AND (json_type(value, '$.offers') IS NULL OR json_type(value, '$.offers') = 'OBJECT' OR (json_type(value, '$.offers') = 'ARRAY'
    AND json_array_length(value, '$.offers') > 0))) OR kind = 'offer') AS has_offers,
  arg_max(CASE WHEN kind = 'offer' THEN nullif(json_extract_string(value, '$.price'), '') ELSE trim({_price} || ' ' || {_cur}) END,
    CASE WHEN (product AND {_price} IS NOT NULL) OR (kind = 'offer' AND coalesce(json_extract_string(value, '$.price'), '') <> '') THEN o END) AS price_range,
  arg_max({_cur}, CASE WHEN product AND {_price} IS NOT NULL THEN o END) AS currency,
  arg_max({_name}, CASE WHEN {_in('kind', weights.LD_ORGANIZATION + weights.LD_LOCAL_SERVICE + weights.LD_SOFTWARE)} THEN o END) AS organization_name,
  arg_max(label, CASE WHEN loc OR loc_service THEN o END) AS business_type,
  arg_max(coalesce(json_extract_string(value, '$.address.streetAddress'), ''), CASE WHEN loc THEN o END) AS address,
  bool_or(loc OR loc_service) AS is_local_business, bool_or(service) AS has_services, bool_or(service OR loc_service) AS is_service_business,
  coalesce(list({_name} ORDER BY o) FILTER (service AND {_name} <> ''), []) AS service_list,
  bool_or({_in('kind', weights.LD_SOFTWARE)}) AS is_software, bool_or({_in('kind', weights.LD_BLOG)}) AS is_blog,
  bool_or({_in('kind', weights.LD_REVIEW)} OR rated) AS has_reviews,
  arg_max(try_cast(coalesce(json_extract_string(value, '$.aggregateRating.ratingValue'), json_extract_string(value, '$.ratingValue')) AS DOUBLE),
    CASE WHEN json_type(value, '$.aggregateRating.ratingValue') IS NOT NULL OR kind = 'aggregaterating' THEN o END) AS aggregate_rating,
  bool_or(product OR {_in('kind', weights.LD_STORE)}) OR bool_or(kind = 'offer') AS is_ecommerce
  FROM fact_rows GROUP BY page_id HAVING len(list_filter(list(label), lambda x: x <> '')) > 0)
""".strip()


def dedup(column):
    """Distinct items of a list in order of first appearance."""
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


_ld_cond = {
    "array_contains({f}.types_lower, 'softwareapplication')": "list_contains(list_transform(type_list, lambda x: lower(x)), 'softwareapplication')",
    "array_contains({f}.types_lower, 'organization')": "list_contains(list_transform(type_list, lambda x: lower(x)), 'organization')",
}


def _ld_points(rows):
    return " + ".join(f"CASE WHEN {_ld_cond.get(c, c.replace('{f}.', ''))} THEN {p} ELSE 0 END" for c, p in rows)


def schema_score_sql(kind):
    whens = " ".join(f"WHEN {_in(f'lower({kind})', kinds)} THEN {_ld_points(rows)}" for kinds, rows in weights.LD_WEIGHTS)
    return f"(CASE {whens} ELSE 0 END + {_ld_points(weights.LD_WEIGHTS_ALL)})"


_on = lambda col: f"coalesce({col} <> '' AND contains(p.low, lower({col})), FALSE)"
_named = lambda names, col: f"coalesce({col} <> '' AND len(list_filter(f.{names}, lambda n: contains(lower(n), lower({col})))) > 0, FALSE)"
CONTENT = f"""
first_meta AS (SELECT page_id, arg_min(content, n) FILTER (key = 'keywords' AND content <> '') AS kw, arg_min(content, n) FILTER (key = 'og:type' AND content <> '') AS og
  FROM metas GROUP BY page_id),
kw_items AS (SELECT page_id, trim(unnest(string_split(kw, ','))) AS w, generate_subscripts(string_split(kw, ','), 1) AS k FROM first_meta WHERE kw IS NOT NULL),
kw_top AS (SELECT page_id, list(w ORDER BY k) AS ws FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS rn FROM kw_items WHERE w <> '') GROUP BY page_id),
contents AS MATERIALIZED (SELECT c.intent_id, c.page_id, c.url,
  CAST({clamp(f'''50 + coalesce({schema_score_sql('coalesce(i.business_type, chr(32))')}, 0)
    + CASE i.business_type WHEN 'ecommerce' THEN p.ecommerce WHEN 'saas' THEN p.saas WHEN 'agencia' THEN p.agencia ELSE p.other END
    + CASE WHEN (i.business_type = 'ecommerce' AND f.is_ecommerce) OR (i.business_type = 'saas' AND f.is_software) OR (i.business_type = 'agencia' AND f.is_service_business) THEN 15 ELSE 0 END
    + 15 * {_on('i.product_category')}::INT + 10 * {_named('product_list', 'i.product_category')}::INT + 15 * {_on('i.service_type')}::INT
    + 10 * {_named('service_list', 'i.service_type')}::INT + 10 * {_on('i.niche')}::INT - p.info_penalty
    - 20 * coalesce(f.is_blog AND i.business_type <> 'blog', FALSE)::INT''')} AS INTEGER) AS content_score,
  array_to_string(list_concat(coalesce(k.ws, []), CASE WHEN m.og IS NOT NULL THEN ['og:' || m.og] ELSE [] END,
    coalesce(list_transform(list_slice({dedup('f.type_list')}, 1, 3), lambda t: 'schema:' || t), []),
    CASE WHEN {_on('i.product_category')} THEN [i.product_category] ELSE [] END, CASE WHEN {_on('i.service_type')} THEN [i.service_type] ELSE [] END,
    CASE WHEN {_on('i.niche')} THEN [i.niche] ELSE [] END, list_filter(list_slice(i.good, 1, 10), lambda w: contains(p.low, lower(w)))), ' | ') AS keywords,
  coalesce(f.is_ecommerce, FALSE) AS is_ecommerce, coalesce(f.is_software, FALSE) AS is_software, coalesce(f.is_service_business, FALSE) AS is_service_business,
  coalesce(f.is_blog, FALSE) AS is_blog
  FROM candidates c JOIN intents i ON i.intent_id = c.intent_id JOIN points p ON p.page_id = c.page_id LEFT JOIN facts f ON f.page_id = c.page_id
  LEFT JOIN first_meta m ON m.page_id = c.page_id LEFT JOIN kw_top k ON k.page_id = c.page_id)
""".strip()
SCORES = f"""
{CANDIDATES},
{FIRSTS},
{SNIPPETS},
{LD},
{FACTS},
{POINTS},
{CONTENT},
scores AS MATERIALIZED (SELECT *, CAST(least(round(0.3 * snippet_score + 0.4 * content_score + 15, 6), 100) AS DOUBLE) AS confidence, round(0.3 * snippet_score + 0.4 * content_score + 15, 6) >= 50 AS is_valid,
  array_to_string(list_filter([CASE WHEN snippet_score > 50 THEN 'Snippet relevante (score: ' || snippet_score || ')' END,
    CASE WHEN content_score > 50 THEN 'Contenido relevante (score: ' || content_score || ')' END,
    CASE WHEN is_ecommerce AND business_type = 'ecommerce' THEN 'Schema.org confirma ecommerce' WHEN is_software AND business_type IN ('saas', 'software') THEN 'Schema.org confirma software'
      WHEN is_service_business AND business_type IN ('agencia', 'agency') THEN 'Schema.org confirma servicios' END], lambda x: x IS NOT NULL), ' | ') AS reasons,
  array_to_string(list_filter([CASE WHEN snippet_score <= 50 THEN 'Snippet poco relevante (score: ' || snippet_score || ')' END,
    CASE WHEN content_score <= 50 THEN 'Contenido poco relevante (score: ' || content_score || ')' END], lambda x: x IS NOT NULL), ' | ') AS rejections
  FROM (SELECT c.intent_id, c.domain, c.page_id, c.url, c.title, s.snippet_score, x.content_score, x.keywords, x.is_ecommerce, x.is_software, x.is_service_business, i.business_type
    FROM firsts c JOIN snippet_scores s ON s.intent_id = c.intent_id AND s.page_id = c.page_id JOIN contents x ON x.intent_id = c.intent_id AND x.page_id = c.page_id
    JOIN intents i ON i.intent_id = c.intent_id))
""".strip()
_size = "length(html)"
_parked = " OR ".join(rlike("html", p) for p in rules.PARKED)
_broken = " OR ".join(rlike("html", p) for p in rules.BROKEN)
_plain = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
LIVENESS = rf"""
liveness AS MATERIALIZED (SELECT page_id, url, CASE WHEN {_size} < 1024 THEN 'empty_or_tiny_html (' || {_size} || 'B)' WHEN {_parked} THEN 'parking_or_placeholder'
  WHEN {_size} < 4000 AND ({_broken}) THEN 'broken_or_placeholder'
  WHEN NOT regexp_matches(html, '(?i)<title[^>]*>\s*\S') AND NOT regexp_matches(html, '(?i)<h1[^>]*>') AND length({_plain}) <= 200 THEN 'no_meaningful_body'
  ELSE 'ok' END AS reason FROM pages_seeded)
""".strip()
_cand_cols = "intent_id, query_ord, position, url, domain, title, snippet, page_id"
_phase = "CASE event_type WHEN 'error' THEN 'phase1' WHEN 'click' THEN 'phase2' WHEN 'purchase' THEN 'done' ELSE 'phase3' END"


def with_scores(body, extra=""):
    return with_pages(body, "metas", ctes=SCORES + (",\n" + extra if extra else ""))


_coerce_case = """CASE page_id % 11 WHEN 0 THEN 7 WHEN 1 THEN 20 WHEN 2 THEN 12 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 100 WHEN 6 THEN 20 WHEN 7 THEN 20
 WHEN 8 THEN 100 WHEN 9 THEN 5 ELSE 20 END"""
_type_case = " ".join(f"('{k}')," for k in ["ecommerce", "saas", "agency", "local", "blog"]) + " ('other')"

ORACLE = {
    "j1_drop_blocked": with_pages(
        f"SELECT {_cand_cols} FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE c.domain = b.host OR suffix(c.domain, '.' || b.host))",
        "markup", ctes=CANDIDATES + ",\n" + BLOCKED,
    ),
    "j2_drop_informational": with_pages(
        f"SELECT {', '.join('c.' + x.strip() for x in _cand_cols.split(','))} FROM (SELECT *, lower(title || ' ' || snippet) AS text FROM candidates) c JOIN intents i ON i.intent_id = c.intent_id "
        f"WHERE NOT ({_info_hit}) AND len(list_filter(i.bad, lambda w: contains(text, lower(w)))) = 0",
        "markup", ctes=CANDIDATES,
    ),
    "j3_page_liveness": with_pages("SELECT page_id, url, reason = 'ok' AS alive, reason FROM liveness", ctes=LIVENESS),
    "j7_qualify": with_scores("SELECT intent_id, domain, confidence FROM scores WHERE confidence >= 60"),
    "j7_qualify_valid": with_scores("SELECT intent_id, domain, confidence FROM scores WHERE is_valid AND confidence >= 55"),
    "w1_first_per_domain": with_pages(
        f"SELECT {_cand_cols} FROM (SELECT *, row_number() OVER (PARTITION BY intent_id, domain ORDER BY query_ord, position, url) AS rn FROM candidates WHERE position <= 20) WHERE rn = 1",
        "markup", ctes=CANDIDATES,
    ),
    "w4_best_page": with_scores(
        "SELECT domain, page_id, confidence, url FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, page_id) AS rn FROM scores) WHERE rn = 1"
    ),
    "l1_top_sites": with_scores("SELECT intent_id, domain, confidence FROM scores ORDER BY confidence DESC, domain, intent_id LIMIT 10"),
    "l1_top_sites_per_intent": with_scores(
        "SELECT intent_id, domain, confidence, CAST(rank AS INTEGER) AS rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.intent_id ORDER BY confidence DESC, domain) AS rank, "
        "i.max_results FROM scores s JOIN intents i ON i.intent_id = s.intent_id) WHERE rank <= max_results"
    ),
    "l2_candidate_budget": with_pages(
        "SELECT intent_id, domain, url, CAST(arrival AS INTEGER) AS arrival FROM (SELECT f.*, row_number() OVER (PARTITION BY f.intent_id ORDER BY query_ord, position, url) AS arrival, "
        "greatest(6 * i.max_results, 60) AS budget FROM firsts f JOIN intents i ON i.intent_id = f.intent_id) WHERE arrival <= budget",
        "markup", ctes=CANDIDATES + ",\n" + FIRSTS,
    ),
    "l2_coerce_max_results": f"SELECT page_id, CAST({_coerce_case} AS INTEGER) AS max_results FROM pages",
    "l4_supplement": with_pages(
        """SELECT intent_id, domain, source, CAST(rank AS INTEGER) AS rank, url FROM (SELECT b.*, i.max_results, row_number() OVER (PARTITION BY b.intent_id
        ORDER BY source DESC, query_ord, position, url) AS rank FROM both_sets b JOIN intents i ON i.intent_id = b.intent_id) WHERE rank <= max_results""",
        "markup",
        ctes=CANDIDATES + """,
main_set AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY intent_id, domain ORDER BY query_ord, position, url) AS rn FROM candidates
  WHERE query_ord = 0 AND position <= intent_id + 1) WHERE rn = 1),
extra_set AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY intent_id, domain ORDER BY query_ord, position, url) AS rn FROM candidates
  WHERE query_ord > 0) WHERE rn = 1),
both_sets AS (SELECT *, 'main' AS source FROM main_set UNION ALL SELECT e.*, 'extra' FROM extra_set e WHERE (SELECT count(*) FROM main_set m WHERE m.intent_id = e.intent_id)
  < (SELECT max_results // 2 FROM intents i WHERE i.intent_id = e.intent_id) AND NOT EXISTS (SELECT 1 FROM main_set m WHERE m.intent_id = e.intent_id AND m.domain = e.domain))""",
    ),
    "st8_jsonld_nodes": with_pages(
        r"""SELECT page_id, CAST(block - 1 AS INTEGER) AS block, replace(fullkey, '"', '') AS path, CAST(len(regexp_extract_all(replace(fullkey, '"', ''), '\.|\[')) AS INTEGER) AS depth,
        CASE json_type(value, '$."@type"') WHEN 'VARCHAR' THEN json_extract_string(value, '$."@type"')
          WHEN 'ARRAY' THEN array_to_string(json_extract_string(value, '$."@type"[*]'), ' | ') ELSE '' END AS types FROM ld_tree WHERE type = 'OBJECT'""",
        ctes=LD,
    ),
    "x1_snippet_score": with_pages("SELECT * FROM snippet_scores", "markup", ctes=CANDIDATES + ",\n" + SNIPPETS),
    "x2_schema_facts": with_pages(
        f"""SELECT page_id, array_to_string({dedup('type_list')}, ' | ') AS types, lower(array_to_string({dedup('type_list')}, ' | ')) AS types_lower, has_products, product_count,
        array_to_string({dedup('product_list')}, ' | ') AS product_names, has_offers, price_range, currency, organization_name, business_type, address, is_local_business, has_services,
        is_service_business, array_to_string({dedup('service_list')}, ' | ') AS service_types, is_software, is_blog, has_reviews, aggregate_rating, is_ecommerce FROM facts""",
        ctes=LD + ",\n" + FACTS,
    ),
    "x3_schema_score": with_pages(
        f"SELECT page_id, k AS business_type, CAST({schema_score_sql('k')} AS INTEGER) AS schema_score FROM facts, (VALUES {_type_case}) AS v(k)",
        ctes=LD + ",\n" + FACTS,
    ),
    "x4_type_scores": with_pages("SELECT page_id, ecommerce, saas, agencia, other FROM points", ctes=POINTS),
    "x5_info_penalty": with_pages("SELECT page_id, info_penalty FROM points", ctes=POINTS),
    "x6_content_score": with_scores("SELECT * FROM contents"),
    "x7_confidence": with_scores(
        "SELECT intent_id, domain, page_id, url, title, snippet_score, content_score, confidence, is_valid, reasons, rejections, keywords FROM scores"
    ),
    "a1_run_stats": with_scores(
        """SELECT count(*) AS total_analyzed, count(*) FILTER (is_valid) AS valid_count, count(*) FILTER (NOT is_valid) AS invalid_count,
        coalesce(count(*) FILTER (is_valid) * 100.0 / count(*), 0)::DOUBLE AS validation_rate, coalesce(avg(confidence) FILTER (is_valid), 0) AS average_confidence,
        count(*) FILTER (is_valid AND ecom) AS ecommerce_count, count(*) FILTER (is_valid AND saas) AS saas_count, count(*) FILTER (is_valid AND cms) AS cms_count
        FROM scores LEFT JOIN kinds USING (domain)""",
        DETECTIONS + ",\nkinds AS (SELECT domain, {0} OR {1} AS ecom, {2} AS saas, {3} AS cms FROM detections GROUP BY domain)".format(
            *["bool_or(" + " OR ".join(f"contains(lower(tech), {quote(n)})" for n in techs.rules.TYPE_NAMES[k]) + ")" for k in ("ecommerce", "payment", "saas", "cms")]
        ),
    ),
    "a2_tech_frequency": with_scores(
        "SELECT tech, count(DISTINCT domain) AS sites FROM detections WHERE category IN ('cms', 'ecommerce', 'frameworks', 'analytics') AND domain IN (SELECT domain FROM scores) GROUP BY tech",
        DETECTIONS,
    ),
    "a3_domains_only": with_scores("SELECT DISTINCT domain FROM scores WHERE is_valid"),
    "a4_rejection_funnel": f"""SELECT phase, reason, CAST(grouping(phase, reason) AS BIGINT) AS level, count(*) AS sites, count(*) FILTER (phase = 'done') AS passed,
        count(*) FILTER (phase = 'done') / count(*) AS pass_rate FROM (SELECT {_phase} AS phase, CASE WHEN {_phase} = 'done' THEN '' ELSE 'reason ' || event_id % 4 END AS reason FROM events)
        GROUP BY ROLLUP (phase, reason)""",
}
ORACLE["j1_drop_blocked_table"] = ORACLE["j1_drop_blocked"]

ORACLE |= {f"{name}_by_id": ORACLE[name] for name in ("x6_content_score", "x7_confidence")}
