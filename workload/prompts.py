"""Registered queries and oracle SQL for prompts: the conversations' texts, each followed by a request."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.operators import prompts, tech, verdicts
from sitegrain.operators import structure as st
from sitegrain.rules import prompts as rules
from sitegrain.sources.pages import spread, with_skeleton
from workload.funnel import INTENTS_SQL, intents, sql_list
from workload.oracle_text import values, with_pages
from workload.seeded import pages_seeded, quote
from workload.structure import CONTEXT, INLINE, _sheet
from workload.tech import DETECTIONS, HITS

REQUESTS = [
    "tienda online de cosmética ecológica en madrid sin shopify",
    "Software para clínicas que tenga hubspot, que no tenga chat",
    "agencia de diseño web en Barcelona con mailchimp",
    "The best shop for vintage fashion and shoes with Stripe",
    "marketplace de coches de lujo en méxico",
    "blog de viajes para familias con buen seo",
    "plataforma de reservas sin crm y sin email marketing",
    "empresa de reformas", "landing page lenta para startup",
    "directorio de abogados en Sevilla con wordpress 2025",
    "herramienta de facturación para pymes que use stripe con google analytics",
    "quiero zapatos hechos a mano online",
]


def prompt_table(s, d):
    """prompts(prompt_id, text)."""
    request = F.get(F.array(*[F.lit(r) for r in REQUESTS]), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(REQUESTS))).cast("int"))
    rows = spread(s.read.parquet(f"{d}/conversations.parquet"))
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.concat(F.col("text"), F.lit(". "), request).alias("text")
    )


def requests(s, d):
    """Intents made of the prompts: term, type, niche and places chosen by the prompt's number."""
    i = F.col("prompt_id")
    kinds, terms = ["ecommerce", "software", "agency", "blog", "tienda"], ["zapatos", "CRM médico", "diseño web", "viajes"]
    niches = [None, "eco natural", "premium y retro", "raro"]
    rows = prompt_table(s, d)
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(i, F.lit(len(xs))).cast("int"))
    return rows.select(
        i.alias("intent_id"), pick(kinds).alias("business_type"), pick(terms).alias("term"), pick(niches).alias("niche"),
        F.slice(F.array(*[F.lit(p) for p in ("madrid", "lima", "cdmx", "london", "usa")]), 1, (i % 6).cast("int")).alias("places"),
    )


def query_table(s, d):
    """queries(intent_id, ord, query): what the prompts ask, in odd shapes, for the three intents."""
    i = F.col("prompt_id")
    text = F.lower(F.get(F.split("text", r"\. "), F.size(F.split("text", r"\. ")) - 1))
    shaped = (
        F.when(i % 7 == 0, F.concat(F.lit('"'), text, F.lit('"')))
        .when(i % 7 == 1, F.concat(F.lit("intitle:"), text, F.lit(" -crm")))
        .when(i % 7 == 2, F.concat(F.lit('"'), text, F.lit('" precio -"artículo"')))
        .when(i % 7 == 3, F.concat(F.lit("Ejemplo: "), text))
        .when(i % 7 == 4, F.concat_ws(" ", F.reverse(F.split(text, " "))))
        .when(i % 7 == 5, F.lit(" `de` "))
        .otherwise(F.concat(F.lit("buscar "), i.cast("string"), F.lit(" "), text))
    )
    return prompt_table(s, d).select((i % 3).alias("intent_id"), i.alias("ord"), shaped.alias("query"))


def _lists(df, *names):
    for n in names:
        df = df.withColumn(n, F.array_join(n, " | "))
    return df


def _profile(s, d):
    rows = prompts.extract_profile(prompt_table(s, d))
    return rows.select(
        "prompt_id", F.col("audience.label").alias("audience"), F.col("audience.confidence").alias("audience_confidence"),
        F.col("scale.label").alias("scale"), F.array_join(F.transform("quality", lambda q: q["label"]), " | ").alias("quality"), "city", "country",
    )


def _indicators(s, d):
    i = F.col("intent_id")
    rows = requests(s, d).select(
        "intent_id", "business_type", F.when(i % 4 == 1, "eco").when(i % 4 == 2, "luxury").alias("niche"), F.when(i % 3 == 0, "madrid").alias("place"),
        F.array("term").alias("main_keywords"), F.when(i % 2 == 0, "moda").alias("industry"),
    )
    return _lists(prompts.indicator_lists(rows), "validation_indicators", "exclusion_indicators")


def _placed(s, d):
    """Locations of the prompts' intents; every fifth has none."""
    i = F.col("intent_id")
    location = F.struct(
        F.when(i % 5 > 0, "España").alias("country"), F.lit(None).cast("string").alias("region"), F.when(i % 5 > 2, "Madrid").alias("city")
    )
    return requests(s, d).select("intent_id", location.alias("location"))


def _deduped_words(s, d):
    words = F.split("text", " ")
    rows = prompt_table(s, d).select("prompt_id", prompts.dedupe_keep_order(words).alias("words"))
    return _lists(rows, "words")


MODEL = [
    '```json\n{"business_type":"ecommerce","must_have":["shopify"],"confidence":0.8,"search_queries":["a","b {i}"]}\n```',
    'Sure: {"business_type":"saas","niche":"eco","target_techs":["hubspot"],"must_have":["x"],"must_not":"no list"} done',
    'no json here {i}', '{"broken": ', '{"service_type":"seo {i}"}',
    '{"business_type":"SaaS","location":{"country":"España","city":"Lugo {i}"},"target_audience":"B2B","language":"en","confidence":"high","analysis_notes":"short"}',
    '{"location":"Madrid","niche":"","product_category":null,"prompt_depurado":"prompt {i}","analysis_notes":"kept","validation_indicators":["precio","{i}"],"exclusion_indicators":["wikipedia"]}',
    '{"prompt_depurado":"only {i}","business_type":"","location":{"region":"Galicia"},"confidence":0.25}',
]


def model_rows(s, d):
    text = F.get(F.array(*[F.lit(t) for t in MODEL]), F.pmod(F.col("prompt_id"), F.lit(len(MODEL))).cast("int"))
    return prompt_table(s, d).select(F.col("prompt_id").alias("id"), F.replace(text, F.lit("{i}"), F.col("prompt_id").cast("string")).alias("text"))


def _parsed(s, d):
    rows = _lists(prompts.parse_intent_rows(model_rows(s, d)), "search_queries", "must_have", "must_not", "target_techs", "validation_indicators", "exclusion_indicators")
    return rows.select("*", "location.country", "location.region", "location.city").drop("location")


def prompt_intents(s, d):
    """Whole intents, read from the prompts; every third names keywords, too."""
    rows = prompts.read_prompts(prompt_table(s, d)).withColumnRenamed("prompt_id", "intent_id")
    words = F.slice(F.split(F.lower("text"), " "), 1, 3)
    return rows.withColumn("main_keywords", F.when(F.col("intent_id") % 3 == 0, words))


def _plainly(s, d):
    return prompts.read_plainly(prompt_table(s, d))


def _split(s, d):
    rows = _plainly(s, d).select(
        "prompt_id", "must_have", "must_not", "tools_needed", "tools_refused", F.col("have.technologies").alias("have_technologies"),
        F.col("have.categories").alias("have_categories"), F.col("not.technologies").alias("not_technologies"), F.col("not.categories").alias("not_categories"),
    )
    return _lists(rows, *rows.columns[1:])


def _cleaned(s, d):
    i = F.col("prompt_id")
    text = (
        F.when(i % 4 == 0, F.concat(F.lit("Prompt: "), F.col("text"))).when(i % 4 == 1, F.concat(F.lit('"'), F.col("text"), F.lit('"')))
        .when(i % 4 == 2, F.concat(F.lit(" → "), F.col("text"))).otherwise(F.col("text"))
    )
    return prompt_table(s, d).select("prompt_id", prompts.clean_prompt(text).alias("prompt"))


def _sheets(s, d):
    pages = pages_seeded(s, d)
    staged = tech.with_evidence(tech.with_technologies(st.with_assets(with_skeleton(pages))))
    read = staged.select(
        "page_id", "domain",
        tech.confirm_targets(F.array(F.lit("shopify"), F.lit("calendly")), F.col("known"), F.col("evidence")).alias("targets"),
        F.transform("known", lambda k: k["tech"]).alias("known"),
        F.array_sort(F.array_distinct(F.transform("assets", lambda a: a["host"]))).alias("hosts"),
    )
    marks = st.context_markdown(st.page_context(pages)).select("page_id", "markdown")
    rows = read.join(marks, "page_id").withColumns(
        {
            "intent_id": F.col("page_id"), "prompt": F.concat(F.lit(" quiero "), F.col("domain")),
            "socials": F.array(F.struct(F.lit("x").alias("platform"), F.col("domain").alias("url"))),
            "scores": F.when(F.col("page_id") % 2 == 0, F.array(F.struct(F.lit("seo").alias("name"), F.col("page_id").cast("string").alias("value")))),
        }
    )
    return verdicts.judge_sheet(rows)


QUERIES = {
    "q1_q5_read_prompts": lambda s, d: _lists(prompts.read_prompts(prompt_table(s, d)).drop("text"), "modifiers", "must_have", "must_not"),
    "q1_q3_plain_forms": lambda s, d: _lists(_plainly(s, d).select("prompt_id", "type", "type_confidence", "short_type", "services", "niches"), "services", "niches"),
    "q5_requirement_forms": _split,
    "q6_extract_profile": _profile,
    "q7_generate_queries": lambda s, d: prompts.generate_queries(requests(s, d)),
    "q7_intent_queries": lambda s, d: prompts.intent_queries(prompt_intents(s, d)),
    "q7_exclusion_queries": lambda s, d: prompts.exclusion_queries(query_table(s, d)),
    "q7_transactional_queries": lambda s, d: prompts.transactional_queries(requests(s, d)),
    "q7_competitor_queries": lambda s, d: prompts.competitor_queries(requests(s, d).select(F.col("intent_id").alias("id"), F.col("term").alias("name"))),
    "q8_geo_queries": lambda s, d: prompts.geo_queries(prompts.generate_queries(requests(s, d)), _placed(s, d)),
    "q9_indicator_lists": _indicators,
    "q10_parse_intent_rows": _parsed,
    "q11_judge_sheet": _sheets,
    "q12_buyer_prompt": lambda s, d: prompts.buyer_prompt(prompt_table(s, d).withColumnRenamed("prompt_id", "id")),
    "q12_clean_prompt": _cleaned,
    "w2_dedupe_queries": lambda s, d: prompts.dedupe_queries(query_table(s, d)),
    "w3_dedupe_keep_order": _deduped_words,
    "l3_post_process_queries": lambda s, d: prompts.post_process_queries(query_table(s, d), intents(s)),
}

# --- oracle -----------------------------------------------------------------------------------------------------

_requests = "[" + ", ".join(quote(r) for r in REQUESTS) + "]"
PROMPTS = f"prompts AS MATERIALIZED (SELECT conv_id * 1000 + turn AS prompt_id, text || '. ' || {_requests}[((conv_id + turn) % {len(REQUESTS)})::INT + 1] AS text FROM conversations)"


def _label(table, text="low"):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + f" THEN {quote(label)}" for label, words in table) + " END"


_strong = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, {quote(w)})" for w in st_) + f" THEN {quote(lb)}" for lb, _, _, st_ in rules.BUSINESS_TYPES) + " END"
_strong_c = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, {quote(w)})" for w in st_) + f" THEN {c}" for _, c, _, st_ in rules.BUSINESS_TYPES) + " END"
_by_conf = sorted(enumerate(rules.BUSINESS_TYPES), key=lambda x: (-x[1][1], x[0]))
_word = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, {quote(w)})" for w in ws) + f" THEN {quote(lb)}" for _, (lb, _, ws, _) in _by_conf) + " ELSE 'web' END"
_word_c = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, {quote(w)})" for w in ws) + f" THEN {round(c * 0.85, 4)}" for _, (_, c, ws, _) in _by_conf) + " ELSE 0.3 END"
_phr = [f"trim(regexp_replace(regexp_extract(low, {quote('(?i)' + p)}, 1), '\\s+', ' ', 'g'))" for p in rules.PHRASES]
_phrase = "coalesce(" + ", ".join(f"CASE WHEN length({p}) BETWEEN 3 AND 49 THEN {p} END" for p in _phr) + ")"
_votes = lambda ws: " + ".join(f"contains(' ' || low || ' ', ' {w} ')::INT" for w in ws)
_tool = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(n, {quote(w)}) OR contains({quote(w)}, n)" for w in ws) + f" THEN {quote(lb)}" for lb, ws in rules.TOOLS)
_tool += f" WHEN length(n) > 2 AND n NOT IN ({', '.join(quote(w) for w in rules.NOT_A_TOOL)}) THEN n END"


def _tool_rows(name, patterns):
    parts = " UNION ALL ".join(
        f"SELECT prompt_id, {i} AS p, unnest(x) AS n, generate_subscripts(x, 1) AS k FROM (SELECT prompt_id, regexp_extract_all(low, {quote(pt.replace('WORD', rules.WORD))}, 1) AS x FROM lows)"
        for i, pt in enumerate(patterns)
    )
    return f"""{name} AS (SELECT prompt_id, string_agg(tool, ' | ' ORDER BY o) AS tools FROM (SELECT prompt_id, tool, min(p * 100000 + k) AS o FROM (
      SELECT prompt_id, p, k, {_tool} AS tool FROM ({parts})) WHERE tool IS NOT NULL GROUP BY ALL) GROUP BY prompt_id)"""


def _in(col, xs):
    return f"{col} IN ({', '.join(quote(x) for x in xs)})"


_mods = f"array_to_string(list_filter({sql_list(rules.MODIFIERS)}, lambda w: contains(low, w)), ' | ')"
_prices = "CASE niche " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.NICHE_PRICES.items()) + " END"
READ = f"""WITH {PROMPTS}, lows AS MATERIALIZED (SELECT prompt_id, lower(text) AS low FROM prompts), {_tool_rows('have', rules.REQUIRED)}, {_tool_rows('havenot', rules.EXCLUDED)},
 tagged AS (SELECT prompt_id, coalesce({_strong}, {_word}) AS business_type, CAST(coalesce({_strong_c}, {_word_c}) AS DOUBLE) AS type_confidence, {_phrase} AS ph,
  CASE WHEN {_votes(rules.ENGLISH_WORDS)} > {_votes(rules.SPANISH_WORDS)} THEN 'en' ELSE 'es' END AS language, {_label(rules.INDUSTRIES)} AS industry, {_label(rules.NICHES)} AS niche,
  {_label(rules.AUDIENCES)} AS audience, {_label(rules.LOCATIONS)} AS place, {_label(rules.PLATFORMS)} AS platform, {_label(rules.SPEEDS)} AS performance, {_mods} AS modifiers FROM lows)
 SELECT t.* EXCLUDE ph, coalesce(a.tools, '') AS must_have, coalesce(b.tools, '') AS must_not, CASE WHEN {_in('business_type', ['ecommerce', 'marketplace'])} THEN ph END AS product_category,
  CASE WHEN NOT {_in('business_type', ['ecommerce', 'marketplace'])} THEN ph END AS service_type, {_prices} AS price_range, CASE WHEN {_in('niche', rules.NICHE_STYLES)} THEN niche END AS style,
  CASE WHEN {_in('place', rules.NATIONAL)} THEN 'nacional' WHEN {_in('place', rules.REGIONAL)} THEN 'regional' WHEN place IS NOT NULL THEN 'local' END AS place_scope
 FROM tagged t LEFT JOIN have a ON a.prompt_id = t.prompt_id LEFT JOIN havenot b ON b.prompt_id = t.prompt_id"""

_pick = lambda xs: "[" + ", ".join("NULL" if x is None else quote(x) for x in xs) + f"][(prompt_id % {len(xs)})::INT + 1]"
REQS = f"""{PROMPTS}, requests AS MATERIALIZED (SELECT prompt_id AS intent_id, {_pick(["ecommerce", "software", "agency", "blog", "tienda"])} AS business_type,
  {_pick(["zapatos", "CRM médico", "diseño web", "viajes"])} AS term, {_pick([None, "eco natural", "premium y retro", "raro"])} AS niche,
  list_slice(['madrid', 'lima', 'cdmx', 'london', 'usa'], 1, (prompt_id % 6)::INT) AS places FROM prompts)"""
_tmpl = values("templates", ["kind", "ord", "weight", "pattern"], [(k, i, w, p) for k, rows in rules.QUERY_TEMPLATES.items() for i, (w, p) in enumerate(rows)])
_nmod = values("niche_words", ["niche", "o", "m"], [("eco natural", 0, "ecológico"), ("eco natural", 1, "sostenible"), ("premium y retro", 0, "lujo"), ("premium y retro", 1, "premium"), ("raro", 0, "raro")])
GENERATE = f"""WITH {REQS}, {_tmpl}, {_nmod},
 every AS (SELECT intent_id, ord AS o, replace(pattern, '{{t}}', term) AS query, weight FROM requests r JOIN templates t ON t.kind =
   CASE WHEN business_type IN ('ecommerce', 'tienda') THEN 'ecommerce' WHEN business_type = 'software' THEN 'saas' WHEN business_type = 'agency' THEN 'agencia' ELSE 'other' END
  UNION ALL SELECT intent_id, 100 + 2 * o, term || ' ' || m, 0.85 FROM requests r JOIN niche_words n ON n.niche = r.niche
  UNION ALL SELECT intent_id, 101 + 2 * o, 'tienda ' || term || ' ' || m, 0.8 FROM requests r JOIN niche_words n ON n.niche = r.niche
  UNION ALL SELECT intent_id, 200 + k, CASE WHEN business_type = 'agency' THEN 'agencia ' || term || ' ' || p WHEN business_type IN ('ecommerce', 'tienda') THEN 'tienda ' || term || ' ' || p ELSE term || ' ' || p END,
   CASE WHEN business_type = 'agency' THEN 0.85 WHEN business_type IN ('ecommerce', 'tienda') THEN 0.75 ELSE 0.7 END FROM (SELECT *, unnest(list_slice(places, 1, 4)) AS p, generate_subscripts(list_slice(places, 1, 4), 1) AS k FROM requests)),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY intent_id, lower(trim(query)) ORDER BY weight DESC, o) AS seen FROM every)
 SELECT intent_id, CAST(ord AS INTEGER) AS ord, query, CAST(weight AS DOUBLE) AS weight FROM (SELECT intent_id, query, weight, row_number() OVER (PARTITION BY intent_id ORDER BY weight DESC, o) AS ord FROM firsts WHERE seen = 1) WHERE ord <= 15"""
_parts = values("parts", ["part", "p", "types", "r", "k", "weight", "pattern"], [
    (part, p, "|" + "|".join(types) + "|", r, k, w, t.replace("{x}", rules.INTENT_EXCLUSIONS))
    for p, (part, table) in enumerate(rules.INTENT_QUERIES.items()) for r, (types, rows) in enumerate(table) for k, (w, t) in enumerate(rows)
])
_told = values("told", ["part", "label", "o", "m"], [
    (part, label, o, m) for part, table in (("niche", rules.INTENT_NICHE_WORDS), ("audience", rules.INTENT_AUDIENCE_WORDS)) for label, ms in table.items() for o, m in enumerate(ms)
])
INTENT_SQL = f"""WITH tags AS MATERIALIZED ({READ}), {PROMPTS}, {_parts}, {_told},
 asked AS MATERIALIZED (SELECT t.*, lower(t.business_type) AS kind, coalesce(product_category, service_type, CASE WHEN t.prompt_id % 3 = 0 THEN nullif(array_to_string(list_slice(string_split(lower(text), ' '), 1, 2), ' '), '') END, text) AS term
   FROM tags t JOIN prompts p ON p.prompt_id = t.prompt_id),
 said AS (SELECT prompt_id, part, 0 AS o, NULL AS m FROM asked, (VALUES ('base'), ('indicator'), ('exclusion'), ('transactional')) x(part)
  UNION ALL SELECT prompt_id, 'location', 0, place FROM asked WHERE place <> '' UNION ALL SELECT prompt_id, 'industry', 0, industry FROM asked WHERE industry <> ''
  UNION ALL SELECT prompt_id, 'platform', 0, platform FROM asked WHERE platform <> ''
  UNION ALL SELECT prompt_id, w.part, o, m FROM asked JOIN told w ON w.part = 'niche' AND w.label = niche WHERE o < 2
  UNION ALL SELECT prompt_id, w.part, 5, m FROM asked JOIN told w ON w.part = 'niche' AND w.label = style WHERE o < 1 AND style IS DISTINCT FROM niche
  UNION ALL SELECT prompt_id, w.part, o, m FROM asked JOIN told w ON w.part = 'audience' AND w.label = audience WHERE o < 2),
 ruled AS (SELECT prompt_id, part, min(r) AS r FROM asked JOIN (SELECT DISTINCT part, r, types FROM parts) x ON types = '||' OR contains(types, '|' || kind || '|') GROUP BY ALL),
 every AS (SELECT a.prompt_id, p.p, s.o, p.k, p.weight, replace(replace(pattern, '{{m}}', coalesce(m, '')), '{{t}}', term) AS query
   FROM asked a JOIN said s ON s.prompt_id = a.prompt_id JOIN ruled u ON u.prompt_id = a.prompt_id AND u.part = s.part JOIN parts p ON p.part = s.part AND p.r = u.r),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, lower(trim(query)) ORDER BY weight DESC, p, o, k) AS seen FROM every WHERE length(trim(query)) > 5)
 SELECT prompt_id AS intent_id, CAST(n AS INTEGER) AS ord, query, CAST(weight AS DOUBLE) AS weight
 FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY weight DESC, p, o, k) AS n FROM firsts WHERE seen = 1) WHERE n <= 20"""
_trans = values("trans", ["kind", "ord", "pattern"], [(k, i, p) for k, ps in rules.TRANSACTIONAL.items() for i, p in enumerate(ps)])
_comp = values("comp", ["ord", "pattern"], list(enumerate(rules.COMPETITOR)))
QTABLE = f"""{PROMPTS}, {INTENTS_SQL},
 tails AS (SELECT prompt_id, lower(string_split(text, '. ')[-1]) AS t FROM prompts),
 queries AS MATERIALIZED (SELECT prompt_id % 3 AS intent_id, prompt_id AS ord, CASE prompt_id % 7 WHEN 0 THEN '"' || t || '"' WHEN 1 THEN 'intitle:' || t || ' -crm' WHEN 2 THEN '"' || t || '" precio -"artículo"'
  WHEN 3 THEN 'Ejemplo: ' || t WHEN 4 THEN array_to_string(list_reverse(string_split(t, ' ')), ' ') WHEN 5 THEN ' `de` ' ELSE 'buscar ' || prompt_id || ' ' || t END AS query FROM tails)"""


def canonical_sql(q):
    quotes = quote("[\"'`]")
    s = f"regexp_replace(lower({q}), {quotes}, ' ', 'g')"
    s = f"regexp_replace({s}, '(^|[^\\p{{L}}\\p{{N}}_])({rules.QUERY_OPERATORS}):', '\\1 ', 'g')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g')"
    return f"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array({s}, '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(rules.STOPWORDS)}, w)))), ' ')"


DEDUPED = lambda src: f"""SELECT intent_id, min(ord) AS ord, arg_min(query, ord) AS query FROM (SELECT *, {canonical_sql('query')} AS c FROM {src}) WHERE c <> '' GROUP BY intent_id, c"""
_one = "trim(query)"
for _q in ('"', "''", "`"):
    _ch = quote(_q) if _q != "''" else "''''"
    _one = f"(SELECT CASE WHEN length(z) >= 2 AND left(z, 1) = {_ch} AND right(z, 1) = {_ch} AND length(z) - length(replace(z, {_ch}, '')) = 2 THEN trim(substring(z, 2, length(z) - 2)) ELSE z END FROM (SELECT {_one} AS z))"
_skip = " OR ".join(f"starts_with(lower(query), {quote(p)})" for p in rules.SKIP_PREFIXES)
POST = f"""WITH {QTABLE}, clean AS (SELECT intent_id, ord, {_one} AS query FROM queries),
 kept AS (SELECT c.* FROM clean c JOIN intents i ON i.intent_id = c.intent_id WHERE length(query) >= 4 AND NOT ({_skip}) AND len(list_filter(i.must_not, lambda t:
   NOT contains(replace(' ' || lower(query) || ' ', ' ', ''), '-' || lower(t)) AND regexp_matches(' ' || lower(query) || ' ', '[^\\p{{L}}\\p{{N}}_-]' || regexp_escape(lower(t)) || '[^\\p{{L}}\\p{{N}}_]'))) = 0)
 SELECT intent_id, CAST(rank AS INTEGER) AS rank, query FROM (SELECT intent_id, query, row_number() OVER (PARTITION BY intent_id ORDER BY ord) AS rank FROM ({DEDUPED('kept')})) WHERE rank <= 15"""


def _model(i):
    return "replace(replace(" + quote(MODEL[i].replace("\n", "~")) + ", '~', chr(10)), '{i}', CAST(prompt_id AS VARCHAR))"


_models = f"CASE prompt_id % {len(MODEL)} " + " ".join(f"WHEN {i} THEN {_model(i)}" for i in range(len(MODEL))) + " END"
_jl = lambda n: f"CASE WHEN json_type(j, '$.{n}') = 'ARRAY' THEN array_to_string(json_extract_string(j, '$.{n}[*]'), ' | ') ELSE '' END"
_js = lambda n: f"nullif(json_extract_string(j, '$.{n}'), '')"
_kinds9 = "CASE WHEN business_type IN ('ecommerce', 'tienda') THEN 'ecommerce' WHEN business_type = 'software' THEN 'saas' WHEN business_type = 'agency' THEN 'agencia' WHEN business_type = 'blog' THEN 'blog' ELSE 'other' END"
_valid = "CASE kind " + " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in rules.VALIDATION_WORDS.items()) + " END"
_pm = "CASE prompt_id % 4 WHEN 0 THEN 'Prompt: ' || text WHEN 1 THEN '\"' || text || '\"' WHEN 2 THEN ' → ' || text ELSE text END"
_c1 = f"trim(regexp_replace(regexp_replace({_pm}, '^\\s+|\\s+$', '', 'g'), '(?s)^```.*?```$', ''))"
_c2 = f"trim(regexp_replace({_c1}, '(?i)^(?:prompt\\s*[:→-]?\\s*|→\\s*|-\\s*)', ''))"
_c3 = f"""trim(regexp_replace({_c2}, '^["''](.+)["'']$', '\\1'))"""
def _named(patterns):
    def one(p):
        words = f"regexp_split_to_array(trim(regexp_extract(low, {quote(p.replace('WORD', rules.WORD))}, 1)), '\\s+')"
        end = f"coalesce(nullif(list_position(list_transform({words}, lambda w: list_contains({sql_list(rules.PHRASE_ENDS)}, w)), true), 0), len({words}) + 1)"
        return f"array_to_string(list_filter(list_slice({words}, 1, {end} - 1), lambda w: length(w) > 1 AND NOT list_contains({sql_list([*rules.PHRASE_PLACES, *rules.PHRASE_TOOLS])}, w)), ' ')"

    parts = [f"CASE WHEN length({one(p)}) > 2 THEN {one(p)} END" for p in patterns]
    # of two phrases the second is left out where it equals the first
    return f"concat_ws(' | ', {parts[0]}" + "".join(f", nullif({x}, coalesce({parts[0]}, ''))" for x in parts[1:]) + ")"


_tech = "CASE " + " ".join(f"WHEN contains(n, {quote(t)}) OR contains({quote(t)}, n) THEN {quote(t)}" for ts in rules.KNOWN_TECHNOLOGIES.values() for t in ts) + " END"
_category = "CASE " + " ".join(f"WHEN {_in('n', names)} THEN {quote(c)}" for c, names in rules.CATEGORY_NAMES) + " END"


def _needs(name, starts, value):
    parts = " UNION ALL ".join(
        f"SELECT prompt_id, {i} AS p, trim(unnest(x)) AS n, generate_subscripts(x, 1) AS k FROM (SELECT prompt_id, regexp_extract_all(low, {quote((st_ + rules.NAMED).replace('WORD', rules.WORD))}, 1) AS x FROM lows)"
        for i, st_ in enumerate(starts)
    )
    cat = f"CASE WHEN {_in('v', rules.SPLIT_CATEGORIES)} THEN v " + " ".join(f"WHEN {_in('v', names)} THEN {quote(c)}" for c, names in rules.SPLIT_NAMES) + " END"
    return f"""{name} AS MATERIALIZED (SELECT prompt_id, v, min(p * 100000 + k) AS o, {cat} AS c FROM (SELECT prompt_id, p, k, {value} AS v FROM ({parts}) WHERE length(n) > 1 AND NOT {_in('n', rules.NEVER_NAMED)}) WHERE v IS NOT NULL GROUP BY prompt_id, v),
  {name}_all AS (SELECT prompt_id, string_agg(v, ' | ' ORDER BY o) AS names, string_agg(v, ' | ' ORDER BY o) FILTER (c IS NULL) AS techs FROM {name} GROUP BY prompt_id),
  {name}_cats AS (SELECT prompt_id, string_agg(c, ' | ' ORDER BY o) AS cats FROM (SELECT prompt_id, c, min(o) AS o FROM {name} WHERE c IS NOT NULL GROUP BY ALL) GROUP BY prompt_id)"""


_single = lambda start: f"array_to_string(regexp_extract_all(text, {quote('(?i)(?:^|[^\\p{L}\\p{N}_])' + start + rules.TOOL_NAME)}, 1), ' | ')"
PLAIN = f"""WITH {PROMPTS}, lows AS (SELECT prompt_id, lower(text) AS low FROM prompts) SELECT prompt_id, coalesce({_label(rules.FIRST_TYPES)}, 'otro') AS type,
  CASE WHEN {_label(rules.FIRST_TYPES)} IS NULL THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS type_confidence, coalesce({_label(rules.SHORT_TYPES)}, 'otro') AS short_type,
  {_named(rules.SERVICE_PHRASES)} AS services, {_named(rules.NICHE_PHRASES)} AS niches FROM lows"""
NEEDS = f"""WITH {PROMPTS}, lows AS MATERIALIZED (SELECT prompt_id, lower(text) AS low FROM prompts), {_needs('have', rules.NEEDS, f'coalesce({_tech}, {_category})')}, {_needs('havenot', rules.REFUSALS, f'coalesce({_tech}, {_category}, n)')}
 SELECT p.prompt_id, coalesce(a.names, '') AS must_have, coalesce(b.names, '') AS must_not, coalesce(a.techs, '') AS have_technologies, coalesce(c.cats, '') AS have_categories,
  coalesce(b.techs, '') AS not_technologies, coalesce(d.cats, '') AS not_categories, {_single(rules.TOOL_NEEDED)} AS tools_needed, {_single(rules.TOOL_REFUSED)} AS tools_refused
 FROM prompts p LEFT JOIN have_all a ON a.prompt_id = p.prompt_id LEFT JOIN havenot_all b ON b.prompt_id = p.prompt_id LEFT JOIN have_cats c ON c.prompt_id = p.prompt_id LEFT JOIN havenot_cats d ON d.prompt_id = p.prompt_id"""
_prof = lambda r: _label(r[1])
_place = lambda i: "CASE " + " ".join(f"WHEN contains(low, {quote(p[0])}) THEN {'NULL' if p[i] is None else quote(p[i])}" for p in rules.PROFILE_PLACES) + " END"
_quality = "array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(low, {quote(w)})" for w in ws) + f" THEN {quote(lb)} END" for lb, ws in rules.PROFILE_QUALITY[1]) + "], lambda x: x IS NOT NULL), ' | ')"
SHEETS = f"""
{CONTEXT},
{DETECTIONS},
{INLINE},
{HITS},
page_tech AS (SELECT page_id, string_agg(DISTINCT tech, ', ' ORDER BY tech) AS techs FROM (SELECT page_id, tech FROM detections) GROUP BY page_id),
page_hosts AS (SELECT page_id, string_agg(host, ', ' ORDER BY host) AS hosts FROM (SELECT DISTINCT page_id, host FROM assets) GROUP BY page_id),
blobs AS (SELECT a.page_id, CASE WHEN kind = 'form' THEN 1 ELSE 0 END AS r, CASE WHEN kind = 'form' THEN 'dna_form' ELSE 'dna_script' END AS source, lower(a.host || ' ' || a.url || ' ' || coalesce(t.tech, '')) AS blob, a.url AS shown
   FROM assets a LEFT JOIN asset_tech t ON t.page_id = a.page_id AND t.pos = a.pos
  UNION ALL SELECT page_id, CASE WHEN kind = 'js' THEN 2 ELSE 3 END, CASE WHEN kind = 'js' THEN 'dna_global' ELSE 'dna_comment' END, lower(label || ' ' || snippet), snippet FROM inline_found),
wanted(o, w) AS (VALUES (0, 'shopify'), (1, 'calendly')),
outcomes AS (SELECT m.page_id, o, w, (SELECT min(tech) FROM detections d WHERE d.page_id = m.page_id AND (contains(lower(tech), w) OR contains(w, lower(tech)))) AS det,
  (SELECT arg_min({{'s': source, 'e': shown}}, r || shown) FROM blobs b WHERE b.page_id = m.page_id AND contains(blob, w)) AS ev FROM markup m, wanted),
target_lines AS (SELECT page_id, string_agg('  · ' || w || CASE WHEN det IS NOT NULL THEN ': SI (detector) — ' || left(det, 120) WHEN ev IS NOT NULL THEN ': SI (' || ev.s || ') — ' || left(ev.e, 120) ELSE ': NO (sin evidencia)' END, chr(10) ORDER BY o) AS lines
  FROM outcomes GROUP BY page_id)
"""
ORACLE = {
    "q1_q5_read_prompts": READ,
    "q1_q3_plain_forms": PLAIN,
    "q5_requirement_forms": NEEDS,
    "q6_extract_profile": f"""WITH {PROMPTS}, lows AS (SELECT prompt_id, lower(text) AS low FROM prompts) SELECT prompt_id, audience, CASE WHEN audience IS NOT NULL THEN 0.8::DOUBLE END AS audience_confidence, scale, quality, city, country FROM (
        SELECT prompt_id, {_prof(rules.PROFILE_AUDIENCE)} AS audience, {_prof(rules.PROFILE_SCALE)} AS scale, {_quality} AS quality, {_place(1)} AS city, {_place(2)} AS country FROM lows)""",
    "q7_generate_queries": GENERATE,
    "q7_intent_queries": INTENT_SQL,
    "q7_exclusion_queries": f"WITH {QTABLE} SELECT intent_id, ord, query || ' -\"qué es\" -wikipedia -\"definición\" -\"guía de\"' AS query FROM queries",
    "q7_transactional_queries": f"""WITH {REQS}, {_trans} SELECT intent_id, CAST(ord AS INTEGER) AS ord, replace(pattern, '{{t}}', term) AS query FROM requests JOIN trans ON kind = CASE WHEN business_type IN ('ecommerce', 'tienda') THEN 'ecommerce'
        WHEN business_type = 'software' THEN 'saas' WHEN business_type = 'agency' THEN 'agencia' ELSE 'other' END""",
    "q7_competitor_queries": f"WITH {REQS}, {_comp} SELECT intent_id AS id, CAST(ord AS INTEGER) AS ord, replace(pattern, '{{t}}', term) AS query FROM requests, comp",
    "q8_geo_queries": f"""WITH generated AS ({GENERATE}), tagged AS (SELECT *, CASE WHEN intent_id % 5 > 2 THEN 'Madrid España' WHEN intent_id % 5 > 0 THEN 'España' END AS tag FROM generated)
        SELECT intent_id, ord, query || ' ' || tag AS query FROM tagged q WHERE ord <= 3 AND tag IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM generated x WHERE x.intent_id = q.intent_id AND x.query = q.query || ' ' || tag)""",
    "q9_indicator_lists": f"""WITH {REQS}, k AS (SELECT *, {_kinds9} AS kind, intent_id % 4 AS m FROM requests) SELECT intent_id, array_to_string(list_concat({_valid},
        CASE WHEN kind = 'ecommerce' AND m = 1 THEN {sql_list(rules.NICHE_WORDS['eco'])} WHEN kind = 'ecommerce' AND m = 2 THEN {sql_list(rules.NICHE_WORDS['luxury'])} ELSE [] END,
        CASE WHEN kind = 'agencia' AND intent_id % 3 = 0 THEN ['madrid', 'dirección', 'oficina'] ELSE [] END, [term], CASE WHEN intent_id % 2 = 0 THEN ['moda'] ELSE [] END), ' | ') AS validation_indicators,
        CASE WHEN kind = 'blog' THEN {quote(' | '.join(rules.BLOG_EXCLUSION_WORDS))} ELSE {quote(' | '.join(rules.EXCLUSION_WORDS))} END AS exclusion_indicators FROM k""",
    "q10_parse_intent_rows": f"""WITH {PROMPTS}, raw AS (SELECT prompt_id AS id, regexp_extract({_models}, '(?s)(\\{{.*\\}})', 1) AS b FROM prompts), p AS (SELECT id, CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j FROM raw)
        SELECT id, j IS NOT NULL AS parsed, lower(coalesce({_js('business_type')}, 'otro')) AS business_type, {_js('product_category')} AS product_category, {_js('service_type')} AS service_type, {_js('niche')} AS niche,
        {_js('location.country')} AS country, {_js('location.region')} AS region, {_js('location.city')} AS city, {_js('target_audience')} AS target_audience, coalesce({_js('language')}, 'es') AS language,
        {_jl('search_queries')} AS search_queries, {_jl('must_have')} AS must_have, {_jl('must_not')} AS must_not, coalesce(nullif({_jl('target_techs')}, ''), {_jl('must_have')}) AS target_techs,
        {_jl('validation_indicators')} AS validation_indicators, {_jl('exclusion_indicators')} AS exclusion_indicators,
        concat_ws(' | ', 'Prompt depurado: ' || {_js('prompt_depurado')}, {_js('analysis_notes')}) AS analysis_notes, coalesce(TRY_CAST({_js('confidence')} AS DOUBLE), 0.7) AS confidence FROM p""",
    "q11_judge_sheet": with_pages(
        f"""SELECT c.page_id AS intent_id, c.domain, '[PROMPT DEL USUARIO]' || chr(10) || 'quiero ' || c.domain || chr(10) || chr(10) || '[DOMINIO ANALIZADO]' || chr(10) || c.domain || chr(10) || chr(10)
        || '[HTML DE LA WEB — formato Markdown]' || chr(10) || regexp_replace(c.md, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || '[ANÁLISIS WAPPALYZER / ADN]' || chr(10)
        || CASE WHEN t.techs IS NULL THEN {quote(rules.SHEET_NO_TECH)} ELSE {quote(rules.SHEET_TECH)} || t.techs END || chr(10) || 'Targets pedidos:' || chr(10) || l.lines || chr(10) || 'Perfiles sociales: x=' || c.domain
        || coalesce(chr(10) || 'Dominios externos: ' || h.hosts, '') || chr(10) || chr(10) || '[ANÁLISIS PAGESPEED]' || chr(10) || CASE WHEN c.page_id % 2 = 0 THEN 'Scores Lighthouse: seo=' || c.page_id ELSE '—' END || chr(10) || chr(10) || 'Respuesta:' AS sheet
        FROM (SELECT page_id, domain, {' || '.join(_sheet)} AS md FROM context) c LEFT JOIN page_tech t ON t.page_id = c.page_id LEFT JOIN page_hosts h ON h.page_id = c.page_id JOIN target_lines l ON l.page_id = c.page_id""",
        "metas", "links", ctes=SHEETS,
    ),
    "q12_buyer_prompt": f"""WITH {PROMPTS}, lows AS (SELECT prompt_id AS id, lower(text) AS low FROM prompts), p AS (SELECT id, coalesce({_label(rules.SECTORS)}, 'empresa') AS sector, regexp_extract(low, {quote('(?:^|[^\\p{L}\\p{N}_])(' + rules.PLACES + ')(?:[^\\p{L}\\p{N}_]|$)')}, 1) AS place FROM lows)
        SELECT id, sector || ' que necesite solución como la descrita' || CASE WHEN place <> '' THEN ' en ' || place ELSE '' END AS prompt FROM p""",
    "q12_clean_prompt": f"WITH {PROMPTS}, c AS (SELECT prompt_id, {_c3} AS t FROM prompts) SELECT prompt_id, CASE WHEN length(t) > 200 THEN regexp_replace(left(t, 200), ' [^ ]*$', '') ELSE t END AS prompt FROM c",
    "w2_dedupe_queries": f"WITH {QTABLE} {DEDUPED('queries')}",
    "w3_dedupe_keep_order": f"""WITH {PROMPTS}, ws AS (SELECT prompt_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM prompts),
        f AS (SELECT prompt_id, arg_min(w, k) AS w, min(k) AS k FROM ws WHERE trim(w) <> '' GROUP BY prompt_id, lower(trim(w))) SELECT prompt_id, string_agg(w, ' | ' ORDER BY k) AS words FROM f GROUP BY prompt_id""",
    "l3_post_process_queries": POST,
}

