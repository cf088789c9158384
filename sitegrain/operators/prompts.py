"""Prompts as a table: classification by lexicons, requirement phrases, query generation and query clean-up.

Everything about one prompt is found inside its row. Only the clean-up of query tables compares rows, by
map-side combined minima and a ranked cap per intent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.markup import distinct_by, let, squeeze
from sitegrain.functions.patterns import constant, contains_any, words_in
from sitegrain.operators.funnel import ranked
from sitegrain.rules import prompts as rules

NO_TEXTS = "array<string>"


def _first_label(text: Column, table) -> Column:
    rows = constant([{"label": label, "words": words} for label, words in table], "array<struct<label: string, words: array<string>>>")
    hit = let(text, lambda t: F.filter(rows, lambda r: F.exists(r["words"], lambda w: F.contains(t, w))))
    return F.get(hit, F.lit(0))["label"]


def classify_type(text: Column) -> Column:
    """(label, confidence) of a lower-case prompt: the first type with a strong phrase, unless an earlier rule decides;
    else the type with the best keyword confidence (the earliest on ties), else the default."""
    table = constant(
        [{"label": l, "confidence": c, "words": w, "strong": s} for l, c, w, s in rules.BUSINESS_TYPES],
        "array<struct<label: string, confidence: double, words: array<string>, strong: array<string>>>",
    )

    def decide(t: Column) -> Column:
        strong = F.get(F.filter(table, lambda r: F.exists(r["strong"], lambda w: F.contains(t, w))), F.lit(0))
        named = F.filter(table, lambda r: F.exists(r["words"], lambda w: F.contains(t, w)))
        best = F.array_max(F.transform(named, lambda r, i: F.struct(r["confidence"].alias("c"), (-i).alias("i"), r["label"].alias("l"))))
        by_word = best["c"] * rules.KEYWORD_FACTOR
        return F.struct(
            F.coalesce(strong["label"], best["l"], F.lit(rules.DEFAULT_TYPE[0])).alias("label"),
            F.round(F.coalesce(strong["confidence"], by_word, F.lit(rules.DEFAULT_TYPE[1])), 4).alias("confidence"),
        )

    return let(text, decide)


def language_vote(text: Column) -> Column:
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    english = F.size(words_in(padded, [f" {w} " for w in rules.ENGLISH_WORDS]))
    spanish = F.size(words_in(padded, [f" {w} " for w in rules.SPANISH_WORDS]))
    return F.when(english > spanish, "en").otherwise("es")


def phrase(text: Column) -> Column:
    """Product or service phrase: the first pattern whose phrase has 3 to 49 characters."""
    found = [squeeze(F.regexp_extract(text, "(?i)" + p, 1)) for p in rules.PHRASES]
    return F.coalesce(*[let(f, lambda v: F.when(F.length(v).between(3, 49), v)) for f in found])


def _tools(text: Column, patterns: list[str]) -> Column:
    """Canonical tools named by trigger phrases, in order, each once; unknown words stay if they could be a tool."""
    table = constant([{"label": t, "words": w} for t, w in rules.TOOLS], "array<struct<label: string, words: array<string>>>")
    named = F.concat(*[F.regexp_extract_all(text, F.lit(p.replace("WORD", rules.WORD)), F.lit(1)) for p in patterns])

    def canonical(name: Column) -> Column:
        known = F.get(F.filter(table, lambda r: F.exists(r["words"], lambda w: F.contains(name, w) | F.contains(w, name))), F.lit(0))
        plausible = (F.length(name) > 2) & ~name.isin(rules.NOT_A_TOOL)
        return F.coalesce(known["label"], F.when(plausible, name))

    return F.array_distinct(F.array_compact(F.transform(named, lambda n: canonical(F.trim(n)))))


def read_prompts(prompts: DataFrame) -> DataFrame:
    """All labels of prompts(prompt_id, text): type, phrase, language, tags, requirements."""
    t = F.col("low")
    typed = prompts.withColumn("low", F.lower("text")).withColumn("type", classify_type(F.col("low")))
    rows = typed.select(
        "prompt_id",
        "text",
        "low",
        F.col("type.label").alias("business_type"),
        F.col("type.confidence").alias("type_confidence"),
        phrase(t).alias("phrase"),
        language_vote(t).alias("language"),
        _first_label(t, rules.INDUSTRIES).alias("industry"),
        _first_label(t, rules.NICHES).alias("niche"),
        _first_label(t, rules.AUDIENCES).alias("audience"),
        _first_label(t, rules.LOCATIONS).alias("place"),
        _first_label(t, rules.PLATFORMS).alias("platform"),
        _first_label(t, rules.SPEEDS).alias("performance"),
        words_in(t, rules.MODIFIERS).alias("modifiers"),
        _tools(t, rules.REQUIRED).alias("must_have"),
        _tools(t, rules.EXCLUDED).alias("must_not"),
    )
    sells = F.col("business_type").isin("ecommerce", "marketplace")
    return rows.withColumns(
        {
            "product_category": F.when(sells, F.col("phrase")),
            "service_type": F.when(~sells, F.col("phrase")),
            "price_range": F.try_element_at(constant(rules.NICHE_PRICES, "map<string,string>"), F.col("niche")),
            "style": F.when(F.col("niche").isin(rules.NICHE_STYLES), F.col("niche")),
            "place_scope": F.when(F.col("place").isin(rules.NATIONAL), "nacional")
            .when(F.col("place").isin(rules.REGIONAL), "regional")
            .when(F.col("place").isNotNull(), "local"),
        }
    ).drop("phrase", "low")


def named_phrases(text: Column, patterns: list[str]) -> Column:
    """What the patterns name in a lower-case prompt, each once: the words before one that ends a phrase, without places,
    tools and single letters; at least 3 characters."""
    ends, foreign = list(rules.PHRASE_ENDS), [*rules.PHRASE_PLACES, *rules.PHRASE_TOOLS]

    def named(pattern: str) -> Column:
        def cleaned(words: Column) -> Column:
            end = F.array_position(F.transform(words, lambda w: w.isin(ends)), F.lit(True)).cast("int")
            head = F.when(end > 0, F.slice(words, F.lit(1), end - 1)).otherwise(words)
            return F.array_join(F.filter(head, lambda w: ~w.isin(foreign) & (F.length(w) > 1)), " ")

        found = F.regexp_extract(text, pattern.replace("WORD", rules.WORD), 1)
        return let(F.split(F.trim(found), r"\s+"), cleaned)

    return F.array_distinct(F.filter(F.array(*[named(p) for p in patterns]), lambda x: F.length(x) > 2))


def requirements(text: Column, starts: list[str], plain: bool) -> Column:
    """Technologies and categories that a lower-case prompt names after the starts, in order, each once.

    A known technology that holds the name or lies in it is taken, else the category of that name; plain: other names stay
    as they are, else they are left out.
    """
    techs = constant([t for names in rules.KNOWN_TECHNOLOGIES.values() for t in names], NO_TEXTS)
    categories = constant({n: c for c, names in rules.CATEGORY_NAMES for n in names}, "map<string, string>")
    named = F.concat(*[F.regexp_extract_all(text, F.lit((p + rules.NAMED).replace("WORD", rules.WORD)), F.lit(1)) for p in starts])
    usable = F.filter(F.transform(named, lambda n: F.trim(n)), lambda n: (F.length(n) > 1) & ~n.isin(rules.NEVER_NAMED))

    def known(name: Column) -> Column:
        tech = F.get(F.filter(techs, lambda t: F.contains(name, t) | F.contains(t, name)), F.lit(0))
        return F.coalesce(tech, F.try_element_at(categories, name), *([name] if plain else []))

    return F.array_distinct(F.array_compact(F.transform(usable, known)))


def split_requirements(names: Column) -> Column:
    """(technologies, categories) of a list of requirements, each once, in order; null counts as empty."""
    categories = constant(
        {n: c for c, others in rules.SPLIT_NAMES for n in others} | {c: c for c in rules.SPLIT_CATEGORIES}, "map<string, string>"
    )
    low = F.transform(F.coalesce(names, F.array().cast(NO_TEXTS)), lambda n: F.lower(F.trim(n)))

    def split(ns: Column) -> Column:
        return F.struct(
            F.array_distinct(F.filter(ns, lambda n: F.try_element_at(categories, n).isNull())).alias("technologies"),
            F.array_distinct(F.array_compact(F.transform(ns, lambda n: F.try_element_at(categories, n)))).alias("categories"),
        )

    return let(low, split)


def tool_names(text: Column, start: str) -> Column:
    """Single tool names as written after a word that asks for them or refuses them, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(r"(?iU)\b" + start + rules.TOOL_NAME), F.lit(1))


def read_plainly(prompts: DataFrame) -> DataFrame:
    """The plain reading of prompts(prompt_id, text): types of two lexicons, named services and niches, requirements,
    their split into technologies and categories, and single tool names. A null text counts as empty."""
    low, unknown = F.col("low"), F.lit(rules.UNKNOWN_TYPE)
    first = _first_label(low, rules.FIRST_TYPES)
    told = prompts.withColumn("text", F.coalesce("text", F.lit("")))
    rows = told.withColumn("low", F.lower("text")).select(
        "prompt_id",
        F.coalesce(first, unknown).alias("type"),
        F.when(first.isNotNull(), rules.FIRST_TYPE_CONFIDENCE).otherwise(rules.NO_TYPE_CONFIDENCE).alias("type_confidence"),
        F.coalesce(_first_label(low, rules.SHORT_TYPES), unknown).alias("short_type"),
        named_phrases(low, rules.SERVICE_PHRASES).alias("services"),
        named_phrases(low, rules.NICHE_PHRASES).alias("niches"),
        requirements(low, rules.NEEDS, plain=False).alias("must_have"),
        requirements(low, rules.REFUSALS, plain=True).alias("must_not"),
        tool_names(F.col("text"), rules.TOOL_NEEDED).alias("tools_needed"),
        tool_names(F.col("text"), rules.TOOL_REFUSED).alias("tools_refused"),
    )
    return rows.withColumns({"have": split_requirements(F.col("must_have")), "not": split_requirements(F.col("must_not"))})


def extract_profile(prompts: DataFrame) -> DataFrame:
    """Audience, scale and quality labels with their confidences, and the first place named, of prompts(prompt_id, text)."""
    low = F.col("low")

    def labelled(rule) -> Column:
        confidence, table = rule
        label = _first_label(low, table)
        return F.when(label.isNotNull(), F.struct(label.alias("label"), F.lit(confidence).alias("confidence")))

    confidence, qualities = rules.PROFILE_QUALITY
    quality = F.array(
        *[F.when(contains_any(low, words), F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))) for label, words in qualities]
    )
    places = constant([{"word": w, "city": c, "country": n} for w, c, n in rules.PROFILE_PLACES], "array<struct<word: string, city: string, country: string>>")
    place = F.get(F.filter(places, lambda p: F.contains(low, p["word"])), F.lit(0))
    return prompts.withColumn("low", F.lower("text")).select(
        "prompt_id",
        labelled(rules.PROFILE_AUDIENCE).alias("audience"),
        labelled(rules.PROFILE_SCALE).alias("scale"),
        F.array_compact(quality).alias("quality"),
        place["city"].alias("city"),
        place["country"].alias("country"),
    )


def template_kind(business_type: Column) -> Column:
    kind = F.lit("other")
    for name, types in rules.TEMPLATE_TYPES.items():
        kind = F.when(F.lower(business_type).isin(types), name).otherwise(kind)
    return kind


def generate_queries(intents: DataFrame, limit: int = rules.QUERIES_MAX) -> DataFrame:
    """Search queries of intents(intent_id, business_type, term, niche, places): (intent_id, ord, query, weight).

    Templates of the type filled with the term, two niche words, up to four places; by weight, in template order,
    each text once regardless of case, capped.
    """
    row = "struct<weight: double, pattern: string>"
    templates = constant(
        {k: [{"weight": w, "pattern": p} for w, p in rows] for k, rows in rules.QUERY_TEMPLATES.items()}, f"map<string, array<{row}>>"
    )
    local = constant({k: {"weight": w, "pattern": p} for k, (w, p) in rules.LOCATION_QUERIES.items()}, f"map<string, {row}>")
    niches = constant([{"name": n, "words": w} for n, w in rules.NICHE_MODIFIERS], "array<struct<name: string, words: array<string>>>")
    extra = constant([{"weight": w, "pattern": p} for w, p in rules.NICHE_QUERIES], f"array<{row}>")
    kind, term, niche = F.col("kind"), F.col("term"), F.lower("niche")

    def filled(rule: Column, word: Column | None = None) -> Column:
        text = F.replace(rule["pattern"], F.lit("{t}"), term)
        text = text if word is None else F.replace(text, F.lit("{m}"), word)
        return F.struct(text.alias("query"), rule["weight"].alias("weight"))

    hit = F.filter(niches, lambda r: F.contains(niche, r["name"]) | F.exists(r["words"], lambda w: F.contains(niche, w)))
    words = F.slice(F.flatten(F.transform(hit, lambda r: F.slice(r["words"], 1, 2))), 1, 2)
    modifiers = F.when(niche.isNull() | (niche == ""), F.array().cast(NO_TEXTS)).when(F.size(words) > 0, words).otherwise(F.array("niche"))
    places = F.slice(F.coalesce("places", F.array().cast(NO_TEXTS)), 1, rules.LOCATIONS_MAX)
    local_kind = F.when(F.col("business_type").isin("agencia", "agency"), "agencia").when(
        F.col("business_type").isin("ecommerce", "tienda"), "ecommerce"
    ).otherwise("other")
    every = F.concat(
        F.transform(F.try_element_at(templates, kind), lambda r: filled(r)),
        F.flatten(F.transform(modifiers, lambda w: F.transform(extra, lambda r: filled(r, w)))),
        F.transform(places, lambda p: filled(F.try_element_at(local, local_kind), p)),
    )
    placed = F.transform(every, lambda q, i: F.struct((-q["weight"]).alias("w"), i.alias("i"), q["query"].alias("query"), q["weight"].alias("weight")))
    kept = F.slice(distinct_by(F.array_sort(placed), lambda q: F.lower(F.trim(q["query"]))), 1, limit)
    rows = intents.withColumn("kind", template_kind(F.col("business_type")))
    return rows.select("intent_id", F.posexplode_outer(kept).alias("ord", "q")).filter("q IS NOT NULL").select(
        "intent_id", (F.col("ord") + 1).alias("ord"), "q.query", "q.weight"
    )


def intent_queries(intents: DataFrame, limit: int = rules.INTENT_QUERIES_MAX) -> DataFrame:
    """Search queries of whole intents, as read_prompts gives them: (intent_id, ord, query, weight).

    Reads intent_id, text, business_type, product_category, service_type, main_keywords, place, niche, style, audience,
    industry and platform. The term is the first of product, service, two keywords and the text that is filled. Each part
    of the rules gives the queries of its first rule for the type, for each of its words; by weight, in the order of the
    rules, each text once regardless of case, capped. Without a term there are no queries.
    """
    filled = lambda name: F.nullif(F.col(name), F.lit(""))
    kind = F.coalesce(F.lower("business_type"), F.lit(""))
    term = F.coalesce(
        filled("product_category"), filled("service_type"), F.nullif(F.array_join(F.slice("main_keywords", 1, 2), " "), F.lit("")), F.col("text")
    )
    none, rule = F.array().cast(NO_TEXTS), "struct<types: array<string>, rows: array<struct<weight: double, pattern: string>>>"
    niches, audiences = (constant(x, "map<string, array<string>>") for x in (rules.INTENT_NICHE_WORDS, rules.INTENT_AUDIENCE_WORDS))

    def told(table: Column, name: str, most: int) -> Column:
        return F.coalesce(F.slice(F.try_element_at(table, F.col(name)), 1, most), none)

    words = {
        "location": F.array_compact(F.array(filled("place"))),
        "niche": F.concat(told(niches, "niche", 2), F.when(~F.col("style").eqNullSafe(F.col("niche")), told(niches, "style", 1)).otherwise(none)),
        "audience": told(audiences, "audience", 2),
        "industry": F.array_compact(F.array(filled("industry"))),
        "platform": F.array_compact(F.array(filled("platform"))),
    }

    def part(name: str) -> Column:
        table = [
            {"types": types, "rows": [{"weight": w, "pattern": p.replace("{x}", rules.INTENT_EXCLUSIONS)} for w, p in rows]}
            for types, rows in rules.INTENT_QUERIES[name]
        ]
        own = F.filter(constant(table, f"array<{rule}>"), lambda r: (F.size(r["types"]) == 0) | F.array_contains(r["types"], F.col("kind")))
        rows = F.coalesce(F.get(own, F.lit(0))["rows"], F.array().cast("array<struct<weight: double, pattern: string>>"))

        # the word is put in first, so that a term is never read as a pattern
        def query(r: Column, text: Column) -> Column:
            return F.struct(F.replace(text, F.lit("{t}"), F.col("term")).alias("query"), r["weight"].alias("weight"))

        if name not in words:
            return F.transform(rows, lambda r: query(r, r["pattern"]))
        return F.flatten(F.transform(words[name], lambda w: F.transform(rows, lambda r: query(r, F.replace(r["pattern"], F.lit("{m}"), w)))))

    every = F.filter(F.concat(*[part(name) for name in rules.INTENT_QUERIES]), lambda q: F.length(F.trim(q["query"])) >= rules.INTENT_QUERY_CHARS)
    placed = F.transform(every, lambda q, i: F.struct((-q["weight"]).alias("w"), i.alias("i"), q["query"].alias("query"), q["weight"].alias("weight")))
    kept = F.slice(distinct_by(F.array_sort(placed), lambda q: F.lower(F.trim(q["query"]))), 1, limit)
    rows = intents.withColumn("kind", kind).withColumn("term", term)
    return rows.select("intent_id", F.posexplode(kept).alias("ord", "q")).select("intent_id", (F.col("ord") + 1).alias("ord"), "q.query", "q.weight")


def exclusion_queries(queries: DataFrame) -> DataFrame:
    """Queries (intent_id, ord, query) that ask for the same without pages that only explain."""
    return queries.select("intent_id", "ord", F.concat("query", F.lit(rules.EXCLUSION_SUFFIX)).alias("query"))


def transactional_queries(intents: DataFrame) -> DataFrame:
    """Queries of buyers for intents(intent_id, business_type, term): (intent_id, ord, query)."""
    table = constant(rules.TRANSACTIONAL, "map<string, array<string>>")
    kind = (
        F.when(F.col("business_type").isin("ecommerce", "tienda"), "ecommerce")
        .when(F.col("business_type").isin("saas", "software"), "saas")
        .when(F.col("business_type").isin("agencia", "agency"), "agencia")
        .otherwise("other")
    )
    texts = F.transform(F.try_element_at(table, kind), lambda p: F.replace(p, F.lit("{t}"), F.col("term")))
    return intents.select("intent_id", F.posexplode(texts).alias("ord", "query"))


def competitor_queries(names: DataFrame) -> DataFrame:
    """Queries that find competitors of names(id, name)."""
    texts = F.transform(constant(rules.COMPETITOR, NO_TEXTS), lambda p: F.replace(p, F.lit("{t}"), F.col("name")))
    return names.select("id", F.posexplode(texts).alias("ord", "query"))


def geo_queries(queries: DataFrame, intents: DataFrame) -> DataFrame:
    """The first three queries of an intent again with "city region country", unless that text is already asked."""
    tag = F.concat_ws(" ", *[F.nullif(F.col(f"location.{p}"), F.lit("")) for p in ("city", "region", "country")])
    places = intents.select("intent_id", tag.alias("tag")).filter("tag <> ''")
    local = queries.filter("ord <= 3").join(places, "intent_id").select(
        "intent_id", F.col("ord").alias("ord"), F.concat_ws(" ", "query", "tag").alias("query")
    )
    return local.join(queries.select("intent_id", "query"), ["intent_id", "query"], "left_anti").select("intent_id", "ord", "query")


def indicator_lists(intents: DataFrame) -> DataFrame:
    """Words for and against a page of intents(intent_id, business_type, niche, place, main_keywords, industry)."""
    words = constant(rules.VALIDATION_WORDS, "map<string, array<string>>")
    kind = F.lit("other")
    for name, types in rules.INDICATOR_TYPES.items():
        kind = F.when(F.lower("business_type").isin(types), name).otherwise(kind)
    none = F.array().cast(NO_TEXTS)
    niche = F.coalesce(F.try_element_at(constant(rules.NICHE_WORDS, "map<string, array<string>>"), F.col("niche")), none)
    place = F.concat(F.array("place"), constant(rules.LOCATION_WORDS, NO_TEXTS))
    good = F.concat(
        F.try_element_at(words, F.col("kind")),
        F.when(F.col("kind") == "ecommerce", niche).otherwise(none),
        F.when((F.col("kind") == "agencia") & (F.coalesce("place", F.lit("")) != ""), place).otherwise(none),
        F.coalesce("main_keywords", none),
        F.filter(F.array("industry"), lambda w: w.isNotNull()),
    )
    bad = F.when(F.col("kind") == "blog", constant(rules.BLOG_EXCLUSION_WORDS, NO_TEXTS)).otherwise(constant(rules.EXCLUSION_WORDS, NO_TEXTS))
    return intents.withColumn("kind", kind).select(
        "intent_id", good.alias("validation_indicators"), bad.alias("exclusion_indicators")
    )


def buyer_prompt(products: DataFrame) -> DataFrame:
    """A buyer's prompt from products(id, text): the sector and the first place it names."""
    low = F.lower("text")
    place = F.regexp_extract(low, rf"(?U)\b({rules.PLACES})\b", 1)
    sector = F.coalesce(_first_label(low, rules.SECTORS), F.lit(rules.DEFAULT_SECTOR))
    tail = F.when(place != "", F.concat(F.lit(" en "), place)).otherwise("")
    return products.select("id", F.concat(sector, F.lit(rules.BUYER_PROMPT), tail).alias("prompt"))


def clean_prompt(text: Column) -> Column:
    """Model-written prompt without code fence, label, arrow, wrapping quotes; at most 200 characters, whole words."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?s)^```.*?```$", ""))
    bare = F.trim(F.regexp_replace(bare, r"(?i)^(?:prompt\s*[:→-]?\s*|→\s*|-\s*)", ""))
    bare = F.trim(F.regexp_replace(bare, r"""^["'](.+)["']$""", "$1"))
    return let(
        bare,
        lambda t: F.when(F.length(t) > rules.PROMPT_MAX, F.regexp_replace(F.left(t, F.lit(rules.PROMPT_MAX)), " [^ ]*$", "")).otherwise(t),
    )


# --- clean-up of query tables -----------------------------------------------------------------------------------


def dedupe_keep_order(values: Column) -> Column:
    """A list without blanks and without repeats that differ only in case or outer blanks; first ones stay."""
    filled = F.filter(values, lambda v: F.trim(v) != "")
    return distinct_by(filled, lambda v: F.lower(F.trim(v)))


def canonical_query(query: Column) -> Column:
    """The set of a query's meaningful words as one text: no quotes, operators, short words or stopwords."""
    text = F.regexp_replace(F.lower(query), "[\"'`]", " ")
    text = F.regexp_replace(text, rf"(?U)\b({rules.QUERY_OPERATORS}):", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s-]", " ")
    words = F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(rules.STOPWORDS))
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def unwrapped(query: Column) -> Column:
    """The query without a quote pair that wraps it whole; quotes of phrases inside it stay."""
    def without(quote: str):
        def body(t: Column) -> Column:
            whole = (
                (F.length(t) >= 2)
                & F.startswith(t, F.lit(quote))
                & F.endswith(t, F.lit(quote))
                & (F.regexp_count(t, F.lit(quote)) == 2)
            )
            return F.when(whole, F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)

        return body

    text = F.trim(query)
    for quote in ('"', "'", "`"):
        text = let(text, without(quote))
    return text


def names_refused(query: Column, refused: Column) -> Column:
    """Whether the query names a refused technology in the positive; "-name" anywhere is a wanted exclusion."""
    def bad(name: Column, padded: Column) -> Column:
        t = F.lower(F.trim(name))
        excluded = F.contains(F.replace(padded, F.lit(" "), F.lit("")), F.concat(F.lit("-"), t)) | F.contains(
            padded, F.concat(F.lit(" -"), t)
        )
        said = F.rlike(padded, F.concat(F.lit(r"(?U)(?<![\w-])\Q"), t, F.lit(r"\E(?!\w)")))
        return (t != "") & ~excluded & said

    names = F.coalesce(refused, F.array().cast(NO_TEXTS))
    padded = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    return let(padded, lambda q: F.exists(names, lambda name: bad(name, q)))


def dedupe_queries(queries: DataFrame) -> DataFrame:
    """First query of each canonical form per intent; queries without any meaningful word are dropped."""
    keyed = queries.withColumn("canonical", canonical_query(F.col("query"))).filter("canonical <> ''")
    return keyed.groupBy("intent_id", "canonical").agg(F.min_by("query", "ord").alias("query"), F.min("ord").alias("ord")).select(
        "intent_id", "ord", "query"
    )


def post_process_queries(queries: DataFrame, intents: DataFrame, limit: int = rules.QUERIES_MAX) -> DataFrame:
    """Cleaned queries of an intent: unwrapped, long enough, no instruction leftovers, no refused technology, first of
    each canonical form, capped: (intent_id, rank, query)."""
    low = F.lower("query")
    leftover = let(low, lambda q: F.exists(constant(rules.SKIP_PREFIXES, NO_TEXTS), lambda p: F.startswith(q, p)))
    rows = (
        queries.withColumn("query", unwrapped(F.col("query")))
        .filter((F.length("query") >= rules.QUERY_MIN_CHARS) & ~leftover)
        .join(intents.select("intent_id", F.col("must_not").alias("_refused")), "intent_id", "left")
        .filter(~names_refused(F.col("query"), F.col("_refused")))
        .drop("_refused")
    )
    return ranked(dedupe_queries(rows), ["intent_id"], [F.col("ord")], limit).select("intent_id", "rank", "query")


def parse_intent_rows(raw: DataFrame) -> DataFrame:
    """Model output (id, text) to typed intents: code fences stripped, outermost braces parsed, defaults for what is missing.

    Empty texts count as missing; lists that are none, as empty. A location that is no object has no country, region and
    city. The notes begin with the cleaned prompt, where the model gave one. Text without a JSON object yields a row of
    defaults with parsed = false.
    """
    body = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    data = F.try_parse_json(body)

    def text(name: str, default: str | None = None) -> Column:
        return F.coalesce(F.nullif(F.try_variant_get(F.col("v"), f"$.{name}", "string"), F.lit("")), F.lit(default))

    def texts(name: str) -> Column:
        return F.coalesce(F.try_variant_get(F.col("v"), f"$.{name}", "array<string>"), F.array().cast(NO_TEXTS))

    must_have, targets = texts("must_have"), texts("target_techs")
    cleaned = F.concat(F.lit(rules.CLEANED_NOTE), text("prompt_depurado"))
    return raw.select("id", data.alias("v")).select(
        "id",
        F.col("v").isNotNull().alias("parsed"),
        F.lower(text("business_type", rules.UNKNOWN_TYPE)).alias("business_type"),
        text("product_category").alias("product_category"),
        text("service_type").alias("service_type"),
        text("niche").alias("niche"),
        F.struct(*[text(f"location.{p}").alias(p) for p in ("country", "region", "city")]).alias("location"),
        text("target_audience").alias("target_audience"),
        text("language", "es").alias("language"),
        texts("search_queries").alias("search_queries"),
        must_have.alias("must_have"),
        texts("must_not").alias("must_not"),
        F.when(F.size(targets) > 0, targets).otherwise(must_have).alias("target_techs"),
        texts("validation_indicators").alias("validation_indicators"),
        texts("exclusion_indicators").alias("exclusion_indicators"),
        F.concat_ws(" | ", cleaned, text("analysis_notes")).alias("analysis_notes"),
        F.coalesce(F.try_variant_get(F.col("v"), "$.confidence", "double"), F.lit(rules.CONFIDENCE)).alias("confidence"),
    )
