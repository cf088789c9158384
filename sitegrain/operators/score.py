"""Scores of candidates: snippet, page content, performance, and the confidence they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.patterns import count_found, points_found, words_in
from sitegrain.operators.funnel import alive_reason
from sitegrain.operators.jsonld import schema_score, with_schema_facts
from sitegrain.operators.structure import with_meta_words
from sitegrain.rules import score as rules


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def _hits(words: Column, text: Column) -> Column:
    return F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.contains(text, F.lower(w)))


def snippet_score(candidates: DataFrame, intents: DataFrame) -> DataFrame:
    """Adds ``snippet_score`` (0-100) from title and snippet against the intent's words."""
    words = intents.select("intent_id", F.col("validation_indicators").alias("_good"), F.col("exclusion_indicators").alias("_bad"))
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit(""))))
    weight_info, info = rules.SNIPPET_INFORMATIONAL
    weight_business, business = rules.SNIPPET_BUSINESS
    score = (
        F.lit(rules.BASE_SCORE)
        + F.size(_hits(F.col("_good"), F.col("_text"))) * rules.VALIDATION_HIT
        + F.size(_hits(F.col("_bad"), F.col("_text"))) * rules.EXCLUSION_HIT
        + count_found(F.col("_text"), F.col("_text"), info) * weight_info
        + count_found(F.col("_text"), F.col("_text"), business) * weight_business
    )
    joined = candidates.join(words, "intent_id", "left").withColumn("_text", text)
    return joined.withColumn("snippet_score", _clamp(score)).drop("_good", "_bad", "_text")


def type_points(low: Column, kind: str) -> Column:
    """Points of a page's words and markup for one business type."""
    weight, words = rules.TYPE_WORDS[kind]
    return F.size(words_in(low, words)) * weight + points_found(low, rules.TYPE_PATTERNS[kind])


def info_penalty(low: Column) -> Column:
    return F.least(points_found(low, rules.INFO_PENALTIES), F.lit(rules.INFO_PENALTY_MAX))


def type_scores(pages: DataFrame) -> DataFrame:
    """(page_id, ecommerce, saas, agencia, other, info_penalty): page points that do not depend on an intent."""
    low = F.col("low")
    return pages.select("page_id", F.lower("html").alias("low")).select(
        "page_id", *[type_points(low, kind).alias(kind) for kind in rules.TYPE_WORDS], info_penalty(low).alias("info_penalty")
    )


def type_score(candidates: DataFrame, pages: DataFrame, intents: DataFrame) -> DataFrame:
    """(intent_id, page_id, type_score) for candidate pages under their intent's business type."""
    kind = F.coalesce("business_type", F.lit(""))
    points = F.col("other")
    for name in ("ecommerce", "saas", "agencia"):
        points = F.when(kind == name, F.col(name)).otherwise(points)
    return (
        candidates.select("intent_id", "page_id")
        .join(intents.select("intent_id", "business_type"), "intent_id")
        .join(type_scores(pages), "page_id")
        .select("intent_id", "page_id", points.alias("type_score"))
    )


def _content_points(kind: Column, low: Column) -> Column:
    """Type points under the row's own business type; only that type's words are looked for."""
    points = type_points(low, "other")
    for name in ("ecommerce", "saas", "agencia"):
        points = F.when(kind == name, type_points(low, name)).otherwise(points)
    return points


def content_score(candidates: DataFrame, pages: DataFrame, intents: DataFrame) -> DataFrame:
    """(intent_id, page_id, url, content_score, keywords, JSON-LD flags, alive_reason) of candidate pages.

    The candidate pages are picked from the page table by page id: Spark broadcasts the candidates while their
    measured size allows it and shuffles otherwise. Everything that reads html happens right behind that one join, in
    the same stage, and html is dropped there.
    """
    wanted = candidates.select("intent_id", "page_id", "url").join(
        intents.select("intent_id", "business_type", "product_category", "service_type", "niche", "validation_indicators"),
        "intent_id",
    )
    kind = F.coalesce("business_type", F.lit(""))
    low = F.col("low")

    def on_page(column: str) -> Column:
        return F.when(F.coalesce(column, F.lit("")) != "", F.contains(low, F.lower(column))).otherwise(F.lit(False))

    read = with_meta_words(with_schema_facts(pages.select("page_id", "html").join(wanted, "page_id")))
    rows = read.withColumn("low", F.lower("html")).select(
        "intent_id",
        "page_id",
        "url",
        "business_type",
        "product_category",
        "service_type",
        "niche",
        "facts",
        "meta_keywords",
        "og_type",
        _content_points(kind, low).alias("type_points"),
        info_penalty(low).alias("penalty"),
        on_page("product_category").alias("has_category"),
        on_page("service_type").alias("has_service"),
        on_page("niche").alias("has_niche"),
        _hits(F.col("validation_indicators"), low).alias("indicators"),
        F.col("html").isNull().alias("missing"),
        alive_reason(F.col("html"), low).alias("alive_reason"),
    )

    def named(names: str, wanted_name: str) -> Column:
        found_name = F.exists(names, lambda n: F.contains(F.lower(n), F.lower(wanted_name)))
        return (F.coalesce(wanted_name, F.lit("")) != "") & found_name

    def points(condition: Column, weight: int) -> Column:
        return F.when(condition, weight).otherwise(0)

    flag = {f: F.coalesce(F.col(f"facts.{f}"), F.lit(False)) for f in ("is_ecommerce", "is_software", "is_service_business", "is_blog")}
    confirmed = (
        ((kind == "ecommerce") & flag["is_ecommerce"])
        | ((kind == "saas") & flag["is_software"])
        | ((kind == "agencia") & flag["is_service_business"])
    )
    score = (
        F.lit(rules.BASE_SCORE)
        + F.when(F.col("facts").isNotNull(), schema_score(kind)).otherwise(0)
        + F.col("type_points")
        + points(confirmed, rules.LD_CONFIRMS_TYPE)
        + points(F.col("has_category"), rules.CATEGORY_ON_PAGE)
        + points(named("facts.product_names", "product_category"), rules.NAMED_IN_LD)
        + points(F.col("has_service"), rules.SERVICE_ON_PAGE)
        + points(named("facts.service_types", "service_type"), rules.NAMED_IN_LD)
        + points(F.col("has_niche"), rules.NICHE_ON_PAGE)
        - F.col("penalty")
        + points(flag["is_blog"] & (kind != "blog"), rules.BLOG_PENALTY)
    )
    none = F.array().cast("array<string>")
    keywords = F.concat(
        F.coalesce("meta_keywords", none),
        F.array_compact(F.array(F.concat(F.lit("og:"), F.col("og_type")))),
        F.coalesce(F.transform(F.slice("facts.types", 1, 3), lambda t: F.concat(F.lit("schema:"), t)), none),
        F.array_compact(
            F.array(*[F.when(F.col(hit), F.col(name)) for hit, name in
                      (("has_category", "product_category"), ("has_service", "service_type"), ("has_niche", "niche"))])
        ),
        F.col("indicators"),
    )
    return rows.select(
        "intent_id",
        "page_id",
        "url",
        F.when(F.col("missing"), rules.MISSING_PAGE_SCORE).otherwise(_clamp(score)).alias("content_score"),
        F.when(F.col("missing"), none).otherwise(keywords).alias("keywords"),
        *[value.alias(name) for name, value in flag.items()],
        "alive_reason",
    )


def confidence(snippets: DataFrame, contents: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    """Confidence of candidates: 0.3 snippet + 0.4 content + 10 + (0.1 performance or 5), with the reasons.

    snippets carry intent_id, page_id, domain, url, title and snippet_score; contents come from ``content_score``;
    performance(page_id, performance_score) is optional. A candidate whose page is not stored scores 30 for content.
    """
    rows = snippets.join(contents.drop("url"), ["intent_id", "page_id"], "left")
    if performance is None:
        rows = rows.withColumn("performance_score", F.lit(None).cast("double"))
    else:
        rows = rows.join(performance.select("page_id", "performance_score"), "page_id", "left")
    content = F.coalesce("content_score", F.lit(rules.MISSING_PAGE_SCORE))
    speed = F.col("performance_score")
    total = F.col("snippet_score") * 0.3 + content * 0.4 + 10 + F.coalesce(speed * 0.1, F.lit(5.0))

    def scored(name: str, score: Column) -> Column:
        return F.concat(F.lit(f"{name} (score: "), F.bround(score).cast("int").cast("string"), F.lit(")"))

    kind = F.coalesce("business_type", F.lit(""))
    good = F.array_compact(
        F.array(
            F.when(F.col("snippet_score") > 50, scored("Snippet relevante", F.col("snippet_score"))),
            F.when(content > 50, scored("Contenido relevante", content)),
            F.when(F.col("is_ecommerce") & (kind == "ecommerce"), F.lit("Schema.org confirma ecommerce"))
            .when(F.col("is_software") & kind.isin("saas", "software"), F.lit("Schema.org confirma software"))
            .when(F.col("is_service_business") & kind.isin("agencia", "agency"), F.lit("Schema.org confirma servicios")),
            F.when(speed > 50, scored("Métricas de rendimiento OK", speed)),
        )
    )
    bad = F.array_compact(
        F.array(
            F.when(F.col("snippet_score") <= 50, scored("Snippet poco relevante", F.col("snippet_score"))),
            F.when(content <= 50, scored("Contenido poco relevante", content)),
        )
    )
    return rows.select(
        "intent_id",
        "domain",
        "page_id",
        "url",
        "title",
        "snippet_score",
        content.alias("content_score"),
        F.least(F.round(total, 6), F.lit(100.0)).alias("confidence"),
        (F.round(total, 6) >= rules.VALID_CONFIDENCE).alias("is_valid"),
        good.alias("reasons"),
        bad.alias("rejections"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("alive_reason", F.lit("empty_html")).alias("alive_reason"),
    )


def score_candidates(candidates: DataFrame, pages: DataFrame, intents: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    """Snippet, content and confidence of candidates in one step."""
    with_kind = candidates.join(intents.select("intent_id", "business_type"), "intent_id", "left")
    return confidence(snippet_score(with_kind, intents), content_score(candidates, pages, intents), performance)


def performance_score(metrics: DataFrame, intents: DataFrame) -> DataFrame:
    """(intent_id, id, performance_score) from speed class and mobile check against what the intent wants."""
    wanted = F.lower(F.coalesce("wanted_speed", F.lit("")))
    slow = F.contains(wanted, F.lit("lenta")) | F.contains(wanted, F.lit("slow"))
    fast = F.contains(wanted, F.lit("rápida")) | F.contains(wanted, F.lit("fast"))
    speed = F.col("performance_category")
    by_speed = (
        F.when((wanted != "") & slow, F.when(speed == "slow", 40).when(speed == "average", 20).otherwise(0))
        .when((wanted != "") & fast, F.when(speed == "fast", 40).when(speed == "average", 20).otherwise(0))
        .otherwise(0)
    )
    by_mobile = F.when(F.col("check_mobile"), F.when(F.col("is_mobile_friendly"), 20).otherwise(-10)).otherwise(0)
    score = F.when(F.col("analysis_success"), _clamp(F.lit(rules.BASE_SCORE) + by_speed + by_mobile)).otherwise(rules.BASE_SCORE)
    return metrics.join(intents.select("intent_id", "wanted_speed", "check_mobile"), "intent_id").select(
        "intent_id", "id", score.alias("performance_score")
    )
