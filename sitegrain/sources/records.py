"""Collected records as sources: search answers, detector output, page metrics, side files, infrastructure, lists.

Fetching is not done here; the answers of such tools arrive as tables of JSON text or facts. Text that does not parse
yields no rows instead of failing the job.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions.ordering import numbered
from sitegrain.functions.patterns import constant, constant_map
from sitegrain.functions.urls import host_of
from sitegrain.rules import records as rules


def serp_candidates(raw: DataFrame) -> DataFrame:
    """Search answers (id, query, json) to candidates. Positions count every item, also the dropped ones without link."""
    item = "struct<link: string, title: string, snippet: string, sitelinks: array<struct<title: string, link: string>>>"
    answers = F.from_json("json", f"struct<organic: array<{item}>>")
    rows = raw.select("id", "query", F.posexplode(answers["organic"]).alias("idx", "item"))
    return rows.filter(F.coalesce("item.link", F.lit("")) != "").select(
        "id",
        "query",
        (F.col("idx") + 1).alias("position"),
        F.col("item.link").alias("url"),
        host_of(F.col("item.link")).alias("domain"),
        F.coalesce("item.title", F.lit("")).alias("title"),
        F.coalesce("item.snippet", F.lit("")).alias("snippet"),
        F.coalesce("item.sitelinks", F.array().cast("array<struct<title:string,link:string>>")).alias("sitelinks"),
    )


def tech_detections(raw: DataFrame) -> DataFrame:
    """Detector output (id, json) to (id, pos, tech, categories, version, confidence).

    The first line that is a JSON object counts, else the whole text. Names stand in "tech", "technologies", "apps"
    or a bare list, as text or as objects.
    """
    lines = F.filter(F.split("json", "\n"), lambda x: F.startswith(F.trim(x), F.lit("{")))
    parsed = F.filter(F.transform(lines, lambda x: F.try_parse_json(F.trim(x))), lambda v: v.isNotNull())
    data = F.coalesce(F.get(parsed, F.lit(0)), F.try_parse_json("json"))

    def items(path: str) -> Column:
        return F.try_variant_get(F.col("data"), path, "array<variant>")

    has_tech = F.try_variant_get(F.col("data"), "$.tech", "variant").isNotNull()
    listed = F.when(has_tech, items("$.tech")).otherwise(F.coalesce(items("$.technologies"), items("$.apps"), items("$")))
    rows = raw.select("id", data.alias("data")).select("id", F.posexplode(listed).alias("pos", "item"))
    item = F.col("item")
    is_object = F.schema_of_variant(item).startswith("OBJECT")

    def field(name: str, kind: str = "string") -> Column:
        return F.when(is_object, F.try_variant_get(item, f"$.{name}", kind))

    plain = F.when(F.schema_of_variant(item) == "STRING", F.trim(F.try_variant_get(item, "$", "string")))
    several = field("categories", "array<string>")
    single = F.filter(F.array(field("categories")), lambda c: c.isNotNull())
    return rows.select(
        "id",
        "pos",
        F.coalesce(plain, field("name"), field("app")).alias("tech"),
        F.coalesce(several, single).alias("categories"),
        field("version").alias("version"),
        F.coalesce(field("confidence", "int"), F.lit(100)).alias("confidence"),
    ).filter(F.coalesce("tech", F.lit("")) != "")


_AUDIT = "struct<title: string, description: string, score: double, displayValue: string, numericValue: double, numericUnit: string>"
_ITEM = "struct<entity: string, transferSize: double, blockingTime: double, mainThreadTime: double>"
_REPORT = (
    "struct<lighthouseResult: struct<categories: map<string, struct<score: double>>, audits: map<string, " + _AUDIT + ">>, "
    "loadingExperience: struct<overall_category: string, metrics: map<string, struct<percentile: double, category: string>>>>"
)


def lighthouse_metrics(raw: DataFrame) -> DataFrame:
    """Page metric reports (id, json) to one row of metrics. Scores are 0-100, times in seconds, blocking times in ms."""
    report = raw.select("id", F.from_json("json", _REPORT).alias("r")).select(
        "id", F.col("r.lighthouseResult.categories").alias("categories"), F.col("r.lighthouseResult.audits").alias("audits")
    )

    def score(name: str) -> Column:
        return F.bround(F.try_element_at("categories", F.lit(name))["score"] * 100, 1)

    def value(name: str) -> Column:
        return F.try_element_at("audits", F.lit(name))["numericValue"]

    def passed(name: str, least: float) -> Column:
        return F.coalesce(F.try_element_at("audits", F.lit(name))["score"] >= least, F.lit(False)).cast("int")

    rows = report.select(
        "id",
        score("performance").alias("performance_score"),
        score("seo").alias("seo_score"),
        score("accessibility").alias("accessibility_score"),
        score("best-practices").alias("best_practices_score"),
        F.bround(value("largest-contentful-paint") / 1000, 2).alias("lcp"),
        F.bround(value("first-contentful-paint") / 1000, 2).alias("fcp"),
        F.bround(value("cumulative-layout-shift"), 3).alias("cls"),
        F.bround(value("total-blocking-time"), 0).alias("total_blocking_time"),
        F.bround(value("speed-index") / 1000, 2).alias("speed_index"),
        F.bround(value("interactive") / 1000, 2).alias("time_to_interactive"),
        F.bround(value("server-response-time"), 0).alias("ttfb"),
        (passed("viewport", 1) + passed("tap-targets", 0.9) + passed("font-size", 0.9) >= 2).alias("is_mobile_friendly"),
        F.col("categories").isNotNull().alias("analysis_success"),
    )
    speed = F.col("performance_score")
    return rows.withColumn(
        "performance_category",
        F.when(speed.isNull(), "unknown").when(speed >= 90, "fast").when(speed >= 50, "average").otherwise("slow"),
    )


def lighthouse_scores(raw: DataFrame) -> DataFrame:
    """The short projection of the metrics."""
    return lighthouse_metrics(raw).select(
        "id", "performance_score", "seo_score", "is_mobile_friendly", "performance_category", "analysis_success"
    )


def normalize_categories(names: Column) -> Column:
    """Requested audit categories as known names in order, each once; none, unknown only, or "all" mean every one."""
    every = F.array(*[F.lit(c) for c in rules.AUDITS])
    synonyms = constant_map(rules.CATEGORY_SYNONYMS)
    plain = F.transform(
        F.coalesce(names, F.array().cast("array<string>")), lambda n: F.translate(F.lower(F.trim(n)), "- ", "__")
    )
    known = F.transform(plain, lambda n: F.coalesce(F.try_element_at(synonyms, n), n))
    kept = F.array_distinct(F.filter(known, lambda n: F.array_contains(every, n)))
    return F.when(F.array_contains(plain, "all") | (F.size(kept) == 0), every).otherwise(kept)


def lighthouse_audits(raw: DataFrame) -> DataFrame:
    """Audits of the requested categories: (id, category, audit, title, description, score, display, value, unit).

    raw(id, json, categories) asks per report; the third-party category is answered by ``third_party_items``.
    """
    table = constant(rules.AUDITS, "map<string, array<string>>")
    wanted = F.filter(normalize_categories(F.col("categories")), lambda c: c != "third_party")
    rows = (
        raw.select("id", F.from_json("json", _REPORT)["lighthouseResult"]["audits"].alias("audits"), F.explode(wanted).alias("category"))
        .select("id", "category", "audits", F.explode(F.try_element_at(table, F.col("category"))).alias("audit"))
        .select("id", "category", "audit", F.try_element_at("audits", F.col("audit")).alias("a"))
        .filter("a IS NOT NULL")
    )
    return rows.select(
        "id",
        "category",
        "audit",
        F.col("a.title").alias("title"),
        F.left(F.coalesce("a.description", F.lit("")), F.lit(rules.DESCRIPTION_MAX)).alias("description"),
        F.col("a.score").alias("score"),
        F.col("a.displayValue").alias("display"),
        F.col("a.numericValue").alias("value"),
        F.col("a.numericUnit").alias("unit"),
    )


def third_party_items(raw: DataFrame) -> DataFrame:
    """The third parties of a report: (id, pos, entity, transfer_size, blocking_time, main_thread_time)."""
    report = F.try_parse_json("json")
    items = F.try_variant_get(report, "$.lighthouseResult.audits['third-party-summary'].details.items", "array<variant>")
    rows = raw.select("id", F.posexplode(items).alias("pos", "item"))

    def number(name: str) -> Column:
        return F.try_variant_get(F.col("item"), f"$.{name}", "double")

    entity = F.coalesce(
        F.try_variant_get(F.col("item"), "$.entity.text", "string"), F.try_variant_get(F.col("item"), "$.entity", "string")
    )
    return rows.select(
        "id",
        "pos",
        entity.alias("entity"),
        number("transferSize").alias("transfer_size"),
        number("blockingTime").alias("blocking_time"),
        number("mainThreadTime").alias("main_thread_time"),
    )


def field_metrics(raw: DataFrame) -> DataFrame:
    """Field data of a report: (id, metric, percentile, category) under the short metric names."""
    names = constant_map(rules.FIELD_METRICS)
    metrics = F.from_json("json", _REPORT)["loadingExperience"]["metrics"]
    rows = raw.select("id", F.explode(metrics).alias("key", "m")).filter("m IS NOT NULL")
    return rows.select(
        "id",
        F.coalesce(F.try_element_at(names, F.col("key")), F.lower("key")).alias("metric"),
        F.col("m.percentile").alias("percentile"),
        F.col("m.category").alias("category"),
    )


def site_files(files: DataFrame) -> DataFrame:
    """Side files (domain, path, status, body) to facts per site: best sitemap with its URL count, ads.txt, robots.txt.

    Only the facts of a file meet the per-site aggregation, never its body.
    """
    order = constant({p: i for i, p in enumerate(rules.SITEMAP_PATHS)}, "map<string,int>")
    body = F.coalesce("body", F.lit(""))
    good = files.filter(F.col("status").between(200, 399)).select(
        "domain",
        "path",
        F.try_element_at(order, F.col("path")).alias("priority"),
        F.regexp_count(body, F.lit("<loc>[^<]+</loc>")).alias("urls"),
        ((F.col("path") == "/ads.txt") & (F.length(body) > rules.ADS_MIN_CHARS)).alias("ads"),
        ((F.col("path") == "/ads.txt") & (F.length(body) > rules.ADS_MIN_CHARS) & F.contains(F.lower(body), F.lit("google.com"))).alias("ads_google"),
        ((F.col("path") == "/robots.txt") & (F.length(body) > rules.ROBOTS_MIN_CHARS)).alias("robots"),
    )
    sitemap = F.when((F.col("urls") > 0) & F.col("priority").isNotNull(), F.col("priority"))
    return good.groupBy("domain").agg(
        F.min_by("path", sitemap).alias("sitemap_path"),
        F.min_by("urls", sitemap).alias("sitemap_urls"),
        F.bool_or("ads").alias("has_ads_txt"),
        F.bool_or("ads_google").alias("has_google_ads_txt"),
        F.bool_or("robots").alias("has_robots_txt"),
    )


def infra_facts(observations: DataFrame, as_of: str) -> DataFrame:
    """Observations (domain, kind, value, pref) to facts per site on a date.

    kinds: whois (registration date), registrar, mx (host, pref), ssl (expiry date), issuer, ip. Of several mail hosts
    the first matching provider rule wins over all hosts; without one the preferred host stands for itself.
    """
    kind, value = F.col("kind"), F.col("value")
    today = F.to_date(F.lit(as_of))

    def of(name: str, column: Column = value) -> Column:
        return F.when(kind == name, column)

    date = F.coalesce(
        *[F.try_to_date(value, fmt) for fmt in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd-MMM-yyyy", "MMM d HH:mm:ss yyyy 'GMT'")]
    )
    host = F.regexp_replace(F.lower(value), r"\.$", "")
    mail_rules = constant(
        [{"ord": i, "part": p, "label": label} for i, (p, label) in enumerate(rules.MAIL_PROVIDERS)],
        "array<struct<ord: int, part: string, label: string>>",
    )
    mail = F.get(F.filter(mail_rules, lambda r: F.contains(host, r["part"])), F.lit(0))
    ip_rules = constant(
        [{"prefix": p, "label": label} for label, prefixes in rules.HOSTING_PREFIXES for p in prefixes],
        "array<struct<prefix: string, label: string>>",
    )
    hosting = F.get(F.filter(ip_rules, lambda r: F.startswith(value, r["prefix"])), F.lit(0))["label"]
    rows = observations.withColumns(
        {
            "date": date,
            "mail": F.when(kind == "mx", mail),
            "host": F.when(kind == "mx", host),
            "hosting": F.when(kind == "ip", hosting),
            "rank": F.struct(F.coalesce("pref", F.lit(0)), value),
        }
    )
    facts = rows.groupBy("domain").agg(
        F.min(of("whois", F.col("date"))).alias("registered"),
        F.min(of("registrar", F.left(value, F.lit(60)))).alias("registrar"),
        F.min("mail").alias("mail"),
        F.min_by("host", of("mx", F.col("rank"))).alias("first_mx"),
        F.max(of("ssl", F.col("date"))).alias("ssl_expires"),
        F.min(of("issuer")).alias("ssl_issuer"),
        F.min_by("value", of("ip", F.col("rank"))).alias("hosting_ip"),
        F.min_by("hosting", of("ip", F.col("rank"))).alias("hosting_provider"),
    )
    days_left = F.datediff("ssl_expires", today)
    return facts.select(
        "domain",
        F.col("registered").cast("string").alias("registered_date"),
        F.bround(F.datediff(today, "registered") / 365.25, 1).alias("domain_age_years"),
        "registrar",
        F.coalesce("mail.label", "first_mx").alias("mx_provider"),
        (days_left > 0).alias("ssl_valid"),
        F.col("ssl_expires").cast("string").alias("ssl_expires"),
        days_left.alias("ssl_days_remaining"),
        "ssl_issuer",
        "hosting_ip",
        "hosting_provider",
    )


def read_domain_list(spark: SparkSession, path: str | list[str], cap: int | None = None, csv: bool = False) -> DataFrame:
    """(place, domain) of text files, in order: trimmed, blanks dropped, in CSV mode without lines that say "domain".

    Files come in the order of the given paths, then by name; lines as they stand in them. Places count from 1 what is
    kept, over all files, and a cap keeps the first ones: a number per range of lines is all that meets in one task.
    """
    paths = [path] if isinstance(path, str) else path
    told = [spark.read.text(p).select(F.lit(i).alias("given"), F.trim("value").alias("domain"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")) for i, p in enumerate(paths)]
    lines = functools.reduce(DataFrame.unionByName, told).filter("domain <> ''")
    if csv:
        lines = lines.filter(~F.contains(F.lower("domain"), F.lit("domain"))).withColumn("domain", F.trim(F.substring_index("domain", ",", 1)))
    kept = numbered(lines, "place", *map(F.col, ("given", "file", "block", "row"))).select("place", "domain")
    return kept.filter(F.col("place") <= cap) if cap else kept


def meets_criteria(metrics: DataFrame, criteria: dict) -> DataFrame:
    """Metrics that satisfy every criterion; a missing value or a failed analysis never does."""
    kept = metrics.filter("analysis_success")
    if "performance" in criteria:
        kept = kept.filter(F.col("performance_category") == criteria["performance"])
    bounds = [
        ("min_performance_score", "performance_score", True),
        ("min_seo_score", "seo_score", True),
        ("max_performance_score", "performance_score", False),
        ("max_lcp", "lcp", False),
        ("min_lcp", "lcp", True),
    ]
    for name, column, is_minimum in bounds:
        if name in criteria:
            limit = F.lit(criteria[name])
            kept = kept.filter(F.col(column) >= limit if is_minimum else F.col(column) <= limit)
    if "is_mobile_friendly" in criteria:
        kept = kept.filter(F.col("is_mobile_friendly") == F.lit(criteria["is_mobile_friendly"]))
    return kept
