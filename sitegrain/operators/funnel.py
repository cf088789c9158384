"""The search funnel: candidate filters, one candidate per site, budgets, ranking and caps.

Per-site and per-intent choices are map-side combined minima or ranked with a literal bound (which Spark limits per
group before the shuffle), so no site, query or intent can pile its rows up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegrain.functions import markup as m
from sitegrain.functions.patterns import contains_any, found_any
from sitegrain.functions.urls import host_suffixes
from sitegrain.rules import funnel as rules

ARRIVAL = ("query_ord", "position", "url")


def drop_blocked(candidates: DataFrame, blocklist: list[str] | DataFrame = rules.BLOCKED_HOSTS) -> DataFrame:
    """Drops candidates whose host is, or is under, a blocked host.

    A list is folded into the filter. A table of any size goes through the distinct hosts: their suffixes meet the
    table by equality, and the blocked hosts leave by an anti join.
    """
    if isinstance(blocklist, list):
        blocked = F.array(*[F.lit(h) for h in blocklist])
        return candidates.filter(~F.coalesce(F.arrays_overlap(host_suffixes(F.col("domain")), blocked), F.lit(False)))
    hosts = candidates.select("domain").distinct().withColumn("host", F.explode(host_suffixes(F.col("domain"))))
    hit = hosts.join(blocklist.select("host"), "host", "left_semi").select("domain")
    return candidates.join(hit, "domain", "left_anti")


def drop_informational(candidates: DataFrame, intents: DataFrame) -> DataFrame:
    """Drops candidates whose title or snippet reads like an article or holds one of the intent's exclusion words."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    business = candidates.filter(~contains_any(text, rules.INFORMATIONAL_WORDS))
    words = intents.select("intent_id", F.col("exclusion_indicators").alias("_excluded"))
    hit = F.exists(F.coalesce("_excluded", F.array().cast("array<string>")), lambda w: F.contains(text, F.lower(w)))
    return business.join(words, "intent_id", "left").filter(~hit).drop("_excluded")


def within_query_cap(candidates: DataFrame, cap: int = rules.RESULTS_PER_QUERY) -> DataFrame:
    """A query yields at most ``cap`` answers. ``position`` counts them, so this is a plain filter."""
    return candidates.filter(F.col("position") <= cap)


def first_per_domain(candidates: DataFrame) -> DataFrame:
    """First candidate of each (intent, site) in arrival order; a combined minimum, no window."""
    others = [c for c in candidates.columns if c not in ("intent_id", "domain")]
    first = F.min_by(F.struct(*others), F.struct(*ARRIVAL))
    return candidates.groupBy("intent_id", "domain").agg(first.alias("c")).select("intent_id", "domain", "c.*")


def coerce_max_results(value: Column) -> Column:
    """Wanted number of results from any text: not an integer -> 20, else held between 1 and 100."""
    text = F.trim(value)
    digits = F.regexp_replace(text, "^[+-]?0*", "")
    number = (
        F.when(F.startswith(text, F.lit("-")) | (digits == ""), 1)
        .when(F.length(digits) > 3, rules.MAX_RESULTS_LIMIT)
        .otherwise(F.least(digits.try_cast("int"), F.lit(rules.MAX_RESULTS_LIMIT)))
    )
    return F.when(text.rlike(r"^[+-]?\d+$"), number).otherwise(rules.MAX_RESULTS_DEFAULT)


def budget_of(max_results: Column) -> Column:
    return F.greatest(max_results * rules.BUDGET_FACTOR, F.lit(rules.BUDGET_FLOOR))


def ranked(df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """Rows numbered within their group, kept up to a literal limit: the limit is applied before the shuffle too."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= limit)


def _most_wanted(intents: DataFrame) -> int:
    """The largest number of results that an intent wants: one number, read before the plan, so that ranks carry a literal limit."""
    return max(1, intents.agg(F.max("max_results")).first()[0] or 1)


def candidate_budget(candidates: DataFrame, intents: DataFrame) -> DataFrame:
    """At most max(6 N, 60) sites per intent in arrival order, N being its wanted number of results."""
    most = max(_most_wanted(intents) * rules.BUDGET_FACTOR, rules.BUDGET_FLOOR)
    kept = ranked(first_per_domain(candidates), ["intent_id"], [F.col(c) for c in ARRIVAL], most, "arrival")
    wanted = intents.select("intent_id", budget_of(F.col("max_results")).alias("_budget"))
    return kept.join(wanted, "intent_id").filter(F.col("arrival") <= F.col("_budget")).drop("_budget")


def supplement(main: DataFrame, extra: DataFrame, intents: DataFrame) -> DataFrame:
    """Where an intent has less than half of its wanted sites, new sites of ``extra`` are appended; then the cap."""
    count = main.groupBy("intent_id").agg(F.count("*").alias("_have"))
    wanted = intents.select("intent_id", "max_results").join(count, "intent_id", "left")
    short = wanted.filter(F.coalesce("_have", F.lit(0)) < F.floor(F.col("max_results") / 2)).select("intent_id")
    fresh = first_per_domain(extra).join(short, "intent_id", "left_semi").join(
        main.select("intent_id", "domain"), ["intent_id", "domain"], "left_anti"
    )
    both = main.withColumn("source", F.lit("main")).unionByName(fresh.withColumn("source", F.lit("extra")))
    order = [F.col("source").desc(), *[F.col(c) for c in ARRIVAL]]
    kept = ranked(both, ["intent_id"], order, _most_wanted(intents))
    return kept.join(intents.select("intent_id", "max_results"), "intent_id").filter("rank <= max_results").drop("max_results")


def alive_tests(html: Column, low: Column) -> list[tuple[Column, Column]]:
    """Tests a dead page fails, in order, each with its reason. Patterns read the whole page."""
    size = F.length(html)
    titled = html.rlike(r"(?i)<title[^>]*>\s*\S") | html.rlike(r"(?i)<h1[^>]*>")
    body = m.squeeze(F.regexp_replace(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1), "<[^>]+>", " "))
    return [
        (size < rules.MIN_PAGE_CHARS, F.concat(F.lit("empty_or_tiny_html ("), size.cast("string"), F.lit("B)"))),
        (found_any(low, html, rules.PARKED), F.lit("parking_or_placeholder")),
        ((size < rules.SMALL_PAGE_CHARS) & found_any(low, html, rules.BROKEN), F.lit("broken_or_placeholder")),
        (~titled & (F.length(body) <= rules.MIN_BODY_CHARS), F.lit("no_meaningful_body")),
    ]


def _first_reason(tests: list[tuple[Column, Column]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), label) for test, label in tests], F.lit("ok"))


def alive_reason(html: Column, low: Column) -> Column:
    """"ok" for a living page, else the first reason against it."""
    return F.when(html.isNull(), F.lit("empty_html")).otherwise(_first_reason(alive_tests(html, low)))


def page_liveness(pages: DataFrame) -> DataFrame:
    """(page_id, url, alive, reason): the first failing test names the reason; status and content type come first."""
    tests = alive_tests(F.col("html"), F.lower("html"))
    if "content_type" in pages.columns:
        kind = F.lower("content_type")
        odd = (kind != "") & ~F.contains(kind, F.lit("html")) & ~F.contains(kind, F.lit("text"))
        tests.insert(0, (odd, F.concat(F.lit("non_html_content:"), F.left(kind, F.lit(40)))))
    if "status" in pages.columns:
        status = F.col("status")
        shown = F.concat(F.lit("http_"), F.coalesce(status.cast("string"), F.lit("None")))
        tests.insert(0, (F.coalesce(status >= 400, F.lit(True)), shown))
    rows = pages.select("page_id", "url", _first_reason(tests).alias("reason"))
    return rows.select("page_id", "url", (F.col("reason") == "ok").alias("alive"), "reason")


def qualify(scores: DataFrame, minimum: float = rules.MIN_CONFIDENCE) -> DataFrame:
    return scores.filter(F.col("confidence") >= minimum)


def qualify_valid(scores: DataFrame, minimum: float) -> DataFrame:
    return scores.filter(F.col("is_valid") & (F.col("confidence") >= minimum))


def best_page(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Best scored page per site: highest confidence, then the lowest page id."""
    others = [c for c in scores.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(F.col("confidence"), -F.col("page_id")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def top_sites(scores: DataFrame, n: int) -> DataFrame:
    """The n best sites of all."""
    tie = [F.col(c) for c in ("domain", "intent_id") if c in scores.columns]
    return scores.orderBy(F.col("confidence").desc(), *tie).limit(n)


def top_sites_per_intent(scores: DataFrame, intents: DataFrame) -> DataFrame:
    """The best sites of each intent, at most as many as it wants."""
    order = [F.col("confidence").desc(), F.col("domain")]
    kept = ranked(scores, ["intent_id"], order, _most_wanted(intents))
    return kept.join(intents.select("intent_id", "max_results"), "intent_id").filter("rank <= max_results").drop("max_results")


def run_stats(results: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Totals over results(domain, is_valid, confidence); site type flags(domain, is_ecommerce, is_saas, is_cms) are optional."""
    kinds = ["is_ecommerce", "is_saas", "is_cms"]
    if flags is None:
        rows = results.withColumns({k: F.lit(False) for k in kinds})
    else:
        rows = results.join(flags.select("domain", *kinds), "domain", "left")
    total, good = F.count("*"), F.count_if("is_valid")
    return rows.agg(
        total.alias("total_analyzed"),
        good.alias("valid_count"),
        (total - good).alias("invalid_count"),
        F.coalesce(F.try_divide(good * 100, total), F.lit(0.0)).alias("validation_rate"),
        F.coalesce(F.avg(F.when(F.col("is_valid"), F.col("confidence"))), F.lit(0.0)).alias("average_confidence"),
        *[F.count_if(F.col("is_valid") & F.col(k)).alias(f"{k[3:]}_count") for k in kinds],
    )


def tech_frequency(results: DataFrame, tech: DataFrame) -> DataFrame:
    """How many of the result sites use each technology of the four platform categories, most frequent first."""
    shown = tech.filter(F.col("category").isin("cms", "ecommerce", "frameworks", "analytics"))
    used = shown.select("domain", "tech").distinct().join(results.select("domain").distinct(), "domain", "left_semi")
    return used.groupBy("tech").agg(F.count("*").alias("sites")).orderBy(F.col("sites").desc(), "tech")


def domains_only(results: DataFrame, only_valid: bool = True) -> DataFrame:
    kept = results.filter("is_valid") if only_valid else results
    return kept.select("domain").distinct()


def rejection_funnel(events: DataFrame) -> DataFrame:
    """Sites rejected per phase and reason, with totals (null = all), and their share of all events."""
    counts = events.rollup("phase", "reason").agg(
        F.grouping_id().alias("level"), F.count("*").alias("sites"), F.count_if(F.col("phase") == "done").alias("passed")
    )
    return counts.withColumn("pass_rate", F.col("passed") / F.col("sites"))
