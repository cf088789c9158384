"""Technology detection: which tools a page or site uses, their categories, and requirements on them.

Page-level detection is narrow. Per-site results come from map-side combined aggregations keyed by (domain, name),
so a site that owns a large share of all pages is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions import markup as m
from sitegrain.functions.patterns import (
    BRANCHES,
    FLAGS,
    branch_rows,
    constant,
    constant_map,
    contains_any,
    dotted_words,
    found_any,
    labels_found,
    rules_hit,
)
from sitegrain.functions.urls import asset_host, host_suffixes, path_of
from sitegrain.operators import postings
from sitegrain.operators.structure import inline_of, ld_blocks, with_assets
from sitegrain.rules import tech as rules
from sitegrain.sources.pages import with_domain, with_skeleton


def _table(rows: list[tuple[str, str]]) -> Column:
    """A small fixed rule table as an array column of (ord, name, label)."""
    return constant(
        [{"ord": i, "name": a, "label": b} for i, (a, b) in enumerate(rows)],
        "array<struct<ord: int, name: string, label: string>>",
    )


# --- page-level detection ---------------------------------------------------------------------------------------


RULE_SETS = {"page": rules.FINGERPRINTS, "tools": rules.TOOL_FINGERPRINTS, "words": rules.PLATFORM_WORDS}


def with_fingerprints(pages: DataFrame, sets: tuple[str, ...] = ("page", "tools", "words")) -> DataFrame:
    """Adds ``low`` (lower-case html), ``dots`` (its dotted words) and ``prints``: (rule_set, tech, category) of each hit."""
    table = constant(
        [
            {"rule_set": name, "tech": tech, "category": category, "branches": branch_rows(patterns)}
            for name in sets
            for tech, category, patterns in RULE_SETS[name]
        ],
        f"array<struct<rule_set: string, tech: string, category: string, {BRANCHES}>>",
    )
    staged = pages.withColumn("low", F.lower("html")).withColumn("dots", dotted_words(F.col("low")))
    hits = F.transform(
        rules_hit(table, F.col("low"), F.col("html"), F.col("dots")),
        lambda r: F.struct(r["rule_set"].alias("rule_set"), r["tech"].alias("tech"), r["category"].alias("category")),
    )
    return staged.withColumn("prints", hits)


def fingerprint_rules(spark: SparkSession, sets: tuple[str, ...] = ("page", "tools", "words")) -> DataFrame:
    """The built-in rules as a table, in the form that ``detect_fingerprints`` takes."""
    rows = [(name, tech, category, list(patterns)) for name in sets for tech, category, patterns in RULE_SETS[name]]
    return spark.createDataFrame(rows, "rule_set string, tech string, category string, patterns array<string>")


def detect_fingerprints(pages: DataFrame, sets: tuple[str, ...] | DataFrame = ("page", "tools", "words")) -> DataFrame:
    """(page_id, domain, rule_set, tech, category), one row per rule that hits the page.

    Instead of names of built-in sets, a table of rules(rule_set, tech, category, patterns ARRAY<STRING>) of any size may
    be given; its posting index is made when this is called.
    """
    if isinstance(sets, DataFrame):
        return postings.fingerprints(with_domain(pages), postings.fingerprint_index(sets, pages))
    staged = with_fingerprints(with_domain(pages), sets)
    return m.rows_of(staged, "prints", "page_id", "domain").select("page_id", "domain", "item.*")


def tech_of_host(host: Column) -> Column:
    """Technology of a third-party host: the exact host first, else the first table row the host is under."""
    exact = constant_map(rules.HOST_TECH)
    suffixes = host_suffixes(host)
    under = F.filter(_table(rules.HOST_TECH), lambda r: F.array_contains(suffixes, r["name"]))
    return F.coalesce(F.try_element_at(exact, host), F.get(under, F.lit(0))["label"])


def detect_hosts(assets: DataFrame, host_tech: DataFrame | None = None) -> DataFrame:
    """Adds ``tech`` to third-party assets; assets of unknown hosts are dropped.

    With a table host_tech(ord, host, tech), the distinct hosts' suffixes meet it by equality: the exact host first,
    else the row with the least ord that the host is under.
    """
    if host_tech is not None:
        hosts = assets.select("host").distinct().withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
        rows = hosts.join(host_tech.select(F.col("host").alias("suffix"), "ord", F.col("tech").alias("of_host")), "suffix")
        # of an exact host the last row counts, as in a map; of those it is under, the first
        exact = F.col("suffix") == F.col("host")
        best = rows.groupBy("host").agg(F.coalesce(F.max_by("of_host", F.when(exact, F.col("ord"))), F.min_by("of_host", "ord")).alias("tech"))
        return assets.join(best, "host").select(*assets.columns, "tech")
    return assets.withColumn("tech", tech_of_host(F.col("host"))).filter(F.col("tech").isNotNull())


def inline_hits(inline: Column) -> Column:
    """Globals in inline scripts and signatures in comments as (kind, label, pos, snippet).

    A script's snippet shows 20 characters before and 120 after the start of the hit, a comment's is the comment; the
    same label with the same snippet is listed once per page.
    """

    table = constant(
        [{"label": label, "pattern": FLAGS + p, "branches": branch_rows([p])} for label, p in rules.INLINE_GLOBALS],
        f"array<struct<label: string, pattern: string, {BRANCHES}>>",
    )

    def global_rows(row: Column) -> Column:
        text, low = row["text"], F.lower(row["text"])

        def shown(rule: Column) -> Column:
            at = F.regexp_instr(text, rule["pattern"])
            start = F.greatest(at - 20, F.lit(1))
            return _hit(row, rule["label"], F.trim(F.substring(text, start, at + 120 - start)))

        return F.transform(rules_hit(table, low, text, low), shown)

    def comment_rows(row: Column) -> Column:
        text = row["text"]
        labels = labels_found(F.lower(text), text, rules.COMMENT_SIGNATURES)
        return F.transform(labels, lambda label: _hit(row, label, text))

    hits = F.concat(
        F.flatten(F.transform(_of_kind(inline, "js"), global_rows)),
        F.flatten(F.transform(_of_kind(inline, "comment"), comment_rows)),
    )
    return m.distinct_by(hits, lambda h: h["key"])


def _of_kind(inline: Column, kind: str) -> Column:
    return F.filter(inline, lambda r: r["kind"] == kind)


def _hit(row: Column, label: Column, snippet: Column) -> Column:
    key = F.concat_ws("\n", row["kind"], label, snippet)
    return F.struct(
        row["kind"].alias("kind"), label.alias("label"), row["pos"].alias("pos"), snippet.alias("snippet"), key.alias("key")
    )


def detect_inline(pages: DataFrame) -> DataFrame:
    """The inline hits of a page as rows: (page_id, kind, label, pos, snippet)."""
    hits = inline_hits(F.col("inline"))
    staged = pages.select("page_id", inline_of(F.col("html")).alias("inline"))
    rows = m.rows_of(staged, hits, "page_id")
    return rows.select("page_id", "item.kind", "item.label", "item.pos", "item.snippet")


def signal_columns(low: Column, html: Column) -> dict[str, Column]:
    """Retargeting pixels as a map, the missing ones, support widgets, email tools and popups of a page."""
    names = F.array(*[F.lit(name) for name, _ in rules.PIXELS])
    there = labels_found(low, html, rules.PIXELS)
    return {
        "pixels": F.map_from_arrays(names, F.transform(names, lambda n: F.array_contains(there, n))),
        "missing_pixels": F.array_except(names, there),
        "has_pixel": F.size(there) > 0,
        "support_widgets": labels_found(low, html, rules.SUPPORT_WIDGETS),
        "email_tools": labels_found(low, html, rules.EMAIL_TOOLS),
        "has_popups": found_any(low, html, [rules.POPUPS]),
    }


def marketing_signals(pages: DataFrame) -> DataFrame:
    staged = with_domain(pages).withColumn("low", F.lower("html"))
    columns = signal_columns(F.col("low"), F.col("html"))
    return staged.select("page_id", "domain", *[value.alias(name) for name, value in columns.items()])


def _first_label(low: Column, text: Column, table: list[tuple[str, str]]) -> Column:
    return F.get(labels_found(low, text, table), F.lit(0))


def shop_columns(by_tech: Column, by_pattern: Column, by_review: Column) -> dict[str, Column]:
    """Shop and review platform; a detected shop technology wins; a shop without reviews is an upsell chance."""
    platform = F.coalesce(by_tech, by_pattern)
    reviews = F.when(platform.isNotNull(), by_review)
    return {
        "is_ecommerce": platform.isNotNull(),
        "platform": platform,
        "has_reviews": reviews.isNotNull(),
        "review_platform": reviews,
        "upsell_opportunity": platform.isNotNull() & reviews.isNull(),
    }


def shop_reviews(pages: DataFrame) -> DataFrame:
    """Shop platform, review platform and the upsell flag of a page, from its technologies and its text."""
    staged = with_technologies(with_assets(with_skeleton(pages)))
    low, html = F.col("low"), F.col("html")
    shops = F.filter("known", lambda k: k["category"] == "ecommerce")
    facts = staged.select(
        "page_id",
        "domain",
        F.array_min(F.transform(shops, lambda k: k["tech"])).alias("by_tech"),
        _first_label(low, html, rules.SHOP_PLATFORMS).alias("by_pattern"),
        _first_label(low, html, rules.REVIEW_PLATFORMS).alias("by_review"),
    )
    columns = shop_columns(F.col("by_tech"), F.col("by_pattern"), F.col("by_review"))
    return facts.select("page_id", "domain", *[value.alias(name) for name, value in columns.items()])


def sample_review(pages: DataFrame) -> DataFrame:
    """First JSON-LD review with a text on the page (at most 250 characters) and its rating."""

    def as_list(node: Column) -> Column:
        return F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.array(node))

    def text(node: Column, path: str) -> Column:
        return F.try_variant_get(node, path, "string")

    def reviews(node: Column) -> Column:
        inner = F.try_variant_get(node, "$.review", "variant")
        return F.when(text(node, "$['@type']") == "Review", F.array(node)).when(inner.isNotNull(), as_list(inner))

    blocks = F.filter(F.transform(ld_blocks(F.col("html")), F.try_parse_json), lambda v: v.isNotNull())
    nodes = F.flatten(F.transform(blocks, as_list))
    found_reviews = F.flatten(F.filter(F.transform(nodes, reviews), lambda r: r.isNotNull()))
    rows = F.transform(
        found_reviews,
        lambda r: F.struct(
            F.coalesce(F.nullif(text(r, "$.reviewBody"), F.lit("")), text(r, "$.description"), F.lit("")).alias("body"),
            text(r, "$.reviewRating.ratingValue").alias("rating"),
        ),
    )
    first = F.get(F.filter(rows, lambda r: r["body"] != ""), F.lit(0))
    return (
        pages.filter(F.contains("html", F.lit("ld+json")))
        .select("page_id", first.alias("r"))
        .filter("r IS NOT NULL")
        .select("page_id", F.left("r.body", F.lit(250)).alias("sample_review"), F.col("r.rating").alias("sample_rating"))
    )


def social_anchors(links: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Social profiles among a page's links: (page_id, domain, pos, platform, url), each URL once per page.

    With targets, profiles are only wanted when a target speaks of social networks.
    """
    named = [t.lower() for t in targets or [] if t]
    if named and "all" not in named and not any(w in " ".join(named) for w in rules.SOCIAL_WORDS):
        links = links.filter(F.lit(False))
    href = F.col("href")
    suffixes = host_suffixes(asset_host(href))
    network = F.get(F.array_intersect(suffixes, F.array(*[F.lit(h) for h in rules.SOCIAL_HOSTS])), F.lit(0))
    path = path_of(F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href))
    profiles = (
        links.withColumn("network", network)
        .filter(F.col("network").isNotNull())
        .filter(~contains_any(F.lower(href), rules.SHARE_PARTS))
        .filter(F.regexp_replace(path, "^/+|/+$", "") != "")
    )
    return profiles.groupBy("page_id", "domain", F.col("href").alias("url")).agg(
        F.min("pos").alias("pos"), F.first(F.regexp_replace("network", r"\.com", "")).alias("platform")
    )


# --- categories and profiles ------------------------------------------------------------------------------------


def category_of(tech: Column) -> Column:
    """Category of a technology name: the exact name, else the first table row where one name contains the other."""
    rows = [(name, category) for category, names in rules.CATEGORY_NAMES for name in names]
    low = F.lower(tech)
    exact = constant_map(rows)
    near = F.filter(_table(rows), lambda r: F.contains(low, r["name"]) | F.contains(r["name"], low))
    known = F.coalesce(*[F.when(contains_any(low, names), F.lit(category)) for category, names in rules.KNOWN_NAMES])
    return F.coalesce(F.try_element_at(exact, low), F.get(near, F.lit(0))["label"], known)


def categorize(tech: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Adds ``category`` to every technology name, row by row: an exact name costs one map lookup.

    With a table(ord, name, category) the distinct names meet it: the exact name first, else the row with the least ord
    that holds the name or is held by it (a posting index finds those). Names are in lower case.
    """
    if table is not None:
        names = tech.select(F.lower("tech").alias("low")).distinct()
        pairs = postings.either_holds(names, "low", table.select("ord", "name", F.col("category").alias("of_name")), "name")
        exact = F.col("name") == F.col("low")
        best = pairs.groupBy("low").agg(F.coalesce(F.max_by("of_name", F.when(exact, F.col("ord"))), F.min_by("of_name", "ord")).alias("category"))
        known = F.coalesce(*[F.when(contains_any(F.col("low"), words), F.lit(category)) for category, words in rules.KNOWN_NAMES])
        best = names.join(best, "low", "left").select("low", F.coalesce("category", known).alias("category"))
        return tech.join(best, F.lower(tech["tech"]) == best["low"], "left").select(*[tech[c] for c in tech.columns if c != "category"], best["category"])
    return tech.withColumn("category", category_of(F.col("tech")))


def categories_of_detection(detections: DataFrame) -> DataFrame:
    """(id, tech, category): the detector's own categories mapped to ours, and the category by name."""
    mapped = constant_map(rules.DETECTOR_CATEGORIES)
    own = F.transform("categories", lambda c: F.try_element_at(mapped, F.lower(c)))
    every = F.array_distinct(F.array_compact(F.concat(F.coalesce(own, F.array()), F.array(category_of(F.col("tech"))))))
    return detections.select("id", "tech", F.explode(every).alias("category")).distinct()


def categorize_multi(tech: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(tech, category) for every category the name belongs to; a table(name, category) may be given, names in lower case."""
    if table is not None:
        names = tech.select("tech").distinct().withColumn("low", F.lower("tech"))
        pairs = postings.either_holds(names.select("low").distinct(), "low", table.select("name", "category"), "name")
        return names.join(pairs, "low").select("tech", "category").distinct()
    low = F.lower("tech")
    rows = [(name.lower(), category) for category, names in rules.MULTI_CATEGORIES for name in names]
    hits = F.filter(_table(rows), lambda r: F.contains(low, r["name"]) | F.contains(r["name"], low))
    labels = F.array_distinct(F.transform(hits, lambda r: r["label"]))
    return tech.select("tech").distinct().select("tech", F.explode(labels).alias("category"))


def type_flags(site_tech: DataFrame) -> DataFrame:
    """Site type flags by technology: shop (a payment tool makes one), CMS site, software service, custom built."""
    low = F.lower("tech")

    def flag(kind: str) -> Column:
        return F.bool_or(contains_any(low, rules.TYPE_NAMES[kind]))

    flags = site_tech.groupBy("domain").agg(
        (flag("ecommerce") | flag("payment")).alias("is_ecommerce"), flag("cms").alias("is_cms"), flag("saas").alias("is_saas")
    )
    return flags.withColumn("is_custom", ~F.col("is_cms") & ~F.col("is_ecommerce"))


def site_tech(detections: DataFrame) -> DataFrame:
    """Distinct (domain, tech, category) of a site; a name that differs only in case counts once, the first one by text."""
    return (
        detections.groupBy("domain", F.lower("tech").alias("key"))
        .agg(F.min("tech").alias("tech"), F.min_by("category", F.struct("tech", "category")).alias("category"))
        .drop("key")
    )


#: Parts that a site's evidence is dealt into.
SALTS = 16

CATEGORIES = [
    "cms", "ecommerce", "crm", "email_marketing", "marketing_automation", "analytics", "live_chat", "payment", "frameworks",
    "javascript_libraries", "cdn", "hosting", "security", "customer_support",
]


def tech_profile(tech: DataFrame) -> DataFrame:
    """One row per site: its technologies, one list per category, and the category flags.

    Runs on distinct (domain, tech): the lists hold rule names, so they stay short however large the site is.
    """
    wide = (
        site_tech(tech)
        .groupBy("domain")
        .agg(
            F.array_sort(F.collect_list("tech")).alias("techs"),
            *[F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("tech")))).alias(c) for c in CATEGORIES],
        )
    )
    flags = {
        "has_crm": F.size("crm") > 0,
        "has_email_marketing": (F.size("email_marketing") > 0) | (F.size("marketing_automation") > 0),
        "has_live_chat": F.size("live_chat") > 0,
        "has_analytics": F.size("analytics") > 0,
        "has_ecommerce": F.size("ecommerce") > 0,
        "has_cms": F.size("cms") > 0,
        "has_payment": F.size("payment") > 0,
    }
    return wide.withColumns(flags)


def footprint(assets: DataFrame) -> DataFrame:
    """Third-party hosts of a site as rows (domain, host, pages). Long on purpose: a site may touch any number of hosts."""
    return assets.groupBy("domain", "host").agg(F.count_distinct("page_id").alias("pages"))


def host_popularity(assets: DataFrame) -> DataFrame:
    """How many sites touch a host. Pairs are reduced first, so a popular host does not become one task."""
    return assets.select("domain", "host").distinct().groupBy("host").agg(F.count("*").alias("sites"))


# --- requirements -----------------------------------------------------------------------------------------------


def with_technologies(staged: DataFrame) -> DataFrame:
    """Adds ``known``: distinct (tech, category) of a page by fingerprint and by third-party host, in name order."""
    by_host = F.transform("assets", lambda a: tech_of_host(a["host"]))
    hosts = F.transform(F.array_compact(by_host), lambda t: F.struct(t.alias("tech"), category_of(t).alias("category")))
    prints = F.transform("prints", lambda p: F.struct(p["tech"].alias("tech"), p["category"].alias("category")))
    return with_fingerprints(staged, ("page",)).withColumn("known", F.array_sort(F.array_distinct(F.concat(prints, hosts))))


def with_evidence(staged: DataFrame) -> DataFrame:
    """Adds ``evidence``: (rank, source, blob, shown) of a page, from assets, forms, inline scripts and comments."""
    linked = F.transform(
        "assets",
        lambda a: F.struct(
            F.when(a["kind"] == "form", 1).otherwise(0).alias("rank"),
            F.when(a["kind"] == "form", "dna_form").otherwise("dna_script").alias("source"),
            F.lower(F.concat_ws(" ", a["host"], a["url"], F.coalesce(tech_of_host(a["host"]), F.lit("")))).alias("blob"),
            a["url"].alias("shown"),
        ),
    )
    inline = F.transform(
        inline_hits(F.col("inline")),
        lambda h: F.struct(
            F.when(h["kind"] == "js", 2).otherwise(3).alias("rank"),
            F.when(h["kind"] == "js", "dna_global").otherwise("dna_comment").alias("source"),
            F.lower(F.concat_ws(" ", h["label"], h["snippet"])).alias("blob"),
            h["snippet"].alias("shown"),
        ),
    )
    return staged.withColumn("inline", inline_of(F.col("html"))).withColumn("evidence", F.concat(linked, inline))


def page_detections(pages: DataFrame) -> DataFrame:
    """Technologies of pages as rows: (page_id, domain, tech, category)."""
    staged = with_technologies(with_assets(with_skeleton(pages)))
    return m.rows_of(staged, "known", "page_id", "domain").select("page_id", "domain", "item.*")


def evidence(pages: DataFrame) -> DataFrame:
    """Page evidence as rows: (page_id, domain, rank, source, blob, shown)."""
    staged = with_evidence(with_assets(with_skeleton(pages)))
    return m.rows_of(staged, "evidence", "page_id", "domain").select("page_id", "domain", "item.*")


def detected_as(known: Column, target: Column) -> Column:
    """How a site's known technologies confirm a target: the first name where either holds the other, else the
    technologies of the category the target names; null if neither."""
    mapping = constant(rules.TARGET_CATEGORIES, "map<string, array<string>>")
    low = F.lower(target)
    named = F.filter(known, lambda k: F.contains(F.lower(k["tech"]), low) | F.contains(low, F.lower(k["tech"])))
    of_kind = F.filter(known, lambda k: F.array_contains(F.try_element_at(mapping, low), k["category"]))
    names = F.array_join(F.slice(F.transform(of_kind, lambda k: k["tech"]), 1, 3), ", ")
    by_category = F.when(F.size(of_kind) > 0, F.concat(low, F.lit(": "), names))
    return F.coalesce(F.get(named, F.lit(0))["tech"], by_category)


def confirm_targets(targets: Column, known: Column, page_evidence: Column) -> Column:
    """Targets of one page as (target, found, source, evidence); the same rules as ``target_evidence``, inside a row."""
    decided = F.transform(targets, lambda t: F.struct(t.alias("target"), detected_as(known, t).alias("detected")))
    wanted = F.filter(decided, lambda d: d["detected"].isNull())

    def first_open(item: Column) -> Column:
        return F.get(F.filter(wanted, lambda d: F.contains(item["blob"], F.lower(d["target"]))), F.lit(0))["target"]

    hits = F.transform(
        page_evidence,
        lambda e: F.struct(e["rank"].alias("rank"), e["shown"].alias("shown"), e["source"].alias("source"), first_open(e).alias("hit")),
    )

    def outcome(d: Column) -> Column:
        best = F.array_min(F.filter(hits, lambda h: h["hit"] == d["target"]))
        return F.struct(
            d["target"].alias("target"),
            (d["detected"].isNotNull() | best.isNotNull()).alias("found"),
            F.when(d["detected"].isNotNull(), "detector").otherwise(best["source"]).alias("source"),
            F.coalesce(d["detected"], best["shown"]).alias("evidence"),
        )

    return F.transform(decided, outcome)


def target_evidence(targets: DataFrame, sites: DataFrame, tech: DataFrame, page_evidence: DataFrame) -> DataFrame:
    """For each (intent, site, target): whether it is confirmed, by what, and by which evidence.

    targets(intent_id, ord, target), sites(intent_id, domain), tech(domain, tech, category), page_evidence as from
    ``evidence``. Detected technologies decide first; only targets they leave open meet the page evidence, and one
    piece of evidence counts for the first open target it names.
    """
    wanted = sites.join(targets.filter(F.lower("target") != "all"), "intent_id")
    profile = site_tech(tech).groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("tech", "category"))).alias("known"))
    by_detector = wanted.join(profile, "domain", "left").select(
        "intent_id", "domain", "ord", "target", detected_as(F.col("known"), F.col("target")).alias("detected")
    )
    open_targets = (
        by_detector.filter("detected IS NULL")
        .groupBy("intent_id", "domain")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "target"))).alias("open"))
    )
    # evidence meets the words that any intent still looks for on its site, a salt of the site at a time; which of them it
    # names is all that is left of its text, so a site is reduced to its best evidence per set of words before it moves on
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt")
    words = open_targets.select("domain", F.explode("open").alias("o")).groupBy("domain").agg(F.array_sort(F.collect_set(F.lower("o.target"))).alias("words"))
    words = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = (
        page_evidence.select("domain", "rank", "source", "blob", "shown", "page_id", salt)
        .join(words, ["domain", "salt"])
        .withColumn("named", F.filter("words", lambda w: F.contains(F.col("blob"), w)))
        .filter(F.size("named") > 0)
        .groupBy("domain", "named", "salt")
        .agg(F.min(F.struct("rank", "page_id", "shown", "source")).alias("best"))
        .groupBy("domain", "named")
        .agg(F.min("best").alias("best"))
    )
    first_named = F.get(F.filter("open", lambda t: F.array_contains("named", F.lower(t["target"]))), F.lit(0))
    by_page = (
        named.join(open_targets, "domain")
        .withColumn("hit", first_named)
        .filter("hit IS NOT NULL")
        .groupBy("intent_id", "domain", F.col("hit.ord").alias("ord"))
        .agg(F.min("best").alias("best"))
    )
    return by_detector.join(by_page, ["intent_id", "domain", "ord"], "left").select(
        "intent_id",
        "domain",
        "ord",
        "target",
        (F.col("detected").isNotNull() | F.col("best").isNotNull()).alias("found"),
        F.when(F.col("detected").isNotNull(), "detector").otherwise(F.col("best.source")).alias("source"),
        F.coalesce("detected", "best.shown").alias("evidence"),
    )


def all_targets_met(found_targets: DataFrame) -> DataFrame:
    return found_targets.groupBy("intent_id", "domain").agg(F.bool_and("found").alias("all_targets_met"))


def requirement_failure(known: Column, must_have: Column, must_not: Column) -> Column:
    """Text of the first requirement that a site's technologies fail, or an empty text.

    A requirement is met by a part of a technology's name, or as a category word by any technology of the category.
    """
    mapping = constant(rules.REQUIREMENT_CATEGORIES, "map<string, array<string>>")

    def names_with(word: Column) -> Column:
        return F.filter(known, lambda k: F.contains(F.lower(k["tech"]), F.lower(word)))

    def names_in(word: Column) -> Column:
        cats = F.coalesce(F.try_element_at(mapping, F.lower(word)), F.array())
        return F.filter(known, lambda k: F.array_contains(cats, k["category"]))

    missing = F.filter(must_have, lambda w: (F.size(names_with(w)) == 0) & (F.size(names_in(w)) == 0))
    refused = F.filter(must_not, lambda w: (F.size(names_with(w)) > 0) | (F.size(names_in(w)) > 0))
    first_missing, first_refused = F.get(missing, F.lit(0)), F.get(refused, F.lit(0))
    by_name = F.get(F.transform(names_with(first_refused), lambda k: k["tech"]), F.lit(0))
    by_category = F.array_join(F.slice(F.transform(names_in(first_refused), lambda k: k["tech"]), 1, 2), ", ")
    return (
        F.when(first_missing.isNotNull(), F.concat(F.lit("No tiene: "), first_missing))
        .when(by_name.isNotNull(), F.concat(F.lit("Tiene "), by_name, F.lit(" (excluido)")))
        .when(first_refused.isNotNull(), F.concat(F.lit("Tiene "), first_refused, F.lit(": "), by_category))
        .otherwise("")
    )


def tech_filter(sites: DataFrame, profile: DataFrame, intents: DataFrame) -> DataFrame:
    """(intent_id, domain, passed, reason): every must_have is met and no must_not is.

    The reason names the first requirement that failed; see ``requirement_failure``.
    """
    lists = profile.groupBy("domain").agg(F.array_sort(F.collect_set(F.struct("tech", "category"))).alias("known"))
    rows = (
        sites.join(intents.select("intent_id", "must_have", "must_not"), "intent_id")
        .join(lists, "domain", "left")
        .withColumn("known", F.coalesce("known", F.array().cast("array<struct<tech:string,category:string>>")))
    )
    reason = requirement_failure(F.col("known"), F.col("must_have"), F.col("must_not"))
    return rows.select("intent_id", "domain", reason.alias("reason")).withColumn("passed", F.col("reason") == "")
