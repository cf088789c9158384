"""Bulk audit: one row per site joining identity, metadata, technology, contacts, pages, infrastructure and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.urls import url_key
from sitegrain.operators import audit
from sitegrain.operators import contacts as ct
from sitegrain.operators import structure as st
from sitegrain.operators import tech
from sitegrain.operators.redirects import redirect_ends
from sitegrain.rules import tech as tech_rules
from sitegrain.sources.pages import with_skeleton


def home_facts(pages: DataFrame, homes: DataFrame) -> DataFrame:
    """Everything the audit reads from a site's home page, in one narrow pass behind one join on page id."""
    picked = pages.select("page_id", "url", "html").join(homes.select("page_id"), "page_id", "left_semi")
    staged = st.with_page_facts(tech.with_technologies(st.with_assets(with_skeleton(picked))))
    low, html = F.col("low"), F.col("html")
    shops = F.filter("known", lambda k: k["category"] == "ecommerce")
    signals = tech.signal_columns(low, html)
    facts = staged.select(
        "domain",
        "page_id",
        "url",
        "title",
        "language",
        "description",
        "h1",
        F.transform("known", lambda k: k["tech"]).alias("technologies"),
        *[signals[name].alias(name) for name in ("missing_pixels", "support_widgets", "email_tools", "has_popups")],
        F.array_min(F.transform(shops, lambda k: k["tech"])).alias("by_tech"),
        F.get(tech.labels_found(low, html, tech_rules.SHOP_PLATFORMS), F.lit(0)).alias("by_pattern"),
        F.get(tech.labels_found(low, html, tech_rules.REVIEW_PLATFORMS), F.lit(0)).alias("by_review"),
        F.size(st.important_links(F.col("links"), F.col("url"))).alias("important_pages"),
    )
    shop = tech.shop_columns(F.col("by_tech"), F.col("by_pattern"), F.col("by_review"))
    return facts.withColumns(shop).withColumns(
        {"missing_title": F.coalesce("title", F.lit("")) == "", "missing_description": F.col("description").isNull()}
    ).drop("by_tech", "by_pattern", "by_review")


def site_audit(pages: DataFrame, infra: DataFrame | None = None, files: DataFrame | None = None, domains: DataFrame | None = None) -> DataFrame:
    """One row per site (of the listed domains, or of all) with its facts and ordered alerts.

    infra and files come from ``infra_facts`` and ``site_files``. Each side has one row per site before it is joined.
    Pages with ``status`` and ``final_url`` add where the home page's redirects end: http_status, final_url, redirects.
    """
    sources = ct.contact_sources(pages)
    if domains is not None:
        sources = sources.join(domains.select("domain").distinct(), "domain", "left_semi")
    homes = sources.filter("source_rank = 0").select("page_id", "domain")
    found = ct.contact_cascade(pages, sources, few=domains is not None)
    rows = home_facts(pages, homes).join(
        found.select("domain", "email", "phone", "social", F.col("source").alias("contact_source")), "domain", "left"
    )
    if infra is not None:
        rows = rows.join(infra, "domain", "left")
    else:
        rows = rows.withColumn("ssl_days_remaining", F.lit(None).cast("int")).withColumn("ssl_valid", F.lit(None).cast("boolean"))
    if {"status", "final_url"} <= set(pages.columns):
        ends = redirect_ends(pages).select(F.col("url_key").alias("_key"), "http_status", "final_url", "redirects", F.col("cyclic").alias("redirects_in_circle"))
        rows = rows.withColumn("_key", url_key(F.col("url"))).join(ends, "_key", "left").drop("_key")
    if files is not None:
        rows = rows.join(files, "domain", "left")
    return audit.alerts(rows)
