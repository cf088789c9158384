"""Result sinks: JSON, CSV and the wide contact tables. Each frame is built in Spark and written by Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLATFORMS = ["linkedin", "instagram", "twitter", "facebook", "youtube", "tiktok"]
PLATFORM_TITLES = ["LinkedIn", "Instagram", "Twitter", "Facebook", "YouTube", "TikTok"]
MISSING = "N/A"


def json_envelope(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total_results"), F.count_if("is_valid").alias("valid_count"))


def write_json(results: DataFrame, path: str) -> None:
    """Result rows as JSON lines under ``rows`` and the totals under ``envelope``."""
    results.write.mode("overwrite").json(f"{path}/rows")
    json_envelope(results).withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/envelope")


def results_csv(results: DataFrame) -> DataFrame:
    """Eight columns as text; the score with one decimal, five keywords, three reasons each."""
    return results.select(
        F.col("domain").alias("Domain"),
        F.col("url").alias("URL"),
        F.initcap(F.col("is_valid").cast("string")).alias("Is Valid"),
        F.bround("confidence", 1).cast("decimal(6,1)").cast("string").alias("Confidence Score"),
        F.coalesce("title", F.lit("")).alias("Page Title"),
        F.array_join(F.slice("keywords", 1, 5), ", ").alias("Keywords"),
        F.array_join(F.slice("reasons", 1, 3), ", ").alias("Validation Reasons"),
        F.array_join(F.slice("rejections", 1, 3), ", ").alias("Rejection Reasons"),
    )


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def _last_of(platform: str) -> Column:
    urls = F.filter("social", lambda s: s["platform"] == platform)
    return F.coalesce(F.try_element_at(urls, F.lit(-1))["url"], F.lit(""))


def _others(values: str, main: str) -> Column:
    rest = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: ~v.eqNullSafe(F.col(main)))
    return F.array_join(rest, "; ")


def contacts_wide(results: DataFrame, fields: list[str]) -> DataFrame:
    """Contact table with columns for the requested fields; of several URLs of a platform the last one wins."""
    columns = [
        F.col("domain").alias("Dominio"),
        F.col("url").alias("URL"),
        F.col("confidence").alias("Confianza"),
        F.coalesce("title", F.lit("")).alias("Título"),
    ]
    if "email" in fields:
        columns += [F.coalesce("email", F.lit(MISSING)).alias("Email"), _others("all_emails", "email").alias("Emails_Adicionales")]
    if "phone" in fields:
        columns += [F.coalesce("phone", F.lit(MISSING)).alias("Teléfono"), _others("all_phones", "phone").alias("Teléfonos_Adicionales")]
    if "social" in fields:
        columns += [_last_of(p).alias(title) for p, title in zip(PLATFORMS, PLATFORM_TITLES)]
        other = F.filter("social", lambda s: ~s["platform"].isin(PLATFORMS))
        columns.append(F.coalesce(F.array_join(F.transform(other, lambda s: s["url"]), "; "), F.lit("")).alias("Otras_RRSS"))
    return results.select(*columns)


def contacts_flat(results: DataFrame) -> DataFrame:
    """Contact table with all social URLs in one column."""

    def shown(column: Column) -> Column:
        return F.coalesce(F.nullif(column, F.lit("")), F.lit(MISSING))

    urls = F.array_join(F.transform("social", lambda s: s["url"]), "; ")
    return results.select(
        "domain",
        "url",
        shown(F.col("title")).alias("title"),
        shown(F.col("email")).alias("email"),
        shown(F.col("phone")).alias("phone"),
        shown(urls).alias("social_media"),
    )


def marketing_wide(results: DataFrame, fields: list[str]) -> DataFrame:
    """Import table for marketing tools: any of domain, url, email, phone, social; missing values are empty."""
    titles = {"domain": "Domain", "url": "Website", "email": "Email", "phone": "Phone"}
    columns = [F.coalesce(f, F.lit("")).alias(title) for f, title in titles.items() if f in fields]
    if "social" in fields:
        columns += [_last_of(p).alias(title) for p, title in zip(PLATFORMS, PLATFORM_TITLES)]
    return results.select(*columns)


def audit_wide(audit: DataFrame) -> DataFrame:
    """Bulk audit table: one text row per site."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return audit.select(
        F.col("domain").alias("Domain"),
        F.col("url").alias("URL"),
        (text("http_status") if "http_status" in audit.columns else F.lit("")).alias("HTTP"),
        F.when(F.coalesce("ssl_valid", F.lit(False)), "Valid").otherwise("Invalid").alias("SSL"),
        text("email").alias("Email"),
        text("phone").alias("Phone"),
        F.coalesce(F.array_join("technologies", "; "), F.lit("")).alias("Technologies"),
        text("language").alias("Language"),
    )
