"""Alerts and the bulk site audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.rules import records as rules


def alerts_of(days: Column, ssl_valid: Column, missing_pixels: Column, upsell: Column, platform: Column, no_title: Column, no_description: Column) -> Column:
    """Alert texts in fixed order: certificate, pixels, reviews, page title, page description."""
    shown = days.cast("string")
    certificate = (
        F.when(days <= 0, rules.ALERT_EXPIRED)
        .when(days <= rules.CERTIFICATE_URGENT_DAYS, F.concat(F.lit(rules.ALERT_EXPIRES[0]), shown, F.lit(rules.ALERT_EXPIRES[1])))
        .when(days <= rules.CERTIFICATE_SOON_DAYS, F.concat(F.lit(rules.ALERT_EXPIRES_SOON[0]), shown, F.lit(rules.ALERT_EXPIRES_SOON[1])))
        .when(days.isNull() & ~ssl_valid, rules.ALERT_INVALID)
    )
    key = F.filter(missing_pixels, lambda p: p.isin(rules.KEY_PIXELS))
    pixels = F.when(F.size(key) == len(rules.KEY_PIXELS), rules.ALERT_NO_PIXEL).when(
        F.size(key) > 0, F.concat(F.lit(rules.ALERT_PIXELS), F.array_join(key, ", "))
    )
    reviews = F.when(
        upsell, F.concat(F.lit(rules.ALERT_REVIEWS[0]), F.coalesce(platform, F.lit("Ecommerce")), F.lit(rules.ALERT_REVIEWS[1]))
    )
    return F.array_compact(
        F.array(certificate, pixels, reviews, F.when(no_title, rules.ALERT_TITLE), F.when(no_description, rules.ALERT_DESCRIPTION))
    )


def alerts(audit: DataFrame) -> DataFrame:
    """Adds ``alerts`` to an audit row."""
    names = ["ssl_days_remaining", "ssl_valid", "missing_pixels", "upsell_opportunity", "platform", "missing_title", "missing_description"]
    return audit.withColumn("alerts", alerts_of(*[F.col(n) for n in names]))
