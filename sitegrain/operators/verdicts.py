"""Yes/no verdicts of an outside judge, applied to sites, and the sheet such a judge reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.ordering import asof_join
from sitegrain.rules import prompts as rules
from sitegrain.streaming import relaxation


def yes_no(text: Column) -> Column:
    """True or false by the first word, else by the only one of both that is mentioned; null when unclear."""
    first = F.lower(F.regexp_extract(text, r"[\p{L}\p{N}_]+", 0))
    yes, no = text.rlike(r"(?iU)\b(?:s[ií]|yes)\b"), text.rlike(r"(?iU)\bno\b")
    return (
        F.when(first.isin("si", "sí", "yes"), True)
        .when(first == "no", False)
        .when(yes & ~no, True)
        .when(no & ~yes, False)
    )


def _judged(rows: DataFrame, columns: list[str], relax_level: Column) -> DataFrame:
    answer = F.when(F.coalesce("error", F.lit("")) == "", yes_no(F.coalesce("raw", F.lit(""))))
    failed = F.coalesce("error", F.lit("")) != ""
    return rows.select(
        *columns,
        F.when(failed, relax_level >= 2).otherwise(F.coalesce(answer, F.lit(False))).alias("passed"),
        F.when(failed, 0).when(answer.isNull(), 1).when(answer, 3).otherwise(0).alias("verdict_score"),
        F.left(F.trim(F.coalesce("raw", F.lit(""))), F.lit(200)).alias("verdict"),
    )


def apply_verdicts(sites: DataFrame, verdicts: DataFrame, relax_level: int = 0) -> DataFrame:
    """Adds ``passed`` and ``verdict_score`` (3 yes, 1 unclear, 0 no or failed) from verdicts(intent_id, domain, raw, error).

    A verdict that failed passes only at relaxation level 2 or above; a site without verdict does not pass. One level
    holds for all; see ``apply_timed_verdicts`` for each intent's level at each verdict's time.
    """
    rows = sites.join(verdicts.select("intent_id", "domain", "raw", "error"), ["intent_id", "domain"], "left")
    return _judged(rows, sites.columns, F.lit(relax_level))


def verdict_levels(verdicts: DataFrame, rejections: int = relaxation.REJECTIONS_PER_LEVEL, seconds: float | None = relaxation.SECONDS_PER_LEVEL, idle: float | None = None) -> DataFrame:
    """Relaxation levels of each intent over time, (intent_id, ts, event_id, level), from its verdicts(intent_id, ts, event_id, raw, error).

    A verdict that is not a yes is a rejection; one that failed is too, until level 2, and a pass from there on.
    """
    failed = F.coalesce("error", F.lit("")) != ""
    told = verdicts.select(F.col("intent_id").alias("key"), "ts", "event_id", F.coalesce(yes_no(F.coalesce("raw", F.lit(""))), F.lit(False)).alias("passed"), failed.alias("failed"))
    return relaxation.level_changes(*relaxation.relax_rises(told, rejections, seconds, idle=idle)).withColumnRenamed("key", "intent_id")


def apply_timed_verdicts(sites: DataFrame, verdicts: DataFrame, levels: DataFrame) -> DataFrame:
    """``apply_verdicts`` with the level that the intent had just before each verdict(intent_id, domain, raw, error, ts, event_id).

    levels(intent_id, ts, event_id, level) hold changes, as ``verdict_levels`` gives them; before the first one it is 0.
    """
    rows = sites.join(verdicts.select("intent_id", "domain", "raw", "error", "ts", "event_id"), ["intent_id", "domain"], "left")
    rows = asof_join(rows, levels.select("intent_id", "ts", "event_id", F.col("level").alias("relax_level")), ["intent_id"], ["ts", "event_id"], ties=False)
    return _judged(rows, [c for c in sites.columns], F.coalesce("relax_level", F.lit(0)))


def tech_summary(known: Column, targets: Column, socials: Column, hosts: Column) -> Column:
    """Readable technology findings: names, one line per target, profiles and third-party hosts.

    targets are (target, found, source, evidence), socials (platform, url).
    """
    names = F.when(
        F.size(known) > 0, F.concat(F.lit(rules.SHEET_TECH), F.array_join(F.slice(known, 1, rules.SHEET_TECH_MAX), ", "))
    ).otherwise(rules.SHEET_NO_TECH)
    line = F.transform(
        targets,
        lambda t: F.when(
            t["found"],
            F.concat(F.lit("  · "), t["target"], F.lit(": SI ("), t["source"], F.lit(") — "), F.left(t["evidence"], F.lit(120))),
        ).otherwise(F.concat(F.lit("  · "), t["target"], F.lit(": NO (sin evidencia)"))),
    )
    lines = F.when(F.size(targets) > 0, F.concat(F.lit(rules.SHEET_TARGETS), F.array_join(line, "\n")))
    shown = F.transform(F.slice(socials, 1, rules.SHEET_SOCIAL_MAX), lambda s: F.concat(s["platform"], F.lit("="), s["url"]))
    profiles = F.when(F.size(socials) > 0, F.concat(F.lit(rules.SHEET_SOCIAL), F.array_join(shown, ", ")))
    outside = F.when(
        F.size(hosts) > 0, F.concat(F.lit(rules.SHEET_HOSTS), F.array_join(F.slice(hosts, 1, rules.SHEET_HOSTS_MAX), ", "))
    )
    return F.concat_ws("\n", names, lines, profiles, outside)


def metric_summary(scores: Column) -> Column:
    """Readable page scores from (name, value) pairs; a dash without any."""
    pairs = F.filter(F.coalesce(scores, F.array().cast("array<struct<name:string,value:string>>")), lambda p: p["value"].isNotNull())
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["value"])), ", ")
    return F.when(F.size(pairs) > 0, F.concat(F.lit(rules.SHEET_SCORES), text)).otherwise(rules.SHEET_NOTHING)


def judge_sheet(rows: DataFrame) -> DataFrame:
    """One text per (intent, site), ready for a batch scoring job.

    rows hold intent_id, domain, prompt, markdown, known, targets, socials, hosts and scores.
    """
    parts = {
        "PROMPT DEL USUARIO": F.trim("prompt"),
        "DOMINIO ANALIZADO": F.col("domain"),
        "HTML DE LA WEB — formato Markdown": F.regexp_replace("markdown", r"^\s+|\s+$", ""),
        "ANÁLISIS WAPPALYZER / ADN": tech_summary(F.col("known"), F.col("targets"), F.col("socials"), F.col("hosts")),
        "ANÁLISIS PAGESPEED": metric_summary(F.col("scores")),
    }
    sections = [F.concat(F.lit(f"[{title}]\n"), F.coalesce(text, F.lit("")), F.lit("\n\n")) for title, text in parts.items()]
    return rows.select("intent_id", "domain", F.concat(*sections, F.lit("Respuesta:")).alias("sheet"))
