"""End-to-end searches: from search answers to ranked leads with contacts.

The candidate set is small against the page table (a bounded number per intent), so every plan narrows it first and
picks its pages by id. The short tables that pick are stored as Parquet, so that Spark knows their size and broadcasts
them: html of the page table is filtered where it lies, and only the picked pages' html goes further. It is read in two
passes (candidate pages, then candidate and contact pages; a third one for technologies in the precise search).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.urls import url_key
from sitegrain.operators import contacts as ct
from sitegrain.operators import funnel, score, tech, verdicts
from sitegrain.operators.structure import with_assets
from sitegrain.session import stored
from sitegrain.sources.pages import with_skeleton

SITE = ("intent_id", "domain")


def narrowed(candidates: DataFrame, intents: DataFrame) -> DataFrame:
    """The search funnel: query cap, blocked hosts, informational texts, first per site, budget."""
    kept = funnel.drop_blocked(funnel.within_query_cap(candidates))
    return funnel.candidate_budget(funnel.drop_informational(kept, intents), intents)


def with_page_ids(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates with the stored page of their URL (the lowest id of those whose URLs mean one page, see ``url_key``); null when not stored."""
    key = url_key(F.col("url"))
    keyed = candidates.drop("page_id").withColumn("_key", key)
    stored = pages.select(key.alias("_key"), "page_id").join(keyed.select("_key").distinct(), "_key", "left_semi")
    ids = stored.groupBy("_key").agg(F.min("page_id").alias("page_id"))
    return keyed.join(ids, "_key", "left").drop("_key")


def picked(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """The pages that a short stored table names, taken from the page table without shuffling it."""
    return pages.join(ids.select("page_id").distinct(), "page_id", "left_semi")


def qualified(candidates: DataFrame, pages: DataFrame, intents: DataFrame) -> DataFrame:
    """Scored candidates with enough confidence, as a stored table."""
    kept = stored(narrowed(candidates, intents))
    located = stored(with_page_ids(kept, pages))
    return stored(funnel.qualify(score.score_candidates(located, picked(pages, located), intents)))


def _shown(title: Column) -> Column:
    return F.when(F.length(title) > 60, F.concat(F.left(title, F.lit(60)), F.lit("..."))).otherwise(title)


def _leads(sites: DataFrame, pages: DataFrame) -> DataFrame:
    sources = stored(ct.contact_sources(pages, sites.select("page_id", *SITE), SITE))
    found = ct.contact_cascade(pages, sources, few=True, keys=SITE)
    shown = sites.withColumn("title", _shown(F.col("title"))).withColumn("reasons", F.slice("reasons", 1, 3))
    return ct.merge_contact(shown, found, SITE)


LEAD = [
    "intent_id", "rank", "domain", "url", "confidence", "title", "reasons", "email", "all_emails", "phone", "all_phones",
    "social", "source", "success",
]


def fast_leads(candidates: DataFrame, pages: DataFrame, intents: DataFrame) -> DataFrame:
    """Leads per intent: funnel, confidence of at least 60, a living page, contacts, ranking and cap."""
    alive = qualified(candidates, pages, intents).filter("alive_reason = 'ok'")
    return funnel.top_sites_per_intent(_leads(alive, pages), intents).select(*LEAD)


def technology_stage(sites: DataFrame, pages: DataFrame, intents: DataFrame) -> DataFrame:
    """Adds what the site's page says about the intent's technologies: targets, all_targets_met, tech_reason."""
    wanted = sites.join(intents.select("intent_id", "must_have", "must_not"), "intent_id")
    there = picked(pages.select("page_id", "url", "html"), sites).join(wanted.select("page_id", *SITE, "must_have", "must_not"), "page_id")
    site = F.col("domain")
    staged = with_skeleton(there.withColumn("site", site)).withColumn("domain", F.col("site"))
    staged = tech.with_evidence(tech.with_technologies(with_assets(staged)))
    known = F.col("known")
    read = staged.select(
        *SITE,
        tech.confirm_targets(F.col("must_have"), known, F.col("evidence")).alias("targets"),
        tech.requirement_failure(known, F.array().cast("array<string>"), F.col("must_not")).alias("tech_reason"),
        F.transform(known, lambda k: k["tech"]).alias("known"),
    )
    met = F.forall("targets", lambda t: t["found"])
    return sites.join(read.withColumn("all_targets_met", met), list(SITE))


def precise_leads(
    candidates: DataFrame,
    pages: DataFrame,
    intents: DataFrame,
    verdict_rows: DataFrame,
    fields: list[str],
    relax_level: int | DataFrame = 0,
) -> DataFrame:
    """Leads per intent that also meet the technology requirements and the judge's verdict, with every wanted contact field.

    relax_level is one level for all, or a table of each intent's levels over time (``verdicts.verdict_levels``).
    """
    sites = technology_stage(qualified(candidates, pages, intents), pages, intents)
    fitting = sites.filter("all_targets_met AND tech_reason = ''").drop("targets", "known", "all_targets_met", "tech_reason")
    judged = verdicts.apply_verdicts if isinstance(relax_level, int) else verdicts.apply_timed_verdicts
    passed = stored(judged(fitting, verdict_rows, relax_level).filter("passed"))
    leads = ct.complete_only(_leads(passed, pages), fields)
    return funnel.top_sites_per_intent(leads, intents).select(*LEAD, "verdict_score")
