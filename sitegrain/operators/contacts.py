"""Contact extraction: addresses, phones, social profiles, and the best of them per site.

Everything a page yields is found inside its row. Per-site choices combine on the map side; lists that may grow with
a site stay long (one row per value), and only the cascade, which looks at a handful of pages per site, builds arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import markup as m
from sitegrain.functions.patterns import constant
from sitegrain.functions.urls import domain_matches, path_of
from sitegrain.operators.structure import contact_footer
from sitegrain.rules import contact as rules
from sitegrain.sources.pages import with_domain

# A run of address characters is read once: a match starts where a run starts or the last match ended.
_EMAIL_SCAN = rf"(?:(?<![a-zA-Z0-9._%+-])|\G){rules.EMAIL.replace('+@', '++@', 1)}"


def email_domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def local_part(email: Column) -> Column:
    return F.regexp_replace(email, "@[^@]*$", "")


def emails_in(html: Column) -> Column:
    """Addresses of a fragment in order: mailto links first, then the text; lower case, each once."""
    linked = F.transform(m.rx_all(html, "(?i)" + rules.MAILTO, 1), lambda e: F.lower(F.trim(e)))
    written = F.transform(m.rx_all(html, _EMAIL_SCAN), lambda e: F.lower(e))
    basic = F.filter(
        F.concat(linked, written),
        lambda e: (F.length(local_part(e)) > 0) & F.contains(e, F.lit("@")) & F.contains(email_domain(e), F.lit(".")),
    )
    return F.when(F.contains(html, F.lit("@")), F.array_distinct(basic)).otherwise(F.array().cast("array<string>"))


def _digits(phone: Column) -> Column:
    return F.regexp_replace(phone, r"[^0-9]", "")


def phones_in(html: Column, international: bool = False) -> Column:
    """Phone numbers of a fragment: tel links first, then the text; separators become one space, each once."""
    pattern = rules.PHONE_INTERNATIONAL if international else rules.PHONE_NATIONAL
    found = F.concat(m.rx_all(html, "(?i)" + rules.TEL, 1), m.rx_all(html, pattern))
    clean = F.transform(found, lambda p: F.regexp_replace(F.trim(p), r"[\s.-]+", " "))

    def good(phone: Column) -> Column:
        digits = _digits(phone)
        enough = F.length(digits) >= rules.PHONE_MIN_DIGITS
        if not international:
            return enough
        return enough & (F.length(digits) <= rules.PHONE_MAX_DIGITS) & ~digits.isin(rules.DUMMY_PHONES)

    return F.array_distinct(F.filter(clean, good))


def socials_in(html: Column, full: bool = False) -> Column:
    """Social profile URLs as (platform, url): by platform, then in order of appearance, each URL once."""
    table = rules.SOCIAL_URLS if full else rules.SOCIAL_URLS[: rules.BASIC_PLATFORMS]
    refused = rules.SOCIAL_REFUSED_FULL if full else rules.SOCIAL_REFUSED_BASIC

    def of(platform: str, pattern: str) -> Column:
        urls = m.rx_all(html, "(?i)" + pattern)
        kept = F.filter(urls, lambda u: ~reduce(lambda a, b: a | b, [F.contains(F.lower(u), F.lit(w)) for w in refused]))
        return F.transform(F.array_distinct(kept), lambda u: F.struct(F.lit(platform).alias("platform"), u.alias("url")))

    return F.concat(*[of(platform, pattern) for platform, pattern in table])


def email_candidates(pages: DataFrame) -> DataFrame:
    return m.rows_of(with_domain(pages), emails_in(F.col("html")), "page_id", "domain", pos="ord", item="email")


def phones(pages: DataFrame, international: bool = False) -> DataFrame:
    found = phones_in(F.col("html"), international)
    return m.rows_of(with_domain(pages), found, "page_id", "domain", pos="ord", item="phone")


def socials(pages: DataFrame, full: bool = True) -> DataFrame:
    found = socials_in(F.col("html"), full)
    rows = m.rows_of(with_domain(pages), found, "page_id", "domain", pos="ord")
    return rows.select("page_id", "domain", "ord", "item.platform", "item.url")


def quality_reason(email: Column) -> Column:
    """Why a generic provider's address is refused, or "ok"."""
    local = local_part(email)
    refused = F.exists(constant(rules.REFUSED_WORDS, "array<string>"), lambda w: F.contains(local, w))
    joined = ~local.rlike("[._+-]")
    random = joined & (
        local.rlike("^[0-9a-f]{16,}$")
        | ((F.length(local) >= 10) & local.rlike("^[a-z0-9]+$") & local.rlike("[0-9]") & local.rlike("[a-z]"))
    )
    too_long = F.concat(
        F.lit("local_part_too_long ("), F.length(local).cast("string"), F.lit(f" > {rules.LOCAL_PART_MAX})")
    )
    return (
        F.when(local == "", "empty_local_part")
        .when(F.length(local) > rules.LOCAL_PART_MAX, too_long)
        .when(refused, "forbidden_keyword")
        .when(random, "random_string")
        .otherwise("ok")
    )


def email_quality(emails: DataFrame) -> DataFrame:
    return emails.withColumn("reason", quality_reason(F.col("email"))).withColumn("ok", F.col("reason") == "ok")


def email_tier(email: Column, domain: Column) -> Column:
    """0: the site's own domain, 1: a generic provider's address that passes, null: not usable for the site."""
    generic = email_domain(email).isin(rules.GENERIC_PROVIDERS) & (quality_reason(email) == "ok")
    return F.when(domain_matches(F.regexp_replace(email_domain(email), r"^www\.", ""), domain), 0).when(generic, 1)


def valid_emails(emails: DataFrame) -> DataFrame:
    """Usable addresses of a site, one row each, with where they were first seen. Long, however many a site has."""
    tiered = emails.withColumn("tier", email_tier(F.col("email"), F.col("domain"))).filter("tier IS NOT NULL")
    first = F.min(F.struct("page_id", "ord"))
    return tiered.groupBy("domain", "email", "tier").agg(first.alias("f")).select(
        "domain", "email", "tier", "f.page_id", "f.ord"
    )


def best_email(emails: DataFrame) -> DataFrame:
    """Best address of a site: the first of its own domain, else the first good generic one, else null."""
    rows = emails.withColumn("tier", email_tier(F.col("email"), F.col("domain")))
    at = F.when(F.col("tier").isNotNull(), F.struct("tier", "page_id", "ord"))
    best = rows.groupBy("domain").agg(F.min_by("email", at).alias("best"), F.count("tier").alias("usable"))
    return best.withColumnRenamed("best", "email")


def outreach(pages: DataFrame) -> DataFrame:
    """One profile link per platform as a map: from the footer, or from the whole page if the footer has none at all."""

    def links_in(fragment: Column) -> Column:
        def first(pattern: str, prefix: str) -> Column:
            handles = F.filter(
                m.rx_all(fragment, "(?i)" + pattern, 1), lambda h: ~h.rlike("(?i)" + rules.HANDLE_SKIP)
            )
            return F.concat(F.lit(prefix), F.get(handles, F.lit(0)))

        entries = F.array(
            *[F.struct(F.lit(name).alias("key"), first(p, prefix).alias("value")) for name, p, prefix in rules.HANDLES]
        )
        return F.filter(entries, lambda e: e["value"].isNotNull())

    footer = m.first_element(F.col("html"), "footer")
    staged = with_domain(pages).withColumn("_footer", F.coalesce(links_in(footer), F.array().cast("array<struct<key:string,value:string>>")))
    chosen = F.when(F.size("_footer") > 0, F.col("_footer")).otherwise(links_in(F.col("html")))
    return staged.select("page_id", "domain", F.map_from_entries(chosen).alias("social_links"))


def page_contacts(pages: DataFrame) -> DataFrame:
    """What a page's footer and the whole page yield, as two steps of arrays; html ends here."""
    footer, html = contact_footer(F.col("html")), F.col("html")

    def step(fragment: Column) -> Column:
        return F.struct(
            emails_in(fragment).alias("emails"), phones_in(fragment).alias("phones"), socials_in(fragment).alias("socials")
        )

    return with_domain(pages).select(
        "page_id", "url", "domain", F.array(step(footer), step(html)).alias("steps")
    )


def contact_sources(pages: DataFrame, homes: DataFrame | None = None, keys: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Pages of a site the cascade may look at: (page_id, keys, source_rank, label). Never touches html.

    homes(page_id, keys) names the home page of each site of interest (keys hold "domain"); without it, every site's
    home is the page at "/" or else its first page.
    """
    paths = with_domain(pages.select("page_id", "url")).select(
        "page_id", "domain", F.lower(F.regexp_replace(path_of(F.col("url")), "(?<=.)/+$", "")).alias("path")
    )
    if homes is None:
        homes = paths.groupBy("domain").agg(
            F.min_by("page_id", F.struct(F.col("path") != "/", F.col("page_id"))).alias("page_id")
        )
    home_rows = homes.select("page_id", *keys, F.lit(0).alias("source_rank"), F.lit("home").alias("label"))
    ranks = constant({p: i + 1 for i, p in enumerate(rules.CONTACT_PATHS)}, "map<string,int>")
    named = (
        paths.withColumn("source_rank", F.try_element_at(ranks, F.col("path")))
        .filter("source_rank IS NOT NULL")
        .join(homes.select(*keys, F.col("page_id").alias("home_id")), "domain")
        .filter(F.col("page_id") != F.col("home_id"))
        .groupBy(*keys, "source_rank")
        .agg(F.min_by(F.struct("page_id", "path"), "page_id").alias("p"))
    )
    return home_rows.unionByName(named.select("p.page_id", *keys, "source_rank", F.col("p.path").alias("label")))


def contact_cascade(pages: DataFrame, sources: DataFrame, few: bool = False, keys: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Contacts per site. Sources are tried in order (footer, then page) up to the first with an own-domain address;
    phones and profiles come only from the sources reached. ``source`` names those that added something.

    A site has at most one page per source rank, so its steps fit in a row. With ``few`` the source pages are picked
    before they are read (right for a short list of sites, whose keys Spark broadcasts by size); otherwise every page
    is read where it lies and only what it yields is shuffled, never html.
    """
    if few:
        labelled = page_contacts(pages.join(sources.select("page_id"), "page_id", "left_semi"))
    else:
        labelled = page_contacts(pages)
    labelled = labelled.select("page_id", "steps").join(sources, "page_id")
    one = labelled.groupBy(*keys, "source_rank").agg(F.min_by(F.struct("label", "steps"), "page_id").alias("s"))
    gathered = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source_rank", "s"))).alias("pages"))

    def steps_of(page: Column) -> Column:
        footer = F.when(page["source_rank"] == 0, F.lit("footer")).otherwise(F.concat(page["s"]["label"], F.lit("/footer")))
        names = F.array(footer, page["s"]["label"])
        return F.transform(page["s"]["steps"], lambda st, i: F.struct(F.get(names, i).alias("label"), st.alias("x")))

    staged = gathered.withColumn("steps", F.flatten(F.transform("pages", steps_of)))
    domain = F.col("domain")

    def has_own(step: Column) -> Column:
        return F.exists(step["x"]["emails"], lambda e: email_tier(e, domain) == 0)

    at = F.get(F.filter(F.transform("steps", lambda s, i: F.when(has_own(s), i)), lambda i: i.isNotNull()), F.lit(0))
    staged = staged.withColumn("reached", F.slice("steps", F.lit(1), F.coalesce(at + 1, F.size("steps"))))

    def every(name: str, upto: Column | None = None) -> Column:
        steps = F.col("reached") if upto is None else F.slice("reached", F.lit(1), upto)
        return F.array_distinct(F.flatten(F.transform(steps, lambda s: s["x"][name])))

    def added(step: Column, i: Column) -> Column:
        new_phone = (F.size(step["x"]["phones"]) > 0) & (F.size(every("phones", i)) == 0)
        new_social = F.size(F.array_except(step["x"]["socials"], every("socials", i))) > 0
        return F.when(has_own(step) | new_phone | new_social, step["label"])

    sources_used = F.array_compact(F.transform("reached", added))
    emails = F.filter(every("emails"), lambda e: email_tier(e, domain).isNotNull())
    own = F.filter("emails", lambda e: email_tier(e, domain) == 0)
    staged = staged.select(
        *keys,
        emails.alias("emails"),
        every("phones").alias("phones"),
        every("socials").alias("socials"),
        F.when(F.size(sources_used) > 0, F.array_join(sources_used, " + ")).otherwise(rules.NO_SOURCE).alias("source"),
    )
    email = F.coalesce(F.get(own, F.lit(0)), F.get("emails", F.lit(0)))
    phone = F.get("phones", F.lit(0))
    return staged.select(
        *keys,
        email.alias("email"),
        F.col("emails").alias("all_emails"),
        phone.alias("phone"),
        F.col("phones").alias("all_phones"),
        F.col("socials").alias("social"),
        "source",
        (email.isNotNull() | phone.isNotNull() | (F.size("socials") > 0)).alias("success"),
    )


def completeness(contacts: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``missing``: the requested fields (email, phone, social) a site has no value for."""
    tests = {
        "email": F.trim(F.coalesce("email", F.lit(""))) == "",
        "phone": F.trim(F.coalesce("phone", F.lit(""))) == "",
        "social": F.coalesce(F.size("social"), F.lit(0)) <= 0,
    }
    names = [f.strip().lower() for f in fields]
    missing = [F.when(tests.get(f, F.lit(True)), F.lit(f)) for f in names]
    return contacts.withColumn("missing", F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>"))


def complete_only(contacts: DataFrame, fields: list[str]) -> DataFrame:
    return completeness(contacts, fields).filter(F.size("missing") == 0).drop("missing")


def merge_contact(sites: DataFrame, contacts: DataFrame, keys: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Sites with their contacts; a contact title replaces the site's when it is longer."""
    found = contacts.withColumnRenamed("title", "_title") if "title" in contacts.columns else contacts.withColumn("_title", F.lit(None).cast("string"))
    longer = F.length("_title") > F.length(F.coalesce("title", F.lit("")))
    rows = sites.join(found, list(keys), "left")
    return (
        rows.withColumn("title", F.when(F.coalesce(longer, F.lit(False)), F.col("_title")).otherwise(F.col("title")))
        .withColumn("success", F.coalesce("success", F.lit(False)))
        .drop("_title")
    )
