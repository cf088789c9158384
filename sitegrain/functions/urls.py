"""URL and host expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without one leading "www." and without port; null when the text holds no host.

    A text without scheme is read as https, so "shop.example/x" has the host "shop.example".
    """
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(F.trim(full), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:;\s]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def asset_host(url: Column) -> Column:
    """Host of an absolute or protocol-relative reference; null for a relative one."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:;\s]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Path part, "/" when empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def is_under(host: Column, parent: Column) -> Column:
    """Host equals the parent or is a subdomain of it."""
    return (host == parent) | F.endswith(host, F.concat(F.lit("."), parent))


def domain_matches(a: Column, b: Column) -> Column:
    """Two hosts belong to one site when they are equal or one is a subdomain of the other."""
    return is_under(a, b) | is_under(b, a)


def absolutize(base: Column, href: Column) -> Column:
    """Absolute link from a page URL and an href. "../" steps are left as they are."""
    origin = origin_of(base)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    no_fragment = F.regexp_replace(base, "#.*$", "")
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("#")), F.concat(no_fragment, href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path_of(base), href))
        .when(href == "", no_fragment)
        .otherwise(F.concat(origin, folder, href))
    )


def host_suffixes(host: Column) -> Column:
    """The host and every parent of it: a.b.c -> [a.b.c, b.c, c]. Turns "is under" into an equi join."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def url_key(url: Column) -> Column:
    """What URLs of one page have in common: host without "www." and default port, path with its steps folded and no final
    slash, query; no scheme, no fragment. Null when the text holds no host.
    """
    full = F.trim(F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url)))
    bare = F.regexp_replace(full, "#.*$", "")
    port = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:\s]+:(\d+)", 1)
    usual = (port == "") | ((port == "80") & bare.rlike("(?i)^http:")) | ((port == "443") & bare.rlike("(?i)^https:"))
    query = F.regexp_extract(bare, r"\?(.+)$", 1)
    steps = F.split(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/")

    def step(kept: Column, name: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(name == "..", up).when(name.isin("", "."), kept).otherwise(F.concat(kept, F.array(name)))

    path = F.aggregate(steps, F.array().cast("array<string>"), step)
    tail = F.concat(F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.concat(F.lit("/"), F.array_join(path, "/")), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.concat(host_of(url), tail)
