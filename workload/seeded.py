"""pages_seeded: the given pages, each with a snippet chosen by page_id % 12.

The raw pages hold next to no business signals, so checks on them alone would pass on empty results. The same rows
are built in Spark and, from the same table of snippets, as the leading CTE of every oracle query.
"{d}" stands for the site's domain and "{i}" for the page id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.session import scratch_folder
from sitegrain.sources.layout import lay_out
from sitegrain.sources.pages import read_pages, with_domain

LD = '<script type="application/ld+json">%s</script>'

# (in head, in article, in footer)
SNIPPETS = [
    (
        '<script src="https://cdn.shopify.com/s/a.js"></script>'
        + LD
        % '{"@context":"https://schema.org","@type":"Product","name":"P{i} serum","offers":'
        '{"@type":"Offer","price":"19.90","priceCurrency":"EUR"},"review":{"@type":"Review",'
        '"reviewBody":"Great serum {i}","reviewRating":{"@type":"Rating","ratingValue":"5"}}}',
        '<div class="product">Add to cart 19,90 € <i>envío</i></div><button>Comprar ahora</button>',
        '<a href="mailto:info@{d}?subject=x">info</a><a href="/contacto">Contacto</a>',
    ),
    (
        '<meta name="description" content="Agency &amp; studio {i}"><meta name="keywords" content="a, b,c , d,e,f">'
        '<script src="https://js.hs-scripts.com/1.js"></script>',
        'Our services and portfolio <div class="service">team</div>',
        '<a href="tel:+34 612 345 678">call</a><a href="https://www.linkedin.com/company/acme-{i}">in</a>',
    ),
    (
        "<meta content='Tool {i} for teams' name='description'><meta property=\"og:type\" content=\"website\">"
        '<meta property="og:title" content="Tool {i}">',
        'Free trial <b>pricing</b> dashboard <div class="pricing">plans</div><a href="/signup">Sign up</a>',
        "sales.{i}@gmail.com 612 34 56 78, 934-567-890",
    ),
    (
        "<!-- optimized with the Yoast SEO plugin v{i} --><script>gtag('js', 1);fbq('init','{i}');</script>",
        '<form action="https://us1.list-manage.com/subscribe/post"><button>Empezar YA</button><button>empezar ya</button></form>',
        "noreply@gmail.com, a1b2c3d4e5f6@gmail.com <a href='https://wa.me/34600111222'>chat</a>",
    ),
    (
        LD
        % '{"@graph":[{"@type":"Organization","name":"Org {i}"},{"@type":["Service","Thing"],"name":"SEO {i}",'
        '"provider":{"@type":"Person","name":"x"}}]}'
        + LD % '<!-- c -->{"@type":"LocalBusiness","name":"Loc {i}","address":{"streetAddress":"Main {i}"}};',
        '<iframe src="https://calendly.com/embed/{i}"></iframe><iframe src="https://static.{d}/w"></iframe>',
        "x@other.example <a href='//cdn.example.org/file'>file</a>",
    ),
    (
        LD % '{"@type":"BlogPosting","name":"Post {i}"}',
        '<div class="blog">Qué es la cosmética: guía completa</div><ul><li>2024-05-0{i} <a href="/post/{i}">Post {i}</a></li></ul>',
        "",
    ),
    ("", "This domain is parked free of charge", ""),
    (
        LD % '{"@type":"Product", name: broken',
        "<h2>Second <b>level</b> {i}</h2><h2> </h2><h2>Otra</h2>",
        '<a href="https://twitter.com/intent/tweet?u=1">t</a><a href="https://instagram.com/shop_{i}">ig</a>'
        '<a href="https://instagram.com/shop_{i}">again</a>',
    ),
    (
        LD
        % '{"@type":"WebPage","mainEntity":[{"@type":"Product","name":"A{i}"},{"@type":"Product","name":"B{i}"},'
        '{"@type":"Product","name":"C{i}","aggregateRating":{"@type":"AggregateRating","ratingValue":"4.5"}}]}',
        '<a href="/contacto?x=1">Contacto</a><a href="/aviso-legal">Aviso</a><a href="contact/us">us</a>',
        '<a href="mailto:Ventas@{d}">v</a> ventas@{d} hola@gmail.com',
    ),
    (
        '<script src="https://js.stripe.com/v3/?a=1"></script><script src="https://js.stripe.com/v3/?a=2"></script>'
        '<script src="/local.js"></script>',
        '<a href="https://www.trustpilot.com/review/{d}">reviews</a> woocommerce add to cart €',
        '<a href="https://youtube.com/@chan{i}">yt</a><a href="https://www.tiktok.com/@tok{i}">tk</a>',
    ),
    (
        '<link rel="canonical" href="https://{d}/c/{i}"><meta http-equiv="content-language" content="es-ES">',
        "404 not found <time datetime='2024-01-0{i}'>x</time> precio $ checkout",
        "+1 202-555-0{i} <a href='https://facebook.com/page.{i}'>fb</a>",
    ),
    # a signature late in a long comment, and a contact link behind more than a hundred others
    (
        "<!-- " + "lorem ipsum " * 50 + "optimized with the Yoast SEO plugin v{i} -->",
        '<a href="/p/{i}">p</a>' * 105 + '<a href="/aviso-legal">Aviso</a>',
        "",
    ),
]

PLACES = ("</head>", "</article>", "</footer>")


def pages_seeded(spark: SparkSession, folder: str) -> DataFrame:
    pages = with_domain(read_pages(spark, folder))
    pick = F.pmod(F.col("page_id"), F.lit(len(SNIPPETS))).cast("int")
    html = F.col("html")
    for n, place in enumerate(PLACES):
        snippet = F.get(F.array(*[F.lit(row[n]) for row in SNIPPETS]), pick)
        snippet = F.replace(snippet, F.lit("{d}"), F.col("domain"))
        snippet = F.replace(snippet, F.lit("{i}"), F.col("page_id").cast("string"))
        html = F.replace(html, F.lit(place), F.concat(snippet, F.lit(place)))
    return pages.select("page_id", "url", html.alias("html"))


# --- the same for the oracle ------------------------------------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def domain_sql(url: str) -> str:
    host = rf"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:\s]+)', 1))"
    return f"nullif(regexp_replace({host}, '^www[.]', ''), '')"


def _seeded_sql() -> str:
    html = "p.html"
    for n, place in enumerate(PLACES):
        col = ("in_head", "in_article", "in_footer")[n]
        snippet = f"replace(replace(s.{col}, '{{d}}', {domain_sql('p.url')}), '{{i}}', CAST(p.page_id AS VARCHAR))"
        html = f"replace({html}, '{place}', {snippet} || '{place}')"
    rows = ",\n".join(f"({m}, {quote(a)}, {quote(b)}, {quote(c)})" for m, (a, b, c) in enumerate(SNIPPETS))
    return (
        f"snippets(m, in_head, in_article, in_footer) AS (VALUES {rows}),\n"
        f"pages_seeded AS MATERIALIZED (SELECT p.page_id, p.url, {domain_sql('p.url')} AS domain, {html} AS html "
        f"FROM pages p JOIN snippets s ON p.page_id % {len(SNIPPETS)} = s.m)"
    )


PAGES_SEEDED_SQL = _seeded_sql()


def by_page_id(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """These pages laid out by page_id, as a table of its own in the shared scratch folder."""
    name = f"pages_{uuid.uuid4().hex}"
    return lay_out(pages, name, f"{scratch_folder(spark)}/{name}")
