"""Hand-worked expectations for page structure."""

from sitegrain.functions.urls import absolutize, domain_matches, host_of, host_suffixes
from sitegrain.operators import jsonld, structure as st
from sitegrain.operators import tech
from tests.conftest import page, rows
from pyspark.sql import functions as F

HTML = """<!DOCTYPE html><html lang="es-ES"><head><title> Acme &amp; Co </title>
<meta content='Bicis eléctricas' name='description'><meta property="og:type" content="website">
<script type="application/ld+json">{"@context":"https://schema.org","@type":"Store","name":"Acme",
 "makesOffer":{"@type":["Offer","Thing"]}};</script>
<script type="application/ld+json">not json</script>
<!-- optimized with the Yoast SEO plugin v21 --><script src="https://js.stripe.com/v3/"></script>
<script>window.dataLayer = [];  fbq('init', '1'); var t = "<a href='/no'>no</a>";</script></head>
<body><header><nav><a href="/inicio">Inicio</a><a href="/INICIO">inicio</a><a href="/contacto">Contacto</a></nav></header>
<main><h1>Bicis</h1><h2></h2><h2>En <b>stock</b></h2><p>Texto útil.</p><button>Comprar ahora</button>
<a href="/demo">Probar demo</a><form action="https://us1.list-manage.com/post"></form></main>
<footer>© 2026 Acme <a href="https://linkedin.com/company/acme">in</a><a href="https://twitter.com/intent/tweet?x=1">t</a></footer>
<iframe src="//calendly.com/embed/x"></iframe><iframe src="/own"></iframe></body></html>"""


def test_context_layers(spark):
    c = rows(st.page_context(page(spark, HTML)))[0]
    assert c["domain"] == "acme.example"
    assert c["lang"] == "es-ES" and c["title"] == "Acme & Co"
    assert c["meta_description"] == "Bicis eléctricas" and c["og_type"] == "website"
    assert c["nav_links"] == ["Inicio", "Contacto"]
    assert c["h1"] == ["Bicis"] and c["h2"] == ["En stock"]
    assert c["schema_types"] == ["Store", "Offer", "Thing"]
    assert c["cta_texts"] == ["Comprar ahora", "Probar demo"]
    assert c["footer_text"].startswith("© 2026 Acme")
    assert "Texto útil." in c["body_text"] and "fbq" not in c["body_text"] and "Inicio" not in c["body_text"]


def test_markdown_marks_missing_parts(spark):
    text = rows(st.context_markdown(st.page_context(page(spark, "<html><body>hola</body></html>"))))[0]["markdown"]
    assert "TÍTULO: —" in text and text.endswith("[CUERPO DE TEXTO (RESUMEN)]\nhola\n")


def test_assets_are_foreign_and_distinct(spark):
    found = {(r["kind"], r["host"]) for r in rows(st.page_assets(page(spark, HTML)))}
    assert found == {("script", "js.stripe.com"), ("iframe", "calendly.com"), ("form", "us1.list-manage.com")}


def test_inline_hits(spark):
    found = {r["label"] for r in rows(tech.detect_inline(page(spark, HTML)))}
    assert {"dataLayer", "fbq", "Yoast SEO"} <= found and "gtag" not in found


def test_social_anchor_is_no_share_link(spark):
    found = rows(tech.social_anchors(st.page_links(page(spark, HTML))))
    assert [r["platform"] for r in found] == ["linkedin"]
    assert rows(tech.social_anchors(st.page_links(page(spark, HTML)), ["Stripe"])) == []


def test_targets_of_a_page(spark):
    targets = spark.createDataFrame([(1, 0, "stripe"), (1, 1, "yoast"), (1, 2, "zendesk")], "intent_id bigint, ord int, target string")
    sites = spark.createDataFrame([(1, "acme.example")], "intent_id bigint, domain string")
    p = page(spark, HTML)
    got = {r["target"]: (r["found"], r["source"]) for r in rows(tech.target_evidence(targets, sites, tech.page_detections(p), tech.evidence(p)))}
    assert got == {"stripe": (True, "detector"), "yoast": (True, "dna_comment"), "zendesk": (False, None)}


def test_jsonld_nodes_at_any_depth(spark):
    for levels in (25, 150):
        deep = '{"@type":"L0","x":' * levels + "1" + "}" * levels
        found = jsonld.jsonld_nodes(page(spark, f'<script type="application/ld+json">{deep}</script>'))
        nodes = rows(found.drop("node"))
        assert len(nodes) == levels and max(n["depth"] for n in nodes) == levels - 1


def test_nothing_is_cut_before_it_is_read(spark):
    late = page(spark, "<!-- " + "x " * 400 + "Yoast SEO plugin -->" + '<a href="/p">p</a>' * 150 + '<a href="/contacto">c</a>')
    assert [r["label"] for r in rows(tech.detect_inline(late))] == ["Yoast SEO"]
    assert [r["path"] for r in rows(st.important_pages(late))] == ["/contacto", "/contact"]
    nav = "".join(f"<a>entry {i} {'y' * 70}</a>" for i in range(30))
    assert len(rows(st.nav_links(page(spark, f"<nav>{nav}</nav>")))) == 30


def test_distinct_keeps_the_first_of_each_key(spark):
    from sitegrain.functions.markup import distinct_ignoring_case

    got = spark.range(1).select(distinct_ignoring_case(F.array(*[F.lit(x) for x in ("b", "A", "B", "a", "c")])).alias("x")).first().x
    assert got == ["b", "A", "c"]


def test_schema_facts_reach_graph_and_main_entity_only(spark):
    block = (
        '{"@graph":[{"@type":"WebPage","mainEntity":[{"@type":"Product","name":"A","offers":{"price":"5","priceCurrency":"EUR"}}]},'
        '{"@type":"Organization","name":"Org","founder":{"@type":"Service","name":"hidden"}}]}'
    )
    f = rows(jsonld.schema_facts(page(spark, f'<script type="application/ld+json">{block}</script>')))[0]
    assert f["types"] == ["WebPage", "Product", "Organization"]
    assert f["has_products"] and f["is_ecommerce"] and not f["has_services"]
    assert f["price_range"] == "5 EUR" and f["organization_name"] == "Org" and f["product_names"] == ["A"]


def test_urls(spark):
    cases = [("HTTPS://WWW.Shop.Example:8080/a?b", "shop.example"), ("shop.example/x", "shop.example"), ("http://", None)]
    got = spark.createDataFrame(cases, "u string, want string").select(host_of(F.col("u")).alias("h"), "want").collect()
    assert all(r.h == r.want for r in got)
    base = "https://a.example/x/y?z=1#f"
    links = [("b", "https://a.example/x/b"), ("/b", "https://a.example/b"), ("//c.d/e", "https://c.d/e"), ("mailto:x", "mailto:x"), ("#g", "https://a.example/x/y?z=1#g")]
    got = spark.createDataFrame(links, "h string, want string").select(absolutize(F.lit(base), F.col("h")).alias("t"), "want").collect()
    assert all(r.t == r.want for r in got)
    row = spark.range(1).select(
        domain_matches(F.lit("mail.a.b"), F.lit("a.b")).alias("x"), domain_matches(F.lit("xa.b"), F.lit("a.b")).alias("y"), host_suffixes(F.lit("a.b.c")).alias("s")
    ).first()
    assert row.x and not row.y and row.s == ["a.b.c", "b.c", "c"]
