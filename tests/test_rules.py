"""Funnel, contacts, prompts and records on hand-worked cases."""

from pyspark.sql import functions as F

from sitegrain.functions.patterns import branches, fixed_text
from sitegrain.operators import contacts, funnel, prompts, tech, verdicts
from sitegrain.sources import records, sinks
from tests.conftest import page, rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_guards_are_part_of_every_match():
    assert branches(r"a\|b|c(d|e)|[|]") == [r"a\|b", "c(d|e)", "[|]"]
    assert fixed_text(r"js\.hs-scripts\.com") == ("js.hs-scripts.com", True)
    assert fixed_text(r"fbq\s*\(") == ("fbq", False)
    assert fixed_text(r"AW-\d{7,}") == ("aw-", False)


def test_liveness_order(spark):
    long_text = "palabra " * 300
    cases = [
        ("<html>x</html>", "empty_or_tiny_html (14B)"),
        (f"<title>a</title>{long_text} this domain is parked", "parking_or_placeholder"),
        (f"<title>a</title>{long_text} 404 not found", "broken_or_placeholder"),
        (f"<title>a</title>{long_text * 3} 404 not found", "ok"),
        ("<body>" + "<i></i>" * 300 + "</body>", "no_meaningful_body"),
        (f"<body>{long_text}</body>", "ok"),
    ]
    pages = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(cases)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["reason"] for r in rows(funnel.page_liveness(pages))}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    wrong = page(spark, f"<title>a</title>{long_text}").withColumn("status", F.lit(503)).withColumn("content_type", F.lit("text/html"))
    assert rows(funnel.page_liveness(wrong))[0]["reason"] == "http_503"
    pdf = page(spark, f"<title>a</title>{long_text}").withColumn("status", F.lit(200)).withColumn("content_type", F.lit("application/pdf"))
    assert rows(funnel.page_liveness(pdf))[0]["reason"] == "non_html_content:application/pdf"


def test_cap_never_returns_more(spark):
    scored = spark.createDataFrame([(1, f"d{i:02d}", 60.0 + i % 5) for i in range(25)], "intent_id bigint, domain string, confidence double")
    for n, want in ((7, 7), (25, 25), (40, 25)):
        wanted = spark.createDataFrame([(1, n)], "intent_id bigint, max_results int")
        kept = rows(funnel.top_sites_per_intent(scored, wanted))
        assert len(kept) == want
        assert [r["rank"] for r in sorted(kept, key=lambda r: (-r["confidence"], r["domain"]))] == list(range(1, want + 1))


def test_an_intent_gets_as_many_as_it_wants(spark):
    scored = spark.range(300).selectExpr("1L AS intent_id", "'d' || id AS domain", "60.0D + id % 5 AS confidence")
    wanted = spark.createDataFrame([(1, 250)], "intent_id bigint, max_results int")
    assert funnel.top_sites_per_intent(scored, wanted).count() == 250


def test_cascade_reads_every_known_path(spark):
    for path in ("/aviso-legal", "/kontakt", "/quienes-somos"):
        pages = spark.createDataFrame(
            [(1, "https://acme.example/", "<html></html>"), (2, f"https://acme.example{path}", "info@acme.example")],
            "page_id bigint, url string, html string",
        )
        assert rows(contacts.contact_cascade(pages, contacts.contact_sources(pages)))[0]["email"] == "info@acme.example", path


def test_one_hot_site_among_candidates(spark):
    rows_in = [(1, i % 7, i, f"https://hot.example/{i}", "hot.example") for i in range(3000)] + [(1, 0, 9, "https://b.example", "b.example")]
    c = spark.createDataFrame(rows_in, "intent_id bigint, query_ord int, position int, url string, domain string")
    got = {r["domain"]: r["url"] for r in rows(funnel.first_per_domain(c))}
    assert got == {"hot.example": "https://hot.example/0", "b.example": "https://b.example"}


def test_email_rules(spark):
    cases = {
        "john.smith": "ok", "noreply": "forbidden_keyword", "a1b2c3d4e5f6": "random_string", "abcdefabcdefabcd": "random_string",
        "x" * 26: "local_part_too_long (26 > 25)", "juan2024": "ok", "juan-perez2024x": "ok",
    }
    for local, want in cases.items():
        assert one(spark, contacts.quality_reason(F.lit(f"{local}@gmail.com"))) == want, local


def test_email_scan_equals_plain_scan(spark):
    import re

    from sitegrain.rules import contact as rules

    texts = ["a@b.co@d.com", "x_y@z.org q@w.es", "a@b.comx_y@d.org", "..a%b@c-d.example.", "@@a@b", "é@x.com", "a@b.c1 a@b.cc"]
    for text in texts:
        want = list(dict.fromkeys(m.lower() for m in re.findall(rules.EMAIL, text)))
        assert one(spark, contacts.emails_in(F.lit(text))) == want, text


def test_cascade_stops_at_own_domain_address(spark):
    home = "<html><body>x@gmail.com <footer>tel 612 345 678</footer></body></html>"
    contact = "<html><body>hola <footer>info@acme.example</footer> 699 999 999</body></html>"
    pages = spark.createDataFrame(
        [(1, "https://acme.example/", home), (2, "https://acme.example/contacto", contact), (3, "https://acme.example/contact", "z@acme.example")],
        "page_id bigint, url string, html string",
    )
    got = rows(contacts.contact_cascade(pages, contacts.contact_sources(pages)))[0]
    assert got["email"] == "info@acme.example" and got["all_emails"] == ["x@gmail.com", "info@acme.example"]
    assert got["all_phones"] == ["612 345 678"] and got["source"] == "footer + /contacto/footer"


def test_completeness(spark):
    c = spark.createDataFrame([("a", " ", "1", [])], "domain string, email string, phone string, social array<string>")
    assert rows(contacts.completeness(c, ["email", "phone", "social"]))[0]["missing"] == ["email", "social"]
    assert rows(contacts.completeness(c, []))[0]["missing"] == []


def test_verdict_texts(spark):
    cases = {"SI": True, "Sí": True, "YES": True, " SI \n": True, "NO": False, "No, esta web no encaja.": False, "": None, "quizás": None}
    for text, want in cases.items():
        assert one(spark, verdicts.yes_no(F.lit(text))) is want, text


def test_category_of_names(spark):
    cases = {"Stripe": "payment", "Vue.js": "frameworks", "Zendesk Chat": "live_chat", "Shopify Payments": "payment",
             "HubSpot CMS": "cms", "Sugar CRM pro": "crm", "Unheard": None, "Cloudflare Bot Management": "security"}
    for name, want in cases.items():
        assert one(spark, tech.category_of(F.lit(name))) == want, name


def test_audit_categories(spark):
    every = one(spark, records.normalize_categories(F.array(F.lit("ALL"))))
    assert "performance" in every and len(every) == 11
    assert one(spark, records.normalize_categories(F.array(F.lit("A11Y"), F.lit("performance")))) == ["accessibility", "performance"]
    assert one(spark, records.normalize_categories(F.array(F.lit("x")))) == every


def test_query_cleanup(spark):
    assert one(spark, prompts.unwrapped(F.lit('"mi query"'))) == "mi query"
    assert one(spark, prompts.unwrapped(F.lit('"a" precio -"b"'))) == '"a" precio -"b"'
    assert one(spark, prompts.canonical_query(F.lit('intitle:"Tienda de Zapatos" site:zapatos'))) == "tienda zapatos"
    refused = F.array(F.lit("shopify"))
    assert one(spark, prompts.names_refused(F.lit("tienda shopify"), refused)) is True
    assert one(spark, prompts.names_refused(F.lit("tienda -shopify"), refused)) is False
    assert one(spark, prompts.names_refused(F.lit("tienda shopifyer"), refused)) is False


def test_types_by_rule(spark):
    cases = {"tienda de ropa": "ecommerce", "software para clínicas": "saas", "agencia de marketing": "agencia", "hola": "web"}
    for text, want in cases.items():
        assert one(spark, prompts.classify_type(F.lit(text)))["label"] == want, text


def test_domain_list(spark, tmp_path):
    path = tmp_path / "domains.csv"
    path.write_text("Domain,x\n a.example ,1\n\nb.example,2\nc.example,3\n")
    assert [r["domain"] for r in rows(records.read_domain_list(spark, str(path), 2, csv=True))] == ["a.example", "b.example"]


def test_sinks_write(spark, tmp_path):
    frame = spark.createDataFrame([("a.example", "u", True, 61.25, "T", ["k"], ["r"], [])],
                                  "domain string, url string, is_valid boolean, confidence double, title string, keywords array<string>, reasons array<string>, rejections array<string>")
    sinks.write_csv(sinks.results_csv(frame), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert back["Confidence Score"] == "61.2" and back["Is Valid"] == "True"
    sinks.write_json(frame, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "envelope")).first().valid_count == 1


def test_queries_of_a_whole_intent(spark):
    fields = "intent_id int, text string, business_type string, product_category string, service_type string, main_keywords array<string>, place string, niche string, style string, audience string, industry string, platform string"
    rows = [
        (1, "quiero zapatos", "Tienda", "zapatos", None, None, "madrid", "eco", "eco", None, None, None),
        (2, "x", "agencia", None, "seo", None, None, None, "vintage", "b2b", "moda", "shopify"),
        (3, "x", "otro", "", "", ["pan", "integral", "casero"], None, "raro", None, "nadie", "", ""),
        (4, "web", None, None, None, None, None, None, None, None, None, None),
        (5, None, "blog", None, None, [], None, None, None, None, None, None),
    ]
    got = {}
    for r in prompts.intent_queries(spark.createDataFrame(rows, fields)).orderBy("intent_id", "ord").collect():
        got.setdefault(r.intent_id, []).append((r["query"], r.weight))
    without = '-"qué es" -wikipedia -"definición" -"guía de" -tutorial'
    assert [q for q, _ in got[1]] == [
        "comprar zapatos online", "tienda zapatos online", "tienda de zapatos", "tienda online zapatos", '"zapatos" "añadir al carrito"',
        '"zapatos" "comprar ahora"', "zapatos shop", '"zapatos" "precio" "envío"', "tienda zapatos madrid", "tienda zapatos ecológico",
        "tienda zapatos natural", f"zapatos tienda online {without}", "comprar zapatos", "venta de zapatos", 'zapatos "checkout"',
        "comprar zapatos madrid", "zapatos ecológico online", "zapatos natural online", f"comprar zapatos {without}", "precio zapatos",
    ]
    assert [q for q, w in got[2] if w <= 0.85] == [
        "seo agency", 'agencia seo "clientes"', "seo vintage", "presupuesto seo", "seo para empresas", "seo empresarial", "agencia seo sector moda", "servicios seo",
    ]
    assert got[3] == [("pan integral", 1.0), ("pan integral online", 0.9), ("pan integral web", 0.85), (f"pan integral {without}", 0.85)]
    # texts of at most five characters ask for too much
    assert [q for q, _ in got[4]] == ["web online", "web web", f"web {without}"] and 5 not in got
    few = prompts.intent_queries(spark.createDataFrame(rows, fields), 3).groupBy("intent_id").count()
    assert {r["count"] for r in few.collect()} == {3}


def test_intents_of_a_model(spark):
    rows = [
        (1, 'So: {"business_type": "SaaS", "location": {"city": "Lugo"}, "prompt_depurado": "crm", "analysis_notes": "n", "must_have": ["a"]}'),
        (2, '{"location": "Madrid", "niche": "", "language": null, "confidence": "high", "validation_indicators": "no list"}'),
        (3, "none"),
        (4, None),
    ]
    got = {r.id: r for r in prompts.parse_intent_rows(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert (got[1].business_type, got[1].location.city, got[1].location.country, got[1].analysis_notes, got[1].target_techs) == ("saas", "Lugo", None, "Prompt depurado: crm | n", ["a"])
    for i in (2, 3, 4):
        r = got[i]
        assert (r.business_type, r.niche, r.language, r.confidence, r.analysis_notes, r.validation_indicators) == ("otro", None, "es", 0.7, "", []), r
        assert tuple(r.location) == (None, None, None) and r.parsed == (i == 2)


def test_plain_reading_of_prompts(spark):
    texts = [
        "agencia de marketing digital en madrid sin hubspot",
        "Tienda online de ropa y zapatos con Shopify y email marketing, que no tenga chat en vivo",
        "software para clínicas con correo y con el Crm-Uno.com, sin email ni pago sin email",
        "empresa de shopify para agencia de pan",
        None,
        "",
    ]
    got = {r.prompt_id: r for r in prompts.read_plainly(spark.createDataFrame(list(enumerate(texts)), "prompt_id int, text string")).collect()}
    assert [(got[i].type, got[i].type_confidence, got[i].short_type) for i in range(6)] == [
        ("agencia", 0.8, "agencia"), ("ecommerce", 0.8, "ecommerce"), ("saas", 0.8, "saas"), ("ecommerce", 0.8, "ecommerce"), ("otro", 0.5, "otro"), ("otro", 0.5, "otro"),
    ]
    # a phrase ends at its first stopword; tools are no part of it
    assert [(got[i].services, got[i].niches) for i in range(6)] == [(["marketing digital"], []), ([], ["ropa"]), (["clínicas"], []), ([], []), ([], []), ([], [])]
    assert (got[0].must_have, got[0].must_not, got[0].tools_refused) == ([], ["hubspot"], ["hubspot"])
    # "chat en" is no name that is known, so it stays as it is when refused
    assert (got[1].must_have, got[1].must_not, got[1].tools_needed, got[1].tools_refused) == (["shopify"], ["chat en"], ["Shopify"], ["chat"])
    assert got[2].must_not == ["email ni", "email_marketing"] and got[2].tools_needed == ["correo", "el"] and got[2].tools_refused == ["email", "email"]
    assert tuple(got[2]["not"]) == (["email ni"], ["email_marketing"])
    for i in (4, 5):
        assert (got[i].must_have, got[i].must_not, got[i].tools_needed, tuple(got[i]["have"])) == ([], [], [], ([], []))


def test_split_of_requirements(spark):
    rows = [(1, ["HubSpot ", "CRM", "livechat", "chat", "email", "mailing", "gestión de clientes", "hubspot"]), (2, None), (3, [])]
    got = {r.i: tuple(r.s) for r in spark.createDataFrame(rows, "i int, n array<string>").select("i", prompts.split_requirements(F.col("n")).alias("s")).collect()}
    assert got == {1: (["hubspot"], ["crm", "chat", "email", "email_marketing"]), 2: ([], []), 3: ([], [])}
