"""Fixed values for scoring: weights, word lists and patterns that results depend on."""

BASE_SCORE = 50
MISSING_PAGE_SCORE = 30
VALID_CONFIDENCE = 50

# Search snippet weights.
VALIDATION_HIT = 10
EXCLUSION_HIT = -15
SNIPPET_INFORMATIONAL = (-20, [
    r"\bqu[eé] es\b", r"\bdefinici[oó]n\b", r"\bgu[ií]a\b",
    r"\bc[oó]mo crear\b", r"\btutorial\b", r"\bart[ií]culo\b",
    r"\bwikipedia\b", r"\bblog\b.*\bpost\b", r"\bnoticias\b",
])
SNIPPET_BUSINESS = (5, [
    r"\bcontact[oa]?\b", r"\btel[eé]fono\b", r"\bprecio\b",
    r"\bcomprar\b", r"\bservicios\b", r"\bportfolio\b",
    r"\bnuestr[oa]s?\b", r"\bempresa\b", r"\bsobre nosotros\b",
])

# Page words with their weight, and page patterns with theirs, per business type.
TYPE_WORDS = {
    "ecommerce": (8, [
        "add to cart", "añadir al carrito", "agregar al carrito",
        "buy now", "comprar ahora", "checkout", "shopping cart",
        "carrito de compra", "precio", "price", "€", "$",
        "envío", "shipping", "delivery", "entrega",
    ]),
    "saas": (6, [
        "pricing", "precios", "free trial", "prueba gratis",
        "sign up", "registrarse", "start free", "get started",
        "features", "características", "integrations", "integraciones",
        "api", "dashboard", "login", "iniciar sesión",
    ]),
    "agencia": (7, [
        "nuestros servicios", "our services", "portfolio",
        "casos de éxito", "case studies", "clientes", "clients",
        "equipo", "team", "about us", "sobre nosotros",
        "contactar", "contact", "presupuesto", "quote",
    ]),
    "other": (5, [
        "contacto", "contact", "teléfono", "phone",
        "email", "dirección", "address", "horario",
        "sobre nosotros", "about us", "empresa", "company",
    ]),
}
TYPE_PATTERNS = {
    "ecommerce": [
        (r"""class=["'][^"']*product[^"']*["']""", 10),
        (r"""class=["'][^"']*cart[^"']*["']""", 10),
        (r"data-price|data-product|data-sku", 10),
        (r"shopify|woocommerce|prestashop", 15),
    ],
    "saas": [(r"""class=["'][^"']*pricing[^"']*["']""", 10), (r"""class=["'][^"']*feature[^"']*["']""", 8)],
    "agencia": [(r"""class=["'][^"']*portfolio[^"']*["']""", 10), (r"""class=["'][^"']*service[^"']*["']""", 8)],
    "other": [],
}

# Informational page patterns with their penalty, and its limit.
INFO_PENALTIES = [
    (r"<article[^>]*>", 10),
    (r"""class=["'][^"']*blog[^"']*["']""", 8),
    (r"""class=["'][^"']*article[^"']*["']""", 8),
    (r"""class=["'][^"']*post[^"']*["']""", 5),
    (r"\bqu[eé] es\b", 15),
    (r"\bdefinici[oó]n\b", 15),
    (r"\bgu[ií]a (completa|definitiva)\b", 10),
    (r"\bc[oó]mo (crear|hacer|empezar)\b", 8),
]
INFO_PENALTY_MAX = 40

# What a JSON-LD type says about a site (types in lower case).
LD_PRODUCT = ["product", "productgroup", "indivisualproduct", "individualproduct"]
LD_ORGANIZATION = ["organization", "corporation", "localbusiness", "store", "onlinestore", "shoppingcenter"]
LD_LOCAL = ["localbusiness", "store"]
LD_LOCAL_SERVICE = [
    "restaurant", "hotel", "medicalclinic", "dentist", "beautysalon", "hairsalon", "spa", "gym", "autodealer",
    "realestateagent",
]
LD_SERVICE = ["service", "professionalservice", "financialservice", "legalservice", "medicalservice"]
LD_SOFTWARE = ["softwareapplication", "webapplication", "mobileapplication", "saasapplication"]
LD_BLOG = ["article", "newsarticle", "blogposting", "blog"]
LD_REVIEW = ["review", "aggregaterating"]
LD_STORE = ["store", "onlinestore", "shoppingcenter"]

# JSON-LD weights as (condition, points) per group of business types, then for every type. "{f}" is the
# facts struct.
LD_WEIGHTS = [
    (["ecommerce", "tienda", "shop", "marketplace"], [
        ("{f}.is_ecommerce", 20),
        ("{f}.has_products", 15),
        ("{f}.has_products AND {f}.product_count >= 3", 5),
        ("{f}.has_offers", 10),
        ("coalesce({f}.price_range, '') <> ''", 5),
        ("{f}.is_blog AND NOT {f}.has_products", -15),
    ]),
    (["saas", "software", "plataforma", "app"], [
        ("{f}.is_software", 25),
        ("array_contains({f}.types_lower, 'softwareapplication')", 15),
        ("{f}.has_reviews", 5),
    ]),
    (["agencia", "agency", "consultora", "servicios"], [
        ("{f}.is_service_business", 20),
        ("{f}.has_services", 15),
        ("{f}.is_local_business", 10),
        ("array_contains({f}.types_lower, 'organization')", 5),
    ]),
    (["local", "negocio local"], [("{f}.is_local_business", 25), ("coalesce({f}.address, '') <> ''", 10)]),
    (["blog"], [("{f}.is_blog", 25)]),
]
LD_WEIGHTS_ALL = [("{f}.has_reviews AND coalesce({f}.aggregate_rating, 0) <> 0", 5), ("coalesce({f}.organization_name, '') <> ''", 5)]

# Content bonuses and the blog penalty.
LD_CONFIRMS_TYPE = 15
CATEGORY_ON_PAGE = 15
SERVICE_ON_PAGE = 15
NICHE_ON_PAGE = 10
NAMED_IN_LD = 10
BLOG_PENALTY = -20

# Speed classes.
FAST_FROM = 90
AVERAGE_FROM = 50
