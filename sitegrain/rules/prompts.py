"""Fixed values for prompts, queries and sheets: lexicons, templates and texts that results depend on."""

SHEET_NOTHING = "—"
SHEET_TECH = "Wappalyzer detectó: "
SHEET_NO_TECH = "Wappalyzer (success): sin tecnologías detectadas"
SHEET_TECH_MAX = 25
SHEET_TARGETS = "Targets pedidos:\n"
SHEET_SOCIAL = "Perfiles sociales: "
SHEET_SOCIAL_MAX = 6
SHEET_HOSTS = "Dominios externos: "
SHEET_HOSTS_MAX = 15
SHEET_SCORES = "Scores Lighthouse: "

# Business types in order, with their keywords, strong phrases and confidence.
BUSINESS_TYPES = [
    ("ecommerce", 0.9,
     ["ecommerce", "e-commerce", "tienda online", "tienda", "shop", "store", "venta online", "vender", "comprar",
      "comercio electrónico"],
     ["tienda de", "shop de", "venta de", "ecommerce de"]),
    ("saas", 0.85,
     ["saas", "software", "plataforma", "herramienta", "tool", "aplicación", "app", "sistema", "solución"],
     ["software de", "plataforma de", "herramienta de", "app de"]),
    ("agencia", 0.9,
     ["agencia", "agency", "consultora", "consultoría", "estudio", "empresa de servicios", "despacho"],
     ["agencia de", "consultoría de", "estudio de"]),
    ("marketplace", 0.85, ["marketplace", "mercado", "plataforma de venta", "portal de compra"], ["marketplace de"]),
    ("blog", 0.8, ["blog", "revista", "magazine", "portal de noticias", "medio digital"], ["blog de", "revista de"]),
    ("directorio", 0.8, ["directorio", "listado", "buscador de", "comparador"], ["directorio de", "listado de"]),
    ("portfolio", 0.75, ["portfolio", "portafolio", "trabajos", "proyectos"], ["portfolio de"]),
    ("landing", 0.7, ["landing", "landing page", "página de aterrizaje", "página de venta"], ["landing de"]),
    ("webapp", 0.8, ["webapp", "web app", "aplicación web"], ["webapp de", "aplicación web de"]),
]
KEYWORD_FACTOR = 0.85
DEFAULT_TYPE = ("web", 0.3)

# Labels and the words that give them, first label wins.
INDUSTRIES = [
    ("tecnología", ["tech", "tecnología", "informática", "software", "digital", "it"]),
    ("moda", ["moda", "fashion", "ropa", "vestimenta", "textil", "calzado", "zapatos"]),
    ("belleza", ["belleza", "cosmética", "cosméticos", "maquillaje", "skincare", "cuidado personal"]),
    ("salud", ["salud", "health", "medicina", "médico", "farmacia", "bienestar", "wellness"]),
    ("alimentación", ["alimentación", "comida", "food", "gastronomía", "restaurante", "bebidas"]),
    ("hogar", ["hogar", "casa", "decoración", "muebles", "mobiliario", "interiorismo"]),
    ("deportes", ["deporte", "sports", "fitness", "gym", "ejercicio", "athletic"]),
    ("educación", ["educación", "formación", "cursos", "academia", "escuela", "universidad"]),
    ("finanzas", ["finanzas", "finance", "banca", "inversión", "trading", "crypto", "seguros"]),
    ("inmobiliaria", ["inmobiliaria", "real estate", "propiedades", "vivienda", "alquiler"]),
    ("turismo", ["turismo", "viajes", "travel", "hotel", "vuelos", "vacaciones"]),
    ("automoción", ["coches", "autos", "vehículos", "automotive", "motor", "concesionario"]),
    ("electrónica", ["electrónica", "electronics", "gadgets", "dispositivos", "tecnología"]),
    ("mascotas", ["mascotas", "pets", "animales", "veterinario"]),
    ("infantil", ["infantil", "niños", "bebé", "baby", "kids", "juguetes"]),
    ("arte", ["arte", "art", "artístico", "galería", "creatividad"]),
    ("música", ["música", "music", "instrumentos", "audio"]),
    ("gaming", ["gaming", "videojuegos", "juegos", "esports", "gamer"]),
]
NICHES = [
    ("luxury", ["lujo", "luxury", "premium", "exclusivo", "high-end", "alta gama"]),
    ("budget", ["barato", "económico", "low cost", "asequible", "precio bajo", "ofertas"]),
    ("eco", ["ecológico", "eco", "sostenible", "sustainable", "natural", "orgánico", "bio", "verde", "eco-friendly",
             "vegano", "cruelty-free"]),
    ("vintage", ["vintage", "retro", "antiguo", "clásico", "second hand", "segunda mano"]),
    ("artesanal", ["artesanal", "handmade", "hecho a mano", "artesano", "craft"]),
    ("profesional", ["profesional", "enterprise", "empresarial", "corporativo", "business"]),
    ("startup", ["startup", "emprendedor", "pyme", "pequeña empresa", "nuevo negocio"]),
    ("minimalista", ["minimalista", "minimal", "simple", "clean", "sencillo"]),
    ("old_money", ["old money", "clásico elegante", "tradicional", "heritage", "preppy"]),
    ("streetwear", ["streetwear", "urban", "urbano", "street style", "casual"]),
    ("boho", ["boho", "bohemio", "hippie", "étnico", "tribal"]),
]
NICHE_PRICES = {"luxury": "alto", "budget": "bajo", "old_money": "alto"}
NICHE_STYLES = ["old_money", "minimalista", "streetwear", "boho", "vintage"]
AUDIENCES = [
    ("b2b", ["b2b", "empresas", "negocios", "corporativo", "business to business", "profesionales"]),
    ("b2c", ["b2c", "consumidores", "particulares", "clientes finales"]),
    ("mujeres", ["mujeres", "mujer", "femenino", "para ella", "women", "female"]),
    ("hombres", ["hombres", "hombre", "masculino", "para él", "men", "male"]),
    ("jóvenes", ["jóvenes", "juvenil", "teens", "adolescentes", "millennials", "gen z"]),
    ("adultos", ["adultos", "mayores", "senior", "tercera edad"]),
    ("familias", ["familias", "familiar", "family", "niños y padres"]),
    ("profesionales", ["profesionales", "expertos", "especialistas"]),
]
LOCATIONS = [
    ("españa", ["españa", "spain", "spanish", "español"]),
    ("madrid", ["madrid", "madrileño"]),
    ("barcelona", ["barcelona", "bcn", "cataluña"]),
    ("valencia", ["valencia", "valenciano"]),
    ("sevilla", ["sevilla", "andalucía"]),
    ("bilbao", ["bilbao", "país vasco", "euskadi"]),
    ("málaga", ["málaga", "costa del sol"]),
    ("méxico", ["méxico", "mexico", "mexicano", "cdmx", "df"]),
    ("argentina", ["argentina", "argentino", "buenos aires"]),
    ("colombia", ["colombia", "colombiano", "bogotá", "medellín"]),
    ("chile", ["chile", "chileno", "santiago"]),
    ("perú", ["perú", "peru", "peruano", "lima"]),
    ("usa", ["usa", "estados unidos", "eeuu", "american", "us"]),
    ("uk", ["uk", "reino unido", "british", "london", "londres"]),
    ("europa", ["europa", "european", "eu"]),
    ("latam", ["latam", "latinoamérica", "hispanoamérica"]),
]
NATIONAL = ["españa", "méxico", "argentina", "colombia", "usa", "uk"]
REGIONAL = ["europa", "latam"]
PLATFORMS = [
    ("shopify", ["shopify"]),
    ("wordpress", ["wordpress", "wp", "woocommerce"]),
    ("magento", ["magento"]),
    ("prestashop", ["prestashop"]),
    ("custom", ["custom", "personalizado", "a medida"]),
    ("wix", ["wix"]),
    ("squarespace", ["squarespace"]),
]
SPEEDS = [
    ("rápida", ["rápida", "rápido", "fast", "veloz", "velocidad alta", "carga rápida"]),
    ("lenta", ["lenta", "lento", "slow", "carga lenta", "velocidad baja"]),
]
MODIFIERS = ["mejor", "mejores", "top", "bueno", "buenos", "profesional", "especializado", "especializada", "recomendado",
             "popular", "2024", "2025", "nuevo", "nuevos", "actual", "moderno"]
ENGLISH_WORDS = ["the", "and", "for", "with", "that", "shop", "store", "agency"]
SPANISH_WORDS = ["de", "para", "con", "que", "tienda", "agencia", "empresa"]

# Phrases that name the product or service, in order.
PHRASES = [
    r"(?:tienda|ecommerce|e-commerce|shop|store|venta)\s+(?:online\s+)?(?:de\s+)?([^,.\-]+?)(?:\s+online|\s+en\s+|\s+con\s+|$)",
    r"(?:agencia|agency|consultor[ií]a|estudio|empresa)\s+(?:de\s+)?([^,.\-]+?)(?:\s+en\s+|\s+con\s+|$)",
    r"(?:software|plataforma|herramienta|app|saas|sistema)\s+(?:de|para)\s+([^,.\-]+?)(?:\s+online|\s+con\s+|$)",
    r"([^,.\-]+?)\s+(?:online|shop|store|tienda)(?:\s|$)",
]

# Tools and categories a requirement may name, and the words around it.
TOOLS = [
    ("crm", ["crm", "hubspot", "salesforce", "zoho", "pipedrive", "freshsales", "copper", "monday", "close"]),
    ("hubspot", ["hubspot"]),
    ("salesforce", ["salesforce"]),
    ("zoho", ["zoho", "zoho crm"]),
    ("pipedrive", ["pipedrive"]),
    ("chat", ["chat", "livechat", "live chat", "chat en vivo", "widget de chat"]),
    ("intercom", ["intercom"]),
    ("drift", ["drift"]),
    ("crisp", ["crisp"]),
    ("zendesk", ["zendesk"]),
    ("tidio", ["tidio"]),
    ("tawk", ["tawk", "tawk.to"]),
    ("email marketing", ["email marketing", "newsletter", "mailchimp", "klaviyo", "mailerlite"]),
    ("mailchimp", ["mailchimp"]),
    ("klaviyo", ["klaviyo"]),
    ("activecampaign", ["activecampaign", "active campaign"]),
    ("analytics", ["analytics", "analíticas", "google analytics", "métricas"]),
    ("google analytics", ["google analytics", "ga4", "gtag"]),
    ("hotjar", ["hotjar"]),
    ("heatmaps", ["heatmap", "heatmaps", "mapas de calor", "grabación de sesiones"]),
    ("popups", ["popup", "popups", "ventanas emergentes", "optinmonster", "sumo"]),
    ("reviews", ["reviews", "reseñas", "trustpilot", "yotpo"]),
    ("stripe", ["stripe"]),
    ("paypal", ["paypal"]),
    ("wordpress", ["wordpress", "wp"]),
    ("shopify", ["shopify"]),
    ("woocommerce", ["woocommerce", "woo"]),
]
WORD = r"[\p{L}\p{N}_]+"
REQUIRED = [
    r"(?:que tenga|con|usando|que use|que utilice)\s+(WORD(?:\s+WORD)?)",
    r"(?:con herramienta de|con sistema de)\s+(WORD(?:\s+WORD)?)",
]
EXCLUDED = [
    r"(?:que no tenga|sin|que no use|que no utilice|sin usar)\s+(WORD(?:\s+WORD)?)",
    r"(?:sin herramienta de|sin sistema de|sin ningún|sin ninguna)\s+(WORD(?:\s+WORD)?)",
    r"(?:no tenga|no use|no utilice)\s+(WORD(?:\s+WORD)?)",
]
NOT_A_TOOL = ["que", "con", "sin", "una", "un", "el", "la", "web", "webs", "página", "páginas", "sitio", "sitios", "tienda",
              "tiendas", "empresa", "empresas", "negocio", "negocios"]

# Query templates (weight, pattern) per business type; "{t}" is the term.
QUERY_TEMPLATES = {
    "ecommerce": [
        (1.0, "comprar {t} online"), (1.0, "tienda {t} online"), (1.0, "tienda online de {t}"), (0.9, "{t} shop online"),
        (0.9, "venta de {t} online"), (0.8, "{t} precio"), (0.8, "{t} ofertas"), (0.7, "{t} envío gratis"),
        (0.9, '"{t}" "añadir al carrito"'), (0.9, '"{t}" "comprar ahora"'), (0.8, '"{t}" "envío" "precio"'),
        (0.8, "tienda {t} españa"), (0.7, "comprar {t} madrid"), (0.7, "tienda {t} barcelona"), (0.6, "{t} tienda mexico"),
        (0.6, "{t} store usa"), (0.9, '{t} tienda -"qué es" -wikipedia -blog'),
        (0.9, '{t} comprar -"cómo crear" -tutorial -guía'), (0.7, "mejores tiendas de {t}"), (0.7, "{t} tienda especializada"),
    ],
    "saas": [
        (1.0, "{t} software"), (1.0, "{t} herramienta online"), (0.9, "{t} plataforma"), (0.9, "{t} tool"), (0.8, "{t} app"),
        (0.9, '"{t}" "prueba gratis"'), (0.9, '"{t}" "free trial"'), (0.9, '"{t}" pricing'), (0.8, '"{t}" "planes" "precio"'),
        (0.8, '"{t}" "registrarse"'), (0.8, "alternativas a {t}"), (0.7, "{t} vs"), (0.7, "mejor {t} software 2024"),
        (0.8, "{t} para empresas"), (0.7, "{t} para pymes"), (0.7, "{t} para startups"),
        (0.9, '{t} software -"qué es" -definición -wikipedia'),
    ],
    "agencia": [
        (1.0, "agencia de {t}"), (1.0, "agencia {t}"), (0.9, "empresa de {t}"), (0.8, "consultoría {t}"), (0.8, "{t} agency"),
        (0.9, 'agencia {t} "nuestros servicios"'), (0.9, 'agencia {t} "portfolio"'), (0.8, 'agencia {t} "casos de éxito"'),
        (0.8, 'agencia {t} "clientes"'), (0.8, '"agencia de {t}" "contacto"'), (0.9, "agencia {t} madrid"),
        (0.9, "agencia {t} barcelona"), (0.8, "agencia {t} valencia"), (0.8, "agencia {t} sevilla"),
        (0.7, "agencia {t} méxico df"), (0.7, "agencia {t} buenos aires"), (0.6, "{t} agency london"),
        (0.6, "{t} agency new york"), (0.9, "contratar agencia {t}"), (0.7, "presupuesto {t}"),
        (0.9, 'agencia {t} -"cómo montar" -"qué es" -curso'),
    ],
    "other": [
        (1.0, "{t}"), (0.9, "{t} españa"), (0.8, "{t} online"), (0.8, '"{t}" "contacto"'), (0.8, '"{t}" "servicios"'),
        (0.7, "{t} empresa"), (0.7, "{t} profesional"), (0.9, '{t} -wikipedia -"qué es" -definición'),
        (0.8, "{t} -blog -artículo -guía"),
    ],
}
TEMPLATE_TYPES = {
    "ecommerce": ["ecommerce", "tienda", "shop", "store"],
    "saas": ["saas", "software", "plataforma", "app", "tool"],
    "agencia": ["agencia", "agency", "consultora", "consultoría"],
}
NICHE_MODIFIERS = [
    ("luxury", ["lujo", "premium", "exclusivo", "luxury", "high-end"]),
    ("budget", ["barato", "económico", "low cost", "ofertas", "descuentos"]),
    ("eco", ["ecológico", "sostenible", "eco-friendly", "orgánico", "natural"]),
    ("vintage", ["vintage", "retro", "antiguo", "clásico", "second hand"]),
    ("modern", ["moderno", "contemporáneo", "minimalista", "modern"]),
    ("professional", ["profesional", "enterprise", "corporativo", "business"]),
    ("startup", ["startup", "emprendedor", "pyme", "pequeña empresa"]),
]
NICHE_QUERIES = [(0.85, "{t} {m}"), (0.8, "tienda {t} {m}")]
LOCATION_QUERIES = {"agencia": (0.85, "agencia {t} {m}"), "ecommerce": (0.75, "tienda {t} {m}"), "other": (0.7, "{t} {m}")}
LOCATIONS_MAX = 4
QUERIES_MAX = 15
TRANSACTIONAL = {
    "ecommerce": ["comprar {t}", "precio {t}", "ofertas {t}", "{t} envío 24h", "dónde comprar {t}"],
    "saas": ["{t} pricing", "{t} free trial", "probar {t} gratis", "registrarse {t}", "descargar {t}"],
    "agencia": ["contratar {t}", "presupuesto {t}", "servicios de {t}", "{t} tarifas", "pedir presupuesto {t}"],
    "other": ["contratar {t}", "{t} servicios", "{t} precios"],
}
COMPETITOR = ["alternativas a {t}", "sitios como {t}", "{t} vs", "competidores de {t}", "mejor que {t}", "parecido a {t}"]
EXCLUSION_SUFFIX = ' -"qué es" -wikipedia -"definición" -"guía de"'

# Queries of a whole intent, part by part: (types, or none for all others, [(weight, pattern)]). "{t}" is the
# term, "{m}" a word of the part (place, niche word, audience word, industry, platform).
INTENT_QUERIES = {
    "base": [
        (["ecommerce", "tienda", "shop", "marketplace"], [
            (1.0, "comprar {t} online"), (1.0, "tienda {t} online"), (0.95, "tienda de {t}"), (0.95, "tienda online {t}"),
            (0.9, "{t} shop"), (0.85, "venta de {t}"),
        ]),
        (["saas", "software", "plataforma", "app", "webapp"], [
            (1.0, "{t} software"), (1.0, "{t} herramienta online"), (0.95, "{t} plataforma"), (0.95, "software de {t}"),
            (0.9, "{t} tool"), (0.85, "{t} app"),
        ]),
        (["agencia", "agency", "consultora", "consultoría"], [
            (1.0, "agencia de {t}"), (1.0, "agencia {t}"), (0.95, "empresa de {t}"), (0.9, "consultoría {t}"), (0.85, "{t} agency"),
        ]),
        (["blog"], [(1.0, "blog de {t}"), (0.9, "revista {t}"), (0.85, "{t} magazine")]),
        ([], [(1.0, "{t}"), (0.9, "{t} online"), (0.85, "{t} web")]),
    ],
    "indicator": [
        (["ecommerce", "tienda", "shop", "marketplace"], [
            (0.95, '"{t}" "añadir al carrito"'), (0.95, '"{t}" "comprar ahora"'), (0.9, '"{t}" "precio" "envío"'), (0.85, '{t} "checkout"'),
        ]),
        (["saas", "software", "plataforma"], [
            (0.95, '"{t}" "free trial"'), (0.95, '"{t}" "prueba gratis"'), (0.9, '"{t}" pricing'), (0.85, '"{t}" "registrarse"'),
        ]),
        (["agencia", "agency"], [
            (0.95, 'agencia {t} "portfolio"'), (0.95, 'agencia {t} "nuestros servicios"'), (0.9, 'agencia {t} "casos de éxito"'),
            (0.85, 'agencia {t} "clientes"'),
        ]),
    ],
    "location": [
        (["ecommerce", "tienda"], [(0.9, "tienda {t} {m}"), (0.85, "comprar {t} {m}"), (0.8, "{t} online {m}")]),
        (["agencia", "agency"], [(0.95, "agencia {t} {m}"), (0.9, "agencia {t} en {m}"), (0.85, "empresa {t} {m}")]),
        (["saas", "software"], [(0.85, "{t} software {m}"), (0.8, "{t} plataforma {m}")]),
        ([], [(0.85, "{t} {m}"), (0.8, "{t} en {m}")]),
    ],
    "niche": [(["ecommerce", "tienda"], [(0.9, "tienda {t} {m}"), (0.85, "{t} {m} online")]), ([], [(0.85, "{t} {m}")])],
    "audience": [
        (["ecommerce", "tienda"], [(0.85, "tienda {t} {m}")]),
        (["saas", "software"], [(0.85, "{t} software {m}")]),
        ([], [(0.8, "{t} {m}")]),
    ],
    "industry": [
        (["ecommerce", "tienda"], [(0.8, "tienda {m} {t}")]),
        (["agencia"], [(0.8, "agencia {t} sector {m}")]),
        ([], [(0.75, "{t} {m}")]),
    ],
    "exclusion": [
        (["ecommerce", "tienda"], [(0.9, "{t} tienda online {x}"), (0.85, "comprar {t} {x}")]),
        (["saas", "software"], [(0.9, "{t} software {x}")]),
        (["agencia"], [(0.9, "agencia {t} {x}")]),
        ([], [(0.85, "{t} {x}")]),
    ],
    "transactional": [
        (["ecommerce", "tienda"], [(0.9, "comprar {t}"), (0.85, "precio {t}"), (0.85, "dónde comprar {t}"), (0.8, "{t} envío rápido")]),
        (["saas", "software"], [(0.9, "{t} pricing"), (0.85, "probar {t} gratis"), (0.8, "contratar {t}")]),
        (["agencia"], [(0.9, "contratar agencia {t}"), (0.85, "presupuesto {t}"), (0.8, "servicios {t}")]),
    ],
    "platform": [(["ecommerce", "tienda"], [(0.85, "tienda {t} {m}"), (0.8, "{t} {m} store")])],
}
INTENT_EXCLUSIONS = '-"qué es" -wikipedia -"definición" -"guía de" -tutorial'
INTENT_NICHE_WORDS = {
    "luxury": ["lujo", "premium", "exclusivo"],
    "budget": ["barato", "económico", "ofertas"],
    "eco": ["ecológico", "natural", "sostenible", "orgánico"],
    "vintage": ["vintage", "retro", "segunda mano"],
    "artesanal": ["artesanal", "handmade", "hecho a mano"],
    "old_money": ["old money", "clásico", "elegante"],
    "minimalista": ["minimalista", "minimal"],
    "streetwear": ["streetwear", "urban"],
}
INTENT_AUDIENCE_WORDS = {
    "b2b": ["para empresas", "empresarial", "business"],
    "b2c": ["para consumidores"],
    "mujeres": ["para mujer", "femenino", "women"],
    "hombres": ["para hombre", "masculino", "men"],
    "jóvenes": ["juvenil", "joven"],
    "profesionales": ["profesional", "expertos"],
}
INTENT_QUERIES_MAX, INTENT_QUERY_CHARS = 20, 6

# Words that never count in a query's canonical form, query operators, and leftovers of instructions.
STOPWORDS = ["de", "del", "la", "el", "los", "las", "un", "una", "unos", "unas", "y", "o", "u", "que", "en", "con", "para", "por",
             "al", "a", "lo", "of", "the", "an", "and", "or", "to", "for", "in", "on", "with", "from", "by"]
QUERY_OPERATORS = "intitle|inurl|site|filetype|cache|or|and"
SKIP_PREFIXES = ["query ", "exactamente", "ninguna query", "no incluyas", "cada query", "si el prompt", "usa operadores",
                 "lista de", "no uses", "mezcla", "incluye", "deben ser 15", "ejemplo:", "example:"]
QUERY_MIN_CHARS = 4

# Words that speak for and against a page, per business type.
VALIDATION_WORDS = {
    "ecommerce": ["añadir al carrito", "add to cart", "comprar", "buy now", "precio", "price", "€", "$", "envío", "shipping",
                  "carrito", "cart", "checkout", "pagar", "stock", "talla", "color", "cantidad", "productos"],
    "saas": ["pricing", "precios", "planes", "free trial", "prueba gratis", "registrarse", "sign up", "login", "dashboard",
             "features", "características", "integraciones", "api", "demo"],
    "agencia": ["nuestros servicios", "portfolio", "casos de éxito", "clientes", "equipo", "contacto", "presupuesto",
                "about us", "sobre nosotros", "trabajos", "proyectos"],
    "blog": ["artículos", "posts", "categorías", "autor", "publicado", "suscríbete", "newsletter"],
    "other": ["contacto", "servicios", "productos", "sobre nosotros", "empresa", "equipo"],
}
INDICATOR_TYPES = {
    "ecommerce": ["ecommerce", "tienda", "shop", "marketplace"],
    "saas": ["saas", "software", "plataforma", "app"],
    "agencia": ["agencia", "agency", "consultora"],
    "blog": ["blog"],
}
NICHE_WORDS = {"eco": ["ecológico", "natural", "orgánico", "sostenible"], "luxury": ["premium", "exclusivo", "lujo"]}
LOCATION_WORDS = ["dirección", "oficina"]
EXCLUSION_WORDS = ["qué es", "definición", "cómo crear", "tutorial", "wikipedia", "guía completa", "artículo", "blog post",
                   "curso de", "aprende a"]
BLOG_EXCLUSION_WORDS = ["wikipedia", "definición de diccionario"]

# Sectors and places of a product description, and the prompt made of them.
SECTORS = [
    ("ecommerce", ["tienda", "ecommerce", "venta online", "shopify", "woocommerce"]),
    ("agencia", ["agencia", "marketing", "publicidad", "diseño", "creative"]),
    ("saas", ["saas", "software", "plataforma", "herramienta", "app"]),
    ("pyme", ["pyme", "empresa", "negocio", "autónomo"]),
    ("restaurante", ["restaurante", "bar", "hostelería", "comida"]),
    ("clinica", ["clínica", "médico", "salud", "dental", "fisio"]),
]
DEFAULT_SECTOR = "empresa"
PLACES = r"españa|spain|madrid|barcelona|mexico|latam|latinoamérica"
BUYER_PROMPT = " que necesite solución como la descrita"
PROMPT_MAX = 200

# Audience, scale and quality labels of a prompt with their confidences, and places (city, country).
PROFILE_AUDIENCE = (0.8, [
    ("B2B", ["b2b", "empresas", "corporativo", "business"]),
    ("pymes", ["pymes", "pequeñas empresas", "pyme"]),
    ("freelancers", ["freelance", "autónomo", "freelancer"]),
])
PROFILE_SCALE = (0.7, [
    ("enterprise", ["grande", "enterprise", "corporación"]),
    ("small", ["pequeña", "pequeño", "pyme", "startup"]),
    ("medium", ["mediana", "mediano"]),
])
PROFILE_QUALITY = (0.8, [
    ("good_seo", ["buen seo", "bien posicionado", "good seo"]),
    ("mal_seo", ["mal seo", "mal posicionado", "bad seo"]),
])
PROFILE_PLACES = [
    ("madrid", "Madrid", "España"),
    ("barcelona", "Barcelona", "España"),
    ("españa", None, "España"),
    ("spain", None, "España"),
    ("méxico", None, "México"),
    ("mexico", None, "México"),
    ("usa", None, "USA"),
    ("estados unidos", None, "USA"),
]

# What an intent has where the model says nothing, and how notes name the cleaned prompt.
UNKNOWN_TYPE, CONFIDENCE = "otro", 0.7
CLEANED_NOTE = "Prompt depurado: "

# The two plain lexicons of business types, first type wins, and their confidence and default.
FIRST_TYPES = [
    ("ecommerce", ["ecommerce", "e-commerce", "tienda online", "tiendas online", "tienda de", "tiendas de", "shop", "store",
                   "venta de", "vender", "comercio electrónico"]),
    ("agencia", ["agencia", "agency", "consultora", "consultoría", "estudio de"]),
    ("saas", ["saas", "software", "plataforma", "herramienta", "app de", "tool"]),
    ("blog", ["blog", "revista", "magazine", "portal de noticias"]),
    ("marketplace", ["marketplace", "mercado de"]),
    ("directorio", ["directorio", "listado de", "buscador de"]),
]
FIRST_TYPE_CONFIDENCE, NO_TYPE_CONFIDENCE = 0.8, 0.5
SHORT_TYPES = [
    ("ecommerce", ["tienda", "shop", "ecommerce", "comprar", "vender", "producto", "online store"]),
    ("saas", ["saas", "software", "herramienta", "plataforma", "app", "tool"]),
    ("agencia", ["agencia", "agency", "estudio", "consultora", "freelance"]),
    ("blog", ["blog", "artículos", "noticias", "revista", "media"]),
    ("marketplace", ["marketplace", "plataforma de venta", "multi-vendor"]),
    ("servicio_local", ["restaurante", "bar", "peluquería", "clínica", "dentista", "fontanero"]),
]

# Phrases that name a service or niche, and words that end them or do not belong to them.
SERVICE_PHRASES = [
    r"(?:agencia|empresa|consultora)\s+de\s+([^,\.]+?)(?:\s+(?:en|sin|con|para)\s|$)",
    r"(?:saas|software|plataforma|herramienta)\s+(?:de|para)\s+([^,\.]+?)(?:\s+(?:en|sin|con|para)\s|$)",
]
NICHE_PHRASES = [r"(?:tienda|ecommerce|shop|tiendas)\s+(?:online\s+)?de\s+(WORD(?:\s+WORD)?)"]
PHRASE_ENDS = ["sin", "con", "en", "para", "que", "el", "la", "los", "las", "y", "o", "b2b", "b2c"]
PHRASE_PLACES = ["madrid", "barcelona", "españa", "spain", "mexico", "méxico", "usa", "eeuu"]
PHRASE_TOOLS = ["shopify", "wordpress", "hubspot", "mailchimp", "stripe", "woocommerce", "crm", "chat"]

# Technologies that a requirement may name, by category, and the other names of categories.
KNOWN_TECHNOLOGIES = {
    "crm": ["hubspot", "salesforce", "zoho", "pipedrive", "freshsales", "copper", "monday", "close", "insightly", "nimble",
            "zendesk sell", "microsoft dynamics", "sugarcrm", "vtiger", "odoo"],
    "email_marketing": ["mailchimp", "klaviyo", "activecampaign", "convertkit", "sendinblue", "brevo", "getresponse", "drip",
                        "constant contact", "aweber", "omnisend", "moosend", "mailerlite", "campaign monitor", "sendgrid"],
    "live_chat": ["intercom", "drift", "crisp", "zendesk", "tidio", "tawk", "livechat", "freshchat", "olark", "chatra",
                  "userlike", "smartsupp", "customerly", "helpcrunch", "gorgias", "zopim"],
    "analytics": ["google analytics", "ga4", "google tag manager", "gtm", "hotjar", "mixpanel", "amplitude", "heap",
                  "fullstory", "mouseflow", "crazy egg", "clarity", "smartlook", "matomo", "plausible", "fathom", "segment"],
    "ecommerce_platform": ["shopify", "woocommerce", "magento", "prestashop", "bigcommerce", "opencart", "vtex",
                           "salesforce commerce", "sap commerce", "wix stores", "squarespace commerce", "ecwid", "volusion",
                           "3dcart", "nopcommerce", "cs-cart"],
    "payment": ["stripe", "paypal", "square", "braintree", "adyen", "klarna", "afterpay", "affirm", "redsys", "bizum",
                "mollie", "worldpay", "checkout.com", "razorpay", "mercado pago"],
    "cms": ["wordpress", "joomla", "drupal", "wix", "squarespace", "webflow", "ghost", "contentful", "strapi", "sanity",
            "prismic", "typo3", "sitecore", "kentico", "umbraco", "hubspot cms"],
    "frameworks": ["react", "vue", "angular", "next.js", "nuxt", "gatsby", "svelte", "ember", "backbone", "jquery",
                   "bootstrap", "tailwind"],
    "hosting": ["aws", "google cloud", "azure", "cloudflare", "vercel", "netlify", "heroku", "digitalocean", "linode",
                "godaddy", "bluehost", "siteground"],
    "marketing_automation": ["marketo", "pardot", "eloqua", "autopilot", "drip", "infusionsoft", "keap", "sharpspring", "act-on"],
    "ab_testing": ["optimizely", "vwo", "ab tasty", "google optimize", "unbounce"],
    "popup_tools": ["optinmonster", "sumo", "privy", "sleeknote", "wisepops", "popupsmart"],
    "reviews": ["trustpilot", "yotpo", "judge.me", "stamped", "reviews.io", "bazaarvoice"],
}
CATEGORY_NAMES = [
    ("crm", ["crm", "gestión de clientes", "customer relationship"]),
    ("chat", ["chat", "livechat", "live chat", "chat en vivo", "chat online"]),
    ("email_marketing", ["email_marketing", "email marketing", "email", "mailing", "newsletter", "correo"]),
    ("analytics", ["analytics", "analíticas", "tracking", "rastreo"]),
    ("payment", ["payment", "pago", "pasarela de pago"]),
]
NEEDS = [r"que tenga\s+", r"con\s+", r"usando\s+", r"que use\s+", r"con el\s+", r"que incluya\s+"]
REFUSALS = [r"sin\s+", r"que no tenga\s+", r"excluir\s+", r"no\s+usar\s+", r"no\s+incluir\s+", r"que no use\s+", r"sin ningún\s+",
            r"sin ninguna\s+"]
NAMED = r"(WORD(?:\s+WORD)?)"
NEVER_NAMED = ["en", "de", "para", "con", "el", "la", "los", "las", "que", "y", "o", "un", "una"]

# Requirements that are categories in the split, and their other names there.
SPLIT_CATEGORIES = ["crm", "chat", "live_chat", "email_marketing", "email", "analytics", "ecommerce", "payment", "cms", "hosting"]
SPLIT_NAMES = [
    ("chat", ["chat en vivo", "livechat", "chat online"]),
    ("crm", ["gestión de clientes"]),
    ("email_marketing", ["email", "mailing", "newsletter"]),
    ("analytics", ["analíticas", "tracking", "rastreo"]),
    ("payment", ["pago", "pasarela de pago"]),
]

# Single tool names after a word that asks for them or refuses them.
TOOL_NAME = r"([a-zA-Z][a-zA-Z0-9_\-]*(?:\.[a-zA-Z]{2,5})?)"
TOOL_NEEDED = r"(?:con|with|que\s+use[n]?|que\s+ten[ga]+|usando)\s+"
TOOL_REFUSED = r"(?:sin|no|without|excluir|evitar|que\s+no\s+use[n]?|que\s+no\s+ten[ga]+)\s+"
