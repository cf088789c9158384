"""Fixed values for reading page structure: limits, word lists, paths and text layouts that results depend on."""

TITLE_MAX = 300
NAV_TEXT_MAX = 60
NAV_LINKS_MAX = 15
CTA_TEXT_MAX = 80
CTA_MAX = 10
FOOTER_TEXT_MAX = 500
FOOTER_FALLBACK_CHARS = 2000
BODY_TEXT_MAX = 3000
BLOG_MIN_CHARS = 300

# Words that make an anchor a call to action.
CTA_WORDS = [
    "comprar", "contratar", "descargar", "empezar", "registrar",
    "contactar", "solicitar", "probar", "ver", "acceder",
]

# Elements that hold no body text.
NOISE_TAGS = ["script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe"]

# Important paths with their titles.
IMPORTANT_PATHS = {
    "full": [
        ("/contacto", "Contacto"),
        ("/contact", "Contact"),
        ("/about", "Acerca de"),
        ("/quienes-somos", "Quiénes somos"),
        ("/servicios", "Servicios"),
        ("/services", "Services"),
        ("/productos", "Productos"),
        ("/products", "Products"),
        ("/aviso-legal", "Aviso Legal"),
        ("/legal", "Legal"),
        ("/privacidad", "Privacidad"),
        ("/privacy", "Privacy"),
    ],
    "bulk": [
        ("/contacto", "Contacto"),
        ("/contact", "Contact"),
        ("/about", "About"),
        ("/servicios", "Servicios"),
        ("/aviso-legal", "Aviso Legal"),
        ("/privacidad", "Privacidad"),
    ],
}

# Words that mark a sign-up or download offer.
LEAD_WORDS = [
    "suscribirse", "suscríbete", "subscribe", "newsletter", "descarga gratis",
    "free download", "ebook", "guía gratis", "regístrate", "sign up",
    "obtén gratis", "descargar", "get started", "acceso gratuito",
]

# Blog paths in order of preference.
BLOG_PATHS = ["/blog", "/noticias", "/news", "/articulos", "/posts", "/actualidad", "/recursos", "/insights", "/journal"]

# ISO dates, day/month/year dates and dates with a month name.
DATE_PATTERN = (
    r"(?i)(\d{4}-\d{2}-\d{2}|\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}"
    r"|\d{1,2}\s+(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
    r"|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{2,4})"
)

# The context sheet, as (section, [(label, column, is a list)]).
SHEET = [
    ("CONTEXTO DEL SITIO WEB", [
        ("DOMINIO: ", "domain", False),
        ("IDIOMA: ", "lang", False),
        ("TÍTULO: ", "title", False),
        ("DESCRIPCIÓN META: ", "meta_description", False),
        ("OG TYPE: ", "og_type", False),
        ("OG DESC: ", "og_description", False),
    ]),
    ("ESTRUCTURA DE NEGOCIO", [
        ("SECCIONES PRINCIPALES: ", "nav_links", True),
        ("H1 (Propuesta): ", "h1", True),
        ("H2 (Detalles): ", "h2", True),
    ]),
    ("SEÑALES SEMÁNTICAS", [
        ("TIPO DE ENTIDAD (SCHEMA): ", "schema_types", True),
        ("LLAMADAS A LA ACCIÓN: ", "cta_texts", True),
        ("FOOTER (DATOS LEGALES/SECTOR): ", "footer_text", False),
    ]),
    ("CUERPO DE TEXTO (RESUMEN)", [("", "body_text", False)]),
]
