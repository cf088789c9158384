"""Fixed values of the search funnel: caps, blocked platforms, word lists and page states that results depend on."""

RESULTS_PER_QUERY = 20
MAX_RESULTS_DEFAULT = 20
MAX_RESULTS_LIMIT = 100
BUDGET_FACTOR = 6
BUDGET_FLOOR = 60
MIN_CONFIDENCE = 60

# Platform and news hosts that are never the business itself (nor are hosts under them).
BLOCKED_HOSTS = [
    "wikipedia.org", "wikihow.com", "quora.com", "reddit.com",
    "medium.com", "linkedin.com", "facebook.com", "twitter.com", "x.com",
    "youtube.com", "instagram.com", "tiktok.com", "pinterest.com",
    "amazon.com", "amazon.es", "ebay.com", "ebay.es",
    "shopify.com", "wix.com", "wordpress.com", "squarespace.com",
    "hubspot.com", "semrush.com", "ahrefs.com", "moz.com",
    "forbes.com", "entrepreneur.com", "inc.com",
    "coursera.org", "udemy.com",
]

# Words of a title or snippet that mark an article instead of a business.
INFORMATIONAL_WORDS = [
    "qué es ", "que es ", "definición", "guía de", "guia de",
    "cómo crear", "como crear", "tutorial", "artículo", "articulo",
    "wikipedia", "los mejores", "las mejores", "top 10", "comparativa",
    "opiniones sobre", "reseña de",
]

# Page states. Sizes are in characters.
MIN_PAGE_CHARS = 1024
SMALL_PAGE_CHARS = 4000
MIN_BODY_CHARS = 200
PARKED = [
    r"\bdomain\s+is\s+for\s+sale\b",
    r"\bbuy\s+this\s+domain\b",
    r"\bthis\s+domain\s+is\s+parked\b",
    r"\bdominio\s+(?:en\s+venta|aparcado)\b",
    r"\bsedoparking\.com\b",
    r"\bgodaddy\s+parked\b",
    r"\bdan\.com\b",
    r"\bregister\.com\b.*\bparked\b",
    r"\baccount\s+suspended\b",
    r"\bsuspendedpage\.cgi\b",
    r"\bdefault\s+parallels\s+plesk\s+page\b",
    r"\bnginx.*welcome\b",
    r"\bapache.*default\s+page\b",
    r"<title>\s*it\s+works!\s*</title>",
    r"<title>\s*welcome\s+to\s+nginx",
]
BROKEN = [
    r"\b403\s+forbidden\b",
    r"\b404\s+not\s+found\b",
    r"\b500\s+internal\s+server\s+error\b",
    r"\b502\s+bad\s+gateway\b",
    r"\b503\s+service\s+unavailable\b",
    r"\bcoming\s+soon\b",
    r"\bsite\s+is\s+down\b",
    r"\bsitio\s+en\s+construcción\b",
]
