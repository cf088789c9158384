"""Fixed values for collected records: metric audits, mail and hosting providers, side files, result columns."""

# Audit categories and the audits each of them shows.
AUDITS = {
    "performance": ["first-contentful-paint", "largest-contentful-paint", "cumulative-layout-shift", "total-blocking-time",
                    "speed-index", "interactive", "server-response-time"],
    "seo": ["meta-description", "document-title", "robots-txt", "canonical", "hreflang", "structured-data", "viewport",
            "font-size", "tap-targets", "crawlable-anchors", "is-crawlable", "link-text", "http-status-code"],
    "accessibility": ["color-contrast", "image-alt", "label", "aria-allowed-attr", "aria-required-attr",
                      "aria-required-children", "aria-required-parent", "button-name", "document-title", "html-has-lang",
                      "html-lang-valid", "heading-order", "link-name", "form-field-multiple-labels"],
    "best_practices": ["is-on-https", "uses-http2", "no-vulnerable-libraries", "errors-in-console", "deprecations",
                       "no-document-write", "image-aspect-ratio", "valid-source-maps"],
    "core_web_vitals": ["largest-contentful-paint", "cumulative-layout-shift", "interaction-to-next-paint",
                        "first-contentful-paint", "server-response-time"],
    "security": ["is-on-https", "no-vulnerable-libraries", "uses-http2", "csp-xss"],
    "mobile": ["viewport", "tap-targets", "font-size"],
    "third_party": ["third-party-summary", "third-party-facades"],
    "structured_data": ["structured-data"],
    "images": ["uses-optimized-images", "uses-webp-images", "uses-responsive-images", "offscreen-images",
               "image-aspect-ratio", "image-size-responsive"],
    "javascript_quality": ["unused-javascript", "duplicated-javascript", "no-unload-listeners", "no-vulnerable-libraries",
                           "render-blocking-resources"],
}
# Other words for a category.
CATEGORY_SYNONYMS = {
    "seo_score": "seo",
    "performance_score": "performance",
    "speed": "performance",
    "core_web_vitals_score": "core_web_vitals",
    "a11y": "accessibility",
    "bp": "best_practices",
    "bestpractices": "best_practices",
}
# Field data metrics and their short names.
FIELD_METRICS = {
    "LARGEST_CONTENTFUL_PAINT_MS": "lcp_ms",
    "FIRST_CONTENTFUL_PAINT_MS": "fcp_ms",
    "CUMULATIVE_LAYOUT_SHIFT_SCORE": "cls",
    "INTERACTION_TO_NEXT_PAINT": "inp_ms",
    "EXPERIMENTAL_TIME_TO_FIRST_BYTE": "ttfb_ms",
}
DESCRIPTION_MAX = 300

# Parts of a mail host -> provider, first row wins.
MAIL_PROVIDERS = [
    ("google", "Google Workspace"),
    ("outlook", "Microsoft 365"),
    ("microsoft", "Microsoft 365"),
    ("zoho", "Zoho Mail"),
    ("mimecast", "Mimecast"),
    ("proton", "ProtonMail"),
]
# Address prefixes -> hosting provider, first row wins.
HOSTING_PREFIXES = [
    ("Amazon AWS", ["16.", "18.", "52.", "54.", "3.", "35."]),
    ("Cloudflare", ["104.16.", "104.17.", "104.18.", "104.19.", "104.20.", "104.21.", "172.64.", "172.65.", "172.66.",
                    "172.67.", "172.68.", "172.69.", "198.41."]),
    ("Google Cloud", ["34.", "35.", "104.154.", "104.196.", "130.211."]),
    ("Microsoft Azure", ["13.", "20.", "40.", "52.174.", "52.232."]),
    ("DigitalOcean", ["104.236.", "159.65.", "178.62.", "198.199."]),
    ("OVH", ["51.", "54.36.", "91.121.", "137.74."]),
    ("Hetzner", ["5.9.", "23.88.", "49.12.", "78.46.", "88.99.", "95.216."]),
    ("Vercel", ["76.76.21.", "76.223."]),
    ("Netlify", ["75.2.", "99.83."]),
]
# Sitemap paths in order of preference; smallest side files that count (in characters).
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/", "/wp-sitemap.xml"]
ADS_MIN_CHARS = 10
ROBOTS_MIN_CHARS = 5

# Alert texts.
ALERT_EXPIRED = "🔴 Prioridad de Contacto: ALTA — SSL expirado"
ALERT_EXPIRES = ("🔴 Prioridad de Contacto: ALTA — SSL expira en ", " días")
ALERT_EXPIRES_SOON = ("🟠 Prioridad de Contacto: ALTA — SSL expira pronto (", " días)")
ALERT_INVALID = "🔴 Prioridad de Contacto: ALTA — SSL inválido o ausente"
ALERT_NO_PIXEL = "🟡 Prioridad de Contacto: ALTA — Sin ningún píxel de retargeting"
ALERT_PIXELS = "🟡 Prioridad de Contacto: ALTA — Sin píxeles: "
ALERT_REVIEWS = ("💡 Oportunidad — ", " sin sistema de reviews (servicio extra que puedes ofrecer)")
ALERT_TITLE = "⚠️ Falta meta title (SEO)"
ALERT_DESCRIPTION = "⚠️ Falta meta description (SEO)"
KEY_PIXELS = ["Meta Pixel", "Google Tag Mgr", "Google Ads"]
CERTIFICATE_URGENT_DAYS = 14
CERTIFICATE_SOON_DAYS = 30
