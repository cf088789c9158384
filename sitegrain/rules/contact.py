"""Fixed values for contact extraction: patterns, providers, refused words and paths that results depend on."""

# Mailbox providers whose addresses may belong to a business.
GENERIC_PROVIDERS = [
    "gmail.com", "hotmail.com", "live.com", "outlook.com", "icloud.com", "me.com", "yahoo.com", "msn.com", "aol.com",
]
LOCAL_PART_MAX = 25

# Parts of a local part that mark a machine or a shared mailbox.
REFUSED_WORDS = [
    "noreply", "no-reply", "no.reply", "donotreply", "do-not-reply",
    "no-responder", "noresponder", "automail", "automated",
    "mailer-daemon", "postmaster",
    "sentry", "ingest", "endpoint", "status",
    "dev", "developer", "test", "staging", "sandbox", "localhost",
    "example", "crash", "reports", "logs",
    "wordpress", "wix", "shopify", "aws", "azure",
    "webmaster", "hostmaster", "root", "daemon", "ping", "track",
    "bounce", "security", "newsletter", "boletin",
    "notification", "notifications", "alerts", "alerta",
    "marketing-outbound", "promo", "deals",
    "privacy", "legal", "abuse", "spam",
    "captcha", "verification", "confirm",
]

# What an address, a link and a phone number look like.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MAILTO = r"""href=["']mailto:([^"'?]+)"""
TEL = r"""href=["']tel:([^"']+)["']"""
PHONE_NATIONAL = r"(?:\+34\s?)?[6789]\d{2}[\s.-]?\d{3}[\s.-]?\d{3}"
PHONE_INTERNATIONAL = PHONE_NATIONAL + r"|(?:\+\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}"
PHONE_MIN_DIGITS = 9
PHONE_MAX_DIGITS = 15
DUMMY_PHONES = ["123456789", "000000000", "111111111", "999999999"]

# Social profile URLs per platform.
SOCIAL_URLS = [
    ("linkedin", r"https?://(?:www\.)?linkedin\.com/(?:company|in)/[a-zA-Z0-9_-]+/?"),
    ("instagram", r"https?://(?:www\.)?instagram\.com/[a-zA-Z0-9_.]+/?"),
    ("twitter", r"https?://(?:www\.)?(?:twitter\.com|x\.com)/[a-zA-Z0-9_]+/?"),
    ("facebook", r"https?://(?:www\.)?facebook\.com/[a-zA-Z0-9.]+/?"),
    ("youtube", r"https?://(?:www\.)?youtube\.com/(?:c/|channel/|user/|@)?[a-zA-Z0-9_-]+/?"),
    ("tiktok", r"https?://(?:www\.)?tiktok\.com/@[a-zA-Z0-9_.]+/?"),
]
BASIC_PLATFORMS = 4
SOCIAL_REFUSED_BASIC = ["share"]
SOCIAL_REFUSED_FULL = ["share", "sharer", "intent", "dialog", "login", "signup", ".png", ".jpg", ".css", ".js"]

# Handles of linked profiles, with the canonical link of each platform.
HANDLES = [
    ("LinkedIn", r"""href=["']https?://(?:www\.)?linkedin\.com/(?:company|in|school)/([^/"'?\s]+)""", "https://linkedin.com/company/"),
    ("Instagram", r"""href=["']https?://(?:www\.)?instagram\.com/([^/"'?\s]+)""", "https://instagram.com/"),
    ("Facebook", r"""href=["']https?://(?:www\.)?facebook\.com/([^/"'?\s]+)""", "https://facebook.com/"),
    ("Twitter/X", r"""href=["']https?://(?:www\.)?(?:twitter|x)\.com/([^/"'?\s]+)""", "https://x.com/"),
    ("YouTube", r"""href=["']https?://(?:www\.)?youtube\.com/(?:c/|channel/|@)?([^/"'?\s]+)""", "https://youtube.com/"),
    ("TikTok", r"""href=["']https?://(?:www\.)?tiktok\.com/@([^/"'?\s]+)""", "https://tiktok.com/@"),
]
HANDLE_SKIP = r"share|intent/tweet|intent/post|sharing|/like|/reaction"

# Paths tried after the home page, in order.
CONTACT_PATHS = ["/contacto", "/contact", "/about", "/legal", "/aviso-legal", "/kontakt", "/quienes-somos"]
NO_SOURCE = "katana"
