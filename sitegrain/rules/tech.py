"""Fixed values for technology detection: hosts, fingerprints, signatures and categories that results depend on.

Patterns are written once, as plain regular expressions without case. Order matters: where only one row may win,
the first does.
"""

# Third-party host (or any host under it) -> technology.
HOST_TECH = [
    ("list-manage.com", "Mailchimp"), ("chimpstatic.com", "Mailchimp"), ("mailchimp.com", "Mailchimp"),
    ("klaviyo.com", "Klaviyo"), ("static.klaviyo.com", "Klaviyo"),
    ("hubspot.com", "HubSpot"), ("hs-scripts.com", "HubSpot"), ("hs-banner.com", "HubSpot"),
    ("hsforms.net", "HubSpot"), ("hs-analytics.net", "HubSpot"),
    ("stripe.com", "Stripe"), ("js.stripe.com", "Stripe"),
    ("paypal.com", "PayPal"), ("paypalobjects.com", "PayPal"),
    ("calendly.com", "Calendly"), ("hooks.zapier.com", "Zapier"),
    ("googletagmanager.com", "Google Tag Manager"), ("google-analytics.com", "Google Analytics"),
    ("googleadservices.com", "Google Ads"), ("doubleclick.net", "Google Ads (DoubleClick)"),
    ("facebook.net", "Facebook Pixel"), ("connect.facebook.net", "Facebook Pixel"),
    ("hotjar.com", "Hotjar"), ("mixpanel.com", "Mixpanel"), ("cdn.mxpnl.com", "Mixpanel"),
    ("segment.com", "Segment"), ("segment.io", "Segment"), ("amplitude.com", "Amplitude"),
    ("intercom.io", "Intercom"), ("intercomcdn.com", "Intercom"),
    ("drift.com", "Drift"), ("driftt.com", "Drift"),
    ("crisp.chat", "Crisp"), ("crisp.im", "Crisp"), ("tidio.co", "Tidio"),
    ("zendesk.com", "Zendesk"), ("zdassets.com", "Zendesk"),
    ("cloudflare.com", "Cloudflare"), ("cdn.cloudflare.com", "Cloudflare"),
    ("vercel.app", "Vercel"), ("netlify.app", "Netlify"),
    ("shopify.com", "Shopify"), ("shopifycdn.com", "Shopify"), ("myshopify.com", "Shopify"),
    ("wp.com", "WordPress.com"), ("wordpress.com", "WordPress.com"),
    ("activecampaign.com", "ActiveCampaign"), ("brevo.com", "Brevo"), ("sendinblue.com", "Brevo"),
    ("convertkit.com", "ConvertKit"), ("recaptcha.net", "reCAPTCHA"),
    ("tiktok.com", "TikTok"), ("ads-twitter.com", "Twitter Ads"), ("static.ads-twitter.com", "Twitter Ads"),
    ("snap.licdn.com", "LinkedIn Insight"), ("px.ads.linkedin.com", "LinkedIn Insight"),
    ("ct.pinterest.com", "Pinterest Tag"),
]

# Fingerprints on the whole page as (technology, category, patterns); any pattern is a hit.
FINGERPRINTS = [
    ("HubSpot", "crm", [r"js\.hs-scripts\.com", r"js\.hsforms\.net", r"hubspot"]),
    ("Salesforce", "crm", [r"force\.com", r"salesforce\.com"]),
    ("Zoho", "crm", [r"zoho\.com", r"salesiq\.zoho"]),
    ("Pipedrive", "crm", [r"pipedrive\.com"]),
    ("Mailchimp", "email_marketing", [r"mailchimp\.com", r"list-manage\.com", r"chimpstatic"]),
    ("Klaviyo", "email_marketing", [r"klaviyo\.com", r"static\.klaviyo"]),
    ("ActiveCampaign", "email_marketing", [r"activecampaign\.com", r"activehosted\.com"]),
    ("Intercom", "live_chat", [r"intercom\.io", r"intercomcdn\.com"]),
    ("Drift", "live_chat", [r"drift\.com", r"js\.driftt\.com"]),
    ("Crisp", "live_chat", [r"crisp\.chat", r"client\.crisp"]),
    ("Zendesk", "live_chat", [r"zendesk\.com", r"zopim\.com"]),
    ("Tidio", "live_chat", [r"tidio\.co", r"tidiochat"]),
    ("Tawk", "live_chat", [r"tawk\.to", r"embed\.tawk"]),
    ("Google Analytics", "analytics", [r"google-analytics\.com", r"googletagmanager\.com", r"gtag\("]),
    ("Hotjar", "analytics", [r"hotjar\.com", r"static\.hotjar"]),
    ("Clarity", "analytics", [r"clarity\.ms"]),
    ("Shopify", "ecommerce", [r"cdn\.shopify\.com", r"shopify\.com"]),
    ("WooCommerce", "ecommerce", [r"woocommerce", r"wc-"]),
    ("Magento", "ecommerce", [r"magento", r"mage"]),
    ("PrestaShop", "ecommerce", [r"prestashop"]),
    ("Stripe", "payment", [r"stripe\.com", r"js\.stripe"]),
    ("PayPal", "payment", [r"paypal\.com", r"paypalobjects"]),
    ("WordPress", "cms", [r"wp-content", r"wp-includes"]),
    ("Joomla", "cms", [r"joomla"]),
    ("Drupal", "cms", [r"drupal"]),
    ("React", "frameworks", [r"react", r"_next", r"__next"]),
    ("Vue.js", "frameworks", [r"vue\.js", r"__nuxt"]),
    ("Angular", "frameworks", [r"ng-", r"angular"]),
]

# Fingerprints of external tools in eight groups.
TOOL_FINGERPRINTS = [
    ("Hubspot", "crm", [r"js\.hs-scripts\.com", r"js\.hsforms\.net", r"hbspt\.", r"hs-banner\.com", r"hubspot\.com", r"_hsq\s*=", r"hs-analytics"]),
    ("Salesforce", "crm", [r"force\.com", r"salesforce\.com", r"pardot\.com", r"salesforceliveagent", r"sfdc\.com"]),
    ("Zoho", "crm", [r"zoho\.com", r"zohocdn\.com", r"salesiq\.zoho", r"zoho\.eu"]),
    ("Pipedrive", "crm", [r"pipedrive\.com", r"pipedrivewebforms"]),
    ("Freshsales", "crm", [r"freshsales\.io", r"freshworks\.com"]),
    ("Copper", "crm", [r"copper\.com", r"prosperworks\.com"]),
    ("Monday", "crm", [r"monday\.com"]),
    ("Close", "crm", [r"close\.com", r"close\.io"]),
    ("Insightly", "crm", [r"insightly\.com"]),
    ("Nimble", "crm", [r"nimble\.com"]),
    ("Intercom", "chat", [r"intercom\.io", r"intercomcdn\.com", r"widget\.intercom\.io", r"Intercom\("]),
    ("Drift", "chat", [r"drift\.com", r"js\.driftt\.com", r"drift\("]),
    ("Crisp", "chat", [r"crisp\.chat", r"client\.crisp\.chat", r"\$crisp"]),
    ("Zendesk_Chat", "chat", [r"zopim\.com", r"zendesk\.com/embeddable", r"zE\(", r"zESettings"]),
    ("Tidio", "chat", [r"tidio\.co", r"tidiochat\.com"]),
    ("Tawk", "chat", [r"tawk\.to", r"embed\.tawk\.to", r"Tawk_API"]),
    ("Livechat", "chat", [r"livechatinc\.com", r"livechat\.com", r"__lc\s*="]),
    ("Freshchat", "chat", [r"freshchat\.com", r"wchat\.freshchat"]),
    ("Olark", "chat", [r"olark\.com", r"olark\.identify"]),
    ("Chatra", "chat", [r"chatra\.io", r"chatra\.com"]),
    ("Userlike", "chat", [r"userlike\.com"]),
    ("Smartsupp", "chat", [r"smartsupp\.com", r"smartsuppchat"]),
    ("Customerly", "chat", [r"customerly\.io"]),
    ("Helpcrunch", "chat", [r"helpcrunch\.com"]),
    ("Mailchimp", "email_marketing", [r"mailchimp\.com", r"list-manage\.com", r"chimpstatic\.com", r"mc\.us\d+\.list-manage"]),
    ("Klaviyo", "email_marketing", [r"klaviyo\.com", r"static\.klaviyo\.com", r"_learnq\s*="]),
    ("Activecampaign", "email_marketing", [r"activecampaign\.com", r"activehosted\.com", r"trackcmp\.net"]),
    ("Convertkit", "email_marketing", [r"convertkit\.com", r"convertkit-mail"]),
    ("Sendinblue", "email_marketing", [r"sendinblue\.com", r"sibforms\.com", r"brevo\.com"]),
    ("Getresponse", "email_marketing", [r"getresponse\.com"]),
    ("Drip", "email_marketing", [r"getdrip\.com", r"dc\.js"]),
    ("Constant_Contact", "email_marketing", [r"constantcontact\.com", r"ctctcdn\.com"]),
    ("Aweber", "email_marketing", [r"aweber\.com"]),
    ("Omnisend", "email_marketing", [r"omnisend\.com", r"omnisrc\.com"]),
    ("Moosend", "email_marketing", [r"moosend\.com"]),
    ("Zendesk", "customer_support", [r"zendesk\.com", r"zdassets\.com", r"zdusercontent\.com"]),
    ("Freshdesk", "customer_support", [r"freshdesk\.com", r"freshworks\.com"]),
    ("Helpscout", "customer_support", [r"helpscout\.net", r"beacon-v2\.helpscout"]),
    ("Kayako", "customer_support", [r"kayako\.com"]),
    ("Groove", "customer_support", [r"groovehq\.com"]),
    ("Hotjar", "heatmaps", [r"hotjar\.com", r"static\.hotjar\.com", r"hj\s*=\s*hj\s*\|\|", r"hjSiteSettings"]),
    ("Crazyegg", "heatmaps", [r"crazyegg\.com", r"cetrk\.com"]),
    ("Fullstory", "heatmaps", [r"fullstory\.com", r"fs\.js"]),
    ("Mouseflow", "heatmaps", [r"mouseflow\.com"]),
    ("Luckyorange", "heatmaps", [r"luckyorange\.com"]),
    ("Clarity", "heatmaps", [r"clarity\.ms", r"microsoft clarity"]),
    ("Smartlook", "heatmaps", [r"smartlook\.com"]),
    ("Optimizely", "ab_testing", [r"optimizely\.com", r"cdn\.optimizely"]),
    ("Vwo", "ab_testing", [r"visualwebsiteoptimizer\.com", r"vwo\.com", r"dev\.visualwebsiteoptimizer"]),
    ("Google_Optimize", "ab_testing", [r"googleoptimize\.com", r"gtm/js\?id=OPT"]),
    ("Ablyft", "ab_testing", [r"ablyft\.com"]),
    ("Convert", "ab_testing", [r"convert\.com"]),
    ("Optinmonster", "popup", [r"optinmonster\.com", r"optmstr\.com"]),
    ("Sumo", "popup", [r"sumo\.com", r"sumome\.com"]),
    ("Privy", "popup", [r"privy\.com"]),
    ("Popupsmart", "popup", [r"popupsmart\.com"]),
    ("Sleeknote", "popup", [r"sleeknote\.com"]),
    ("Justuno", "popup", [r"justuno\.com"]),
    ("Wisepops", "popup", [r"wisepops\.com"]),
    ("Trustpilot", "reviews", [r"trustpilot\.com", r"widget\.trustpilot"]),
    ("Yotpo", "reviews", [r"yotpo\.com", r"staticw2\.yotpo"]),
    ("Bazaarvoice", "reviews", [r"bazaarvoice\.com"]),
    ("Judge_Me", "reviews", [r"judge\.me"]),
    ("Stamped", "reviews", [r"stamped\.io"]),
    ("Loox", "reviews", [r"loox\.io"]),
    ("Feefo", "reviews", [r"feefo\.com"]),
    ("Reviews_Io", "reviews", [r"reviews\.io"]),
    ("Ekomi", "reviews", [r"ekomi\.com"]),
]

# Platform words on the page.
PLATFORM_WORDS = [
    ("Shopify", "ecommerce", [r"shopify"]),
    ("WooCommerce", "ecommerce", [r"woocommerce", r"wc-"]),
    ("Magento", "ecommerce", [r"magento", r"mage"]),
    ("PrestaShop", "ecommerce", [r"prestashop"]),
    ("WordPress", "cms", [r"wp-content", r"wordpress"]),
    ("Joomla", "cms", [r"joomla"]),
    ("Drupal", "cms", [r"drupal"]),
    ("React/Next.js", "frameworks", [r"react", r"_next"]),
    ("Vue.js", "frameworks", [r"vue", r"__nuxt"]),
    ("Angular", "frameworks", [r"ng-", r"angular"]),
    ("Google Analytics", "analytics", [r"google-analytics", r"gtag", r"ga\("]),
    ("Hotjar", "analytics", [r"hotjar"]),
    ("Stripe", "payment", [r"stripe"]),
    ("PayPal", "payment", [r"paypal"]),
]

# Globals in inline scripts.
INLINE_GLOBALS = [
    ("dataLayer", r"\b(window\.)?dataLayer\s*="),
    ("gtag", r"\bgtag\s*\("),
    ("fbq", r"\bfbq\s*\("),
    ("_hsq (HubSpot)", r"\b_hsq\s*\.?\s*push"),
    ("hj (Hotjar)", r"\bhj\s*\("),
    ("ga()", r"\bga\s*\(\s*['\"]create['\"]"),
    ("Google Tag Manager", r"GTM-[A-Z0-9]+"),
    ("Klaviyo (_learnq)", r"\b_learnq\b"),
    ("Intercom", r"\bIntercom\s*\("),
    ("Drift", r"\bdrift\.\w+\s*\("),
    ("Segment (analytics.js)", r"\banalytics\.load\s*\("),
    ("Mixpanel", r"\bmixpanel\.\w+\s*\("),
    ("Stripe (Stripe())", r"\bStripe\s*\(\s*['\"]pk_"),
    ("Shopify", r"\bShopify\.\w+"),
    ("WordPress wp-", r"\bwp[-_](?:emoji|content|includes|admin)\b"),
    ("Tidio", r"\bTidio[A-Za-z]*\b"),
    ("Crisp", r"\b\$crisp\b"),
    ("LinkedIn Insight", r"\b_linkedin_partner_id\b"),
    ("TikTok Pixel (ttq)", r"\bttq\.\w+\s*\("),
    ("Pinterest tag", r"\bpintrk\s*\("),
    ("Microsoft Clarity", r"\bclarity\s*\("),
]

# Signatures in HTML comments.
COMMENT_SIGNATURES = [
    ("Yoast SEO", r"\bYoast\s*SEO\b"),
    ("RankMath", r"\bRank[\s-]?Math\b"),
    ("Elementor", r"\bElementor(?:\s*Pro)?\b"),
    ("WPBakery", r"\bWPBakery\b"),
    ("WP Rocket", r"\bWP[\s-]?Rocket\b"),
    ("WordPress", r"\bWordPress\b"),
    ("Joomla", r"\bJoomla\b"),
    ("Drupal", r"\bDrupal\b"),
    ("Shopify", r"\bShopify\b"),
    ("Wix", r"\bWix\.com\b"),
    ("Squarespace", r"\bSquarespace\b"),
    ("HubSpot", r"\bHubSpot\b"),
    ("Mailchimp", r"\bMailchimp\b"),
    ("Klaviyo", r"\bKlaviyo\b"),
    ("Stripe", r"\bStripe\b"),
    ("PayPal", r"\bPayPal\b"),
    ("Google Tag Manager", r"\bGoogle\s+Tag\s+Manager\b"),
    ("Google Analytics", r"\bGoogle\s+Analytics\b|\bgtag\.js\b"),
]

# Retargeting pixels, support widgets, email tools and popup tools.
PIXELS = [
    ("Meta Pixel", r"connect\.facebook\.net|fbq\s*\(|facebook\.com/tr\b|FB_PIXEL"),
    ("TikTok Pixel", r"analytics\.tiktok\.com|ttq\s*\(|tiktok\.com/i18n/pixel"),
    ("Google Ads", r"googleadservices\.com/pagead|AW-\d{7,}|google_conversion"),
    ("Google Tag Mgr", r"googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]+"),
    ("LinkedIn Insight", r"snap\.licdn\.com|linkedin\.com/px"),
    ("Pinterest", r"pintrk\s*\(|assets\.pinterest\.com"),
]
SUPPORT_WIDGETS = [
    ("WhatsApp", r"wa\.me/\d+|api\.whatsapp\.com/send|whatsapp-button"),
    ("Zendesk", r"zendesk\.com|zopim\.com|zE\s*\("),
    ("Intercom", r"widget\.intercom\.io|intercomSettings|Intercom\s*\("),
    ("Tidio", r"code\.tidio\.co"),
    ("Tawk.to", r"embed\.tawk\.to|Tawk_API"),
    ("Crisp", r"client\.crisp\.chat"),
    ("Drift", r"js\.driftt\.com"),
    ("LiveChat", r"livechatinc\.com|__lc\.license"),
]
EMAIL_TOOLS = [
    ("Mailchimp", r"mailchimp\.com|list-manage\.com|mc\.js"),
    ("Klaviyo", r"klaviyo\.com|_learnq\s*\(|klaviyoForms"),
    ("ActiveCampaign", r"activehosted\.com|trackcmp\.net"),
    ("Brevo", r"brevo\.com|sendinblue\.com"),
    ("ConvertKit", r"convertkit\.com|ck\.js"),
    ("HubSpot Email", r"js\.hs-scripts\.com|hbspt\s*\."),
    ("Drip", r"getdrip\.com|_dcq\s*="),
]
POPUPS = r"optinmonster|privy\.com|popupsmart|sumo\.com|wishpond|hellobar|wheelio|spin-a-sale|picreel|poptin|popup-maker|icegram"

# Shop platforms and review platforms, first hit wins.
SHOP_PLATFORMS = [
    ("Shopify", r"cdn\.shopify\.com|Shopify\.theme|myshopify\.com"),
    ("WooCommerce", r"woocommerce|wc-product|add-to-cart.*woocommerce"),
    ("Magento", r"mage/cookies|Magento_|mage\.cookies"),
    ("PrestaShop", r"prestashop|blockcart"),
    ("BigCommerce", r"bigcommerce|bc-sf-filter"),
]
REVIEW_PLATFORMS = [
    ("Trustpilot", r"trustpilot\.com|widget\.trustpilot"),
    ("Yotpo", r"yotpo\.com|staticw2\.yotpo|yotpo-widget"),
    ("Judge.me", r"judge\.me|judgeme|jdgm"),
    ("Stamped.io", r"stamped\.io|stampedio"),
    ("Loox", r"loox\.io|loox-widget"),
    ("Okendo", r"okendo\.io"),
    ("Reviews.io", r"reviews\.io|reviewswidget"),
    ("Schema Review", r'"@type"\s*:\s*"Review"'),
]

# Social networks, and link parts that mark a share button instead of a profile.
SOCIAL_HOSTS = ["instagram.com", "facebook.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com"]
SHARE_PARTS = [
    "share?", "/share/", "share=", "sharer.php", "/intent/", "intent/tweet", "intent=tweet", "/dialog/share", "/sharer/",
]
SOCIAL_WORDS = ["social", "linkedin", "instagram", "facebook", "twitter", "x.com", "youtube", "tiktok"]

# Technology names per category, in matching order.
CATEGORY_NAMES = [
    ("payment", ["paypal", "stripe", "square", "braintree", "adyen", "klarna", "afterpay", "affirm", "redsys", "bizum",
                 "mollie", "worldpay", "checkout.com", "razorpay", "mercadopago", "mercado pago", "apple pay", "google pay",
                 "amazon pay", "shopify payments", "wepay", "2checkout", "authorize.net", "payu", "skrill"]),
    ("crm", ["hubspot", "salesforce", "zoho", "pipedrive", "freshsales", "copper", "monday", "close", "insightly", "nimble",
             "zendesk sell", "microsoft dynamics", "sugarcrm", "vtiger", "odoo", "agile crm", "capsule", "keap", "infusionsoft"]),
    ("email_marketing", ["mailchimp", "klaviyo", "activecampaign", "convertkit", "sendinblue", "brevo", "getresponse", "drip",
                         "constant contact", "aweber", "omnisend", "moosend", "mailerlite", "campaign monitor", "sendgrid",
                         "mailjet", "emma", "dotdigital"]),
    ("live_chat", ["intercom", "drift", "crisp", "zendesk chat", "zendesk", "tidio", "tawk.to", "tawk", "livechat", "freshchat",
                   "olark", "chatra", "userlike", "smartsupp", "customerly", "helpcrunch", "gorgias", "zopim", "purechat",
                   "jivochat", "chaport", "comm100"]),
    ("analytics", ["google analytics", "google tag manager", "gtm", "ga4", "hotjar", "mixpanel", "amplitude", "heap",
                   "fullstory", "mouseflow", "crazy egg", "microsoft clarity", "clarity", "smartlook", "matomo", "plausible", "fathom", "segment",
                   "piwik", "clicky", "statcounter", "woopra", "kissmetrics"]),
    ("ecommerce", ["shopify", "woocommerce", "magento", "prestashop", "bigcommerce", "opencart", "vtex", "salesforce commerce",
                   "sap commerce", "wix stores", "squarespace commerce", "ecwid", "volusion", "3dcart", "nopcommerce",
                   "cs-cart", "oscommerce", "zen cart", "x-cart"]),
    ("cms", ["wordpress", "joomla", "drupal", "wix", "squarespace", "webflow", "ghost", "contentful", "strapi", "sanity",
             "prismic", "typo3", "sitecore", "kentico", "umbraco", "hubspot cms", "concrete5", "craft cms", "blogger", "medium"]),
    ("frameworks", ["react", "vue", "vue.js", "angular", "next.js", "nuxt", "nuxt.js", "gatsby", "svelte", "ember", "backbone"]),
    ("javascript_libraries", ["jquery"]),
    ("frameworks", ["bootstrap", "tailwind", "tailwindcss", "foundation", "bulma", "materialize"]),
    ("cdn", ["cloudflare", "akamai", "fastly", "amazon cloudfront", "cloudfront", "keycdn", "stackpath", "bunnycdn", "jsdelivr", "unpkg"]),
    ("hosting", ["aws", "amazon web services", "google cloud", "azure", "vercel", "netlify", "heroku", "digitalocean",
                 "linode", "godaddy", "bluehost", "siteground", "wpengine", "kinsta", "flywheel"]),
    ("security", ["hsts", "cloudflare bot management", "recaptcha", "hcaptcha", "auth0", "okta", "onelogin",
                  "let's encrypt", "comodo", "digicert"]),
    ("marketing_automation", ["marketo", "pardot", "eloqua", "autopilot", "sharpspring", "act-on"]),
    ("customer_support", ["freshdesk", "helpscout", "help scout", "kayako", "desk.com"]),
]

# Names looked for when nothing above matches (as a part of the technology's name).
KNOWN_NAMES = [("crm", ["sugar crm"])]

# The detector's own categories -> ours.
DETECTOR_CATEGORIES = {
    "cms": "cms", "blogs": "cms",
    "ecommerce": "ecommerce", "cart abandance": "ecommerce",
    "payment processors": "payment", "buy now pay later": "payment",
    "crm": "crm", "marketing automation": "marketing_automation",
    "email": "email_marketing", "newsletters": "email_marketing",
    "analytics": "analytics", "tag managers": "analytics", "a/b testing": "analytics", "heatmaps": "analytics",
    "session recording": "analytics",
    "live chat": "live_chat", "chatbots": "live_chat",
    "customer support": "customer_support", "helpdesk": "customer_support",
    "javascript frameworks": "frameworks", "web frameworks": "frameworks", "mobile frameworks": "frameworks",
    "javascript libraries": "javascript_libraries", "javascript graphics": "javascript_libraries",
    "ui frameworks": "javascript_libraries",
    "paas": "hosting", "iaas": "hosting", "hosting": "hosting", "cdn": "cdn",
    "security": "security", "ssl/tls certificate authorities": "security", "access management": "security",
}

# Multi-label categories; a name belongs where either name contains the other.
MULTI_CATEGORIES = [
    ("cms", ["WordPress", "Drupal", "Joomla", "Wix", "Squarespace", "Webflow", "Ghost", "Contentful", "Shopify", "Prestashop",
             "Magento", "OpenCart", "BigCommerce", "WooCommerce", "Sitecore", "Umbraco", "Typo3"]),
    ("payment", ["Stripe", "PayPal", "Klarna", "Redsys", "Bizum", "Braintree", "Authorize.Net", "Square", "2Checkout",
                 "Mollie", "Adyen", "Mercado Pago", "PayU"]),
    ("analytics", ["Google Analytics", "Hotjar", "Mixpanel", "Segment", "Amplitude", "Heap", "Matomo", "Clicky", "Woopra",
                   "Piwik", "Clarity", "FullStory", "Lucky Orange"]),
    ("ui_framework", ["Bootstrap", "Tailwind CSS", "Foundation", "Bulma", "Materialize", "Ant Design", "Chakra UI", "MUI",
                      "Semantic UI", "jQuery UI"]),
    ("chat_widget", ["Intercom", "Zendesk", "Drift", "Crisp", "Tidio", "Tawk.to", "LiveChat", "Freshdesk", "HubSpot Chat",
                     "Olark", "Userlike"]),
    ("ecommerce", ["Shopify", "WooCommerce", "Magento", "PrestaShop", "BigCommerce", "OpenCart", "Wix eCommerce",
                   "Squarespace Commerce"]),
    ("crm", ["HubSpot", "Salesforce", "Zoho", "Pipedrive", "ActiveCampaign", "Freshsales", "Monday", "Copper"]),
    ("email_marketing", ["Mailchimp", "Klaviyo", "ActiveCampaign", "Brevo", "ConvertKit", "GetResponse", "SendGrid",
                         "Campaign Monitor", "Drip", "Omnisend"]),
]

# Names that make a site a shop, a CMS site or a software service (as part of a technology's name).
TYPE_NAMES = {
    "ecommerce": ["shopify", "woocommerce", "magento", "prestashop", "bigcommerce", "opencart", "oscommerce", "zen cart",
                  "wix stores", "squarespace commerce", "ecwid", "volusion", "3dcart", "nopcommerce", "vtex",
                  "salesforce commerce"],
    "cms": ["wordpress", "joomla", "drupal", "wix", "squarespace", "webflow", "ghost", "contentful", "strapi", "sanity",
            "prismic", "typo3"],
    "saas": ["stripe", "chargebee", "recurly", "paddle", "fastspring", "auth0", "okta", "firebase", "supabase", "intercom",
             "crisp"],
    "payment": ["stripe", "paypal", "square", "braintree", "adyen", "klarna", "afterpay", "affirm", "sezzle", "redsys", "bizum"],
}

# Words for a category in a requirement -> the categories whose presence satisfies it.
REQUIREMENT_CATEGORIES = {
    "crm": ["crm"],
    "email": ["email_marketing", "marketing_automation"],
    "email marketing": ["email_marketing", "marketing_automation"],
    "chat": ["live_chat"], "live chat": ["live_chat"], "livechat": ["live_chat"],
    "analytics": ["analytics"],
    "ecommerce": ["ecommerce"], "e-commerce": ["ecommerce"],
    "cms": ["cms"],
    "payment": ["payment"], "pago": ["payment"],
}
TARGET_CATEGORIES = {
    "crm": ["crm"],
    "email": ["email_marketing", "marketing_automation"],
    "email marketing": ["email_marketing", "marketing_automation"],
    "email_marketing": ["email_marketing", "marketing_automation"],
    "live chat": ["live_chat"], "live_chat": ["live_chat"], "chat": ["live_chat"],
    "analytics": ["analytics"],
    "ecommerce": ["ecommerce"],
    "cms": ["cms"],
    "payment": ["payment"], "payments": ["payment"],
}
