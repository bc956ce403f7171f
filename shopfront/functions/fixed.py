"""Word lists, patterns, limits and column orders that define the results.

Everything here is data. Patterns are written for both Java and RE2.
"""

# --- fixed values: page detectors -------------------------------------------------------
WHATSAPP = (
    r"(whatsapp|wa\.me/|wa\.link/|api\.whatsapp\.com|web\.whatsapp\.com|whatsapp://"
    r"|whatsapp-chat|joinchat|click-to-chat)"
)
MAPS = (
    r"(google\.[a-z.]+/maps|maps\.google\.|maps\.googleapis\.com|maps\.app\.goo\.gl"
    r"|goo\.gl/maps|g\.page/)"
)
BOOKING = (
    r"(calendly\.com|book\.?now|book[- ](an?|your|online|appointment|a )|appointment|reserve"
    r"|reservation|rendez-vous|réserver|حجز|booking|fresha\.com|setmore\.com"
    r"|acuityscheduling\.com|squareup\.com/appointments|simplybook\.me|vagaro\.com)"
)
PARKED = (
    "domain is for sale", "this domain is parked", "buy this domain",
    "domain may be for sale", "godaddy.com/domains", "related searches",
    "this web page is parked", "courtesy page",
)
MAINTENANCE_TEXT = "under maintenance"
MAINTENANCE_TITLE = "coming soon"
PLACEHOLDER_BYTES = 300
LOCAL_BUSINESS = "LocalBusiness"
LOCAL_BUSINESS_SUBTYPES = (
    "Dentist", "MedicalClinic", "HealthAndBeautyBusiness", "BeautySalon", "HairSalon",
    "ExerciseGym", "GymOrFitnessCenter", "RealEstateAgent", "Restaurant", "Spa",
)

# --- fixed values: contact details ------------------------------------------------------
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
EMAIL_BAD_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js")
EMAIL_BAD_DOMAINS = (
    "website.com", "yourdomain.com", "sentry.io", "example.com", "wixpress.com", "domain.com",
    "email.com",
)
WHATSAPP_NUMBER = r"(?:wa\.me/|phone=)\+?(\p{Nd}{7,15})"
INSTAGRAM = r"instagram\.com/([A-Za-z0-9_.]+)"
INSTAGRAM_RESERVED = ("p", "explore", "accounts", "reel", "sharer")
CONTACTS_KEPT = 3

# --- fixed values: forms ----------------------------------------------------------------
NOT_REAL_INPUTS = ("hidden", "submit", "button", "search", "image", "reset")
SEARCH_FORM_START = -100
REAL_FIELDS = 2

# --- fixed values: crawl plan and sitemaps ----------------------------------------------
NOT_PAGE_HREF = r"^(mailto:|tel:|javascript:|#|sms:|whatsapp:)"
ASSET_SUFFIXES = (
    "pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "zip", "doc", "docx",
    "xls", "xlsx", "mp4", "mp3", "css", "js", "xml", "ico",
)
PAGE_RANKS = (
    r"(contact|book|appointment|reserv|rendez-vous|nous[-_ ]joindre|حجز|اتصل)",
    r"(location|find[-_ ]?us|visit|direction|موقع)",
    r"(about|a-propos)",
)
MAX_SEGMENTS = 3
MAX_PATH_CHARS = 48
MAX_HYPHENS = 3
MAX_LABEL_CHARS = 40
MAX_PAGES = 8
SITEMAP_LOC = r"<loc>\s*([^<\s]+)\s*</loc>"
SITEMAP_FILES = 3
SITEMAP_CHILDREN = 2
SITEMAP_HEAD_BYTES = 50
SITEMAP_HTTP_SAMPLE = 50

# --- fixed values: audit limits ---------------------------------------------------------
SLOW_MS = 3000
HEAVY_KB = 3000

# --- fixed values: lead files -----------------------------------------------------------
LEAD_ALIASES = {
    "name": ["name", "business_name", "title", "company"],
    "website": ["website", "url", "site", "web", "homepage"],
    "phone": ["phone", "tel", "telephone", "phone_number", "contact_phone"],
    "email": ["email", "mail", "contact_email"],
    "address": ["address", "addr", "location", "street_address"],
    "city": ["city", "town"],
    "country": ["country"],
    "category": ["category", "sector", "type", "industry"],
}
LEAD_FIELDS = (
    "name", "website", "phone", "email", "address", "city", "country", "category",
    "source", "source_id", "lat", "lon",
)

# --- fixed values: OSM tags -------------------------------------------------------------
OSM_NAME = ("name", "name:en")
OSM_WEBSITE = ("website", "contact:website", "url")
OSM_PHONE = ("phone", "contact:phone")
OSM_EMAIL = ("email", "contact:email")
OSM_CATEGORY = ("amenity", "shop", "office", "craft", "leisure")
OSM_KINDS = ("node", "way", "relation")
OSM_TAG_SPEC = r"^([a-zA-Z0-9_:]+)(=(.*))?$"

# --- fixed values: audit row ------------------------------------------------------------
CHECKS = ("maps", "whatsapp", "booking", "form", "jsonld")
AUDIT_FIELDS = (
    "url", "fetched", "https", "https_error", "http_redirects_to_https", "sitemap_robots_http",
    "status", "mobile_viewport", "title", "meta_description", "has_jsonld_localbusiness",
    "has_maps_link", "has_whatsapp_link", "has_booking_link", "has_contact_form",
    "pages_checked", "pages_failed", "maps_found_on", "whatsapp_found_on", "booking_found_on",
    "form_found_on", "jsonld_found_on", "missing_sitewide", "missing_home_only",
    "broken_or_parked", "page_weight_kb", "load_time_ms", "has_sitemap", "robots_disallowed",
    "lang", "visible_text_chars", "emails", "whatsapp_number", "phones", "instagram", "error",
    "problems", "notes",
)

# --- fixed values: report wording -------------------------------------------------------
CHECK_LABELS = {
    "maps": "Google Maps link",
    "whatsapp": "WhatsApp link/button",
    "booking": "online booking link or contact/enquiry form",
    "jsonld": "LocalBusiness structured data",
}
CHECK_ADVICE = {
    "maps": "makes it harder for customers to find the physical location.",
    "whatsapp": "customers in this market expect one-tap WhatsApp contact.",
    "booking": "customers must call during business hours to book.",
    "jsonld": "Google/AI assistants can't read hours/address/phone directly.",
}
MESSAGES = {
    "no_url": "No website on file.",
    "robots": "robots.txt disallows automated checks; skipped the audit out of respect.",
    "no_response": "Site did not respond ({}).",
    "error_page": "Site returned an error page (HTTP {}).",
    "parked": "Site looks parked or placeholder, not a real business page.",
    "maintenance": "Site shows an under-maintenance / coming-soon page.",
    "missing": "No {} on {}, {}",
    "no_https": "No valid HTTPS{}, browsers mark it 'Not secure' or block it.",
    "no_redirect": "HTTPS works, but http:// does not redirect to https://, so old links and typed "
                   "addresses land on the 'Not secure' version.",
    "points_to_http": "sitemap.xml/robots.txt still point to http:// URLs, search engines are told "
                      "to index the insecure version.",
    "no_viewport": "No mobile viewport tag, the site will look broken on phones.",
    "no_title": "No <title>, hurts how the site shows up in search and when shared.",
    "no_description": "No meta description on the home page, search engines show a random snippet "
                      "instead.",
    "no_sitemap": "No sitemap.xml, can slow down how fully search engines index the site.",
    "slow": "Slow to load ({}ms), visitors tend to leave before it finishes.",
    "heavy": "Heavy page ({}KB), slow on mobile data.",
}
NOTE_HOME_ONLY = "No {} on the home page, but found on {}."
WHERE_HOME = "the home page (no contact/booking/location pages were found to check)"
WHERE_PAGES = "any of the {} pages checked ({})"
ERROR_NO_URL = "no url given"
ERROR_NO_RESPONSE = "no response"
ERROR_NO_HTTPS = "no response on https"

# Whitespace as Unicode-aware trimming sees it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
