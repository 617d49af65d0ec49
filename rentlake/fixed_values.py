"""Fixed values.

Everything in this file is a value that results depend on: word lists, patterns,
host names, limits and text formats.  Patterns are written in ECMAScript spelling,
case-insensitive unless the name ends in ``_CS``; ``functions.regex`` turns them
into the spelling the JVM needs.
"""

# --- portals -----------------------------------------------------------------
UTM_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
TRACKING_HOST_PREFIXES = ("clicks.", "click.", "track.", "email.")
TRACKING_LABELS = ("www", "clicks", "click", "track", "email", "m")
LISTING_PATHS = {
    "immobiliare.it": (r"\/annunci\/\d+", r"\/affitto-"),
    "idealista.it": (r"\/immobile\/\d+", r"\/affitto\/", r"\/inmueble\/", r"\/proprieta\/"),
    "idealista.com": (r"\/immobile\/\d+", r"\/affitto\/", r"\/inmueble\/"),
    "fotocasa.es": (r"\/alquiler\/", r"\/comprar\/"),
    "casa.it": (r"\/immobili\/\d+", r"\/annunci\/\d+"),
    "subito.it": (r"\/affitto\/", r"\/case\/"),
}
PORTAL_HOST = r"idealista\.|immobiliare\.|casa\.it|subito\.it|fotocasa\."
CASA_URL_IMMOBILI = "https://www.casa.it/immobili/"
CASA_URL_ANNUNCI = "https://www.casa.it/annunci/"
IDEALISTA_URL = "https://www.idealista.it/immobile/"
ALERT_URL = "https://www.immobiliare.it/annunci/alert-"
FACEBOOK = "https://www.facebook.com"
CLICK_HOST = "clicks.immobiliare"
IMMOBILIARE_SUBJECTS = ("listings for your search", "nuovi annunci")

# URL preference: first pattern that matches gives the score.
URL_SCORES = (
    (r"clicks\.immobiliare", 1),
    (r"immobiliare\.it\/annunci\/alert-", 2),
    (r"idealista\.it\/immobile\/\d+", 10),
    (r"casa\.it\/immobili\/\d+", 10),
    (r"immobiliare\.it\/annunci\/\d+", 8),
)

# --- amounts -----------------------------------------------------------------
RENT_MONTHLY = r"€\s*([\d][\d.,\s]*)\s*(?:\/\s*)?(?:month|mese|mo\b)"
RENT_AFTER_SIGN = r"€\s*([\d][\d.,\s]*)"
RENT_AFTER_SIGN_TAIL = r"€\s*[\d][\d.,\s]*([\s\S]{0,8})"
AREA_TAIL = r"^\s*m[²2]"
RENT_BEFORE_SIGN = r"([\d][\d.,\s]*)\s*€"
RENT_THOUSAND = r"€\s*1[.,\s]?000\b|€\s*1\.000"
RENT_MONTH_WORD = r"(?:\/\s*)?(?:month|mese|mo\b)|\/mese|al mese"
RENT_HINT = r"(?:€\s*[\d.,\s]+\s*\/?\s*(?:month|mese|mo\b)|\/mese|al mese|affitto\s+\d|rent\s+\d)"
RENT_MIN, RENT_MAX, RENT_HINT_ABOVE = 150, 15_000, 1_500
AREA = r"(\d+)\s*m(?:q|²|2)"
ROOMS_EN = r"(\d+)\s*rooms?\b"
ROOMS_STANZE = r"(\d+)\s*stanze\b"
ROOMS_LOCALI = r"(\d+(?:[.,]\d+)?)\s*(?:locali|loc\.?|camere)"
ROOM_WORDS = (("monolocale", 1), ("bilocale", 2), ("trilocale", 3), ("quadrilocale", 4))
ROOMS_TITLE_PREFIX = r"^(\d+)[- ]room"
CONDO_FEE = r"(?:spese|condominio)[^\d]*(\d+)"

# --- alert messages ----------------------------------------------------------
RENT_ALERT = r"affitto-case|\/affitto-|properties for rent|for rent in|in affitto"
SALE_ALERT = r"vendita-case|\/vendita-|in vendita|[_-]sale[_-]|sale_professional|newad_sale"
FOOTER_LINK = (
    r"^(disable search|manage search|start search|download the app|discover|privacy"
    r"|general conditions|see details|unsubscribe|view all|see all)$"
)
IMMOBILIARE_ANCHOR = (
    r"(\d+[- ]room|bedroom|locali|bilocale|trilocale|quadri|appartamento|flat|villa"
    r"|villetta|loft|studio)"
)
IDEALISTA_SKIP = r"^vedi\s+\d+\s+foto$|^contatta$|^vedi tutti gli annunci"
IDEALISTA_ANCHOR = (
    r"^(trilocale|bilocale|monolocale|quadri|quadrilocale|appartamento|attico|villetta"
    r"|villa|loft|rustico|casa|stanza)\b|\b(in|a)\s+via\b"
)
CALL_TO_ACTION = (
    r"^vedi\s+\d*\s*foto|^vedi\s+(tutti|dettagli|annunci)|^(see|view)\s+(all|details|photos)"
)
SUBJECT_ALERT = r"^Un nuovo annuncio:\s*(.+)$"
BLOCK_LOCATION = (
    r"(?:Appartamento|Bilocale|Trilocale|Monolocale)?[^|€\n]{0,40}(?:in|a)\s+"
    r"[^|€\n]{8,100}(?:,\s*Torino)?"
)
CITY_WORD = r",?\s*torino\b"
HINT_AFTER_IN = r"\b(?:in|a)\s+(.+)$"
HINT_AFTER_TYPE = r"(?:flat|appartamento|villetta)\s+(.+)$"
HINT_BEFORE_TURIN = r",\s*([A-Za-zÀ-ÿ0-9\s.'-]+),\s*Turin"
IMMOBILE_ID = r"\/immobile\/(\d+)"
CLICK_ID_CS = r"\/f\/a\/([^/~]+)"
CASA_BLOCK_FACT = r"m(?:q|²|2)\b"
IDEALISTA_BLOCK_FACT = r"m²|stanze|locali"
CASA_BLOCK_DEPTH, IDEALISTA_BLOCK_DEPTH = 25, 30

# --- group posts -------------------------------------------------------------
ARTICLE = r'<div[^>]*role="article"[^>]*>([\s\S]*?)<\/div>\s*(?=<div[^>]*role="article"|$)'
FEED_CUT_MARKERS = (
    r"\bLike\s+Reply\b",
    r"\bLike\s*·\s*Comment\b",
    r"\bSee translation\b",
    r"\bView all \d+ repl",
    r"\bWrite a public comment\b",
)
FEED_UI_MARKERS = FEED_CUT_MARKERS + (r"\b\d+[mhd]\s+Like\b",)
STUDENT_MARKERS = (
    r"\bstudenti\b", r"\bstudent\b", r"\bstudents\b", r"\buniversitar", r"\buniversità\b",
    r"\buniversita\b", r"\bsolo\s+student", r"\bper\s+student", r"\bstudentesco\b",
    r"\berasmus\b", r"\bposto\s+letto\b", r"\bcamera\s+in\s+affitto\b",
    r"\bstanza\s+(?:singola|doppia)\b", r"\broom\s+for\s+rent\b", r"\bflat\s*share\b",
    r"\bcoliving\b",
)
RENT_MARKERS = (
    r"\baffitt", r"\baffitto\b", r"\brent\b", r"\blocation\b", r"\b€\s*\d", r"\d\s*€",
    r"\blocali\b", r"\bmq\b", r"\bm²\b", r"\btrilocale\b", r"\bbilocale\b",
)
SALE_MARKERS = (r"\bin\s+vendita\b", r"\bvendita\b", r"\bsale\b")
CONVERSATION_MARKERS = (
    r"\bmi interessa\b", r"\bsono interessat[oa]\b", r"\bscritto in privato\b",
    r"\ble ho scritto\b", r"\bbuongiorno,?\s+le ho scritto\b",
    r"\bsarebbe di tuo interesse\b", r"\bciao\s+\w+,?\s+mia mamma\b",
)
AFFITT = r"\baffitt"
EXPLICIT_RENT = (
    r"(?:€\s*\d{2,4}|\d{2,4}\s*€|\d{2,4}\s*(?:€|eur|euro)\s*(?:\/|\b)?\s*(?:mese|mo|month))"
)
POST_URL = r"""https?:\/\/[^\s<>"')]+"""
POST_URL_TAIL_CS = r"[.,;:!?)]+$"
POST_PLACE = (
    r"\b(?:Torino|Turin|Cenisia|Cit Turin|Pozzo Strada|San Donato|Rivoli|Bernini)\b[^.,\n]{0,40}"
)
POST_SOURCE = "facebook.group"
POST_TITLE_DEFAULT = "Facebook listing"
GROUP_ID = r"^\d+$|^[a-zA-Z][\w.-]{2,}$"

# --- keys and places ---------------------------------------------------------
STREET = (
    r"\b(?:via|corso|largo|piazza|vicolo|strada|str\.?)\s+([a-z0-9]+)(?:\s+(\d+[a-z]?))?"
)
SNC = r"\bs\.?\s*n\.?\s*c\.?\b"
EARTH_RADIUS_M = 6_371_000

# --- scoring -----------------------------------------------------------------
REPLY_KEYS = (
    "budgetFit", "sizeForFamily", "targetZone", "dataComplete", "costClarity",
    "notStudentShared", "layoutFit", "listingTrust", "descriptionQuality",
)
RATING_KEYS = REPLY_KEYS + ("proximityToReference",)
RISK_PAYMENT = r"western union|crypto|wire transfer|pagare prima"
RISK_MESSENGER = r"solo whatsapp|contatta su telegram"
RISK_RENT_BELOW = 400
RISK_FLAGS = ("suspicious payment", "messenger-only contact", "anomalously low price")
ZONE_MISS_REASON = "⚠️ zone not in targets (Cenisia, Pozzo Strada, …)"
FEE_MISSING_REASON = "⚠️ spese not mentioned in email"
LANDMARK_REASON = "near metro/landmark"

# --- digest ------------------------------------------------------------------
SUSPICIOUS_DIVIDER = "🚨 Suspicious (review):"
NO_LINK_LINE = "🔗 (link from email — run pipeline/run after updating parsers)"
DUPLICATE_LINE = "↔️ Possible duplicate (same address/rent/rooms): "
TIP_RULES = (
    'The JSON "summary" field must be exactly ONE sentence in English (max 30 words).\n'
    "Give a practical tip for this family: fit, trade-off, or what to check on viewing.\n"
    "Do not repeat scores, rent, rooms, or m² from the listing."
)
