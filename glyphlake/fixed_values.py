"""Word lists, tables, patterns and limits the results depend on.

They are facts of the data domain (file formats, style names, catalogue hosts)
and are kept together here, as plain text, so that every operator and every
test reads the same ones.
"""

# Words that name a generic CSS family rather than a typeface.
FAMILY_STOPWORDS = [
    "sansserif", "serif", "monospace", "cursive", "fantasy",
    "systemui", "uimonospace", "emoji", "math", "fangsong",
]

# Patterns over documents.
FONT_URL = r"\.(?:woff2|woff|otf|ttf)(?:\?[^\"'()\s<>]+)?$"
TEXT_RESOURCE = r"(?i)\.(?:css|js|mjs|cjs|json|webmanifest|txt|xml)(?:\?[^\"'()\s<>]+)?$"
FONT_HINT = r"(?i)@font-face|font-family|fontFamily|font\s*:\s*|\.woff2?|\.otf|\.ttf|typeface|glyph|variable"
NOISE_HOST = (
    r"(?i)(?:googletagmanager|google-analytics|doubleclick|googleoptimize|recaptcha|gstatic|google\.com"
    r"|hotjar|clarity\.ms|segment|sentry|newrelic|nr-data|intercom|crisp\.chat|cookiebot|trustarc"
    r"|optimizely|fullstory)"
)
NOISE_PATH = r"(?i)\.(?:png|jpe?g|gif|svg|webp|avif|mp4|webm|mp3|woff2?|ttf|otf)$"
RESOURCE_HINT = r"(?i)font|type|glyph|manifest|webpack|_next|assets|build|runtime|app|page-data"
CRAWL_SKIP = r"(?i)\.(?:png|jpe?g|gif|svg|webp|avif|mp4|webm|mp3|wav|pdf|zip|woff2?|otf|ttf)(?:$|\?)"
CRAWL_INCLUDE = ["/typefaces/", "/fonts/", "/font/", "/family/"]
CRAWL_EXCLUDE = ["/cart", "/checkout", "/login", "/account", "/privacy", "/terms", "/cdn-cgi/"]

# Style words at the end of a label: pattern, label, weight, slope; first hit wins.
STYLE_SUFFIXES = [
    (r"(?i)\b(?:extra\s*bold|ultra\s*bold)\s+italic$", "ExtraBold Italic", "800", "Italic"),
    (r"(?i)\bsemi\s*bold\s+italic$", "SemiBold Italic", "600", "Italic"),
    (r"(?i)\b(?:extra\s*light|ultra\s*light)\s+italic$", "ExtraLight Italic", "200", "Italic"),
    (r"(?i)\bthin\s+italic$", "Thin Italic", "100", "Italic"),
    (r"(?i)\blight\s+italic$", "Light Italic", "300", "Italic"),
    (r"(?i)\bnormal\s+italic$", "Italic", "400", "Italic"),
    (r"(?i)\bregular\s+italic$", "Regular Italic", "400", "Italic"),
    (r"(?i)\bmedium\s+italic$", "Medium Italic", "500", "Italic"),
    (r"(?i)\bbold\s+italic$", "Bold Italic", "700", "Italic"),
    (r"(?i)\bblack\s+italic$", "Black Italic", "900", "Italic"),
    (r"(?i)\bheavy\s+italic$", "Heavy Italic", "850", "Italic"),
    (r"(?i)\bitalic$", "Italic", "400", "Italic"),
    (r"(?i)\b(?:extra\s*bold|ultra\s*bold)$", "ExtraBold", "800", "Normal"),
    (r"(?i)\bsemi\s*bold$", "SemiBold", "600", "Normal"),
    (r"(?i)\b(?:extra\s*light|ultra\s*light)$", "ExtraLight", "200", "Normal"),
    (r"(?i)\bthin$", "Thin", "100", "Normal"),
    (r"(?i)\blight$", "Light", "300", "Normal"),
    (r"(?i)\bbook$", "Book", "400", "Normal"),
    (r"(?i)\bnormal$", "Regular", "400", "Normal"),
    (r"(?i)\bregular$", "Regular", "400", "Normal"),
    (r"(?i)\bmedium$", "Medium", "500", "Normal"),
    (r"(?i)\bbold$", "Bold", "700", "Normal"),
    (r"(?i)\bblack$", "Black", "900", "Normal"),
    (r"(?i)\bheavy$", "Heavy", "850", "Normal"),
]

# Weight ladders: upper bound of each step, label; above the last one "Black".
CSS_WEIGHT_STEPS = [
    (150, "Thin"), (250, "ExtraLight"), (350, "Light"), (450, "Regular"),
    (550, "Medium"), (650, "SemiBold"), (750, "Bold"), (850, "ExtraBold"),
]
NAME_WEIGHT_STEPS = [
    (100, "Thin"), (200, "ExtraLight"), (300, "Light"), (400, "Regular"),
    (500, "Medium"), (600, "SemiBold"), (700, "Bold"), (800, "ExtraBold"),
]
NAME_WEIGHT_WORDS = [
    ("hairline", "Hairline"), ("thin", "Thin"), ("extra-?light|ultra-?light", "ExtraLight"),
    ("light", "Light"), ("book", "Book"), ("regular|normal|roman", "Regular"),
    ("medium", "Medium"), ("semi-?bold|demi-?bold", "SemiBold"),
    ("extra-?bold|ultra-?bold", "ExtraBold"), ("heavy", "Heavy"), ("black", "Black"),
    ("bold", "Bold"),
]
HUNDRED_WEIGHTS = [
    (100, "Thin"), (200, "ExtraLight"), (300, "Light"), (400, "Regular"), (500, "Medium"),
    (600, "SemiBold"), (700, "Bold"), (800, "ExtraBold"), (900, "Black"),
]
HUNDRED_WEIGHT_REACH = 60

# Style-key rewrites, applied in order: pattern, replacement.
QUALITY_STYLE_REWRITES = [
    (r"semi[\s_-]?bold", "semibold"),
    (r"demi[\s_-]?bold", "semibold"),
    (r"extra[\s_-]?light", "extralight"),
    (r"\bex[\s_-]?light\b", "extralight"),
    (r"\bexlgt\b", "extralight"),
    (r"ultra[\s_-]?light", "extralight"),
    (r"extra[\s_-]?bold", "extrabold"),
    (r"\bex[\s_-]?bold\b", "extrabold"),
    (r"\bexbld\b", "extrabold"),
    (r"ultra[\s_-]?bold", "extrabold"),
    (r"\bdemo\b", ""),
    (r"\btrial\b", ""),
    (r"\blcg\b", ""),
    (r"\bweb\b", ""),
    (r"\bvariable\s*font\b", " variable "),
    (r"\bvf\b", " variable "),
    (r"[_-]+", " "),
    (r"\s+", " "),
    (r"[^a-z0-9]+", ""),
]
QUALITY_WEIGHTED_ITALIC = (
    r"(thin|extralight|light|book|regular|medium|semibold|demibold|bold|extrabold|black|heavy)italic$"
)
TARGET_STYLE_REWRITES = [
    (r"[_-]+", " "),
    (r"\s+", " "),
    (r"\bsemibld\b", "semibold"),
    (r"\bsemibd\b", "semibold"),
    (r"\bsemi[\s-]?bold\b", "semibold"),
    (r"\bextra[\s-]?light\b", "extralight"),
    (r"\bextra[\s-]?bold\b", "extrabold"),
    (r"\bex[\s-]?light\b", "extralight"),
    (r"\bex[\s-]?bold\b", "extrabold"),
    (r"\bexlgt\b", "extralight"),
    (r"\bexbld\b", "extrabold"),
    (r"\blgtitalic\b", "lightitalic"),
    (r"\bmeditalic\b", "mediumitalic"),
    (r"\bblditalic\b", "bolditalic"),
    (r"\bblkitalic\b", "blackitalic"),
    (r"\blgt\b", "light"),
    (r"\bmed\b", "medium"),
    (r"\bbld\b", "bold"),
    (r"\bblk\b", "black"),
    (r"\breg\b", "regular"),
    (r"\bital\b", "italic"),
    (r"[^a-z0-9]+", ""),
]

# File formats.
FORMAT_FOLDERS = {"woff2": "Webfonts/Woff2", "woff": "Webfonts/Woff", "ttf": "TTF", "otf": "OTF"}
FORMAT_KEYWORDS = ["woff2", "woff", "otf", "ttf", "eot", "zip"]
CORE_FORMATS = ["woff", "woff2", "otf", "ttf"]
MAGIC_HEX = {
    "774F4632": "woff2", "774F4646": "woff", "00010000": "ttf", "4F54544F": "otf", "504B0304": "zip",
}
FACE_SOURCE_ORDER = {"woff2": 0, "woff": 1, "otf": 2, "ttf": 3}
STYLE_SOURCE_RANK = {"woff2": 4, "woff": 3, "otf": 2, "ttf": 1}
WEB_FORMAT_RANK = {"woff2": 100, "otf": 95, "ttf": 90, "woff": 80}
DESKTOP_FORMAT_RANK = {"otf": 10, "ttf": 9, "woff2": 7, "woff": 6, "eot": 1}
RECOVERY_FORMAT_SCORE = {"woff2": 40, "woff": 25, "ttf": 20, "otf": 15}
PREVIEW_PRIORITY = {"otf": 4, "ttf": 4, "woff2": 3, "woff": 2, "zip": 1}
SUBSET_LIMIT = 50

# Licences whose id counts as open.
OPEN_LICENSES = ["OFL-1.1", "APACHE-2.0", "MIT", "CC0-1.0", "UFL", "PUBLIC-DOMAIN"]

# Stop words of package validation tokens.
VALIDATION_STOPWORDS = [
    "family", "font", "fonts", "type", "typeface", "foundry", "studio", "universal",
    "superfamily", "variable", "trial",
]

# Words that describe a sample sheet rather than a family.
SHEET_DESCRIPTORS = [
    "font", "fonts", "guide", "fontguide", "brochure", "catalog", "catalogue", "trial",
    "manual", "technical", "tech", "doc", "techdoc", "documentation", "character", "characters",
    "charset", "set", "glyph", "glyphs", "preview", "booklet", "sheet", "pdf", "download", "file",
]
SLUG_MARKERS = ["font", "fonts", "typeface", "typefaces", "family", "families", "product", "products"]
SHEET_STYLE_WORDS = (
    "air|thin|extralight|extra light|ultralight|ultra light|light|regular|book|retina|medium|semibold"
    "|semi bold|demibold|demi bold|bold|extrabold|extra bold|black|heavy|super"
)
SHEET_WIDTH_WORDS = "condensed|narrow|normal|text|display|mono|soft|extended"
COMPACT_STYLE = (
    r"\b(?:Condensed|Narrow|Normal|Text|Display|Mono|Soft|Extended)?"
    r"(?:Thin|Extralight|Light|Regular|Book|Medium|Semibold|Bold|Extrabold|Black|Heavy)(?:Italic|Oblique)?\b"
)
FEATURE_TAG = (
    r"(?i)\b(ss\d{2}|cv\d{2}|liga|dlig|calt|salt|onum|lnum|pnum|tnum|frac|afrc|sups|subs|smcp|c2sc|case"
    r"|ordn|kern|zero)\b"
)
SCRIPT_NAMES = [
    "latin", "cyrillic", "greek", "arabic", "hebrew", "thai", "hangul", "korean", "vietnamese",
    "japanese", "chinese", "devanagari",
]

# Shop products.
NOISE_HANDLE = r"^option-set-\d+-select-\d+$"
BUNDLE_LABEL = (
    r"(?i)\b(?:font\s*family|family\s*\+\s*variable|full\s*font\s*family|complete\s*family|all\s*styles?|family\s*pack)\b"
)
AXIS_LABEL = r"(?i)^(?:font\s*style|style|font\s*weight|weight|title)$"
WEIGHT_WORDS = (
    r"(?i)^regular(?:\s+(?:italic|oblique|slanted))?$|\b(?:italic|oblique|slanted|hairline|thin|extra\s*light|ultra\s*light"
    r"|light|book|medium|semi\s*bold|demi\s*bold|extra\s*bold|ultra\s*bold|bold|heavy|black)\b"
)

# Classes of files that anchors lead to.
LEGAL_DOCUMENT = r"(?:eula|license|licen[cs]e|terms|agreement|privacy)"
SHEET_DOCUMENT = r"(?:technical|glyph|character\s*set|brochure|catalog(?:ue)?)"
TRIAL_ASSET = r"(?:trial|demo|test|free)"
PREVIEW_HOST = "firebasestorage.googleapis.com"

# Challenge-page phrases (two soft ones or a strong one mark a page).
BLOCKED_SOFT = [
    "access denied", "request blocked", "forbidden", "verify (that )?you are human",
    "challenge required", "bot detection", "captcha", "turnstile", "just a moment", "attention required",
]
BLOCKED_STRONG = [
    "cf-challenge", "challenge-platform", "ray id", "perimeterx", "datadome", "hcaptcha", "recaptcha",
    "turnstile",
]

# Reasons of skipped or failed items: substring, code; first hit wins.
REASON_CODES = [
    ("timed out", "timeout"),
    ("quality-log status=fail", "quality_fail"),
    ("quality-log status=warn", "quality_warn"),
    ("style coverage too low", "coverage_low"),
    ("invalid fonts detected", "invalid_fonts"),
    ("italic mismatches", "italic_mismatch"),
    ("contamination fonts", "contamination"),
    ("validation-log status=fail", "validation_fail"),
    ("scraper returned 0", "no_candidates"),
    ("no scraper matched", "no_scraper"),
    ("downloaded only", "download_count_low"),
    ("first skip reason", "skip_signal"),
    ("expected scraper", "scraper_mismatch"),
    ("failed to fetch", "network_fetch"),
    ("request gagal", "network_fetch"),
]
NETWORK_TIMEOUT = (
    r"(?i)\b(err_connection_timed_out|timed out|timeout|failed to connect|connection attempt failed"
    r"|econnrefused|enotfound|ehostunreach)\b"
)
FETCH_FAILURE = (
    r"(?i)failed to fetch|fetch failed|request gagal|inline asset token missing|socket timeout|timed out"
    r"|econnreset|enotfound|abort"
)
BLOCKED_RESPONSE = r"(?i)request gagal \((401|403|407|429|444|500|502|503|504)\)"
HTML_LIKE_SKIP = r"(?i)<!doctype html|<html[\s>]|access denied|forbidden|cloudflare|captcha"

# Field names tried, in order, on items of a catalogue dump.
API_URL_PATHS = ["url", "woff2", "woff", "font_file.url", "font.url", "files.woff2", "file.url", "src"]
API_URL_KEYS = ["woff2", "woff", "url", "href", "src", "fileUrl", "file_url", "fontUrl", "font_url"]
API_NAME_PATHS = ["name", "family", "family_name", "full_name", "style_name", "font_name"]
API_LICENSE_PATHS = ["license", "license_id", "licenseId", "license_type"]

# File names that say nothing about the file.
OPAQUE_STEM_PREFIXES = ["lineto-font", "pangram-font", "abcdinamo-font", "klim-font"]

# Rate windows.
RATE_LIMIT_EVENTS = 10
RATE_LIMIT_SECONDS = 60

# Routing rules in registry order: id, part of the URL tested, pattern.
ROUTING_RULES = [
    ("lineto", "url", r"lineto\.com"),
    ("pangram", "url", r"pangram"),
    ("grillitype", "url", r"grillitype\.com|gt-type\.com"),
    ("w-type", "url", r"wtypefoundry\.com"),
    ("superiortype", "url", r"superiortype\.com"),
    ("klim", "host", r"(?i)(^|\.)klim\.co\.nz$"),
    ("swisstypefaces", "url", r"swisstypefaces\.com"),
    ("ohno", "url", r"ohnotype\.co"),
    ("abcdinamo", "url", r"abcdinamo\.com"),
    ("abjad-type", "host", r"^(www\.)?(buy\.)?abjadfonts\.com$"),
    ("205tf", "host", r"^(www\.)?(205|250)\.tf$"),
    ("a2-type", "url", r"(?i)(^|//)a2-type\.co\.uk|(?-i)a2-type\.co\.uk"),
    ("cotype", "url", r"cotypefoundry\.com"),
    ("monolisa", "url", r"monolisa\.dev"),
    ("groteskly", "url", r"groteskly\.xyz"),
    ("displaay", "url", r"displaay\.net"),
    ("brandingwithtype", "url", r"(?i)(^|//)brandingwithtype\.com|(?-i)brandingwithtype\.com"),
    ("typeji", "url", r"(?i)(^|//)(www\.)?typeji\.com"),
    ("julytype", "url", r"(?i)(^|//)(www\.)?julytype\.com"),
    ("generaltypestudio", "url", r"(?i)(^|//)(www\.)?generaltypestudio\.com"),
    ("massdriver", "host", r"(^|\.)mass-driver\.com$"),
    ("commercialtype", "url", r"(?i)(^|//)(www\.)?commercialtype\.com"),
    ("khtype", "url", r"(?i)(^|//)(www\.)?khtype\.com"),
    ("sharptype", "url", r"(?i)(^|//)(www\.)?sharptype\.co"),
    ("type-department", "url", r"(?i)(^|//)(www\.|staging\.)?type-department\.com"),
    ("narrowtype", "url", r"(?i)(^|//)(www\.)?narrowtype\.com"),
    ("productiontype", "url", r"(?i)(^|//)(www\.)?productiontype\.com"),
    ("arillatype", "url", r"(?i)(^|//)(www\.)?arillatype\.studio"),
    ("formulatype", "url", r"(?i)(^|//)(www\.)?formulatype\.com"),
    ("typefaces-pizza", "host", r"^(www\.)?typefaces\.pizza$"),
    ("nuformtype", "url", r"(?i)(^|//)(www\.)?nuformtype\.com"),
    ("hanli-type", "url", r"(?i)(^|//)(type\.)?hanli\.eu"),
    ("sourcetype", "host", r"^(www\.)?sourcetype\.com$"),
    ("typotheque", "host", r"(?i)(^|\.)typotheque\.com$"),
    ("typetype", "host", r"typetype\.org"),
    ("intervaltype", "host", r"intervaltype\.com"),
    ("due-studio", "host", r"due-studio\.com"),
    ("typejockeys", "url", r"(?i)(^|//)(www\.)?typejockeys\.com"),
    ("blazetype", "url", r"(?i)(^|//)(www\.)?blazetype\.eu"),
    ("fairetype", "url", r"(?i)(^|//)(www\.)?fairetype\.com"),
    ("deinwaller", "url", r"(?i)(^|//)(www\.)?deinwaller\.com"),
    ("renebieder", "url", r"(?i)(^|//)(www\.|store\.)?renebieder\.com"),
    ("viktorzumegen", "url", r"(?i)(^|//)(www\.)?viktorzumegen\.de"),
    ("optimo", "url", r"(?i)(^|//)(www\.)?optimo\.ch"),
    ("nodotypefoundry", "url", r"(?i)(^|//)(www\.)?nodotypefoundry\.com"),
    ("thedesignersfoundry", "host", r"^(www\.)?thedesignersfoundry\.com$"),
    ("saschabente", "url", r"saschabente\.com|saschabente\.de"),
    ("generic", "url", r""),
]

# Source presets: id, mode, items path, URL field, name field, licence field.
SOURCE_PRESETS = [
    ("google-fonts", "css-url", None, None, None, "OFL-1.1"),
    ("adobe-fonts", "css-url", None, None, None, "Proprietary"),
    ("lineto", "api-json", "styles", "woff2", "name", "Proprietary"),
    ("generic-api", "api-json", "data.fonts", "url", "family_name", "license_type"),
]

# Acceptance suite: case id, URL, time limit in ms, whether it may pass softly;
# the expected rule is the id itself, one file is the least each must give.
SUITE_CASES = [
    ("205tf", "https://www.205.tf/pinokio-sans", None, False),
    ("a2-type", "https://a2-type.co.uk/ny-sans", None, False),
    ("abcdinamo", "https://abcdinamo.com/typefaces/gravity", None, False),
    ("abjad-type", "https://www.abjadfonts.com/fonts/miknas", None, False),
    ("arillatype", "https://arillatype.studio/font/at-aero", None, False),
    ("blazetype", "https://blazetype.eu/typefaces/indecisive-sans/", 900_000, False),
    ("brandingwithtype", "https://brandingwithtype.com/typefaces/bw-gradual/buy", None, False),
    ("commercialtype", "https://commercialtype.com/catalog/focal", None, False),
    ("cotype", "https://cotypefoundry.com/font-family/aeonik", None, False),
    ("deinwaller", "https://deinwaller.com/gatch-1", None, False),
    ("lineto", "https://lineto.com/typefaces/akkurat", None, False),
    ("pangram", "https://pangrampangram.com/products/frama", None, False),
    ("grillitype", "https://www.grillitype.com/typeface/gt-standard", 900_000, False),
    ("w-type", "https://wtypefoundry.com/typefaces/wtf-forma", None, False),
    ("superiortype", "https://superiortype.com/fonts/raptor-v3", None, False),
    ("swisstypefaces", "https://www.swisstypefaces.com/fonts/sangbleu/", None, False),
    ("ohno", "https://ohnotype.co/fonts/degular", None, False),
    ("klim", "https://klim.co.nz/fonts/founders-grotesk/", None, False),
    ("displaay", "https://displaay.net/typeface/greed", None, False),
    ("due-studio", "https://www.due-studio.com/typefaces/analo-grotesk", None, False),
    ("formulatype", "https://formulatype.com/ft-habit", None, False),
    ("generaltypestudio", "https://www.generaltypestudio.com/fonts/senes", None, False),
    ("groteskly", "https://groteskly.xyz/fonts/rothek", None, False),
    ("hanli-type", "https://type.hanli.eu/gap/", None, False),
    ("intervaltype", "https://intervaltype.com/product/algorytm-clear/", None, False),
    ("julytype", "https://www.julytype.com/typefaces/jt-javel", None, False),
    ("khtype", "https://khtype.com/typeface/kh-interference/", None, False),
    ("massdriver", "https://mass-driver.com/typefaces/md-nichrome", None, False),
    ("monolisa", "https://www.monolisa.dev/", None, False),
    ("thedesignersfoundry", "https://www.thedesignersfoundry.com/typeface/tocapu", None, False),
    ("narrowtype", "https://narrowtype.com/fonts/neolit/", None, False),
    ("nuformtype", "https://nuformtype.com/rotina", None, False),
    ("productiontype", "https://productiontype.com/font/ciel", None, False),
    ("renebieder", "https://www.renebieder.com/fonts/neue-faktum", None, False),
    ("optimo", "https://optimo.ch/typefaces/basel", None, False),
    ("nodotypefoundry", "https://nodotypefoundry.com/typefaces/nt-rappel/", None, False),
    ("viktorzumegen", "https://www.viktorzumegen.de/choreo-collection.html", None, False),
    ("sharptype", "https://www.sharptype.co/typefaces/alpes", None, False),
    ("sourcetype", "https://sourcetype.com/typefaces/15263/un-11", None, True),
    ("type-department", "https://type-department.com/products/non-sans", None, False),
    ("typefaces-pizza", "https://typefaces.pizza/type/westy", None, False),
    ("typeji", "https://www.typeji.com/fonts/MinSans", None, False),
    ("typejockeys", "https://www.typejockeys.com/en/font/marie", None, False),
    ("typetype", "https://typetype.org/fonts/tt-turns/", None, False),
    ("typotheque", "https://www.typotheque.com/fonts/pristine", None, False),
    ("generic", "https://rsms.me/inter/", None, False),
]

# How a label is turned into words, in this order.
LABEL_REWRITES = [
    ("[?#].*$", ""),
    (r"\.[^.]+$", ""),
    (r"(?i)\.p\b", " "),
    ("[_-]+", " "),
    ("([A-Z]+)([A-Z][a-z])", "$1 $2"),
    ("([a-z0-9])([A-Z])", "$1 $2"),
    (r"(?i)\b[0-9a-f]{8,}\b", " "),
]

# A family loses the ending if its label matches.
FAMILY_ENDINGS = [
    (r"(?i)^(Regular|Italic|Regular Italic)$", r"(?i)\s+Normal$"),
    (r"(?i)(Bold|Black|Heavy|Extra)", r"(?i)\s+Extra$"),
]

# Points of a spelling, per word and per pattern.
SPELLING_POINTS_PER_WORD = 6
SPELLING_POINTS = [
    (r"^[^ ]*$", -5),
    (r"[A-Z]{2,}", 4),
    (r"[A-Z][a-z]+\s+[A-Z][a-z]+", 2),
    (r"^[a-z0-9 ]+$", -3),
]

# Points of a catalogue family for a request.
FAMILY_MATCH_POINTS = {
    "same_reference": 140,
    "alias_is_slug": 130,
    "same_reference_token": 120,
    "alias_token_is_slug_token": 110,
    "name_is_title": 120,
    "reference_is_title": 90,
    "slug_holds_reference": 70,
    "name_and_title_overlap": 50,
}

# Points of a face for a wanted style.
FACE_MATCH_POINTS = {
    "same_slope": 45,
    "other_slope": -25,
    "same_weight": 40,
    "same_hundred": 20,
    "other_weight": -8,
}
FACE_WORD_FOUND, FACE_WORD_MISSING = 8, -4

# What may follow a family in a document's name.
DOCUMENT_VERSION = r"^(?:v(?:er(?:sion)?)?\d+|\d+)$"
DOCUMENT_VERSION_START = r"^(?:v(?:er(?:sion)?)?\d+|\d)"

# Feature tags and control names of sample-sheet forms.
FORM_FEATURE_TAGS = [
    "liga", "dlig", "clig", "hlig", "rlig", "calt", "ccmp", "locl", "salt", "swsh", "frac", "ordn", "case",
    "zero", "tnum", "onum", "lnum", "pnum", "sups", "subs", "sinf", "smcp", "c2sc", "aalt", "kern", "mark", "mkmk",
]
FORM_FEATURE_CONTROLS = [
    "alternate", "ligature", "swashes", "fractions", "ordinals", "case-sensitive", "open-type-figure", "circle-numbers",
]
FORM_FEATURE_ATTRIBUTES = ["name", "id", "value", "data-feature", "data-tag", "data-opentype-feature"]

# Points of an asset's style token for a wanted style; the
# distance in length is taken off where one token lies in the other.
TOKEN_MATCH_POINTS = {"equal": 140, "inside": 98, "around": 88}
TOKEN_SLANT_POINTS = {"wanted_and_found": 10, "wanted_not_found": -20, "found_not_wanted": -8}
TOKEN_MATCH_LEAST = 60
