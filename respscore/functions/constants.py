"""Fixed values that must equal the reference's for identical results.

Everything here is a constant of the ranking definition or of a public
standard (FNV-1a, ECMAScript white space); nothing is derived at run time.
"""

# --- fixed values: ranking definition -------------------------------------
PREFIX_BODY_UNITS = 51200       # 50 * 1024 UTF-16 code units: an optional cut (max_body_units)
HASH_BITS = 64
TOKEN_PATTERN = "[a-z0-9]+"     # maximal runs after lower-casing
UNKNOWN_TYPE = "unknown"        # MIME type for an empty/missing header
LENGTH_SIGMAS = 3.0             # length outlier saturates at 3 sigma
HIGH_RANK_THRESHOLD = 70        # rank > 70 is "high" (strict)
SCAN_DEFAULT_LIMIT = 500
SCAN_MIN_LIMIT = 1

# --- fixed values: FNV-1a 64-bit (public constants) ------------------------
FNV64_OFFSET = 0xCBF29CE484222325
FNV64_PRIME = 0x100000001B3     # 2**40 + 435

# --- fixed values: row colour rules, tested in this order -------------------
# status >= 500, >= 400, >= 300, then for 2xx: JSON, XML (not image/svg), HTML
COLOR_SERVER_ERROR = "#a32f2a"
COLOR_CLIENT_ERROR = "#a06008"
COLOR_REDIRECT = "#8a7a06"
COLOR_JSON = "#157a37"
COLOR_XML = "#0b4ea8"
COLOR_HTML = "#1f7aa8"
COLOR_NONE = "transparent"
JSON_MARKERS = ("application/json", "+json")
XML_MARKERS = ("application/xml", "text/xml", "+xml")
XML_EXCLUDE = "image/svg"
HTML_MARKERS = ("text/html", "application/xhtml+xml")

# --- fixed values: CSV export header ----------------------------------------
CSV_HEADER = ("Rank", "Method", "Status", "Length", "Type", "URL")

# --- fixed values: ECMAScript String.prototype.trim white space -------------
# WhiteSpace (TAB VT FF SP NBSP ZWNBSP + Zs) and LineTerminator (LF CR LS PS)
JS_TRIM_CLASS = (
    r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
